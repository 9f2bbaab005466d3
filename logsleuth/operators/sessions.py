"""Sessions: runs of events of one address without a pause longer than the timeout."""

from pyspark.sql import DataFrame, Window, functions as F

from logsleuth.functions.columns import micros
from logsleuth.operators.distribute import earliest_line, global_index, skew_join, store
from logsleuth.schema import EVENT_ORDER


def _slots(events: DataFrame, width: int) -> DataFrame:
    """One row per address and time slot as wide as the timeout.

    Two events in one slot are never further apart than the timeout, so a session
    can only break between slots. That makes this aggregation, combined before the
    shuffle, all that is needed of the events, however many share an address.
    """
    timed = events.select("ip_address", *EVENT_ORDER, micros("parsed_time").alias("t"))
    return (
        timed.groupBy("ip_address", F.floor(F.col("t") / width).alias("slot"), "source_file")
        .agg(
            F.count("*").alias("n"),
            F.min("t").alias("slot_start"),
            F.max("t").alias("slot_end"),
            F.min("parsed_time").alias("parsed_time"),
            earliest_line("t").alias("line_number"),
        )
        .groupBy("ip_address", "slot")
        .agg(
            F.sum("n").alias("slot_events"),
            F.min("slot_start").alias("slot_start"),
            F.max("slot_end").alias("slot_end"),
            F.min(F.struct(*EVENT_ORDER)).alias("first"),
        )
    )


def session_slots(events: DataFrame, timeout_minutes: int = 30) -> DataFrame:
    """Slots with the ordinal of their session within the address."""
    width = timeout_minutes * 60_000_000
    by_ip = Window.partitionBy("ip_address").orderBy("slot")
    pause = F.col("slot_start") - F.lag("slot_end").over(by_ip)
    return (
        _slots(events, width)
        .withColumn("_new", (pause > width).cast("long"))
        .withColumn("ordinal", F.sum(F.coalesce("_new", F.lit(0))).over(by_ip))
        .drop("_new")
    )


def _numbered(slots: DataFrame) -> DataFrame:
    """Sessions made of slots, numbered over all addresses by the order they start in."""
    runs = (
        slots.groupBy("ip_address", "ordinal")
        .agg(
            F.min("first").alias("first"),
            F.sum("slot_events").alias("event_count"),
            F.min("slot_start").alias("start_micros"),
            F.max("slot_end").alias("end_micros"),
        )
        .select("ip_address", "ordinal", "event_count", "start_micros", "end_micros", "first.*")
    )
    return global_index(runs, [*EVENT_ORDER, "ip_address"], "_number").select(
        F.format_string("S-%04d", F.col("_number") + 1).alias("session_id"),
        "ip_address",
        "ordinal",
        F.col("parsed_time").alias("session_start"),
        ((F.col("end_micros") - F.col("start_micros")) / 1e6).alias("duration_seconds"),
        "event_count",
    )


def sessions(events: DataFrame, timeout_minutes: int = 30) -> DataFrame:
    """One row per session with its id, start, duration and number of events."""
    return _numbered(session_slots(events, timeout_minutes))


def link_sessions(events: DataFrame, timeout_minutes: int = 30) -> DataFrame:
    """Events with the id of their session."""
    slots = store(session_slots(events, timeout_minutes))
    slot_ids = slots.join(
        _numbered(slots).select("ip_address", "ordinal", "session_id"), ["ip_address", "ordinal"]
    ).select("ip_address", "slot", "session_id", "slot_events")
    width = timeout_minutes * 60_000_000
    slotted = events.withColumn("slot", F.floor(micros("parsed_time") / width))
    return skew_join(slotted, slot_ids, ["ip_address", "slot"], "slot_events").drop("slot")
