"""Behavioural features per address."""

from pyspark.sql import DataFrame, Window, functions as F

from logsleuth.functions.columns import micros
from logsleuth.operators.activity import HONEY_USERS, Activity, addresses_of
from logsleuth.operators.distribute import first_events
from logsleuth.operators.enrich import with_geo, with_geo_risk, with_reputation
from logsleuth.schema import IP_FEATURE_COLUMNS

MINUTE = 60_000_000


def ip_activity(
    events: DataFrame, honey_users: list[str] = HONEY_USERS, activity: Activity | None = None
) -> DataFrame:
    """Counts, time span and intelligence of each address, in a single aggregation.

    Intelligence is derived from the address and its failures, so no join is needed. With
    ``activity`` nothing is read of the events, and its decoy users count.
    """
    return with_reputation(with_geo_risk(with_geo(addresses_of(events, activity, honey_users))))


def _gaps(events: DataFrame) -> DataFrame:
    """Every gap between different neighbouring times of an address, one row each.

    Times are made distinct first, so repeated lines collapse before the shuffle.
    Gaps inside a minute come from a window over (address, minute); gaps between
    minutes from a window over one row per minute. The largest group is thus a
    minute of one address, or the minutes of the log's time span.
    """
    stamps = events.select("ip_address", micros("parsed_time").alias("t")).distinct()
    inside = Window.partitionBy("ip_address", "_minute").orderBy("t")
    within = stamps.withColumn("_minute", F.floor(F.col("t") / MINUTE)).withColumn(
        "gap", F.col("t") - F.lag("t").over(inside)
    )
    across = Window.partitionBy("ip_address").orderBy("_minute")
    between = (
        within.groupBy("ip_address", "_minute")
        .agg(F.min("t").alias("_first"), F.max("t").alias("_last"))
        .withColumn("gap", F.col("_first") - F.lag("_last").over(across))
    )
    gaps = within.select("ip_address", "gap").unionByName(between.select("ip_address", "gap"))
    return gaps.filter(F.col("gap").isNotNull()).withColumn("gap", F.col("gap") / 1e6)


def inter_event_times(events: DataFrame) -> DataFrame:
    """Mean-free part of the gap statistics per address: counts, moments, minimum."""
    return (
        _gaps(events)
        .groupBy("ip_address")
        .agg(
            F.count("*").alias("gaps"),
            F.avg("gap").alias("gap_mean"),
            F.var_pop("gap").alias("gap_var"),
            F.min("gap").alias("gap_min"),
        )
    )


def ip_features(events: DataFrame, activity: Activity | None = None) -> DataFrame:
    """Address and its thirteen features.

    Events at the very same time are gaps of zero. They are not materialised: their
    number is known, and they are merged into the moments of the non-zero gaps.
    """
    gaps = F.coalesce(F.col("gaps"), F.lit(0))
    every = F.col("total_events") - 1
    zeros = every - gaps
    mean = F.coalesce(F.col("gap_mean"), F.lit(0.0))
    squares = F.coalesce(F.col("gap_var"), F.lit(0.0)) * gaps + mean * mean * gaps * zeros / F.greatest(
        every, F.lit(1)
    )
    return (
        ip_activity(events, activity=activity)
        .join(inter_event_times(events), "ip_address", "left")
        .withColumns(
            {
                "iet_mean": F.when(every > 0, F.col("span_seconds") / every).otherwise(0.0),
                "iet_std": F.when(every > 1, F.sqrt(squares / (every - 1))).otherwise(0.0),
                "iet_min": F.when((every > 0) & (zeros == 0), F.col("gap_min")).otherwise(0.0),
                "fail_ratio": F.col("failed_count") / F.col("total_events"),
            }
        )
        .select("ip_address", *IP_FEATURE_COLUMNS)
    )


def first_seen(events: DataFrame) -> DataFrame:
    """Position of the first event of each address in the total order of events."""
    return first_events(events, ["ip_address"]).withColumnRenamed("first", "first_seen")
