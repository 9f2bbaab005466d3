"""Stored tables: events, overlays on them, analysis runs and the scored export."""

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from logsleuth.operators.distribute import skew_join, store
from logsleuth.schema import OVERLAY_DEFAULTS

# Columns an address-wide update may not touch.
PER_EVENT_ONLY = ["session_id", "tamper_flag"]
EVENT_FIELDS = list(OVERLAY_DEFAULTS)
IP_FIELDS = [c for c in OVERLAY_DEFAULTS if c not in PER_EVENT_ONLY]
DEFAULT_SCORE, DEFAULT_LEVEL = 0.0, "LOW"


def write_events(events: DataFrame, path: str, fresh: bool = False) -> int:
    """Store events as Parquet by day, replacing or extending the table; number stored.

    Rows are clustered by day before writing, with several tasks per busy day, so
    that no day ends up as one task or as thousands of small files.
    """
    from pyspark.sql import Observation

    stored = Observation()
    (
        events.withColumn("event_date", F.col("parsed_time").cast("date"))
        .observe(stored, F.count("*").alias("rows"))
        .hint("rebalance", "event_date")
        .write.mode("overwrite" if fresh else "append")
        .partitionBy("event_date")
        .parquet(path)
    )
    return stored.get["rows"]


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("event_date")


def with_overlay_columns(events: DataFrame) -> DataFrame:
    """Events with every later-stage column, at its default where it is missing."""
    missing = {c: d for c, d in OVERLAY_DEFAULTS.items() if c not in events.columns}
    return events.withColumns({c: F.lit(v).cast(t) for c, (t, v) in missing.items()})


def _overlay(events, updates, keys, allowed, join):
    fields = [c for c in updates.columns if c in allowed]
    renamed = updates.select(*keys, *[F.col(c).alias(f"_{c}") for c in fields])
    joined = join(with_overlay_columns(events), renamed)
    return joined.withColumns({c: F.coalesce(f"_{c}", c) for c in fields}).drop(
        *[f"_{c}" for c in fields]
    )


def overlay_by_event(events: DataFrame, updates: DataFrame, keys=("source_file", "line_number")):
    """Set the given fields on single events; other columns of ``updates`` are ignored.

    Of several updates with one key the largest counts, field by field from the first on:
    events are never multiplied.
    """
    keys = list(keys)
    fields = [c for c in updates.columns if c in EVENT_FIELDS]
    if fields:
        updates = updates.groupBy(*keys).agg(F.max(F.struct(*fields)).alias("_u")).select(*keys, "_u.*")
    return _overlay(events, updates, keys, EVENT_FIELDS, lambda e, u: e.join(u, keys, "left"))


def _event_counts(events: DataFrame, addresses: DataFrame | None) -> DataFrame:
    if addresses is not None:
        return addresses.select("ip_address", F.col("total_events").alias("_events"))
    return events.groupBy("ip_address").agg(F.count("*").alias("_events"))


def overlay_by_ip(events: DataFrame, updates: DataFrame, addresses: DataFrame | None = None) -> DataFrame:
    """Set the given fields on all events of each address in ``updates``.

    ``addresses``, those of an Activity, save a pass over the events to count them.
    """

    def join(all_events, per_ip):
        table = store(_event_counts(events, addresses).join(per_ip, "ip_address"))
        return skew_join(all_events, table, ["ip_address"], "_events")

    return _overlay(events, updates, ["ip_address"], IP_FIELDS, join)


def analysis_run(events, bruteforce, scores, log_file: str, config: dict, addresses: DataFrame | None = None) -> DataFrame:
    """One row describing an analysis."""
    settings = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in config.items()]))
    counts = _event_counts(events, addresses).agg(F.coalesce(F.sum("_events"), F.lit(0)).alias("total_events"))
    return counts.select(
        F.current_timestamp().alias("run_time"),
        F.lit(log_file).alias("log_file"),
        "total_events",
        bruteforce.agg(F.count_if("is_bruteforce")).scalar().alias("suspects"),
        scores.agg(F.count_if(F.col("level") == "CRITICAL")).scalar().alias("critical"),
        settings.alias("config_json"),
    )


def _append_once(rows: DataFrame, path: str, run_id: str | None) -> None:
    """Add rows in a folder of their run: a run that is repeated replaces its own rows."""
    rows.write.mode("overwrite").parquet(f"{path}/run={run_id or uuid.uuid4().hex}")


def append_run_log(run: DataFrame, path: str, run_id: str | None = None) -> None:
    """Add an analysis run to the stored log; give retries the ``run_id`` of the first try."""
    _append_once(run, path, run_id)


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("run")


def append_actions(actions: DataFrame, path: str, run_id: str | None = None) -> None:
    """Add response actions to the stored log, with the time at which that is done.

    Give retries the ``run_id`` of the first try: their actions are then stored once.
    """
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    _append_once(actions.select(now.alias("time"), "*"), path, run_id)


def read_actions(spark: SparkSession, path: str) -> DataFrame:
    """All actions taken so far: a history for :func:`response_actions`."""
    return spark.read.parquet(path).drop("run")


def scored_events(events: DataFrame, scores: DataFrame, addresses: DataFrame | None = None) -> DataFrame:
    """Events with the score and level of their address, times as text.

    ``addresses``, those of an Activity, save a pass over the events to count them.
    """
    rated = scores.select(
        "ip_address", F.col("score").alias("risk_score"), F.col("level").alias("severity_level")
    )
    table = store(_event_counts(events, addresses).join(rated, "ip_address"))
    return (
        skew_join(events, table, ["ip_address"], "_events")
        .na.fill({"risk_score": DEFAULT_SCORE, "severity_level": DEFAULT_LEVEL})
        .withColumn("parsed_time", F.date_format("parsed_time", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    )


def export_scored_csv(
    events: DataFrame, scores: DataFrame, path: str, addresses: DataFrame | None = None
) -> T.StructType:
    """Write the scored events as CSV; returns the schema to read them back with."""
    table = scored_events(events, scores, addresses)
    table.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return table.schema


def read_scored_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def export_plain_csv(events: DataFrame, path: str) -> None:
    """Simple profile: events as they are, times to the second."""
    text = F.date_format("parsed_time", "yyyy-MM-dd HH:mm:ss")
    events.withColumn("parsed_time", text).write.mode("overwrite").option("header", True).csv(path)
