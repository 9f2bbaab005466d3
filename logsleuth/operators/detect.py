"""Rule-based detection: one aggregation per address, thresholds as scalar subqueries."""

from pyspark.sql import DataFrame, functions as F

from logsleuth.functions.columns import (
    failed_count,
    is_night_login,
    normal_cdf,
    round_half_even,
    success_count,
)
from logsleuth.schema import FAILED, SUCCESS

# Baseline without any failures, smallest deviation and threshold.
EMPTY_MEAN, EMPTY_SIGMA, MIN_SIGMA, MIN_THRESHOLD = 3.0, 1.5, 1.0, 3.0
MAX_CONFIDENCE = 0.999
STUFFING_RATIO, STUFFING_USERS = 0.5, 2
COMPROMISE_TEXT = "FAILED → SUCCESS (Compromise Likely)"


def failures_per_ip(events: DataFrame, addresses: DataFrame | None = None) -> DataFrame:
    """Failures of each failing address, from the events or from their ``addresses``."""
    if addresses is not None:
        return addresses.filter("failed_count > 0").select("ip_address", "failed_count")
    return (
        events.filter(F.col("event") == FAILED)
        .groupBy("ip_address")
        .agg(F.count("*").alias("failed_count"))
    )


def adaptive_threshold(
    events: DataFrame, z_score: float = 2.5, addresses: DataFrame | None = None
) -> DataFrame:
    """One row: mean and deviation of failures per failing address, and the threshold.

    A single failing address has no sample deviation; the smallest one is used then.
    """
    stats = failures_per_ip(events, addresses).agg(
        F.avg("failed_count").alias("mean"), F.stddev_samp("failed_count").alias("sigma")
    )
    none = F.col("mean").isNull()
    sigma = F.when(none, EMPTY_SIGMA).otherwise(
        F.greatest(F.coalesce(F.col("sigma"), F.lit(MIN_SIGMA)), F.lit(MIN_SIGMA))
    )
    return stats.select(
        F.when(none, EMPTY_MEAN).otherwise(F.col("mean")).alias("mean"), sigma.alias("sigma")
    ).withColumn(
        "threshold", F.greatest(F.col("mean") + z_score * F.col("sigma"), F.lit(MIN_THRESHOLD))
    )


def _baseline(events: DataFrame, z_score: float, addresses: DataFrame | None):
    return adaptive_threshold(events, z_score, addresses).select(F.struct("mean", "sigma", "threshold")).scalar()


def bruteforce(events: DataFrame, z_score: float = 2.5, addresses: DataFrame | None = None) -> DataFrame:
    """Failing addresses with threshold, flag and confidence.

    ``addresses``, here and below, are those of an Activity: then no events are read.
    """
    base = F.col("_base")
    confidence = F.least(
        normal_cdf(F.col("failed_count").cast("double"), base["mean"], base["sigma"]),
        F.lit(MAX_CONFIDENCE),
    )
    return (
        failures_per_ip(events, addresses)
        .withColumn("_base", _baseline(events, z_score, addresses))
        .select(
            "ip_address",
            "failed_count",
            round_half_even(base["threshold"], 1).alias("threshold"),
            (F.col("failed_count") >= base["threshold"]).alias("is_bruteforce"),
            round_half_even(confidence, 3).alias("confidence"),
        )
    )


def night_logins(events: DataFrame, night_end: int = 5) -> DataFrame:
    return events.filter(is_night_login(night_end))


def credential_stuffing(events: DataFrame, addresses: DataFrame | None = None) -> DataFrame:
    """Failing addresses by how many different users they tried."""
    if addresses is None:
        tried = events.filter(F.col("event") == FAILED).groupBy("ip_address").agg(
            F.count_distinct("username").alias("unique_users"),
            F.count("username").alias("total_attempts"),
        )
    else:
        tried = addresses.filter("failed_count > 0").select(
            "ip_address",
            F.col("failing_users").alias("unique_users"),
            F.coalesce("failed_with_user", F.lit(0)).alias("total_attempts"),
        )
    ratio = F.coalesce(F.try_divide("unique_users", "total_attempts"), F.lit(0.0))
    return (
        tried.withColumn(
            "spray_ratio", round_half_even(ratio, 3)
        )
        .withColumn(
            "is_stuffing",
            (F.col("spray_ratio") > STUFFING_RATIO) & (F.col("unique_users") > STUFFING_USERS),
        )
    )


def compromise_pattern(
    events: DataFrame, z_score: float = 2.5, addresses: DataFrame | None = None
) -> DataFrame:
    """Addresses with many failures whose first failure precedes their last success."""
    failed, success = F.col("event") == FAILED, F.col("event") == SUCCESS
    if addresses is None:
        logins = events.filter(failed | success).groupBy("ip_address").agg(
            failed_count().alias("failed_count"),
            success_count().alias("success_count"),
            F.min(F.when(failed, F.col("parsed_time"))).alias("first_fail"),
            F.max(F.when(success, F.col("parsed_time"))).alias("last_success"),
        )
    else:
        logins = addresses.select("ip_address", "failed_count", "success_count", "first_fail", "last_success")
    return (
        logins.withColumn("_base", _baseline(events, z_score, addresses))
        .filter(
            (F.col("failed_count") >= F.col("_base.threshold"))
            & (F.col("success_count") > 0)
            & (F.col("first_fail") < F.col("last_success"))
        )
        .drop("_base")
        .withColumn("pattern", F.lit(COMPROMISE_TEXT))
    )


def multi_host_access(events: DataFrame, addresses: DataFrame | None = None) -> DataFrame:
    """Addresses seen on more than one host."""
    if addresses is None:
        addresses = events.groupBy("ip_address").agg(
            F.count_distinct("host").alias("hosts_accessed"), F.count("*").alias("total_events")
        )
    return addresses.select("ip_address", "hosts_accessed", "total_events").filter(F.col("hosts_accessed") > 1)


def bruteforce_fixed(events: DataFrame, failed_threshold: int = 3) -> DataFrame:
    """Simple profile: failures per address at or above a fixed number, most first."""
    return (
        failures_per_ip(events)
        .filter(F.col("failed_count") >= failed_threshold)
        .orderBy(F.desc("failed_count"), "ip_address")
    )


def compromise_fixed(events: DataFrame, failed_threshold: int = 3) -> DataFrame:
    """Simple profile: enough failures and any success, in whatever order."""
    return (
        events.groupBy("ip_address")
        .agg(
            failed_count().alias("failed_count"),
            success_count().alias("success_count"),
            F.count("*").alias("total_events"),
        )
        .filter((F.col("failed_count") >= failed_threshold) & (F.col("success_count") > 0))
    )
