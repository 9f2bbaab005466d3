"""Insider threats: users whose behaviour shows several warning signs."""

from pyspark.sql import DataFrame, functions as F

from logsleuth.functions.columns import is_night_login
from logsleuth.schema import ROOT, SUDO

# Usual number of addresses, and what makes a user a threat.
USUAL_ADDRESSES = 3
MIN_INDICATORS = 2
MIN_RISK = 0.3


def insider_threats(events: DataFrame, profiles: DataFrame) -> DataFrame:
    """Profiled users with at least two indicators or a high risk, riskiest first."""
    activity = events.groupBy("username").agg(
        F.count("*").alias("event_count"),
        F.count_if(is_night_login()).alias("_nights"),
        F.count_distinct("ip_address").alias("_addresses"),
        F.count_if(F.col("event").isin(ROOT, SUDO)).alias("_privilege"),
    )
    signs = F.array_compact(
        F.array(
            F.when(
                F.col("current_state").isin("COMPROMISED", "ELEVATED"),
                F.concat(F.lit("HMM state: "), "current_state"),
            ),
            F.when(F.col("_nights") > 0, F.format_string("%d night logins detected", "_nights")),
            F.when(
                F.col("_addresses") > USUAL_ADDRESSES,
                F.format_string("Accessed from %d different IPs", "_addresses"),
            ),
            F.when(
                F.col("_privilege") > 0,
                F.format_string("%d privilege escalation attempts", "_privilege"),
            ),
        )
    )
    return (
        profiles.select("username", "current_state", F.col("risk").alias("risk_score"))
        .join(activity, "username")
        .withColumn("indicators", signs)
        .filter((F.size("indicators") >= MIN_INDICATORS) | (F.col("risk_score") > MIN_RISK))
        .select("username", "risk_score", "current_state", "indicators", "event_count")
        .orderBy(F.desc("risk_score"), "username")
    )
