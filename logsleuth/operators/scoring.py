"""Multi-factor risk score per address and what follows from it."""

from pyspark.sql import Column, DataFrame, functions as F

from logsleuth.functions.columns import (
    failed_count,
    is_night_login,
    round_half_even,
    success_count,
)
from logsleuth.operators.activity import HONEY_USERS, Activity
from logsleuth.operators.features import ip_activity

# Factor column, display name and weight, in display order.
FACTORS = [
    ("failed_log", "Failed Logins (log₂)", 1.0),
    ("compromise", "Compromise Pattern", 1.0),
    ("night_fraction", "Night Login Fraction", 1.0),
    ("anomaly", "AI Anomaly Score", 1.0),
    ("reputation", "IP Reputation Penalty", 1.0),
    ("geo_risk", "Geo Risk", 1.0),
    ("spray", "User Spray", 1.0),
    ("velocity", "Login Velocity", 1.0),
]
HONEY_FACTOR = "DECEPTION TRIGGER"
HONEY_TEXT = "Interacted with Honey-Token (Zero False Positive)"
HONEY_SCORE = 100.0

# Lowest score of each level; anything below is LOW.
LEVELS = [("CRITICAL", 40.0), ("HIGH", 25.0), ("MEDIUM", 12.0)]
SIMPLE_LEVELS = [("CRITICAL", 15), ("HIGH", 8), ("MEDIUM", 4)]
LEVEL_NAMES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]


def level_of(score: Column, levels: list = LEVELS) -> Column:
    level = F.lit("LOW")
    for name, lowest in reversed(levels):
        level = F.when(score >= lowest, name).otherwise(level)
    return level


def _text(template: str, *columns) -> Column:
    return F.format_string(template, *columns)


def risk_factors(
    events: DataFrame, anomaly: DataFrame, honey_users: list[str] = HONEY_USERS, activity: Activity | None = None
) -> DataFrame:
    """One row per address with the raw points and description of every factor.

    ``anomaly`` has (ip_address, anomaly_score); addresses it lacks score 0. With ``activity``
    the events are not read.
    """
    ips = ip_activity(events, honey_users, activity).join(
        anomaly.select("ip_address", "anomaly_score"), "ip_address", "left"
    )
    failed, success = F.col("failed_count"), F.col("success_count")
    logins = F.greatest(success, F.lit(1))
    score = F.coalesce(F.col("anomaly_score"), F.lit(0.0))
    hours = F.greatest(F.col("span_seconds") / 3600.0, F.lit(0.01))
    velocity = F.when(F.col("total_events") > 1, F.col("total_events") / hours).otherwise(0.0)
    compromised = (failed >= 3) & (success > 0)
    points = {
        "failed_log": F.log2(1 + failed) * 5,
        "compromise": F.when(compromised, 10.0).otherwise(0.0),
        "night_fraction": F.col("night_logins") / logins * 8,
        "anomaly": F.col("anomaly_score") * 15,
        "reputation": (1 - F.col("ip_reputation")) * 10,
        "geo_risk": F.col("geo_risk") * 5,
        "spray": F.col("unique_users") / F.col("total_events") * 20,
        "velocity": F.least(F.col("events_per_hour") * 2, F.lit(10.0)),
    }
    texts = {
        "failed_log": _text("%d failed → log₂(%d)×5", failed, failed + 1),
        "compromise": F.concat(
            F.when(compromised, "Yes").otherwise("No"), F.lit(" (fail≥3 + success>0)")
        ),
        "night_fraction": _text("%d/%d night/success × 8", "night_logins", logins),
        "anomaly": _text("Isolation Forest: %.3f × 15", "anomaly_score"),
        "reputation": _text("(1 - %.3f) × 10", "ip_reputation"),
        "geo_risk": _text("Country risk: %.2f × 5", F.col("geo_risk")),
        "spray": _text("%d users / %d events × 20", "unique_users", "total_events"),
        "velocity": _text("%.1f events/hr (capped at 10)", "events_per_hour"),
    }
    return ips.withColumns({"anomaly_score": score, "events_per_hour": velocity}).select(
        "ip_address",
        "geo_country",
        "honey_contact",
        *[
            F.struct(
                round_half_even(points[key], 2).alias("raw"),
                round_half_even(points[key] * weight, 2).alias("weighted"),
                texts[key].alias("description"),
            ).alias(key)
            for key, _, weight in FACTORS
        ],
    )


def risk_scores(
    events: DataFrame, anomaly: DataFrame, honey_users: list[str] = HONEY_USERS, activity: Activity | None = None
) -> DataFrame:
    """Score, level and factor list per address; contact with a decoy user overrides all."""
    total = sum((F.col(key)["raw"] * weight for key, _, weight in FACTORS), F.lit(0.0))
    honey = F.col("honey_contact")
    listed = F.array(
        *[
            F.struct(
                F.lit(position).alias("position"),
                F.lit(name).alias("factor"),
                F.col(key)["raw"].alias("raw"),
                F.col(key)["weighted"].alias("weighted"),
                F.col(key)["description"].alias("description"),
            )
            for position, (key, name, _) in enumerate(FACTORS, 1)
        ]
    )
    decoy = F.array(
        F.struct(
            F.lit(1).alias("position"),
            F.lit(HONEY_FACTOR).alias("factor"),
            F.lit(HONEY_SCORE).alias("raw"),
            F.lit(HONEY_SCORE).alias("weighted"),
            F.lit(HONEY_TEXT).alias("description"),
        )
    )
    return (
        risk_factors(events, anomaly, honey_users, activity)
        .withColumn("score", F.when(honey, HONEY_SCORE).otherwise(round_half_even(total, 2)))
        .withColumn("level", level_of(F.col("score")))
        .withColumn("factors", F.when(honey, decoy).otherwise(listed))
        .select("ip_address", "geo_country", "score", "level", "factors")
    )


def factor_table(scores: DataFrame) -> DataFrame:
    """Long form of the factors: one row per address and factor."""
    return scores.select("ip_address", F.explode("factors").alias("f")).select("ip_address", "f.*")


def severity_summary(scores: DataFrame) -> DataFrame:
    """Addresses per level, with zeros for levels nobody has."""
    spine = scores.sparkSession.createDataFrame([(n,) for n in LEVEL_NAMES], "level string")
    counts = scores.groupBy("level").agg(F.count("*").alias("ips"))
    return spine.join(counts, "level", "left").na.fill(0, ["ips"])


def top_factor(scores: DataFrame) -> DataFrame:
    """Factor with the most weighted points of each address; the first one on a tie."""
    ranked = F.transform(
        "factors", lambda f: F.struct(f["weighted"], (-f["position"]).alias("p"), f["factor"])
    )
    return scores.select(
        "ip_address", "score", "level", "geo_country", F.array_max(ranked)["factor"].alias("top_factor")
    ).orderBy(F.desc("score"), "ip_address")


def severity_simple(events: DataFrame, night_end: int = 5) -> DataFrame:
    """Simple profile: points for failures, successes and night logins."""
    return (
        events.groupBy("ip_address")
        .agg(
            failed_count().alias("failed_count"),
            success_count().alias("success_count"),
            F.count_if(is_night_login(night_end)).alias("night_logins"),
        )
        .withColumn(
            "score", F.col("failed_count") * 2 + F.col("success_count") * 3 + F.col("night_logins") * 5
        )
        .withColumn("level", level_of(F.col("score"), SIMPLE_LEVELS))
    )
