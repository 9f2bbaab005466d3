"""Summary tables behind report sections, cards and charts."""

from pyspark.sql import DataFrame, Window, functions as F

from logsleuth.functions.columns import failed_count, micros, success_count, wall_clock
from logsleuth.operators.activity import Activity
from logsleuth.operators.distribute import global_index, with_previous
from logsleuth.operators.scoring import LEVEL_NAMES, factor_table
from logsleuth.schema import EVENT_ORDER, FAILED, INTERNAL_IP

# Weekdays in report order, spike rule, factor rows shown.
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
SPIKE_DEVIATIONS = 2
TOP_ADDRESSES = 5
MINUTES_PER_DAY = 1440


def event_type_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event").agg(F.count("*").alias("events"))


def failed_by_ip(events: DataFrame) -> DataFrame:
    return (
        events.filter(F.col("event") == FAILED)
        .groupBy("ip_address")
        .agg(F.count("*").alias("failed_count"))
        .orderBy(F.desc("failed_count"), "ip_address")
    )


def fail_success_by_ip(events: DataFrame) -> DataFrame:
    return events.groupBy("ip_address").agg(
        failed_count().alias("failed"), success_count().alias("success")
    )


def unique_ips(events: DataFrame) -> DataFrame:
    return events.select("ip_address").filter(F.col("ip_address") != INTERNAL_IP).distinct()


def events_by_ip(events: DataFrame, ip: str) -> DataFrame:
    return events.filter(F.col("ip_address") == ip).orderBy(*EVENT_ORDER)


def events_by_time(events: DataFrame) -> DataFrame:
    return events.orderBy(*EVENT_ORDER)


def timeline(session_events: DataFrame, block: int | None = None) -> DataFrame:
    """All events in time order, marking where the session differs from the row before."""
    rows = session_events.select(
        *EVENT_ORDER, "ip_address", "username", "event", "session_id"
    )
    marked = with_previous(
        global_index(rows, EVENT_ORDER, "position"), "position", "session_id", "_before", block
    )
    changed = F.col("_before").isNotNull() & (F.col("_before") != F.col("session_id"))
    return marked.withColumn("session_changed", changed).drop("_before").orderBy("position")


def kpi_counts(events: DataFrame, scores: DataFrame, addresses: DataFrame | None = None) -> DataFrame:
    """One row: events, failures, successes, rated and distinct addresses.

    ``addresses``, those of an Activity, save the pass over the events.
    """
    rated = scores.agg(
        F.struct(
            F.count_if(F.col("level") == "CRITICAL").alias("critical"),
            F.count_if(F.col("level") == "HIGH").alias("high"),
        )
    ).scalar()
    ip = F.col("ip_address")
    if addresses is None:
        addresses = events.groupBy("ip_address").agg(
            F.count("*").alias("total_events"),
            failed_count().alias("failed_count"),
            success_count().alias("success_count"),
        )
    return (
        addresses.agg(
            F.coalesce(F.sum("total_events"), F.lit(0)).alias("total"),
            F.coalesce(F.sum("failed_count"), F.lit(0)).alias("failed"),
            F.coalesce(F.sum("success_count"), F.lit(0)).alias("success"),
            F.count("*").alias("all_ips"),
            F.count_if(ip != INTERNAL_IP).alias("unique_ips"),
        )
        .withColumn("_rated", rated)
        .withColumns(
            {"critical_ips": F.col("_rated.critical"), "high_risk_ips": F.col("_rated.high")}
        )
        .drop("_rated")
    )


def failed_heatmap(events: DataFrame) -> DataFrame:
    """Failed logins per weekday and hour; all weekdays and hours are present."""
    spine = events.sparkSession.createDataFrame(
        list(enumerate(WEEKDAYS)), "position int, weekday string"
    )
    hours = list(range(24))
    counts = (
        events.filter(F.col("event") == FAILED)
        .withColumn("_hour", F.hour("parsed_time"))
        .groupBy(F.weekday("parsed_time").alias("position"))
        .pivot("_hour", hours)
        .agg(F.count(F.lit(1)))
    )
    named = counts.select("position", *[F.col(str(h)).alias(f"h{h:02d}") for h in hours])
    return (
        spine.join(named, "position", "left")
        .na.fill(0, [f"h{h:02d}" for h in hours])
        .orderBy("position")
        .drop("position")
    )


def login_frequency(events: DataFrame) -> DataFrame:
    """Events per minute including empty minutes, with the spike threshold and flag.

    The statistics need no spine: empty minutes only add zeros to the known number
    of minutes. Empty minutes are filled in behind the minutes that have events, day by day.
    """
    counts = events.groupBy(F.floor(micros("parsed_time") / 60_000_000).alias("minute")).agg(
        F.count("*").alias("events")
    )
    minutes = F.max("minute") - F.min("minute") + 1
    total, squares = F.sum("events"), F.sum(F.col("events") * F.col("events"))
    variance = (squares - total * total / minutes) / (minutes - 1)
    stats = counts.agg(
        F.struct(
            F.min("minute").alias("first"),
            F.max("minute").alias("last"),
            (total / minutes).alias("mean"),
            F.when(minutes > 1, F.sqrt(F.greatest(variance, F.lit(0.0)))).alias("sigma"),
        ).alias("s")
    )
    threshold = F.col("s.mean") + SPIKE_DEVIATIONS * F.col("s.sigma")
    limits = stats.select(F.struct(F.col("s.last").alias("last"), threshold.alias("threshold"))).scalar()
    # Every day has a row at its first minute, so that all others can be filled in by day:
    # the days are dealt out before any minute is made.
    per_day = F.floor(F.col("minute") / MINUTES_PER_DAY)
    days = stats.select(
        F.explode(
            F.sequence(F.floor(F.col("s.first") / MINUTES_PER_DAY), F.floor(F.col("s.last") / MINUTES_PER_DAY))
        ).alias("day"),
        F.col("s.first").alias("first"),
    ).select("day", F.greatest(F.col("day") * MINUTES_PER_DAY, "first").alias("minute"), F.lit(0).cast("long").alias("events"))
    rows = counts.select(per_day.alias("day"), "minute", "events").unionByName(days)
    known = rows.groupBy("day", "minute").agg(F.max("events").alias("events"))
    following = F.lead("minute").over(Window.partitionBy("day").orderBy("minute")) - 1
    end = F.least((F.col("day") + 1) * MINUTES_PER_DAY - 1, F.col("_limits.last"))
    return (
        known.withColumn("_until", following)
        .withColumn("_limits", limits)
        .withColumn("_until", F.coalesce("_until", end))
        .select(
            F.explode(F.sequence("minute", "_until")).alias("at"),
            "minute",
            "events",
            F.col("_limits.threshold").alias("threshold"),
        )
        .select(
            wall_clock(F.col("at") * 60_000_000).alias("minute"),
            F.when(F.col("at") == F.col("minute"), F.col("events")).otherwise(0).alias("events"),
            "threshold",
        )
        .withColumn("is_spike", F.coalesce(F.col("events") > F.col("threshold"), F.lit(False)))
    )


def technique_counts(enriched: DataFrame) -> DataFrame:
    """Events per technique with its tactic, share, and whether it is above the median."""
    counts = enriched.groupBy("mitre_technique", "mitre_tactic").agg(F.count("*").alias("events"))
    stats = counts.agg(
        F.struct(F.median("events").alias("median"), F.sum("events").alias("total"))
    ).scalar()
    parts = F.split("mitre_technique", " — ")
    return (
        counts.withColumn("_stats", stats)
        .select(
            "mitre_technique",
            parts[0].alias("technique_id"),
            parts[1].alias("technique_name"),
            "mitre_tactic",
            "events",
            (F.col("events") / F.col("_stats.total")).alias("share"),
            (F.col("events") > F.col("_stats.median")).alias("above_median"),
        )
        .orderBy(F.desc("events"), "mitre_technique")
    )


def tactic_counts(enriched: DataFrame) -> DataFrame:
    """Events per tactic, in percent of all and relative to the largest."""
    counts = enriched.groupBy("mitre_tactic").agg(F.count("*").alias("events"))
    stats = counts.agg(
        F.struct(F.sum("events").alias("total"), F.max("events").alias("largest"))
    ).scalar()
    return (
        counts.withColumn("_stats", stats)
        .select(
            "mitre_tactic",
            "events",
            (F.col("events") / F.col("_stats.total") * 100).alias("percent"),
            (F.col("events") / F.col("_stats.largest")).alias("of_largest"),
        )
        .orderBy(F.desc("events"), "mitre_tactic")
    )


def geo_breakdown(intel: DataFrame) -> DataFrame:
    """Addresses, events and mean risk per country, from the per-address table."""
    return (
        intel.groupBy("geo_country")
        .agg(
            F.count("*").alias("ips"),
            F.sum("total_events").alias("events"),
            (F.sum(F.col("geo_risk") * F.col("total_events")) / F.sum("total_events")).alias("avg_risk"),
        )
        .orderBy(F.desc("ips"), "geo_country")
    )


def severity_ranking(scores: DataFrame) -> DataFrame:
    """Addresses by falling score with their rank."""
    ranked = global_index(
        scores.select("ip_address", "score", "level"), [F.desc("score"), "ip_address"], "_at"
    )
    return ranked.select(
        (F.col("_at") + 1).alias("severity_rank"), "ip_address", "score", "level"
    ).orderBy("severity_rank")


def top_factor_breakdown(scores: DataFrame, addresses: int = TOP_ADDRESSES) -> DataFrame:
    """All factors of the addresses with the highest scores."""
    top = scores.orderBy(F.desc("score"), "ip_address").limit(addresses)
    return (
        factor_table(top)
        .join(top.select("ip_address", "score", "level"), "ip_address")
        .orderBy(F.desc("score"), "ip_address", "position")
    )


def anomaly_ranking(anomaly: DataFrame) -> DataFrame:
    status = F.when(F.col("is_anomaly"), "ANOMALY").otherwise("normal")
    return anomaly.withColumn("status", status).orderBy(F.desc("anomaly_score"), "ip_address")


def campaign_members(campaigns: DataFrame) -> DataFrame:
    """Members of each campaign and their number, one row per member."""
    grouped = campaigns.filter(F.col("campaign_cluster") >= 0)
    sizes = grouped.groupBy("campaign_cluster").agg(F.count("*").alias("members"))
    return (
        grouped.join(sizes, "campaign_cluster")
        .select("campaign_cluster", "cluster_label", "members", "ip_address")
        .orderBy("campaign_cluster", "ip_address")
    )


def user_risk_ranking(profiles: DataFrame) -> DataFrame:
    return profiles.select("username", "current_state", "risk").orderBy(F.desc("risk"), "username")


def executive_summary(
    events: DataFrame,
    scores: DataFrame,
    bruteforce: DataFrame,
    compromised: DataFrame,
    anomaly: DataFrame,
    chains: DataFrame,
    sessions: DataFrame,
    activity: Activity | None = None,
) -> DataFrame:
    """One row with the headline numbers of an analysis; with ``activity`` from its tables."""
    levels = scores.agg(
        F.struct(*[F.count_if(F.col("level") == n).alias(n.lower()) for n in LEVEL_NAMES])
    ).scalar()
    chain = chains.agg(
        F.struct(F.count("*").alias("n"), F.max("kill_chain_progress").alias("progress"))
    ).scalar()
    worst = F.lit("LOW")
    for name in reversed(LEVEL_NAMES[:-1]):
        worst = F.when(F.col(f"_levels.{name.lower()}") > 0, name).otherwise(worst)
    total, first, last = F.count("*"), "parsed_time", "parsed_time"
    if activity is not None:
        total, first, last = F.coalesce(F.sum("total_events"), F.lit(0)), "first_seen", "last_seen"
    return (
        (events if activity is None else activity.cells)
        .agg(
            total.alias("total_events"),
            F.min(first).alias("window_start"),
            F.max(last).alias("window_end"),
            F.count_distinct("username").alias("users"),
        )
        .withColumns(
            {
                "_levels": levels,
                "_chain": chain,
                "bruteforce_sources": bruteforce.agg(F.count_if("is_bruteforce")).scalar(),
                "compromise_patterns": compromised.agg(F.count("*")).scalar(),
                "anomalous_ips": anomaly.agg(F.count_if("is_anomaly")).scalar(),
                "sessions": sessions.agg(F.count("*")).scalar(),
            }
        )
        .select(
            worst.alias("threat_level"),
            "total_events",
            F.col("_levels.critical").alias("critical_ips"),
            F.col("_levels.high").alias("high_ips"),
            "bruteforce_sources",
            "compromise_patterns",
            "anomalous_ips",
            F.col("_chain.n").alias("attack_chains"),
            F.col("_chain.progress").alias("max_progress"),
            "window_start",
            "window_end",
            ((micros("window_end") - micros("window_start")) / 3.6e9).alias("duration_hours"),
            "users",
            "sessions",
        )
    )
