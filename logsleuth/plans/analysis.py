"""Whole analyses: from logs to scores, chains, responses and summary tables."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from logsleuth.operators import (
    anomaly,
    behaviour,
    campaigns,
    chains,
    detect,
    enrich,
    features,
    insiders,
    pivots,
    reports,
    response,
    scoring,
    sessions,
    tamper,
)
from logsleuth.operators.activity import Activity, activity_of
from logsleuth.operators.distribute import cut, store
from logsleuth.sources.text_logs import parse_simple_profile, read_auth_logs


def run_models(events: DataFrame, activity: Activity | None = None) -> dict[str, DataFrame]:
    """Anomalies, campaigns and user profiles; the feature table is made only once."""
    per_ip = store(features.ip_features(events, activity))
    return {
        "features": per_ip,
        "anomaly": anomaly.isolation_forest(per_ip),
        "campaigns": campaigns.ip_campaigns(per_ip, features.first_seen(events)),
        "user_profiles": cut(behaviour.user_profiles(events)),
    }


def analyze(events: DataFrame, history: DataFrame | None = None) -> dict[str, DataFrame]:
    """All result tables of the main analysis as DataFrames, by name.

    ``events`` is read by many of them and should be a stored table, not a parse. What is
    known of single addresses comes from one aggregation of the events. Tables several results
    are built on are stored, so they are computed once and survive the loss of executors.
    """
    activity = activity_of(events)
    addresses = activity.addresses
    models = run_models(events, activity)
    intel = store(enrich.ip_intel(events, addresses))
    enriched = enrich.enrich_events(events, intel)
    scores = store(scoring.risk_scores(events, models["anomaly"], activity=activity))
    attack = chains.attack_chains(events, scores, addresses)
    session_table = cut(sessions.sessions(events))
    flagged = detect.bruteforce(events, addresses=addresses)
    compromised = detect.compromise_pattern(events, addresses=addresses)
    profiles = models["user_profiles"]
    return {
        **models,
        "events": enriched,
        "bruteforce": flagged,
        "night_logins": detect.night_logins(events),
        "credential_stuffing": detect.credential_stuffing(events, addresses),
        "compromise_pattern": compromised,
        "multi_host_access": detect.multi_host_access(events, addresses),
        "scores": scores,
        "severity_summary": scoring.severity_summary(scores),
        "top_factor": scoring.top_factor(scores),
        "chain_nodes": attack["nodes"],
        "chain_edges": attack["edges"],
        "chain_summary": attack["summary"],
        "tamper_regions": tamper.tamper_regions(events),
        "sessions": session_table,
        "insider_threats": insiders.insider_threats(events, profiles),
        "pivot_points": pivots.pivot_points(events),
        "response_actions": response.response_actions(scores, history),
        "narratives": response.ip_narrative(scores, attack["summary"]),
        "technique_counts": reports.technique_counts(enriched),
        "tactic_counts": reports.tactic_counts(enriched),
        "geo_breakdown": reports.geo_breakdown(intel),
        "summary": reports.executive_summary(
            events, scores, flagged, compromised, models["anomaly"], attack["summary"], session_table, activity
        ),
    }


def analyze_logs(spark: SparkSession, paths, **options) -> dict[str, DataFrame]:
    """The main analysis of text logs, which are parsed once into a stored table."""
    return analyze(store(read_auth_logs(spark, paths, **options)))


def analyze_simple(
    lines: DataFrame, failed_threshold: int = 3, night_end: int = 5, year: str = "2024"
) -> dict[str, DataFrame]:
    """Result tables of the simple rule profile for a table of raw lines (``value``)."""
    events = parse_simple_profile(lines, year)
    return {
        "events": events.orderBy("parsed_time"),
        "bruteforce": detect.bruteforce_fixed(events, failed_threshold),
        "night_logins": detect.night_logins(events, night_end),
        "compromise": detect.compromise_fixed(events, failed_threshold),
        "severity": scoring.severity_simple(events, night_end),
        "failed_by_ip": reports.failed_by_ip(events),
        "totals": events.agg(
            F.count("*").alias("total_events"),
            F.count_if(F.col("event") == "FAILED_LOGIN").alias("failed_logins"),
        ),
    }
