"""The registered queries: every operator over the whole tables of a data folder."""

import uuid

from pyspark import cloudpickle
from pyspark.sql import Window, functions as F

from logsleuth.functions.columns import round_half_even
from logsleuth import schema
from logsleuth.operators import (
    activity,
    anomaly,
    behaviour,
    campaigns,
    chains,
    components,
    detect,
    enrich,
    features,
    insiders,
    networks,
    pivots,
    reports,
    response,
    scoring,
    sessions,
    tamper,
)
from logsleuth.schema import IP_FEATURE_COLUMNS
from logsleuth.operators.activity import activity_of
from logsleuth.operators.distribute import shared_dir, store
from logsleuth.plans import analysis
from logsleuth.sources import tables, text_logs
from logsleuth.sources.event_table import auth_events, auth_lines, from_event_table
from logsleuth.streaming import jobs

# Functions that run inside tasks travel with the job, so that the queries also work
# where the package is not installed on the executors.
for module in (anomaly, behaviour, campaigns, components, jobs, schema):
    cloudpickle.register_pickle_by_value(module)

# Radius of the campaigns that are checked besides those of the default radius.
WIDE_EPS = 1.3

EVENT_COLUMNS = (
    "source_file line_number timestamp_str parsed_time event ip_address username process host message"
).split()


def rounded(df, *columns, digits=6):
    """Doubles that come out of long sums are compared to six digits."""
    return df.withColumns({c: round_half_even(F.col(c), digits) for c in columns})


def events(spark, sf_dir):
    return auth_events(spark, sf_dir)


def on_events(operator):
    return lambda spark, sf_dir: operator(events(spark, sf_dir))


def on_intel(*columns):
    return on_events(lambda e: enrich.ip_intel(e).select(*columns))


def rated(e, known):
    """Risk scores with the heuristic as anomaly input, which SQL can follow."""
    per_ip = features.ip_activity(e, activity=known)
    return scoring.risk_scores(e, anomaly.heuristic_anomaly(per_ip), activity=known)


def on_rated(operator):
    """Operators of events, their addresses, and the stored scores of these."""

    def run(e):
        known = activity_of(e)
        return operator(e, known, store(rated(e, known)))

    return on_events(run)


def on_scores(operator):
    def run(e):
        known = activity_of(e)
        return operator(rated(e, known))

    return on_events(run)


def on_features(operator):
    return on_events(lambda e: operator(features.ip_features(e)))


def with_text(df, column, separator=" → "):
    """Lists are compared as text."""
    return df.withColumn(column, F.array_join(column, separator))


def chain_overview(e, known, scores):
    """Summary of the rated chains with the number of their edges."""
    made = chains.attack_chains(e, scores, known.addresses)
    edges = made["edges"].groupBy("ip_address").agg(F.count("*").alias("edge_count"))
    return with_text(
        made["summary"].join(edges, "ip_address", "left").na.fill(0, ["edge_count"]), "phases_reached"
    )


def earlier_blocks(e, addresses):
    """A history in which addresses with fifteen failures are blocked already."""
    return (
        detect.failures_per_ip(e, addresses)
        .filter(F.col("failed_count") >= 15)
        .select(
            F.col("ip_address").alias("ip"),
            F.lit(None).cast("string").alias("user"),
            F.lit("IP_BLOCK").alias("action"),
        )
    )


def grouped(e, **options):
    return campaigns.ip_campaigns(features.ip_features(e), features.first_seen(e), **options)


def grouped_wide(e):
    """Campaigns within a radius at which the given events have several."""
    return grouped(e, eps=WIDE_EPS, min_samples=campaigns.MIN_SAMPLES)


def on_profiles(operator):
    return on_events(lambda e: operator(e, behaviour.user_profiles(e)))


def summary_row(e, known, scores):
    return reports.executive_summary(
        e,
        scores,
        detect.bruteforce(e, addresses=known.addresses),
        detect.compromise_pattern(e, addresses=known.addresses),
        anomaly.heuristic_anomaly(features.ip_activity(e, activity=known)),
        chains.chain_summary(e, scores, known.addresses),
        sessions.sessions(e),
        known,
    )


def network_ranges(e):
    """Ranges around the addresses of the events: wide ones, and narrow ones within them.

    All addresses with the same first two numbers, from the first to the last address with
    the same first three, and some single addresses.
    """
    ips = e.select("ip_address").distinct().withColumn("n", networks.ip_number(F.col("ip_address"))).filter("n IS NOT NULL")
    parts = F.split("ip_address", r"\.")
    two, three = F.array_join(F.slice(parts, 1, 2), "."), F.array_join(F.slice(parts, 1, 3), ".")
    wide = ips.select(two.alias("net")).distinct().select(
        F.concat("net", F.lit(".0.0")).alias("first_ip"), F.concat("net", F.lit(".255.255")).alias("last_ip"),
        F.concat(F.lit("wide "), "net").alias("network"),
    )
    narrow = ips.groupBy(three.alias("net")).agg(
        F.min_by("ip_address", "n").alias("first_ip"), F.max_by("ip_address", "n").alias("last_ip")
    ).select("first_ip", "last_ip", F.concat(F.lit("narrow "), "net").alias("network"))
    single = ips.filter("n % 7 = 0").select(
        F.col("ip_address").alias("first_ip"), F.col("ip_address").alias("last_ip"), F.lit("single").alias("network")
    )
    return wide.unionByName(narrow).unionByName(single)


def ranges_of_addresses(e):
    """Every address with its narrowest range; all first numbers above 200 lie in a last one."""
    rest = e.sparkSession.createDataFrame([("200.0.0.1", "255.255.255.254", "rest")], "first_ip string, last_ip string, network string")
    ips = e.select("ip_address").distinct()
    return networks.lookup_ranges(ips, network_ranges(e).filter("network NOT LIKE 'wide %3'").unionByName(rest))


def sketched(e):
    """Distinct users and hosts from sketches of single days."""
    found = activity.sketched_addresses(activity.activity_sketches(e))
    return found.select("ip_address", "total_events", "failed_count", "unique_users", "failing_users", "hosts_accessed")


def lines_of(e):
    """Lines with noise, and the layout their host writes."""
    layout = F.when(F.col("host") == "host3", "syslog").otherwise("auth_log")
    return auth_lines(e).select("value", layout.alias("layout"))


def on_lines(operator):
    return on_events(lambda e: operator(lines_of(e)))


def scratch(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def log_files(spark, sf_dir):
    """The lines of all events as text files, one folder per host."""
    path = scratch(spark, "lines")
    auth_lines(events(spark, sf_dir)).write.partitionBy("host").text(path)
    return f"{path}/*/*.txt"


def read_back(spark, sf_dir):
    parsed = text_logs.read_auth_logs(spark, log_files(spark, sf_dir), number_lines=True)
    return by_position(parsed)


def by_position(parsed):
    """Parsed lines with the host folder of their file and how many lines share their number."""
    position = Window.partitionBy("source_file", "line_number")
    return parsed.select(
        "*",
        F.regexp_extract("source_file", "host=(host[0-9]+)", 1).alias("folder"),
        F.count("*").over(position).alias("same_position"),
    ).drop("source_file", "line_number")


def formats(spark, sf_dir):
    found = text_logs.detect_log_format(spark, log_files(spark, sf_dir))
    host = F.regexp_extract("source_file", "host=(host[0-9]+)", 1)
    return found.select(host.alias("host"), "layout").distinct()


def stored(spark, sf_dir):
    """Events of the first half month stored afresh, the others appended."""
    path = scratch(spark, "events")
    all_events = events(spark, sf_dir).select(EVENT_COLUMNS)
    early = F.dayofmonth("parsed_time") <= 15
    tables.write_events(all_events.filter(early), path, fresh=True)
    tables.write_events(all_events.filter(~early), path)
    return tables.read_events(spark, path)


def night_overlay(e):
    updates = detect.night_logins(e).select(
        "source_file",
        "line_number",
        F.lit(1).alias("tamper_flag"),
        F.lit("night").alias("hmm_state"),
        F.lit("dropped").alias("no_such_field"),
    )
    return tables.overlay_by_event(e, updates).select(
        "line_number", "event", "hmm_state", "severity_level", "tamper_flag", "ip_reputation"
    )


def score_overlay(e, known, scores):
    updates = scores.select(
        "ip_address",
        F.col("score").alias("risk_score"),
        F.col("level").alias("severity_level"),
        F.lit("dropped").alias("session_id"),
    )
    return tables.overlay_by_ip(e, updates, known.addresses).select(
        "line_number", "ip_address", "risk_score", "severity_level", "session_id"
    )


def run_log(spark, sf_dir):
    path = scratch(spark, "runs")
    e = events(spark, sf_dir)
    known = activity_of(e)
    run = tables.analysis_run(
        e,
        detect.bruteforce(e, addresses=known.addresses),
        rated(e, known),
        "events",
        {"z_score": 2.5, "night_end": 5},
        known.addresses,
    )
    tables.append_run_log(run, path)
    return tables.read_run_log(spark, path).drop("run_time")


def exported(e, known, scores):
    """The scored events as they are read back from CSV files."""
    path = scratch(e.sparkSession, "csv")
    schema = tables.export_scored_csv(e, scores, path, known.addresses)
    return tables.read_scored_csv(e.sparkSession, path, schema).drop("raw_line")


def action_log(spark, sf_dir):
    """Actions of a first and a second analysis of the same events, as stored."""
    path = scratch(spark, "actions")
    e = events(spark, sf_dir)
    scores = store(rated(e, activity_of(e)))
    tables.append_actions(response.response_actions(scores), path)
    tables.append_actions(response.response_actions(scores, tables.read_actions(spark, path)), path)
    return tables.read_actions(spark, path).drop("time")


def model_results(e):
    """Outcome of the three models in long form."""
    models = analysis.run_models(e)
    anomalies = models["anomaly"].select(
        F.lit("anomaly").alias("model"),
        F.col("ip_address").alias("subject"),
        F.col("is_anomaly").cast("string").alias("outcome"),
        F.col("anomaly_score").alias("score"),
    )
    groups = models["campaigns"].select(
        F.lit("campaign").alias("model"),
        F.col("ip_address").alias("subject"),
        F.col("cluster_label").alias("outcome"),
        F.col("campaign_cluster").cast("double").alias("score"),
    )
    users = models["user_profiles"].select(
        F.lit("user").alias("model"),
        F.col("username").alias("subject"),
        F.col("current_state").alias("outcome"),
        F.col("risk").alias("score"),
    )
    return anomalies.unionByName(groups).unionByName(users)


def event_stream(spark, sf_dir):
    """The ``events`` table as a stream, be it a folder or, found by a pattern, a single file."""
    layout = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return from_event_table(spark.readStream.schema(layout).parquet(f"{sf_dir}/events.parque[t]"))


def streamed_lines(spark, sf_dir):
    lines = jobs.read_line_stream(spark, log_files(spark, sf_dir))
    return by_position(jobs.ingest_available(lines, scratch(spark, "ingest")))


def streamed_frequency(spark, sf_dir):
    baseline = reports.login_frequency(events(spark, sf_dir)).select("threshold").first()[0]
    stream = jobs.frequency_stream(event_stream(spark, sf_dir), baseline)
    return jobs.run_to_end(stream, scratch(spark, "frequency"), ["minute"])


def streamed_sessions(spark, sf_dir):
    return jobs.run_sessions(event_stream(spark, sf_dir), scratch(spark, "sessions"))


QUERIES = {
    # Sources and line parsing.
    "read_auth_logs": read_back,
    "detect_log_format": formats,
    "split_header": on_lines(lambda x: text_logs.split_header(x).drop("raw_line")),
    "classify_event": on_lines(
        lambda x: text_logs.split_header(x).select(
            "message", text_logs.classify_event(F.col("message")).alias("event")
        )
    ),
    "extract_ip": on_lines(
        lambda x: text_logs.split_header(x).select(
            "message", text_logs.extract_ip(F.col("message")).alias("ip_address")
        )
    ),
    "extract_user": on_lines(
        lambda x: text_logs.split_header(x).select(
            "message", text_logs.extract_user(F.col("message")).alias("username")
        )
    ),
    "parse_event_time": on_lines(
        lambda x: text_logs.split_header(x).select(
            "timestamp_str",
            text_logs.parse_event_time(F.col("timestamp_str"), F.col("layout")).alias("parsed_time"),
        )
    ),
    "parse_simple_profile": on_lines(text_logs.parse_simple_profile),
    "write_events": stored,
    "overlay_by_event": on_events(night_overlay),
    "overlay_by_ip": on_rated(score_overlay),
    "append_run_log": run_log,
    # Detection and enrichment.
    "adaptive_threshold": on_events(
        lambda e: rounded(detect.adaptive_threshold(e), "mean", "sigma", "threshold")
    ),
    "bruteforce": on_events(detect.bruteforce),
    "night_logins": on_events(lambda e: detect.night_logins(e).select(EVENT_COLUMNS)),
    "credential_stuffing": on_events(detect.credential_stuffing),
    "compromise_pattern": on_events(detect.compromise_pattern),
    "multi_host_access": on_events(detect.multi_host_access),
    "bruteforce_fixed": on_events(detect.bruteforce_fixed),
    "compromise_fixed": on_events(detect.compromise_fixed),
    "severity_simple": on_events(scoring.severity_simple),
    "ip_geo": on_intel("ip_address", "geo_country", "geo_city", "geo_lat", "geo_lon"),
    "country_risk": on_intel("ip_address", "geo_country", "geo_risk"),
    "ip_reputation": on_intel("ip_address", "failed_count", "ip_reputation"),
    "ip_asn": on_intel("ip_address", "asn"),
    "ip_ranges": on_events(ranges_of_addresses),
    "activity_sketches": on_events(sketched),
    "mitre_map": on_events(
        lambda e: enrich.with_description(enrich.with_technique(e)).select(
            "line_number", "event", "mitre_technique", "mitre_tactic", "mitre_description"
        )
    ),
    "enrich_events": on_events(lambda e: enrich.enrich_events(e).drop("raw_line")),
    # Features and models.
    "ip_features": on_features(
        lambda f: rounded(
            rounded(f, "hour_mean", "hour_std", "iet_min", "fail_ratio"), "iet_mean", "iet_std", digits=2
        )
    ),
    "iforest_contamination": on_events(lambda e: anomaly.iforest_contamination(features.ip_activity(e))),
    "heuristic_anomaly": on_events(lambda e: anomaly.heuristic_anomaly(features.ip_activity(e))),
    "anomaly_ranking": on_events(
        lambda e: reports.anomaly_ranking(anomaly.heuristic_anomaly(features.ip_activity(e)))
    ),
    "isolation_forest": on_features(anomaly.isolation_forest),
    "scaled_features": on_features(
        lambda f: rounded(campaigns.scaled_features(f), *IP_FEATURE_COLUMNS, digits=5)
    ),
    "dbscan_params": on_features(lambda f: rounded(campaigns.dbscan_params(f), "eps")),
    "ip_campaigns": on_events(grouped),
    "ip_campaigns_wide": on_events(grouped_wide),
    "campaign_members": on_events(lambda e: reports.campaign_members(grouped_wide(e))),
    "user_observations": on_events(behaviour.user_observations),
    "user_state_path": on_events(behaviour.user_state_path),
    "user_profiles": on_profiles(lambda e, p: p),
    "user_risk_ranking": on_profiles(lambda e, p: reports.user_risk_ranking(p)),
    "insider_threats": on_profiles(
        lambda e, p: with_text(insiders.insider_threats(e, p), "indicators", "; ")
    ),
    "run_models": on_events(model_results),
    # Scoring.
    "risk_factors": on_scores(scoring.factor_table),
    "risk_scores": on_scores(lambda s: s.drop("factors")),
    "severity_level": on_scores(lambda s: s.select("ip_address", "level")),
    "severity_summary": on_scores(scoring.severity_summary),
    "severity_ranking": on_scores(reports.severity_ranking),
    "top_factor": on_scores(scoring.top_factor),
    "top_factor_breakdown": on_scores(reports.top_factor_breakdown),
    "kpi_counts": on_rated(lambda e, known, s: reports.kpi_counts(e, s, known.addresses)),
    "response_actions": on_rated(
        lambda e, known, s: response.response_actions(s, earlier_blocks(e, known.addresses))
    ),
    "action_log": action_log,
    "export_scored_csv": on_rated(exported),
    # Forensics.
    "chain_nodes": on_events(lambda e: chains.chain_nodes(e).drop("_row")),
    "chain_edges": on_events(lambda e: chains.chain_edges(chains.chain_nodes(e))),
    "chain_summary": on_events(lambda e: with_text(chains.chain_summary(e), "phases_reached")),
    "attack_chains": on_rated(chain_overview),
    "entropy_series": on_events(tamper.entropy_series),
    "tamper_regions": on_events(tamper.tamper_regions),
    "tamper_summary": on_events(tamper.tamper_summary),
    "link_sessions": on_events(lambda e: sessions.link_sessions(e).drop("raw_line")),
    "pivot_points": on_events(pivots.pivot_points),
    "ip_narrative": on_rated(
        lambda e, known, s: response.ip_narrative(s, chains.chain_summary(e, s, known.addresses))
    ),
    # Reports.
    "event_type_counts": on_events(reports.event_type_counts),
    "failed_by_ip": on_events(reports.failed_by_ip),
    "fail_success_by_ip": on_events(reports.fail_success_by_ip),
    "unique_ips": on_events(reports.unique_ips),
    "events_by_ip": on_events(
        lambda e: reports.events_by_ip(e, "198.51.100.7").select(EVENT_COLUMNS)
    ),
    "events_by_time": on_events(lambda e: reports.events_by_time(e).select(EVENT_COLUMNS)),
    "timeline": on_events(lambda e: reports.timeline(sessions.link_sessions(e))),
    "failed_heatmap": on_events(reports.failed_heatmap),
    "login_frequency": on_events(lambda e: rounded(reports.login_frequency(e), "threshold")),
    "technique_counts": on_events(
        lambda e: rounded(reports.technique_counts(enrich.with_technique(e)), "share")
    ),
    "tactic_counts": on_events(
        lambda e: rounded(reports.tactic_counts(enrich.with_technique(e)), "percent", "of_largest")
    ),
    "geo_breakdown": on_events(lambda e: rounded(reports.geo_breakdown(enrich.ip_intel(e)), "avg_risk")),
    "executive_summary": on_rated(lambda *known: rounded(summary_row(*known), "duration_hours")),
    # Streams.
    "stream_ingest": streamed_lines,
    "stream_login_frequency": streamed_frequency,
    "stream_sessions": streamed_sessions,
}
