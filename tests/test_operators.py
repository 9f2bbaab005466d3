"""Operators on small fixtures with known results, and under forced splitting."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from logsleuth.functions.columns import micros, normal_cdf, wall_clock
from logsleuth.operators import (
    anomaly,
    chains,
    detect,
    distribute,
    enrich,
    features,
    pivots,
    reports,
    response,
    scoring,
    sessions,
    tamper,
)
from logsleuth.sources import tables

DAY = dt.datetime(2024, 6, 15)


def at(hour, minute=0, second=0):
    return DAY.replace(hour=hour, minute=minute, second=second)


def test_micros_and_back(spark):
    times = [dt.datetime(2024, 2, 29, 23, 59, 59, 999999), dt.datetime(1969, 12, 31, 23, 0, 0, 1)]
    frame = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    for r in frame.select("t", micros("t").alias("m"), wall_clock(micros("t")).alias("back")).collect():
        assert r["back"] == r["t"]
        assert r["m"] == (r["t"] - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


def test_normal_cdf(spark):
    xs = [-4.0, -1.0, 0.0, 0.5, 2.0, 6.0]
    frame = spark.createDataFrame([(x,) for x in xs], "x double")
    got = frame.select("x", normal_cdf(F.col("x"), F.lit(0.0), F.lit(1.0)).alias("p")).collect()
    for r in got:
        assert r["p"] == pytest.approx(statistics.NormalDist().cdf(r["x"]), abs=2e-7)


@pytest.mark.parametrize(
    "ip, country, sha, network",
    [
        ("185.220.101.34", "Iran", 4, 2),
        ("45.33.32.156", "France", 34, 3),
        ("192.168.1.100", "United States", 90, 1),
        ("192.168.1.50", "South Korea", 33, 8),
        ("91.240.118.172", "Nigeria", 22, 8),
        ("10.0.0.5", "Local", 59, 3),
    ],
)
def test_intelligence(make_events, ip, country, sha, network):
    row = enrich.ip_intel(make_events([{"ip": ip, "event": "OTHER"}])).first()
    assert row["geo_country"] == country and row["asn"] == enrich.NETWORKS[network]
    risk = enrich.COUNTRY_RISK.get(country, 0.3)
    assert row["ip_reputation"] == pytest.approx(max(0, sha / 100 - 0.3 * risk), abs=6e-4)


def test_internal_intelligence_and_unknown_events(make_events):
    row = enrich.enrich_events(make_events([{"ip": "Internal", "event": "STRANGE"}])).first()
    assert (row["geo_country"], row["ip_reputation"], row["asn"]) == ("Local", 0.95, "AS0 — Internal")
    assert row["mitre_technique"] == "T1059 — Command and Scripting Interpreter"


def test_thresholds_without_and_with_one_failing_address(make_events):
    none = detect.adaptive_threshold(make_events([{"event": "OTHER"}])).first()
    assert (none["mean"], none["sigma"], none["threshold"]) == (3.0, 1.5, 6.75)
    one = detect.bruteforce(make_events([{}] * 4)).first()
    assert one["threshold"] == 6.5 and not one["is_bruteforce"] and one["confidence"] == 0.5


def test_night_boundary(make_events):
    events = make_events(
        [{"at": at(4, 59, 59), "event": "SUCCESSFUL_LOGIN"}, {"at": at(5), "event": "SUCCESSFUL_LOGIN"}]
    )
    assert detect.night_logins(events).count() == 1
    assert detect.night_logins(events, night_end=6).count() == 2


def test_spray_ratio_of_exactly_one_half_is_not_stuffing(make_events):
    half = [{"user": f"u{i % 3}", "ip": "1.1.1.1"} for i in range(6)]
    more = [{"user": f"u{i % 4}", "ip": "2.2.2.2"} for i in range(6)]
    found = {r["ip_address"]: r for r in detect.credential_stuffing(make_events(half + more)).collect()}
    assert not found["1.1.1.1"]["is_stuffing"] and found["1.1.1.1"]["spray_ratio"] == 0.5
    assert found["2.2.2.2"]["is_stuffing"]


def test_compromise_needs_failure_before_success(make_events):
    early = [{"ip": "1.1.1.1", "event": "SUCCESSFUL_LOGIN", "at": 0}]
    early += [{"ip": "1.1.1.1", "at": 10 + i} for i in range(9)]
    late = [{"ip": "2.2.2.2", "at": 10 + i} for i in range(9)]
    late += [{"ip": "2.2.2.2", "event": "SUCCESSFUL_LOGIN", "at": 60}]
    quiet = [{"ip": f"3.3.3.{i}"} for i in range(30)]
    found = detect.compromise_pattern(make_events(early + late + quiet)).collect()
    assert [r["ip_address"] for r in found] == ["2.2.2.2"]


def test_sessions_at_the_timeout(make_events, rows_of):
    events = make_events(
        [
            {"ip": "a", "at": 0},
            {"ip": "b", "at": 5},
            {"ip": "a", "at": 1800},
            {"ip": "a", "at": 3601},
            {"ip": "b", "at": 10},
        ]
    )
    linked = rows_of(sessions.link_sessions(events), "line_number", "session_id")
    assert linked == [(0, "S-0001"), (1, "S-0002"), (2, "S-0001"), (3, "S-0003"), (4, "S-0002")]
    table = rows_of(sessions.sessions(events), "session_id", "event_count", "duration_seconds")
    assert table == [("S-0001", 2, 1800.0), ("S-0002", 2, 5.0), ("S-0003", 1, 0.0)]


def test_sessions_with_salted_join(make_events, rows_of, monkeypatch):
    data = [{"ip": "hot" if i % 3 else "cold", "at": i * 10 + 3000 * (i // 40)} for i in range(200)]
    events = make_events(data)
    plain = rows_of(sessions.link_sessions(events), "line_number", "session_id")
    monkeypatch.setattr(distribute, "HOT_ROWS", 3)
    assert rows_of(sessions.link_sessions(events.repartition(7)), "line_number", "session_id") == plain


def test_session_numbers_grow_past_four_digits(spark, make_events):
    events = make_events([{"ip": "a"}]).drop("ip_address", "parsed_time", "line_number")
    many = (
        spark.range(10001)
        .select(
            F.concat(F.lit("ip"), "id").alias("ip_address"),
            wall_clock(F.col("id") * 1000000).alias("parsed_time"),
            F.col("id").alias("line_number"),
        )
        .crossJoin(events)
    )
    assert sessions.sessions(many).agg(F.max(F.length("session_id"))).first()[0] == 7


def test_features_against_plain_statistics(make_events):
    times = [0, 3, 3, 3, 50, 61, 125, 4000, 4000.5]
    events = make_events([{"at": t, "user": f"u{i % 2}"} for i, t in enumerate(times)])
    row = features.ip_features(events).first()
    deltas = [b - a for a, b in zip(times, times[1:])]
    assert row["iet_mean"] == pytest.approx(statistics.mean(deltas))
    assert row["iet_std"] == pytest.approx(statistics.stdev(deltas))
    assert row["iet_min"] == 0.0 and row["unique_users"] == 2 and row["fail_ratio"] == 1.0
    spaced = features.ip_features(make_events([{"at": 10 * i} for i in range(500)])).first()
    assert (spaced["iet_mean"], spaced["iet_std"], spaced["iet_min"]) == (10.0, 0.0, 10.0)
    single = features.ip_features(make_events([{}])).first()
    assert (single["iet_mean"], single["iet_std"], single["iet_min"], single["hour_std"]) == (0, 0, 0, 0)


def brute_edges(phases):
    return [
        (i, j)
        for i, p in enumerate(phases)
        for j in [next((j for j in range(i + 1, len(phases)) if phases[j] in chains.SUCCESSORS.get(p, [])), None)]
        if j is not None
    ]


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_chain_edges_for_any_block_size(make_events, rows_of, block):
    kinds = ["FAILED_LOGIN", "SUCCESSFUL_LOGIN", "SUDO_ATTEMPT", "OTHER", "DISCONNECT"]
    data = [{"ip": "hot" if i % 4 else "cold", "event": kinds[i * i * 7 % 5]} for i in range(60)]
    nodes = chains.chain_nodes(make_events(data))
    for ip in ("hot", "cold"):
        phases = [r["phase"] for r in nodes.filter(F.col("ip_address") == ip).orderBy("id").collect()]
        edges = rows_of(chains.chain_edges(nodes, block).filter(F.col("ip_address") == ip), "src", "dst")
        assert edges == brute_edges(phases)


@pytest.mark.parametrize("levels, fan_out", [(0, 2), (1, 4), (3, 2), (6, 2)])
def test_chain_edges_through_a_tree_of_blocks(make_events, rows_of, levels, fan_out):
    rng = random.Random(3)
    kinds = ["FAILED_LOGIN"] * 5 + ["DISCONNECT"] * 5 + ["SUCCESSFUL_LOGIN", "OTHER", "SUDO_ATTEMPT"]
    data = [{"ip": "hot" if i % 5 else "cold", "event": rng.choice(kinds)} for i in range(120)]
    nodes = chains.chain_nodes(make_events(data)).cache()
    for ip in ("hot", "cold"):
        phases = [r["phase"] for r in nodes.filter(F.col("ip_address") == ip).orderBy("id").collect()]
        edges = chains.chain_edges(nodes, 2, levels, fan_out).filter(F.col("ip_address") == ip)
        assert rows_of(edges, "src", "dst") == brute_edges(phases)


def test_chain_of_the_golden_example(make_events, rows_of):
    kinds = ["FAILED_LOGIN", "INVALID_USER", "SUCCESSFUL_LOGIN", "ROOT_ACCESS", "SUCCESSFUL_LOGIN"]
    made = chains.attack_chains(make_events([{"event": k} for k in kinds]))
    assert rows_of(made["edges"], "src", "dst") == [(0, 2), (1, 2), (2, 3)]
    row = made["summary"].first()
    assert row["kill_chain_progress"] == 0.667
    assert row["phases_reached"] == ["RECONNAISSANCE", "INITIAL_ACCESS", "PRIVILEGE_ESCALATION"]


@pytest.mark.parametrize("block", [50, 70, 100000])
def test_entropy_for_any_block_size(make_events, rows_of, block):
    import numpy as np

    rng = np.random.default_rng(3)
    steps = rng.integers(0, 41, 400)
    steps[100:180] = 7
    times = np.cumsum(steps)
    events = make_events([{"at": int(t)} for t in times])
    deltas = np.diff(np.sort(times)).astype(float)
    expected = []
    for start in range(0, len(deltas) - 50, 10):
        p = np.histogram(deltas[start : start + 50], bins=20)[0] / 50
        p = p[p > 0]
        expected.append((start + 25, round(float(-np.sum(p * np.log2(p + 1e-12))), 4) + 0.0))
    assert rows_of(tamper.entropy_series(events, block=block), "center", "entropy") == expected
    values = np.array([e for _, e in expected])
    flagged = [c for c, e in expected if abs(e - values.mean()) / values.std() > 2]
    assert [r["start_idx"] + 25 for r in tamper.tamper_regions(events, block=block).orderBy("start_idx").collect()] == flagged


def test_too_few_events_have_no_entropy(make_events):
    assert tamper.entropy_series(make_events([{}] * 99)).count() == 0
    assert tamper.tamper_regions(make_events([{}] * 99)).count() == 0


def test_pivots_count_dotted_nodes(make_events, rows_of):
    edges = [("1.1.1.1", "web"), ("1.1.1.1", "db"), ("2.2.2.2", "web"), ("Internal", "web"), ("Internal", "db")]
    edges += [("3.3.3.3", "a.example"), ("4.4.4.4", "a.example"), ("4.4.4.4", "a.example")]
    events = make_events([{"ip": i, "host": h, "event": "SUCCESSFUL_LOGIN"} for i, h in edges])
    found = rows_of(pivots.pivot_points(events), "ip", "host_involved", "hosts_count")
    assert found == [
        ("1.1.1.1", "db", 2), ("1.1.1.1", "web", 2),
        ("a.example", "3.3.3.3", 2), ("a.example", "4.4.4.4", 2),
    ]


def test_levels_at_their_bounds(spark):
    frame = spark.createDataFrame([(40.0,), (39.99,), (25.0,), (12.0,), (11.99,)], "s double")
    assert [r[0] for r in frame.select(scoring.level_of(F.col("s"))).collect()] == ["CRITICAL", "HIGH", "HIGH", "MEDIUM", "LOW"]


def scored(make_events, rows):
    events = make_events(rows)
    return events, scoring.risk_scores(events, anomaly.heuristic_anomaly(features.ip_features(events)))


def test_honey_users_and_responses(make_events, rows_of):
    attack = [{"ip": "6.6.6.6", "at": i, "event": "FAILED_LOGIN"} for i in range(30)]
    attack += [{"ip": "6.6.6.6", "at": 40, "event": "SUCCESSFUL_LOGIN"}]
    honey = [{"ip": "7.7.7.7", "user": "svc_forensics"}]
    calm = [{"ip": "8.8.8.8", "at": 9000 * i, "event": "SUCCESSFUL_LOGIN"} for i in range(3)]
    _, scores = scored(make_events, attack + honey + calm)
    by_ip = {r["ip_address"]: r for r in scores.collect()}
    assert (by_ip["7.7.7.7"]["score"], by_ip["7.7.7.7"]["level"]) == (100.0, "CRITICAL")
    assert [f["factor"] for f in by_ip["7.7.7.7"]["factors"]] == ["DECEPTION TRIGGER"]
    assert by_ip["6.6.6.6"]["score"] >= 40 > by_ip["8.8.8.8"]["score"]
    actions = response.response_actions(scores)
    assert sorted((r["action"], r["ip"] or r["user"]) for r in actions.collect()) == [
        ("ACCOUNT_LOCKOUT", "compromised_user"), ("IP_BLOCK", "6.6.6.6"), ("IP_BLOCK", "7.7.7.7"),
    ]
    assert response.response_actions(scores, actions).count() == 0
    summary = dict(rows_of(scoring.severity_summary(scores), "level", "ips"))
    assert set(summary) == {"CRITICAL", "HIGH", "MEDIUM", "LOW"} and sum(summary.values()) == 3


def test_timeline_blocks(make_events, rows_of):
    events = make_events([{"ip": f"ip{i // 3 % 2}", "at": i * 700} for i in range(40)])
    linked = sessions.link_sessions(events)
    whole = rows_of(reports.timeline(linked), "position", "session_changed")
    assert rows_of(reports.timeline(linked, block=4), "position", "session_changed") == whole
    assert any(changed for _, changed in whole) and not whole[0][1]


def test_frequency_fills_empty_minutes(make_events, rows_of):
    events = make_events([{"at": at(10)}, {"at": at(10, 3)}, {"at": at(10, 3, 59)}])
    got = rows_of(reports.login_frequency(events), "minute", "events", "threshold")
    counts = [1, 0, 0, 2]
    limit = statistics.mean(counts) + 2 * statistics.stdev(counts)
    assert [(m.minute, n) for m, n, _ in got] == list(enumerate(counts))
    assert got[0][2] == pytest.approx(limit)
    single = reports.login_frequency(make_events([{}])).first()
    assert single["events"] == 1 and not single["is_spike"]


def test_forest_invariants(spark, sf_events, rows_of):
    per_ip = features.ip_features(sf_events)
    first = rows_of(anomaly.isolation_forest(per_ip.repartition(1)), "ip_address", "anomaly_score", "is_anomaly")
    again = rows_of(anomaly.isolation_forest(per_ip.repartition(8)), "ip_address", "anomaly_score", "is_anomaly")
    assert first == again
    scores = [s for _, s, _ in first]
    assert min(scores) == 0.0 and max(scores) == 1.0
    assert 0 < sum(flag for *_, flag in first) <= round(0.05 * len(first)) + 1


def test_forest_ranks_an_outlier_first(make_events):
    data = [{"ip": f"1.1.1.{i}", "at": 60 * j + i, "event": "SUCCESSFUL_LOGIN"} for i in range(40) for j in range(5)]
    data += [{"ip": "66.6.6.6", "at": at(3, 0, i % 60), "user": f"u{i}"} for i in range(300)]
    ranked = reports.anomaly_ranking(anomaly.isolation_forest(features.ip_features(make_events(data))))
    top = ranked.first()
    assert top["ip_address"] == "66.6.6.6" and top["anomaly_score"] == 1.0 and top["status"] == "ANOMALY"


def test_forest_with_few_addresses(make_events):
    scores = anomaly.isolation_forest(features.ip_features(make_events([{"ip": "a"}, {"ip": "b"}])))
    assert {(r["anomaly_score"], r["is_anomaly"]) for r in scores.collect()} == {(0.5, False)}


def test_stored_tables(spark, make_events, tmp_path, rows_of):
    events = make_events([{"at": at(1) + dt.timedelta(days=i % 3), "ip": f"ip{i % 2}"} for i in range(12)])
    path = str(tmp_path / "events")
    assert tables.write_events(events, path, fresh=True) == 12
    assert tables.write_events(events, path) == 12
    assert tables.read_events(spark, path).count() == 24
    assert tables.write_events(events, path, fresh=True) == 12
    assert tables.read_events(spark, path).count() == 12
    updates = spark.createDataFrame([("log", 3, "S-9", "x")], "source_file string, line_number long, session_id string, other string")
    overlaid = tables.overlay_by_event(events, updates)
    assert [r["line_number"] for r in overlaid.filter("session_id = 'S-9'").collect()] == [3]
    assert "other" not in overlaid.columns and overlaid.first()["ip_reputation"] == 0.5
    per_ip = spark.createDataFrame([("ip1", 7.5, "S-8")], "ip_address string, risk_score double, session_id string")
    by_ip = tables.overlay_by_ip(events, per_ip)
    assert rows_of(by_ip.groupBy("ip_address", "risk_score", "session_id").count(), "ip_address", "risk_score", "session_id", "count") == [
        ("ip0", 0.0, "", 6), ("ip1", 7.5, "", 6),
    ]


def test_csv_export(spark, make_events, tmp_path):
    events, scores = scored(make_events, [{"ip": "5.5.5.5", "message": 'quo"ted, text'}] * 3)
    path = str(tmp_path / "out")
    schema = tables.export_scored_csv(events, scores.filter("ip_address = 'none'"), path)
    back = tables.read_scored_csv(spark, path, schema).collect()
    assert len(back) == 3 and {r["message"] for r in back} == {'quo"ted, text'}
    assert back[0]["risk_score"] == 0.0 and back[0]["severity_level"] == "LOW"
    tables.export_plain_csv(events, path)
    times = sorted(r["parsed_time"] for r in spark.read.option("header", True).csv(path).collect())
    assert times == [f"2024-06-15 10:00:0{i}" for i in range(3)]


def test_a_retried_run_is_logged_once(spark, make_events, tmp_path):
    events = make_events([{"ip": "a", "at": i} for i in range(9)])
    run = tables.analysis_run(events, detect.bruteforce(events), spark.createDataFrame([("a", "LOW")], "ip_address string, level string"), "log", {"z": 1})
    path = str(tmp_path / "runs")
    for run_id in ("one", "one", "two"):
        tables.append_run_log(run, path, run_id)
    tables.append_run_log(run, path)
    assert [r["total_events"] for r in tables.read_run_log(spark, path).collect()] == [9] * 3
    actions = spark.createDataFrame([("a", None, "IP_BLOCK", "t", "s")], "ip string, user string, action string, target string, status string")
    for run_id in ("one", "one", "two"):
        tables.append_actions(actions, str(tmp_path / "actions"), run_id)
    assert tables.read_actions(spark, str(tmp_path / "actions")).count() == 2
