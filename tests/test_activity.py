"""One aggregation of the events behind every per-address result: scans counted, days merged."""

import pytest
from pyspark.sql import functions as F

from checks import queries
from logsleuth.operators import activity, anomaly, chains, detect, enrich, features, reports, response, scoring
from logsleuth.sources import tables


@pytest.fixture
def counted(spark, sf_events):
    """Events whose readings are counted: rows read so far, in passes over the table."""
    seen, n = spark.sparkContext.accumulator(0), sf_events.count()

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    events = sf_events.mapInArrow(run, sf_events.schema)
    return events, lambda: seen.value / n


SCANS = {
    "risk_scores": 1, "kpi_counts": 1, "severity_summary": 1, "ip_narrative": 1, "append_run_log": 1,
    "enrich_events": 2, "export_scored_csv": 2, "overlay_by_ip": 2, "executive_summary": 4,
}


@pytest.mark.parametrize("name", sorted(SCANS))
def test_scans_of_the_events(spark, counted, monkeypatch, name):
    events, scans = counted
    monkeypatch.setattr(queries, "events", lambda *_: events)
    monkeypatch.setattr(queries, "auth_events", lambda *_: events)
    queries.QUERIES[name](spark, "").collect()
    assert 1 <= scans() <= SCANS[name]


def test_activity_gives_what_the_events_give(sf_events, rows_of):
    known = activity.activity_of(sf_events)
    a = known.addresses
    per_ip = features.ip_activity(sf_events)
    scores = scoring.risk_scores(sf_events, anomaly.heuristic_anomaly(per_ip))
    pairs = [
        (per_ip, features.ip_activity(sf_events, activity=known)),
        (scores, scoring.risk_scores(sf_events, anomaly.heuristic_anomaly(per_ip), activity=known)),
        (detect.bruteforce(sf_events), detect.bruteforce(sf_events, addresses=a)),
        (detect.credential_stuffing(sf_events), detect.credential_stuffing(sf_events, a)),
        (detect.compromise_pattern(sf_events), detect.compromise_pattern(sf_events, addresses=a)),
        (detect.multi_host_access(sf_events), detect.multi_host_access(sf_events, a)),
        (enrich.ip_intel(sf_events), enrich.ip_intel(sf_events, a)),
        (chains.chain_summary(sf_events, scores), chains.chain_summary(sf_events, scores, a)),
        (reports.kpi_counts(sf_events, scores), reports.kpi_counts(sf_events, scores, a)),
        (tables.scored_events(sf_events, scores), tables.scored_events(sf_events, scores, a)),
    ]
    for from_events, from_activity in pairs:
        assert sorted(map(str, from_events.collect())) == sorted(map(str, from_activity.select(from_events.columns).collect()))
    assert response.response_actions(scores).count() > 0


def test_days_are_merged(sf_events, rows_of):
    day = F.dayofyear("parsed_time") % 3
    parts = [activity.activity_cells(sf_events.filter(day == d)) for d in range(3)]
    merged = activity.activity_from(activity.merge_cells(*parts)).addresses
    whole = activity.activity_of(sf_events).addresses
    assert rows_of(merged, *whole.columns) == rows_of(whole, *whole.columns)


def test_hours_without_spread(make_events):
    rows = [{"ip": "a", "at": 3600 * 24 * i, "user": None if i % 2 else "u"} for i in range(7)] + [{"ip": "b", "at": 0}, {"ip": "b", "at": 3600}]
    found = {r.ip_address: r for r in activity.activity_of(make_events(rows)).addresses.collect()}
    assert (found["a"].hour_mean, found["a"].hour_std) == (10.0, 0.0)
    assert found["b"].hour_std == pytest.approx(0.5**0.5)
    assert (found["a"].unique_users, found["a"].failing_users, found["a"].failed_with_user, found["a"].failed_count) == (1, 1, 4, 7)


def test_no_events(make_events):
    known = activity.activity_of(make_events([]))
    assert known.addresses.count() == 0
    row = reports.kpi_counts(make_events([]), scoring.risk_scores(make_events([]), anomaly.heuristic_anomaly(features.ip_activity(make_events([])))), known.addresses).first()
    assert (row["total"], row["failed"], row["all_ips"]) == (0, 0, 0)
