"""Whole analyses, and independence of the results from how rows are laid out."""

import pytest
from pyspark.sql import functions as F

from logsleuth.operators import behaviour, chains, detect, distribute, features, sessions, tamper
from logsleuth.plans import analysis


def test_analysis_tables_fit_together(sf_events):
    result = analysis.analyze(sf_events)
    counts = {name: frame.count() for name, frame in result.items()}
    ips = sf_events.select("ip_address").distinct().count()
    assert counts["events"] == sf_events.count()
    assert counts["features"] == counts["anomaly"] == counts["campaigns"] == counts["scores"] == ips
    rated = result["scores"].filter(F.col("level").isin("HIGH", "CRITICAL"))
    assert counts["chain_summary"] == rated.count() > 0
    row = result["summary"].first()
    assert row["sessions"] == counts["sessions"] and row["attack_chains"] == counts["chain_summary"]
    assert row["threat_level"] == "CRITICAL" and row["total_events"] == counts["events"]
    assert result["response_actions"].filter("action = 'IP_BLOCK'").count() == row["critical_ips"]
    again = analysis.response.response_actions(result["scores"], result["response_actions"])
    assert again.count() == 0


@pytest.mark.parametrize("partitions", [1, 13])
def test_results_do_not_depend_on_layout(sf_events, rows_of, monkeypatch, partitions):
    moved = sf_events.repartition(partitions, F.rand(3))

    def results(events):
        nodes = chains.chain_nodes(events)
        return [
            rows_of(detect.bruteforce(events), "ip_address", "threshold", "confidence"),
            rows_of(features.ip_features(events).withColumn("s", F.round("iet_std", 3)), "ip_address", "s", "iet_min"),
            rows_of(sessions.link_sessions(events), "line_number", "session_id"),
            rows_of(nodes, "ip_address", "id", "phase", "time"),
            rows_of(chains.chain_edges(nodes, 50), "ip_address", "src", "dst"),
            rows_of(tamper.entropy_series(events, block=100), "center", "entropy"),
            rows_of(behaviour.user_profiles(events, fan_out=16), "username", "current_state", "risk"),
        ]

    expected = results(sf_events)
    monkeypatch.setattr(distribute, "HOT_ROWS", 5)
    assert results(moved) == expected


def test_checkpoint_folder_comes_from_the_session(spark):
    assert distribute.shared_dir(spark) == spark.sparkContext.getCheckpointDir()
