"""Streaming forms against their batch counterparts, with data arriving in several files."""

import datetime as dt
import random

from pyspark.sql import functions as F

from checks import queries
from logsleuth.operators import chains, reports, sessions
from logsleuth.sources import tables, text_logs
from logsleuth.streaming import jobs

START = dt.datetime(2024, 6, 15, 10)


def event_files(spark, make_events, path, data, files):
    """Events in time order, one Parquet file after the other."""
    data = sorted(data, key=lambda r: r["at"])
    size = -(-len(data) // files)
    for n in range(files):
        part = data[n * size : (n + 1) * size]
        make_events(part).coalesce(1).write.mode("append").parquet(f"{path}/in")
    schema = spark.read.parquet(f"{path}/in").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def test_frequency_matches_batch(spark, make_events, tmp_path, rows_of):
    data = [{"at": 13 * i % 7200} for i in range(600)] + [{"at": 60.5}] * 40
    stream = event_files(spark, make_events, str(tmp_path), data, 3)
    got = rows_of(
        jobs.run_available(jobs.frequency_stream(stream, 20.0), str(tmp_path / "out")), "minute", "events", "is_spike"
    )
    batch = reports.login_frequency(make_events(data)).filter("events > 0")
    last = max(r["at"] for r in data)
    final = START + dt.timedelta(seconds=last) - dt.timedelta(minutes=11)
    want = [(m, n, n > 20) for m, n in rows_of(batch, "minute", "events") if m <= final]
    assert got == want and any(spike for *_, spike in got)


def test_frequency_of_a_closed_input(spark, make_events, tmp_path, rows_of):
    data = [{"at": 13 * i % 7200} for i in range(600)] + [{"at": 60.5}] * 40
    stream = event_files(spark, make_events, str(tmp_path), data, 3)
    got = jobs.run_to_end(jobs.frequency_stream(stream, 20.0), str(tmp_path / "out"), ["minute"])
    batch = reports.login_frequency(make_events(data)).filter("events > 0")
    want = [(m, n, n > 20) for m, n in rows_of(batch, "minute", "events")]
    assert rows_of(got, "minute", "events", "is_spike") == want


COLUMNS = ("ip_address", "session_start", "session_end", "event_count")


def batch_sessions(events):
    """Sessions of the batch operator with the columns of the stream."""
    end = F.timestamp_micros(F.unix_micros(F.col("session_start").cast("timestamp")) + F.round(F.col("duration_seconds") * 1e6).cast("long"))
    return sessions.sessions(events).select("ip_address", "session_start", end.cast("timestamp_ntz").alias("session_end"), "event_count")


def test_sessions_of_a_closed_input(spark, make_events, tmp_path, rows_of):
    data = [{"ip": "a", "at": t} for t in (0, 10, 1810, 3611, 9000)]
    data += [{"ip": "b", "at": 10 * i} for i in range(50)] + [{"ip": "z", "at": 40000}]
    stream = event_files(spark, make_events, str(tmp_path), data, 4)
    got = rows_of(jobs.run_sessions(stream, str(tmp_path / "out")), *COLUMNS)
    assert got == rows_of(batch_sessions(make_events(data)), *COLUMNS)
    assert [r[3] for r in got if r[0] == "a"] == [3, 1, 1] and [r[3] for r in got if r[0] == "z"] == [1]


def test_open_sessions_wait_for_the_next_run(spark, make_events, tmp_path, rows_of):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    first = [{"ip": "a", "at": t} for t in (0, 600, 5000)] + [{"ip": "b", "at": 5000}]
    second = [{"ip": "a", "at": 6000}, {"ip": "b", "at": 6801}, {"ip": "b", "at": 1.5}]  # the last one comes too late
    make_events(first).write.parquet(folder)
    stream = lambda: spark.readStream.schema(make_events([]).schema).parquet(folder)
    counts = lambda table: [(r[0], r[3]) for r in rows_of(table, *COLUMNS)]
    assert counts(jobs.run_sessions(stream(), out, close=False)) == [("a", 2)]
    make_events(second).write.mode("append").parquet(folder)
    assert counts(jobs.run_sessions(stream(), out, close=False)) == [("a", 2)]
    assert counts(jobs.run_sessions(stream(), out)) == [("a", 2), ("a", 2), ("b", 1), ("b", 1)]


def test_a_hot_address_is_combined_before_the_shuffle(spark, make_events):
    events = make_events([{"ip": "Internal", "at": i} for i in range(4000)], partitions=3)
    rows = events.select(F.col("parsed_time").cast("timestamp").alias("at"), "ip_address", F.lit(False).alias("closing"))
    pieces = jobs._pieces(rows, 1_800_000_000).collect()
    assert len(pieces) <= 3 * 4 and sum(r.n for r in pieces) == 4000


def test_merging_pieces_in_any_order():
    rng = random.Random(1)
    for _ in range(300):
        times = [rng.randint(0, 400) for _ in range(rng.randint(1, 30))]
        want = jobs.merge_pieces([(t, t, 1) for t in times], 10)
        rng.shuffle(times)
        state = []
        while times:
            part, times = times[:3], times[3:]
            slots = {}
            for t in part:
                slots.setdefault(t // 10, []).append(t)
            state = jobs.merge_pieces(state + [(min(v), max(v), len(v)) for v in slots.values()], 10)
        assert state == want


def test_event_stream_reads_files_and_folders(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    for n, folder in enumerate((str(tmp_path), "/root/testdata/sf0.001")):
        stream = queries.event_stream(spark, folder).select("line_number")
        assert jobs.run_available(stream, str(tmp_path / f"out{n}")).count() == events.count()


def test_ingest_matches_batch(spark, tmp_path, rows_of):
    folder = tmp_path / "logs"
    folder.mkdir()
    for n in range(3):
        lines = [f"Jun 15 14:0{n}:{i:02d} web sshd[1]: Failed password for u{i} from 1.1.1.{n}" for i in range(20)]
        (folder / f"auth{n}.log").write_text("\n".join(lines + ["", "junk", "Feb 31 01:00:00 web sshd: x"]))
    (folder / "iso.log").write_text("2024-06-15T14:00:00Z db sshd[1]: Accepted password for x from 2.2.2.2\n")
    got = jobs.ingest_available(jobs.read_line_stream(spark, str(folder), files_per_batch=2), str(tmp_path / "out"))
    batch = text_logs.read_auth_logs(spark, str(folder), number_lines=True)
    assert rows_of(got, *got.columns) == rows_of(batch, *got.columns)
    assert got.count() == 61


def test_streamed_events_in_later_operators(spark, tmp_path, rows_of):
    folder = tmp_path / "logs"
    folder.mkdir()
    for n in range(2):
        lines = [f"Jun 15 {10 + i // 400}:{i // 7 % 60:02d}:{i % 60:02d} web sshd[1]: Failed password for u{i % 9} from 1.1.1.{i % 5}" for i in range(900)]
        (folder / f"auth{n}.log").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        streamed = jobs.ingest_available(jobs.read_line_stream(spark, str(folder)), str(tmp_path / "out"))
        batch = text_logs.read_auth_logs(spark, str(folder), number_lines=True)
        assert streamed.select("source_file", "line_number").distinct().count() == streamed.count() == 1800
        results = []
        for name, events in (("streamed", streamed), ("batch", batch)):
            tables.write_events(events, str(tmp_path / name), fresh=True)
            stored = tables.read_events(spark, str(tmp_path / name))
            updates = stored.filter("line_number % 9 = 0").select("source_file", "line_number", F.lit(1).alias("tamper_flag"))
            overlaid = tables.overlay_by_event(stored, updates.unionByName(updates))
            nodes = chains.chain_nodes(stored).drop("_row")
            linked = sessions.link_sessions(stored)
            results.append(
                [rows_of(overlaid, "source_file", "line_number", "tamper_flag"), rows_of(nodes, *nodes.columns), rows_of(linked, "source_file", "line_number", "session_id")]
            )
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert results[0] == results[1]
    assert [len(r) for r in results[0]] == [1800] * 3 and sum(t for *_, t in results[0][0]) == 200


def test_a_repeated_batch_is_stored_once(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.log").write_text("Jun 15 14:00:00 web sshd[1]: Failed password for u from 1.1.1.1\n" * 5)
    out = tmp_path / "out"
    assert jobs.ingest_available(jobs.read_line_stream(spark, str(folder)), str(out)).count() == 5
    (out / "state/commits/0").unlink()  # as if it had failed before the commit
    (out / "state/commits/.0.crc").unlink(missing_ok=True)
    assert jobs.ingest_available(jobs.read_line_stream(spark, str(folder)), str(out)).count() == 5


def test_wall_clock_does_not_depend_on_the_session_zone(spark, make_events, rows_of):
    data = [{"at": dt.datetime(2024, 3, 31, 2, 30), "ip": "x"}, {"at": dt.datetime(2024, 3, 31, 4), "ip": "x"}]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        events = make_events(data)
        assert [r["event_count"] for r in sessions.sessions(events).collect()] == [1, 1]
        minutes = rows_of(reports.login_frequency(events), "minute")
        assert minutes[0][0] == data[0]["at"] and minutes[-1][0] == data[1]["at"] and len(minutes) == 91
        line = spark.createDataFrame([("Mar 31 02:30:00 h sshd: x", "auth_log")], "value string, layout string")
        assert text_logs.parse_lines(line).first()["parsed_time"] == data[0]["at"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
