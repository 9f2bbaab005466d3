import datetime as dt

import pytest
from pyspark.sql import functions as F

from logsleuth.plans import analysis
from logsleuth.sources import text_logs

def sample_lines():
    """Three failures from one address, a login from a second, five failures from a third."""
    tries = [("Failed", "amy", "172.16.4.9")] * 3 + [("Accepted", "ben", "172.16.7.2")] + [("Failed", "carl", "10.9.8.7")] * 5
    return [
        f"Mar 11 13:05:{i:02d} gate sshd[{500 + i}]: {how} password for {user} from {ip} port {4000 + i} ssh2"
        for i, (how, user, ip) in enumerate(tries)
    ]


SAMPLE = sample_lines()


def parsed(spark, tails, **options):
    lines = [(f"Jun 15 14:00:02 web {t}", "auth_log") for t in tails]
    frame = text_logs.parse_lines(spark.createDataFrame(lines, "value string, layout string"), **options)
    return {r["raw_line"].split(" web ")[1]: r for r in frame.collect()}


@pytest.mark.parametrize(
    "tail, process, message, event, user, ip",
    [
        ("sshd[77]: Failed password for invalid user bob from 1.2.3.4 port 5 ssh2", "sshd", "77]: Failed", "FAILED_LOGIN", "invalid", "1.2.3.4"),
        ("sudo: admin : TTY=pts/0 ; PWD=/home/admin ; USER=root ; COMMAND=/bin/bash", "sudo", " admin : TTY", "OTHER", "unknown", "Internal"),
        ("sshd[7]: pam_unix(sshd:session): session opened for user root by (uid=0)", "sshd", "7]: pam_unix", "ROOT_ACCESS", "user", "Internal"),
        ("sshd[7]: Invalid user bob from 9.9.9.9 port 1", "sshd", "7]: Invalid", "INVALID_USER", "bob", "9.9.9.9"),
        ("sshd[7]: AUTHENTICATION FAILURE; user", "sshd", "7]: AUTH", "FAILED_LOGIN", "unknown", "Internal"),
        ("sshd[7]: Accepted publickey for eve from 999.1.1.1", "sshd", "7]: Accepted", "SUCCESSFUL_LOGIN", "eve", "999.1.1.1"),
    ],
)
def test_header_rules(spark, tail, process, message, event, user, ip):
    row = parsed(spark, [tail])[tail]
    assert (row["process"], row["event"], row["username"], row["ip_address"]) == (process, event, user, ip)
    assert row["message"].startswith(message)


def test_strict_users(spark):
    tails = [
        "sshd[77]: Failed password for invalid user bob from 1.2.3.4 port 5 ssh2",
        "sshd[7]: pam_unix(sshd:session): session opened for user root by (uid=0)",
    ]
    rows = parsed(spark, tails, strict_users=True)
    assert [rows[t]["username"] for t in tails] == ["bob", "root"]


def test_times(spark):
    stamps = ["Jun 15 14:00:02", "Jun  5 04:59:59", "Feb 31 10:00:00", "Feb 29 10:00:00", "Foo 12 10:00:00", "Jan 15 23:59:60"]
    iso = ["2024-06-15T14:00:02+05:30", "2024-06-15T14:00:02.25Z", "2024-06-15T14:00:02", "2024-06-15T14:00:02x", "2024-02-30T14:00:02Z"]
    data = [(s, "auth_log") for s in stamps] + [(s, "syslog") for s in iso]
    frame = spark.createDataFrame(data, "s string, layout string")
    got = {
        r["s"]: r["t"]
        for r in frame.select("s", text_logs.parse_event_time(F.col("s"), F.col("layout")).alias("t")).collect()
    }
    assert got["Jun 15 14:00:02"] == dt.datetime(2024, 6, 15, 14, 0, 2)
    assert got["Jun  5 04:59:59"] == dt.datetime(2024, 6, 5, 4, 59, 59)
    assert got["Feb 29 10:00:00"] == dt.datetime(2024, 2, 29, 10)
    assert got["2024-06-15T14:00:02+05:30"] == got["2024-06-15T14:00:02"] == dt.datetime(2024, 6, 15, 14, 0, 2)
    assert got["2024-06-15T14:00:02.25Z"] == dt.datetime(2024, 6, 15, 14, 0, 2, 250000)
    for bad in ("Feb 31 10:00:00", "Foo 12 10:00:00", "Jan 15 23:59:60", "2024-06-15T14:00:02x", "2024-02-30T14:00:02Z"):
        assert got[bad] is None


def test_reading_files(spark, tmp_path):
    classic = tmp_path / "auth.log"
    classic.write_bytes(
        b"\n  \nnoise\nFeb 31 10:00:00 web sshd[1]: Failed password for a from 1.1.1.1\n"
        + "\n".join(SAMPLE).encode()
        + b"\nJun  5 01:00:00 web sshd[1]: Accepted password for x\xff from 2.2.2.2 port 1\n"
    )
    iso = tmp_path / "syslog"
    iso.write_text("\n".join(f"2024-06-15T14:00:{i:02d}+02:00 db sshd[1]: Failed password for z from 3.3.3.3" for i in range(30)))
    (tmp_path / "empty.log").write_text("")
    (tmp_path / "noise.log").write_text("nothing here\n" * 3)
    formats = {
        r["source_file"].rsplit("/", 1)[1]: r["layout"]
        for r in text_logs.detect_log_format(spark, str(tmp_path)).collect()
    }
    assert formats == {"auth.log": "auth_log", "syslog": "syslog", "noise.log": "auth_log"}
    events = text_logs.read_auth_logs(spark, str(tmp_path))
    assert events.count() == len(SAMPLE) + 1 + 30
    odd = events.filter("ip_address = '2.2.2.2'").first()
    assert odd["username"] == "x" and odd["parsed_time"] == dt.datetime(2024, 6, 5, 1)
    numbered = text_logs.read_auth_logs(spark, str(tmp_path), number_lines=True)
    lines = [r["line_number"] for r in numbered.filter("host = 'gate'").orderBy("line_number").collect()]
    assert lines == list(range(5, 14))


def test_a_store_that_only_spark_opens(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "auth.log").write_text("\n".join(SAMPLE * 20) + "\n")
    iso = "\n".join(f"2024-06-15T14:00:{i:02d}+02:00 db sshd[1]: Failed password for z from 3.3.3.3" for i in range(9))
    (folder / "iso.log").write_text(iso + "\n" + "\n".join(SAMPLE * 4))
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.only.link./in", f"file://{tmp_path}")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        far, near = "viewfs://only/in/logs", str(folder)
        assert far.split(":")[0] in text_logs.first_lines(spark, far).first()["source_file"]
        heads = lambda path: sorted(r["value"] for r in text_logs.first_lines(spark, path).collect())
        assert heads(far) == heads(near) and len(heads(far)) == 40
        layouts = {r["source_file"].rsplit("/", 1)[1]: r["layout"] for r in text_logs.detect_log_format(spark, far).collect()}
        assert layouts == {"auth.log": "auth_log", "iso.log": "auth_log"}
        events = [sorted(r["raw_line"] for r in text_logs.read_auth_logs(spark, path).collect()) for path in (far, near)]
        assert events[0] == events[1] and len(events[0]) == 216
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_line_numbers_over_many_splits(spark, tmp_path):
    text = [f"Jun 15 14:{i // 60 % 60:02d}:{i % 60:02d} web sshd[{i}]: Failed password for u from 1.1.1.1" for i in range(2000)]
    (tmp_path / "big.log").write_text("\n".join(text) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        events = text_logs.read_auth_logs(spark, str(tmp_path), number_lines=True)
        assert events.rdd.getNumPartitions() > 4
        got = {r["raw_line"]: r["line_number"] for r in events.collect()}
        loose = text_logs.read_auth_logs(spark, str(tmp_path)).orderBy("line_number").collect()
        assert [r["value"] for r in text_logs.first_lines(spark, str(tmp_path)).collect()] == text[:20]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {line: number for number, line in enumerate(text, 1)}
    assert [r["raw_line"] for r in loose] == text


def test_simple_profile_on_the_sample(spark):
    lines = spark.createDataFrame([(v,) for v in SAMPLE], "value string")
    result = analysis.analyze_simple(lines)
    flagged = [(r["ip_address"], r["failed_count"]) for r in result["bruteforce"].collect()]
    assert flagged == [("10.9.8.7", 5), ("172.16.4.9", 3)]
    levels = {r["ip_address"]: (r["score"], r["level"]) for r in result["severity"].collect()}
    assert levels == {"10.9.8.7": (10, "HIGH"), "172.16.4.9": (6, "MEDIUM"), "172.16.7.2": (3, "LOW")}
    assert result["compromise"].count() == 0 and result["night_logins"].count() == 0


def test_adaptive_rules_on_the_sample(spark):
    from logsleuth.operators import detect

    frame = spark.createDataFrame([(v, "auth_log") for v in SAMPLE], "value string, layout string")
    found = {r["ip_address"]: r for r in detect.bruteforce(text_logs.parse_lines(frame)).collect()}
    assert {ip: (r["threshold"], r["confidence"], r["is_bruteforce"]) for ip, r in found.items()} == {
        "172.16.4.9": (7.5, 0.24, False),
        "10.9.8.7": (7.5, 0.76, False),
    }
