"""Authentication events read from the generic ``events`` table.

The table holds (event_id, ts, user_id, event_type, value, props); its columns are
mapped onto the authentication schema by fixed rules so that every operator can be
run, and checked, on given data.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from logsleuth.schema import (
    DISCONNECT,
    FAILED,
    INTERNAL_IP,
    INVALID,
    OTHER,
    ROOT,
    SUCCESS,
    SUDO,
    UNKNOWN_USER,
)


def _with_auth_columns(raw: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    group = F.col("user_id")
    with_keys = raw.withColumn("_k", k).withColumns(
        {
            "event": F.when(kind == "error", FAILED)
            .when(kind == "view", SUCCESS)
            .when(kind == "signup", INVALID)
            .when((kind == "click") & (F.col("_k") % 10 == 9), OTHER)
            .when(kind == "click", DISCONNECT)
            .when(F.col("_k") % 2 == 0, SUDO)
            .otherwise(ROOT),
            "ip_address": F.when(F.col("_k") >= 96, INTERNAL_IP)
            .when(F.col("_k") == 95, "127.0.0.1")
            .when(
                F.col("_k") == 94,
                F.concat_ws(".", F.lit("10"), F.floor(group / 250).cast("string"), (group % 250).cast("string"), F.lit("1")),
            )
            .when(F.col("_k") == 7, "198.51.100.7")
            .when(
                F.col("_k") < 20,
                F.concat_ws(".", F.lit("198.51"), F.floor(group / 40).cast("string"), F.col("_k").cast("string")),
            )
            .otherwise(
                F.concat_ws(
                    ".",
                    F.lit("203"),
                    F.floor(group / 250).cast("string"),
                    (group % 250).cast("string"),
                    F.floor(F.col("_k") / 32).cast("string"),
                )
            ),
            "username": F.when(F.col("event_id") % 997 == 0, "admin_backup")
            .when(kind == "click", UNKNOWN_USER)
            .otherwise(F.concat(F.lit("user"), group.cast("string"))),
            "host": F.concat(F.lit("host"), (F.col("_k") % 4).cast("string")),
            "_pid": (1000 + F.col("event_id") % 9000).cast("string"),
        }
    )
    user, ip = F.col("username"), F.col("ip_address")
    port = (40000 + F.col("_k")).cast("string")
    body = (
        F.when(F.col("event") == FAILED, F.concat(F.lit("Failed password for "), user, F.lit(" from "), ip, F.lit(" port "), port, F.lit(" ssh2")))
        .when(F.col("event") == SUCCESS, F.concat(F.lit("Accepted password for "), user, F.lit(" from "), ip, F.lit(" port "), port, F.lit(" ssh2")))
        .when(F.col("event") == INVALID, F.concat(F.lit("Invalid user "), user, F.lit(" from "), ip, F.lit(" port "), port))
        .when(F.col("event") == DISCONNECT, F.concat(F.lit("Disconnected from "), ip, F.lit(" port "), port))
        .when(F.col("event") == OTHER, F.concat(F.lit("Received signal 15 while serving "), ip))
        .when(F.col("event") == SUDO, F.concat(F.lit("sudo: "), user, F.lit(" : TTY=pts/0 ; PWD=/home/"), user, F.lit(" ; USER=root ; COMMAND=/bin/bash")))
        .otherwise(F.concat(F.lit("pam_unix(sshd:session): session opened for user root by "), user))
    )
    stamp = F.concat(
        F.date_format("ts", "MMM"), F.lit(" "),
        F.lpad(F.dayofmonth("ts").cast("string"), 2, " "), F.lit(" "),
        F.date_format("ts", "HH:mm:ss"),
    )
    return with_keys.withColumns(
        {
            "source_file": F.lit("events"),
            "line_number": F.col("event_id"),
            "parsed_time": F.col("ts").cast("timestamp_ntz"),
            "timestamp_str": stamp,
            "process": F.lit("sshd"),
            "message": F.concat("_pid", F.lit("]: "), body),
        }
    ).withColumn(
        "raw_line",
        F.concat("timestamp_str", F.lit(" "), "host", F.lit(" sshd["), "message"),
    )


def auth_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``events`` table of a data folder as authentication events."""
    return from_event_table(spark.read.parquet(f"{sf_dir}/events.parquet"))


def from_event_table(raw: DataFrame) -> DataFrame:
    return _with_auth_columns(raw).select(
        "source_file",
        "line_number",
        "timestamp_str",
        "parsed_time",
        "event",
        "ip_address",
        "username",
        "process",
        "host",
        "message",
        "raw_line",
    )


def auth_lines(events: DataFrame) -> DataFrame:
    """Raw log lines (host, value) of authentication events, with noise between them.

    Hosts ending in 3 write ISO stamps, all others the classic layout. Some events
    are followed by an empty line, a line of another program, or an impossible date.
    """
    iso = F.concat(
        F.date_format("parsed_time", "yyyy-MM-dd'T'HH:mm:ss"),
        F.lit("+00:00 "), "host", F.lit(" sshd["), "message",
    )
    number = F.col("line_number")
    lines = F.array_compact(
        F.array(
            F.when(F.col("host") == "host3", iso).otherwise(F.col("raw_line")),
            F.when(number % 40 == 0, F.lit("   ")),
            F.when(number % 41 == 0, F.concat(F.lit("kernel message "), number.cast("string"))),
            F.when(
                number % 43 == 0,
                F.lit("Feb 31 10:00:00 host0 sshd[1]: Failed password for x from 1.2.3.4 port 1 ssh2"),
            ),
        )
    )
    return events.select("host", F.explode(lines).alias("value"))
