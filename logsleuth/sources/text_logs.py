"""Raw authentication logs: reading, layout detection and line parsing."""

import io
import itertools

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from logsleuth.operators.distribute import store
from logsleuth.schema import AUTH_EVENTS, INTERNAL_IP, OTHER, UNKNOWN_USER

# Line layouts, event rules in order of precedence, address and user
# patterns, and the defaults that go with them.
LAYOUTS = {
    "auth_log": r"([A-Z][a-z]{2}\s+\d+\s\d{2}:\d{2}:\d{2})\s(\S+)\s(\S+?)[\[:\s](.*)",
    "syslog": r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[^\s]*)\s(\S+)\s(\S+?)[\[:\s](.*)",
    "journald": r"([A-Z][a-z]{2}\s+\d+\s\d{2}:\d{2}:\d{2})\s(\S+)\s(\S+)\[(\d+)\]:\s(.*)",
}
DEFAULT_LAYOUT = "auth_log"
SAMPLE_LINES = 20
EVENT_RULES = [
    ("Failed password", "FAILED_LOGIN"),
    ("authentication failure", "FAILED_LOGIN"),
    ("Accepted password", "SUCCESSFUL_LOGIN"),
    ("Accepted publickey", "SUCCESSFUL_LOGIN"),
    ("session opened.*root", "ROOT_ACCESS"),
    ("sudo:", "SUDO_ATTEMPT"),
    ("Invalid user", "INVALID_USER"),
    ("Connection closed", "DISCONNECT"),
    ("Disconnected from", "DISCONNECT"),
]
IP_PATTERN = r"(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"
USER_PATTERN = r"(?:for|user)\s+(\S+?)(?:\s|$)"
DEFAULT_YEAR = "2024"

# Fixed values of the simple profile.
SIMPLE_LAYOUT = r"([A-Z][a-z]{2}\s+\d+\s\d{2}:\d{2}:\d{2})\s(\S+)\s(\S+?):?\s(.*)"
SIMPLE_IP_PATTERN = r"(\d+\.\d+\.\d+\.\d+)"

# Option beside the default: the name after "for", "user" or "(for) invalid user".
STRICT_USER_PATTERN = r"\b(?:for(?:\s+(?:invalid\s+)?user)?|user)\s+(?!(?:invalid|user)\s)(\S+?)(?:\s|$)"

MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
ISO_STAMP = (
    r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?"
    r"(Z|[+-]\d{2}(:?\d{2}(:?\d{2}([.,]\d+)?)?)?)?$"
)
BLANKS = " \t\r\n\f\u000b"


def clean_line(value: Column) -> Column:
    """Line without surrounding blanks; bytes that are no UTF-8 are left out."""
    replaced = F.replace(F.make_valid_utf8(value), F.lit("�"), F.lit(""))
    return F.btrim(F.when(F.is_valid_utf8(value), value).otherwise(replaced), F.lit(BLANKS))


def classify_event(message: Column) -> Column:
    """Event type by the first rule found in the message."""
    event = F.lit(OTHER)
    for pattern, name in reversed(EVENT_RULES):
        event = F.when(message.rlike(f"(?is){pattern}"), name).otherwise(event)
    return event


def _first_match(text: Column, pattern: str, default: str) -> Column:
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found == "", default).otherwise(found)


def extract_ip(message: Column) -> Column:
    return _first_match(message, IP_PATTERN, INTERNAL_IP)


def extract_user(message: Column, strict_users: bool = False) -> Column:
    pattern = STRICT_USER_PATTERN if strict_users else USER_PATTERN
    return _first_match(message, f"(?i){pattern}", UNKNOWN_USER)


def parse_classic_time(stamp: Column, year: str = DEFAULT_YEAR) -> Column:
    """Wall-clock time of ``Mon d HH:MM:SS`` in a given year; null if there is no such time."""
    parts = F.split(stamp, r"\s+")
    month = (F.instr(F.lit(MONTHS), F.substring(stamp, 1, 3)) + 2) / 3
    number = F.when(month == F.floor(month), F.lpad(F.floor(month).cast("string"), 2, "0"))
    day = F.when(F.length(parts[1]) <= 2, F.lpad(parts[1], 2, "0"))
    text = F.concat(F.lit(f"{year}-"), number, F.lit("-"), day, F.lit(" "), parts[2])
    return text.try_cast("timestamp_ntz")


def parse_iso_time(stamp: Column) -> Column:
    """Wall-clock part of an ISO stamp; null if the stamp or its offset is malformed."""
    clock = F.replace(F.regexp_extract(stamp, r"^([^Z+]*?)(?:Z|[+-]\d{2}[:\d.,]*)?$", 1), F.lit(","), F.lit("."))
    return F.when(stamp.rlike(ISO_STAMP), clock.try_cast("timestamp_ntz"))


def parse_event_time(stamp: Column, layout: Column, year: str = DEFAULT_YEAR) -> Column:
    return F.when(layout == "syslog", parse_iso_time(stamp)).otherwise(
        parse_classic_time(stamp, year)
    )


def split_header(lines: DataFrame) -> DataFrame:
    """Time stamp, host, process and message of each line; other lines are left out.

    ``lines`` has the columns ``value`` and ``layout``.
    """
    line = F.col("_line")
    part = lambda group: F.when(
        F.col("layout") == "syslog", F.regexp_extract(line, f"(?s){LAYOUTS['syslog']}", group)
    ).when(
        F.col("layout") == "journald",
        F.regexp_extract(line, f"(?s){LAYOUTS['journald']}", 5 if group == 4 else group),
    ).otherwise(F.regexp_extract(line, f"(?s){LAYOUTS['auth_log']}", group))
    return (
        lines.withColumn("_line", clean_line(F.col("value")))
        .withColumn("timestamp_str", part(1))
        .filter(F.col("timestamp_str") != "")
        .withColumns({"host": part(2), "process": part(3), "message": part(4)})
        .withColumnRenamed("_line", "raw_line")
        .drop("value")
    )


def parse_lines(lines: DataFrame, year: str = DEFAULT_YEAR, strict_users: bool = False) -> DataFrame:
    """Event columns of raw lines; lines of another layout or with no valid time are dropped."""
    message = F.col("message")
    return (
        split_header(lines)
        .withColumn("parsed_time", parse_event_time(F.col("timestamp_str"), F.col("layout"), year))
        .filter(F.col("parsed_time").isNotNull())
        .withColumns(
            {
                "event": classify_event(message),
                "ip_address": extract_ip(message),
                "username": extract_user(message, strict_users),
            }
        )
        .drop("layout")
    )


def _raw_lines(spark: SparkSession, paths) -> DataFrame:
    """Lines with their file, the byte offset of their split and their order in it."""
    return spark.read.text(paths).select(
        "value",
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_at"),
    )


def with_line_numbers(lines: DataFrame, all_lines: DataFrame) -> DataFrame:
    """Lines with their number in the file, from the line counts of earlier splits."""
    earlier = (
        Window.partitionBy("source_file")
        .orderBy("_split")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    splits = (
        all_lines.groupBy("source_file", "_split")
        .agg(F.count("*").alias("_lines"), F.min("_at").alias("_from"))
        .withColumn("_before", F.coalesce(F.sum("_lines").over(earlier), F.lit(0)))
        .drop("_lines")
    )
    return lines.join(splits, ["source_file", "_split"]).withColumn(
        "line_number", F.col("_before") + F.col("_at") - F.col("_from") + 1
    )


def layout_votes(line: Column) -> dict[str, Column]:
    return {name: line.rlike(f"(?s){pattern}").cast("int") for name, pattern in LAYOUTS.items()}


def first_lines(spark: SparkSession, paths) -> DataFrame:
    """The first lines of each file, as (source_file, value).

    Spark lists the files and deals them out; a task opens each of its files with pyarrow and
    stops reading after the last line it needs. Files in stores that only Spark opens are read
    by Spark, in a pass over all their lines.
    """

    def run(batches):
        for batch in batches:
            for path in batch.column("source_file").to_pylist():
                try:
                    files, name = fs.FileSystem.from_uri(path)
                    stream = files.open_input_stream(name)
                except (pa.ArrowException, OSError):
                    lines = [None]  # not empty: not opened
                else:
                    with stream:
                        text = io.TextIOWrapper(stream, encoding="utf-8", errors="ignore")
                        lines = [line.rstrip("\n") for line in itertools.islice(text, SAMPLE_LINES)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(lines), pa.string()), pa.array(lines, pa.string())],
                    ["source_file", "value"],
                )

    # Neither lengths nor contents are asked for, so Spark opens no file.
    names = spark.read.format("binaryFile").load(paths).select(
        F.col("_metadata.file_path").alias("source_file")
    )
    opened = store(names.mapInArrow(run, "source_file string, value string"))
    unopened = opened.filter("value IS NULL").select("source_file")
    if unopened.isEmpty():
        return opened
    # Spark keeps the first rows of a window's groups before it shuffles them.
    place = F.row_number().over(Window.partitionBy("source_file").orderBy("_split", "_at"))
    heads = _raw_lines(spark, paths).withColumn("_place", place).filter(F.col("_place") <= SAMPLE_LINES)
    read = heads.join(unopened, "source_file", "left_semi").select("source_file", "value")
    return opened.filter("value IS NOT NULL").unionByName(read)


def detect_log_format(spark: SparkSession, paths) -> DataFrame:
    """Layout of each file: the one most of its first lines match, the earlier on ties.

    At most 20 lines of a file are read, however long it is, in stores that pyarrow opens
    (local, HDFS, S3, GCS); elsewhere Spark reads the files. A file none of whose first lines
    match counts as the default layout; an empty file has no row.
    """
    votes = (
        first_lines(spark, paths)
        .groupBy("source_file")
        .agg(*[F.sum(v).alias(n) for n, v in layout_votes(clean_line(F.col("value"))).items()])
    )
    return votes.select("source_file", chosen_layout().alias("layout"))


def chosen_layout() -> Column:
    best = F.greatest(*LAYOUTS)
    layout = F.lit(DEFAULT_LAYOUT)
    for name in reversed(LAYOUTS):
        layout = F.when(F.col(name) == best, name).otherwise(layout)
    return F.when(best == 0, DEFAULT_LAYOUT).otherwise(layout)


def read_auth_logs(
    spark: SparkSession,
    paths,
    year: str = DEFAULT_YEAR,
    strict_users: bool = False,
    layout: str | None = None,
    number_lines: bool = False,
) -> DataFrame:
    """Text logs as authentication events, in no particular order.

    ``line_number`` grows along each file (split offset and position in the split)
    and breaks ties between equal times; it is the true line number, at the price of
    counting the lines of every split first, with ``number_lines``. ``layout`` skips
    the per-file detection, which runs at once; the rest is lazy.
    """
    lines = _raw_lines(spark, paths)
    if layout is not None:
        lines = lines.withColumn("layout", F.lit(layout))
    else:
        # Stored, one small row a file: the optimizer broadcasts it only if it is small.
        lines = lines.join(store(detect_log_format(spark, paths)), "source_file", "left")
        lines = lines.withColumn("layout", F.coalesce("layout", F.lit(DEFAULT_LAYOUT)))
    if number_lines:
        lines = with_line_numbers(lines, _raw_lines(spark, paths))
    else:
        # Offset and position: lines of later splits sort after those of earlier ones.
        position = F.col("_split") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
        lines = lines.withColumn("line_number", position)
    return (
        parse_lines(lines, year, strict_users)
        .select(*[F.col(f.name).cast(f.dataType) for f in AUTH_EVENTS])
    )


def parse_simple_profile(lines: DataFrame, year: str = DEFAULT_YEAR) -> DataFrame:
    """Simple profile: one layout, password results only, address of any digit length."""
    part = lambda group: F.regexp_extract("value", f"(?s){SIMPLE_LAYOUT}", group)
    message = F.col("message")
    return (
        lines.withColumn("timestamp_str", part(1))
        .filter(F.col("timestamp_str") != "")
        .withColumn("message", part(4))
        .select(
            "timestamp_str",
            F.when(message.contains("Failed password"), "FAILED_LOGIN")
            .when(message.contains("Accepted password"), "SUCCESSFUL_LOGIN")
            .otherwise(OTHER)
            .alias("event"),
            _first_match(message, SIMPLE_IP_PATTERN, INTERNAL_IP).alias("ip_address"),
            "message",
            parse_classic_time(F.col("timestamp_str"), year).alias("parsed_time"),
        )
    )
