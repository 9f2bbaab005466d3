"""Streaming forms of ingest, login frequency and sessions."""

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

from logsleuth.functions.columns import as_instant, wall_clock
from logsleuth.schema import AUTH_EVENTS
from logsleuth.sources.text_logs import DEFAULT_YEAR, LAYOUTS, clean_line, parse_lines, with_line_numbers

WATERMARK = "10 minutes"

# State with timers needs this state store.
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def line_layout(value: Column) -> Column:
    """Layout of a single line, since a stream has no first lines to vote on."""
    line = clean_line(value)
    return F.when(line.rlike(f"(?s){LAYOUTS['auth_log']}"), "auth_log").otherwise("syslog")


def read_line_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Lines of text files as they appear under a path, with their file and split."""
    return (
        spark.readStream.option("maxFilesPerTrigger", files_per_batch)
        .text(path)
        .select(
            "value",
            F.col("_metadata.file_path").alias("source_file"),
            F.col("_metadata.file_block_start").alias("_split"),
        )
    )


def parse_batch(lines: DataFrame, year: str = DEFAULT_YEAR) -> DataFrame:
    """Authentication events of one micro-batch of lines.

    A batch holds whole files, so every line gets its number in its file, the one that
    the batch reader gives with ``number_lines``. Splits are counted in a pass of their own.
    """
    placed = lines.withColumn("_at", F.monotonically_increasing_id())
    numbered = with_line_numbers(placed, placed)
    parsed = parse_lines(numbered.withColumn("layout", line_layout(F.col("value"))), year)
    return parsed.select(*[F.col(f.name).cast(f.dataType) for f in AUTH_EVENTS])


def _run_batches(stream: DataFrame, path: str, schema, prepare, mode: str) -> DataFrame:
    """Write every available batch, prepared, into a folder of its own; the table of all of them.

    A batch that is repeated after a failure replaces its folder, so that no row is stored twice.
    """
    spark = stream.sparkSession
    table = f"{path}/table"
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{table}/batch=-1")
    query = (
        stream.writeStream.foreachBatch(
            lambda batch, n: prepare(batch).write.mode("overwrite").parquet(f"{table}/batch={n}")
        )
        .option("checkpointLocation", f"{path}/state")
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(table)


def ingest_available(lines: DataFrame, path: str, year: str = DEFAULT_YEAR) -> DataFrame:
    """Parse all available lines into a Parquet table of events and return that table."""
    stored = _run_batches(lines, path, AUTH_EVENTS, lambda batch: parse_batch(batch, year), "append")
    return stored.select(AUTH_EVENTS.fieldNames())


def run_to_end(stream: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Process everything available and return the latest row of each key.

    For aggregations without session windows. Rows are written as they change, whatever the
    watermark says, so what is still open at the end of a finite input is there too.
    """
    rows = _run_batches(stream, path, stream.schema, lambda batch: batch, "update")
    others = [c for c in stream.columns if c not in keys]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("_last"))
    return latest.select(*keys, "_last.*").select(stream.columns)


def _clock(instant: str) -> Column:
    return wall_clock(F.unix_micros(instant))


def frequency_stream(events: DataFrame, threshold: float, watermark: str = WATERMARK) -> DataFrame:
    """Events per minute, flagged against a threshold from a batch baseline.

    Empty minutes do not appear, and a minute is final once the watermark passed it.
    """
    return (
        events.select(as_instant("parsed_time").alias("at"))
        .withWatermark("at", watermark)
        .groupBy(F.window("at", "1 minute").alias("w"))
        .agg(F.count("*").alias("events"))
        .select(
            _clock("w.start").alias("minute"),
            "events",
            (F.col("events") > threshold).alias("is_spike"),
        )
    )


#: Columns of a piece of a session: the events of an address in a slot as wide as the timeout.
PIECES = "ip_address string, start long, last long, n long"

#: Event time of the row that closes an input: later than any event.
END_OF_INPUT = "9999-01-01"


def _pieces(rows: DataFrame, width: int) -> DataFrame:
    """First and last time and number of the events of each address and slot, by task.

    Events of a slot always belong to one session. They are combined where they are read, so
    an address with very many events sends a few rows to the task that keeps its sessions.
    """

    def run(batches):
        for batch in batches:
            batch = batch.filter(pc.invert(batch.column("closing")))
            at = pc.cast(pc.cast(batch.column("at"), pa.timestamp("us")), pa.int64())
            slot = pa.array(at.to_numpy(zero_copy_only=False) // width)
            table = pa.table({"ip_address": batch.column("ip_address"), "slot": slot, "at": at})
            found = table.group_by(["ip_address", "slot"]).aggregate([("at", "min"), ("at", "max"), ("at", "count")])
            for part in found.select(["ip_address", "at_min", "at_max", "at_count"]).to_batches():
                yield pa.RecordBatch.from_arrays(part.columns, ["ip_address", "start", "last", "n"])

    return rows.mapInArrow(run, PIECES)


def merge_pieces(pieces: list[tuple], width: int) -> list[tuple]:
    """Sessions (start, last, n) made of pieces; a pause of ``width`` does not end one."""
    merged: list[tuple] = []
    for start, last, n in sorted(pieces):
        if merged and start - merged[-1][1] <= width:
            before = merged.pop()
            merged.append((before[0], max(before[1], last), before[2] + n))
        else:
            merged.append((start, last, n))
    return merged


class OpenSessions(StatefulProcessor):
    """Keeps the open sessions of an address; a timer gives out what the watermark has passed.

    A session is final when the watermark is behind its last event by more than the pause.
    Pieces wholly behind the watermark come too late and are dropped, as in any aggregation
    with a watermark.
    """

    def __init__(self, width: int):
        self.width = width

    def init(self, handle):
        self.handle = handle
        self.open = handle.getListState("open", "start long, last long, n long")

    def _keep(self, sessions):
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if sessions:
            self.open.put(sessions)
            first = min(last for _, last, _ in sessions)
            self.handle.registerTimer((first + self.width) // 1000 + 1)
        else:
            self.open.clear()

    def handleInputRows(self, key, rows, timerValues):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        pieces = [tuple(int(v) for v in s) for s in self.open.get()]
        for frame in rows:
            new = zip(frame["start"].tolist(), frame["last"].tolist(), frame["n"].tolist())
            pieces.extend(piece for piece in new if piece[1] >= passed)
        self._keep(merge_pieces(pieces, self.width))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        kept, done = [], []
        for start, last, n in self.open.get():
            (done if last + self.width < passed else kept).append((int(start), int(last), int(n)))
        self._keep(kept)
        if done:
            yield pd.DataFrame([(key[0], *s) for s in done], columns=["ip_address", "start", "last", "n"])

    def close(self):
        pass


def end_marks(spark: SparkSession, path: str) -> DataFrame:
    """Stream of the rows with which ``close_input`` ends the input that is kept at ``path``."""
    schema = "at timestamp, ip_address string, closing boolean"
    spark.createDataFrame([], schema).write.mode("append").parquet(f"{path}/end")
    return spark.readStream.schema(schema).parquet(f"{path}/end")


def close_input(spark: SparkSession, path: str) -> None:
    """Declare the input at ``path`` ended: its next run gives out all that is still open."""
    end = spark.sql(f"SELECT TIMESTAMP'{END_OF_INPUT}' AS at, CAST(NULL AS string) AS ip_address, true AS closing")
    end.coalesce(1).write.mode("append").parquet(f"{path}/end")


def session_stream(
    events: DataFrame, timeout_minutes: int = 30, watermark: str = WATERMARK, ends: DataFrame | None = None
) -> DataFrame:
    """Sessions per address; a pause of exactly the timeout still belongs to the session.

    Sessions appear when the watermark has passed them. ``ends``, a stream of ``end_marks``,
    lets a finite input be closed, which makes its open sessions final. Needs the state store
    that ``run_sessions`` sets.
    """
    width = timeout_minutes * 60_000_000
    rows = events.select(as_instant("parsed_time").alias("at"), "ip_address", F.lit(False).alias("closing"))
    if ends is not None:
        rows = rows.unionByName(ends)
    pieces = _pieces(rows.withWatermark("at", watermark), width)
    return (
        pieces.groupBy("ip_address")
        .transformWithStateInPandas(OpenSessions(width), PIECES, "Append", "EventTime")
        .select(
            "ip_address",
            wall_clock(F.col("start")).alias("session_start"),
            wall_clock(F.col("last")).alias("session_end"),
            F.col("n").alias("event_count"),
        )
    )


def run_sessions(
    events: DataFrame, path: str, timeout_minutes: int = 30, watermark: str = WATERMARK, close: bool = True
) -> DataFrame:
    """Process all available events and return the table of sessions at ``path``.

    With ``close`` the input ends there and every session of it is in the table; without it
    open sessions wait in the state for the next run.
    """
    spark = events.sparkSession
    stream = session_stream(events, timeout_minutes, watermark, end_marks(spark, path))
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        table = run_available(stream, path)
        if close:
            close_input(spark, path)
            table = run_available(stream, path)
    finally:
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)
    return table


def run_available(stream: DataFrame, path: str) -> DataFrame:
    """Process everything available into a Parquet table and return that table."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{path}/table")
        .option("checkpointLocation", f"{path}/state")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/table")
