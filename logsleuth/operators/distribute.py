"""Building blocks that keep ordered and keyed work spread over the cluster.

Authentication logs are skewed by nature: every line without an address lands on
one key, an attacking address or the ``root`` account may own a third of a log.
Nothing here therefore relies on one key fitting into one task.
"""

import decimal
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from logsleuth.functions.columns import micros
from logsleuth.schema import EVENT_ORDER

# A key is hot above this many rows, or above its share of 1/HOT_MAX_KEYS of all
# rows if that is more. By counting, at most HOT_MAX_KEYS keys can be hot and
# they carry at most 2 * HOT_MAX_KEYS salts: the bound for broadcasting them.
HOT_ROWS = 2_000_000
HOT_MAX_KEYS = 100_000

# Setting under which a query removes its shuffle files when it ends.
REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Rows handled by one window group when a globally ordered table is cut up.
BLOCK_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a temporary one only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            configured = tempfile.mkdtemp(prefix="logsleuth-")
        context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, for tables of addresses or users and for loop state."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """``df`` as a table in the checkpoint folder, for data as large as the events.

    Unlike a checkpoint the table is compressed and columnar: a pass that needs one
    column reads one column, and the optimizer knows its size. Shuffle files of the job are
    removed when the table is complete, so disk holds those of one step at a time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(REMOVE_SHUFFLES, None)
    spark.conf.set(REMOVE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(REMOVE_SHUFFLES) if before is None else spark.conf.set(REMOVE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def spread_out(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partitioning that stays as wide as the session's shuffles.

    For steps that do much work on few bytes, which adaptive execution would merge
    into a single task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def hot_keys(counts: DataFrame, keys: list[str], weight: str, hot_rows: int | None = None):
    """Keys of ``counts`` that need splitting, with the number of salts each gets."""
    total = counts.agg(F.sum(weight)).scalar()
    limit = F.greatest(F.lit(hot_rows or HOT_ROWS), F.ceil(total / HOT_MAX_KEYS))
    return (
        counts.withColumn("_limit", limit)
        .filter(F.col(weight) > F.col("_limit"))
        .select(*keys, F.ceil(F.col(weight) / F.col("_limit")).cast("int").alias("_salts"))
    )


def skew_join(
    events: DataFrame,
    table: DataFrame,
    keys: list[str],
    weight: str,
    how: str = "left",
    spread: tuple = ("line_number", "source_file", "parsed_time"),
    hot_rows: int | None = None,
) -> DataFrame:
    """Join many events to one row per key, spreading the events of hot keys.

    ``weight`` is the column of ``table`` that says how many events its key has.
    Hot keys get several salts: their events are dealt out over them and their
    table row is repeated once per salt. All other keys take part unsalted. The
    salt is a hash of the ``spread`` columns, so a retried task deals the same way.
    """
    hot = F.broadcast(hot_keys(table, keys, weight, hot_rows))
    deal = F.pmod(F.xxhash64(*spread), F.col("_salts"))
    salted_events = events.join(hot, keys, "left").withColumn(
        "_salt", F.coalesce(deal.cast("int"), F.lit(0))
    )
    salted_table = table.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    )
    return salted_events.drop("_salts").join(
        salted_table.drop("_salts", weight), keys + ["_salt"], how
    ).drop("_salt")


def global_index(df: DataFrame, order: list, name: str = "row_index") -> DataFrame:
    """Number the rows 0, 1, 2, ... in the given total order.

    Rows are range partitioned and sorted; the position inside the partition is
    stamped and stored, so that the per-partition offsets and the rows refer to the
    same layout even if executors are lost in between. The offsets have one
    row per partition, which is what makes their ordered window and broadcast safe.
    """
    stamped = store(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_stamp", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_stamp", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        stamped.groupBy("_part")
        .agg(F.count("*").alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    within = F.col("_stamp").bitwiseAND((1 << 33) - 1)
    return (
        stamped.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + within)
        .drop("_stamp", "_part", "_offset")
    )


def earliest_line(at: str) -> Column:
    """Aggregate: line number at the smallest ``at``, the lowest one among equal times.

    Time and line are compared as one fixed-width number, which a hash aggregation
    can hold; the minimum of a struct would sort all rows before the shuffle.
    """
    lines = F.lit(decimal.Decimal(10**19))
    at = F.col(at).cast("decimal(18,0)")
    return (
        F.min(at * lines + F.col("line_number").cast("decimal(20,0)")) - F.min(at) * lines
    ).cast("long")


def first_events(events: DataFrame, keys: list[str]) -> DataFrame:
    """Position (a struct in the order of events) of the first event of each key."""
    timed = events.select(*keys, *EVENT_ORDER, micros("parsed_time").alias("_t"))
    per_file = timed.groupBy(*keys, "source_file").agg(
        F.min("parsed_time").alias("parsed_time"), earliest_line("_t").alias("line_number")
    )
    return per_file.groupBy(*keys).agg(F.min(F.struct(*EVENT_ORDER)).alias("first"))


def with_previous(
    indexed: DataFrame, index: str, column: str, alias: str, block: int | None = None
) -> DataFrame:
    """Value of ``column`` in the row before, over a globally indexed table.

    The table is cut into blocks of consecutive rows; the last row of each block is
    lent to the next one, so no window ever holds more than a block.
    """
    block = block or BLOCK_ROWS
    own = F.floor(F.col(index) / block)
    lent = F.when(F.col(index) % block == block - 1, F.array(own, own + 1)).otherwise(F.array(own))
    order = Window.partitionBy("_block").orderBy(index)
    return (
        indexed.withColumn("_block", F.explode(lent))
        .withColumn(alias, F.lag(column).over(order))
        .filter(F.col("_block") == own)
        .drop("_block")
    )


def exact_percentile(df: DataFrame, column: str, share, tie: list[str]) -> DataFrame:
    """One-row table with the linearly interpolated percentile of a column.

    Order statistics come from a distributed sort; nothing is collected in a buffer.
    The ``tie`` columns spread rows of equal value over partitions.
    """
    order = [column, *tie]
    indexed = global_index(df.select(order).filter(F.col(column).isNotNull()), order, "_rank")
    share = share if isinstance(share, Column) else F.lit(share)
    at = indexed.agg((share * (F.count("*") - 1)).alias("at")).scalar()
    return (
        indexed.withColumn("_at", at)
        .filter((F.col("_rank") >= F.floor("_at")) & (F.col("_rank") <= F.ceil("_at")))
        .agg(
            (
                F.min(column) + (F.max(column) - F.min(column)) * F.max(F.col("_at") - F.floor("_at"))
            ).alias(column)
        )
    )
