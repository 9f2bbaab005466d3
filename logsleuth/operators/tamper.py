"""Signs of log tampering: unusual entropy of the time between neighbouring events."""

from pyspark.sql import DataFrame, Window, functions as F

from logsleuth.functions.columns import micros, round_half_even
from logsleuth.operators import distribute
from logsleuth.operators.distribute import cut, global_index
from logsleuth.schema import EVENT_ORDER

# Histogram bins and the offset inside the logarithm.
BINS = 20
LOG_OFFSET = 1e-12


def _windows(events: DataFrame, window: int, stride: int, block: int) -> DataFrame:
    """One row per window and delta in it, grouped so that no further shuffle is needed.

    Rows are numbered globally and cut into blocks; the first rows of a block are
    lent to the block before it, so every window lies within one block.
    """
    block -= block % stride
    row = F.col("row_index")
    indexed = global_index(
        events.select(*EVENT_ORDER, micros("parsed_time").alias("t")), EVENT_ORDER
    ).select("row_index", "t")
    own = F.floor(row / block)
    lent = F.when((row % block <= window) & (own > 0), F.array(own - 1, own)).otherwise(F.array(own))
    in_block = Window.partitionBy("_block").orderBy("row_index")
    deltas = indexed.withColumn("_block", F.explode(lent)).withColumn(
        "delta", (F.lead("t").over(in_block) - F.col("t")) / 1e6
    )
    rows = indexed.agg(F.count("*")).scalar()
    first = F.greatest(F.ceil((row - (window - 1)) / stride), F.col("_block") * (block // stride), F.lit(0))
    last = F.least(F.floor(row / stride), (F.col("_block") + 1) * (block // stride) - 1)
    return (
        deltas.filter(F.col("delta").isNotNull() & (first <= last))
        .withColumn("window", F.explode(F.sequence(first, last)))
        .withColumn("_rows", rows)
        .filter(
            (F.col("window") * stride < F.col("_rows") - 1 - window) & (F.col("_rows") >= 2 * window)
        )
        .select("_block", "window", "delta")
    )


def _entropies(events, window=50, stride=10, block=None) -> DataFrame:
    """Unrounded entropy per window: equal bins between its smallest and largest delta."""
    block = block or distribute.BLOCK_ROWS
    whole = Window.partitionBy("_block", "window")
    low, high, x = F.col("_low"), F.col("_high"), F.col("delta")
    width = (high - low) / BINS
    guess = F.least(F.floor((x - low) / (high - low) * BINS), F.lit(BINS - 1))
    # Neighbouring bin where the rounded division fell on the wrong side of an edge.
    exact = (
        F.when(x < guess * width + low, guess - 1)
        .when((guess < BINS - 1) & (x >= (guess + 1) * width + low), guess + 1)
        .otherwise(guess)
    )
    flat = low == high
    p = F.col("n") / F.lit(float(window))
    return (
        _windows(events, window, stride, block)
        .withColumns({"_low": F.min("delta").over(whole), "_high": F.max("delta").over(whole)})
        .withColumns(
            {
                "_low": F.when(flat, low - 0.5).otherwise(low),
                "_high": F.when(flat, high + 0.5).otherwise(high),
            }
        )
        .groupBy("_block", "window", exact.alias("bin"))
        .agg(F.count("*").alias("n"))
        .groupBy("_block", "window")
        .agg((-F.sum(p * F.log2(p + LOG_OFFSET))).alias("entropy"))
        .select((F.col("window") * stride + window // 2).alias("center"), "entropy")
    )


def entropy_series(events: DataFrame, window: int = 50, stride: int = 10, block=None) -> DataFrame:
    """Entropy of the deltas around each window centre."""
    series = _entropies(events, window, stride, block)
    return series.select("center", (round_half_even(F.col("entropy"), 4) + 0.0).alias("entropy"))


def _rated(series: DataFrame, z_threshold: float) -> DataFrame:
    """Stored entropies with their mean and spread, their distance, and whether that is too far."""
    stats = series.agg(
        F.struct(F.avg("entropy").alias("mean"), F.stddev_pop("entropy").alias("sigma"))
    ).scalar()
    mean, sigma = F.col("_stats.mean"), F.col("_stats.sigma")
    z = F.when(sigma > 0, F.abs(F.col("entropy") - mean) / sigma).otherwise(0.0)
    return series.withColumn("_stats", stats).withColumn("z", z).withColumn("_far", F.col("z") > z_threshold)


def tamper_summary(
    events: DataFrame, window: int = 50, stride: int = 10, z_threshold: float = 2.0, block=None
) -> DataFrame:
    """One row, also for a clean log: the verdict, the number of regions and the baseline entropy.

    A log too short for a window is not tampered and has baseline 0.
    """
    rated = _rated(cut(_entropies(events, window, stride, block)), z_threshold)
    regions = F.count_if("_far")
    return rated.agg(
        (regions > 0).alias("tampered"),
        regions.alias("regions"),
        round_half_even(F.coalesce(F.avg("entropy"), F.lit(0.0)), 4).alias("baseline_entropy"),
    )


def tamper_regions(
    events: DataFrame, window: int = 50, stride: int = 10, z_threshold: float = 2.0, block=None
) -> DataFrame:
    """Regions whose entropy is far from the mean, with the baseline they differ from."""
    rated = _rated(cut(_entropies(events, window, stride, block)), z_threshold)
    rows = events.agg(F.count("*")).scalar()
    half = window // 2
    return (
        rated.withColumn("_rows", rows)
        .filter("_far")
        .select(
            F.greatest(F.col("center") - half, F.lit(0)).alias("start_idx"),
            F.least(F.col("center") + half, F.col("_rows")).alias("end_idx"),
            round_half_even(F.col("entropy"), 4).alias("entropy"),
            round_half_even(F.col("z"), 2).alias("z_score"),
            round_half_even(F.col("_stats.mean"), 4).alias("baseline_entropy"),
        )
    )
