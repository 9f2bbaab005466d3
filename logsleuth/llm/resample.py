"""Importance resampling towards a target corpus, ranked by parallel sorting by regular sampling.

Features of a text are its words and pairs of neighbouring words, hashed into buckets. A
bucket's gain is the logarithm of how much more often it occurs in the target than in the
documents; the mean gain of a document, plus noise drawn from its id by a fixed rule, is its
score. Taking the highest scores then draws without replacement in proportion to the weights.

Ranks are exact and come without a window or a total sort: runs are sorted where they lie,
regular samples of every run give splitters, segments between splitters are exchanged and
merged locally, and counts of the segments before give each row its rank. No segment holds
more than about twice its share, whatever the scores: equal scores go by id, and rows that
share the id by the place in their run. Segments wholly behind the draw are not exchanged.

Every text is read twice: for the counts over the whole corpus, and for its own score. A null
or empty text has no features, weight 0 and no words. A row without an id has no noise, so
score and rank are null and it is never drawn. Repeated rows are drawn one by one. With no
rows, or none of enough words, nothing is drawn; an empty target gives gains too.
"""

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from logsleuth.llm.texts import id_and_text, stretches, text_buffer, word_places
from logsleuth.operators.distribute import store

#: Buckets of features, share that is drawn in percent, fewest words, and seed of the noise.
BUCKETS, PERCENT, LEAST_WORDS, SEED = 10_000, 25, 20, 7

#: Segments of the sort at most. The driver sees their square in samples, 16 MB at most.
SEGMENTS = 768

# Fixed value: the reversed polynomial of the checksum.
_POLYNOMIAL = 0xEDB88320

#: Bytes of a word up to which its checksum is continued by table.
_SHORT = 48


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLYNOMIAL), table >> 1)
    return table.astype(np.uint32)


_TABLE = _byte_table()


def _step(register: np.ndarray, byte) -> np.ndarray:
    return _TABLE[(register ^ byte) & 0xFF] ^ (register >> np.uint32(8))


def _zeros_tables() -> np.ndarray:
    """[n][k][v]: register after n zero bytes, from a register with v in its k-th byte.

    A register after some bytes is that after as many zeros, xor what the bytes do to an
    empty one. The tables let a checksum be continued by a word whose effect is known.
    """
    start = np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)
    tables = [start]
    for _ in range(_SHORT):
        tables.append(_step(tables[-1], np.uint32(0)))
    return np.stack(tables)


_ZEROS = _zeros_tables()


def _after_zeros(register: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.zeros(len(register), np.uint32)
    for k in range(4):
        out ^= _ZEROS[n, k, (register >> np.uint32(8 * k)) & 0xFF]
    return out


def checksums(part: np.ndarray, starts: np.ndarray, lengths: np.ndarray, before: int | None = None):
    """crc32 of every word, and of the word before it, a space and the word.

    ``before`` is the checksum of the word before the first one, if there is one; without it
    the first pair has no meaning.
    """
    n = len(starts)
    short = np.minimum(lengths, _SHORT)
    order = np.argsort(-short, kind="stable")
    at, left = starts[order], short[order]
    effect = np.zeros(n, np.uint32)
    for i in range(int(left[0]) if n else 0):
        active = int(np.searchsorted(-left, -i, side="left"))  # words with more than i bytes
        effect[:active] = _step(effect[:active], part[at[:active] + i])
    own = np.empty(n, np.uint32)
    own[order] = effect
    full = np.uint32(0xFFFFFFFF)
    single = _after_zeros(np.full(n, full), short) ^ own ^ full
    long = np.flatnonzero(lengths > _SHORT)
    text = lambda i: part[starts[i] : starts[i] + lengths[i]].tobytes()
    for i in long:
        single[i] = zlib.crc32(text(i))
    earlier = np.empty(n, np.uint32)
    earlier[1:] = single[:-1]
    if n:
        earlier[0] = before or 0
    spaced = _step(earlier ^ full, np.uint32(32))
    double = _after_zeros(spaced, short) ^ own ^ full
    for i in long:
        double[i] = zlib.crc32(text(i), int(spaced[i] ^ full))
    return single, double


def feature_stretches(column: pa.Array, buckets: int) -> Iterator[tuple]:
    """(first document, first word of each document, bucket of each word, bucket of each pair
    or -1 where a word begins a document) of the stretches of a batch of texts."""
    data, offsets = text_buffer(column)
    last = None
    for a, edges, more in stretches(data, offsets):
        part, starts, lengths, first = word_places(data, edges)
        before = last if more else None
        single, double = checksums(part, starts, lengths, before)
        pairs = (double % buckets).astype(np.int64)
        alone = first[:-1][first[:-1] < first[1:]]
        if before is not None and len(alone):
            alone = alone[1:]
        pairs[alone] = -1
        if len(single):
            last = int(single[-1])
        elif not more:
            last = None
        yield a, first, (single % buckets).astype(np.int64), pairs


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket. Tasks send one row a bucket, the driver gets as many."""

    def run(batches):
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, words, pairs in feature_stretches(batch.column("text"), buckets):
                counts += np.bincount(words, minlength=buckets)
                counts += np.bincount(pairs[pairs >= 0], minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some])], ["bucket", "n"])

    rows = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, np.int64)
    for row in rows.collect():
        total[row["bucket"]] = row["n"]
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, of each bucket, rounded down."""
    buckets = len(source)
    all_source, all_target = float(source.sum() + buckets), float(target.sum() + buckets)
    pairs = zip(source.tolist(), target.tolist())
    return np.array(
        [math.floor(1000 * math.log((t + 1.0) * all_source / ((s + 1.0) * all_target))) for s, t in pairs], np.int64
    )


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight (mean gain, rounded down) of every row."""
    buckets = len(gain)

    def run(batches):
        padded = np.append(gain, 0)  # -1: no pair
        for batch in batches:
            n_words = np.zeros(batch.num_rows, np.int64)
            total = np.zeros(batch.num_rows, np.int64)
            for a, first, words, pairs in feature_stretches(batch.column("text"), buckets):
                sums = np.append(0, np.cumsum(padded[words] + padded[pairs]))
                n_words[a : a + len(first) - 1] += np.diff(first)
                total[a : a + len(first) - 1] += np.diff(sums[first])
            n = n_words + np.maximum(n_words - 1, 0)
            values = (n_words, n, total // np.maximum(n, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, values)], ["doc_id", "n_words", "n_features", "weight"]
            )

    return docs.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a draw from Gumbel's law, fixed by seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + 0.5) / F.lit(2.0**32)
    return F.floor(-1000.0 * F.log(-F.log(share))).cast("long")


def _segment(keys: list[np.ndarray], splitters: list[np.ndarray]) -> np.ndarray:
    """Splitters at or below each key, compared from the first column on; a binary search."""
    low = np.zeros(len(keys[0]), np.int64)
    high = np.full(len(keys[0]), len(splitters[0]), np.int64)
    while (open_ := low < high).any():
        at = np.minimum((low + high) // 2, max(len(splitters[0]) - 1, 0))
        below = np.ones(len(at), bool)
        for key, splitter in zip(reversed(keys), reversed(splitters)):
            below = (splitter[at] < key) | ((splitter[at] == key) & below)
        low, high = np.where(open_ & below, at + 1, low), np.where(open_ & ~below, at, high)
    return low


def draw_highest(rows: DataFrame, percent: int, segments: int | None = None) -> DataFrame:
    """``rows`` with the column rank: 1, 2, ... for the highest scores, null for the rest.

    ``rows`` (doc_id and score, both not null, and others) is read several times, so it
    should be stored. The rank goes by score downwards, then id, then place; floor(percent *
    n / 100) rows are drawn.
    """
    spark = rows.sparkSession
    p = min(segments or int(spark.conf.get("spark.sql.shuffle.partitions")), SEGMENTS)
    key = [F.col("score").desc(), F.col("doc_id"), F.col("_at")]
    runs = store(
        rows.coalesce(p).sortWithinPartitions(*key[:2]).withColumn("_at", F.monotonically_increasing_id())
    ).withColumn("_run", F.shiftright("_at", 33))
    sizes = runs.groupBy("_run").agg(F.count("*").alias("_n")).collect()
    n = sum(row["_n"] for row in sizes)
    drawn = percent * n // 100
    sizes = spark.createDataFrame([tuple(row) for row in sizes], "_run long, _n long")
    place = F.col("_at").bitwiseAND((1 << 33) - 1)
    regular = F.floor((place + 1) * p / F.col("_n")) > F.floor(place * p / F.col("_n"))
    sampled = (
        runs.join(F.broadcast(sizes), "_run")
        .filter(regular)
        .select((-F.col("score")).alias("s"), "doc_id", "_at", (F.col("_n") / F.least("_n", F.lit(p))).alias("w"))
        .toPandas()
        .sort_values(["s", "doc_id", "_at"])
    )
    before = np.cumsum(sampled["w"].to_numpy()) - sampled["w"].to_numpy()
    chosen = np.unique(np.searchsorted(before, np.arange(1, p) * (n / p)))
    table = sampled.iloc[chosen[chosen < len(sampled)]]
    splitters = [table[c].to_numpy(np.int64) for c in ("s", "doc_id", "_at")]
    columns = [f.name for f in rows.schema]

    def cut_run(batches):
        for batch in batches:
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("score", "doc_id", "_at")]
            found = _segment([-keys[0], *keys[1:]], splitters)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in (*columns, "_at")), pa.array(found, pa.int32())], [*columns, "_at", "_segment"]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    cut = runs.drop("_run").mapInArrow(cut_run, f"{fields}, _at long, _segment int")
    count = len(splitters[0]) + 1
    held = np.zeros(count, np.int64)
    for row in cut.groupBy("_segment").agg(F.count("*").alias("n")).collect():
        held[row["_segment"]] = row["n"]
    offsets = (np.cumsum(held) - held).tolist()
    last = max((i for i, o in enumerate(offsets) if o < drawn), default=-1)
    # One partition a segment, numbered alike: the position in it is the rank in the segment.
    merged = (
        cut.filter(F.col("_segment") <= last)
        .repartitionById(max(last + 1, 1), F.col("_segment"))
        .sortWithinPartitions(*key)
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    )
    rank = F.element_at(F.lit(offsets), F.col("_segment") + 1) + F.col("_place") + 1
    ranked = merged.withColumn("rank", F.when(rank <= drawn, rank))
    rest = cut.filter(F.col("_segment") > last).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*columns, "rank").unionByName(rest.select(*columns, "rank"))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS, seed: int = SEED, segments: int | None = None,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs``.

    ``docs`` has doc_id and text, ``target`` has text. Rows of at least ``least_words`` words
    with an id take part; the highest ``percent`` of a hundred of them get a rank.
    """
    docs = id_and_text(docs)
    target = id_and_text(target.select(F.lit(None).cast("long").alias("doc_id"), "text"))
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    scored = store(weigh(docs, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    eligible = F.coalesce((F.col("n_words") >= least_words) & F.col("score").isNotNull(), F.lit(False))
    ranked = draw_highest(scored.filter(eligible), percent, segments)
    others = scored.filter(~eligible).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(others).select("doc_id", "n_features", "weight", "score", "rank")
