"""Whole texts as Arrow buffers: blocks of documents, words, hashes and counts by bucket."""

import contextlib
import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

# Bytes of text looked at together. A longer text is a block of its own.
BLOCK_BYTES = 1 << 18


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of texts that go to a Python worker at once: some MB at a few kB each.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of the session, which are made for rows of numbers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def id_and_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns that operators on texts need, so others cannot clash."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))


# Fixed value: the number of the allocator's setting for blocks that are mapped on their own.
M_MMAP_THRESHOLD = -3


@functools.cache
def lean_memory() -> None:
    """Let this worker give freed memory back, which it would keep as long as it lives.

    Workers are used again by all later steps: what a step has needed once would be missing to
    the others. Blocks of four megabytes and more are mapped on their own, so freeing returns
    them; smaller ones are used again, which is faster.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such setting
        ctypes.CDLL(None).mallopt(M_MMAP_THRESHOLD, 4 << 20)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    lean_memory()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive documents of about ``limit`` bytes, one document at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


# Character classes by byte: letters and digits (and every byte of a character beyond
# ASCII) make up words, A-Z count as a-z.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_IN_WORD = np.zeros(256, bool)
for _low, _high in ((48, 57), (65, 90), (97, 122), (128, 255)):
    _IN_WORD[_low : _high + 1] = True

_POWER_STEP = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, _POWER_STEP | np.uint64(1), np.uint64))


_POWERS = _powers(4096)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash: spreads every input bit over the output."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, prefixes: tuple = ()
) -> tuple[list[np.ndarray], np.ndarray]:
    """64-bit hashes of all words of a block, and the words before each document.

    Returns [hashes in text order, then those of the first p bytes of each word for every p
    of ``prefixes``], and an array of len(offsets) with the number of the first word of each
    document (its last entry is the number of words). A word of at most p bytes is its own
    prefix. Memory is some 40 bytes for each byte of the block.
    """
    base, top = int(offsets[0]), int(offsets[-1])
    part = data[base:top]
    edges = np.asarray(offsets - base, np.int64)
    inside = _IN_WORD[part]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    bounds = edges[:-1][edges[:-1] < len(part)]
    opens[bounds] = inside[bounds]
    starts = np.flatnonzero(opens)
    if not len(starts):
        return [np.zeros(0, np.uint64)] * (1 + len(prefixes)), np.zeros(len(offsets), np.int64)
    letters = np.flatnonzero(inside)
    first = np.searchsorted(letters, starts)
    lengths = np.diff(np.append(first, len(letters)))
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    longest = int(lengths.max())
    powers = _POWERS if longest <= len(_POWERS) else _powers(longest)
    with np.errstate(over="ignore"):
        values = (_FOLD[part[letters]].astype(np.uint64) + np.uint64(1)) * powers[place]
        sums = [np.add.reduceat(values, first)]
        for p in sorted(prefixes, reverse=True):
            values[place >= p] = 0
            sums.insert(1, np.add.reduceat(values, first))
    return [mix(x) for x in sums], np.searchsorted(starts, edges).astype(np.int64)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; of the whole text if it has fewer words."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            total = total * np.uint64(0x100000001B3) + words[i : i + n]
    return mix(total)


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a block with A-Z as a-z, start and length of its words in them, and the
    number of the first word of each document (len(offsets) entries)."""
    base, top = int(offsets[0]), int(offsets[-1])
    part = _FOLD[data[base:top]]
    edges = np.asarray(offsets - base, np.int64)
    inside = _IN_WORD[part]
    opens, shuts = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    shuts[:-1] &= ~inside[1:]
    inner = edges[1:-1][(edges[1:-1] > 0) & (edges[1:-1] < len(part))]
    opens[inner], shuts[inner - 1] = inside[inner], inside[inner - 1]
    starts = np.flatnonzero(opens)
    return part, starts, np.flatnonzero(shuts) + 1 - starts, np.searchsorted(starts, edges)


def stretches(data: np.ndarray, offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, bool]]:
    """Blocks as (first document, offsets, whether it goes on the document before).

    As ``blocks``, but a text longer than ``limit`` comes in several stretches, cut between
    words, so that memory does not grow with it. Only one word is never cut.
    """
    for a, b in blocks(offsets, limit):
        low, high, more = int(offsets[a]), int(offsets[b]), False
        while b == a + 1 and high - low > limit:
            at = low + limit
            while at < high and (inside := _IN_WORD[data[at : at + limit]]).all():
                at += len(inside)
            if at < high:
                at += int(np.argmin(inside))
            if at >= high:
                break
            yield a, np.array([low, at], np.int64), more
            low, more = at, True
        yield a, np.append(low, offsets[a + 1 : b + 1]), more
