"""Reversible line dedup: sharded cuckoo filters backed by exact reference counts.

The index holds, for every line key, the documents that have it (postings) and their number
and largest id (references). Keys held by enough documents to be dropped stand in cuckoo
filters, one for each shard of keys. Documents can be put in and taken out: counts of the
keys they touch are taken again from the postings, and keys that come to or fall below the
limit enter or leave their shard's filter. When repeated keys outgrow the shards, the filters
are made anew from the references with at least twice as many. A filter answers "surely not
repeated" for nearly all lines; what it lets through is settled by the exact references.

A change writes what it touches: its own postings, the counts of their keys and the filters of
their shards. Later versions stand before earlier ones when the index is read, and after
``COMPACT`` changes the tables are written whole.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from logsleuth.llm.texts import id_and_text, small_batches
from logsleuth.operators.distribute import store

MIN_CHARS, MIN_DOCS = 20, 3

#: Keys meant for a shard, bytes of its filter, and bytes of all filters that may be
#: broadcast. Beyond that postings and filters meet by shard, ``GROUP_ROWS`` postings at a time.
SHARD_KEYS, SHARD_BYTES, BROADCAST_BYTES = 16_384, 64 << 10, 64 << 20
GROUP_ROWS = 1_000_000

#: Changes after which the tables of an index are written whole.
COMPACT = 8

#: Stands for a null id while documents are counted: one document below all others.
NO_ID = -(1 << 63)

POSTINGS = "key binary, doc_id long"
REFERENCES = "key binary, n_docs long, keeper long"
FILTERS = "shard long, filter binary"


def line_key(line: bytes) -> bytes | None:
    """128-bit digest of a line without outer white space, A-Z lower-cased; None if short."""
    line = line.strip(b" \t\n\x0b\x0c\r")
    if len(line) < MIN_CHARS:
        return None
    if not line.isascii() and len(line) < 4 * MIN_CHARS and len(line.decode()) < MIN_CHARS:
        return None
    return xxhash.xxh3_128_digest(line.lower())


class Cuckoo:
    """Cuckoo filter: buckets of four 16-bit fingerprints, each key in one of two buckets."""

    SLOTS, KICKS = 4, 500

    def __init__(self, keys: int = 0, raw: bytes | None = None):
        if raw is None:
            size = 1 << max(2, int(np.ceil(np.log2(max(keys, 1) / 3))))
            self.table = np.zeros((size, self.SLOTS), np.uint16)
        else:
            self.table = np.frombuffer(raw, np.uint16).reshape(-1, self.SLOTS).copy()

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _places(self, keys: np.ndarray):
        """Fingerprints and both buckets of digests given as rows of two 64-bit numbers."""
        mask = np.uint64(len(self.table) - 1)
        prints = (keys[:, 0] & np.uint64(0xFFFF)).astype(np.uint16)
        prints[prints == 0] = 1
        first = (keys[:, 0] >> np.uint64(16)) & mask
        return prints, first, first ^ self._step(prints, mask)

    @staticmethod
    def _step(prints, mask):
        with np.errstate(over="ignore"):
            return (prints.astype(np.uint64) * np.uint64(0x5BD1E995C6A4A793) >> np.uint64(20)) & mask

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, first, second = self._places(keys)
        found = (self.table[first] == prints[:, None]).any(axis=1)
        return found | (self.table[second] == prints[:, None]).any(axis=1)

    def _insert_one(self, fingerprint: int, bucket: int, turn: int) -> bool:
        mask = np.uint64(len(self.table) - 1)
        for kick in range(self.KICKS):
            row = self.table[bucket]
            free = np.flatnonzero(row == 0)
            if len(free):
                row[free[0]] = fingerprint
                return True
            slot = (turn + kick) % self.SLOTS
            fingerprint, row[slot] = int(row[slot]), fingerprint
            bucket ^= int(self._step(np.array([fingerprint], np.uint16), mask)[0])
        return False

    def insert(self, keys: np.ndarray) -> bool:
        """Puts keys in, each of them new. False: no room, a larger filter must be built."""
        for turn, (p, a, b) in enumerate(zip(*(x.tolist() for x in self._places(keys)))):
            roomy = (self.table[a] == 0).any()
            if not self._insert_one(p, a if roomy else b, turn):
                return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        """Takes keys out that were put in before."""
        for p, a, b in zip(*(x.tolist() for x in self._places(keys))):
            for bucket in (a, b):
                found = np.flatnonzero(self.table[bucket] == p)
                if len(found):
                    self.table[bucket, found[0]] = 0
                    break


def as_numbers(keys: pa.Array | list) -> np.ndarray:
    """Digests as rows of two unsigned 64-bit numbers."""
    keys = keys if isinstance(keys, list) else keys.to_pylist()
    return np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)


def shard_of(numbers: np.ndarray, shards: int) -> np.ndarray:
    return (numbers[:, 1] % np.uint64(shards)).astype(np.int64)


def line_keys(docs: DataFrame) -> DataFrame:
    """Distinct (key, doc_id) of the lines of each row; null texts have one empty line."""

    def run(batches):
        for batch in batches:
            keys, rows = [], []
            for i, text in enumerate(batch.column("text")):
                raw = text.as_buffer() if text.is_valid else None
                if raw is None or raw.size < MIN_CHARS:
                    continue
                own = {line_key(x) for x in raw.to_pybytes().split(b"\n")} - {None}
                keys += own
                rows += [i] * len(own)
            ids = batch.column("doc_id").take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), ids], ["key", "doc_id"])

    ids = F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("doc_id")
    return id_and_text(docs).select(ids, "text").mapInArrow(run, POSTINGS)


@dataclass(frozen=True)
class LineIndex:
    """State of the index: stored tables of the checkpoint folder, seen through later changes."""

    postings: DataFrame
    references: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int
    changes: int = 0

    @staticmethod
    def empty(spark: SparkSession, min_docs: int = MIN_DOCS, shards: int = 1) -> "LineIndex":
        tables = (spark.createDataFrame([], s) for s in (POSTINGS, REFERENCES, FILTERS))
        return LineIndex(*tables, shards, min_docs)

    @staticmethod
    def build(docs: DataFrame, min_docs: int = MIN_DOCS) -> "LineIndex":
        """An index of all ``docs``, sharded by the number of keys that repeat."""
        postings = store(line_keys(docs).distinct())
        references = store(count_references(postings))
        repeated = references.filter(F.col("n_docs") >= min_docs).select("key")
        shards = max(1, shards_for(repeated))
        return LineIndex(postings, references, store(new_filters(repeated, shards)), shards, min_docs)

    def insert(self, docs: DataFrame) -> "LineIndex":
        """With the lines of ``docs`` too. Ids that are in the index get more lines."""
        added = store(line_keys(docs).distinct().join(self.postings, ["key", "doc_id"], "left_anti"))
        return self._changed(self.postings.unionByName(added), added)

    def delete(self, doc_ids: DataFrame) -> "LineIndex":
        """Without the documents of the column doc_id; unknown ids change nothing."""
        ids = doc_ids.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id")).distinct()
        gone = store(self.postings.join(ids, "doc_id", "left_semi").select("key", "doc_id"))
        return self._changed(self.postings.join(gone, ["key", "doc_id"], "left_anti"), gone)

    def _changed(self, postings: DataFrame, touched: DataFrame) -> "LineIndex":
        keys = store(touched.select("key").distinct())
        fresh = store(count_references(postings.join(keys, "key", "left_semi")))
        before = self.references.join(keys, "key", "left_semi").select("key", F.col("n_docs").alias("was"))
        high = lambda c: F.coalesce(F.col(c), F.lit(0)) >= self.min_docs
        moved = store(
            fresh.select("key", "n_docs")
            .join(before, "key", "full")
            .filter(high("n_docs") != high("was"))
            .select("key", high("n_docs").alias("enters"))
        )
        references = self.references.join(keys, "key", "left_anti").unionByName(fresh)
        repeated = references.filter(F.col("n_docs") >= self.min_docs).select("key")
        shards = shards_for(repeated)
        if shards > self.shards:
            shards = max(shards, 2 * self.shards)
            filters = store(new_filters(repeated, shards))
        else:
            shards = self.shards
            own = store(with_shard(moved, shards).select("shard").distinct())
            turned = store(turn_filters(self.filters.join(own, "shard", "left_semi"), moved, shards))
            filters = self.filters.join(own, "shard", "left_anti").unionByName(turned)
        tables, changes = (postings, references, filters), self.changes + 1
        if changes >= COMPACT:
            tables, changes = tuple(store(table) for table in tables), 0
        return LineIndex(*tables, shards, self.min_docs, changes)

    def droppable(self) -> DataFrame:
        """Exact (key, doc_id) of lines that go: repeated, and not in the keeper."""
        if self.shards * SHARD_BYTES <= BROADCAST_BYTES:
            known = {r["shard"]: bytes(r["filter"]) for r in self.filters.collect()}
            rows = passing(self.postings, known, self.shards)
        else:
            rows = passing_by_shard(self.postings, self.filters, self.shards)
        repeated = self.references.filter(F.col("n_docs") >= self.min_docs)
        return rows.join(repeated, "key").filter("doc_id != keeper").select("key", "doc_id")


def count_references(postings: DataFrame) -> DataFrame:
    """Documents of each key and the largest of them; combined before the shuffle."""
    return postings.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))


def shards_for(repeated: DataFrame) -> int:
    """Shards that the keys fill."""
    return -(-repeated.count() // SHARD_KEYS)


def new_filters(repeated: DataFrame, shards: int) -> DataFrame:
    """Filters that hold exactly the keys of ``repeated``."""
    none = repeated.sparkSession.createDataFrame([], FILTERS)
    return turn_filters(none, repeated.withColumn("enters", F.lit(True)), shards)


def turn_filters(filters: DataFrame, moved: DataFrame, shards: int) -> DataFrame:
    """Filters after keys have come in (``enters``) or gone out. One task holds one shard."""

    def turn(key, old: pa.Table, changes: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        enters = np.array(changes.column("enters").to_pylist(), bool)
        keys = as_numbers(changes.column("key").to_pylist()) if len(changes) else np.zeros((0, 2), np.uint64)
        raw = old.column("filter")[0].as_py() if len(old) else None
        cuckoo = Cuckoo(raw=raw) if raw is not None else Cuckoo(SHARD_KEYS)
        cuckoo.delete(keys[~enters])
        if not cuckoo.insert(keys[enters]):
            raise RuntimeError("a shard of the line index is full: build it anew")
        return pa.table({"shard": pa.array([shard], pa.int64()), "filter": pa.array([cuckoo.to_bytes()], pa.binary())})

    changes = with_shard(moved.select("key", "enters"), shards)
    return filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(turn, FILTERS)


def with_shard(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` (key and others) with the shard of the key."""

    def number(batches):
        for batch in batches:
            shard = shard_of(as_numbers(batch.column("key")), shards) if len(batch) else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard, pa.int64())], [*batch.schema.names, "shard"])

    return rows.mapInArrow(number, T.StructType([*rows.schema.fields]).add("shard", "long"))


def passing_by_shard(postings: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """As ``passing``, for filters too large to be sent everywhere.

    Postings go to the filter of their shard. A shard with very many postings (a line of a
    third of all documents) is dealt over several copies of its filter.
    """
    numbered = with_shard(postings, shards)
    sizes = numbered.groupBy("shard").agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias("copies"))
    sizes = store(sizes)
    dealt = numbered.join(sizes, "shard").withColumn("copy", F.pmod(F.hash("doc_id"), F.col("copies")))
    copies = filters.join(sizes, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))

    def run(own: pa.Table, known: pa.Table) -> pa.Table:
        if not len(known) or not len(own):
            return own.slice(0, 0)
        cuckoo = Cuckoo(raw=known.column("filter")[0].as_py())
        return own.filter(pa.array(cuckoo.contains(as_numbers(own.column("key").to_pylist()))))

    groups = dealt.select("key", "doc_id", "shard", "copy").groupBy("shard", "copy")
    found = groups.cogroup(copies.select("filter", "shard", "copy").groupBy("shard", "copy"))
    return found.applyInArrow(lambda a, b: run(a, b).select(["key", "doc_id"]), postings.schema)


def unused(name: str, columns: list[str]) -> str:
    """A column name like ``name`` that is not in ``columns``, in whatever case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def passing(postings: DataFrame, known: dict, shards: int) -> DataFrame:
    """Postings whose keys are in the filter of their shard."""

    def run(batches):
        filters = {s: Cuckoo(raw=raw) for s, raw in known.items()}
        for batch in batches:
            numbers = as_numbers(batch.column("key"))
            shard = shard_of(numbers, shards)
            keep = np.zeros(len(batch), bool)
            for s in np.unique(shard):
                if s in filters:
                    own = np.flatnonzero(shard == s)
                    keep[own] = filters[s].contains(numbers[own])
            yield batch.filter(pa.array(keep))

    return postings.mapInArrow(run, postings.schema)


def drop_lines(docs: DataFrame, index: LineIndex) -> DataFrame:
    """``docs`` with the lines taken out of ``text`` that the index drops from them.

    All columns stay and n_lines (before) and n_dropped are added, in place of columns of
    these names. A null text counts as one empty line and becomes an empty text. Rows with
    the same id are one document: all of them lose the line, or, as the largest id, none.
    """
    gone_keys, gone_doc = unused("_drops", docs.columns), unused("_doc", docs.columns)
    drops = index.droppable().groupBy(F.col("doc_id").alias(gone_doc)).agg(F.collect_set("key").alias(gone_keys))
    drops = drops.hint("shuffle_hash")
    passing_on = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    schema = T.StructType([docs.schema[c] for c in passing_on])
    schema["text"].nullable = True
    schema = schema.add("n_lines", "long").add("n_dropped", "long")

    def run(batches):
        for batch in batches:
            texts, total, dropped = [], [], []
            for text, gone in zip(batch.column("text"), batch.column(gone_keys)):
                lines = (text.as_buffer().to_pybytes() if text.is_valid else b"").split(b"\n")
                kept = lines
                if gone.is_valid:
                    keys = set(gone.as_py())
                    kept = [x for x in lines if line_key(x) not in keys]
                total.append(len(lines))
                dropped.append(len(lines) - len(kept))
                texts.append(b"\n".join(kept))
            new = {"text": pa.array(texts, pa.binary()).cast(pa.string()), "n_lines": pa.array(total), "n_dropped": pa.array(dropped)}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in schema.names], schema.names)

    same = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)) == F.col(gone_doc)
    joined = docs.select(*passing_on).join(drops, same, "left").drop(gone_doc)
    small_batches(docs.sparkSession)
    return joined.mapInArrow(run, schema)
