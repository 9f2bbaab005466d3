"""Near duplicates by consistent weighted sampling over TF-IDF shingles.

Documents are bags of shingles of five words, weighted by term frequency times a damped
inverse document frequency. Improved consistent weighted sampling draws
shingles so that two documents draw the same one with the probability of their weighted
Jaccard similarity. Draws are cut into bands; documents that agree on a band are candidates
and are verified by their exact weighted Jaccard similarity.

* Texts with the same words are one node from the start, so copies cost nothing further.
* In each band bucket every node is compared with one head, not with every other node.
* What is open then is settled exactly: nodes outside a bucket's largest component meet
  all nodes of other components, in blocks that are dealt out over tasks. Blocks return a
  forest of what is linked, never pairs. No bucket is capped, and a head that is unlike the
  others hides no link.

Document frequency is counted exactly, by shingle over all documents. Documents are dealt into
chunks of some MB; a chunk sends its distinct shingles, each once with its count, to parts by
ranges of the hash, and gets the sums back in the same order. No table of shingles is
collected or broadcast, and a shingle of every document reaches its part once a chunk.
"""

import functools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from logsleuth.llm.texts import blocks, id_and_text, mix, shingles, text_buffer, word_hashes
from logsleuth.operators.components import connected_components
from logsleuth.operators.distribute import store

#: Rows of the table of random numbers, and shingles that are drawn from at once.
RANDOM_ROWS, DRAW_ROWS = 1 << 13, 1 << 10

#: Bytes of text in a chunk of documents, and bytes of text for each part of the shingles.
CHUNK_BYTES, PART_BYTES = 4 << 20, 16 << 20


@dataclass(frozen=True)
class Similarity:
    """Words in a shingle, least similarity, and draws: ``bands`` of ``rows`` each.

    With 16 bands of 4 a pair at similarity 0.8 is missed once in 4,700 times.
    """

    words: int = 5
    least: float = 0.8
    bands: int = 16
    rows: int = 4
    #: What inverse document frequency adds to a weight of 1 at most. Copies make the shingles
    #: they share frequent; more of it would pull large groups of near copies apart.
    rarity: float = 0.25
    #: Rounds in which one head of each open bucket is compared.
    heads: int = 1
    seed: int = 42


def packed(counts: np.ndarray) -> bytes:
    """Counts in the narrowest type that holds them, behind the size of that type."""
    size = next(n for n in (1, 2, 4, 8) if int(counts.max(initial=0)) < 1 << 8 * n)
    return bytes([size]) + counts.astype(f"<u{size}").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def planes(keys: np.ndarray) -> bytes:
    """Ascending keys, their first bytes together, then the second: those compress."""
    return keys.astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(8, -1).T.copy().view(">u8")[:, 0].astype(np.uint64)


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Distinct hashes in ascending order. Sorting them is many times faster than the hash
    table that ``np.unique`` builds where nothing else is asked of it."""
    hashes = np.sort(hashes)
    return hashes[np.concatenate((hashes[:1] == hashes[:1], hashes[1:] != hashes[:-1]))]


def word_runs(column):
    """Word hashes of each text of an Arrow column."""
    data, offsets = text_buffer(column)
    for a, b in blocks(offsets):
        (hashes,), first = word_hashes(data, offsets[a : b + 1])
        for low, high in zip(first, first[1:]):
            yield hashes[low:high]


def whole(column) -> pa.Array:
    """A column of a table as one array."""
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def in_chunks(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """``docs`` with the chunk of each row, which depends on the row only, rows and parts."""
    total, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(size // CHUNK_BYTES + 1))
    return docs.withColumn("chunk", chunk), total, size // PART_BYTES + 1


def document_frequency(chunked: DataFrame, parts: int, words: int) -> DataFrame:
    """Documents with each shingle, over all rows: chunk, part and df.

    The df of a chunk's parts, one after the other, are those of its distinct shingles in
    ascending order.
    """

    def count(table: pa.Table) -> pa.Table:
        found = [distinct(shingles(own, words)) for own in word_runs(whole(table.column("text")))]
        keys, n = np.unique(np.concatenate(found), return_counts=True)
        part = (keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        some, first = np.unique(part, return_index=True)
        ranges = list(zip(first, np.append(first[1:], len(keys))))
        return pa.table(
            {
                "chunk": pa.array([table.column("chunk")[0].as_py()] * len(some), pa.int64()),
                "part": pa.array(some.astype(np.int64)),
                "keys": pa.array([planes(keys[a:b]) for a, b in ranges], pa.binary()),
                "n": pa.array([packed(n[a:b]) for a, b in ranges], pa.binary()),
            }
        )

    def add(table: pa.Table) -> pa.Table:
        keys = [from_planes(raw) for raw in table.column("keys").to_pylist()]
        ends = np.cumsum([len(k) for k in keys])[:-1]
        keys, n = np.concatenate(keys), np.concatenate([unpacked(raw) for raw in table.column("n").to_pylist()])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        df = np.empty(len(keys), np.int64)
        df[order] = np.repeat(np.add.reduceat(n[order], first), np.diff(np.append(first, len(keys))))
        own = pa.array([packed(x) for x in np.split(df, ends)], pa.binary())
        return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "df": own})

    counted = chunked.select("chunk", "text").groupBy("chunk").applyInArrow(count, "chunk long, part long, keys binary, n binary")
    return counted.groupBy("part").applyInArrow(add, "chunk long, part long, df binary")


def shingle_idf(counts: np.ndarray, total: int, rarity: float = Similarity.rarity) -> np.ndarray:
    """Damped inverse document frequency of counts, from 1 (in all) to nearly 1 + rarity."""
    span = math.log(max(total, 2) + 1)
    return 1 + rarity * (span - np.log(counts + 1)) / span


def exact_bag(words: np.ndarray, k: int, df: np.ndarray, total: int, rarity: float) -> tuple:
    """Distinct shingles in ascending order, their weights and idf; ``df`` in that order."""
    keys, tf = np.unique(shingles(words, k), return_counts=True)
    idf = shingle_idf(df, total, rarity)
    return keys, tf * idf, idf


def weighted_jaccard(a: tuple, b: tuple) -> float:
    """Sum of smaller over sum of larger weights of two bags."""
    place = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    same = a[0][place] == b[0]
    small = np.minimum(a[1][place[same]], b[1][same]).sum()
    return float(small / (a[1].sum() + b[1].sum() - small))


class Sampler:
    """Draws of improved consistent weighted sampling.

    Each shingle has a row of random numbers (gamma(2, 1) for r and c, uniform for beta)
    by its hash, so all documents see the same numbers for it. Of shingles that share the row
    and the weight the smallest is drawn, in all documents alike.
    """

    def __init__(self, draws: int, seed: int):
        rng = np.random.default_rng(seed)
        size = (RANDOM_ROWS, draws)
        self.r = rng.standard_gamma(2.0, size, dtype=np.float32)
        self.log_c = rng.standard_gamma(2.0, size, dtype=np.float32)
        np.log(self.log_c, out=self.log_c)
        self.beta = rng.random(size, dtype=np.float32)

    def draw(self, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """One 64-bit number for each draw: the shingle drawn and its level.

        Shingles are looked at ``DRAW_ROWS`` at a time, however long the document is.
        """
        draws = np.arange(self.r.shape[1])
        least = np.full(len(draws), np.inf, np.float32)
        drawn, levels = np.zeros(len(draws), np.uint64), np.zeros(len(draws), np.float32)
        for a in range(0, len(keys), DRAW_ROWS):
            own = keys[a : a + DRAW_ROWS]
            row = (own & np.uint64(RANDOM_ROWS - 1)).astype(np.int64)
            r, beta = self.r[row], self.beta[row]
            level = np.floor(np.log(weights[a : a + DRAW_ROWS]).astype(np.float32)[:, None] / r + beta)
            value = self.log_c[row] - r * (level - beta + np.float32(1))
            best = value.argmin(axis=0)
            better = value[best, draws] < least
            least = np.where(better, value[best, draws], least)
            drawn = np.where(better, own[best], drawn)
            levels = np.where(better, level[best, draws], levels)
        with np.errstate(over="ignore"):
            return mix(drawn + levels.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@functools.lru_cache(maxsize=1)
def sampler(draws: int, seed: int) -> Sampler:
    """One sampler for all chunks that a process works on."""
    return Sampler(draws, seed)


def band_keys(draws: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket for each band, which the bands do not share."""
    total = np.arange(1, bands + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for part in draws.reshape(bands, rows).T:
            total = mix(total * np.uint64(0x100000001B3) + part)
    return total.view(np.int64)


def nodes_of(docs: DataFrame, s: Similarity) -> tuple[DataFrame, int]:
    """Ids, node (digest of the words), band buckets and df of the shingles, and the rows.

    Without a word, all but the id is null.
    """
    chunked, total, parts = in_chunks(docs)
    # Stored, so that the shuffles of the counts are gone when the texts are shuffled again.
    counts = store(document_frequency(chunked, parts, s.words))

    def run(own: pa.Table, counts: pa.Table) -> pa.Table:
        words = list(word_runs(whole(own.column("text"))))
        sets = [np.unique(shingles(w, s.words), return_counts=True) for w in words]
        keys = distinct(np.concatenate([some for some, _ in sets])) if words else np.zeros(0, np.uint64)
        turn = np.argsort(whole(counts.column("part")).to_numpy())
        raw = counts.column("df").to_pylist()
        df = np.concatenate([np.zeros(0, np.int64), *(unpacked(raw[i]) for i in turn)])
        if len(df) != len(keys):
            raise RuntimeError("the documents have changed while their shingles were counted")
        nodes, buckets, frequencies = [], [], []
        for w, (some, tf) in zip(words, sets):
            if not len(w):
                nodes.append(None)
                buckets.append(None)
                frequencies.append(None)
                continue
            mine = df[np.searchsorted(keys, some)]
            weights = tf * shingle_idf(mine, total, s.rarity)
            nodes.append(xxhash.xxh3_128_digest(w.tobytes()))
            buckets.append(band_keys(sampler(s.bands * s.rows, s.seed).draw(some, weights), s.bands, s.rows))
            frequencies.append(packed(mine))
        return pa.table(
            {
                "doc_id": own.column("doc_id"),
                "node": pa.array(nodes, pa.binary()),
                "buckets": pa.array(buckets, pa.list_(pa.int64())),
                "df": pa.array(frequencies, pa.binary()),
            }
        )

    both = chunked.groupBy("chunk").cogroup(counts.groupBy("chunk"))
    return both.applyInArrow(run, "doc_id long, node binary, buckets array<long>, df binary"), total


def bags_of(total: int, s: Similarity):
    """Function from Arrow columns of text and df to bags, for use inside tasks."""

    def bags(column, df):
        for words, raw in zip(word_runs(column), df):
            yield exact_bag(words, s.words, unpacked(raw.as_py()), total, s.rarity)

    return bags


def verified(pairs: DataFrame, texts: DataFrame, total: int, s: Similarity) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity is high enough.

    ``texts`` has node, text and df. Texts of b travel to the pairs, then those of a; rows of
    one a lie together, so its bag is made once. A hot a is split by adaptive execution.
    """
    bags = bags_of(total, s)
    least = s.least

    def run(batches):
        last, own = None, None
        for batch in batches:
            keep = []
            heads = batch.column("a").to_pylist()
            others = bags(batch.column("text_b"), batch.column("df_b"))
            for i, other in enumerate(others):
                if heads[i] != last:
                    last, own = heads[i], next(bags(batch.column("text_a").slice(i, 1), batch.column("df_a").slice(i, 1)))
                keep.append(weighted_jaccard(own, other) >= least)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"), F.col("df").alias("df_b"))
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"), F.col("df").alias("df_a"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a")
    return both.select("a", "b", "text_a", "df_a", "text_b", "df_b").mapInArrow(run, "a binary, b binary")


def block_similarity(bags: list[tuple], root: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of the pairs of a block whose roots differ.

    A weight of tf * idf is tf features of weight idf each, so the sum of smaller weights is
    a product of two 0/1 matrices. Features of one root only add nothing, and features with
    the same bags become one column, however long the passage is that made them.
    """
    keys, rows, idf = [], [], []
    for i, (own, weights, rare) in enumerate(bags):
        tf = np.rint(weights / rare).astype(np.int64)
        turn = np.arange(tf.sum()) - np.repeat(np.cumsum(tf) - tf, tf)
        keys.append(np.repeat(own, tf) ^ mix(turn.astype(np.uint64)))
        rows.append(np.full(len(turn), i))
        idf.append(np.repeat(rare, tf))
    keys, rows, idf = np.concatenate(keys), np.concatenate(rows), np.concatenate(idf)
    order = np.argsort(keys, kind="stable")
    keys, rows, idf = keys[order], rows[order], idf[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(first, len(keys)))
    roots = root[rows]
    several = np.minimum.reduceat(roots, first) != np.maximum.reduceat(roots, first)
    some = np.repeat(several, sizes)
    rows, idf, sizes = rows[some], idf[some], sizes[several]
    total = np.array([w.sum() for _, w, _ in bags])
    small = np.zeros((len(bags), len(bags)))
    if len(sizes):
        first = np.cumsum(sizes) - sizes
        mark = np.random.default_rng(1).integers(0, 1 << 63, len(bags), dtype=np.uint64)
        _, at, column = np.unique(np.add.reduceat(mark[rows], first), return_index=True, return_inverse=True)
        weight = np.bincount(column, idf[first])
        starts, lengths = first[at], sizes[at]
        for low in range(0, len(weight), 4096):
            n = lengths[low : low + 4096]
            place = np.repeat(starts[low : low + 4096], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            x = np.zeros((len(bags), len(n)))
            x[rows[place], np.repeat(np.arange(len(n)), n)] = 1
            small += (x * weight[low : low + 4096]) @ x.T
    return small / (total[:, None] + total[None, :] - small)


def settled(remaining: DataFrame, roots: DataFrame, texts: DataFrame, total: int, s: Similarity, first: bool, block: int = 256) -> DataFrame:
    """Links (a, b) inside the buckets of ``remaining`` that span several components.

    Of each bucket the nodes of its largest component (main) need not meet each other.
    Main and other nodes are dealt into blocks; a task gets two blocks at most. With
    ``first``, other nodes come only to the one of their buckets with the largest main
    component: most of them join it there, and need not be brought to all their buckets.
    """
    state = remaining.join(roots, "node")
    sizes = state.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    per_bucket = (
        sizes.groupBy("bucket")
        .agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n"))
        .filter("n > n_main")
    )
    is_main = F.col("root") == F.col("main")
    members = state.join(per_bucket.select("bucket", "main", "n_main"), "bucket")
    if first:
        others = members.filter(~is_main).groupBy("node").agg(F.max(F.struct("n_main", "bucket")).alias("best"))
        others = others.select("node", F.col("best.bucket").alias("bucket"))
        members = members.filter(is_main).unionByName(members.filter(~is_main).join(others, ["node", "bucket"], "left_semi"))
    members = store(members)
    n_other = F.count(F.when(~is_main, 1))
    counts = members.groupBy("bucket").agg(
        F.ceil(F.count(F.when(is_main, 1)) / block).cast("int").alias("m"), F.ceil(n_other / block).cast("int").alias("r")
    )
    deal = F.xxhash64("node", "bucket")
    dealt = (
        members.join(counts.filter("r > 0"), "bucket")
        .withColumn("own", F.when(is_main, F.pmod(deal, "m")).otherwise(F.col("m") + F.pmod(deal, "r")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.when(is_main, F.col("m")).otherwise(F.lit(0)), F.col("m") + F.col("r") - 1)))
        .select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "node", "root")
        .join(texts, "node")
    )
    bags = bags_of(total, s)
    least = s.least

    def compare(table: pa.Table) -> pa.Table:
        nodes, own_roots = table.column("node").to_pylist(), table.column("root").to_pylist()
        number = {r: i for i, r in enumerate(sorted(set(own_roots)))}
        root = np.array([number[r] for r in own_roots])
        near = np.zeros((len(nodes), len(nodes)), bool)
        if len(number) > 1:
            near = block_similarity(list(bags(whole(table.column("text")), table.column("df"))), root) >= least
            near &= root[:, None] != root[None, :]
        mark = np.arange(len(nodes))
        while True:
            nearest = np.where(near, mark[None, :], len(nodes)).min(axis=1)
            following = np.minimum(mark, nearest)
            following = following[following]
            if (following == mark).all():
                break
            mark = following
        some = np.flatnonzero(mark != np.arange(len(nodes)))
        return pa.table({"a": pa.array([nodes[mark[i]] for i in some], pa.binary()), "b": pa.array([nodes[i] for i in some], pa.binary())})

    return dealt.groupBy("bucket", "lo", "hi").applyInArrow(compare, "a binary, b binary")


def star_round(remaining: DataFrame, roots: DataFrame, turn: int):
    """Pairs of each open bucket's head with nodes of other components, and who remains.

    The head of a round leaves the bucket: it has met all that it needed to meet.
    """
    state = remaining.join(roots, "node")
    order = F.struct(F.xxhash64("node", F.lit(turn)), "node", "root")
    heads = (
        state.groupBy("bucket")
        .agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.min(order).alias("head"))
        .filter("r0 != r1")
        .select("bucket", F.col("head.node").alias("a"), F.col("head.root").alias("ra"))
    )
    left = store(state.join(heads, "bucket"))
    pairs = left.filter("root != ra").select("a", F.col("node").alias("b")).distinct()
    return pairs, left.filter("node != a").select("bucket", "node")


def near_duplicates(docs: DataFrame, s: Similarity = Similarity()) -> DataFrame:
    """Classes of near-duplicate documents.

    Returns doc_id, class_id (smallest doc_id of the class) and kept (it is that one) for
    every row of ``docs`` (doc_id, text). A text with fewer words than a shingle is one
    shingle; null texts and texts without a word are like nothing else and stay. Equal texts
    are always one class. Rows with one doc_id are judged by their own texts. Rows with a null
    doc_id have no class and stay.
    """
    docs = id_and_text(docs)
    rows, total = nodes_of(docs, s)
    rows = store(rows)
    found = rows.filter("node is not null and doc_id is not null")
    # All rows of a node have the same buckets: the least array is any of them.
    nodes = store(found.groupBy("node").agg(F.first("buckets").alias("buckets")))
    placed = nodes.select("node", F.explode("buckets").alias("bucket"))
    several = placed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    remaining = store(placed.join(several, "bucket"))
    involved = store(remaining.select("node").distinct())
    texts = store(node_texts(docs, found, involved))
    roots = involved.withColumn("root", F.col("node"))
    tried = None
    for turn in range(s.heads):
        pairs, remaining = star_round(remaining, roots, turn)
        pairs = store(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            continue
        tried = pairs if tried is None else tried.unionByName(pairs)
        roots = joined(verified(pairs, texts, total, s), involved, roots, fresh=turn == 0)
    for first in (True, False):
        roots = joined(settled(remaining, roots, texts, total, s, first), involved, roots)
    return classes(rows.select("doc_id", "node"), roots)


def joined(more: DataFrame, involved: DataFrame, roots: DataFrame, fresh: bool = False) -> DataFrame:
    """Components with the links ``more``; ``fresh`` if every node is its own so far."""
    more = store(more)
    if more.isEmpty():
        return roots
    vertices = involved.select(F.col("node").alias("v"))
    start = None if fresh else roots.withColumnRenamed("node", "v")
    return connected_components(vertices, more, start).withColumnRenamed("v", "node")


def node_texts(docs: DataFrame, found: DataFrame, involved: DataFrame) -> DataFrame:
    """One text and its df for each of the ``involved`` nodes, from the smallest document that has it."""
    own = found.join(involved, "node", "left_semi").groupBy("node")
    first = own.agg(F.min("doc_id").alias("doc_id"), F.first("df").alias("df"))

    def run(batches):
        # Rows may share an id: only the text that makes the node is its text.
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            own = []
            for a, b in blocks(offsets):
                (hashes,), first = word_hashes(data, offsets[a : b + 1])
                own += [xxhash.xxh3_128_digest(hashes[x:y].tobytes()) for x, y in zip(first, first[1:])]
            same = [x == y for x, y in zip(own, batch.column("node").to_pylist())]
            yield batch.filter(pa.array(same, pa.bool_()))

    rows = docs.join(first.hint("shuffle_hash"), "doc_id").select("node", "text", "df")
    return rows.mapInArrow(run, "node binary, text string, df binary").dropDuplicates(["node"])


def classes(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Class of each row from the components of nodes; a node without links is its own."""
    named = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    out = named.join(smallest, "root", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id"))
    return out.select("doc_id", own.alias("class_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))
