"""Near-duplicate embeddings by a forest of random-projection trees with spill.

Every tree splits the vectors of a label again and again at the median of a random
projection. Vectors near the median go to both sides, so a close pair is rarely parted, and
several trees make it rarer still. Vectors that share a leaf are compared exactly; a pair
that meets in several leaves counts in one of them. Links are united to components.

Trees grow level by level as aggregations: all open leaves of all trees get their median
at once, nothing is fitted on a sample and the depth follows the data. Equal vectors are
one node. A leaf whose vectors lie so close together that splitting would send most of them
to both sides is compared as it is, in blocks that are dealt out over tasks.
"""

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from logsleuth.operators.components import connected_components
from logsleuth.operators.distribute import store


@dataclass(frozen=True)
class Forest:
    """Least cosine, number of trees, rows of a leaf and of a block, and spill.

    ``spill`` is the distance from the median within which vectors go to both sides, in
    deviations of the projected difference of two vectors at the least cosine.
    """

    least: float = 0.93
    trees: int = 4
    leaf: int = 256
    spill: float = 0.75
    seed: int = 42
    #: Levels whose projections are made together.
    levels: int = 10

    def margin(self) -> float:
        """Spill for projections that are scaled to unit variance of a unit vector."""
        return self.spill * math.sqrt(2 - 2 * self.least)


def directions(dim: int, level: int, f: Forest) -> np.ndarray:
    """Random directions of all trees for ``levels`` levels from ``level`` on."""
    parts = [
        np.random.default_rng([f.seed, dim, t, x]).normal(size=dim)
        for t in range(f.trees)
        for x in range(level, level + f.levels)
    ]
    made = np.array(parts).T
    return made / np.linalg.norm(made, axis=0) * math.sqrt(dim)


def valid_vectors(table: DataFrame) -> DataFrame:
    """Rows that can link: id and label not null, a finite vector that is not zero.

    Returns vec_id, node (digest of label and vector) and vec (float32 as binary, so that
    it travels as it is).
    """

    def run(batches):
        for batch in batches:
            keep, nodes, vecs = [], [], []
            labels = batch.column("label").to_pylist()
            for i, value in enumerate(batch.column("vec")):
                x = value.values
                if x is None or x.null_count or not len(x):
                    continue
                x = x.to_numpy(zero_copy_only=False).astype("<f8")
                if not np.isfinite(x).all() or not x.any():
                    continue
                x = x + 0.0  # one zero
                keep.append(i)
                vecs.append(x.tobytes())
                nodes.append(xxhash.xxh3_128_digest(f"{labels[i]}|".encode() + vecs[-1]))
            rows = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [rows.column("vec_id"), rows.column("label"), pa.array(nodes, pa.binary()), pa.array(vecs, pa.binary())],
                ["vec_id", "label", "node", "vec"],
            )

    rows = table.filter("vec_id is not null and label is not null and vec is not null")
    return rows.mapInArrow(run, "vec_id long, label string, node binary, vec binary")


def projected(rows: DataFrame, level: int, f: Forest, first: bool) -> DataFrame:
    """Rows with p, the projections of the next levels of their tree; ``first``: of all trees."""

    def run(batches):
        made: dict = {}
        for batch in batches:
            out, trees, which = [], [], []
            own = None if first else batch.column("tree").to_pylist()
            for i, raw in enumerate(batch.column("vec").to_pylist()):
                x = np.frombuffer(raw, "<f8")
                if len(x) not in made:
                    made[len(x)] = directions(len(x), level, f)
                p = ((x / np.linalg.norm(x)) @ made[len(x)]).astype(np.float32).reshape(f.trees, -1)
                for t in range(f.trees) if first else [own[i]]:
                    out.append(p[t])
                    trees.append(t)
                    which.append(i)
            kept = batch.take(pa.array(which, pa.int64()))
            path = pa.array(np.ones(len(which), np.int64)) if first else kept.column("path")
            yield pa.RecordBatch.from_arrays(
                [kept.column("node"), kept.column("space"), pa.array(trees, pa.int32()), path, pa.array(out, pa.list_(pa.float32()))],
                ["node", "space", "tree", "path", "p"],
            )

    return rows.mapInArrow(run, "node binary, space string, tree int, path long, p array<float>")


def grow(nodes: DataFrame, f: Forest) -> DataFrame:
    """Leaves of the forest: node, space, tree, path, n (rows of the leaf).

    ``nodes`` has node, space (label and dimension: only vectors of one space meet) and vec.
    """
    keys = ["space", "tree", "path"]
    done = None
    level = 0
    open_rows = store(projected(nodes.select("node", "space", "vec"), 0, f, True))
    while True:
        at = level % f.levels
        if at == 0 and level:
            with_vec = open_rows.drop("p").join(nodes.select("node", "vec"), "node")
            open_rows = store(projected(with_vec, level, f, False))
        p = F.get(F.col("p"), F.lit(at))
        leaves = open_rows.groupBy(*keys).agg(
            F.count("*").alias("n"), F.percentile_approx(p, [0.25, 0.5, 0.75], 1000).alias("q")
        )
        # Most of a leaf within the spill: its vectors are too close to be told apart.
        close = (F.col("n") <= f.leaf) | (F.get("q", F.lit(2)) - F.get("q", F.lit(0)) < 2 * f.margin())
        leaves = leaves.withColumn("closed", close | F.lit(level >= 60))
        state = store(open_rows.join(leaves, keys))
        closed = state.filter("closed").select("node", *keys, "n")
        done = closed if done is None else done.unionByName(closed)
        split = state.filter("not closed")
        if split.isEmpty():
            return done
        middle = F.get("q", F.lit(1))
        sides = F.array_compact(
            F.array(
                F.when(p <= middle + f.margin(), F.col("path") * 2),
                F.when(p >= middle - f.margin(), F.col("path") * 2 + 1),
            )
        )
        open_rows = split.select("node", "space", "tree", F.explode(sides).alias("path"), "p")
        level += 1


def leaf_links(members: DataFrame, f: Forest) -> DataFrame:
    """Links found in leaves: node, links (vectors it links with) and root.

    ``members`` has node, vec, copies, leaf, leaves (all leaves of the node), n. Roots are
    the smallest node reachable inside the block, so at most one edge leaves each member.
    """
    block = f.leaf
    parts = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("node", "leaf"), parts).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = (
        members.withColumn("parts", parts)
        .withColumn("own", own)
        .withColumn("other", every)
        .withColumn("lo", F.least("own", "other"))
        .withColumn("hi", F.greatest("own", "other"))
        .select("leaf", "lo", "hi", "own", "node", "vec", "copies", "leaves")
    )
    least = f.least

    def compare(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_pylist()
        x = np.array([np.frombuffer(v, "<f8") for v in table.column("vec").to_pylist()])
        x /= np.linalg.norm(x, axis=1)[:, None]
        near = x @ x.T >= least
        np.fill_diagonal(near, False)
        part = table.column("own").to_numpy()
        if table.column("lo")[0].as_py() != table.column("hi")[0].as_py():
            near &= part[:, None] != part[None, :]
        # A pair counts in the smallest of the leaves that it shares.
        here = table.column("leaf")[0].as_py()
        earlier = [[y for y in own if y < here] for own in table.column("leaves").to_pylist()]
        number = {y: i for i, y in enumerate(sorted({y for own in earlier for y in own}))}
        if number and near.any():
            met = np.zeros((len(nodes), len(number)), np.float32)
            for i, own in enumerate(earlier):
                met[i, [number[y] for y in own]] = 1
            near &= (met @ met.T) == 0
        links = near @ table.column("copies").to_numpy().astype(np.int64)
        order = np.argsort(np.array(nodes, object))
        rank = np.empty(len(nodes), np.int64)
        rank[order] = np.arange(len(nodes))
        root = rank
        while True:
            nearest = np.where(near, root[None, :], len(nodes)).min(axis=1, initial=len(nodes))
            following = np.minimum(root, nearest)
            following = np.minimum(following, following[order[following]])
            if (following == root).all():
                break
            root = following
        some = np.flatnonzero(links)
        return pa.table(
            {
                "node": pa.array([nodes[i] for i in some], pa.binary()),
                "links": pa.array(links[some]),
                "root": pa.array([nodes[order[root[i]]] for i in some], pa.binary()),
            }
        )

    return dealt.groupBy("leaf", "lo", "hi").applyInArrow(compare, "node binary, links long, root binary")


def embedding_links(
    table: DataFrame, f: Forest = Forest(), vec_id: str = "vec_id", vec: str = "embedding", label: str = "label"
) -> DataFrame:
    """Links and components of all vectors of a table.

    Returns vec_id, n_links (other rows linked with it), component_id (smallest vec_id that
    links lead to) and kept for every row. Rows link when labels are equal, vectors equally long
    and their cosine in double precision is at least ``f.least``. Null ids, null labels and vectors
    that are null, empty, zero or hold null or non-finite components link with nothing; a
    row without id has component null and is kept. Repeated rows are copies of each other.
    """
    rows = table.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("vec"),
        F.col(label).cast("string").alias("label"),
    )
    valid = store(valid_vectors(rows))
    space = F.concat_ws("|", F.octet_length("vec").cast("string"), "label")
    nodes = store(
        valid.groupBy("node", space.alias("space")).agg(
            F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("vec").alias("vec")
        )
    )
    leaves = store(grow(nodes, f).withColumn("leaf", F.xxhash64("space", "tree", "path")))
    # Leaves of a node: trees times what spill adds, whatever the number of vectors.
    known = leaves.groupBy("node").agg(F.collect_list("leaf").alias("leaves"))
    payload = nodes.select("node", "vec", "copies").join(known, "node")
    members = leaves.filter("n > 1").select("node", "leaf", "n").join(payload, "node")
    found = store(leaf_links(members, f))
    edges = found.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct()
    linked = found.select(F.col("node").alias("v")).distinct()
    roots = connected_components(linked, edges).withColumnRenamed("v", "node")
    joined = nodes.join(roots, "node").groupBy("root").agg(F.min("least").alias("component_id"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    summary = (
        nodes.select("node", "copies", "least")
        .join(links, "node", "left")
        .join(roots.join(joined, "root").select("node", "component_id"), "node", "left")
        .select(
            "node",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component_id", "least").alias("component_id"),
        )
    )
    linkable = valid.select("vec_id", "node").join(summary, "node").drop("node")
    return with_the_rest(rows, linkable)


def with_the_rest(rows: DataFrame, linkable: DataFrame) -> DataFrame:
    """Results of linkable rows, and of the others, which link with nothing."""
    x = F.col("vec")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0)
    alone = rows.filter(~F.coalesce(good, F.lit(False))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    both = linkable.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id").unionByName(alone)
    return both.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
