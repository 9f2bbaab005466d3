"""Campaigns: density clusters (DBSCAN) of addresses that behave alike.

The textbook algorithm compares all pairs of points. Here every point looks around itself only
as far as it has to, and no pair is ever written down that a component already implies:

* equal feature vectors are one weighted point;
* a tree of splits, taken from a bounded sample, cuts space into leaves; a leaf's task holds
  its own points and those within eps of its box, so all neighbours of an own point are there.
  Leaves that no split makes smaller (very many points within eps) are dealt out over blocks;
* neighbours are counted ring by ring around a pivot of the leaf, nearest rings first, and a
  point leaves the count as soon as it has enough. Only points that end with too few keep
  their neighbours, and those are fewer than ``min_samples``;
* core points are contracted: points near a part of a component join it and are not compared
  again. A leaf sends one row a point, its component; components that share a point of two
  leaves are one. Blocks of one leaf share pivots, and only what is still apart afterwards is
  compared across them.

Rows that are shuffled grow with the points (times the leaves whose border they are near), not
with their pairs.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logsleuth.operators.components import connected_components
from logsleuth.operators.distribute import global_index, skew_join, store
from logsleuth.schema import EVENT_ORDER, IP_FEATURE_COLUMNS

# Radius bounds, neighbours wanted, fewest addresses, labels.
MIN_EPS, EPS_PER_SPREAD = 0.5, 0.8
FEW_ADDRESSES, MIN_SAMPLES_FEW, MIN_SAMPLES = 50, 2, 5
TINY_EPS, TINY_MIN_SAMPLES = 1.0, 1
MIN_ADDRESSES = 3
LONE, LONE_LABEL, CAMPAIGN_LABEL = -1, "Lone Actor", "Campaign #%d"

# Points that splits are taken from, points a leaf is meant to own, points that meet in a task.
SAMPLE_POINTS, LEAF_POINTS, BLOCK_POINTS = 20_000, 4_096, 32_768
# Points that all blocks of a leaf share, and points compared with a ring at once.
PIVOTS, TILE = 64, 128
# Fewest sampled points of a leaf, so that a split is not guessed, and limits tried in a dimension.
LEAST_SAMPLED, SPLITS_TRIED = 32, 33
# How many times the blocks that open points have met they have met after a further round.
MORE_BLOCKS = 4


def scaled_features(features: DataFrame) -> DataFrame:
    """Features with mean 0 and population deviation 1; constant ones become 0."""
    stats = features.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in IP_FEATURE_COLUMNS],
            *[F.stddev_pop(c).alias(f"s_{c}") for c in IP_FEATURE_COLUMNS],
        )
    ).scalar()

    def scaled(name):
        deviation = F.col(f"_s.s_{name}")
        return (F.col(name) - F.col(f"_s.m_{name}")) / F.when(deviation == 0, 1.0).otherwise(deviation)

    return features.withColumn("_s", stats).select(
        "ip_address", *[scaled(c).alias(c) for c in IP_FEATURE_COLUMNS]
    )


def dbscan_params(features: DataFrame) -> DataFrame:
    """Radius and neighbour count for DBSCAN on the scaled features.

    A scaled column has deviation 1, or 0 if it is constant, so the mean deviation
    is the share of columns that vary.
    """
    varying = sum(
        ((F.min(c) < F.max(c)).cast("int") for c in IP_FEATURE_COLUMNS), F.lit(0)
    ) / float(len(IP_FEATURE_COLUMNS))
    n = F.col("n")
    return features.agg(F.count("*").alias("n"), varying.alias("spread")).select(
        "n",
        F.when(n < 2, TINY_EPS)
        .otherwise(F.greatest(F.lit(MIN_EPS), F.col("spread") * EPS_PER_SPREAD))
        .alias("eps"),
        F.when(n < 2, TINY_MIN_SAMPLES)
        .when(n < FEW_ADDRESSES, MIN_SAMPLES_FEW)
        .otherwise(MIN_SAMPLES)
        .alias("min_samples"),
    )


def split_tree(sample: np.ndarray, each: float, eps: float) -> tuple[object, int]:
    """Splits of space and the number of leaves; a sampled point stands for ``each`` points.

    A leaf is its number, a split (dimension, limit, below, from there on). Points within eps
    of a limit go to both sides, so the split that has fewest of them for each point of its
    smaller side is taken, and none that has more of them than that side has points.
    """
    leaves = 0

    def best(points):
        """Dimension and limit of the best split, or None."""
        n, least, found = len(points), 1.0, None
        places = np.unique(np.linspace(n // 10, n - n // 10, SPLITS_TRIED).astype(int))
        for d, value in enumerate(np.sort(points, axis=0).T):
            limits = value[places]
            below = np.searchsorted(value, limits)
            side = np.minimum(below, n - below)
            shared = np.searchsorted(value, limits + eps, "right") - np.searchsorted(value, limits - eps)
            cost = np.where(side >= LEAST_SAMPLED, shared / np.maximum(side, 1), np.inf)
            at = int(cost.argmin())
            if cost[at] <= least:
                least, found = cost[at], (d, float(limits[at]))
        return found

    def split(points):
        nonlocal leaves
        if len(points) * each > LEAF_POINTS and len(points) >= 2 * LEAST_SAMPLED and (at := best(points)):
            below = points[:, at[0]] < at[1]
            return *at, split(points[below]), split(points[~below])
        leaves += 1
        return leaves - 1

    return split(sample), leaves


def placed(points: DataFrame, tree, eps: float) -> DataFrame:
    """Rows (leaf, own, pid, weight, x): each point in its leaf and in all within eps of it."""
    reach = eps * (1 + 1e-9)  # rounding cannot lose a neighbour

    def spots(x, rows, gaps, own, node):
        if not len(rows):
            return
        if not isinstance(node, tuple):
            yield rows, own, node
            return
        d, limit, below, above = node
        value = x[rows, d]
        for side, child in ((value < limit, below), (value >= limit, above)):
            wider = gaps.copy()
            wider[:, d] = np.where(side, gaps[:, d], np.maximum(gaps[:, d], np.abs(value - limit)))
            near = (wider * wider).sum(1) <= reach * reach
            yield from spots(x, rows[near], wider[near], (own & side)[near], child)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = vectors(batch.column("x"))
            rows = np.arange(len(x))
            for at, own, leaf in spots(x, rows, np.zeros(x.shape), np.ones(len(x), bool), tree):
                taken = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), leaf, np.int32)), pa.array(own), *(taken.column(c) for c in ("pid", "weight", "x"))],
                    ["leaf", "own", "pid", "weight", "x"],
                )

    return points.select("pid", "weight", "x").mapInArrow(
        run, "leaf int, own boolean, pid long, weight long, x array<double>"
    )


def vectors(column) -> np.ndarray:
    """A list column without nulls and with lists of one length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def within(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """Which rows of ``b`` are within ``eps`` of which rows of ``a``.

    Squares of distances are one product of matrices; pairs so near to ``eps`` that its
    rounding could decide are computed from the differences.
    """
    square_a, square_b = (a * a).sum(1), (b * b).sum(1)
    finite = [x.max(initial=0, where=np.isfinite(x)) for x in (square_a, square_b)]
    total = np.column_stack([a, square_a, np.ones(len(a))]) @ np.column_stack([-2 * b, np.ones(len(b)), square_b]).T
    slack = 1e-12 * (sum(finite) + eps * eps)
    near = total <= eps * eps + slack
    i, j = np.nonzero(near & (total >= eps * eps - slack))
    if len(i):
        exact = np.zeros(len(i))
        for d in range(a.shape[1]):
            gap = a[i, d] - b[j, d]
            exact += gap * gap
        near[i, j] = np.sqrt(exact) <= eps
    return near


class Rings:
    """Points in the order of their distance from a pivot.

    By the triangle inequality neighbours within eps lie in rings that differ by eps at most.
    """

    def __init__(self, x: np.ndarray, pivot: np.ndarray):
        radius = np.sqrt(((x - pivot) ** 2).sum(1))
        self.order = np.argsort(radius, kind="stable")
        self.pivot, self.x, self.radius = pivot, x[self.order], radius[self.order]

    def around(self, low: float, high: float, eps: float) -> tuple[int, int]:
        """Range of the points that may be near one at a distance of low to high."""
        slack = eps + 1e-9 * (1 + abs(high))
        return int(np.searchsorted(self.radius, low - slack, "left")), int(np.searchsorted(self.radius, high + slack, "right"))


def outward(low: int, high: int, centre: int, width: int):
    """Ranges that cover low to high, those around ``centre`` first."""
    a = b = min(max(centre, low), high)
    while low < a or b < high:
        if b < high:
            yield b, min(b + width, high)
            b = min(b + width, high)
        if low < a:
            yield max(a - width, low), a
            a = max(a - width, low)


def count_near(probes: np.ndarray, x: np.ndarray, weight: np.ndarray, eps: float, enough: int):
    """Weight of the points near each probe, counted up to ``enough``, and the pairs
    (probe, point) of the probes that stay below it."""
    counts = np.zeros(len(probes), np.int64)
    pairs = [np.zeros((2, 0), np.int64)]
    if not len(probes) or not len(x):
        return counts, pairs[0]
    rings = Rings(x, probes.mean(0))
    heavy = weight[rings.order]
    own = Rings(probes, rings.pivot)
    for first in range(0, len(probes), TILE):
        tile = np.arange(first, min(first + TILE, len(probes)))
        low, high = rings.around(own.radius[tile[0]], own.radius[tile[-1]], eps)
        centre = int(np.searchsorted(rings.radius, own.radius[tile[len(tile) // 2]]))
        total, found = np.zeros(len(tile), np.int64), []
        for a, b in outward(low, high, centre, 16 * TILE):
            open_ = np.flatnonzero(total < enough)
            if not len(open_):
                break
            near = within(own.x[tile[open_]], rings.x[a:b], eps)
            total[open_] += near @ heavy[a:b]
            few = np.flatnonzero(total[open_] < enough)
            i, j = np.nonzero(near[few])
            found.append(np.stack([open_[few[i]], j + a]))
        counts[own.order[tile]] = total
        if found:
            at = np.concatenate(found, axis=1)
            at = at[:, total[at[0]] < enough]
            pairs.append(np.stack([own.order[tile[at[0]]], rings.order[at[1]]]))
    return counts, np.concatenate(pairs, axis=1)


def local_components(x: np.ndarray, eps: float) -> np.ndarray:
    """Number of the component of each point, points within ``eps`` being linked.

    A component grows from its newest points; what joins it is taken out of the points that
    are still compared.
    """
    labels = np.full(len(x), -1, np.int64)
    if not len(x):
        return labels
    rings = Rings(x, x.mean(0))
    left = np.arange(len(x))
    number = 0
    while len(left):
        fresh, left = left[:1], left[1:]
        labels[rings.order[fresh]] = number
        while len(fresh):
            tile, fresh = fresh[:TILE], fresh[TILE:]
            low, high = rings.around(rings.radius[tile].min(), rings.radius[tile].max(), eps)
            a, b = np.searchsorted(left, (low, high))
            joined = []
            for at in range(a, b, 16 * TILE):
                some = left[at : min(at + 16 * TILE, b)]
                joined.append(some[within(rings.x[tile], rings.x[some], eps).any(0)])
            if joined:
                joined = np.concatenate(joined)
                labels[rings.order[joined]] = number
                left = np.setdiff1d(left, joined, assume_unique=True)
                fresh = np.concatenate([fresh, joined])
        number += 1
    return labels


def _counted(rows: DataFrame, keys: list[str], eps: float, enough: int) -> DataFrame:
    """pid, n and near of the probes of each group, n as far as the group's members tell."""

    def run(table: pa.Table) -> pa.Table:
        x, pid = vectors(table.column("x")), numbers(table, "pid")
        probe, member = numbers(table, "probe"), numbers(table, "member")
        counts, pairs = count_near(x[probe], x[member], numbers(table, "weight")[member], eps, enough)
        order = np.argsort(pairs[0], kind="stable")
        ends = np.searchsorted(pairs[0][order], np.arange(len(counts) + 1))
        near = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pid[member][pairs[1][order]], pa.int64()))
        return pa.Table.from_arrays([pa.array(pid[probe]), pa.array(counts), near], ["pid", "n", "near"])

    return rows.groupBy(*keys).applyInArrow(run, "pid long, n long, near array<long>")


def _core_points(entries: DataFrame, blocks: dict, eps: float, enough: int) -> DataFrame:
    """pid, core, and for the others near: the few points around them (themselves too)."""
    members = entries.withColumns({"probe": F.col("own"), "member": F.lit(True)})
    counted = _counted(members, ["leaf", "block"], eps, enough)
    # What is still open in a leaf of several blocks looks into the others, a few at first:
    # most points soon have enough, so that few meet all blocks.
    wide = {leaf: n for leaf, n in blocks.items() if n > 1}
    met, done = 1, []
    while wide:
        counted = store(counted)
        done.append(counted.filter(F.col("n") >= enough))
        counted = counted.filter(F.col("n") < enough)
        own = entries.filter(F.col("leaf").isin(list(wide)) & F.col("own"))
        rest = store(own.join(counted, "pid", "left_semi"))
        parts = {r["leaf"]: -(-r["n"] // BLOCK_POINTS) for r in rest.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
        if not parts:
            break
        part = F.pmod(F.hash("pid"), _of_leaf(parts))
        further = F.sequence(F.lit(met), F.least(F.lit(MORE_BLOCKS * met), _of_leaf(wide)) - 1)
        probes = (
            rest.withColumns({"part": part, "_on": F.explode(further), "probe": F.lit(True), "member": F.lit(False)})
            .withColumn("block", F.pmod(F.col("block") + F.col("_on"), _of_leaf(wide)))
            .drop("_on")
        )
        into = (
            entries.filter(F.col("leaf").isin(list(parts)))
            .withColumns({"part": F.explode(F.sequence(F.lit(0), _of_leaf(parts) - 1)), "probe": F.lit(False), "member": F.lit(True)})
        )
        more = _counted(probes.unionByName(into), ["leaf", "block", "part"], eps, enough)
        counted = counted.unionByName(more).groupBy("pid").agg(
            F.sum("n").alias("n"), F.flatten(F.collect_list("near")).alias("near")
        )
        met *= MORE_BLOCKS
        wide = {leaf: n for leaf, n in wide.items() if n > met}
    for some in done:
        counted = counted.unionByName(some)
    core = F.col("n") >= enough
    return store(counted.select("pid", core.alias("core"), F.when(~core, F.col("near")).alias("near")))


def _of_leaf(values: dict):
    """The value of the row's leaf, from a table of at most some hundred leaves."""
    table = [0] * (max(values) + 1)
    for leaf, value in values.items():
        table[leaf] = value
    return F.element_at(F.lit(table), F.col("leaf") + 1).cast("int")


def _leaf_components(core: DataFrame, eps: float) -> DataFrame:
    """leaf, block, own, pid and root: the smallest point of its component in that block."""

    def run(table: pa.Table) -> pa.Table:
        pid = numbers(table, "pid")
        labels = local_components(vectors(table.column("x")), eps)
        least = np.full(labels.max(initial=-1) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, labels, pid)
        return table.select(["leaf", "block", "own", "pid"]).append_column("root", pa.array(least[labels], pa.int64()))

    return core.groupBy("leaf", "block").applyInArrow(run, "leaf int, block int, own boolean, pid long, root long")


def _apart(rows: DataFrame, eps: float) -> DataFrame:
    """Pairs (a, b) of different components of which a probe and a member are near."""

    def run(table: pa.Table) -> pa.Table:
        x = vectors(table.column("x"))
        roots, root = np.unique(numbers(table, "root"), return_inverse=True)
        probe, member = numbers(table, "probe"), numbers(table, "member")
        links = [np.zeros(0, np.int64)]
        if probe.any() and member.any():
            rings = Rings(x[member], x[member].mean(0))
            own = Rings(x[probe], rings.pivot)
            theirs, mine = root[probe][own.order], root[member][rings.order]
            for first in range(0, len(theirs), TILE):
                tile = slice(first, first + TILE)
                low, high = rings.around(own.radius[tile][0], own.radius[tile][-1], eps)
                for a in range(low, high, 16 * TILE):
                    some = slice(a, min(a + 16 * TILE, high))
                    near = within(own.x[tile], rings.x[some], eps) & (theirs[tile, None] != mine[some])
                    i, j = np.nonzero(near)
                    i, j = theirs[tile][i], mine[some][j]
                    links.append(np.unique(np.minimum(i, j) * len(roots) + np.maximum(i, j), return_index=True)[0])
        links = np.unique(np.concatenate(links), return_index=True)[0]
        a, b = np.divmod(links, max(len(roots), 1))
        return pa.Table.from_arrays([pa.array(roots[a], pa.int64()), pa.array(roots[b], pa.int64())], ["a", "b"])

    return rows.groupBy("leaf", "block", "part").applyInArrow(run, "a long, b long")


def _contracted(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """(v, root) of the components of few vertices; nothing is run where there are no links."""
    links = store(links.distinct())
    if links.isEmpty():
        return vertices.select("v", F.col("v").alias("root"))
    touched = links.select(F.col("a").alias("v")).union(links.select("b")).distinct()
    return vertices.join(connected_components(touched, links), "v", "left").select(
        "v", F.coalesce("root", "v").alias("root")
    )


def _core_components(entries: DataFrame, status: DataFrame, blocks: dict, eps: float) -> DataFrame:
    """pid and root of the core points: the smallest core point they are connected to."""
    core = entries.join(status.filter("core").select("pid"), "pid", "left_semi")
    wide = {leaf: n for leaf, n in blocks.items() if n > 1}
    if wide:
        core = store(core)
        in_wide = F.col("leaf").isin(list(wide))
        pivot = F.pmod(F.xxhash64("pid", F.lit(1)), _of_leaf(wide) * (BLOCK_POINTS // PIVOTS)) == 0
        others = F.filter(F.sequence(F.lit(0), _of_leaf(wide) - 1), lambda b: b != F.col("block"))
        shared = core.filter(in_wide & pivot).withColumns({"block": F.explode(others), "own": F.lit(False)})
        local = store(_leaf_components(core.unionByName(shared), eps))
    else:
        local = store(_leaf_components(core, eps))
    roots = local.select(F.col("root").alias("v")).distinct()
    least = local.groupBy("pid").agg(F.min("root").alias("b"), F.max("root").alias("a"), F.collect_set("root").alias("all"))
    shared = least.filter("a != b").select(F.explode("all").alias("a"), "b").filter("a != b")
    found = _contracted(roots, shared)
    if wide:
        found = store(found)
        ends = local.filter(in_wide).join(found.withColumnRenamed("root", "to"), F.col("root") == F.col("v"))
        placed_ = store(
            core.filter(in_wide).join(ends.select("leaf", "block", "pid", F.col("to").alias("root")).distinct(), ["leaf", "block", "pid"])
        )
        sizes = placed_.groupBy("leaf", "root").agg(F.count("*").alias("n"))
        largest = sizes.groupBy("leaf").agg(F.max_by("root", F.struct("n", "root")).alias("_main"), F.count("*").alias("_parts"))
        small = store(
            placed_.join(F.broadcast(largest.filter("_parts > 1")), "leaf").filter(F.col("root") != F.col("_main")).drop("_main", "_parts")
        )
        parts = {r["leaf"]: -(-r["n"] // BLOCK_POINTS) for r in small.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
        if parts:
            part = F.pmod(F.hash("pid"), _of_leaf(parts))
            every = F.sequence(F.lit(0), _of_leaf(wide) - 1)
            probes = small.withColumns({"part": part, "block": F.explode(every), "probe": F.lit(True), "member": F.lit(False)})
            into = placed_.filter(F.col("leaf").isin(list(parts))).withColumns(
                {"part": F.explode(F.sequence(F.lit(0), _of_leaf(parts) - 1)), "probe": F.lit(False), "member": F.lit(True)}
            )
            again = _contracted(
                found.select(F.col("root").alias("v")).distinct(), _apart(probes.unionByName(into), eps)
            )
            found = found.join(again.select(F.col("v").alias("root"), F.col("root").alias("to")), "root").select("v", F.col("to").alias("root"))
    own = local.filter("own").select("pid", F.col("root").alias("v"))
    return own.join(found, "v").select("pid", "root")


def _weighted_points(points: DataFrame) -> DataFrame:
    """Distinct vectors with weight; pid follows their first appearance."""
    distinct = points.groupBy("x").agg(F.count("*").alias("weight"), F.min("first_seen").alias("first"))
    return global_index(distinct.select("x", "weight", "first.*"), EVENT_ORDER, "pid").select("pid", "x", "weight")


def ip_campaigns(
    features: DataFrame, first_seen: DataFrame, eps: float | None = None, min_samples: int | None = None
) -> DataFrame:
    """Campaign number and label of each address, -1 for lone actors.

    Campaigns are numbered by the first appearance of their first core address; a border
    address joins the lowest-numbered campaign it touches. ``eps``, the radius in scaled
    features, and ``min_samples``, the addresses within it that make one a core (itself
    counted), default to ``dbscan_params``; a larger eps gives fewer and wider campaigns.
    """
    features = store(features)
    stats = features.agg(*[(F.min(c) < F.max(c)).alias(c) for c in IP_FEATURE_COLUMNS])
    found = dbscan_params(features).crossJoin(F.broadcast(stats)).first()
    if found["n"] < MIN_ADDRESSES:
        return _labelled(features.select("ip_address", F.lit(LONE).cast("long").alias("campaign_cluster")))
    eps = float(found["eps"] if eps is None else eps)
    enough = found["min_samples"] if min_samples is None else min_samples
    names = [c for c in IP_FEATURE_COLUMNS if found[c]] or IP_FEATURE_COLUMNS[:1]
    scaled = scaled_features(features).select("ip_address", F.array(*names).alias("x"))
    points = store(scaled.join(first_seen, "ip_address"))
    members = store(_weighted_points(points))

    n = members.count()
    share = F.pmod(F.xxhash64("pid"), F.lit(1 << 30)) < math.ceil(min(1.0, SAMPLE_POINTS / n) * (1 << 30))
    sample = members.filter(share).select("x").toArrow()
    tree, _ = split_tree(vectors(sample.column("x")), n / max(sample.num_rows, 1), eps) if sample.num_rows else (0, 1)
    spots = store(placed(members, tree, eps))
    sizes = {r["leaf"]: r["n"] for r in spots.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    blocks = {leaf: math.ceil(size / BLOCK_POINTS) for leaf, size in sizes.items()}
    entries = spots.withColumn("block", F.pmod(F.hash("pid", F.lit(7)), _of_leaf(blocks)))

    status = _core_points(entries, blocks, eps, enough)
    of_core = store(_core_components(entries, status, blocks, eps))
    numbered = global_index(of_core.select("root").distinct(), ["root"], "campaign_cluster")
    of_core = store(of_core.join(numbered, "root").select("pid", "campaign_cluster"))
    touching = status.filter("NOT core").select(F.col("pid").alias("border"), F.explode("near").alias("pid"))
    of_border = (
        touching.join(of_core, "pid").groupBy("border").agg(F.min("campaign_cluster").alias("campaign_cluster"))
    )
    of_point = members.join(of_core.unionByName(of_border.withColumnRenamed("border", "pid")), "pid")
    per_ip = skew_join(
        points.select("ip_address", "x"),
        store(of_point.select("x", "weight", "campaign_cluster")),
        ["x"],
        "weight",
        spread=("ip_address",),
    )
    return _labelled(
        per_ip.select("ip_address", F.coalesce("campaign_cluster", F.lit(LONE)).alias("campaign_cluster"))
    )


def _labelled(clusters: DataFrame) -> DataFrame:
    number = F.col("campaign_cluster")
    label = F.when(number >= 0, F.format_string(CAMPAIGN_LABEL, number)).otherwise(LONE_LABEL)
    return clusters.withColumn("cluster_label", label)
