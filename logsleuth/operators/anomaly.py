"""Anomaly scores per address: isolation forest, and a simple heuristic."""

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from logsleuth.functions.columns import round_half_even
from logsleuth.operators.distribute import exact_percentile, store
from logsleuth.schema import IP_FEATURE_COLUMNS

# Forest size, rows per tree, fewest addresses that can be modelled.
TREES = 200
TREE_ROWS = 256
MIN_ADDRESSES = 3
NEUTRAL_SCORE = 0.5
HEURISTIC_FLAG = 0.6

# Addresses are drawn modulo this prime.
PRIME = (1 << 31) - 1
# Digits of features that come out of long sums; the others have six.
FEATURE_DIGITS = {"iet_mean": 2, "iet_std": 2}

NODE_SCHEMA = "tree int, node int, feature int, split double, low int, high int, path double"


def contamination_of(rows):
    """Share of anomalies to expect among that many addresses."""
    return F.when(rows < 5, 0.20).when(rows < 20, 0.10).otherwise(0.05)


def iforest_contamination(features: DataFrame) -> DataFrame:
    return features.agg(F.count("*").alias("n_samples")).withColumn(
        "contamination", contamination_of(F.col("n_samples"))
    )


def heuristic_anomaly(features: DataFrame) -> DataFrame:
    """Weighted sum of failures, night logins, country risk and bad reputation."""
    score = round_half_even(
        F.least(
            F.lit(1.0),
            F.col("failed_count") * 0.1
            + F.col("night_logins") * 0.2
            + F.col("geo_risk") * 0.3
            + (1 - F.col("ip_reputation")) * 0.2,
        ),
        4,
    )
    few = F.col("_rows") < MIN_ADDRESSES
    return (
        features.withColumn("_rows", features.agg(F.count("*")).scalar())
        .withColumn("anomaly_score", F.when(few, NEUTRAL_SCORE).otherwise(score))
        .withColumn("is_anomaly", ~few & (F.col("anomaly_score") > HEURISTIC_FLAG))
        .select("ip_address", "anomaly_score", "is_anomaly")
    )


def expected_path(rows: float) -> float:
    """Average path length of an unsuccessful search in a tree of that many rows."""
    if rows <= 1:
        return 0.0
    if rows == 2:
        return 1.0
    return 2.0 * (math.log(rows - 1.0) + 0.5772156649015329) - 2.0 * (rows - 1.0) / rows


def digest_draws(text: str) -> tuple[int, int]:
    """Two draws of 28 bits that any engine with this digest can repeat."""
    digest = hashlib.md5(text.encode()).hexdigest()
    return int(digest[:7], 16), int(digest[7:14], 16)


def _noise_free(name: str) -> Column:
    """A feature without digits that depend on the order in which it was summed."""
    return round_half_even(F.col(name), FEATURE_DIGITS.get(name, 6)).alias(name)


def _tree_samples(features: DataFrame) -> DataFrame:
    """Up to TREE_ROWS addresses for every tree, those with the lowest draws.

    A draw is linear in two digests of the address, modulo a prime, with coefficients from a
    digest of the tree: nothing but the address and the tree decides it. A threshold
    on it thins out the candidates first, leaving a few hundred more than needed per tree.
    """
    rows = features.agg(F.count("*")).scalar()
    digest = F.md5(F.col("ip_address").cast("binary"))
    part = lambda first: F.conv(F.substring(digest, first, 7), 16, 10).cast("long")
    factors = [digest_draws(f"tree {tree}") for tree in range(TREES)]
    shifts = [digest_draws(f"shift {tree}")[0] for tree in range(TREES)]
    tables = [F.lit(list(column)) for column in (*zip(*factors), shifts)]
    one, two, shift = (lambda t, c=c: F.element_at(c, t + 1).cast("long") for c in tables)
    draw = lambda t: (F.col("_one") * one(t) + F.col("_two") * two(t) + shift(t)) % PRIME
    limit = F.floor((TREE_ROWS * 1.5 + 200) / F.col("_rows") * PRIME)
    drawn = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), draw(t).alias("at")))
    candidates = (
        features.withColumns({"_rows": rows, "_one": part(1), "_two": part(8)})
        .withColumn("_draw", F.explode(F.filter(drawn, lambda d: d["at"] < limit)))
        .select("ip_address", *IP_FEATURE_COLUMNS, "_draw.*")
    )
    by_draw = Window.partitionBy("tree").orderBy("at", "ip_address")
    return candidates.withColumn("_rank", F.row_number().over(by_draw)).filter(F.col("_rank") <= TREE_ROWS)


def _grow(sample: pd.DataFrame) -> pd.DataFrame:
    """One isolation tree over one bounded sample, as a flat list of nodes.

    Places are numbered as in a heap (1; below place p: 2p and 2p + 1); the feature and the
    limit of a split are drawn by digest of tree and place.
    """
    tree = int(sample["tree"].iloc[0])
    points = sample[IP_FEATURE_COLUMNS].to_numpy(dtype=float)
    limit = math.ceil(math.log2(max(len(points), 2)))
    nodes = []
    pending = [(0, 1, np.arange(len(points)), 0)]
    used = 1
    while pending:
        node, place, members, depth = pending.pop()
        part = points[members]
        low, high = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(members) <= 1 or len(usable) == 0:
            nodes.append((tree, node, -1, 0.0, node, node, depth + expected_path(len(members))))
            continue
        which, share = digest_draws(f"{tree}:{place}")
        feature = int(usable[which % len(usable)])
        split = float(low[feature] + (high[feature] - low[feature]) * (share / float(1 << 28)))
        below = part[:, feature] <= split
        nodes.append((tree, node, feature, split, used, used + 1, 0.0))
        pending += [(used, 2 * place, members[below], depth + 1), (used + 1, 2 * place + 1, members[~below], depth + 1)]
        used += 2
    return pd.DataFrame(nodes, columns=[c.split()[0] for c in NODE_SCHEMA.split(", ")])


def grow_forest(features: DataFrame) -> DataFrame:
    """Node table of the forest, at most TREES * (2 * TREE_ROWS - 1) rows."""
    return _tree_samples(features).groupBy("tree").applyInPandas(_grow, NODE_SCHEMA)


def _path_scorer(forest: DataFrame):
    """Vectorised mean path length over all trees.

    The model has a fixed largest size (about 100,000 nodes), so it is shipped to
    the executors as one broadcast variable, the way tree ensembles usually are.
    """
    nodes = forest.toPandas()
    trees = nodes["tree"].max() + 1
    shape = (trees, nodes["node"].max() + 1)
    at = (nodes["tree"].to_numpy(), nodes["node"].to_numpy())
    model = {}
    for name, kind in (("feature", int), ("split", float), ("low", int), ("high", int), ("path", float)):
        model[name] = np.zeros(shape, dtype=kind)
        model[name][at] = nodes[name].to_numpy()
    depth = math.ceil(math.log2(TREE_ROWS)) + 1
    shipped = forest.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def mean_path(*columns: pd.Series) -> pd.Series:
        forest_arrays = shipped.value
        points = np.column_stack([c.to_numpy(dtype=float) for c in columns])
        total = np.zeros(len(points))
        for tree in range(forest_arrays["feature"].shape[0]):
            feature, split = forest_arrays["feature"][tree], forest_arrays["split"][tree]
            low, high = forest_arrays["low"][tree], forest_arrays["high"][tree]
            node = np.zeros(len(points), dtype=int)
            for _ in range(depth):
                wanted = feature[node]
                value = points[np.arange(len(points)), np.maximum(wanted, 0)]
                step = np.where(value <= split[node], low[node], high[node])
                node = np.where(wanted < 0, node, step)
            total += forest_arrays["path"][tree][node]
        return pd.Series(total / forest_arrays["feature"].shape[0])

    return mean_path


def isolation_forest(features: DataFrame) -> DataFrame:
    """Anomaly score in [0, 1] and flag per address, from an isolation forest.

    Scores are scaled between the least and the most isolated address; the flag
    marks the expected share of anomalies, cut at an interpolated percentile. All draws are
    digests of addresses, trees and places, so that the same addresses give the same forest
    anywhere.
    """
    features = store(features.select("ip_address", *map(_noise_free, IP_FEATURE_COLUMNS)))
    rows = features.count()
    if rows < MIN_ADDRESSES:
        return features.select(
            "ip_address",
            F.lit(NEUTRAL_SCORE).alias("anomaly_score"),
            F.lit(False).alias("is_anomaly"),
        )
    mean_path = _path_scorer(grow_forest(features))
    scale = expected_path(min(TREE_ROWS, rows))
    isolated = F.pow(F.lit(2.0), -mean_path(*IP_FEATURE_COLUMNS) / scale)
    isolation = store(features.select("ip_address", round_half_even(isolated, 12).alias("isolation")))
    bounds = isolation.agg(
        F.struct(F.min("isolation").alias("low"), F.max("isolation").alias("high"))
    ).scalar()
    share = contamination_of(F.count("*"))
    edge = exact_percentile(isolation, "isolation", 1.0 - share, ["ip_address"]).scalar()
    spread = F.col("_b.high") - F.col("_b.low")
    score = F.when(spread > 0, (F.col("isolation") - F.col("_b.low")) / spread).otherwise(NEUTRAL_SCORE)
    return isolation.withColumns({"_b": bounds, "_edge": edge}).select(
        "ip_address",
        round_half_even(score, 4).alias("anomaly_score"),
        (F.col("isolation") > F.col("_edge")).alias("is_anomaly"),
    )
