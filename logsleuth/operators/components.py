"""Connected components of a large undirected graph."""

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from logsleuth.operators.distribute import store

# Links that one task unites. More of them go through rounds.
LINKS_AT_ONCE = 200_000


def united(links: DataFrame) -> DataFrame:
    """(v, root) of the ends of at most ``LINKS_AT_ONCE`` links, in one task."""

    def run(table: pa.Table) -> pa.Table:
        parent: dict = {}

        def root(v):
            while (up := parent.setdefault(v, v)) != v:
                parent[v] = v = parent[up]
            return v

        for a, b in zip(table.column("a").to_pylist(), table.column("b").to_pylist()):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        ends = list(parent)
        kind = table.schema.field("a").type
        return pa.table({"v": pa.array(ends, kind), "root": pa.array([root(v) for v in ends], kind)})

    kind = links.schema["a"].dataType
    schema = T.StructType([T.StructField("v", kind), T.StructField("root", kind)])
    return links.select("a", "b", F.lit(0).alias("_all")).groupBy("_all").applyInArrow(run, schema)


def with_few_links(vertices: DataFrame, links: DataFrame, start: DataFrame | None) -> DataFrame:
    """Components where one task can unite all links, or what they say of earlier roots."""
    if start is not None:
        for end in ("a", "b"):
            known = start.select(F.col("v").alias(end), F.col("root").alias(f"_{end}"))
            links = links.join(known, end)
        links = links.select(F.col("_a").alias("a"), F.col("_b").alias("b")).filter("a != b").distinct()
    roots = start if start is not None else vertices.select("v", F.col("v").alias("root"))
    moved = store(united(links)).select(F.col("v").alias("root"), F.col("root").alias("_to"))
    return store(roots.join(moved, "root", "left").select("v", F.coalesce("_to", "root").alias("root")))


def connected_components(
    vertices: DataFrame, links: DataFrame, start: DataFrame | None = None
) -> DataFrame:
    """Smallest vertex of the component of each vertex, as (v, root).

    ``vertices`` has v, ``links`` has a and b. With ``start``, an earlier result for the same
    vertices, ``links`` needs only what has come since: older links live on in its roots.

    Up to ``LINKS_AT_ONCE`` links are united in one task. With more, every round each vertex,
    and the vertex it points to, moves to the smallest grandparent in
    its neighbourhood; trees are flattened at the same time, so rounds grow with the logarithm
    of the diameter. Proposals are combined before they are shuffled, which keeps a hub
    with very many links harmless. Ends when no pointer changes.
    """
    links = store(links)
    if links.count() <= LINKS_AT_ONCE:
        return with_few_links(vertices, links, start)
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = store(links.select(ends.alias("e")).select("e.a", "e.b"))
    if start is None:
        state = store(vertices.select("v", F.col("v").alias("root")))
        known = state.withColumn("grand", F.col("root"))
    else:
        state, known = start.select("v", "root"), None
    while True:
        if known is None:
            parents = state.select(F.col("v").alias("root"), F.col("root").alias("grand"))
            known = store(state.join(parents, "root").select("v", "root", "grand"))
        near = (
            both.join(known.select(F.col("v").alias("b"), "grand"), "b")
            .groupBy("a")
            .agg(F.min("grand").alias("near"))
            .withColumnRenamed("a", "v")
        )
        # One offer to the vertex, which knows its old root, and one to that root.
        offer = F.least("near", "grand").alias("offer")
        nothing = F.lit(None).cast(state.schema["root"].dataType)
        offers = F.array(
            F.struct("v", offer, F.col("root").alias("old")),
            F.struct(F.col("root").alias("v"), offer, nothing.alias("old")),
        )
        following = store(
            known.join(near, "v", "left")
            .select(F.explode(offers).alias("o"))
            .groupBy("o.v")
            .agg(F.min("o.offer").alias("root"), F.max("o.old").alias("old"))
        )
        moved = not following.filter("root != old").isEmpty()
        state, known = following.select("v", "root"), None
        if not moved:
            return state
