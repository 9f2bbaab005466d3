"""Pivot points: nodes of the graph of successful logins with several neighbours."""

from pyspark.sql import DataFrame, functions as F

from logsleuth.schema import SUCCESS

PIVOT_RISK = "HIGH"


def login_edges(events: DataFrame) -> DataFrame:
    """Undirected address-host edges of successful logins, once in each direction."""
    pairs = events.filter(F.col("event") == SUCCESS).select("ip_address", "host").distinct()
    ends = F.array(
        F.struct(F.col("ip_address").alias("node"), F.col("host").alias("neighbour")),
        F.struct(F.col("host").alias("node"), F.col("ip_address").alias("neighbour")),
    )
    return pairs.select(F.explode(ends).alias("e")).select("e.*").distinct()


def pivot_points(events: DataFrame) -> DataFrame:
    """Dotted nodes connected to more than one other node, one row per neighbour.

    Addresses and hosts share one namespace, so a dotted host name counts as well.
    The neighbours stay rows: a gateway may have millions of them.
    """
    edges = login_edges(events).filter(F.col("node").contains("."))
    degree = (
        edges.groupBy("node").agg(F.count("*").alias("hosts_count")).filter(F.col("hosts_count") > 1)
    )
    return edges.join(degree, "node").select(
        F.col("node").alias("ip"),
        F.col("neighbour").alias("host_involved"),
        "hosts_count",
        F.lit(PIVOT_RISK).alias("risk"),
    )
