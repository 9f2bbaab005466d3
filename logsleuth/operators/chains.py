"""Attack chains: the events of an address as a causal graph of kill-chain phases."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from logsleuth.functions.columns import is_night_login
from logsleuth.operators import distribute
from logsleuth.operators.distribute import global_index, skew_join
from logsleuth.schema import EVENT_ORDER

# Phase of each event type, phase order and allowed successors.
PHASES = {
    "FAILED_LOGIN": "RECONNAISSANCE",
    "INVALID_USER": "RECONNAISSANCE",
    "SUCCESSFUL_LOGIN": "INITIAL_ACCESS",
    "ROOT_ACCESS": "PRIVILEGE_ESCALATION",
    "SUDO_ATTEMPT": "PRIVILEGE_ESCALATION",
    "DISCONNECT": "DEFENSE_EVASION",
    "OTHER": "EXECUTION",
}
DEFAULT_PHASE = "EXECUTION"
NIGHT_PHASE = "PERSISTENCE"
PHASE_ORDER = [
    "RECONNAISSANCE",
    "INITIAL_ACCESS",
    "EXECUTION",
    "PERSISTENCE",
    "PRIVILEGE_ESCALATION",
    "DEFENSE_EVASION",
    "LATERAL_MOVEMENT",
]
SUCCESSORS = {
    "RECONNAISSANCE": ["INITIAL_ACCESS"],
    "INITIAL_ACCESS": ["EXECUTION", "PERSISTENCE", "PRIVILEGE_ESCALATION"],
    "EXECUTION": ["PERSISTENCE", "PRIVILEGE_ESCALATION"],
    "PERSISTENCE": ["PRIVILEGE_ESCALATION", "LATERAL_MOVEMENT"],
    "PRIVILEGE_ESCALATION": ["DEFENSE_EVASION", "LATERAL_MOVEMENT"],
    "DEFENSE_EVASION": ["LATERAL_MOVEMENT"],
}
SHOWN_CHARACTERS = 80
CHAIN_LEVELS = ["HIGH", "CRITICAL"]

# Levels above the blocks of rows in the search for edges, and blocks in one of the next level.
LEVELS, FAN_OUT = 1, 1_000


def phase_of() -> Column:
    phase = F.lit(DEFAULT_PHASE)
    for event, name in PHASES.items():
        phase = F.when(F.col("event") == event, name).otherwise(phase)
    return F.when(is_night_login(), NIGHT_PHASE).otherwise(phase)


def only_rated(rows: DataFrame, scores: DataFrame | None) -> DataFrame:
    """Rows of addresses rated HIGH or CRITICAL; all rows if there are no ratings."""
    if scores is None:
        return rows
    rated = scores.filter(F.col("level").isin(CHAIN_LEVELS)).select("ip_address")
    return rows.join(rated, "ip_address", "left_semi")


def chain_nodes(events: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Events of each address numbered from 0 in time order, with their phase.

    One global sort by (address, time) numbers all rows; subtracting the first
    number of the address gives the node id. A long chain is spread over partitions.
    """
    rows = only_rated(events, scores).select(
        "ip_address",
        *EVENT_ORDER,
        phase_of().alias("phase"),
        "event",
        F.substring("message", 1, SHOWN_CHARACTERS).alias("details"),
        "username",
    )
    indexed = global_index(rows, ["ip_address", *EVENT_ORDER], "_row")
    starts = indexed.groupBy("ip_address").agg(
        F.min("_row").alias("_start"), F.count("*").alias("_nodes")
    )
    return skew_join(indexed, starts, ["ip_address"], "_nodes", how="inner").select(
        "ip_address",
        (F.col("_row") - F.col("_start")).alias("id"),
        "phase",
        "event",
        F.col("parsed_time").alias("time"),
        "details",
        "username",
        F.col("_row").alias("_row"),
    )


def _first_beyond(heads: DataFrame, targets: list[str], levels: int, fan_out: int) -> DataFrame:
    """Of each block (address, _block) the first node of every phase in later blocks.

    ``heads`` has the first node of every phase inside each block (_phase). Blocks are gathered
    ``fan_out`` at a time into blocks of the next level: what lies behind a block is found
    among its neighbours there, or else behind the larger block, which is answered first.
    """
    if not levels:
        group = ["ip_address"]
    else:
        heads = heads.withColumn("_parent", F.floor(F.col("_block") / fan_out))
        group = ["ip_address", "_parent"]
    following = (
        Window.partitionBy(*group).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    )
    near = {f"next_{t}": F.min(f"_{t}").over(following) for t in targets}
    if not levels:
        return heads.select("ip_address", "_block", *[c.alias(name) for name, c in near.items()])
    parents = heads.groupBy("ip_address", F.col("_parent").alias("_block")).agg(
        *[F.min(f"_{t}").alias(f"_{t}") for t in targets]
    )
    beyond = _first_beyond(parents, targets, levels - 1, fan_out)
    beyond = beyond.select("ip_address", F.col("_block").alias("_parent"), *[F.col(c).alias(f"_far_{c}") for c in near])
    return (
        heads.withColumns(near)
        .join(beyond, ["ip_address", "_parent"])
        .select("ip_address", "_block", *[F.coalesce(c, f"_far_{c}").alias(c) for c in near])
    )


def chain_edges(
    nodes: DataFrame, block: int | None = None, levels: int = LEVELS, fan_out: int = FAN_OUT
) -> DataFrame:
    """For each node the first later node of its address in an allowed next phase.

    Nodes are cut into blocks of consecutive rows. Inside a block a running minimum,
    read from the end, gives the next node of every phase; past the block's end the
    first node of every phase in the following blocks of the address takes over, found in a
    tree of blocks. With blocks of 100,000 rows and one level above them no group has more than a
    thousand rows for an address of up to 10 ** 11 events, and one more for each 10 ** 8 beyond.
    """
    block = block or distribute.BLOCK_ROWS
    targets = sorted({t for ts in SUCCESSORS.values() for t in ts}, key=PHASE_ORDER.index)
    later = (
        Window.partitionBy("ip_address", "_block")
        .orderBy(F.desc("id"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )

    def first_of(phase):
        return F.min(F.when(F.col("phase") == phase, F.col("id")))

    rows = nodes.select("ip_address", "id", "phase", F.floor(F.col("_row") / block).alias("_block"))
    inside = rows.withColumns({t: first_of(t).over(later) for t in targets})
    heads = inside.groupBy("ip_address", "_block").agg(
        *[first_of(t).alias(f"_{t}") for t in targets]
    )
    beyond = _first_beyond(heads, targets, levels, fan_out)
    nearest = {t: F.coalesce(F.col(t), F.col(f"next_{t}")) for t in targets}
    destination = F.lit(None).cast("long")
    for phase, allowed in SUCCESSORS.items():
        options = [nearest[t] for t in allowed]
        first = F.least(*options) if len(options) > 1 else options[0]
        destination = F.when(F.col("phase") == phase, first).otherwise(destination)
    return (
        inside.join(beyond, ["ip_address", "_block"])
        .select("ip_address", F.col("id").alias("src"), destination.alias("dst"))
        .filter(F.col("dst").isNotNull())
    )


def chain_summary(
    events: DataFrame, scores: DataFrame | None = None, addresses: DataFrame | None = None
) -> DataFrame:
    """Phases each address reached, in kill-chain order, and how far it got.

    Ratings are applied to the one row per address, after the events were combined. With the
    ``addresses`` of an Activity the events are not read.
    """
    if addresses is None:
        per_ip = events.groupBy("ip_address").agg(
            F.count("*").alias("node_count"),
            *[F.max(phase_of() == p).alias(p) for p in PHASE_ORDER],
        )
    else:
        reached = [(F.col(f"phase_{p.lower()}") > 0).alias(p) for p in PHASE_ORDER]
        per_ip = addresses.select("ip_address", F.col("total_events").alias("node_count"), *reached)
    reached = only_rated(per_ip, scores)
    furthest = F.greatest(
        *[F.when(F.col(p), F.lit(i)).otherwise(0) for i, p in enumerate(PHASE_ORDER)]
    )
    share = F.rint(furthest / (len(PHASE_ORDER) - 1.0) * 1000.0) / 1000.0
    return reached.select(
        "ip_address",
        "node_count",
        F.array_compact(F.array(*[F.when(F.col(p), F.lit(p)) for p in PHASE_ORDER])).alias(
            "phases_reached"
        ),
        share.alias("kill_chain_progress"),
    )


def attack_chains(
    events: DataFrame, scores: DataFrame | None = None, addresses: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Node, edge and summary tables of the chains of all rated addresses."""
    nodes = chain_nodes(events, scores)
    return {
        "nodes": nodes.drop("_row"),
        "edges": chain_edges(nodes),
        "summary": chain_summary(events, scores, addresses),
    }
