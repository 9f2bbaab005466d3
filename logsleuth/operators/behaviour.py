"""Behavioural states per user: a three-state hidden Markov model, decoded in parallel.

A user may own a third of a log, so no user is ever decoded in one piece. Events are
sorted by (user, time) over the cluster and cut into bounded chunks. Viterbi scoring
is a product of max-plus matrices, one per event, and back-tracking is a composition
of maps from end state to start state; both are associative. The chunks are combined
in a tree: products go up, entry scores and end states come down, and every chunk
decodes on its own. Log probabilities are fixed-point integers, which makes the
result independent of where the chunks are cut.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from logsleuth.functions.columns import is_night_login, round_half_even
from logsleuth.operators.distribute import cut, first_events, store
from logsleuth.schema import EVENT_ORDER, FAILED, ROOT, SUCCESS, SUDO, UNKNOWN_USER

# States, start, transition and emission probabilities, observations.
STATES = ["NORMAL", "ELEVATED", "COMPROMISED"]
START = [0.85, 0.10, 0.05]
TRANSITION = [
    [0.90, 0.08, 0.02],
    [0.20, 0.60, 0.20],
    [0.05, 0.15, 0.80],
]
EMISSION = [
    [0.70, 0.05, 0.05, 0.10, 0.10],
    [0.30, 0.25, 0.15, 0.20, 0.10],
    [0.10, 0.30, 0.25, 0.25, 0.10],
]
LOG_OFFSET = 1e-10
OBSERVED = {"success": 0, "failed": 1, "night": 2, "new_ip": 3, "privilege": 4}
STATE_RISK = {"ELEVATED": 0.3, "COMPROMISED": 0.7}
SHORT_RISK = 0.1

# Events per chunk, and chunks per node of the tree above them.
FAN_OUT = 4096
# One unit of the fixed-point log probabilities, and the score of the impossible.
UNIT = float(1 << 32)
NEVER = -(1 << 60)

LONGS = T.ArrayType(T.LongType())
INTS = T.ArrayType(T.IntegerType())


def fixed_point(probability: float) -> int:
    return round(math.log(probability + LOG_OFFSET) * UNIT)


_START = np.array([fixed_point(p) for p in START])
_STEP = np.array(
    [
        [[fixed_point(TRANSITION[i][j]) + fixed_point(EMISSION[j][o]) for j in range(3)] for i in range(3)]
        for o in range(5)
    ]
)
_FIRST = np.array([[_START[j] + fixed_point(EMISSION[j][o]) for j in range(3)] for o in range(5)])


def user_observations(events: DataFrame) -> DataFrame:
    """Observation code of every event of a known user.

    Whether an address is new to the user is decided by the first event of the pair,
    found by an aggregation and matched on the full event position.
    """
    known = events.filter(F.col("username") != UNKNOWN_USER).select(
        "username", "ip_address", "event", *EVENT_ORDER
    )
    firsts = first_events(known, ["username", "ip_address"]).select(
        "username", "ip_address", "first.*", F.lit(True).alias("_first")
    )
    success = F.col("event") == SUCCESS
    code = (
        F.when(is_night_login(), OBSERVED["night"])
        .when(success & F.col("_first").isNotNull(), OBSERVED["new_ip"])
        .when(F.col("event") == FAILED, OBSERVED["failed"])
        .when(F.col("event").isin(ROOT, SUDO), OBSERVED["privilege"])
        .otherwise(OBSERVED["success"])
    )
    return known.join(firsts, ["username", "ip_address", *EVENT_ORDER], "left").select(
        "username", *EVENT_ORDER, code.cast("int").alias("observation")
    )


def _chunks(observations: DataFrame, fan_out: int, keep: list[str]) -> DataFrame:
    """Time-ordered events of each user in chunks of at most ``fan_out`` events.

    The stamp grows with the sorted position, so ``stamp / fan_out`` numbers chunks
    in order. Storing the chunks fixes the layout the stamps refer to.
    """
    order = ["username", *EVENT_ORDER]
    row = F.struct("_stamp", *keep, "observation")
    chunks = (
        observations.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_stamp", F.monotonically_increasing_id())
        .groupBy("username", F.floor(F.col("_stamp") / fan_out).alias("node"))
        .agg(F.sort_array(F.collect_list(row)).alias("rows"))
    )
    return store(chunks)


def _batches(codes: pd.Series):
    """Chunks ordered longest first, padded; and how many are still running per step."""
    lengths = codes.map(len).to_numpy()
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths.max()) if len(lengths) else 0
    table = np.zeros((len(codes), longest), dtype=np.int8)
    for row, position in enumerate(order):
        table[row, : lengths[position]] = codes.iloc[position]
    running = np.searchsorted(-lengths[order], -np.arange(longest), side="left")
    return table, order, lengths[order], running


def _scores(table, running, entry, starts, visit=None):
    """Scores after each event for every chunk of a batch, from given entry scores.

    ``entry`` has shape (chunks, any, 3): several entry vectors at a time.
    """
    score = entry.copy()
    for step, active in enumerate(running):
        observed = table[:active, step]
        options = score[:active, :, :, None] + _STEP[observed][:, None, :, :]
        best = options.max(axis=2)
        if step == 0:
            first = _FIRST[observed][:, None, :] + score[:active, :, :1]
            best = np.where(starts[:active, None, None], first, best)
        if visit is not None:
            visit(step, active, options)
        score[:active] = best
    return score


@F.pandas_udf(LONGS)
def _chunk_product(codes: pd.Series, starts: pd.Series) -> pd.Series:
    """Max-plus product of the events of a chunk, as nine numbers by (from, to)."""
    table, order, _, running = _batches(codes)
    entry = np.full((len(codes), 3, 3), NEVER)
    entry[:, np.arange(3), np.arange(3)] = 0
    product = _scores(table, running, entry, starts.to_numpy()[order])
    result = np.empty_like(product)
    result[order] = product
    return pd.Series(list(result.reshape(len(codes), 9)))


def _decode(codes, starts, entry, ends=None):
    """Per chunk, the state before it and after each event for each given end state."""
    table, order, lengths, running = _batches(codes)
    came_from = np.zeros((len(codes), table.shape[1], 3), dtype=np.int8)

    def visit(step, active, options):
        came_from[:active, step] = options[:, 0].argmax(axis=1)

    first = np.array(entry.tolist(), dtype=np.int64)[order][:, None, :]
    final = _scores(table, running, first, starts.to_numpy()[order], visit)[:, 0]
    rows = np.arange(len(codes))
    if ends is None:
        state = np.tile(np.arange(3), (len(codes), 1))
        path = None
    else:
        state = ends.to_numpy()[order][:, None]
        path = np.zeros((len(codes), table.shape[1]), dtype=np.int8)
    for step in range(table.shape[1] - 1, -1, -1):
        alive = rows[: running[step]]
        if path is not None:
            path[alive, step] = state[alive, 0]
        state[alive] = np.take_along_axis(came_from[alive, step], state[alive], axis=1)
    return order, lengths, state, path, final


@F.pandas_udf(INTS)
def _chunk_back(codes: pd.Series, starts: pd.Series, entry: pd.Series) -> pd.Series:
    """State before the chunk for each state after it, and the best state after it."""
    order, _, state, _, final = _decode(codes, starts, entry)
    result = np.empty((len(codes), 4), dtype=np.int32)
    result[order] = np.column_stack([state, final.argmax(axis=1)])
    return pd.Series(list(result))


@F.pandas_udf(INTS)
def _chunk_states(codes: pd.Series, starts: pd.Series, entry: pd.Series, ends: pd.Series) -> pd.Series:
    order, lengths, _, path, _ = _decode(codes, starts, entry, ends)
    result = [None] * len(codes)
    for row, position in enumerate(order):
        result[position] = path[row, : lengths[row]].astype(np.int32)
    return pd.Series(result)


@F.pandas_udf(LONGS)
def _product(products: pd.Series) -> pd.Series:
    """Product of a bounded list of products, its best entry kept at 0."""
    result = []
    for matrices in products:
        total = matrices[0].reshape(3, 3)
        for matrix in matrices[1:]:
            total = (total[:, :, None] + matrix.reshape(3, 3)[None, :, :]).max(axis=1)
            total = np.maximum(total - total.max(), NEVER)
        result.append(total.reshape(9))
    return pd.Series(result)


@F.pandas_udf(T.ArrayType(LONGS))
def _entries(products: pd.Series, entry: pd.Series) -> pd.Series:
    """Entry scores of each child, from those of the node above; the best is kept at 0."""
    result = []
    for matrices, score in zip(products, entry):
        scores = []
        for matrix in matrices:
            scores.append(score)
            score = (score[:, None] + matrix.reshape(3, 3)).max(axis=0)
            score = np.maximum(score - score.max(), NEVER)
        result.append(scores)
    return pd.Series(result)


@F.pandas_udf(INTS)
def _compose(maps: pd.Series) -> pd.Series:
    """Composition of a bounded list of back-tracking maps; the last one's best state."""
    result = []
    for chunk_maps in maps:
        state = np.arange(3)
        for back in chunk_maps[::-1]:
            state = back[:3][state]
        result.append(np.append(state, chunk_maps[-1][3]).astype(np.int32))
    return pd.Series(result)


@F.pandas_udf(INTS)
def _ends(maps: pd.Series, end: pd.Series) -> pd.Series:
    """End state of each child, from the end state of the node above."""
    result = []
    for chunk_maps, state in zip(maps, end):
        states = []
        for back in chunk_maps[::-1]:
            states.append(state)
            state = back[state]
        result.append(np.array(states[::-1], dtype=np.int32))
    return pd.Series(result)


def _parents(nodes: DataFrame, value: str, combine, fan_out: int) -> DataFrame:
    """Nodes one level up: ordered children, their values, and the combined value."""
    grouped = nodes.groupBy("username", F.floor(F.col("node") / fan_out).alias("node")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("node").alias("child"), value))).alias("c")
    )
    return grouped.select(
        "username",
        "node",
        F.col("c.child").alias("children"),
        F.col(f"c.{value}").alias("parts"),
        combine(F.col(f"c.{value}")).alias(value),
    )


def _sweep(leaves: DataFrame, value: str, combine, root, spread, result: str, fan_out, levels):
    """Combine ``value`` up the tree, then bring ``result`` down to the leaves."""
    tiers = []
    nodes = leaves
    for _ in range(levels):
        nodes = _parents(nodes, value, combine, fan_out)
        tiers.append(nodes)
    down = nodes.select("username", "node", root(F.col(value)).alias(result))
    for tier in reversed(tiers):
        placed = F.explode(F.arrays_zip("children", F.col("_r")))
        down = (
            tier.join(down, ["username", "node"])
            .withColumn("_r", spread(F.col("parts"), F.col(result)))
            .select("username", placed.alias("z"))
            .select("username", F.col("z.children").alias("node"), F.col("z._r").alias(result))
        )
    return down


def _decoded(events: DataFrame, fan_out: int, keep: list[str]) -> DataFrame:
    """Chunks with the state after each of their events, and the event columns to keep."""
    chunks = _chunks(user_observations(events), fan_out, keep)
    bounds = chunks.groupBy("username").agg(
        F.min("node").alias("_head"), F.sum(F.size("rows")).alias("_events")
    )
    highest = chunks.agg(F.max("node")).first()[0] or 0
    levels = 0
    while highest > 0:
        highest //= fan_out
        levels += 1
    codes = chunks.join(bounds, "username").select(
        "username",
        "node",
        "rows",
        "_events",
        F.col("rows.observation").alias("codes"),
        (F.col("node") == F.col("_head")).alias("starts"),
    )
    long = codes.filter(F.col("_events") > 1)
    entry = _sweep(
        long.select("username", "node", _chunk_product("codes", "starts").alias("product")),
        "product",
        _product,
        lambda _: F.array(*[F.lit(v).cast("long") for v in (0, NEVER, NEVER)]),
        _entries,
        "entry",
        fan_out,
        levels,
    )
    scored = store(
        long.join(entry, ["username", "node"]).withColumn(
            "back", _chunk_back("codes", "starts", "entry")
        )
    )
    ends = _sweep(
        scored.select("username", "node", "back"),
        "back",
        _compose,
        lambda back: F.element_at(back, 4),
        _ends,
        "end",
        fan_out,
        levels,
    )
    decoded = scored.join(ends, ["username", "node"]).select(
        "username", "rows", _chunk_states("codes", "starts", "entry", "end").alias("states"), "node"
    )
    # A single event is no sequence: the user counts as normal.
    single = codes.filter(F.col("_events") == 1).select(
        "username", "rows", F.array(F.lit(0)).alias("states"), "node"
    )
    return decoded.unionByName(single)


def _state_name(code):
    return F.element_at(F.array(*map(F.lit, STATES)), code + 1)


def user_state_path(events: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """Most likely state after every event of every known user, one row per event."""
    return (
        _decoded(events, fan_out, EVENT_ORDER)
        .select("username", F.explode(F.arrays_zip("rows", "states")).alias("z"))
        .select(
            "username",
            *[F.col(f"z.rows.{c}").alias(c) for c in EVENT_ORDER],
            F.col("z.rows.observation").alias("observation"),
            _state_name(F.col("z.states")).alias("state"),
        )
    )


def user_profiles(events: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """Event count, time in each risky state, last state and risk of every known user."""

    def share(state):
        return F.sum(F.size(F.filter("states", lambda s: s == STATES.index(state))))

    weighted = sum((F.col(s.lower()) * risk for s, risk in STATE_RISK.items()), F.lit(0.0))
    risk = round_half_even(weighted / F.col("event_count"), 3)
    return (
        _decoded(events, fan_out, [])
        .groupBy("username")
        .agg(
            F.sum(F.size("states")).alias("event_count"),
            *[share(s).alias(s.lower()) for s in STATE_RISK],
            F.max_by(F.element_at("states", -1), "node").alias("_last"),
        )
        .select(
            "username",
            "event_count",
            *[s.lower() for s in STATE_RISK],
            _state_name(F.col("_last")).alias("current_state"),
            F.when(F.col("event_count") < 2, SHORT_RISK).otherwise(risk).alias("risk"),
        )
    )
