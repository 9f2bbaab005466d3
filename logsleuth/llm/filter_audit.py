"""What each filter of a chain removes, in every order: decision diagrams of failure masks.

A document's failure mask has one bit for each filter it fails. Documents are counted by part
and mask; a part's counts become a decision diagram with one level for each filter, whose
inner nodes carry the counts below them and whose equal subgraphs are shared. Following the
passing edges from the root applies the filters in the order of the levels: the failing edge
of each node on that path leads to what its filter removes there. Exchanging two neighbouring
levels touches the nodes of these levels only, and a chain of such swaps visits all orders.

Every document takes part. A null text counts as empty, a null part as the empty string. A
row without an id passes the filter for copies and has no label; rows that share the smallest
id of a text all pass it. Of an id's several labels any that is set counts. Rows are counted
one by one, so repeated rows count repeatedly. An empty table has no parts and no rows.
"""

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from logsleuth.operators.distribute import skew_join, store

BLANKS = " \t\n\x0b\x0c\r"

#: What is counted: documents, those labelled good, those labelled toxic.
COUNTS = ("n", "good", "toxic")


class Diagram:
    """Counts by mask under a changing order of variables (bits of the mask).

    ``counts`` maps masks to tuples of counts of equal length. All paths have all levels;
    nodes of a level with equal children are one node. ``total`` has the counts below each
    node, ``order`` the variable of each level.
    """

    def __init__(self, counts: dict[int, tuple], variables: int, width: int = 1):
        self.order = list(range(variables))
        self.children: dict[int, tuple[int, int]] = {}
        self.total: dict[int, tuple] = {}
        self._made = 0
        tables: list[dict] = [{} for _ in range(variables + 1)]

        def build(level: int, own: dict[int, tuple]) -> int:
            if level == variables:
                value = next(iter(own.values()), (0,) * width)
                if value not in tables[level]:
                    tables[level][value] = self._new(value)
                return tables[level][value]
            if not own and () in tables[level]:
                return tables[level][()]
            sides = [{m: c for m, c in own.items() if m >> level & 1 == side} for side in (0, 1)]
            node = self._node(tables[level], *(build(level + 1, side) for side in sides))
            if not own:
                tables[level][()] = node
            return node

        self.root = build(0, counts)
        self.levels = [sorted(set(table.values())) for table in tables[:variables]]

    def _new(self, total: tuple) -> int:
        self._made += 1
        self.total[self._made] = total
        return self._made

    def _node(self, table: dict, low: int, high: int) -> int:
        node = table.get((low, high))
        if node is None:
            node = table[low, high] = self._new(tuple(map(sum, zip(self.total[low], self.total[high]))))
            self.children[node] = low, high
        return node

    def swap(self, level: int) -> None:
        """Exchange the variables of this level and the next.

        A node of the upper level keeps its meaning and its counts; its four grandchildren
        are paired the other way. Nodes above and below the two levels stay as they are.
        """
        table: dict = {}
        for node in self.levels[level]:
            low, high = self.children[node]
            (a, b), (c, d) = self.children[low], self.children[high]
            self.children[node] = self._node(table, a, c), self._node(table, b, d)
        for node in self.levels[level + 1]:
            del self.children[node], self.total[node]
        self.levels[level + 1] = list(table.values())
        self.order[level : level + 2] = self.order[level + 1], self.order[level]

    def arrange(self, order: Sequence[int]) -> None:
        """Bring the levels into ``order`` by swaps of neighbours."""
        for level, variable in enumerate(order):
            for at in range(self.order.index(variable), level, -1):
                self.swap(at - 1)

    def passing(self) -> Iterator[tuple[int, tuple, tuple]]:
        """Variable, counts kept and counts removed of each level along the passing edges."""
        node = self.root
        for variable in self.order:
            low, high = self.children[node]
            yield variable, self.total[low], self.total[high]
            node = low


def plain_changes(n: int) -> Iterator[int]:
    """Positions of the n! - 1 swaps of neighbours that visit every order of n things."""
    if n < 2:
        return
    down = True
    inner = plain_changes(n - 1)
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        at = next(inner, None)
        if at is None:
            return
        yield at + 1 if down else at
        down = not down


def orders_of(diagram: Diagram, orders: Sequence[Sequence[int]] | None = None) -> Iterator[None]:
    """Stops the diagram at each of ``orders``, or at every order there is."""
    if orders is None:
        yield
        for level in plain_changes(len(diagram.order)):
            diagram.swap(level)
            yield
    else:
        for order in orders:
            diagram.arrange(order)
            yield


def part_steps(counts: dict[int, tuple], names: str, orders=None) -> list[tuple]:
    """Rows (order, step, kept, removed, redundant, unique_fails, good, toxic, shapley) of a part."""
    failing = [sum(c[0] for m, c in counts.items() if m >> i & 1) for i in range(len(names))]
    alone = [counts.get(1 << i, (0,))[0] for i in range(len(names))]
    shapley = [0] * len(names)
    rows = []
    diagram = Diagram(counts, len(names), len(COUNTS))
    for _ in orders_of(diagram, orders):
        order = "".join(names[v] for v in diagram.order)
        for step, (v, kept, (removed, good, toxic)) in enumerate(diagram.passing(), 1):
            shapley[v] += removed
            rows.append((order, step, v, kept[0], removed, failing[v] - removed, alone[v], good, toxic))
    return [(*row[:2], *row[3:], shapley[row[2]]) for row in rows]


STEP_COLUMNS = (
    "filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def audit(masks: DataFrame, names: str, orders: Sequence[str] | None = None) -> DataFrame:
    """Steps of every order of filters, for each part.

    ``masks`` has a row for each document: part, mask (bit i: fails the filter ``names[i]``),
    good and toxic (booleans). ``orders`` defaults to all orders, which is meant for up to six
    filters; shapley adds up what a filter removes in the orders asked for. At most
    2 ** len(names) rows of counts meet in the task of a part, however many documents it has.
    """
    chosen = None if orders is None else [[names.index(x) for x in order] for order in orders]
    counted = masks.groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic")
    )

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        counts = dict(zip(rows["mask"], zip(*(rows[c] for c in COUNTS))))
        found = zip(*part_steps(counts, names, chosen))
        kinds = [pa.string(), pa.int32(), *[pa.int64()] * 7]
        columns = [pa.array(values, kind) for values, kind in zip(found, kinds)]
        part = pa.array([rows["part"][0]] * len(columns[0]), pa.string())
        fields = [c.split()[0] for c in STEP_COLUMNS.split(", ")]
        return pa.Table.from_arrays([part, *columns], ["part", *fields])

    return counted.groupBy("part").applyInArrow(run, f"part string, {STEP_COLUMNS}")


def text_failures(text: Column) -> dict[str, Column]:
    """Failure of the filters that look at one text: few words, repetition, capitals, symbols."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    words = F.split(trimmed, r"[\x20\x09-\x0D]+")
    some = trimmed != ""
    n_words = F.when(some, F.size(words)).otherwise(0)
    n_distinct = F.when(some, F.size(F.array_distinct(words))).otherwise(0)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n_words < 50,
        "B": 100 * n_distinct < 65 * n_words,
        "C": 100 * capitals > 5 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


#: The letters of the five filters, in the order of their bits; E is the filter for copies.
FILTERS = "ABCDE"


def failure_masks(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, mask, good and toxic of every document.

    ``docs`` has doc_id, text and ``part``; ``labels`` has doc_id, quality and toxic. Texts are
    read once: what is stored of each is its digest and the mask of the filters that look at it
    alone. Copies are found by digest; groups of copies too large for a task are split.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    fails = text_failures(F.col("text"))
    bits = sum((F.when(fails[name], 1 << i).otherwise(0) for i, name in enumerate(FILTERS[:4])), F.lit(0))
    facts = store(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
            text.alias("text"),
        ).select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("key"), bits.alias("bits"))
    )
    copies = store(
        facts.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter("n > 1")
    )
    marks = (
        labels.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.col("quality") == 1).alias("good"),
            (F.col("toxic") == 1).alias("toxic"),
        )
        .groupBy("doc_id")
        .agg(F.bool_or("good").alias("good"), F.bool_or("toxic").alias("toxic"))
    )
    copied = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return (
        skew_join(facts, copies, ["key"], "n", spread=("doc_id",))
        .withColumn("mask", F.col("bits") + F.when(copied, 1 << 4).otherwise(0))
        .select("doc_id", "part", "mask")
        .join(marks, "doc_id", "left")
        .select("part", "mask", *(F.coalesce(c, F.lit(False)).alias(c) for c in COUNTS[1:]))
    )


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """The five filters over ``docs``: a row for each part, order and step."""
    return audit(failure_masks(docs, labels, part), FILTERS)
