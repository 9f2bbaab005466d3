"""Filter audit: diagrams against counting by mask, and whole results against plain Python."""

import collections
import itertools
import random
import re

from checks.compare import compare, duck
from logsleuth.llm import filter_audit
from logsleuth.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def test_plain_changes():
    for n in range(6):
        order, seen = list(range(n)), [tuple(range(n))]
        for at in filter_audit.plain_changes(n):
            order[at : at + 2] = order[at + 1], order[at]
            seen.append(tuple(order))
        assert sorted(seen) == sorted(itertools.permutations(range(n)))


def counted(counts, order):
    """Variable, kept and removed of each step by looking at all masks."""
    left = dict(counts)
    for v in order:
        gone = {m: c for m, c in left.items() if m >> v & 1}
        left = {m: c for m, c in left.items() if not m >> v & 1}
        add = lambda rows: tuple(map(sum, zip(*rows.values()))) if rows else (0, 0)
        yield v, add(left), add(gone)


def test_diagram():
    rng = random.Random(4)
    for _ in range(40):
        n = rng.randint(1, 5)
        masks = rng.sample(range(1 << n), rng.randint(0, 1 << n))
        counts = {m: (rng.randint(1, 3), rng.randint(0, 1)) for m in masks}
        diagram = filter_audit.Diagram(counts, n, 2)
        for _ in filter_audit.orders_of(diagram):
            assert list(diagram.passing()) == list(counted(counts, diagram.order))
            fresh = filter_audit.Diagram(
                {sum((m >> v & 1) << i for i, v in enumerate(diagram.order)): c for m, c in counts.items()}, n, 2
            )
            # Nothing is kept twice, and nothing that is not needed.
            assert [len(x) for x in diagram.levels] == [len(x) for x in fresh.levels]
        wanted = list(itertools.permutations(range(n)))[:: max(1, n)]
        for order, _ in zip(wanted, filter_audit.orders_of(diagram, wanted)):
            assert diagram.order == list(order)


def brute(docs, labels):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    first = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    rows = collections.defaultdict(list)
    for doc_id, text, part in docs:
        text = text or ""
        w = words(text)
        fails = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": doc_id is not None and doc_id > first[text],
        }
        own = [x for x in labels if x[0] == doc_id and doc_id is not None]
        rows[part or ""].append((fails, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = []
    for part, mine in rows.items():
        shapley, steps = collections.Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[0][f]]
                left = [r for r in left if not r[0][f]]
                failing = sum(r[0][f] for r in mine)
                alone = sum(r[0][f] and sum(r[0].values()) == 1 for r in mine)
                shapley[f] += len(gone)
                good, toxic = sum(r[1] for r in gone), sum(r[2] for r in gone)
                steps.append((f, "".join(order), step, len(left), len(gone), failing - len(gone), alone, good, toxic))
        out += [(part, *s[1:], shapley[s[0]]) for s in steps]
    return sorted(out)


def test_odd_rows(spark):
    rng = random.Random(6)
    texts = [None, "", " \n", "A B c", "few # words", "z" * 4000, "same word " * 400, "\x0b".join(f"w{i}" for i in range(60)), "É é " * 30]
    docs = [(rng.choice([None, *range(25)]), rng.choice(texts), rng.choice(["a", "b", None, ""])) for _ in range(200)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(20), 3, 4, None, None]]
    frame = spark.createDataFrame(
        [(*d, 1, True, 2) for d in docs], "doc_id long, text string, source string, mask int, good boolean, n int"
    ).repartition(3)
    marks = spark.createDataFrame([(*x, "s") for x in labels], "doc_id long, quality int, toxic int, source string")
    got = sorted(map(tuple, filter_audit.filter_audit(frame, marks).collect()))
    assert got == brute(docs, labels)


def test_chosen_orders_and_split_copies(spark, monkeypatch):
    monkeypatch.setattr("logsleuth.operators.distribute.HOT_ROWS", 5)
    docs = [(i, "one two three" if i % 3 else f"text {i}", "s") for i in range(90)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    masks = filter_audit.failure_masks(frame, marks)
    got = [tuple(r)[1:5] for r in filter_audit.audit(masks, "ABCDE", ["EABCD"]).collect()]
    assert sorted(got) == [("EABCD", 1, 31, 59), ("EABCD", 2, 0, 31), ("EABCD", 3, 0, 0), ("EABCD", 4, 0, 0), ("EABCD", 5, 0, 0)]


def test_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(docs, marks).count() == 0


def test_sql(spark):
    assert compare(spark, duck(SF), SF, QUERIES["op13_filter_audit"], ORACLE["op13_filter_audit"]) is None
