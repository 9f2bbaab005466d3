"""Resampling: checksums and weights against plain Python, ranks against a sort, odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import pyarrow as pa
import pytest

from checks.compare import compare, duck
from logsleuth.llm import resample, texts
from logsleuth.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def features_of(text):
    words = words_of(text)
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def bucket(feature, buckets):
    return zlib.crc32(feature.encode()) % buckets


@pytest.mark.parametrize("limit", [1 << 18, 40])
def test_feature_buckets(monkeypatch, limit):
    monkeypatch.setattr(texts.stretches, "__defaults__", (limit,))
    rng = random.Random(3)
    parts = ["ab", "Q", " ", "\n", ".", "é", "x" * 70, "中9", "_"]
    for _ in range(200):
        docs = [rng.choice([None, "", "a", "".join(rng.choices(parts, k=rng.randint(0, 60)))]) for _ in range(rng.randint(0, 6))]
        got = [[[], []] for _ in docs]
        for a, first, words, pairs in resample.feature_stretches(pa.array(docs, pa.string()), 97):
            for i, (low, high) in enumerate(zip(first, first[1:])):
                got[a + i][0] += words[low:high].tolist()
                got[a + i][1] += [p for p in pairs[low:high].tolist() if p >= 0]
        for text, (words, pairs) in zip(docs, got):
            assert words + pairs == [bucket(f, 97) for f in features_of(text)]


def brute(docs, target, buckets=10_000, percent=25, least=20, seed=7):
    source = collections.Counter(bucket(f, buckets) for _, t in docs for f in features_of(t))
    wanted = collections.Counter(bucket(f, buckets) for t in target for f in features_of(t))
    s, t = sum(source.values()) + buckets, sum(wanted.values()) + buckets
    rows = []
    for doc_id, text in docs:
        own = [bucket(f, buckets) for f in features_of(text)]
        gains = [math.floor(1000 * math.log((wanted[b] + 1) * s / ((source[b] + 1) * t))) for b in own]
        weight = sum(gains) // len(own) if own else 0
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        rows.append([doc_id, len(own), weight, score, None, len(words_of(text)) >= least and doc_id is not None])
    drawn = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0]))
    for rank, row in enumerate(drawn[: percent * len(drawn) // 100], 1):
        row[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=str)


def test_odd_rows(spark):
    rng = random.Random(1)
    prose = lambda n: " ".join(rng.choice("alpha beta Gamma delta épsilon 7 don't".split()) for _ in range(n))
    docs = [(i, prose(rng.randint(15, 60))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "x" * 9000), (103, "word " * 4000), (5, docs[5][1]), (5, docs[5][1]), (None, prose(50))]
    target = ["gamma delta gamma", None, "", "alpha beta " * 9]
    frame = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], "doc_id long, text string, score int, rank int, n_words int")
    aims = spark.createDataFrame([(t, 0) for t in target], "text string, doc_id int")
    for segments in (1, 5, 100):
        got = resample.resample(frame.repartition(3), aims, percent=40, segments=segments).collect()
        assert sorted(map(tuple, got), key=str) == brute(docs, target, percent=40)


@pytest.mark.parametrize("segments", [1, 3, 40])
def test_ranks_of_ties(spark, segments):
    rng = random.Random(segments)
    rows = [(rng.choice([7, 7, 7, rng.randint(0, 400)]), rng.choice([-5, 0, 0, 0, rng.randint(-9, 9)])) for _ in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, score long").repartition(7)
    got = [tuple(r) for r in resample.draw_highest(resample.store(frame), 60, segments).collect()]
    assert len(got) == len(rows)
    drawn = sorted((r for r in got if r[2] is not None), key=lambda r: r[2])
    assert [r[2] for r in drawn] == list(range(1, 1801))
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert [r[:2] for r in drawn] == want[:1800]
    assert sorted(r[:2] for r in got) == sorted(rows)


def test_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample.resample(none, none).count() == 0
    few = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    assert [r["rank"] for r in resample.resample(few, none).collect()] == [None, None]


def test_sql(spark):
    assert compare(spark, duck(SF), SF, QUERIES["op12_resample"], ORACLE["op12_resample"]) is None
