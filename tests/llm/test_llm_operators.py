"""The numbered operators against brute force, with nulls, repeated rows and clashing columns."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.compare import compare, duck
from logsleuth.llm import bpe, embedding_dedup, license_scan, line_dedup, minhash, packing, pii, quality, token_counts, toxicity
from logsleuth.llm.queries import ORACLE, QUERIES, VOCABULARY

SF = "/root/testdata/sf0.001"
ODD = [
    (1, None), (2, ""), (3, "a b c d e"), (3, "a b c d e"), (None, "one two three four five six"),
    (4, "don't  stop\n\n\tnow <|endoftext|> é x \U0001f600 " * 3), (5, "x" * 5000), (6, "word " * 3000),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, 7, 8, 9, 10) for i, t in ODD]
    names = "doc_id long, text string, ids int, n_words int, n_lines int, length int"
    return spark.createDataFrame(rows, names).repartition(2)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def full_ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    assert compare(spark, duck(SF), SF, QUERIES[name], ORACLE[name]) is None


def test_bpe_equals_the_whole_text_encoder(tokenizer):
    vocabulary = bpe.vocabulary(VOCABULARY)
    rng = random.Random(1)
    parts = ["a", "'s", "'", "s", " ", "  ", "\n", "é", "1", "23", ".", "!!", "<|endoftext|>", "<|", "中", "\u0085", "I'LL", "²", "́"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        ids = vocabulary.encode_text(text)
        assert np.frombuffer(ids, "<u4").tolist() == full_ids(tokenizer, text), text
        assert vocabulary.decode(ids) == text


def test_bpe_query(spark, tokenizer, docs, odd):
    got = {r.doc_id: r for r in QUERIES["op1_bpe"](spark, SF).collect()}
    for r in docs.collect():
        ids = full_ids(tokenizer, r.text)
        raw = np.array(ids, "<u4").tobytes()
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(raw).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    again = bpe.decode(bpe.encode(odd, VOCABULARY), VOCABULARY).select("doc_id", "text").collect()
    assert sorted(map(str, again)) == sorted(str(type(again[0])(doc_id=i, text=t or "")) for i, t in ODD)


def test_token_counts(tokenizer, docs, odd):
    for frame in (docs.limit(60), odd):
        rows = frame.select("doc_id", "text").collect()
        got = collections.Counter()
        for r in token_counts.token_counts(frame, VOCABULARY).collect():
            got[r.doc_id, r.section] += r.n_tokens
        want = collections.Counter()
        for r in rows:
            text = r.text or ""
            for line in range(text.count("\n") + 1):
                want[r.doc_id, line] += 0
            for a, _ in tokenizer.encode(text, add_special_tokens=False).offsets:
                want[r.doc_id, text.count("\n", 0, a)] += 1
        assert got == want


def test_token_rules():
    starts, ends = np.array([0, 3, 5]), np.array([3, 5, 9])
    lows, highs = np.array([0, 4]), np.array([4, 9])
    rules = {r: token_counts.attribute(starts, ends, lows, highs, r).tolist() for r in token_counts.RULES}
    assert rules["start"] == [2, 1] and rules["end"] == [1, 2]
    assert rules["middle"] == [2, 1] and rules["split"] == [1.5, 1.5]


def test_packing(spark, tokenizer, docs, odd):
    limits = packing.Limits(tokens=64, segments=3, loss=50, min_cut=4, window=16)
    rows = docs.limit(80).union(odd.filter("doc_id > 3").select("doc_id", F.col("text")))
    texts = {r.doc_id: r.text for r in rows.collect()}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
    pieces = packing.pack(bpe.encode(frame, VOCABULARY), limits).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append((p.start, p.ids))
        by_sequence[p.sequence_id].append((p.offset, p.length))
    assert {d: b"".join(x for _, x in sorted(v)) for d, v in by_doc.items()} == {
        d: np.array(full_ids(tokenizer, t) + [0], "<u4").tobytes() for d, t in texts.items()
    }
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= 50 and len(own) <= 3


def test_packing_masks(spark):
    ids = np.arange(90, dtype="<u4").tobytes()
    mask = packing.instruction_mask(["user", "assistant"], [50, 40])
    frame = spark.createDataFrame([(1, ids, mask), (2, None, None)], "doc_id long, ids binary, mask binary")
    pieces = packing.pack(frame, packing.Limits(tokens=64, loss=10, min_cut=1), mask="mask", end_id=None).collect()
    spans = collections.defaultdict(int)
    for p in pieces:
        spans[p.sequence_id] += sum(mask[p.start : p.start + p.length])
    assert max(spans.values()) <= 10 and sum(p.length for p in pieces) == 90
    assert all(zlib.crc32(p.ids) == zlib.crc32(ids[4 * p.start : 4 * (p.start + p.length)]) for p in pieces)


def test_pii_base_patterns():
    def plain(text):
        found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
            found += [(m.start(), 1, m.end())] * all(int(x) <= 255 for x in m.group().split("."))
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
            digits = re.sub("[^0-9]", "", m.group())
            found += [(m.start(), 2, m.end())] * (12 <= len(digits) <= 19 and pii.luhn(digits))
        for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
            found += [(m.start(), 3, m.end())] * (9 <= len(re.sub("[^0-9]", "", m.group())) <= 15)
        return sorted(found)

    rng = random.Random(5)
    parts = ["a", "@", ".", "1", "255", "300", "-", " ", "+", "(", "b.c", "4111111111111111", "é", "0", "٣", "\n", "12.34.56.78"]
    for _ in range(5000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert pii.base_spans(text) == plain(text), text


def test_pii_field_and_redaction(spark, nothing, odd):
    train = [(i, f"und das token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\" ist hier {i}.\nAKIA{i:016d} x") for i in range(80)]
    frame = spark.createDataFrame(train, "doc_id long, text string")
    field = pii.fit(frame)
    secret = hashlib.sha1(b"new").hexdigest()
    text = f"ein token = \"{secret}\" mail a.b@c.de end"
    row = pii.redact(spark.createDataFrame([(1, text, 5)], "doc_id long, text string, spans int"), field).first()
    assert row.text == 'ein token = "<SECRET>" mail <EMAIL> end' and row.spans == 5
    assert pii.personal_data(nothing, pii.fit(nothing)).count() == 0
    assert pii.personal_data(odd, field).count() == len(ODD)


def test_line_dedup_is_reversible(spark, odd):
    line = "this line is long enough to count"
    rows = [(i, f"own {i}\n  {line.upper()} \n{line}") for i in range(1, 6)] + [(9, None), (None, line)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    whole = line_dedup.LineIndex.build(frame)
    first = line_dedup.LineIndex.build(frame.filter("doc_id < 3")).insert(frame.filter("doc_id is null or doc_id >= 3"))
    state = lambda index: sorted(map(tuple, index.droppable().collect()))
    assert state(first) == state(whole) and len(state(whole)) == 5
    less = whole.delete(spark.createDataFrame([(5,), (4,), (77,)], "doc_id long"))
    assert state(less) == state(line_dedup.LineIndex.build(frame.filter("doc_id is null or doc_id not in (4, 5)")))
    assert state(less.delete(spark.createDataFrame([(3,), (None,)], "doc_id long"))) == []
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_lines(frame, whole).collect()}
    assert got[1] == ("own 1", 3, 2) and got[5][2] == 0 and got[9] == ("", 1, 0) and got[None] == ("", 1, 1)
    assert line_dedup.drop_lines(odd, line_dedup.LineIndex.build(odd)).count() == len(ODD)


def folder_bytes(spark):
    from pathlib import Path

    folder = Path(line_dedup.store(spark.range(1)).inputFiles()[0].removeprefix("file:")).parent.parent
    return sum(p.stat().st_size for p in folder.rglob("*.parquet"))


def test_line_index_writes_what_changes(spark):
    """One document more or less is a small part of an index of many, and compaction keeps the result."""
    texts = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.concat(F.lit("a line of some length "), (F.col("id") * 13 % 997 + i).cast("string"))), "\n")
    many = spark.range(3_000).select(F.col("id").alias("doc_id"), texts.alias("text"))
    before = folder_bytes(spark)
    index = line_dedup.LineIndex.build(many)
    whole = folder_bytes(spark) - before
    one = spark.createDataFrame([(5_000, "a line of some length 7\nquite another line, and a new one")], "doc_id long, text string")
    before = folder_bytes(spark)
    more = index.insert(one)
    less = more.delete(one)
    assert folder_bytes(spark) - before < whole / 3 and less.changes == 2
    state = lambda x: sorted(map(tuple, x.droppable().collect()))
    kept = state(index)
    assert state(less) == kept and state(more) == state(line_dedup.LineIndex.build(many.union(one)))
    for _ in range(line_dedup.COMPACT // 2):
        less = less.insert(one).delete(one)
    assert less.changes < line_dedup.COMPACT and state(less) == kept


def test_filters_too_large_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(line_dedup, "GROUP_ROWS", 7)
    rows = [(i, f"shared by every document here\nshared by a third of them {i % 3}\nown line number {i} of this") for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    index = line_dedup.LineIndex.build(frame)
    got = collections.Counter(r.doc_id for r in index.droppable().collect())
    assert got == {i: 2 if i < 57 else 1 for i in range(59)}


def test_line_dedup_beside_any_columns(spark):
    rows = [(i, "the same line in all of them", "x", i, 1) for i in range(4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _drops string, _DOC long, n_lines int")
    found = line_dedup.drop_lines(frame, line_dedup.LineIndex.build(frame)).collect()
    assert sorted((r.doc_id, r.text, r._drops, r._DOC, r.n_dropped) for r in found) == [
        (0, "", "x", 0, 1), (1, "", "x", 1, 1), (2, "", "x", 2, 1), (3, rows[3][1], "x", 3, 0),
    ]


def test_line_index_grows(spark):
    """More repeated keys than one filter has slots, put into an empty index."""
    line = F.concat(F.lit("a line that is long enough "), F.col("id").cast("string"))
    text = spark.range(41_000).agg(F.array_join(F.collect_list(line), "\n").alias("text"))
    frame = spark.range(1, 4).withColumnRenamed("id", "doc_id").crossJoin(text)
    index = line_dedup.LineIndex.empty(spark).insert(frame)
    assert index.shards == 3 and index.filters.count() == 3
    drops = index.droppable().groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in drops} == {1: 41_000, 2: 41_000}
    assert index.delete(frame.filter("doc_id = 2")).droppable().count() == 0


def test_cuckoo_filter():
    keys = np.random.default_rng(0).integers(0, 1 << 63, (9000, 2)).astype(np.uint64)
    cuckoo = line_dedup.Cuckoo(6000)
    assert cuckoo.insert(keys[:6000]) and cuckoo.contains(keys[:6000]).all()
    cuckoo.delete(keys[:3000])
    assert cuckoo.contains(keys[3000:6000]).all() and cuckoo.contains(keys[6000:]).mean() < 0.01
    assert cuckoo.contains(keys[:3000]).mean() < 0.01


def test_license_scan(docs, odd):
    phrases = {tuple(k.split()): v for k, v in license_scan.PHRASES.items()}
    for frame in (docs, odd.select("doc_id", "text")):
        want = []
        for r in frame.collect():
            text = "".join(c.lower() if c.isascii() else c for c in r.text or "")
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
            at = [(i, v) for p, v in phrases.items() for i in range(len(words)) if tuple(words[i : i + len(p)]) == p]
            starts = [i for i, _ in at]
            want.append((r.doc_id, len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({v for _, v in at}))))
        got = license_scan.license_scan(frame).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_license_passages(spark):
    text = "x y " + license_scan.PASSAGES["mit"].replace("free of charge", "gratis") + " tail. Under the MIT license. CC BY-NC"
    got = license_scan.license_scan(spark.createDataFrame([(1, text), (2, "Kİ nothing")], "doc_id long, text string"))
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[1].labels == "cc-by-nc,mit" and rows[1].n_base == 2 and rows[1].score == 1.0
    passage = next(s for s in rows[1].spans if not s.base)
    assert passage.label == "mit" and passage.first == 2 and 0.6 < passage.share < 1
    assert rows[2].labels == "" and rows[2].n_words == 2


def near_classes(rows, least=0.8):
    """Brute force over all pairs; rows of (doc_id, text)."""
    import pyarrow as pa

    from logsleuth.llm.texts import shingles, text_buffer, word_hashes

    data, offsets = text_buffer(pa.array([t for _, t in rows], pa.string()))
    (hashes,), first = word_hashes(data, offsets)
    words = [hashes[a:b] for a, b in zip(first, first[1:])]
    sets = [np.unique(shingles(w, 5)).tolist() for w in words]
    counts = collections.Counter(k for own in sets for k in own)
    rarity = minhash.Similarity.rarity
    bags = [minhash.exact_bag(w, 5, np.array([counts[k] for k in own]), len(rows), rarity) for w, own in zip(words, sets)]
    own = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(words[i]) and len(words[j]) and own[i] != own[j] and minhash.weighted_jaccard(bags[i], bags[j]) >= least:
                own = [own[j] if x == own[i] else x for x in own]
    smallest = {}
    for (d, _), c in zip(rows, own):
        smallest[c] = min(d, smallest.get(c, d))
    return {d: smallest[c] for (d, _), c in zip(rows, own)}


def test_minhash(spark, docs, odd):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert got == near_classes(rows)
    rest = {(r.doc_id, r.class_id, r.kept) for r in minhash.near_duplicates(odd).collect()}
    assert rest == {(i, i, True) for i, _ in ODD}


def test_minhash_open_buckets(spark):
    """A chain of copies, each near only to some others, is one class as brute force says."""
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(1, 3)):
            words[rng.randrange(len(words))] = f"n{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = near_classes(rows)
    for heads in (3, 0):  # without any head everything is settled in blocks
        got = minhash.near_duplicates(frame, minhash.Similarity(heads=heads)).collect()
        assert {r.doc_id: r.class_id for r in got} == want


def test_minhash_counts_exactly(spark, docs, monkeypatch):
    """Rare text stays rare in two million shingles, of which a table of 2^18 buckets would hold eight in each."""
    boiler = " ".join(f"b{i}" for i in range(192))
    tail = lambda c: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda x: F.concat(c.cast("string"), F.lit("q"), x.cast("string"))), " ")
    filler = spark.range(100).select((F.col("id") + 100).alias("doc_id"), F.concat(F.lit(boiler + " "), tail(F.col("id"))).alias("text"))
    # 188 shingles of the boilerplate each; similarity 0.795 with 20 others each and 0.803 with 19.
    near = [(i, boiler + "".join(f" t{i}x{j}" for j in range(n))) for i, n in ((1, 20), (2, 20), (3, 19), (4, 19))]
    got = minhash.near_duplicates(filler.union(spark.createDataFrame(near, "doc_id long, text string"))).filter("doc_id < 100").collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == [(1, 1), (2, 2), (3, 3), (4, 3)]

    import pyarrow as pa

    from logsleuth.llm.texts import shingles

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    own = [np.unique(shingles(w, 5)) for w in minhash.word_runs(pa.array([t for _, t in rows], pa.string()))]
    counts = collections.Counter(k for x in own for k in x.tolist())
    monkeypatch.setattr(minhash, "CHUNK_BYTES", 50_000)
    monkeypatch.setattr(minhash, "PART_BYTES", 70_000)
    made, total = minhash.nodes_of(docs, minhash.Similarity())
    found = {r.doc_id: minhash.unpacked(r.df).tolist() for r in made.collect() if r.df is not None}
    assert total == len(rows) and found == {d: [counts[k] for k in x.tolist()] for (d, _), x in zip(rows, own) if len(x)}


def test_minhash_distinct_is_a_sort():
    """Distinct hashes cost a sort and a pass, not a hash table (some fifty times as long)."""
    hashes = np.random.default_rng(2).integers(0, 1 << 63, 1_000_000, dtype=np.uint64)
    hashes = np.concatenate([hashes, hashes[:1000]])

    def least(f):
        took = []
        for _ in range(5):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    assert least(lambda: minhash.distinct(hashes)) < 5 * least(lambda: np.sort(hashes))
    for some in (hashes, hashes[:1], hashes[:0], np.zeros(3, np.uint64)):
        assert minhash.distinct(some).tolist() == sorted(set(some.tolist()))


def test_toxic_segments():
    def best(seq, a, b):
        top = max(((sum(seq[i : j + 1]), i, j) for i in range(a, b) for j in range(i, b)), default=(0, 0, 0), key=lambda x: x[0])
        return [] if top[0] <= 0 else [*best(seq, a, top[1]), (top[1], top[2], top[0]), *best(seq, top[2] + 1, b)]

    rng = random.Random(3)
    for _ in range(500):
        seq = [-1 if rng.random() < 0.6 else rng.choice([2.5, 1.3, 7.7]) + rng.random() / 97 for _ in range(rng.randint(0, 14))]
        places = [i for i, x in enumerate(seq) if x > 0]
        got = toxicity.maximal_segments(places, [seq[i] for i in places], 1)
        assert [(a, b, pytest.approx(s)) for a, b, s in got] == best(seq, 0, len(seq))


def test_toxicity_held_out(spark, nothing, odd):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        words = [f"w{rng.randint(0, 300)}" for _ in range(60)]
        if toxic := i % 4 == 0:
            words[rng.randrange(60)] = f"vequ{rng.choice(['a', 'ta', 'mo'])}"
            words[rng.randrange(60)] = "scum"
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    truth = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(frame, truth)
    scored = toxicity.score(frame, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).filter("held").collect()
    assert scored and sum((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in scored) >= 0.95 * len(scored)
    assert toxicity.score(odd, model).count() == len(ODD)
    empty = toxicity.fit(nothing, truth)
    assert {r.score < 0.5 for r in toxicity.score(frame.limit(3), empty).collect()} == {True}


def test_toxicity_of_a_bounded_sample(spark):
    """A class that is cut to the bound counts as all its rows: scores stay as with all rows."""
    rng = random.Random(6)
    rows = []
    for i in range(9000):  # every toxic row and a quarter of the clean ones have the word
        words = [f"w{rng.randint(0, 300)}" for _ in range(60)]
        if i % 30 == 0 or rng.random() < 0.25:
            words[rng.randrange(60)] = "scum"
        rows.append((i, " ".join(words), int(i % 30 == 0)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    labels = frame.select("doc_id", "toxic")
    learned = dict(labels.filter(~toxicity.held_out(F.col("doc_id"))).groupBy("toxic").count().collect())
    assert learned[0] > 15 * 400 > 400 > learned[1]
    scores = []
    for sample in (toxicity.SAMPLE, 400):
        model = toxicity.fit(frame, labels, sample)
        scores.append({r.doc_id: r.score for r in toxicity.score(frame, model).collect()})
    whole, bounded = ([s[i] for i, text, _ in rows if "scum" in text] for s in scores)
    assert max(whole) < 0.5 and max(bounded) < 0.5
    assert abs(np.mean(whole) - np.mean(bounded)) < 0.2


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(40, 16))
    rows = []
    for i in range(900):
        v = centers[rng.integers(40)] + rng.normal(size=16) * rng.choice([0.02, 0.25])
        rows.append((i, [float(x) for x in np.float32(v)], int(i % 3) if i % 50 else None))
    rows += [(900, rows[5][1], rows[5][2]), (901, None, 1), (902, [0.0] * 16, 1), (903, [float("nan")] + [1.0] * 15, 1), (904, [None] * 16, 1), (905, [1.0, 2.0], 1), (None, rows[5][1], rows[5][2])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    forest = embedding_dedup.Forest(leaf=32)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_links(frame, forest).collect()}
    want = {i: (0, i, True) for i, _, _ in rows}
    for label in range(3):
        own = [(i, np.array(v, float)) for i, v, x in rows if x == label and i is not None and (i <= 900)]
        u = np.array([v / np.linalg.norm(v) for _, v in own])
        near = u @ u.T >= 0.93
        np.fill_diagonal(near, False)
        mark = np.array([i for i, _ in own])
        while True:
            following = np.minimum(mark, np.where(near, mark[None, :], 10**9).min(axis=1))
            if (following == mark).all():
                break
            mark = following
        for (i, _), n, c in zip(own, near.sum(axis=1), mark):
            want[i] = (int(n), int(c), i == c)
    assert got.keys() == want.keys()
    found, there = sum(n for n, _, _ in got.values()), sum(n for n, _, _ in want.values())
    assert 0.99 * there <= found <= there


def test_quality_edges(spark, odd):
    got = {r.doc_id: r for r in quality.quality_rules(odd).collect()}
    assert got[1].n_words == 0 and got[1].base_failed and not got[1].kept
    assert got[6].n_repeat_words == 3000 and got[6].base_failed
    text = "a b c a b c a b"  # every window of three but none besides occurs twice
    row = quality.measure(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_repeat_words == 8
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = quality.quality_rules(docs).filter("kept").select("doc_id").collect()
    assert sorted(r[0] for r in kept) == sorted(r.doc_id for r in quality.passing(docs).collect())


def test_empty_tables(spark, nothing):
    assert bpe.decode(bpe.encode(nothing, VOCABULARY), VOCABULARY).count() == 0
    assert packing.pack(bpe.encode(nothing, VOCABULARY)).count() == 0
    assert token_counts.token_counts(nothing, VOCABULARY).count() == 0
    assert license_scan.license_scan(nothing).count() == 0
    assert quality.quality_rules(nothing).count() == 0
    assert line_dedup.drop_lines(nothing, line_dedup.LineIndex.build(nothing)).count() == 0
    assert minhash.near_duplicates(nothing).count() == 0
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.embedding_links(empty).count() == 0
