"""Language spans: paths against plain dynamic programming, scripts, held-out accuracy, odd rows."""

import random

import numpy as np
import pytest

from logsleuth.llm import language, texts
from logsleuth.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def path_value(scores, labels, switch):
    return sum(scores[t, l] for t, l in enumerate(labels)) - switch * int((np.diff(labels) != 0).sum())


def plain_viterbi(scores, switch):
    value = scores[0].astype(float)
    for row in scores[1:]:
        value = np.maximum(value, value.max() - switch) + row
    return value.max()


def test_best_paths():
    rng = np.random.default_rng(5)
    for _ in range(300):
        k, sizes = rng.integers(1, 5), rng.integers(0, 9, rng.integers(1, 7))
        edges = np.append(0, np.cumsum(sizes))
        scores = rng.integers(-4, 5, (edges[-1], k)).astype(np.float32)
        if rng.random() < 0.5:  # one language mostly
            scores[:, 0] += 3
        labels = language.best_paths(scores, edges, 3.0)
        for a, b in zip(edges, edges[1:]):
            if b > a:
                assert path_value(scores[a:b], labels[a:b], 3.0) == plain_viterbi(scores[a:b], 3.0)


def test_scripts():
    names = language._NAMES
    for char, script in zip("aÉжΩ漢かカ한अไא٣", "Latin Latin Cyrillic Greek Han Kana Kana Hangul Devanagari Thai Hebrew Arabic".split()):
        part = np.frombuffer(char.encode(), np.uint8)
        assert language.letter_scripts(part, np.array([0])).tolist() == [1 << names.index(script)], char
    for char in "5—•×\U0001f600":
        part = np.frombuffer(char.encode(), np.uint8)
        assert language.letter_scripts(part, np.array([0])).tolist() == [0], char


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    words = {
        "aa": "the house stands near a river where children play after school".split(),
        "bb": "das haus steht nahe am fluss wo kinder nach der schule spielen".split(),
        "ru": "дом стоит у реки где дети играют после школы".split(),
    }
    rows = [(i, " ".join(rng.choices(words[l], k=30)), l) for i, l in enumerate(list(words) * 60)]
    return words, spark.createDataFrame(rows, "doc_id long, text string, lang string")


def predicted(spark, model, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, score double, spans int").repartition(2)
    return language.languages(frame, model).collect()


def test_spans_and_odd_rows(spark, corpus):
    words, docs = corpus
    model = language.fit(docs)
    assert model.languages == ["aa", "bb", "ru"]
    mixed = " ".join(words["aa"] + words["bb"] + words["ru"] + words["bb"])
    texts_ = [None, "", "12 34 — 5", "\n \t", "漢字 かな", mixed, "x" * 5000, "the house", "the house"]
    rows = [(i if i < 7 else None, t, "zz", 0.0, 1) for i, t in enumerate(texts_)]
    found = {r.doc_id: r for r in predicted(spark, model, rows)}
    assert [found[i].lang_pred for i in range(4)] == ["und"] * 4 and [found[i].score for i in range(4)] == [0.0] * 4
    assert found[4].lang_pred in model.languages and found[4].score == 0.0 and found[4].spans == []
    a, b, r = (len(words[x]) for x in ("aa", "bb", "ru"))
    edges = [0, a, a + b, a + b + r, a + 2 * b + r]
    assert [(s.lang, s.first, s.last) for s in found[5].spans] == [
        (l, x, y - 1) for l, x, y in zip(("aa", "bb", "ru", "bb"), edges, edges[1:])
    ]
    assert found[5].lang_pred == "bb" and 0 < found[5].score < 1
    assert found[None].lang_pred == "aa" and len(predicted(spark, model, rows)) == len(rows)


def test_long_texts_in_stretches(spark, corpus, monkeypatch):
    words, docs = corpus
    model = language.fit(docs)
    text = " ".join((words["aa"] * 3 + words["ru"] * 2) * 20)
    whole = language.languages(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    part, starts, lengths, _ = texts.word_places(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
    want = model.word_scores(part, starts, lengths)[0]
    got = []
    for _, edges, _ in texts.stretches(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]), 100):
        part, starts, lengths, _ = texts.word_places(np.frombuffer(text.encode(), np.uint8), edges)
        got.append(model.word_scores(part, starts, lengths)[0])
    assert len(got) > 10 and np.array_equal(np.concatenate(got), want)
    assert len(whole.spans) == 40


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = language.fit(empty)
    assert model.languages == [] and language.languages(empty, model).count() == 0
    one = spark.createDataFrame([(1, "the house")], "doc_id long, text string")
    assert language.languages(one, model).first()["lang_pred"] == "und"


def test_held_out_accuracy(spark):
    found = QUERIES["op11_language"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = found.join(docs, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and len(held) > 200
    assert sum(r.lang == r.lang_pred for r in held) >= 0.99 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
