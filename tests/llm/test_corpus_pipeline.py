"""The pipeline's stages on a small corpus with known outcomes."""

import corpus_pipeline as pipeline


def stages(spark, docs):
    results = [docs]
    for _, stage in pipeline.STAGES:
        results.append(stage(spark, results[-1], ""))
    return results


def prose(seed, n=80):
    return " ".join(f"the {chr(97 + (seed * 7 + i * 3) % 26)}{seed}x{i} of" for i in range(n))


def test_stages(spark):
    shared = "a line that several documents share word for word"
    rows = [(i, f"{prose(i)}\n{shared}", "en", "s", 0) for i in range(4)]
    rows += [
        (10, prose(20), "en", "s", 0), (11, prose(20) + " end", "en", None, 0), (12, "too short", "en", "s", 0),
        (13, None, None, None, None), (14, prose(30) + " write to a.b@c.org now", "en", "s", 0), (None, prose(20), "en", "s", 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    raw, good, lines, single, clean, packed = stages(spark, docs)
    ids = lambda frame: sorted((r.doc_id for r in frame.collect()), key=str)
    assert [f.columns for f in (good, lines, single, clean)] == [docs.columns] * 4
    assert ids(good) == sorted([0, 1, 2, 3, 10, 11, 14, None], key=str)
    assert {r.doc_id for r in lines.collect() if shared in r.text} == {3}
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    assert ids(single) == sorted([0, 1, 2, 3, 10, 14, None], key=str)
    assert {r.text[-20:] for r in clean.collect() if r.doc_id == 14} == {"write to <EMAIL> now"}
    assert {r.doc_id for r in packed.collect()} == {0, 1, 2, 3, 10, 14, None}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert stages(spark, docs)[-1].count() == 0
