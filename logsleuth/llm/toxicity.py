"""Toxic passages: maximum-scoring segments over token log-odds.

Words and their first bytes get log-odds between toxic and clean training documents, shrunk
by a Dirichlet prior in proportion to overall frequency and taken at the lower end of their
uncertainty. Every other word costs a little. A linear scan finds all maximal scoring
segments of a document; how high the best segment of a clean document of that length gets
follows an extreme-value law, against which segments are significant. A logistic curve over
the calibrated excess gives the document's score.

Model and calibration are fitted on a bounded sample of labelled rows (``SAMPLE`` of each
class, those with the lowest hash), each class weighted back to all its rows, so that the
share of toxic rows is that of the labels whatever their number; scoring reads every text whole, in one pass without a
shuffle.
"""

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from logsleuth.llm.texts import blocks, id_and_text, shingles, text_buffer, word_hashes
from logsleuth.operators.distribute import store

#: Labelled rows of each class that are fitted on at most, and features of the model.
SAMPLE, FEATURES = 8_000, 1 << 17

#: Bytes of the word beginnings that are features besides the word.
PREFIXES = (4, 5, 6)

#: Strength of the prior in documents, deviations taken off, least log-odds that count, least
#: documents of a feature, and the cost of a word that says nothing.
PRIOR, CAUTION, LEAST_ODDS, LEAST_DOCS, COST = 20.0, 2.0, 0.7, 4, 0.1

EULER = 0.5772156649015329


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learnable(labels: DataFrame) -> DataFrame:
    """doc_id and toxic of the labels that may be learned from.

    Rows with null id or label and held-out rows do not take part; of an id's several labels
    the larger counts.
    """
    return (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )


def training_sample(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, toxic and fold of at most ``sample`` rows a class, the same on every run."""
    rows = learnable(labels).withColumn("_at", F.xxhash64("doc_id"))
    parts = [rows.filter(F.col("toxic") == y).orderBy("_at", "doc_id").limit(sample) for y in (0, 1)]
    return parts[0].unionByName(parts[1]).select("doc_id", "toxic", F.pmod("_at", F.lit(2)).cast("int").alias("fold"))


def class_weights(labels: DataFrame, sample: int = SAMPLE) -> tuple[float, float]:
    """Learnable rows of the clean and the toxic class for each row that is sampled of it."""
    rows = {r["toxic"]: r["n"] for r in learnable(labels).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    return tuple(max(1.0, rows.get(y, 0) / sample) for y in (0, 1))


def maximal_segments(places: list[int], scores: list[float], cost: float) -> list[tuple]:
    """All maximal scoring segments (first, last, score) of a sequence, in linear time.

    The sequence has ``scores`` (positive) at ``places`` and -cost everywhere else. Each
    candidate keeps the sums before and behind it; it joins the nearest earlier candidate
    with a smaller sum before it, found by following that link instead of looking again.
    """
    kept: list[list] = []  # first, last, sum before, sum behind, number of the linked one
    total, at = 0.0, 0
    for place, score in zip(places, scores):
        total -= cost * (place - at)
        own = [place, place, total, total + score, -1]
        total, at = total + score, place + 1
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= own[2]:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= own[3]:
                own[4] = j
                kept.append(own)
                break
            own[0], own[2] = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, b, high - low) for a, b, low, high, _ in kept]


class Features:
    """Weights of features by 64-bit hash, with a bitmap that most words end at."""

    BITS = 22

    def __init__(self, keys: np.ndarray, weights: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.weights = keys[order], weights[order].astype(np.float64)
        self.some = np.zeros(1 << self.BITS, bool)
        self.some[self._bit(self.keys)] = True

    @classmethod
    def _bit(cls, keys):
        return (keys >> np.uint64(64 - cls.BITS)).astype(np.int64)

    def best(self, hashes: list[np.ndarray]) -> np.ndarray:
        """Largest weight among the features of each word, 0 without any."""
        best = np.zeros(len(hashes[0]))
        for own in hashes:
            near = np.flatnonzero(self.some[self._bit(own)])
            if len(near) and len(self.keys):
                found = np.minimum(np.searchsorted(self.keys, own[near]), len(self.keys) - 1)
                hit = self.keys[found] == own[near]
                np.maximum.at(best, near[hit], self.weights[found[hit]])
        return best


def feature_hashes(data, offsets):
    """Hashes of words and of their beginnings; beginnings differ from equal words."""
    hashes, first = word_hashes(data, offsets, PREFIXES)
    return [h ^ np.uint64(0xA5A5 * i) for i, h in enumerate(hashes)], first


def one_of_copies(train: DataFrame) -> DataFrame:
    """Training rows, one of those that share their least shingle, stored.

    Copies of a toxic document would make its rare words look like evidence.
    """

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            keys = []
            for a, b in blocks(offsets):
                (words,), first = word_hashes(data, offsets[a : b + 1])
                for low, high in zip(first, first[1:]):
                    keys.append(int(shingles(words[low:high], 5).min()) >> 1 if high > low else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], [*batch.schema.names, "key"])

    schema = T.StructType([*train.schema.fields]).add("key", "long")
    rows = store(train.mapInArrow(run, schema))
    first = F.broadcast(rows.groupBy("key").agg(F.min("doc_id").alias("doc_id")))
    return rows.join(first, ["key", "doc_id"], "left_semi").select("text", "toxic", "fold")


def count_features(train: DataFrame) -> DataFrame:
    """Training documents with each feature, by class and fold."""

    def run(batches):
        tables = {}
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            kinds = list(zip(batch.column("toxic").to_pylist(), batch.column("fold").to_pylist()))
            for a, b in blocks(offsets):
                hashes, first = feature_hashes(data, offsets[a : b + 1])
                for i in range(a, b):
                    low, high = first[i - a], first[i - a + 1]
                    own = np.unique(np.concatenate([h[low:high] for h in hashes]))
                    tables.setdefault(kinds[i], []).append(own)
        for (toxic, fold), parts in tables.items():
            keys, counts = np.unique(np.concatenate(parts), return_counts=True)
            for at in range(0, len(keys), 100_000):
                n = len(keys[at : at + 100_000])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[at : at + n].view(np.int64)), pa.array(np.full(n, 2 * toxic + fold, np.int32)), pa.array(counts[at : at + n])],
                    ["feature", "kind", "n"],
                )

    rows = train.mapInArrow(run, "feature long, kind int, n long")
    counts = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(4)]
    return rows.groupBy("feature").agg(*counts)


def cautious_log_odds(toxic: Column, clean: Column, sizes: tuple, weight: tuple = (1.0, 1.0)) -> Column:
    """Log-odds with a Dirichlet prior, less ``CAUTION`` of its deviations.

    ``sizes`` has the documents and the features (each once a document) of both classes: rates
    are shares of features, so longer documents do not make all their words suspicious.
    ``weight`` (clean, toxic) is what a sampled row of a class stands for in the prior.
    """
    (docs_toxic, docs_clean), (all_toxic, all_clean) = sizes
    w_clean, w_toxic = weight
    everything = w_toxic * all_toxic + w_clean * all_clean
    prior = PRIOR * everything / (w_toxic * docs_toxic + w_clean * docs_clean)
    rate = (toxic * w_toxic + clean * w_clean + 0.5) / (everything + 1)
    a, b = toxic + prior * rate, clean + prior * rate
    odds = F.log(a / (all_toxic + prior - a)) - F.log(b / (all_clean + prior - b))
    return odds - CAUTION * F.sqrt(1 / a + 1 / b)


@dataclass(frozen=True)
class Calibration:
    """Extreme-value law of clean documents and the logistic curve over the excess."""

    rate: float
    size: float
    curve: tuple

    def excess(self, score: float, words: int) -> float:
        return self.rate * score - math.log(self.size * max(words, 1))

    def document(self, segments: list[tuple], words: int) -> tuple[float, list[tuple]]:
        """Score of a document and its significant segments (first, last, score, p)."""
        found = []
        for first, last, score in segments:
            p = -math.expm1(-math.exp(min(-self.excess(score, words), 50)))
            if p < 0.05:
                found.append((first, last, score, p))
        x = curve_inputs(self, [s[2] for s in segments], len(found), words)
        t = sum(c * v for c, v in zip(self.curve, x))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, t)))), found


def curve_inputs(law, scores: list[float], significant: int, words: int) -> tuple:
    best = law.excess(max(scores, default=0.0), words)
    return 1.0, max(-10.0, min(30.0, best)), math.log1p(significant)


def extreme_value_law(best: np.ndarray, words: np.ndarray) -> tuple[float, float]:
    """Rate and size of the law by moments: rate * best - log(size * words) is Gumbel."""
    rate = 1.0
    if len(best) < 2:
        return rate, 1.0
    logs = np.log(np.maximum(words, 1))
    for _ in range(30):
        spread = float(np.std(best - logs / rate))
        rate = min(10.0, max(0.2, math.pi / (math.sqrt(6) * max(spread, 1e-6))))
    return rate, math.exp(float(np.mean(rate * best - logs)) - EULER)


def logistic_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple:
    """Weighted logistic regression with a small ridge, by Newton steps."""
    c = np.zeros(x.shape[1])
    ridge = np.diag([1e-3] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge @ c
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(bend, slope)
        c = c + step / max(1.0, float(np.abs(step).max()) / 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in c)


@dataclass(frozen=True)
class ToxicityModel:
    keys: np.ndarray
    weights: np.ndarray
    calibration: Calibration


def _segments(features: Features, data, offsets, a, b):
    """Segments and number of words of each document of a block."""
    hashes, first = feature_hashes(data, offsets[a : b + 1])
    weights = features.best(hashes)
    hits = np.flatnonzero(weights > 0)
    where = np.searchsorted(hits, first)
    for i in range(b - a):
        own = hits[where[i] : where[i + 1]]
        yield maximal_segments((own - first[i]).tolist(), weights[own].tolist(), COST), int(first[i + 1] - first[i])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """A model from the labelled rows that are not held out.

    Each fold is calibrated with the features of the other one. Without both classes the
    model finds nothing and scores 0 everywhere.
    """
    weight = class_weights(labels, sample)
    chosen = F.broadcast(training_sample(labels, sample))  # at most 2 * sample small rows
    train = one_of_copies(id_and_text(docs).join(chosen, "doc_id"))
    sizes = {(r["toxic"], r["fold"]): r["n"] for r in train.groupBy("toxic", "fold").agg(F.count("*").alias("n")).collect()}
    n = [[sizes.get((y, f), 0) for f in (0, 1)] for y in (0, 1)]
    nothing = ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), Calibration(1.0, 1.0, (-500.0, 0.0, 0.0)))
    if not sum(n[0]) or not sum(n[1]):
        return nothing
    toxic, clean = [F.col("n2"), F.col("n3")], [F.col("n0"), F.col("n1")]
    counted = store(count_features(train))
    total = counted.agg(*(F.coalesce(F.sum(f"n{k}"), F.lit(0)) for k in range(4))).first()
    both = ((sum(n[1]), sum(n[0])), (total[2] + total[3], total[0] + total[1]))
    weights = {"w": cautious_log_odds(toxic[0] + toxic[1], clean[0] + clean[1], both, weight)}
    for f in (0, 1):
        half = ((n[1][f], max(n[0][f], 1)), (total[2 + f], total[f]))
        weights[f"w{f}"] = cautious_log_odds(toxic[f], clean[f], half, weight)
    scored = (
        counted.filter(toxic[0] + toxic[1] >= LEAST_DOCS)
        .select("feature", "n2", "n3", *(c.alias(k) for k, c in weights.items()))
        .filter(F.greatest("w", "w0", "w1") > LEAST_ODDS)
        .orderBy(F.greatest("w", "w0", "w1").desc(), "feature")
        .limit(FEATURES)
    ).toPandas()
    keys = scored["feature"].to_numpy(np.int64).view(np.uint64)

    def table(name, seen):
        good = (scored[name].to_numpy() > LEAST_ODDS) & seen
        return keys[good], scored.loc[good, name].to_numpy()

    all_rows = np.ones(len(keys), bool)
    halves = [table(f"w{f}", scored[f"n{2 + f}"].to_numpy() >= LEAST_DOCS / 2) for f in (0, 1)]

    def run(batches):
        features = [Features(*half) for half in halves]
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            folds = np.array(batch.column("fold").to_pylist())
            rows = []
            for a, b in blocks(offsets):
                both = [list(_segments(f, data, offsets, a, b)) for f in features]
                for i in range(a, b):
                    segments, words = both[1 - folds[i]][i - a]
                    rows.append(([s[2] for s in segments], words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array([r[0] for r in rows], pa.list_(pa.float64())), pa.array([r[1] for r in rows], pa.int64())],
                ["toxic", "scores", "words"],
            )

    seen = train.mapInArrow(run, "toxic int, scores array<double>, words long").collect()
    y = np.array([r["toxic"] for r in seen], float)
    best = np.array([max(r["scores"], default=0.0) for r in seen])
    words = np.array([r["words"] for r in seen], float)
    rate, size = extreme_value_law(best[y == 0], words[y == 0])
    law = Calibration(rate, size, (0.0, 0.0, 0.0))
    x = []
    for r in seen:
        _, found = law.document([(0, 0, s) for s in r["scores"]], r["words"])
        x.append(curve_inputs(law, list(r["scores"]), len(found), r["words"]))
    return ToxicityModel(*table("w", all_rows), Calibration(rate, size, logistic_curve(np.array(x), y, np.where(y == 1, weight[1], weight[0]))))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Score and toxic passages of every row of ``docs``.

    Returns doc_id, score (0 to 1) and passages: array of structs of first and last word
    (from 0), score and p (chance of such a segment in a clean document). Null and empty
    texts have no passages and get the score of a document without evidence. Rows are
    scored one by one; null ids and repeated rows change nothing.
    """
    schema = "doc_id long, score double, passages array<struct<first:long,last:long,score:double,p:double>>"
    passage = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()), ("p", pa.float64())]))

    def run(batches):
        features = Features(model.keys, model.weights)
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            scores, passages = [], []
            for a, b in blocks(offsets):
                for segments, words in _segments(features, data, offsets, a, b):
                    value, found = model.calibration.document(segments, words)
                    scores.append(value)
                    passages.append([dict(zip(("first", "last", "score", "p"), s)) for s in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(passages, passage)], ["doc_id", "score", "passages"]
            )

    return id_and_text(docs).mapInArrow(run, schema)
