"""Language of every stretch of a text: scripts, word scores, and Viterbi with a switching penalty.

The ranges of code points a word's letters lie in narrow the languages it can be in. Each
candidate scores the word by log-odds of its byte trigrams and of the word itself, against
the average language. The best path through the words of a document pays a penalty for each
change of language; its runs are the spans of a mixed text, and the language with most words
is that of the document.

The model is fitted on a bounded sample: of each language about ``SAMPLE`` documents, those
with the lowest hash of their id; the ``LANGUAGES`` most frequent languages are learned. All
that is predicted comes from whole texts, in one pass without a shuffle. Memory is about
eight bytes a word and language for 4 MB of text, or for one document that is longer.

A null text, and one without any letter, is ``und`` with score 0 and no spans, and so is every
text if no language was learned. A text with letters that say nothing (no word has evidence)
gets the most frequent language and score 0. Rows are labelled one by one: null ids, repeated
rows and other columns change nothing. Rows without id, text or language are not learned from.
"""

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from logsleuth.llm.texts import BLOCK_BYTES, blocks, id_and_text, mix, small_batches, stretches, text_buffer, word_places

#: Documents of a language that are learned from (about), and languages that are learned.
SAMPLE, LANGUAGES = 2_000, 128

#: Price of a change of language, strength of the prior of a feature, largest log-odds of one.
SWITCH, PRIOR, MOST = 8.0, 50.0, 4.0

#: Score of a language that a word's script rules out.
EXCLUDED = -60.0

UNKNOWN = "und"

#: Buckets of trigrams and of words, as powers of two.
TRIGRAM_BITS, WORD_BITS = 15, 16
FEATURES = (1 << TRIGRAM_BITS) + (1 << WORD_BITS)

# First code points of the ranges of scripts. "" holds no letters of a script.
SCRIPTS = (
    (0x0000, ""), (0x0041, "Latin"), (0x005B, ""), (0x0061, "Latin"), (0x007B, ""), (0x00AA, "Latin"), (0x00AB, ""),
    (0x00B5, "Latin"), (0x00B6, ""), (0x00BA, "Latin"), (0x00BB, ""), (0x00C0, "Latin"), (0x00D7, ""), (0x00D8, "Latin"),
    (0x00F7, ""), (0x00F8, "Latin"), (0x0250, ""), (0x0370, "Greek"),
    (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Syriac"),
    (0x0750, "Arabic"), (0x0780, "Thaana"), (0x07C0, "Nko"), (0x0800, ""), (0x08A0, "Arabic"), (0x0900, "Devanagari"),
    (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Ethiopic"), (0x13A0, "Cherokee"), (0x1400, ""), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, ""),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, ""), (0x2E80, "Han"), (0x3000, ""), (0x3005, "Han"), (0x3008, ""),
    (0x3040, "Kana"), (0x3100, ""), (0x3130, "Hangul"), (0x3190, ""), (0x31F0, "Kana"), (0x3200, ""), (0x3400, "Han"),
    (0xA000, ""), (0xAC00, "Hangul"), (0xD7A4, ""), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, ""), (0xFB1D, "Hebrew"),
    (0xFB50, "Arabic"), (0xFE00, ""), (0xFE70, "Arabic"), (0xFEFF, ""), (0xFF21, "Latin"), (0xFF3B, ""),
    (0xFF41, "Latin"), (0xFF5B, ""), (0xFF66, "Kana"), (0xFFA0, ""), (0x20000, "Han"), (0x32000, ""),
)

_NAMES = sorted({name for _, name in SCRIPTS if name})
_FIRST = np.array([first for first, _ in SCRIPTS])
_BIT = np.array([1 << _NAMES.index(name) if name else 0 for _, name in SCRIPTS], np.int64)
_ASCII_BITS = _BIT[np.searchsorted(_FIRST, np.arange(128), side="right") - 1]


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def letter_scripts(part: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Bits of the script of the character that begins at each of ``letters`` (byte places)."""
    lead = part[letters].astype(np.int64)
    out = np.zeros(len(letters), np.int64)
    plain = lead < 128
    out[plain] = _ASCII_BITS[lead[plain]]
    wide = np.flatnonzero(lead >= 0xC0)
    if len(wide):
        at, first = letters[wide], lead[wide]
        extra = 1 + (first >= 0xE0) + (first >= 0xF0)
        point = first & (0x3F >> extra)
        for i in range(1, 4):
            more = extra >= i
            follow = part[np.minimum(at + i, len(part) - 1)].astype(np.int64) & 0x3F
            point = np.where(more, point << 6 | follow, point)
        out[wide] = _BIT[np.searchsorted(_FIRST, point, side="right") - 1]
    return out


def word_features(part: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
    """(first byte of each word among all word bytes, bucket of the trigram at each byte,
    bucket of each word, bits of the scripts of its letters)."""
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    place = np.arange(total) - np.repeat(first, lengths)
    letters = np.repeat(starts, lengths) + place
    own = part[letters].astype(np.uint32)
    before, after = np.zeros(total, np.uint32), np.zeros(total, np.uint32)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first], after[first + lengths - 1] = 0, 0
    code = before | own << np.uint32(8) | after << np.uint32(16)
    trigram = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - TRIGRAM_BITS)).astype(np.int64)
    with np.errstate(over="ignore"):
        step = np.uint64(0x9E3779B97F4A7C15)
        spread = mix(own.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(8)) * step)
        word = mix(np.add.reduceat(spread, first))
    bits = np.bitwise_or.reduceat(letter_scripts(part, letters), first)
    return first, trigram, (word >> np.uint64(64 - WORD_BITS)).astype(np.int64) + (1 << TRIGRAM_BITS), bits


@dataclass(frozen=True)
class LanguageModel:
    """Learned languages, their shares, the scripts they use, and log-odds by feature."""

    languages: list[str]
    shares: np.ndarray
    scripts: np.ndarray
    odds: np.ndarray

    def word_scores(self, part, starts, lengths) -> tuple[np.ndarray, np.ndarray]:
        """Score of each word in each language, and whether the word has letters."""
        if not len(starts):
            return np.zeros((0, len(self.languages)), np.float32), np.zeros(0, bool)
        first, trigram, word, bits = word_features(part, starts, lengths)
        # A byte is in three trigrams.
        scores = np.add.reduceat(self.odds[trigram], first, axis=0) / np.float32(3) + self.odds[word]
        lettered = bits > 0
        scores[~lettered] = 0
        # Few sets of scripts occur; each is judged once.
        sets, which = np.unique(bits, return_inverse=True)
        fits = (sets[:, None] & ~self.scripts[None, :]) == 0
        some = (sets[:, None] & self.scripts[None, :]) > 0
        allowed = np.where(fits.any(1)[:, None], fits, some)
        allowed[~allowed.any(1)] = True
        strange = ~(fits | some).any(1)
        scores[strange[which]] = 0
        for i in np.flatnonzero(~allowed.all(1)):
            mine = np.flatnonzero(which == i)
            scores[np.ix_(mine, np.flatnonzero(~allowed[i]))] = EXCLUDED
        return scores, lettered


def _constant(scores: np.ndarray, edges: np.ndarray, switch: float) -> tuple[np.ndarray, np.ndarray]:
    """Best single language of each document, and whether no change from it can pay.

    A path that changes languages gains, over the best single one, what its other stretches
    gain, less a price for each change. If no stretch of any language gains more than half
    the price, no path does.
    """
    sums = np.concatenate([np.zeros((1, scores.shape[1])), np.cumsum(scores, axis=0, dtype=np.float64)])
    totals = sums[edges[1:]] - sums[edges[:-1]]
    best = totals.argmax(1)
    sizes = np.diff(edges)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    alone = np.ones(len(sizes), bool)
    for l in range(scores.shape[1]):
        gain = sums[1:, l] - np.take_along_axis(sums[1:], best[doc][:, None], 1)[:, 0]
        start = sums[edges[:-1], l] - sums[edges[:-1], best]
        gain = gain - start[doc]
        # Documents lie on levels so far apart that a running minimum starts anew in each.
        level = -(np.abs(gain).max(initial=0.0) * 2 + 1) * doc
        low = np.minimum.accumulate(np.concatenate([[0.0], (gain + level)[:-1]])) if len(gain) else gain
        rise = gain + level - np.minimum(low, level)
        worst = np.zeros(len(sizes))
        np.maximum.at(worst, doc, rise)
        alone &= worst <= switch / 2
    return best, alone


def best_paths(scores: np.ndarray, edges: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Language of each word on the best path of its document (words edges[i] to edges[i+1]).

    The path maximises the sum of its word scores less ``switch`` for each change. Documents
    in which no change can pay are settled by sums; the others go through Viterbi side by
    side, the longest first, so that the documents still open are always the first ones.
    """
    best, alone = _constant(scores, edges, switch)
    sizes = np.diff(edges)
    labels = np.repeat(best, sizes)
    mixed = np.flatnonzero(~alone)
    mixed = mixed[np.argsort(-sizes[mixed], kind="stable")]
    if not len(mixed):
        return labels
    start, size = edges[mixed], sizes[mixed]
    stay = np.ones(scores.shape, bool)
    came = np.zeros(len(scores), np.int32)
    value = scores[start].astype(np.float64)
    for t in range(1, int(size[0])):
        n = int(np.searchsorted(-size, -t, side="left"))
        now, at = value[:n], start[:n] + t
        came[at] = now.argmax(1)
        moved = now.max(1)[:, None] - switch
        stay[at] = now >= moved
        value[:n] = np.maximum(now, moved) + scores[at]
    own = value.argmax(1)
    for t in range(int(size[0]) - 1, -1, -1):
        n = int(np.searchsorted(-size, -t, side="left"))
        at = start[:n] + t
        labels[at] = own[:n]
        own[:n] = np.where(stay[at, own[:n]], own[:n], came[at])
    return labels


def _has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def _judge(model: LanguageModel, labels, lettered, scores, has_letter: bool):
    """Language, score and spans of one document from the path through its words."""
    if not has_letter or not model.languages:
        return UNKNOWN, 0.0, []
    evidence = lettered & (scores != 0).any(1)
    if not evidence.any():
        return model.languages[int(model.shares.argmax())], 0.0, []
    words = np.bincount(labels[evidence], minlength=len(model.languages))
    most = np.flatnonzero(words == words.max())
    own = most[int(scores.sum(0)[most].argmax())]
    edges = np.flatnonzero(np.diff(labels)) + 1
    firsts, lasts = np.append(0, edges), np.append(edges, len(labels)) - 1
    spans = [{"lang": model.languages[labels[a]], "first": int(a), "last": int(b)} for a, b in zip(firsts, lasts)]
    return model.languages[own], float(words[own] / words.sum()), spans


def languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score and spans (lang, first and last word from 0) of every row.

    score is the share of the words with evidence that lie in spans of the language.
    """
    schema = "doc_id long, lang_pred string, score double, spans array<struct<lang:string,first:long,last:long>>"
    span = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))
    limit = max(1 << 14, BLOCK_BYTES * 4 // max(len(model.languages), 4))

    def judged(texts: pa.Array):
        data, offsets = text_buffer(texts)
        scores, lettered = [], []
        n_words = np.zeros(len(texts), np.int64)
        for a, edges, _ in stretches(data, offsets, limit):
            part, starts, lengths, first = word_places(data, edges)
            own, has = model.word_scores(part, starts, lengths)
            scores.append(own)
            lettered.append(has)
            n_words[a : a + len(first) - 1] += np.diff(first)
        scores, lettered = np.concatenate(scores), np.concatenate(lettered)
        edges = np.append(0, np.cumsum(n_words))
        labels = best_paths(scores, edges) if len(model.languages) else np.zeros(len(scores), np.int64)
        is_letter = np.append(0, np.cumsum(((data >= 65) & (data <= 90)) | ((data >= 97) & (data <= 122))))
        for i in range(len(texts)):
            plain = is_letter[offsets[i + 1]] > is_letter[offsets[i]]
            some = bool(plain) or _has_letter(texts[i].as_py() or "")
            a, b = edges[i], edges[i + 1]
            yield _judge(model, labels[a:b], lettered[a:b], scores[a:b], some)

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            found = []
            for a, b in blocks(text_buffer(texts)[1], 16 * BLOCK_BYTES):
                found.extend(judged(pa.concat_arrays([texts.slice(a, b - a)])))
            names, shares, spans = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(shares, pa.float64()), pa.array(spans, span)],
                ["doc_id", "lang_pred", "score", "spans"],
            )

    return id_and_text(docs).mapInArrow(run, schema)


def count_features(sample: DataFrame) -> DataFrame:
    """Occurrences (language, feature, n) in rows of text and number of a language.

    Features from ``FEATURES`` on are letters by script.
    """

    def run(batches):
        kinds = FEATURES + len(_NAMES)
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            numbers = batch.column("language").to_numpy(zero_copy_only=False)
            data, offsets = text_buffer(batch.column("text"))
            for a, edges, _ in stretches(data, offsets):
                part, starts, lengths, first = word_places(data, edges)
                if not len(starts):
                    continue
                at, trigram, word, bits = word_features(part, starts, lengths)
                for i in np.flatnonzero(np.diff(first)):
                    low, high = first[i], first[i + 1]
                    own = slice(at[low], at[high] if high < len(at) else None)
                    counts = tables.setdefault(int(numbers[a + i]), np.zeros(kinds, np.int64))
                    np.add.at(counts, trigram[own], 1)
                    np.add.at(counts, word[low:high], 1)
                    for k in range(len(_NAMES)):
                        counts[FEATURES + k] += int(((bits[low:high] >> k) & 1).sum())
        for number, counts in tables.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some), number), pa.int64()), pa.array(some, pa.int64()), pa.array(counts[some])],
                ["language", "feature", "n"],
            )

    rows = sample.mapInArrow(run, "language long, feature long, n long")
    return rows.groupBy("language", "feature").agg(F.sum("n").alias("n"))


def log_odds(counts: np.ndarray) -> np.ndarray:
    """Log-odds of each feature (rows) in each language, against the mean of all languages.

    Counts are shrunk towards the mean by ``PRIOR`` occurrences spread over all features
    alike; a feature never seen says nothing.
    """
    size = counts.sum(0).astype(np.float64)
    share = counts / np.maximum(size, 1)
    mean = share.mean(1, keepdims=True)
    shrunk = (counts + PRIOR * mean) / (size + PRIOR)
    with np.errstate(divide="ignore", invalid="ignore"):
        odds = np.log(shrunk / mean)
    return np.clip(np.where(mean > 0, odds, 0.0), -MOST, MOST).astype(np.float32)


def learnable(docs: DataFrame) -> DataFrame:
    """doc_id, text and lang of the rows that may be learned from."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    return rows.filter("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").filter(~held_out(F.col("doc_id")))


def fit(docs: DataFrame, sample: int = SAMPLE, most: int = LANGUAGES) -> LanguageModel:
    """A model from the rows of ``docs`` (doc_id, text, lang) that are not held out."""
    rows = learnable(docs)
    found = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()
    found = sorted(found, key=lambda r: r["lang"])
    names = [r["lang"] for r in found]
    if not names:
        return LanguageModel([], np.zeros(0), np.zeros(0, np.int64), np.zeros((FEATURES, 0), np.float32))
    spark = docs.sparkSession
    limits = [(r["lang"], i, math.floor(min(1.0, sample / r["n"]) * 2**32)) for i, r in enumerate(found)]
    table = spark.createDataFrame(limits, "lang string, language long, below long")
    at = F.xxhash64("doc_id").bitwiseAND((1 << 32) - 1)
    small_batches(spark)
    chosen = rows.join(F.broadcast(table), "lang").filter(at < F.col("below")).select("language", "text")
    counts = np.zeros((FEATURES + len(_NAMES), len(names)), np.int64)
    counted = count_features(chosen).toPandas()
    counts[counted["feature"].to_numpy(), counted["language"].to_numpy()] = counted["n"].to_numpy()
    by_script = counts[FEATURES:]
    used = by_script * 100 >= np.maximum(by_script.sum(0), 1)
    scripts = (used * (1 << np.arange(len(_NAMES)))[:, None]).sum(0)
    odds = np.concatenate([log_odds(counts[: 1 << TRIGRAM_BITS]), log_odds(counts[1 << TRIGRAM_BITS : FEATURES])])
    shares = np.array([r["n"] for r in found], np.float64)
    return LanguageModel(names, shares / shares.sum(), scripts, odds)
