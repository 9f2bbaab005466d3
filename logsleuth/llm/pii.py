"""Personal data by a semi-Markov conditional random field over whole spans.

Regular patterns give the base spans. Around digits, at signs and equal signs, the random
field scores every candidate span of bounded length by features of the whole span (its
parts, counts, shape, checks it passes and what stands around it), and dynamic programming
chooses boundaries and kinds of all spans of a region together. Its weights are the maximum
of the conditional likelihood of weakly labelled regions: base spans, and secrets of well
known forms, taken from a bounded sample (``REGIONS``) of all documents.

Regions are found from their trigger characters, never from a pattern that might look at a
long text again and again: time is linear in the text.
"""

import bisect
import itertools
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from logsleuth.llm.texts import id_and_text, small_batches

KINDS = ("email", "ip", "card", "phone", "secret")

#: Regions learned from, passes over them, tokens of a span and characters beside a trigger.
REGIONS, PASSES, MAX_TOKENS, REACH = 1_200, 8, 12, 96

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@=]")
TOKEN = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9]")

#: Forms of secrets that weakly label regions.
SECRETS = (
    re.compile(r"\bAKIA[0-9A-Z]{16}\b"),
    re.compile(r"(?<=password=)[^\s\"']{6,}"),
    re.compile(r"(?<=token = \")[0-9a-f]{20,}(?=\")"),
)


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def small_part(part: str) -> bool:
    return len(part.lstrip("0")) <= 3 and int(part[-4:]) <= 255


def emails(text: str):
    """Spans of a local part, an at sign and a domain, leftmost and without overlap."""
    done, at = 0, text.find("@")
    while at >= 0:
        low = at
        while low > done and (text[low - 1] in "._%+-" or text[low - 1].isascii() and text[low - 1].isalnum()):
            low -= 1
        found = DOMAIN.match(text, at + 1) if low < at else None
        done = found.end() if found else at + 1
        if found:
            yield low, done
        at = text.find("@", done)


def addresses(text: str):
    for run in DOTTED.finditer(text):
        parts, at = run.group().split("."), run.start()
        for i in range(0, len(parts) - 3, 4):
            end = at + sum(len(p) + 1 for p in parts[i : i + 4]) - 1
            if all(map(small_part, parts[i : i + 4])):
                yield at, end
            at = end + 1


def cards(text: str):
    for m in CARD.finditer(text):
        digits = digits_of(m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str):
    for m in PHONE.finditer(text):
        if 9 <= len(digits_of(m.group())) <= 15:
            yield m.span()


BASE = (emails, addresses, cards, phones)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all base spans in order."""
    return sorted((a, k, b) for k, find in enumerate(BASE) for a, b in find(text))


def regions(text: str):
    """Stretches around trigger characters, at most ``REACH`` characters beyond them."""
    done = 0
    for m in TRIGGER.finditer(text):
        if m.start() < done:
            continue
        low = m.start()
        while low > max(done, m.start() - REACH) and not text[low - 1].isspace():
            low -= 1
        high, last = m.end(), m.start()
        while high < len(text) and high - last <= REACH and text[high] != "\n":
            if text[high] in "0123456789@=":
                last = high
            elif text[high].isspace() and not re.match(r"[ \t][^\s0-9@=]{0,16}[0-9@=]", text[high : high + 18]):
                break
            high += 1
        yield low, high
        done = high


def tokens_of(text: str, low: int, high: int) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(text, low, high)]


def level(n: int, steps: tuple) -> int:
    return sum(n >= s for s in steps)


def context(text: str, start: int, end: int) -> list[str]:
    before, after = text[max(0, start - 24) : start], text[end : end + 2]
    words = re.findall(r"[A-Za-z]+", before)
    gap = re.search(r"[^A-Za-z0-9]*\Z", before).group()[-3:]
    known = words[-1].lower() if words and words[-1].lower() in CUES else "-"
    return [
        f"cue={known}{'=' if '=' in gap else ''}",
        f"left={'n' if before[-1:].isalnum() else before[-1:] if before[-1:] in '@.+-_=' else 's'}",
        f"right={'n' if after[:1].isalnum() else after[:1] if after[:1] in '@-_=' else 's'}",
        f"goes_on={int(bool(re.match(r'[.@:-][A-Za-z0-9]', after)))}",
    ]


#: Words before personal data that are told apart.
CUES = frozenset("password passwd pwd token key secret apikey tel phone call mobile fax mail email card ip host version".split())


def span_features(text: str, start: int, end: int, n_tokens: int) -> list[str]:
    """Features of a whole span; all of them are names, weights go by kind and name."""
    span = text[start:end]
    digits = digits_of(span)
    letters = sum(c.isalpha() for c in span)
    upper = sum("A" <= c <= "Z" for c in span)
    hexadecimal = bool(re.fullmatch(r"[0-9a-f]+", span))
    alone = n_tokens == 1
    parts = span.split(".")
    return [
        "bias",
        f"tokens={min(n_tokens, 12)}",
        f"chars={level(len(span), (4, 8, 12, 16, 20, 32, 48))}",
        f"digits={level(len(digits), (1, 4, 7, 9, 12, 16, 20))}",
        f"mixed={int(letters > 0)}{int(bool(digits))}{int(alone)}",
        f"upper={level(upper, (1, 4, 12))}{int(upper == letters)}",
        f"hex={int(hexadecimal and letters > 0)}{level(len(span), (8, 16, 32))}",
        f"at={min(span.count('@'), 2)}{int('.' in span.rpartition('@')[2])}",
        f"dots={min(span.count('.'), 4)}",
        f"spaces={min(span.count(' '), 4)}",
        f"plus={int(span[:1] == '+')}{int('(' in span)}",
        f"equals={int('=' in span)}{int(chr(34) in span)}",
        f"ip={int(len(parts) == 4 and all(p.isdigit() and p.isascii() and small_part(p) for p in parts))}",
        f"email={int(bool(re.fullmatch(r'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+', span)))}",
        f"luhn={int(12 <= len(digits) <= 19 and letters == 0 and luhn(digits))}",
        f"dialled={int(letters == 0 and 9 <= len(digits) <= 15)}{int(span[:1] == '+')}",
        *context(text, start, end),
    ]


def candidates(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Token ranges [i, j) that may be a span: bounded, and not opened or closed by a gap."""
    found = []
    for i, (a, _) in enumerate(tokens):
        if not (text[a].isalnum() or text[a] in "+("):
            continue
        for j in range(i + 1, min(i + MAX_TOKENS, len(tokens)) + 1):
            last = text[tokens[j - 1][0]]
            if "\n" in text[a : tokens[j - 1][1]]:
                break
            if last.isalnum() and last.isascii():
                found.append((i, j))
    return found


@dataclass(frozen=True)
class SpanField:
    """Weights of the random field: a row for each feature name, a column for each kind."""

    names: dict
    weights: np.ndarray

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        return np.array([self.weights[r].sum(axis=0) for r in rows]).reshape(-1, len(KINDS))

    def known(self, text, tokens, spans) -> list[list[int]]:
        get = self.names.get
        return [
            [n for n in map(get, span_features(text, tokens[i][0], tokens[j - 1][1], j - i)) if n is not None]
            for i, j in spans
        ]

    def spans(self, text: str, low: int, high: int) -> list[tuple[int, int, int]]:
        """Best joint choice of spans (start, kind number, end) of a region."""
        tokens = tokens_of(text, low, high)
        ranges = candidates(text, tokens)
        scores = self.scores(self.known(text, tokens, ranges))
        ends: dict[int, list] = {}
        for (i, j), own in zip(ranges, scores):
            kind = int(own.argmax())
            if own[kind] > 0:
                ends.setdefault(j, []).append((i, kind, float(own[kind])))
        best, choice = [0.0] * (len(tokens) + 1), [None] * (len(tokens) + 1)
        for j in range(1, len(tokens) + 1):
            best[j] = best[j - 1]
            for i, kind, value in ends.get(j, ()):
                if best[i] + value > best[j]:
                    best[j], choice[j] = best[i] + value, (i, kind)
        found, j = [], len(tokens)
        while j > 0:
            if choice[j] is None:
                j -= 1
            else:
                i, kind = choice[j]
                found.append((tokens[i][0], kind, tokens[j - 1][1]))
                j = i
        return found[::-1]


def weak_labels(text: str, low: int, high: int) -> list[tuple[int, int, int]]:
    """Base spans and known forms of secrets inside a region, leftmost, without overlap."""
    found = [s for s in base_spans(text) if low <= s[0] and s[2] <= high]
    for form in SECRETS:
        found += [(m.start(), 4, m.end()) for m in form.finditer(text) if low <= m.start() and m.end() <= high]
    kept, done = [], low
    for span in sorted(found, key=lambda s: (s[0], -s[2])):
        if span[0] >= done:
            kept.append(span)
            done = span[2]
    return kept


class _Example:
    """A region prepared for learning: its candidate spans and the ones that are right."""

    def __init__(self, text: str, low: int, high: int):
        tokens = tokens_of(text, low, high)
        self.n = len(tokens)
        starts = {a: i for i, (a, _) in enumerate(tokens)}
        ends = {b: i + 1 for i, (_, b) in enumerate(tokens)}
        self.ranges = candidates(text, tokens)
        self.names = [span_features(text, tokens[i][0], tokens[j - 1][1], j - i) for i, j in self.ranges]
        place = {r: x for x, r in enumerate(self.ranges)}
        self.right = []
        for a, kind, b in weak_labels(text, low, high):
            x = place.get((starts.get(a), ends.get(b)))
            if x is not None:
                self.right.append((x, kind))

    def number(self, names: dict):
        self.rows = [[names.setdefault(f, len(names)) for f in own] for own in self.names]
        del self.names

    def expected(self, scores: np.ndarray) -> np.ndarray:
        """Probability of every (span, kind) under the field, by forward and backward sums."""
        ahead = [0.0] + [-math.inf] * self.n
        totals = np.logaddexp.reduce(scores, axis=1) if len(scores) else np.zeros(0)
        by_end, by_start = {}, {}
        for x, (i, j) in enumerate(self.ranges):
            by_end.setdefault(j, []).append((i, x))
            by_start.setdefault(i, []).append((j, x))
        for j in range(1, self.n + 1):
            ahead[j] = float(np.logaddexp.reduce([ahead[j - 1]] + [ahead[i] + totals[x] for i, x in by_end.get(j, ())]))
        behind = [-math.inf] * self.n + [0.0]
        for i in range(self.n - 1, -1, -1):
            behind[i] = float(np.logaddexp.reduce([behind[i + 1]] + [behind[j] + totals[x] for j, x in by_start.get(i, ())]))
        outside = np.array([ahead[i] + behind[j] - ahead[self.n] for i, j in self.ranges])
        return np.exp(scores + outside[:, None])


def learn(samples: list[tuple[str, int, int]], passes: int = PASSES, rate: float = 0.3, ridge: float = 1e-4) -> SpanField:
    """Weights that raise the conditional likelihood of weakly labelled regions."""
    names: dict = {}
    examples = [_Example(*s) for s in samples]
    for e in examples:
        e.number(names)
    weights = np.zeros((len(names) + 1, len(KINDS)))
    seen = np.full_like(weights, 1e-2)
    field = SpanField(names, weights)
    for _ in range(passes):
        for e in examples:
            if not e.ranges:
                continue
            slope_of = -e.expected(field.scores(e.rows))
            for x, kind in e.right:
                slope_of[x, kind] += 1
            slope = np.zeros_like(weights)
            sizes = [len(r) for r in e.rows]
            flat = np.concatenate([np.array(r) for r in e.rows])
            np.add.at(slope, flat, np.repeat(slope_of, sizes, axis=0))
            slope -= ridge * weights
            seen += slope**2
            weights += rate * slope / np.sqrt(seen)
    return field


def fit(docs: DataFrame, sample: int = REGIONS) -> SpanField:
    """A field learned from at most ``sample`` regions with the lowest hash, of all texts.

    Only these regions, with a little text around them, come to the driver. A corpus
    without any region gives a field that finds nothing.
    """

    def run(batches):
        for batch in batches:
            parts, lows, highs = [], [], []
            for text in batch.column("text").to_pylist():
                for low, high in regions(text):
                    first = max(0, low - 32)
                    parts.append(text[first : high + 32])
                    lows.append(low - first)
                    highs.append(high - first)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), pa.array(lows, pa.int32()), pa.array(highs, pa.int32())], ["part", "low", "high"])

    rows = with_triggers(id_and_text(docs)).select("text").mapInArrow(run, "part string, low int, high int")
    order = [F.xxhash64("part"), "part", "low", "high"]
    chosen = rows.distinct().orderBy(*order).limit(sample).collect()
    return learn([(r["part"], r["low"], r["high"]) for r in chosen])


def with_triggers(docs: DataFrame) -> DataFrame:
    """Rows that can hold personal data at all."""
    return docs.filter(F.col("text").rlike("[0-9@=]"))


def all_spans(text: str, field: SpanField) -> list[tuple[int, int, int, bool]]:
    """(start, kind number, end, base): all base spans, and those of the field beside them."""
    base = base_spans(text)
    found = [(*s, True) for s in base]
    starts = [a for a, _, _ in base]
    reach = list(itertools.accumulate((b for _, _, b in base), max))
    for low, high in regions(text):
        for a, kind, b in field.spans(text, low, high):
            # Of the base spans that begin before b, none may end behind a.
            earlier = bisect.bisect_left(starts, b)
            if not earlier or reach[earlier - 1] <= a:
                found.append((a, kind, b, False))
    return sorted(found)


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def personal_data(docs: DataFrame, field: SpanField) -> DataFrame:
    """``docs`` (doc_id, text) with ``spans`` in order of start, then kind.

    Places are code points, ends exclusive. Null and empty texts have no spans. Rows are
    searched one by one: null ids and repeated rows change nothing.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches):
        for batch in batches:
            out = []
            for text, some in zip(batch.column("text"), batch.column("some").to_pylist()):
                found = all_spans(text.as_py(), field) if some else []
                out.append([{"kind": KINDS[k], "start": a, "end": b, "base": own} for a, k, b, own in found])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(out, kind)], ["doc_id", "text", "spans"])

    some = F.coalesce(F.col("text").rlike("[0-9@=]"), F.lit(False)).alias("some")
    return id_and_text(docs).select("doc_id", "text", some).mapInArrow(run, f"doc_id long, text string, spans {SPANS}")


def redact(docs: DataFrame, field: SpanField) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by <KIND>; all columns stay.

    Overlapping spans become one, named after the first. Null texts stay null.
    """
    schema = T.StructType([*docs.schema])

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, text in enumerate(texts):
                if text is None or not TRIGGER.search(text):
                    continue
                parts, done = [], 0
                for a, k, b, _ in all_spans(text, field):
                    if a >= done:
                        parts += [text[done:a], f"<{KINDS[k].upper()}>"]
                    done = max(done, b)
                texts[i] = "".join([*parts, text[done:]])
            columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)
