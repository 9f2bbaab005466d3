"""Token counts of fields and sections from one encoding of the whole document.

Every document is encoded once. The character span of each token follows from the lengths
of the tokens' bytes; spans of tokens and of sections are both sorted, so their interval
join is a binary search. Tokens that cross a border go by one of four rules:

* ``start``: to the section that holds their first character;
* ``end``: to the section that holds their last character;
* ``middle``: to the section that holds their middle (the larger part of two);
* ``split``: to every section by its share of the token's characters.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from logsleuth.llm.bpe import vocabulary
from logsleuth.llm.texts import blocks, small_batches, text_buffer

RULES = ("start", "end", "middle", "split")


def token_spans(lengths: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last code point that each token touches."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    opening = (raw & 0xC0) != 0x80
    if opening.all():
        return starts, ends
    number = np.cumsum(opening)
    return number[starts] - 1, number[ends - 1]


def attribute(starts, ends, lows, highs, rule: str) -> np.ndarray:
    """Tokens of each section [low, high) under a rule; sections may also overlap."""
    if rule == "split":
        shares = np.zeros(len(lows))
        if len(starts):
            # How much of all tokens lies before a place: whole tokens and a part of one.
            width = np.maximum(ends - starts, 1)

            def before(place):
                full = np.searchsorted(ends, place, side="right")
                part = np.minimum(full, len(starts) - 1)
                inside = np.clip((place - starts[part]) / width[part], 0, 1)
                return np.where(full < len(starts), full + inside, len(starts))

            shares = before(highs) - before(lows)
        return shares
    at = {"start": 2 * starts, "end": 2 * (ends - 1), "middle": starts + ends - 1}[rule]
    at = np.maximum.accumulate(at) if len(at) else at
    return np.searchsorted(at, 2 * highs) - np.searchsorted(at, 2 * lows)


def line_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with their line feed, in code points; an empty text is one empty line."""
    number = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    feeds = np.flatnonzero(raw == 10) + 1
    return number[np.concatenate(([0], feeds))], number[np.append(feeds, len(raw))]


def token_counts(
    docs: DataFrame, path: str, rule: str = "start", sections: str | None = None
) -> DataFrame:
    """Tokens of each section of each document.

    ``docs`` has doc_id and text (null: empty). ``sections`` names a column of arrays of
    structs with start and end in code points (a null start or end, or an end before its
    start, makes a section without tokens; a null array has no sections); without it,
    sections are the lines with their line feeds. Returns doc_id, section (from 0), start,
    end, n_tokens (double under ``split``), doc_tokens. Repeated rows are counted one by one.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    number = pa.float64() if rule == "split" else pa.int64()
    schema = T.StructType().add("doc_id", "long").add("section", "long").add("start", "long")
    schema.add("end", "long").add("n_tokens", "double" if rule == "split" else "long")
    schema.add("doc_tokens", "long")
    columns = [F.col("doc_id").cast("long"), "text"]
    if sections:
        bounds = F.transform(sections, lambda s: F.array(s["start"].cast("long"), s["end"].cast("long")))
        columns.append(bounds.alias("bounds"))

    def run(batches):
        words = vocabulary(path)
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            given = batch.column("bounds") if sections else None
            for a, b in blocks(offsets):
                encoded = words.encode(data, offsets[a : b + 1])
                which, parts = [], []
                for i, ids in enumerate(encoded, start=a):
                    raw = data[offsets[i] : offsets[i + 1]]
                    lengths = words.lengths[np.frombuffer(ids, "<u4")]
                    starts, ends = token_spans(lengths, raw)
                    if given is None:
                        lows, highs = line_bounds(raw)
                    else:
                        own = [[x or 0, y or 0] if x is not None and y is not None else [0, 0] for x, y in given[i].as_py() or ()]
                        lows, highs = np.array(own, np.int64).reshape(-1, 2).T
                        highs = np.maximum(lows, highs)
                    counts = attribute(starts, ends, lows, highs, rule)
                    which.append(np.full(len(lows), i))
                    parts.append((np.arange(len(lows)), lows, highs, counts, np.full(len(lows), len(lengths))))
                section, lows, highs, counts, totals = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(np.concatenate(which))), pa.array(section), pa.array(lows), pa.array(highs), pa.array(counts, number), pa.array(totals)],
                    schema.names,
                )

    small_batches(docs.sparkSession)
    return docs.select(*columns).mapInArrow(run, schema)
