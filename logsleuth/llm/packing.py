"""Packing of token sequences by vector bin packing with the dot-product heuristic.

A sequence has room for so many tokens, segments and loss-bearing tokens. Of the pieces
that fit into what is left of all three, the one goes in whose needs have the largest dot
product with the room left. Where nothing fits any more, a piece is cut to close the gap.

Examples are packed where they lie: a task fills sequences from a window of its own rows,
so nothing is shuffled, memory is bounded by the window and a lost task is simply run again.
Only the last sequence of a task can stay short.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, types as T


@dataclass(frozen=True)
class Limits:
    """Room of a sequence; gaps under ``min_cut`` tokens stay rather than cut a piece."""

    tokens: int = 1024
    segments: int = 128
    loss: int = 1024
    min_cut: int = 4
    #: Pieces that wait together in a task. They hold less than one sequence each.
    window: int = 4096


class Packer:
    """Fills sequences one after the other from the pieces that wait.

    ``emit`` gets (example, start, length, sequence, offset) for each placed piece, where
    example is what was given to ``add``, or what ``part`` (example, start, length) made of it:
    a piece that waits keeps no more of its example than that.
    """

    def __init__(self, limits: Limits, first: int, emit, part=lambda example, start, n: example):
        self.limits, self.next, self.emit, self.part = limits, first, emit, part
        room = 2 * limits.window
        self.tokens = np.zeros(room, np.int64)
        self.loss = np.zeros(room, np.int64)
        self.waiting: list = [None] * room
        self.n = 0
        self._open()

    def _open(self):
        self.used = [0, 0, 0]

    def _close(self):
        if self.used[0]:
            self.next += 1
        self._open()

    def add(self, example, tokens: int, mask: np.ndarray | None):
        """All tokens of an example; ``mask`` marks the loss-bearing ones (None: all)."""
        lim, start = self.limits, 0
        before = None if mask is None else np.concatenate(([0], np.cumsum(mask != 0)))
        while start < tokens:
            n = min(tokens - start, lim.tokens)
            if before is None:
                n = min(n, lim.loss)
            else:
                n = min(n, max(1, int(np.searchsorted(before, before[start] + lim.loss, "right")) - 1 - start))
            if n == lim.tokens:
                self._whole(example, start, n)
            else:
                self._wait(example, start, n, before)
            start += n

    def _whole(self, example, start, n):
        """A sequence of its own, numbered before the one that is being filled."""
        self.emit(example, start, n, self.next, 0)
        self.next += 1

    def _wait(self, example, start, n, before):
        if self.n == len(self.waiting):
            self.fill(self.limits.window)
        i = self.n
        self.tokens[i] = n
        self.loss[i] = n if before is None else before[start + n] - before[start]
        # Losses before each token of the piece, counted from its first token.
        own = None if before is None else before[start : start + n + 1].copy()
        self.waiting[i] = (self.part(example, start, n), start, own, start)
        self.n += 1

    def _take(self, i: int):
        """Removes the waiting piece i."""
        last = self.n - 1
        self.tokens[i], self.loss[i], self.waiting[i] = (
            self.tokens[last], self.loss[last], self.waiting[last],
        )
        self.waiting[last], self.n = None, last

    def _place(self, i: int, n: int):
        example, start, before, first = self.waiting[i]
        loss = n if before is None else int(before[start + n - first] - before[start - first])
        self.emit(example, start, n, self.next, self.used[0])
        self.used = [self.used[0] + n, self.used[1] + 1, self.used[2] + loss]
        if n == self.tokens[i]:
            self._take(i)
        else:
            self.tokens[i] -= n
            self.loss[i] -= loss
            self.waiting[i] = (example, start + n, before, first)

    def fill(self, leave: int):
        """Places waiting pieces until at most ``leave`` of them wait."""
        lim = self.limits
        while self.n > leave:
            room = [lim.tokens - self.used[0], lim.segments - self.used[1], lim.loss - self.used[2]]
            tokens, loss = self.tokens[: self.n], self.loss[: self.n]
            gain = tokens * (room[0] / lim.tokens**2) + loss * (room[2] / lim.loss**2)
            gain = gain + room[1] / lim.segments**2
            fits = (tokens <= room[0]) & (loss <= room[2])
            if room[1] < 1 or room[0] < 1:
                self._close()
            elif fits.any():
                best = int(np.argmax(np.where(fits, gain, -1.0)))
                self._place(best, int(tokens[best]))
            else:
                best = int(np.argmax(gain))
                n = min(room[0], int(tokens[best]))
                _, start, before, first = self.waiting[best]
                if before is None:
                    n = min(n, room[2])
                else:
                    at = start - first
                    n = min(n, int(np.searchsorted(before, before[at] + room[2], "right")) - 1 - at)
                if n >= lim.min_cut:
                    self._place(best, n)
                else:
                    self._close()

    def finish(self):
        self.fill(0)
        self._close()


def pack(
    examples: DataFrame,
    limits: Limits = Limits(),
    ids: str = "ids",
    mask: str | None = None,
    end_id: int | None = 0,
    keep: tuple = ("doc_id",),
) -> DataFrame:
    """Pieces of all examples and where they stand.

    ``ids`` holds little-endian u32 tokens (null: none), ``mask`` one byte a token (nonzero:
    loss-bearing; null or no column: all of them). ``end_id`` is put behind each example and
    bears loss. Returns the columns ``keep`` with start, length, ids (of the piece),
    doc_tokens, sequence_id, offset. Examples without any token give no piece. Repeated rows
    are packed one by one. Sequence ids are unique and have gaps between tasks.
    """
    columns = [*keep, ids] + ([mask] if mask else [])
    schema = T.StructType([examples.schema[c] for c in keep])
    for name in ("start", "length"):
        schema.add(name, "long")
    schema.add("ids", "binary").add("doc_tokens", "long").add("sequence_id", "long")
    schema.add("offset", "long")
    arrow = pa.schema([("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches):
        placed: list = []
        kept_types: list = []

        def emit(example, start, length, sequence, offset):
            row, raw, first, total = example
            piece = raw[4 * (start - first) : 4 * (start - first + length)]
            placed.append((row, start, length, piece, total, sequence, offset))

        def part(example, start, length):
            row, raw, first, total = example
            return row, raw[4 * (start - first) : 4 * (start - first + length)], start, total

        def flush():
            rows, *values = zip(*placed)
            arrays = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kept_types)]
            arrays += [pa.array(v, f.type) for v, f in zip(values, arrow)]
            placed.clear()
            return pa.RecordBatch.from_arrays(arrays, [*keep, *arrow.names])

        packer = Packer(limits, TaskContext.get().partitionId() << 40, emit, part)
        end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        for batch in batches:
            kept_types[:] = [batch.schema.field(c).type for c in keep]
            rows = list(zip(*(batch.column(c).to_pylist() for c in keep)))
            masks = batch.column(mask) if mask else None
            for i, value in enumerate(batch.column(ids)):
                raw = (value.as_py() or b"") + end
                own = None
                if masks is not None and masks[i].is_valid:
                    own = np.frombuffer(masks[i].as_py() + (b"\1" if end else b""), np.uint8)
                packer.add((rows[i], raw, 0, len(raw) // 4), len(raw) // 4, own)
                if len(placed) >= 4096:
                    yield flush()
        packer.finish()
        if placed:
            yield flush()

    return examples.select(*columns).mapInArrow(run, schema)


def instruction_mask(roles: list[str], lengths: list[int], trained: str = "assistant") -> bytes:
    """Loss mask of a conversation whose turns have the given roles and token counts."""
    return b"".join((b"\1" if r == trained else b"\0") * n for r, n in zip(roles, lengths))


