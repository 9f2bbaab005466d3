"""Byte-pair encoding of whole texts by forced-boundary splitting.

A pair of neighbouring bytes that occurs inside no token of the vocabulary can never be
bridged by a token, whatever stands around it. Where such a pair is also a place at which
the vocabulary's word splitter starts anew (a change between ASCII letters, digits, other
signs and white space, except after an apostrophe or white space), the text is cut.
Fragments are encoded one by one and their ids are joined. They do not depend on their
neighbours, so the result equals the encoding of the whole text.
"""

import functools
import json
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from logsleuth.llm.texts import blocks, small_batches, text_buffer

#: Fixed value: the word splitter of byte-level vocabularies of this kind.
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Neighbouring fragments are joined to about this many bytes for one call of the encoder.
FRAGMENT_BYTES = 512


def _byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in byte-level vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _restarts() -> np.ndarray:
    """Byte pairs between which the splitter starts anew, whatever stands around them."""
    letters = np.zeros(256, bool)
    letters[65:91] = letters[97:123] = True
    digits = np.zeros(256, bool)
    digits[48:58] = True
    space = np.zeros(256, bool)
    space[9:14] = space[32] = True
    signs = ~letters & ~digits & ~space
    signs[128:] = False
    # Last bytes of the white space beyond ASCII: U+0085, U+00A0, U+1680, U+2000 to U+200A,
    # U+2028, U+2029, U+202F, U+205F, U+3000.
    beyond = np.zeros(256, bool)
    beyond[128:] = True
    beyond[[*range(0x80, 0x8B), 0x85, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = False
    quote = np.zeros(256, bool)
    quote[39] = True
    allowed = np.zeros((256, 256), bool)
    for before, after in (
        (letters, digits | signs | space),
        (digits, letters | signs | space),
        (signs & ~quote, letters | digits | space),
        (quote | beyond, space),
    ):
        allowed |= before[:, None] & after[None, :]
    return allowed


class Vocabulary:
    """A byte-level vocabulary file, its forced boundaries and the tables to go back."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, splitter = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or splitter["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError("not a byte-level BPE vocabulary without normalizer")
        if splitter["add_prefix_space"] or not splitter["use_regex"]:
            raise ValueError("the word splitter differs from SPLITTER")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        letter = _byte_letters()
        tokens = {bytes(letter[c] for c in t): i for t, i in model["vocab"].items()}
        self.special = [a["content"].encode() for a in spec["added_tokens"]]
        ids = dict(tokens)
        ids.update((a["content"].encode(), a["id"]) for a in spec["added_tokens"])
        self.table = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            self.table[i] = token
        self.lengths = np.array([len(t) for t in self.table], np.int64)
        inside = np.zeros(65536, bool)
        for token in ids:
            own = np.frombuffer(token, np.uint8).astype(np.uint16)
            inside[own[:-1] << 8 | own[1:]] = True
        self.forced = ~inside & _restarts().ravel()
        # Ids that grow with the merges are ranks: then the faster encoder gives the same.
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        merged = [model["vocab"][a + b] for a, b in pairs]
        self.ranked = None
        if merged == sorted(merged) and len(tokens) == 256 + len(merged):
            self.ranked = tiktoken.Encoding(
                "vocabulary", pat_str=SPLITTER, mergeable_ranks=tokens, special_tokens={}
            )

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Ids of each document of a block, as little-endian unsigned 32-bit integers."""
        base = int(offsets[0])
        part = data[base : int(offsets[-1])]
        edges = np.asarray(offsets - base)
        cut = np.zeros(len(part) + 1, bool)
        if len(part) > 1:
            cut[1:-1] = self.forced[part[:-1].astype(np.uint16) << 8 | part[1:]]
        cuts = np.flatnonzero(cut)
        cuts = cuts[np.flatnonzero(np.diff(cuts // FRAGMENT_BYTES, prepend=-1))]
        cuts = np.union1d(cuts, edges)
        raw, places = part.tobytes(), cuts.tolist()
        # Below U+0240 both encoders know the same letters; beyond, and for added tokens
        # in the text, the full one is asked.
        full = np.concatenate(([0], np.cumsum(part > 0xC8)))[cuts]
        full = (np.diff(full) > 0).tolist()
        special = [s for s in self.special if s in raw]
        parts = []
        for a, b, rare in zip(places, places[1:], full):
            text = raw[a:b].decode()
            if rare or not self.ranked or any(s in raw[a:b] for s in special):
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            else:
                ids = self.ranked.encode_ordinary(text)
            parts.append(array("I", ids).tobytes())
        first = np.searchsorted(cuts, edges).tolist()
        return [b"".join(parts[a:b]) for a, b in zip(first, first[1:])]

    def encode_text(self, text: str | None) -> bytes:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        return self.encode(raw, np.array([0, len(raw)]))[0]

    def decode(self, ids: bytes | None) -> str:
        """Text of ids; bytes that are no UTF-8 become replacement characters."""
        numbers = np.frombuffer(ids or b"", "<u4").tolist()
        return b"".join(map(self.table.__getitem__, numbers)).decode("utf-8", "replace")


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary for each worker process."""
    return Vocabulary(path)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with ``ids`` (binary, little-endian u32) in place of ``text``.

    Null and empty texts get no ids. All other columns pass, repeated rows stay; a column
    that already has the name of ``ids`` is replaced. No shuffle: a task encodes its own
    rows, with memory for one Arrow batch.
    """
    passing = [c for c in docs.columns if c not in (text, ids)]
    schema = T.StructType([docs.schema[c] for c in passing]).add(ids, "binary")

    def run(batches):
        words = vocabulary(path)
        for batch in batches:
            data, offsets = text_buffer(batch.column(text))
            out = []
            for a, b in blocks(offsets):
                out += words.encode(data, offsets[a : b + 1])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in passing), pa.array(out, pa.binary())], [*passing, ids]
            )

    small_batches(docs.sparkSession)
    return docs.select(*passing, text).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``encoded`` with the ``text`` of its ids; null ids give an empty text."""
    passing = [c for c in encoded.columns if c != text]
    schema = T.StructType([encoded.schema[c] for c in passing]).add(text, "string")

    def run(batches):
        words = vocabulary(path)
        for batch in batches:
            out = [words.decode(x.as_py()) for x in batch.column(ids)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in passing), pa.array(out, pa.string())], [*passing, text]
            )

    return encoded.select(*passing).mapInArrow(run, schema)


def n_ids(ids: str = "ids") -> Column:
    return F.floor(F.octet_length(ids) / 4).cast("long")
