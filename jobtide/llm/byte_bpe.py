"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece exactly one token can stand last in the prefix's own
encoding: a token that ends there and whose border with the last token of the
rest survives the merges. Storing that token per prefix makes appending exact
and cheap, and after an edit only the bytes near it are encoded again.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices, strings

BYTES = 256
# A space next to more white space: there a piece may reach over the space.
WIDE_SPACE = re.compile(r" \s|\s ")
# Bounds of a worker's memory: entries of each table, characters of a key, rows worked on at once.
KEPT, LONGEST_KEPT, ROWS = 1 << 18, 64, 512


class Vocabulary:
    """Rank table of a byte-level BPE; ids are ranks and the 256 bytes come first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        self.longest = max(map(len, ranks))
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self._holds: dict[tuple[int, int], bool] = {}
        for i in range(BYTES, len(self.tokens)):
            token = self.tokens[i]
            splits = [(a, b) for k in range(1, len(token)) if (a := ranks.get(token[:k], i)) < i and (b := ranks.get(token[k:], i)) < i]
            if len(splits) > 1:
                splits = [s for s in splits if self._border(*s)] or splits
            if splits:
                self.parts[i] = splits[0]
                self.joined[splits[0]] = i
        # Finds all tokens that end at each byte, longest first; bytes stand as the characters of the same number.
        self.ending = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.ending.add_word(token.decode("latin-1"), (i, len(token)))
        self.ending.make_automaton()

    def _border(self, a: int, b: int) -> bool:
        """Undo the latest merge beside the border again and again; the border falls if a merge over it would have come earlier."""
        limit = len(self.tokens)
        while True:
            if self.joined.get((a, b), limit) < limit:
                return False
            last = max(a, b)
            if last not in self.parts:
                return True
            # Of equal pairs the left one merges first, so a tie counts only when the right token is undone.
            if a > b:
                limit, a = a, self.parts[a][1]
            else:
                limit, b = b + 1, self.parts[b][0]

    def holds(self, a: int, b: int) -> bool:
        """Whether the bytes of both tokens together encode to exactly these two."""
        known = self._holds.get((a, b))
        if known is None:
            if len(self._holds) > KEPT:
                self._holds.clear()
            known = self._holds[a, b] = self._border(a, b)
        return known


class PrefixEncoder:
    """Encoding of one growing piece; ``last[i]`` is the last token of the first ``i`` bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> PrefixEncoder:
        self.data += more
        self._extend(len(self.data))
        return self

    def _extend(self, end: int) -> None:
        holds, last, begin = self.vocabulary.holds, self.last, len(self.last)
        back = max(0, begin - self.vocabulary.longest)
        for at, (token, size) in self.vocabulary.ending.iter(self.data[back:end].decode("latin-1")):
            i = back + at + 1
            if i == len(last) and (i == size or holds(last[i - size], token)):
                last.append(token)
        if len(last) <= end:
            raise ValueError("no token ends here; the vocabulary lacks a byte")

    def replace(self, start: int, end: int, new: bytes) -> PrefixEncoder:
        """Bytes [start, end) become ``new``. Only the edit and what follows it up to agreement is worked out again."""
        old_last, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last, agree = old_last[: start + 1], 0
        while len(self.last) <= len(self.data):
            at = len(self.last)
            self._extend(at)
            # A prefix depends on the entries within the longest token only; as many equal ones in a row settle the rest.
            agree = agree + 1 if at > start + len(new) and old_last[at - shift] == self.last[at] else 0
            if agree >= self.vocabulary.longest:
                self.last += old_last[at - shift + 1:]
        return self

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at])
            at -= len(self.vocabulary.tokens[self.last[at]])
        return out[::-1]


@lru_cache(maxsize=4)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def load(path: str) -> Vocabulary:
    return Vocabulary(ranks_of(path))


@lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    ranks = ranks_of(path)
    return [t for t, _ in sorted(ranks.items(), key=lambda r: r[1])]


def decode_ids(tokens: list[bytes], ids: bytes) -> bytes:
    """The bytes that little-endian unsigned 32-bit ids stand for."""
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Codec:
    """Encodes and decodes whole texts; the encodings of frequent stretches are kept, up to a bound."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.pieces = vocabulary, regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.known_pieces: dict[str, list[int]] = {}

    def piece(self, piece: str) -> list[int]:
        ids = self.known_pieces.get(piece)
        if ids is None:
            data = piece.encode("utf-8")
            whole = self.vocabulary.ranks.get(data)
            ids = [whole] if whole is not None else PrefixEncoder(self.vocabulary, data).ids()
            if len(piece) <= LONGEST_KEPT:
                if len(self.known_pieces) >= KEPT:
                    self.known_pieces.clear()
                self.known_pieces[piece] = ids
        return ids

    def _stretch(self, stretch: str) -> bytes:
        ids = [i for p in self.pieces.findall(stretch) for i in self.piece(p)]
        out = pack(f"<{len(ids)}I", *ids)
        if len(stretch) <= LONGEST_KEPT:
            if len(self.known) >= KEPT:
                self.known.clear()
            self.known[stretch] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        A single space between other characters always begins a piece, so the
        stretches between such spaces can be encoded one by one.
        """
        known, stretch = self.known, self._stretch
        if WIDE_SPACE.search(text):
            parts = self.pieces.findall(text)
        else:
            first, *rest = text.split(" ")
            parts = [first, *[" " + r for r in rest]]
        return b"".join([known.get(p) or stretch(p) for p in parts])


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(load(path), pattern)


def _with(df: DataFrame, column: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField(column, kind)])


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """Adds ``out_col``: the ids of the whole text as binary, little-endian unsigned 32-bit; null counts as empty.

    Row-local: no shuffle, repeated rows and extra columns pass through, an
    empty table gives an empty result. ``out_col`` must not be taken.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in slices(batches, ROWS):
            ids = pa.array([own.encode(s) for s in strings(batch, text_col)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, out_col])

    return df.mapInArrow(run, _with(df, out_col, T.BinaryType()))


def decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds ``out_col``: the bytes that the ids stand for; null ids decode to nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_bytes(path)
        for batch in slices(batches, ROWS):
            data = pa.array([decode_ids(tokens, i or b"") for i in batch.column(ids_col).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, data], names=[*batch.schema.names, out_col])

    return df.mapInArrow(run, _with(df, out_col, T.BinaryType()))
