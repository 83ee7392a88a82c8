"""Removal of repeated passages with a logarithmic family of suffix arrays.

Every byte string of ``length`` bytes holds an anchor: the leftmost least hash of
its inner ``GRAM``-byte strings, the same wherever the string occurs. Anchors that
occur in one document only are dropped first, by short hashes. The text around
the others goes to the bucket of its anchor. There each new batch gets a suffix
array, which is scanned against the arrays of all levels for strings that stand
in both; the smaller document is noted on either side, and arrays of one size
merge.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import shuffle_partitions, slices

LENGTH, GRAM = 50, 26
WINDOW = LENGTH - GRAM + 1  # gram places in a string
PRIME = 0x9E3779B97F4A7C15
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
NONE = -(1 << 63)


def squeeze(*arrays: np.ndarray | bytes, level: int = 3) -> bytes:
    """Arrays in one compressed frame, each after its length."""
    parts = [a if isinstance(a, bytes) else a.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=level).compress(np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts))


def unsqueeze(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    sizes = np.frombuffer(raw, np.int64, len(kinds)).tolist()
    out, at = [], 8 * len(kinds)
    for size, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def anchors(data: np.ndarray, begins: np.ndarray, open_docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, last, document) of each anchor: it stands for the strings that start in [first, last].

    ``begins`` holds where each document begins and, last, the end; documents
    that are not ``open_docs`` have no strings.
    """
    none = tuple(np.zeros(0, k) for k in (np.uint64, np.int64, np.int64, np.int64))
    n = len(data)
    if n < LENGTH:
        return none
    power = lambda k: np.uint64(pow(PRIME, k, 1 << 64))
    one = data.astype(np.uint64) + np.uint64(1)
    two = one[:-1] * power(1) + one[1:]
    four = two[:-2] * power(2) + two[2:]
    eight = four[:-4] * power(4) + four[4:]
    sixteen = eight[:-8] * power(8) + eight[8:]
    gram = sixteen[:-8] * power(8) + eight[16:]
    gram = gram[:-2] * power(2) + two[24:]
    del one, two, four, eight, sixteen
    gram ^= gram >> np.uint64(31)
    gram *= np.uint64(0xBF58476D1CE4E5B9)
    gram ^= gram >> np.uint64(29)
    doc = np.repeat(np.arange(len(begins) - 1, dtype=np.int32), np.diff(begins))
    end = begins[1:][doc]
    places = np.arange(len(gram))
    gram[places + GRAM > end[:len(gram)]] = TOP

    def both(a, b, shift):
        """Least of two neighbouring stretches and its place, the left one where they tie."""
        (x, i), (y, j) = a, b
        left = x <= y
        return np.where(left, x, y), np.where(left, i, j + np.uint8(shift))

    at = {1: (gram, np.zeros(len(gram), np.uint8))}
    size = 1
    while 2 * size <= WINDOW:
        x, i = at[size]
        at[2 * size] = both((x[:-size], i[:-size]), (x[size:], i[size:]), size)
        size *= 2
    least, rest = at[size], WINDOW - size
    done = size
    for part in (8, 4, 2, 1):
        if rest & part:
            x, i = at[part]
            m = len(gram) - done - part + 1
            least = both((least[0][:m], least[1][:m]), (x[done:done + m], i[done:done + m]), done)
            done += part
    start = np.flatnonzero((np.arange(len(least[0])) + LENGTH <= end[:len(least[0])]) & open_docs[doc[:len(least[0])]])
    if not len(start):
        return none
    place = start + least[1][start]
    cut = np.flatnonzero((np.diff(place) != 0) | (np.diff(start) != 1))
    first, last = start[np.concatenate(([0], cut + 1))], start[np.concatenate((cut, [len(start) - 1]))]
    return gram[place[np.concatenate(([0], cut + 1))]], first, last, doc[first].astype(np.int64)


@dataclass
class Level:
    """One suffix array: ascending different suffixes, the least worth of each anywhere in the family, and which suffix each owner has."""

    keys: np.ndarray
    least: np.ndarray
    owner: np.ndarray
    of: np.ndarray


class SuffixFamily:
    """Suffix arrays of up to ``LENGTH`` bytes in levels of growing size.

    The array of a new batch is scanned against every level when it comes; both
    sides of an equal suffix then know the least worth of the two. Afterwards it
    merges with the levels of about its size.
    """

    def __init__(self):
        self.levels: list[Level] = []
        self.owners = self.found = 0

    def add(self, suffixes: np.ndarray, worth: np.ndarray) -> None:
        """``suffixes`` of the owners that follow those added before, each with its ``worth``."""
        order = np.argsort(suffixes, kind="stable")
        new = np.flatnonzero(np.concatenate(([True], suffixes[order[1:]] != suffixes[order[:-1]]))) if len(order) else order
        level = Level(suffixes[order[new]], np.minimum.reduceat(worth[order], new) if len(new) else worth, order + self.owners, np.repeat(np.arange(len(new)), np.diff(new, append=len(order))))
        self.owners += len(order)
        # The merge of two sorted arrays is their scan; larger levels are searched for the new suffixes alone.
        fresh = np.ones(len(level.keys), bool)
        while self.levels and len(self.levels[-1].keys) < 2 * len(level.keys):
            level, fresh = self._merged(self.levels.pop(), level, fresh)
        own, met = np.flatnonzero(fresh), []
        for old in self.levels:
            at = np.minimum(np.searchsorted(old.keys, level.keys[own]), len(old.keys) - 1)
            hit = np.flatnonzero(old.keys[at] == level.keys[own])
            level.least[own[hit]] = np.minimum(level.least[own[hit]], old.least[at[hit]])
            met.append((old, at[hit], own[hit]))
            self.found += len(hit)
        for old, at, hit in met:
            old.least[at] = level.least[hit]
        if len(level.keys):
            self.levels.append(level)

    def _merged(self, a: Level, b: Level, fresh: np.ndarray) -> tuple[Level, np.ndarray]:
        """One level of two, and which of its suffixes are ``fresh`` ones of b; equal suffixes take the lesser worth."""
        keys = np.concatenate((a.keys, b.keys))
        order = np.argsort(keys, kind="stable")  # two sorted runs: one merge
        first = np.flatnonzero(np.concatenate(([True], keys[order[1:]] != keys[order[:-1]])))
        place = np.empty(len(keys), np.int64)
        place[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(keys)))
        new = np.zeros(len(first), bool)
        new[place[len(a.keys):][fresh]] = True
        self.found += len(keys) - len(first)
        least = np.minimum.reduceat(np.concatenate((a.least, b.least))[order], first)
        return Level(keys[order[first]], least, np.concatenate((a.owner, b.owner)), place[np.concatenate((a.of, b.of + len(a.keys)))]), new

    def least(self) -> np.ndarray:
        """For each owner, the least worth among the owners of an equal suffix."""
        out = np.zeros(self.owners, np.int64)
        for level in self.levels:
            out[level.owner] = level.least[level.of]
        return out


# --- batches of documents --------------------------------------------------------------------------------------------

def _batches(text_col: str, id_col: str, batch_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, ids, texts, held = TaskContext.get().partitionId(), 0, [], [], 0

        def closed():
            lengths = np.array([len(t) for t in texts], np.int64)
            return pa.RecordBatch.from_arrays([
                pa.array([(part << 32) | seq], pa.int64()),
                pa.array([squeeze(np.array([NONE if i is None else i for i in ids], np.int64), lengths, b"".join(texts), level=6)], pa.binary())], names=["batch", "data"])

        for batch in slices(batches, 256):
            for i, t in zip(batch.column(id_col).to_pylist(), batch.column(text_col).to_pylist(), strict=True):
                t = (t or "").encode("utf-8", "surrogatepass")
                if ids and held + len(t) > batch_bytes:
                    yield closed()
                    seq, ids, texts, held = seq + 1, [], [], 0
                ids.append(i)
                texts.append(t)
                held += len(t)
        if ids:
            yield closed()

    return run


def _opened(data: bytes):
    ids, lengths, text = unsqueeze(data, "i8", "i8", "u1")
    return ids, np.concatenate(([0], np.cumsum(lengths))), text


def _keyed(batches: Iterator[pa.RecordBatch], key: str, columns: tuple[str, ...]):
    """(key, rows) of runs of equal keys in sorted input."""
    at, rows = None, []
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in (key, *columns)], strict=True):
            if rows and row[0] != at:
                yield at, rows
                rows = []
            at = row[0]
            rows.append(row[1:])
    if rows:
        yield at, rows


def _split(buckets: np.ndarray, *arrays: np.ndarray):
    """(bucket, arrays of it) in ascending order of buckets."""
    order = np.argsort(buckets, kind="stable")
    edge = np.flatnonzero(np.diff(buckets[order])) + 1
    for rows in np.split(order, edge) if len(order) else []:
        yield int(buckets[rows[0]]), [a[rows] for a in arrays]


def _short(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    return (hashes % np.uint64(buckets)).astype(np.int64), ((hashes // np.uint64(buckets)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _rows(first: list, second: list, data: list, names: tuple[str, str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(data, pa.binary())], names=[*names, "data"])


def _announce(buckets: int):
    """The short hashes of a batch's anchors, by bucket, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in _keyed(batches, "batch", ("data",)):
            for (data,) in rows:
                ids, begins, text = _opened(data)
                bucket, short = _short(np.unique(anchors(text, begins, ids != NONE)[0]), buckets)
                out = [(b, squeeze(np.diff(np.unique(s), prepend=np.uint32(0)))) for b, (s,) in _split(bucket, short)]
                yield _rows([b for b, _ in out], [batch] * len(out), [d for _, d in out], ("bucket", "batch"))

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a bucket's short hashes, those of more than one batch, to each batch that has them."""
    for bucket, rows in _keyed(batches, "bucket", ("batch", "data")):
        each = [np.cumsum(unsqueeze(d, "u4")[0], dtype=np.uint32) for _, d in rows]
        found, count = np.unique(np.concatenate(each), return_counts=True)
        found = found[count > 1]
        kept = [(b, s) for (b, _), s in zip(rows, (e[np.isin(e, found, assume_unique=True)] for e in each), strict=True) if len(s)]
        yield _rows([b for b, _ in kept], [bucket] * len(kept), [squeeze(s) for _, s in kept], ("batch", "bucket"))


def _ask(buckets: int):
    """The text around each shared anchor, by bucket: contexts with the batch's smallest document, and the places that wait for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in _keyed(batches, "batch", ("bucket", "data")):
            known = [np.uint64(b) << np.uint64(32) | unsqueeze(d, "u4")[0].astype(np.uint64) for b, d in rows if b >= 0]
            ids, begins, text = _opened(next(d for b, d in rows if b < 0))
            hashes, first, last, doc = anchors(text, begins, ids != NONE)
            if not len(hashes):
                continue
            bucket, short = _short(hashes, buckets)
            shared = np.isin(bucket.astype(np.uint64) << np.uint64(32) | short, np.concatenate(known)) if known else np.zeros(len(hashes), bool)
            # Anchors of several documents of this batch need no word from others.
            order = np.lexsort((ids[doc], hashes))
            begin = np.flatnonzero(np.concatenate(([True], np.diff(hashes[order]) != 0)))
            run_end = np.concatenate((begin[1:], [len(order)])) - 1
            several = np.repeat(ids[doc][order][begin] != ids[doc][order][run_end], run_end - begin + 1)
            shared[order[several]] = True
            some = np.flatnonzero(shared)
            some = some[np.argsort(ids[doc[some]], kind="stable")]
            raw, out = text.tobytes(), []
            for b, (rows_of,) in _split(bucket[some], some):
                seen: dict[bytes, int] = {}
                contexts, docs, places, of, settled = [], [], [], [], []
                for f, l, d in zip(first[rows_of].tolist(), last[rows_of].tolist(), ids[doc[rows_of]].tolist(), strict=True):
                    context = raw[f:l + LENGTH]
                    i = seen.setdefault(context, len(contexts))
                    if i == len(contexts):
                        contexts.append(context)
                        docs.append(d)
                    if d > docs[i]:
                        settled.append((f, l - f + 1))
                    else:
                        places.append(f)
                        of.append(i)
                out.append((b, squeeze(np.array(docs, np.int64), np.array([len(c) for c in contexts], np.uint8), b"".join(contexts), np.array(places, np.uint32),
                                       np.array(of, np.uint32), np.array([s for s, _ in settled], np.uint32), np.array([w for _, w in settled], np.uint8))))
            yield _rows([b for b, _ in out], [batch] * len(out), [d for _, d in out], ("bucket", "batch"))

    return run


def _answer(batch_suffixes: int):
    """Which strings around each anchor stand in a smaller document too: a bit for each, to the batch that asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _keyed(batches, "bucket", ("batch", "data")):
            seen: dict[bytes, int] = {}
            least, asked = [], []
            for batch, data in rows:
                docs, sizes, text, places, of, settled, width = unsqueeze(data, "i8", "u1", "u1", "u4", "u4", "u4", "u1")
                raw, ends = text.tobytes(), np.cumsum(sizes, dtype=np.int64)
                own = []
                for d, e, s in zip(docs.tolist(), ends.tolist(), sizes.tolist(), strict=True):
                    i = seen.setdefault(raw[e - s:e], len(least))
                    if i == len(least):
                        least.append(d)
                    else:
                        least[i] = min(least[i], d)
                    own.append(i)
                asked.append((batch, docs, np.array(own, np.int64), places, of, settled, width))
            contexts, low = list(seen), np.array(least, np.int64)
            count = np.array([len(c) - LENGTH + 1 for c in contexts], np.int64)
            base = np.concatenate(([0], np.cumsum(count)))
            owner_doc = np.repeat(low, count)
            family = SuffixFamily()
            begin = 0
            while begin < len(contexts):
                stop = max(begin + 1, int(np.searchsorted(base, base[begin] + batch_suffixes, "right")) - 1)
                text = np.frombuffer(b"".join(contexts[begin:stop]), np.uint8)
                shift = np.repeat(np.arange(stop - begin) * (LENGTH - 1), count[begin:stop])
                where = np.arange(base[stop] - base[begin]) + shift
                family.add(np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, LENGTH)[where]).view(f"S{LENGTH}").ravel(), owner_doc[base[begin]:base[stop]])
                begin = stop
            repeated = family.least() < owner_doc if len(contexts) else np.zeros(0, bool)
            bits = np.where(repeated, 1 << (np.arange(len(repeated)) - np.repeat(base[:-1], count)), 0)
            mask = np.add.reduceat(bits, base[:-1]).astype(np.uint32) if len(contexts) else np.zeros(0, np.uint32)
            full = ((1 << count) - 1).astype(np.uint32)
            out = []
            for batch, docs, own, places, of, settled, width in asked:
                masks = np.where(docs > low[own], full[own], mask[own])[of]
                hit = masks > 0
                out.append((batch, squeeze(np.concatenate((places[hit], settled)), np.concatenate((masks[hit], ((1 << width.astype(np.int64)) - 1).astype(np.uint32))))))
            yield _rows([b for b, _ in out], [bucket] * len(out), [d for _, d in out], ("batch", "bucket"))

    return run


def _cut(id_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _keyed(batches, "batch", ("bucket", "data")):
            ids, begins, text = _opened(next(d for b, d in rows if b < 0))
            step = np.zeros(len(text) + 1, np.int32)
            for b, d in rows:
                if b >= 0:
                    places, masks = unsqueeze(d, "u4", "u4")
                    for bit in range(WINDOW):
                        at = places[masks >> np.uint32(bit) & np.uint32(1) > 0].astype(np.int64) + bit
                        np.add.at(step, at, 1)
                        np.add.at(step, at + LENGTH, -1)
            gone = np.cumsum(step[:-1]) > 0
            spans, kept = [], []
            for s, e in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                edge = np.flatnonzero(np.diff(gone[s:e].astype(np.int8), prepend=0, append=0))
                spans.append([{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()])
                kept.append(text[s:e][~gone[s:e]].tobytes())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([
                pa.array([None if i == NONE else i for i in ids.tolist()], pa.int64()), pa.array(np.diff(begins).astype(np.int64)), pa.array(spans, kind), pa.array(kept, pa.binary())],
                names=[id_name, "n_bytes", "spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", batch_bytes: int = 2 << 20, batch_suffixes: int = 1 << 18) -> DataFrame:
    """(id, n_bytes, spans, kept): the bytes left of each text, and the runs removed from it as byte offsets, end exclusive.

    A byte goes if a 50-byte string that covers it also starts in a document of a
    smaller id; all strings are judged on the input. Null text is empty. Rows
    that share an id do not remove from each other. A row with a null id neither
    loses nor removes anything. An empty table gives an empty result. Memory of
    a task follows ``batch_bytes``, or the longest text, and the bucket.
    """
    buckets = 4 * shuffle_partitions(docs.sparkSession)
    table = materialize(docs.select(id_col, text_col).mapInArrow(_batches(text_col, id_col, batch_bytes), "batch long, data binary"), "batches")
    body = table.select("batch", F.lit(-1).cast("long").alias("bucket"), "data")
    to_bucket, to_batch = "bucket long, batch long, data binary", "batch long, bucket long, data binary"
    announced = table.mapInArrow(_announce(buckets), to_bucket)
    shared = announced.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_shared, to_batch)
    asked = body.unionByName(shared).repartition("batch").sortWithinPartitions("batch").mapInArrow(_ask(buckets), to_bucket)
    answers = asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_answer(batch_suffixes), to_batch)
    return body.unionByName(answers).repartition("batch").sortWithinPartitions("batch").mapInArrow(
        _cut(id_col), f"{id_col} long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
