"""Approximate nearest neighbours with a forest of hash prefixes.

Rows are dealt to shards of bounded size. A shard holds, for each tree, the
array of its rows' long hash strings in sorted order. A query descends in all
trees to the longest prefix it shares and then climbs in all of them together,
one bit at a time, until enough different candidates share its prefix in some
tree; these are compared on the original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

BITS = 32
AT_ONCE = 1024  # queries hashed together


@dataclass(frozen=True)
class Hasher:
    """Signs of random projections around a centre; ``planes`` is (trees, dimensions, BITS)."""

    centre: np.ndarray
    planes: np.ndarray

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        """(trees, rows) hash strings of BITS bits, the first bit highest."""
        weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        return np.stack([((vectors - self.centre) @ p > 0) @ weights for p in self.planes])


def fit(vectors: DataFrame, trees: int, seed: int, sample: int) -> Hasher | None:
    """The centre comes from at most ``sample`` rows, those of the smallest id hashes; the planes are random."""
    rows = vectors.select(F.xxhash64("id").alias("k"), "id", "vec").orderBy("k", "id").limit(sample).collect()
    if not rows:
        return None
    lengths = [len(r["vec"]) for r in rows]
    common = max(sorted(set(lengths)), key=lengths.count)
    some = np.stack([np.frombuffer(r["vec"], np.float64) for r in rows if len(r["vec"]) == common])
    return Hasher(some.mean(0), np.random.default_rng(seed).standard_normal((trees, some.shape[1], BITS)))


class PrefixForest:
    """Sorted arrays of one shard. Equal vectors are one entry with several ids, smallest first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, hasher: Hasher):
        order = np.argsort(ids, kind="stable")
        self.vectors, place = np.unique(vectors[order], axis=0, return_inverse=True)
        by = np.argsort(place.ravel(), kind="stable")
        self.ids = ids[order][by]
        self.first = np.searchsorted(place.ravel()[by], np.arange(len(self.vectors) + 1))
        hashes = hasher(self.vectors)
        self.order = np.argsort(hashes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(hashes, self.order, 1)

    def candidates(self, hashes: np.ndarray, least: int) -> Iterator[np.ndarray]:
        """For each column of ``hashes``: the entries that share a prefix with it in some tree, at the longest length that gives ``least`` of them."""
        n, trees = len(self.vectors), range(len(self.sorted))
        spans = np.empty((BITS + 1, 2, *hashes.shape), np.int64)
        for length in range(BITS + 1):
            low = hashes >> (BITS - length) << (BITS - length)
            for t in trees:
                spans[length, 0, t] = np.searchsorted(self.sorted[t], low[t])
                spans[length, 1, t] = np.searchsorted(self.sorted[t], low[t] + (1 << (BITS - length)))
        together = (spans[:, 1] - spans[:, 0]).sum(1)
        for q in range(hashes.shape[1]):
            # Entries may be counted once per tree, so this level is where the climb begins, not where it ends.
            length = int(np.flatnonzero(together[:, q] >= min(least, n))[-1])
            found = np.zeros(n, bool)
            while True:
                for t in trees:
                    found[self.order[t, spans[length, 0, t, q]:spans[length, 1, t, q]]] = True
                if length == 0 or np.count_nonzero(found) >= least:
                    break
                length -= 1
            yield np.flatnonzero(found)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, hasher: Hasher, k: int, share: float, floor: int) -> Iterator[tuple[int, int, float]]:
        least = max(k + 1, floor, math.ceil(share * len(self.vectors)))
        for own, query, found in zip(query_ids, queries, self.candidates(hasher(queries), least), strict=True):
            distance = np.sqrt(((self.vectors[found] - query) ** 2).sum(1))
            # An entry gives at most k + 1 ids, so the nearest k + 1 entries, ties included, hold the nearest k ids.
            edge = np.partition(distance, k)[k] if len(distance) > k else np.inf
            near = np.flatnonzero(distance <= edge)
            rows = sorted((distance[i], int(v)) for i in near for v in self.ids[self.first[found[i]]:self.first[found[i] + 1]][: k + 1] if v != own)
            yield from ((int(own), v, float(d)) for d, v in rows[:k])


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec): finite non-zero vectors as little-endian doubles, one an id, the least of its bytes; others, and null ids, take no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vecs = [], []
            for i, v in zip(batch.column("id").to_pylist(), batch.column("vec").to_pylist(), strict=True):
                if i is None or not v or None in v:
                    continue
                x = np.array(v, np.float64)
                if np.isfinite(x).all() and x.any():
                    ids.append(i)
                    vecs.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vecs, pa.binary())], names=["id", "vec"])

    found = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).mapInArrow(run, "id long, vec binary")
    return found.groupBy("id").agg(F.min("vec").alias("vec"))


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, trees: int = 24,
            share: float = 0.6, floor: int = 512, shard_rows: int = 4096, seed: int = 7, sample: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query by Euclidean distance, ties to the smaller id.

    A query's own row, known by its id, is no candidate. ``share`` is the part of
    a shard's different vectors that a query must gather before it stops
    climbing, and ``floor`` their least number: they set recall, the same at every
    size, since shards do not grow.
    Vectors that are null, empty, zero, or hold a null or non-finite component
    take no part, nor do vectors whose length is not the sample's commonest. Rows
    that share an id are one vector, the least by its bytes, as query and as
    candidate. Equal vectors are indexed once per shard and all found. An empty table gives an
    empty result.
    """
    base = materialize(usable(vectors, id_col, vec_col), "vectors")
    hasher = fit(base, trees, seed, sample)
    if hasher is None:
        return base.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    size = 8 * len(hasher.centre)
    base = base.where(F.length("vec") == size)
    shards = max(1, math.ceil(base.count() / shard_rows))
    rows = base.select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "id", "vec")
    # Every query goes to every shard, as a row of its own; the vectors stay where their shard is built.
    asked = usable(queries, id_col, vec_col).where(F.length("vec") == size).select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "id", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, forest, ids, vecs, asks = None, None, [], [], []

        def answers():
            nonlocal asks
            found = list(forest.search(np.array([i for i, _ in asks]), np.stack([np.frombuffer(v) for _, v in asks]), hasher, k, share, floor)) if asks and forest else []
            asks = []
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64())],
                                              names=["query_id", "vec_id", "score"])

        for batch in batches:
            for s, kind, i, v in zip(*[batch.column(c).to_pylist() for c in ("shard", "kind", "id", "vec")], strict=True):
                if s != shard:
                    if asks:
                        yield answers()
                    shard, forest, ids, vecs = s, None, [], []
                if kind == 0:
                    ids.append(i)
                    vecs.append(np.frombuffer(v))
                    continue
                if forest is None and ids:
                    forest, ids, vecs = PrefixForest(np.array(ids), np.stack(vecs), hasher), [], []
                asks.append((i, v))
                if len(asks) >= AT_ONCE:
                    yield answers()
        if asks:
            yield answers()

    found = rows.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
