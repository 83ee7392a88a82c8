"""Hard negatives with a multiway hyperplane tree whose split points know how far their siblings' subtrees lie.

Components are scaled to integers, and a score is an integer inner product. One
further coordinate gives all rows the same length, so that scores of an anchor
and distances from it tell the same: a window of scores is a ring around the
anchor. A node has several split points; rows belong to the nearest. Each split
point keeps the least and largest distance to the rows of every sibling, and a
sibling goes when these and the ring cannot meet. Leaves are compared exactly.
"""

from __future__ import annotations

import math
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

LEAF, SPLITS, AT_ONCE = 128, 12, 512
NONE = np.iinfo(np.int64).min


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows; in doubles where these hold them."""
    if a.size and b.size and a.shape[1] * float(np.abs(a).max()) * float(np.abs(b).max()) < 2.0**52:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


class Node:
    """A leaf holds places of rows. Otherwise ``near`` and ``far`` (split, child) bound the distances from a split point to a child's rows."""

    def __init__(self, places: np.ndarray):
        self.places, self.children = places, []

    def split(self, points: np.ndarray, rng: np.random.Generator) -> None:
        """Gives a node of more than LEAF different rows its split points and children."""
        places = self.places
        if len(places) <= LEAF:
            return
        own = points[places]
        pool = rng.choice(len(places), min(3 * SPLITS, len(places)), replace=False)
        chosen = [int(pool[0])]
        gap = np.linalg.norm(own[pool] - own[pool[0]], axis=1)
        while len(chosen) < SPLITS and gap.max() > 0:  # each next split point lies farthest from those before
            chosen.append(int(pool[gap.argmax()]))
            gap = np.minimum(gap, np.linalg.norm(own[pool] - own[chosen[-1]], axis=1))
        if len(chosen) == 1:
            return
        self.splits = own[chosen]
        distance = np.stack([np.linalg.norm(own - s, axis=1) for s in self.splits], axis=1)
        nearest = distance.argmin(1)
        parts = [np.flatnonzero(nearest == j) for j in range(len(chosen))]
        self.near = np.stack([distance[p].min(0) for p in parts], axis=1)
        self.far = np.stack([distance[p].max(0) for p in parts], axis=1)
        self.children = [Node(places[p]) for p in parts]


class SplitTree:
    """The rows of one shard."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, seed: int):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        exact = vectors.astype(np.float64)
        squares = (exact**2).sum(1)
        self.square = float(squares.max())
        self.root = Node(np.arange(len(ids)))
        points, rng, growing = np.hstack([exact, np.sqrt(self.square - squares)[:, None]]), np.random.default_rng(seed), [self.root]
        while growing:
            node = growing.pop()
            node.split(points, rng)
            growing += node.children

    def search(self, own: np.ndarray, labels: np.ndarray, queries: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> list[list[tuple[int, int]]]:
        """For each query the k rows of the highest score in its window low..high, of its label or of others, as (-score, id).

        ``low`` rises as better rows are found. The first walk goes down to one
        leaf per query; the second one visits what the windows still meet.
        """
        exact = queries.astype(np.float64)
        squares = (exact**2).sum(1)
        slack = 1e-6 * (math.sqrt(self.square) + np.sqrt(squares) + 1)
        best: list[list[tuple[int, int]]] = [[] for _ in own]
        low, seen = low.copy(), [None] * len(own)

        def ring(scores: np.ndarray, some: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(squares[some] + self.square - 2 * scores.astype(np.float64), 0))

        def compare(leaf: Node, some: np.ndarray) -> None:
            scores = inner(queries[some], self.vectors[leaf.places])
            fits = (scores >= low[some, None]) & (scores <= high[some, None]) & ((self.labels[leaf.places] == labels[some, None]) == same) & (self.ids[leaf.places] != own[some, None])
            for at, row in zip(*np.nonzero(fits), strict=True):
                q, score = some[at], int(scores[at, row])
                if score < low[q]:
                    continue
                insort(best[q], (-score, int(self.ids[leaf.places[row]])))
                if len(best[q]) > k:
                    best[q].pop()
                if len(best[q]) == k:
                    low[q] = -best[q][-1][0]

        def distances(node: Node, some: np.ndarray) -> np.ndarray:
            plain, last = node.splits[:, :-1], node.splits[:, -1]
            return np.sqrt(np.maximum(squares[some, None] + ((plain**2).sum(1) + last**2) - 2 * exact[some] @ plain.T, 0))

        stack = [(self.root, np.arange(len(own)))]
        while stack:
            node, some = stack.pop()
            if not node.children:
                compare(node, some)
                for q in some:
                    seen[q] = node
                continue
            nearest = distances(node, some).argmin(1)
            stack += [(child, some[nearest == j]) for j, child in enumerate(node.children) if (nearest == j).any()]
        stack = [(self.root, np.flatnonzero(low <= high))]
        while stack:
            node, some = stack.pop()
            if not node.children:
                some = some[[seen[q] is not node for q in some]] if len(some) else some
                if len(some):
                    compare(node, some)
                continue
            away = distances(node, some)
            outer = ring(np.maximum(low[some], -(1 << 62)), some) + slack[some]
            within = ring(np.minimum(high[some], 1 << 62), some) - slack[some]
            for j, child in enumerate(node.children):
                meets = (np.maximum(away - node.far[:, j], node.near[:, j] - away).max(1) <= outer) & ((away + node.far[:, j]).min(1) >= within)
                if meets.any():
                    stack.append((child, some[meets]))
        return best


def usable(rows: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, vec): scaled integer components as little-endian longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for i, label, v in zip(*[batch.column(c).to_pylist() for c in ("id", "label", "vec")], strict=True):
                if i is None or label is None or not v or None in v:
                    continue
                x = np.floor(scale * np.array(v, np.float64))
                if np.isfinite(x).all() and np.abs(x).max() <= math.isqrt((2**63 - 1) // len(v)):
                    kept.append((i, label, x.astype(np.int64).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in kept], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["id", "label", "vec"])

    plain = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("vec"))
    one = plain.mapInArrow(run, "id long, label long, vec binary").groupBy("id").agg(F.min(F.struct("label", "vec")).alias("row"))
    return one.select("id", "row.label", "row.vec")


def _ask(rows: DataFrame, asked: DataFrame, shards: int, seed: int, k: int, windows: bool, percents: tuple[int, int]) -> DataFrame:
    """(anchor_id, positive_id, positive_score, id, score): the k best of each shard for each anchor, or for each of its windows."""
    held = rows.select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "id", "label", "vec", F.lit(None).cast("array<struct<id:bigint,score:bigint>>").alias("positives"))
    # Every anchor goes to every shard as a row; the rows stay where their shard is built.
    dealt = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "id", "label", "vec", "positives")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree, held, asks = None, None, [], []

        def answers() -> pa.RecordBatch:
            nonlocal asks
            wants = [(i, label, v, p) for i, label, v, positives in asks for p in (positives if windows else [{"id": None, "score": None}])] if tree else []
            asks = []
            found = []
            if wants:
                low = np.array([-(-percents[0] * p["score"] // 100) if windows else NONE for *_, p in wants], np.int64)
                high = np.array([percents[1] * p["score"] // 100 if windows else np.iinfo(np.int64).max for *_, p in wants], np.int64)
                best = tree.search(np.array([w[0] for w in wants]), np.array([w[1] for w in wants]), np.stack([np.frombuffer(w[2], np.int64) for w in wants]), low, high, not windows, k)
                found = [(w[0], w[3]["id"], w[3]["score"], i, -s) for w, hits in zip(wants, best, strict=True) for s, i in hits]
            return pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], pa.int64()) for j in range(5)], names=["anchor_id", "positive_id", "positive_score", "id", "score"])

        for batch in batches:
            for s, kind, i, label, v, positives in zip(*[batch.column(c).to_pylist() for c in ("shard", "kind", "id", "label", "vec", "positives")], strict=True):
                if s != shard:
                    if asks:
                        yield answers()
                    shard, tree, held = s, None, []
                if kind == 0:
                    held.append((i, label, v))
                    continue
                if held:
                    tree = SplitTree(np.array([h[0] for h in held]), np.array([h[1] for h in held]), np.stack([np.frombuffer(h[2], np.int64) for h in held]), seed)
                    held = []
                asks.append((i, label, v, positives))
                if len(asks) >= AT_ONCE:
                    yield answers()
        if asks:
            yield answers()

    both = held.unionByName(dealt).repartition("shard").sortWithinPartitions("shard", "kind")
    return both.mapInArrow(run, "anchor_id long, positive_id long, positive_score long, id long, score long")


def hard_negatives(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = 256,
                   positives: int = 5, negatives: int = 3, low_percent: int = 50, high_percent: int = 95, shard_rows: int = 16384, seed: int = 7) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), exact.

    ``is_anchor`` is a condition on ``id``. An anchor's positives are the rows of
    its label with the highest scores; for each, its negatives are the rows of
    other labels with the highest scores between ``low_percent`` and
    ``high_percent`` of the positive's. Equal scores go by the smaller id.

    Rows with a null id or label, a null or empty vector, or a null or non-finite
    component take no part, nor do rows with components so large that a score
    could need over 64 bits, nor vectors whose length is not the commonest (of
    equally common ones, the shorter counts). Of rows that share an id only the
    one of the least (label, vector) counts. An anchor without rows of its label,
    or without rows in a window, gives no row for it. An empty table gives an
    empty result.
    """
    rows = materialize(usable(vectors, id_col, vec_col, label_col, scale), "vectors")
    common = rows.groupBy(F.length("vec").alias("size")).count().orderBy(F.desc("count"), "size").first()
    rows = rows.where(F.length("vec") == (common["size"] if common else 0))
    shards = max(1, math.ceil((common["count"] if common else 0) / shard_rows))
    anchors = rows.where(is_anchor)
    asked = anchors.withColumn("positives", F.lit(None).cast("array<struct<id:bigint,score:bigint>>"))
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    near = _ask(rows, asked, shards, seed, positives, False, (0, 0)).withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
    known = materialize(near.groupBy("anchor_id").agg(F.collect_list(F.struct("id", "score")).alias("positives")), "positives")
    windows = anchors.join(known, F.col("id") == F.col("anchor_id")).drop("anchor_id")
    found = _ask(rows, windows, shards, seed, negatives, True, (low_percent, high_percent))
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
