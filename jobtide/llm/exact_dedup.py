"""Exact deduplication by Grace hashing.

Records are partitioned by the hash of their content into spill tables in the
shared folder. A bucket whose contents outweigh the memory bound is partitioned
again by further bits, until each fits an open-addressing table that compares
complete contents. Copies inside one input batch are folded before the shuffle,
so a group that holds a third of all rows reaches its bucket as one record for
each batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import shuffle_partitions, strings

LOWEST = -(1 << 63)


def content_of(text: str) -> bytes:
    """What two equal texts share: UTF-8 with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower()


class ContentTable:
    """Open addressing with linear probing; a slot is taken by equal hashes only if the whole contents are equal."""

    def __init__(self, capacity: int = 1024):
        self.slots = np.full(capacity, -1, np.int64)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.count: list[int] = []
        self.best: list[tuple] = []

    def _place(self, h: int, content: bytes | None) -> int:
        mask = len(self.slots) - 1
        at = h & mask
        while (i := self.slots[at]) >= 0:
            if content is not None and self.hashes[i] == h and self.contents[i] == content:
                break
            at = (at + 1) & mask
        return at

    def add(self, h: int, content: bytes, n: int, best: tuple) -> int:
        at = self._place(h, content)
        i = int(self.slots[at])
        if i < 0:
            i = self.slots[at] = len(self.hashes)
            self.hashes.append(h)
            self.contents.append(content)
            self.count.append(0)
            self.best.append(best)
            if 2 * len(self.hashes) > len(self.slots):
                self.slots = np.full(4 * len(self.slots), -1, np.int64)
                for j, x in enumerate(self.hashes):
                    self.slots[self._place(x, None)] = j
        self.count[i] += n
        self.best[i] = max(self.best[i], best)
        return int(i)


def _spill(text_col: str, id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, batch in enumerate(batches):
            ids = batch.column(id_col).to_pylist()
            seen: dict[bytes, int] = {}
            rep, tops, n, sizes, hashes = [], {}, {}, [], []
            for i, text in enumerate(strings(batch, text_col)):
                content = content_of(text)
                r = seen.setdefault(content, i)
                rep.append(r)
                n[r] = n.get(r, 0) + 1
                tops[r] = max(tops.get(r, (LOWEST, -1)), (LOWEST if ids[i] is None else ids[i], i))
                sizes.append(len(content))
                hashes.append(xxhash.xxh64_intdigest(content) - (1 << 63) if r == i else None)
            rows = len(rep)
            yield pa.RecordBatch.from_arrays([
                pa.StructArray.from_arrays(batch.columns, names=batch.schema.names),
                pa.array([(part << 32) | k] * rows, pa.int64()), pa.array(range(rows), pa.int32()), pa.array(rep, pa.int32()),
                pa.array(hashes, pa.int64()), pa.array(sizes, pa.int64()),
                pa.array([n[i] if r == i else None for i, r in enumerate(rep)], pa.int64()),
                pa.array([tops[i][0] if r == i else None for i, r in enumerate(rep)], pa.int64()),
                pa.array([tops[i][1] if r == i else None for i, r in enumerate(rep)], pa.int32()),
            ], names=["row", "batch", "ord", "rep", "h", "size", "n", "top_id", "top_ord"])

    return run


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; a bucket's table is dropped when the next one begins."""
    bucket, table, members = None, ContentTable(), []

    def finished():
        shas = [hashlib.sha256(c).hexdigest() for c in table.contents]
        cols = list(zip(*[(b, o, i) for b, o, i in members], strict=True)) or [(), (), ()]
        best = [table.best[i] for i in cols[2]]
        return pa.RecordBatch.from_arrays([
            pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()),
            pa.array([None if b[0] == LOWEST else b[0] for b in best], pa.int64()), pa.array([b[1] for b in best], pa.int64()),
            pa.array([b[2] for b in best], pa.int32()), pa.array([table.count[i] for i in cols[2]], pa.int64()),
            pa.array([shas[i] for i in cols[2]], pa.string()),
        ], names=["batch", "rep", "keep_id", "keep_batch", "keep_ord", "group_size", "text_sha256"])

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("bucket", "h", "text", "n", "top_id", "batch", "top_ord", "ord")]
        for at, h, text, n, top, b, top_ord, o in zip(*cols, strict=True):
            if at != bucket:
                if members:
                    yield finished()
                bucket, table, members = at, ContentTable(), []
            members.append((b, o, table.add(h, content_of(text or ""), n, (top, b, top_ord))))
    if members:
        yield finished()


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", limit_bytes: int = 64 << 20, fanout: int = 64) -> DataFrame:
    """One row per input row: ``row`` (all input columns, whatever their names), ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    The row with the largest id stays; among rows that share even the id, one
    stays. A null id ranks below all others; a group of null ids keeps one of
    its rows and has a null ``keep_id``. An empty table gives an empty result.
    ``limit_bytes`` bounds the contents of a bucket; a single content is one
    record however large.
    """
    spark = docs.sparkSession
    fields = [("batch", T.LongType()), ("ord", T.IntegerType()), ("rep", T.IntegerType()), ("h", T.LongType()), ("size", T.LongType()),
              ("n", T.LongType()), ("top_id", T.LongType()), ("top_ord", T.IntegerType())]
    schema = T.StructType([T.StructField("row", docs.schema), *[T.StructField(n, t) for n, t in fields]])
    spilled = materialize(docs.mapInArrow(_spill(text_col, id_col), schema), "spill")
    records = spilled.where(F.col("n").isNotNull())
    total = records.agg(F.sum("size")).first()[0] or 0
    first = max(4 * shuffle_partitions(spark), fanout, 2 * total // limit_bytes)
    level = records.select(F.pmod("h", F.lit(first)).alias("bucket"), "h", "size", F.col("row")[text_col].alias("text"), "n", "top_id", "batch", "top_ord", "ord")
    fit, depth = [], 0
    while True:
        # A bucket of one hash is one content, which no further bits can part; its table holds it once.
        over = level.groupBy("bucket").agg(F.sum("size").alias("bytes"), F.min("h").alias("lo"), F.max("h").alias("hi")).where((F.col("bytes") > limit_bytes) & (F.col("lo") < F.col("hi"))).select("bucket")
        if over.isEmpty():
            break
        depth += 1
        fit.append(level.join(over, "bucket", "left_anti"))
        deeper = F.col("bucket") * fanout + F.pmod(F.xxhash64("h", F.lit(depth)), F.lit(fanout))
        level = materialize(level.join(over, "bucket", "left_semi").withColumn("bucket", deeper), f"spill{depth}")
    for part in fit:
        level = level.unionByName(part)
    found = level.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        _match, "batch long, rep int, keep_id long, keep_batch long, keep_ord int, group_size long, text_sha256 string")
    return spilled.select("row", "batch", "rep", "ord").join(found, ["batch", "rep"]).select(
        "row", "keep_id", "group_size", ((F.col("batch") == F.col("keep_batch")) & (F.col("ord") == F.col("keep_ord"))).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows that stay, with the input's own columns."""
    return exact_dedup(docs, **options).where("kept").select("row.*")
