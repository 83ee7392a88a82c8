"""Jaccard join of documents on their word n-grams by rare-first prefix filtering.

All n-grams are ordered by the number of documents that hold them, then by hash.
Two sets that are alike enough share an n-gram within their prefixes: the first
few places in that order. N-grams of a single document come first and match
nothing, so a document with enough of them is done at once; of the others, the
shared n-grams are all that a comparison needs.

Documents are dealt to blocks. A block asks, once per different n-gram, how many
documents hold it; n-gram ranges count over all blocks and answer for those that
are shared. Prefix rows then meet by n-gram under length, positional and suffix
filters, and each pair is verified once, on whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import power_of_two, shuffle_partitions
from .components import components
from .simhash import remix, shingle_hashes

BLOCK_BYTES = 4 << 20  # text of a block
RANGE_BYTES = 12 << 20  # text whose n-grams one range counts
KEY_BITS, KEY_BYTES = 48, 6  # a question carries so much of a hash
PARTS = 512  # a suffix is told apart by the parity of so many parts
TILE = 4096  # prefix rows of one n-gram compared by one task
SALTS = 16  # classes of the rows of one set


def least_overlap(a, b, percent: int):
    """Shared n-grams that two sets of these sizes need; works on numbers and arrays."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


# --- rare-first order ------------------------------------------------------------------------------------------------

class Block:
    """The documents of a block: their sets, and the keys of their different n-grams in ascending order."""

    def __init__(self, texts: list[str | None], shingle: int):
        self.sets = [np.unique(shingle_hashes(t or "", shingle)) for t in texts]
        self.flat = np.concatenate(self.sets) if self.sets else np.zeros(0, np.uint64)
        self.keys, self.place, self.counts = np.unique(self.flat >> np.uint64(64 - KEY_BITS), return_inverse=True, return_counts=True)

    def edges(self, bits: int) -> np.ndarray:
        """Where each of the 2^bits ranges begins among the keys."""
        return np.searchsorted(self.keys, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(KEY_BITS - bits))


def packed(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // KEY_BYTES, 8), np.uint8)
    wide[:, :KEY_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, KEY_BYTES)
    return wide.view("<u8").ravel()


def _ask(shingle: int, bits: int):
    def run(table: pa.Table) -> pa.Table:
        block = Block(table.column("text").to_pylist(), shingle)
        edges = block.edges(bits)
        full = np.flatnonzero(np.diff(edges))
        cut = [slice(edges[r], edges[r + 1]) for r in full]
        return pa.table({
            "range": pa.array(full, pa.int32()), "block": pa.array([table.column("block")[0].as_py()] * len(full), pa.int32()),
            "keys": pa.array([packed(block.keys[c]) for c in cut], pa.binary()), "counts": pa.array([block.counts[c].astype(np.uint32).tobytes() for c in cut], pa.binary())})

    return run


def _answer(table: pa.Table) -> pa.Table:
    """For each block that asked: which of its keys, by place, are held by more than one document, and by how many."""
    asked = [unpacked(k) for k in table.column("keys").to_pylist()]
    _, place = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.bincount(place, weights=np.concatenate([np.frombuffer(c, np.uint32) for c in table.column("counts").to_pylist()]))[place].astype(np.int64)
    ends = np.cumsum([len(a) for a in asked])
    rows = []
    for block, low, high in zip(table.column("block").to_pylist(), ends - [len(a) for a in asked], ends, strict=True):
        shared = np.flatnonzero(total[low:high] > 1)
        if len(shared):
            rows.append((block, table.column("range")[0].as_py(), shared.astype(np.uint32).tobytes(), total[low:high][shared].tobytes()))
    return pa.table([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["block", "range", "places", "totals"])


def _order(shingle: int, bits: int, percent: int):
    """Rows (id, n, whole, singles, shared): ``shared`` in rare-first order, and only where a prefix reaches into it."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(table.column("text").to_pylist(), shingle)
        edges, totals = block.edges(bits), np.ones(len(block.keys), np.int64)
        for r, places, counts in zip(*[answers.column(c).to_pylist() for c in ("range", "places", "totals")], strict=True):
            totals[edges[r] + np.frombuffer(places, np.uint32).astype(np.int64)] = np.frombuffer(counts, np.int64)
        held, end, rows = totals[block.place], 0, []
        for own, hashes in zip(table.column("id").to_pylist(), block.sets, strict=True):
            n, counts = len(hashes), held[end:end + len(hashes)]
            end += n
            singles = int(np.count_nonzero(counts == 1))
            row = (own, n, None, singles, None)
            if n and singles < prefix_length(n, percent):
                some = np.flatnonzero(counts > 1)
                row = (own, n, xxhash.xxh128_digest(hashes.tobytes()), singles, hashes[some[np.lexsort((hashes[some], counts[some]))]].view(np.int64))
            rows.append(row)
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()))
        return pa.table([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=["id", "n", "whole", "singles", "shared"])

    return run


def ordered_sets(docs: DataFrame, shingle: int, percent: int, text_col: str, id_col: str) -> DataFrame:
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = shuffle_partitions(docs.sparkSession)
    blocks, bits = max(parts, math.ceil(size / BLOCK_BYTES)), power_of_two(max(parts, size / RANGE_BYTES)).bit_length() - 1
    # Both uses of the blocks read one shuffle of the texts.
    placed = texts.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int")).repartition("block")
    asked = placed.groupBy("block").applyInArrow(_ask(shingle, bits), "range int, block int, keys binary, counts binary")
    answers = asked.groupBy("range").applyInArrow(_answer, "block int, range int, places binary, totals binary")
    return placed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_order(shingle, bits, percent), "id long, n long, whole binary, singles long, shared array<long>")


# --- candidates ------------------------------------------------------------------------------------------------------

def _prefixes(percent: int):
    """A row per prefix place that a shared n-gram takes, with the parity of the parts of what follows it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, n, whole, singles, shared in zip(*[batch.column(c).to_pylist() for c in ("id", "n", "whole", "singles", "shared")], strict=True):
                grams = np.array(shared, np.int64)
                part = (remix(grams.view(np.uint64), 1) % np.uint64(PARTS)).astype(np.int64)
                places = np.arange(prefix_length(n, percent) - singles)
                follows = np.zeros((len(places), PARTS), bool)
                left = np.bincount(part, minlength=PARTS) % 2 == 1
                for k in places:
                    left[part[k]] ^= True
                    follows[k] = left
                bits = np.packbits(follows, axis=1)
                yield pa.RecordBatch.from_arrays([
                    pa.array(grams[places]), pa.array([own] * len(places), pa.int64()), pa.array([whole] * len(places), pa.binary()), pa.array([n] * len(places), pa.int64()),
                    pa.array(places + singles), pa.array([b.tobytes() for b in bits], pa.binary())], names=["gram", "id", "whole", "n", "place", "follows"])

    return run


class Bucket:
    """Prefix rows of one n-gram (or of two pieces of them), sorted; pairs pass the length, positional and suffix filters."""

    def __init__(self, rows: pa.RecordBatch, percent: int, crossing: bool):
        self.n, self.place, self.part = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("n", "place", "part"))
        self.side = rows.column("side").to_numpy() if crossing else None
        self.follows = np.frombuffer(b"".join(rows.column("follows").to_pylist()), np.uint64).reshape(-1, PARTS // 64)
        self.percent = percent

    def pass_with(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` that pass with row i, as if this n-gram were the first they share: at that one, no link is lost."""
        n, place = self.n[others], self.place[others]
        need = least_overlap(n, self.n[i], self.percent)
        ok = self.percent * np.maximum(n, self.n[i]) <= 100 * np.minimum(n, self.n[i])
        ok &= 1 + np.minimum(n - place, self.n[i] - self.place[i]) - 1 >= need
        if self.side is not None:
            ok &= self.side[others] != self.side[i]
        some = others[ok]
        apart = np.bitwise_count(self.follows[some] ^ self.follows[i]).sum(1, dtype=np.int64) + self.place[some] + self.place[i]
        return some[apart <= self.n[some] + self.n[i] - 2 * need[ok]]

    def forest(self) -> tuple[list[tuple[int, int]], bool]:
        """Pairs that join all rows which passing pairs join."""
        pairs, free = [], np.arange(len(self.n))
        while len(free):
            queue, free = [free[0]], free[1:]
            while queue and len(free):
                i = queue.pop()
                new = self.pass_with(i, free)
                pairs += [(i, j) for j in new]
                queue += new.tolist()
                free = np.setdiff1d(free, new, assume_unique=True)
        return pairs, False

    def between(self, most: int) -> tuple[list[tuple[int, int]], bool]:
        """Passing pairs between different parts, at most so many for two parts, and whether there are more."""
        pairs, counts, more = [], {}, False
        for i in range(len(self.n)):
            later = np.arange(i + 1, len(self.n))
            for j in self.pass_with(i, later[self.part[later] != self.part[i]]):
                key = (self.part[i], self.part[j]) if self.part[i] < self.part[j] else (self.part[j], self.part[i])
                counts[key] = counts.get(key, 0) + 1
                if counts[key] <= most:
                    pairs.append((i, j))
                else:
                    more = True
        return pairs, more


KEY = ("gram", "one", "two")


def _meet(percent: int, most: int | None):
    """Rows (a, b, more): pairs of sets to verify. A row without a pair says that a bucket holds back some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: pa.RecordBatch) -> tuple[list, list]:
            bucket = Bucket(rows, percent, rows.column("one")[0].as_py() != rows.column("two")[0].as_py())
            pairs, more = bucket.forest() if most is None else bucket.between(most)
            whole = rows.column("whole").to_pylist()
            ordered = [sorted((whole[i], whole[j])) for i, j in pairs]
            return [a for a, _ in ordered] + [None] * more, [b for _, b in ordered] + [None] * more

        def parts(table: pa.Table, last: bool) -> tuple[list[tuple[list, list]], pa.Table]:
            table = table.combine_chunks()
            key = np.stack([table.column(c).to_numpy() for c in KEY])
            starts = np.concatenate(([0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1, [table.num_rows]))
            whole = len(starts) - 1 if last else len(starts) - 2
            cut = [table.slice(starts[k], starts[k + 1] - starts[k]) for k in range(whole) if starts[k + 1] - starts[k] > 1]
            return [found(c.combine_chunks().to_batches()[0]) for c in cut], table.slice(starts[whole])

        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            pairs, rest = parts(now if rest is None else pa.concat_tables([rest, now]), False)
            yield pa.RecordBatch.from_arrays([pa.array([x for p in pairs for x in p[j]], pa.binary()) for j in range(2)], names=["a", "b"])
        if rest is not None and rest.num_rows:
            pairs, _ = parts(rest, True)
            yield pa.RecordBatch.from_arrays([pa.array([x for p in pairs for x in p[j]], pa.binary()) for j in range(2)], names=["a", "b"])

    return run


def meet(rows: DataFrame, percent: int, most: int | None) -> DataFrame:
    """Candidates among prefix rows (gram, id, whole, n, place, follows, part). N-grams of over TILE rows are cut into pairs of pieces."""
    sizes = rows.groupBy("gram").agg(F.count("*").alias("rows"), F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high")
    cut = rows.join(sizes.select("gram", F.ceil(F.col("rows") / TILE).cast("int").alias("pieces")), "gram").withColumn("piece", F.pmod(F.xxhash64("whole"), F.col("pieces")).cast("int"))
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select(
        "gram", F.least("piece", "other").alias("one"), F.greatest("piece", "other").alias("two"), F.when(F.col("piece") <= F.col("other"), 1).otherwise(2).alias("side"),
        "id", "whole", "n", "place", "part", "follows")
    return dealt.repartition(*KEY).sortWithinPartitions(*KEY, "id", "whole").mapInArrow(_meet(percent, most), "a binary, b binary")


# --- links -----------------------------------------------------------------------------------------------------------

def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, id_a, id_b, linked): exact similarity of pairs of sets. A set is one row, so a hot one is split by the join."""
    side = lambda s: sets.select(F.col("whole").alias(s), F.col("id").alias(f"id_{s}"), F.col("n").alias(f"n_{s}"), F.col("shared").alias(f"shared_{s}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").withColumn("both", F.size(F.array_intersect("shared_a", "shared_b")))
    return both.select("a", "b", "id_a", "id_b", (100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))).alias("linked"))


def links(sets: DataFrame, members: DataFrame, percent: int, most: int = 16) -> DataFrame:
    """(node, component) of ids over links of sets (id, n, whole, singles, shared) and over ``members`` (a, b).

    First, each n-gram's candidates are verified along a forest. Where a pair of
    it fails, pairs between groups that are still apart follow, more in each
    round, until none is held back; no pair is verified twice.
    """
    prefixes = sets.mapInArrow(_prefixes(percent), "gram long, id long, whole binary, n long, place long, follows binary")
    met = prefixes.groupBy("gram").agg(F.count("*").alias("rows")).where("rows > 1").select("gram")
    prefixes = materialize(prefixes.join(met, "gram"), "prefixes")
    tested, joined, limit = None, None, None
    while True:
        rows = prefixes.withColumn("part", F.col("id")) if joined is None else prefixes.join(joined, F.col("id") == F.col("node"), "left").withColumn("part", F.coalesce("component", "id")).drop("node", "component")
        found = meet(rows, percent, limit).distinct()
        found = materialize(found if tested is None else found.join(tested, ["a", "b"], "left_anti"), "candidates")
        new = materialize(verify(found.where("a is not null"), sets, percent), "verified")
        held_back = limit is not None and not found.where("a is null").isEmpty()
        failed = not new.where("not linked").isEmpty()
        tested = new if tested is None else tested.unionByName(new)
        joined = components(tested.where("linked").select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).unionByName(members))
        if not (failed if limit is None else held_back):
            return joined
        limit = most if limit is None else 8 * limit


def jaccard_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 3, percent: int = 90) -> DataFrame:
    """(id, n_shingles, component_id) per row: the size of its set of n-grams and the least id reachable over links.

    Two documents link when 100 times the size of the intersection of their sets
    reaches ``percent`` times that of the union. Words are cut at white space,
    A-Z lower-cased; a text of fewer words than ``shingle`` has its whole
    sequence as its one n-gram. N-grams are told apart by 64-bit hashes.

    Texts without words (null, empty, blank) have an empty set and link with
    nothing. Rows of equal sets are folded to one. Rows that share an id are one
    document where they link. A row with a null id gets its size, and null as its
    component. An empty table gives an empty result.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent is above 0 and at most 100")
    every = materialize(ordered_sets(docs, shingle, percent, text_col, id_col), "sets")
    reach = every.where("id is not null and whole is not null")
    # Copies of one set may be a third of all rows: they point to the least id of one of SALTS classes, and these to each other's least.
    reach = reach.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    lows = materialize(reach.groupBy("whole", "salt").agg(F.min("id").alias("low")), "lows")
    first = lows.groupBy("whole").agg(F.min("low").alias("id"))
    copies = reach.select("id", "whole", "salt").join(lows, ["whole", "salt"]).select(F.col("id").alias("a"), F.col("low").alias("b"))
    members = materialize(copies.unionByName(lows.join(first, "whole").select(F.col("low").alias("a"), F.col("id").alias("b"))), "members")
    sets = materialize(reach.join(first, ["whole", "id"]).dropDuplicates(["whole"]).select("id", "n", "whole", "singles", "shared"), "different")
    joined = links(sets, members, percent)
    named: Column = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return every.join(joined, F.col("id") == F.col("node"), "left").select("id", F.col("n").alias("n_shingles"), named.alias("component_id"))
