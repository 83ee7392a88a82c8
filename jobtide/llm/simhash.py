"""SimHash near-deduplication with bit-sliced comparison.

Candidates meet in buckets. In a bucket the fingerprints' bits are stored as
planes, 64 fingerprints to a word; a fingerprint is compared with 64 others by
one XOR per plane, the differing bits are summed by carry-save counters, and a
block of 64 is abandoned once all of its sums exceed the radius. A bucket returns
a forest that joins what it found, not all pairs. Where links are to hold a least
similarity, the groups so found are only gathered: inside each, the exact sets of
shingles are compared, every set going to its group once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import slices, strings
from .components import components

SEED = 42
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
GOLDEN = 0x9E3779B97F4A7C15
CHUNK = 1 << 15  # (fingerprint, word) combinations worked on at once
ROWS = 256


# --- fingerprints ----------------------------------------------------------------------------------------------------

def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words, A-Z lower-cased, repeats included; of all words if they are fewer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    runs = zip(*[words[k:] for k in range(size)], strict=False) if len(words) >= size else [words] if words else []
    return np.array([xxhash.xxh64_intdigest(b" ".join(r), SEED) for r in runs], np.uint64)


def remix(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of each hash; the 0th is itself."""
    if k == 0:
        return hashes
    x = hashes + np.uint64(GOLDEN * k % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """``words`` 64-bit words; a bit is 1 if set in over half of the hashes."""
    out = np.zeros(words, np.uint64)
    for k in range(words if len(hashes) else 0):
        counts = np.unpackbits(remix(hashes, k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[k] = np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


def whole_hash(shingles: np.ndarray) -> int:
    """One signed hash of an ascending set of shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)).view(np.int64))


def fingerprints(docs: DataFrame, shingle: int, words: int, minima: int, text_col: str, id_col: str, as_sets: bool = False) -> DataFrame:
    """(id, fp array<long>, keys array<long>); ``keys`` are the least of ``minima`` further hashes of the shingles.

    ``as_sets`` counts a repeated shingle once and ends ``keys`` with a hash of the whole set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            hashes = [shingle_hashes(t, shingle) for t in strings(batch, text_col)]
            if as_sets:
                hashes = [np.unique(h) for h in hashes]
            prints = [fingerprint(h, words).view(np.int64) for h in hashes]
            keys = [np.array([remix(h, words + k).min() if len(h) else 0 for k in range(minima)], np.uint64).view(np.int64) for h in hashes]
            if as_sets:
                keys = [np.append(k, whole_hash(h)) for k, h in zip(keys, hashes, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(id_col).cast(pa.int64()), pa.array(prints, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))], names=["id", "fp", "keys"])

    return docs.select(id_col, text_col).mapInArrow(run, "id long, fp array<long>, keys array<long>")


# --- bit-sliced comparison -------------------------------------------------------------------------------------------

class Counter:
    """Vertical carry-save counters: plane k of all sums is one array; sums of 2^planes and more are only marked as over."""

    def __init__(self, planes: int, size: int):
        self.sums = [np.zeros(size, np.uint64) for _ in range(planes)]
        self.waiting: list[np.ndarray | None] = [None] * planes
        self.over = np.zeros(size, np.uint64)

    def add(self, bits: np.ndarray) -> None:
        """A plane is held until a second one of its weight comes; a full adder then turns sum, first and second into sum and carry."""
        for k in range(len(self.sums)):
            first = self.waiting[k]
            if first is None:
                self.waiting[k] = bits
                return
            half = self.sums[k] ^ first
            carry = (self.sums[k] & first) | (half & bits)
            self.sums[k], self.waiting[k] = half ^ bits, None
            bits = carry
        self.over |= bits

    def settle(self) -> None:
        for k in range(len(self.sums)):
            bits, self.waiting[k] = self.waiting[k], None
            for j in range(k, len(self.sums)):
                if bits is None:
                    break
                self.sums[j], bits = self.sums[j] ^ bits, self.sums[j] & bits
            if bits is not None:
                self.over |= bits

    def keep(self, rows: np.ndarray) -> None:
        self.sums = [s[rows] for s in self.sums]
        self.waiting = [None if w is None else w[rows] for w in self.waiting]
        self.over = self.over[rows]

    def within(self, radius: int) -> np.ndarray:
        self.settle()
        more, same = self.over.copy(), ~self.over
        for k in reversed(range(len(self.sums))):
            if radius >> k & 1:
                same &= self.sums[k]
            else:
                more |= same & self.sums[k]
                same &= ~self.sums[k]
        return ~more


def near(prints: np.ndarray, lane: np.ndarray, low: np.ndarray, high: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows within ``radius``. Row i stands in lane ``lane[i]`` and is compared with the rows in lanes [low[i], high[i])."""
    n, width = prints.shape[0], 64 * prints.shape[1]
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    lanes = 64 * (int(lane.max()) // 64 + 1)
    at = np.zeros((lanes, width), np.uint8)
    at[lane] = bits
    planes = np.packbits(np.ascontiguousarray(at.T), axis=1, bitorder="little").view(np.uint64)
    row_of = np.full(lanes, -1, np.int64)
    row_of[lane] = np.arange(n)
    asks = np.flatnonzero(high > low)
    count = ((high[asks] - 1) >> 6) - (low[asks] >> 6) + 1
    ends = np.cumsum(count)
    begin = 0
    while begin < len(asks):
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + CHUNK, "right")))
        some, many = asks[begin:stop], count[begin:stop]
        row = np.repeat(some, many)
        word = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low[some] >> 6, many)
        first, last = np.maximum(low[row] - 64 * word, 0), np.minimum(high[row] - 64 * word, 64)
        valid = (ONES << first.astype(np.uint64)) & (ONES >> (64 - last).astype(np.uint64))
        counter = Counter(max(1, int(radius).bit_length()), len(row))
        for b in range(width):
            counter.add(planes[b][word] ^ (np.uint64(0) - bits[row, b].astype(np.uint64)))
            if b % 8 == 7:
                alive = np.flatnonzero(valid & ~counter.over)
                if len(alive) < 0.7 * len(row):
                    row, word, valid = row[alive], word[alive], valid[alive]
                    counter.keep(alive)
                if not len(row):
                    break
        hits = counter.within(radius) & valid
        some = np.flatnonzero(hits)
        i, j = np.nonzero(np.unpackbits(hits[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        if len(i):
            yield row[some[i]], row_of[64 * word[some[i]] + j]
        begin = stop


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least row of each row's component."""
    label = np.arange(n)
    for u, v in pairs:
        while True:
            a, b = label[u], label[v]
            apart = a != b
            if not apart.any():
                break
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(label[label], label):
                label = label[label]
    return label


def _compare(radius: int, words: int):
    def joined(ids: np.ndarray, prints: np.ndarray, side: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        """Runs begin at ``starts``; a run of two sides compares one with the other, a run of one side each with the later ones."""
        n = len(ids)
        lane, low, high = (np.zeros(n, np.int64) for _ in range(3))
        free = 0
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), n], strict=True):
            if free % 64 + e - s > 64:
                free = -(-free // 64) * 64
            lane[s:e] = np.arange(free, free + e - s)
            second = s + int(np.searchsorted(side[s:e], 2))
            low[s:e] = lane[s:e] + 1 if second == e or second == s else free + second - s
            high[s:e] = free + e - s
            if s < second < e:
                high[second:e] = 0
            free += e - s
        root = forest(n, near(prints, lane, low, high, radius))
        moved = np.flatnonzero(root != np.arange(n))
        return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root[moved]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        names = ("table", "key", "one", "two")

        def flush(last: bool):
            nonlocal held, rows
            if not rows:
                return None
            whole = pa.Table.from_batches(held).combine_chunks()
            key = np.stack([whole.column(c).to_numpy() for c in names])
            starts = np.concatenate(([0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1))
            end = len(whole) if last else int(starts[-1])
            rest = whole.slice(end)
            held, rows = rest.to_batches(), len(rest)
            if not end:
                return None
            whole = whole.slice(0, end)
            prints = whole.column("fp").combine_chunks()
            prints = (prints.flatten() if isinstance(prints, pa.ListArray) else prints.chunk(0).flatten()).to_numpy().view(np.uint64).reshape(-1, words)
            return joined(whole.column("id").to_numpy(), prints, whole.column("side").to_numpy(), starts[starts < end])

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 1 << 15 and (out := flush(False)) is not None:
                yield out
        if (out := flush(True)) is not None:
            yield out

    return run


# --- exact similarity ------------------------------------------------------------------------------------------------

class Sets:
    """Sets of shingle hashes laid end to end, each shingle as its place among all."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.ends = np.cumsum(self.sizes)
        names, self.flat = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True)
        self.marked = np.zeros(len(names), bool)

    def of(self, i: int) -> np.ndarray:
        return self.flat[self.ends[i] - self.sizes[i]:self.ends[i]]

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, their shingles, running ends) to ask ``alike`` about."""
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.ends[rows] - ends, sizes)
        return rows, self.flat[at], ends

    def alike(self, i: int, taken: tuple[np.ndarray, np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
        """Which of the taken rows have that Jaccard similarity to row i; two empty sets are equal."""
        rows, flat, ends = taken
        own = self.of(i)
        self.marked[own] = True
        sums = np.concatenate(([0], np.cumsum(self.marked[flat])))
        self.marked[own] = False
        both = sums[ends] - sums[ends - self.sizes[rows]]
        union = len(own) + self.sizes[rows] - both
        return (both >= similarity * union - 1e-9) | (union == 0)


def similar_groups(sets: Sets, n: int, similarity: float) -> np.ndarray:
    """The first row of each row's component. Rows that are joined already are not compared again."""
    label, free = np.full(n, -1, np.int64), np.arange(n)
    while len(free):
        label[free[0]] = free[0]
        queue, free = [free[0]], free[1:]
        taken = sets.take(free)
        while queue and len(free):
            i = queue.pop()
            hit = sets.alike(i, taken, similarity)
            new = taken[0][hit]
            new = new[label[new] < 0]
            if len(new):
                label[new] = label[i]
                queue.extend(new.tolist())
                free = free[label[free] < 0]
                if len(free) < 0.7 * len(taken[0]):
                    taken = sets.take(free)
    return label


EDGE = "a long, b long, whole long, rooted long"


def _refine(similarity: float, across: bool):
    """Within a piece: the root of every row. Across two pieces: one edge from each row of side 1 to each root of side 2 that it is like."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        at = None

        def done() -> pa.RecordBatch:
            sets = Sets([np.frombuffer(r["shingles"], np.uint64) for r in held])
            if not across:
                root = similar_groups(sets, len(held), similarity)
                a, b, w, rw = [r["id"] for r in held], [held[k]["id"] for k in root], [r["whole"] for r in held], [held[k]["whole"] for k in root]
            else:
                first = [k for k, r in enumerate(held) if r["side"] == 1]
                second = sets.take(np.array([k for k, r in enumerate(held) if r["side"] == 2], np.int64))
                a, b = [], []
                for k in first:
                    roots = {held[j]["root"] for j in second[0][sets.alike(k, second, similarity)]}
                    a += [held[k]["id"]] * len(roots)
                    b += roots
                w = rw = [None] * len(a)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (a, b, w, rw)], names=["a", "b", "whole", "rooted"])

        for batch in batches:
            for r in batch.to_pylist():
                if (key := (r["component"], r["one"], r["two"])) != at:
                    if held:
                        yield done()
                    at, held = key, []
                held.append(r)
        if held:
            yield done()

    return run


def similar_edges(docs: DataFrame, coarse: DataFrame, similarity: float, shingle: int, tile: int, text_col: str, id_col: str) -> DataFrame:
    """(a, b): edges that join exactly what a Jaccard similarity of ``similarity`` or more of the sets of shingles links, inside each component of ``coarse`` (node, component).

    A component is cut into pieces of about ``tile`` rows, each grouped with the
    component's least row in it. Only rows that did not come to that one's group
    are then compared with the other pieces: all pairs that could join anything.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            sets = [np.unique(shingle_hashes(t, shingle)) for t in strings(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("component"), pa.array([whole_hash(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                                             names=["id", "component", "whole", "shingles"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(coarse, F.col("id") == F.col("node")).select("id", "component", "text")
    # Equal sets of one component are one row; they and the texts of one id are joined without being compared.
    every = materialize(texts.mapInArrow(run, "id long, component long, whole long, shingles binary"), "sets")
    first = every.groupBy("component", "whole").agg(F.min("id").alias("first"))
    known = every.select("id", "component", "whole").join(first, ["component", "whole"])
    sets = every.join(first, ["component", "whole"]).where("id = first").drop("first").dropDuplicates(["component", "whole"])
    sizes = first.groupBy("component").agg(F.ceil(F.count("*") / tile).cast("int").alias("pieces"), F.min(F.struct("first", "whole")).alias("least"))
    cut = materialize(sets.join(sizes, "component").withColumn("is_least", F.col("least.whole") == F.col("whole")).withColumn("one", F.pmod(F.xxhash64("whole"), F.col("pieces")).cast("int")).drop("least"), "pieces")
    order = ["component", "one", "two"]
    dealt = cut.where("not is_least").unionByName(cut.where("is_least").withColumn("one", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))).withColumn("two", F.lit(0))
    columns = ["id", "whole", *order, "shingles"]
    inside = materialize(dealt.repartition(*order).sortWithinPartitions(*order, F.col("is_least").desc()).select(*columns).mapInArrow(_refine(similarity, False), EDGE), "inside")
    roots = inside.select(F.col("a").alias("id"), "whole", F.col("b").alias("root"), "rooted").distinct()
    least = cut.where("is_least").select("component", F.col("whole").alias("least"))
    many = materialize(cut.where("pieces > 1").join(roots, ["id", "whole"]).join(least, "component").withColumn("loose", F.col("rooted") != F.col("least")), "loose")
    asking = many.where("loose").withColumn("two", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).where("two <> one")
    wanted = many.where("loose").select("component", F.col("one").alias("asker")).distinct()
    # Two loose rows meet once, in the lower piece of the two as the one that asks.
    answering = many.join(wanted, "component").where("asker <> one and (not loose or asker < one)").withColumn("two", F.col("one")).withColumn("one", F.col("asker"))
    both = asking.withColumn("side", F.lit(1)).select(*columns, "side", "root").unionByName(answering.withColumn("side", F.lit(2)).select(*columns, "side", "root"))
    across = both.repartition(*order).sortWithinPartitions(*order).mapInArrow(_refine(similarity, True), EDGE)
    return known.select(F.col("id").alias("a"), F.col("first").alias("b")).unionByName(inside.select("a", "b")).unionByName(across.select("a", "b"))


# --- Spark -----------------------------------------------------------------------------------------------------------

def pigeonhole(word: Column, radius: int, blocks: int) -> Column:
    """(table, key) of every choice of ``blocks - radius`` out of ``blocks`` stretches of the 64 bits.

    Fingerprints within ``radius`` agree in at least that many stretches, so no pair is missed.
    """
    edge = [64 * k // blocks for k in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << edge[k + 1]) - (1 << edge[k])) for k in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return F.array(*[F.struct(F.lit(t).alias("table"), word.bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)])


def simhash_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 3, words: int = 1, radius: int = 3,
                   blocks: int = 5, minima: int = 0, tile: int = 4096, similarity: float | None = None) -> DataFrame:
    """(id, fp, component_id) per row: the fingerprint and the smallest id reachable over links of at most ``radius`` bits.

    With ``minima`` = 0 candidates meet by the pigeonhole rule, which misses no
    pair of 64-bit fingerprints. With ``minima`` > 0 they meet by that many
    min-hashes of their shingles, for wide fingerprints and large radii. A
    bucket of more than ``tile`` rows is cut into pieces, and each pair of
    pieces is compared by a task of its own.

    With ``similarity`` a link within the radius counts only if the exact Jaccard
    similarity of the two sets of shingles reaches it; fingerprints are then of
    sets, so a repeated shingle counts once, and links inside a group hold
    whatever their distance.

    A text without words (null, empty, blank) has fingerprint zero and links
    like any other. Rows that share an id are one document. A row with a null id
    gets its fingerprint but joins no group: its ``component_id`` is null. An
    empty table gives an empty result.
    """
    if not minima and words > 1:
        raise ValueError("the pigeonhole rule is for 64-bit fingerprints")
    prints = materialize(fingerprints(docs, shingle, words, minima, text_col, id_col, similarity is not None), "prints")
    classes = materialize(prints.where("id is not null").groupBy("fp", "keys").agg(F.min("id").alias("id")), "classes")
    keys = pigeonhole(F.col("fp")[0], radius, blocks) if not minima else F.transform(F.slice("keys", 1, minima), lambda k, t: F.struct(t.alias("table"), k.alias("key")))
    met = classes.select("id", "fp", F.explode(keys).alias("_k")).select("id", "fp", "_k.table", "_k.key")
    sizes = met.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1")
    cut = met.join(sizes, ["table", "key"]).withColumn("pieces", F.ceil(F.col("n") / tile).cast("int")).withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select(
        "table", "key", F.least("piece", "other").alias("one"), F.greatest("piece", "other").alias("two"),
        F.when(F.col("piece") <= F.col("other"), 1).otherwise(2).alias("side"), "id", "fp")
    order = ["table", "key", "one", "two"]
    edges = dealt.repartition(*order).sortWithinPartitions(*order, "side").mapInArrow(_compare(radius, words), "a long, b long")
    # Classes that share an id (rows of one id with several texts) meet in that id.
    joined = components(edges)
    if similarity is not None:
        joined = components(similar_edges(docs, joined, similarity, shingle, tile, text_col, id_col))
    named = classes.join(joined, classes["id"] == joined["node"], "left").select("fp", "keys", F.coalesce("component", "id").alias("component_id"))
    return prints.join(named, ["fp", "keys"], "left").select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that are the smallest id of their group; same columns. Rows with a null id stay."""
    found = simhash_groups(docs, text_col, id_col, **options)
    dropped = found.where(F.col("id") != F.col("component_id")).select(F.col("id").alias("_dropped")).distinct()
    return docs.join(dropped, docs[id_col] == F.col("_dropped"), "left_anti")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp[0]), 16, "0"))


#: Options for links of a similarity of 0.8 or more over five words. Two sets of that similarity differ in about 155
#: of 1024 bits (standard deviation 11), at most in 192 (12.5) where four shingles meet five; the radius lies five
#: deviations above, and the exact similarity decides. All eight min-hashes differ for 3 in a million such pairs.
NEAR_COPIES = {"shingle": 5, "words": 16, "radius": 256, "minima": 8, "similarity": 0.8}
