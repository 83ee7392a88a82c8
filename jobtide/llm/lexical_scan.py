"""Ranked lexical search without a document index: one automaton of all items' terms reads the texts.

The terms of a block of items form an Aho-Corasick automaton. Each term is
guarded by a separator on either side, and a text's separators all become that
one, so that an output of the automaton is one whole term of the text. Outputs
map to the items that hold the term. The texts are read twice: for document
counts and lengths, then for term counts, scores and the best of each item.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, strings

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Every byte of UTF-8 text: A-Z as a-z, other ASCII but 0-9 and a-z as the guard, all else as it is.
READ_AS = bytes(ord(chr(b).lower()) if chr(b).isalnum() or b >= 0x80 else 0x20 for b in range(0x80)) + bytes(range(0x80, 0x100))
DOCUMENTS, LENGTHS = -1, -2  # places of N and L beside the document counts of the terms
ROWS, CELLS = 256, 1 << 22  # texts, and (text, item) sums, held at once


def terms_of(text: Column) -> Column:
    """The distinct terms of a text; null for null."""
    return F.array_distinct(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), 0))


class TermReader:
    """Counts the terms of texts that an automaton knows, by their places in ``terms``."""

    def __init__(self, terms: list[str]):
        self.automaton = ahocorasick.Automaton()
        for place, term in enumerate(terms):
            self.automaton.add_word(f" {term} ", place)
        self.automaton.make_automaton()

    def __call__(self, text: str) -> tuple[int, np.ndarray, np.ndarray]:
        """(number of terms, repeats included; places of known terms; how often each occurs)."""
        guarded = b" " + text.encode("utf-8", "surrogatepass").translate(READ_AS) + b" "
        inside = np.frombuffer(guarded, np.uint8) != 0x20
        length = int(np.count_nonzero(inside[1:] & ~inside[:-1]))
        hits = list(map(itemgetter(1), self.automaton.iter(guarded.decode("utf-8", "surrogatepass")))) if length else []
        return length, *np.unique(np.array(hits, np.int64), return_counts=True)


def _counts(terms):
    """Per task: (place, documents) of each term met, and N and L at their own places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, found, documents, lengths = TermReader(terms.value), np.zeros(len(terms.value), np.int64), 0, 0
        for batch in slices(batches, ROWS):
            for text in strings(batch, "text"):
                length, places, _ = read(text)
                found[places] += 1
                documents += length > 0
                lengths += length
        met = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(met, [DOCUMENTS, LENGTHS])), pa.array(np.append(found[met], [documents, lengths]))], names=["place", "n"])

    return run


class Best:
    """The k best (score, id) of each item; equal scores by smaller id, null ids last."""

    def __init__(self, items: int, k: int):
        self.k, self.heaps, self.least = k, [[] for _ in range(items)], np.ones(items, np.int64)

    def add(self, item: int, score: int, own: int | None) -> None:
        heap, entry = self.heaps[item], (score, own is not None, -(own or 0))
        if len(heap) < self.k:
            heapq.heappush(heap, entry)
        elif entry > heap[0]:
            heapq.heapreplace(heap, entry)
        if len(heap) == self.k:
            self.least[item] = heap[0][0]

    def rows(self) -> Iterator[tuple[int, int | None, int]]:
        for item, heap in enumerate(self.heaps):
            for score, known, negative in heap:
                yield item, -negative if known else None, score


def _scores(terms, holders, weights, documents: int, lengths: int, items: int, k: int):
    """Per task: the k best documents of each item, as (item, doc_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, (first, held) = TermReader(terms.value), holders.value
        best = Best(items, k)
        for batch in slices(batches, max(1, min(ROWS, CELLS // max(items, 1)))):
            sums = np.zeros((batch.num_rows, items), np.int64)
            for row, text in enumerate(strings(batch, "text")):
                length, places, tf = read(text)
                m = 10 + 90 * length * documents // lengths if length else 0
                gains = weights[places] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
                # Outputs to items: the gain of a term goes to each item that holds it.
                n = first[places + 1] - first[places]
                at = np.arange(n.sum()) + np.repeat(first[places] - np.cumsum(n) + n, n)
                np.add.at(sums[row], held[at], np.repeat(gains, n))
            ids = batch.column("id").to_pylist()
            for row, item in zip(*np.nonzero(sums >= best.least), strict=True):
                best.add(int(item), int(sums[row, item]), ids[row])
        rows = list(best.rows())
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(3)], names=["item", "doc_id", "score"])

    return run


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, text_col: str = "text", id_col: str = "doc_id",
                   item_text_col: str = "text", item_id_col: str = "item_id", block_terms: int = 100_000) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of the highest score above 0 for every item.

    A term weighs floor(1000 ln((2N+2)/(2df+1))) and gains by its count in a
    document, dampened by the document's length; all sums are 64-bit integers.
    N, lengths and document counts are of all documents.

    Items are dealt to blocks of about ``block_terms`` terms, an item whole: that
    bounds what is broadcast, and each block reads the documents twice. Null and
    empty texts have no terms: they are counted nowhere, ranked for nothing, and
    an item of that kind has no rows, like one with a null id. Items that share
    an id are one item with the terms of all. Rows that share a doc_id are
    documents of their own; a null doc_id comes last among equal scores. No
    documents or no items give an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    wanted = items.select(F.col(item_id_col).cast("long").alias("item_id"), F.explode(terms_of(F.col(item_text_col))).alias("term")).where("item_id is not null").distinct()
    blocks = max(1, math.ceil(wanted.count() / block_terms))
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for block in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        if not rows:
            continue
        holders = defaultdict(list)
        names = sorted({r["item_id"] for r in rows})
        place_of = {name: place for place, name in enumerate(names)}
        for r in rows:
            holders[r["term"]].append(place_of[r["item_id"]])
        terms = sorted(holders)
        known = spark.sparkContext.broadcast(terms)
        met = {r["place"]: r["n"] for r in texts.mapInArrow(_counts(known), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()}
        documents, lengths = met.get(DOCUMENTS, 0), met.get(LENGTHS, 0)
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * met.get(place, 0) + 1))) for place in range(len(terms))], np.int64)
        first = np.cumsum([0] + [len(holders[t]) for t in terms])
        mapped = spark.sparkContext.broadcast((first, np.array([i for t in terms for i in holders[t]], np.int64)))
        scored = texts.mapInArrow(_scores(known, mapped, weights, documents, lengths, len(names), k), "item long, doc_id long, score long")
        named = F.element_at(F.lit(names).cast("array<bigint>"), (F.col("item") + 1).cast("int"))
        found = found.unionByName(scored.select(named.alias("item_id"), "doc_id", "score"))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
