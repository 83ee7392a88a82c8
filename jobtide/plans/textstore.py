"""A token index that follows its postings: segments, delete marks, merges by size.

Texts that were read become a segment of postings beside older ones. A mark says
from which segment on a posting counts, so that its older entries are void
without being rewritten. Segments of about one size are merged, and void entries
go then; other segments keep their files. A term table beside the postings names
every token with its number of postings, sorted, and is read first.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rank, textindex
from ..sources.store import Piece, TableStore, part_of

col = F.col
SCHEMAS = {
    "tokens": f"{textindex.ENTRY}, segment long", "marks": "id string, since long",
    "terms": "token string, postings long",
}
PARTS = 16
FAN = 4  # so many segments of one size are merged; sizes differ by this factor


class TokenStore:
    """The index under ``root``. ``parts`` stays the same for its life; a token lies in one part."""

    def __init__(self, spark: SparkSession, root: str, parts: int = PARTS):
        self.spark, self.parts = spark, parts
        self.store = TableStore(spark, root, SCHEMAS)

    # -- writing

    def add(self, texts: DataFrame, void: DataFrame | None = None) -> int:
        """A segment of ``texts`` (id and fields). Entries of ``void`` (id) in older segments no longer count.

        ``void`` has the postings that were read before or are gone; by default
        it is the ids of ``texts``. A posting that is gone is in ``void`` alone.
        """
        segment = self.store.version() + 1
        marks = (texts if void is None else void).select("id").distinct().withColumn("since", F.lit(segment).cast("long"))
        tokens = textindex.build_entries(texts, parts=self.parts).withColumn("segment", F.lit(segment).cast("long"))
        added = self._write(tokens, segment, textindex.ids_once(texts))
        if segment > 1:
            added += self.store.write("marks", marks, F.lit(0), segment, ("id",))
        version = self.store.publish([], added)
        due = self.due()
        return self.merge(due) if due else version

    def _write(self, tokens: DataFrame, segment: int, once: bool = False) -> list[Piece]:
        """``once``: no id is repeated, so that a word's first rows are its postings, counted in the map tasks."""
        part = col("part") if "part" in tokens.columns else part_of(col("token"), self.parts)
        added = self.store.write("tokens", tokens, part, segment, ("token",))
        first = self.store.read("tokens", pieces=added).where("first").select("token", "id")
        terms = (first if once else first.distinct()).groupBy("token").agg(F.count(F.lit(1)).alias("postings"))
        return added + self.store.write("terms", terms, F.lit(0), segment, ("token",))

    def segments(self) -> dict[int, int]:
        """Entries held by each segment."""
        sizes: dict[int, int] = defaultdict(int)
        for p in self.store.pieces("tokens"):
            sizes[p.sequence] += p.rows
        return dict(sizes)

    def due(self) -> list[int]:
        """Segments of one size class that are to be merged."""
        classes = defaultdict(list)
        for segment, rows in self.segments().items():
            size = 0
            while rows >= FAN ** (size + 1):
                size += 1
            classes[size].append(segment)
        return next((sorted(c) for _, c in sorted(classes.items()) if len(c) >= FAN), [])

    def merge(self, segments: Iterable[int]) -> int:
        """These segments as one, without void entries. Marks that no segment needs any more go."""
        while segments := list(segments):
            every, sequence = self.store.pieces(), self.store.version() + 1
            old = [p for p in every if p.sequence in segments and p.name in ("tokens", "terms")]
            added = self._write(self._live([p for p in old if p.name == "tokens"]), sequence)
            rest = [p.sequence for p in every if p.name == "tokens" and p.sequence not in segments]
            settled = [p for p in every if p.name == "marks" and p.sequence <= min([*rest, sequence])]
            self.store.publish([*old, *settled], added)
            segments = self.due()
        return self.store.version()

    # -- reading

    def _live(self, pieces: list[Piece]) -> DataFrame:
        """Entries of these pieces that no later mark makes void. Filters on them reach the scan."""
        tokens, marks = self.store.read("tokens", pieces=pieces), self.store.pieces("marks")
        if not marks:
            return tokens
        newest = self.store.read("marks", pieces=marks).groupBy(col("id").alias("_id")).agg(F.max("since").alias("since"))
        return tokens.join(newest, (col("id") == col("_id")) & (col("segment") < col("since")), "left_anti")

    def index(self, words: Iterable[str] | None = None) -> DataFrame:
        """(token, field, id, pos) of live postings; of the parts of some ``words``, where they are given."""
        parts = None if words is None else {int(hashlib.md5(w.encode()).hexdigest()[:7], 16) % self.parts for w in words}
        return self._live(self.store.pieces("tokens", parts=parts)).select("token", "field", "id", F.explode("places").alias("pos"))

    def terms(self, words: Iterable[str], min_prefix: int = textindex.PREFIX_MIN) -> DataFrame:
        """(word, token, postings): tokens that a word starts, or, if it is short, equals. Only the term table is read.

        ``postings`` may count void entries until the segments that hold them are merged.
        """
        table, found = self.store.read("terms"), None
        for w in dict.fromkeys(words):
            hit = table.where(col("token").startswith(w) if len(w) >= min_prefix else col("token") == w)
            hit = hit.groupBy("token").agg(F.sum("postings").alias("postings")).select(F.lit(w).alias("word"), "token", "postings")
            found = hit if found is None else found.unionByName(hit)
        return found if found is not None else self.spark.createDataFrame([], "word string, token string, postings long")

    def match(self, terms: list[str], mode: str = "any", field: str | None = "body") -> DataFrame:
        """Ids whose field holds any (or all) of the phrases; reads the parts of their words."""
        return textindex.match_terms(self.index({w for t in terms for w in textindex.words_of(t)}), terms, mode, field)

    def query(self, text: str) -> DataFrame:
        """(id, text_field) of a free text. The term table says which parts hold tokens of its words."""
        words = textindex.words_of(text)
        parts = [r[0] for r in self.terms(words).select(part_of(col("token"), self.parts)).distinct().collect()]
        return textindex.text_query(self._live(self.store.pieces("tokens", parts=parts)).select("token", "field", "id"), text)

    def rarity(self, words: list[str], corpus: int) -> DataFrame:
        """(word, postings, spec) of single words. Counts come from the term table where it is exact.

        That is where one token answers a word and nothing is void; postings are
        read for the other words alone.
        """
        found = {r["word"]: r for r in self.terms(words).groupBy("word").agg(F.count(F.lit(1)).alias("tokens"), F.sum("postings").alias("n")).collect()}
        void = bool(self.store.pieces("marks"))
        counts = []
        for word in words:
            row = found.get(word)
            exact = row is None or (row["tokens"] == 1 and not void)
            counts.append((word, (row["n"] if row else 0) if exact else self.query(word).count()))
        table = self.spark.createDataFrame(counts, "word string, postings long")
        return table.withColumn("spec", rank.text_specificity(col("postings"), F.lit(corpus)))
