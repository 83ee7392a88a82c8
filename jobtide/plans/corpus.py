"""The corpus as it lies between days: a sweep reads and writes only what it touches.

Postings and texts are cut into parts by board. A sweep reads the parts of its
boards, merges them and writes them anew; texts that were read are added as a
delta beside older texts; events are added as one piece a day. One published
version then names the new folders and all the old ones that still hold.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import snapshot
from ..schemas import COMPANIES, EVENTS, POSTINGS_RAW
from ..sources.store import PARTS, Piece, TableStore, part_of

col = F.col
TEXT_ROWS = "id string, company_id string, text string, sweep long"
SCHEMAS = {"postings": POSTINGS_RAW, "posting_text": TEXT_ROWS, "job_events": EVENTS, "companies": COMPANIES}
TOLD = "_events array<string>"  # beside the postings a sweep writes
DELTAS = 8  # more pieces than this beside a part's oldest one are compacted
SHARE = 0.5  # so are pieces that together hold more than this share of its rows


@dataclass
class Swept:
    """What one sweep did."""

    version: int
    parts: list[int]
    rows_read: int
    added: list[Piece]
    joined: DataFrame  # as a plan: nothing stores it
    events: DataFrame


class Corpus:
    """Stored tables of one corpus. ``parts`` stays the same for the life of a corpus."""

    def __init__(self, spark: SparkSession, root: str, parts: int = PARTS):
        self.spark, self.parts = spark, parts
        self.store = TableStore(spark, root, SCHEMAS)

    def load(self, postings: DataFrame, text: DataFrame, companies: DataFrame | None = None) -> int:
        """First version from whole tables; ``text`` has id and text, and company_id where it is known: nothing is joined then."""
        texts = text if "company_id" in text.columns else text.join(postings.select("id", "company_id"), "id")
        texts = texts.withColumn("sweep", F.lit(0).cast("long"))
        added = self._write_postings(postings, 0) + self._write_text(texts, 0)
        if companies is not None:
            added += self.store.write("companies", companies, F.lit(0))
        return self.store.publish([], added)

    def _write_postings(self, rows: DataFrame, sequence: int, beside: str = "") -> list[Piece]:
        return self.store.write("postings", rows, part_of(col("company_id"), self.parts), sequence, ("company_id", "id"), beside)

    def _write_text(self, rows: DataFrame, sequence: int) -> list[Piece]:
        return self.store.write("posting_text", rows, part_of(col("company_id"), self.parts), sequence, ("company_id", "id"))

    def postings(self, version: int | None = None) -> DataFrame:
        return self.store.read("postings", version)

    def events(self, version: int | None = None) -> DataFrame:
        return self.store.read("job_events", version)

    def text(self, version: int | None = None, parts: Iterable[int] | None = None) -> DataFrame:
        """(id, text): of each posting the text read last."""
        return self._newest(self.store.pieces("posting_text", version, parts)).select("id", "text")

    def _newest(self, pieces: list[Piece]) -> DataFrame:
        """Of each part the oldest piece is the base; later ones outrank it, and each other by sweep."""
        oldest: dict[int, Piece] = {}
        for p in pieces:
            oldest.setdefault(p.part, p)
        later = [p for p in pieces if p is not oldest[p.part]]
        base = self.store.read("posting_text", pieces=list(oldest.values()))
        if not later:
            return base
        deltas = self.store.read("posting_text", pieces=later)
        # Dealt by id first, so that no task sorts all the texts its scan reads.
        newest = deltas.repartition("id").groupBy("id").agg(F.max_by(F.struct("company_id", "text", "sweep"), "sweep").alias("n")).select("id", "n.*")
        return base.join(deltas.select("id").distinct(), "id", "left_anti").unionByName(newest)

    def touched(self, boards: DataFrame) -> list[int]:
        """Parts with a board whose rows today's sweep may change."""
        board = F.concat_ws(":", "ats", "slug")
        return sorted(r[0] for r in boards.where(col("outcome").isin("swept", "unchanged", "dead")).select(part_of(board, self.parts)).distinct().collect())

    def sweep(self, snap: DataFrame, boards: DataFrame, now, day) -> Swept:
        """Merge one day. Parts of other boards are neither read nor written; stored texts are not read at all.

        Merged rows are written once, with the events each gives beside them, which are then read from there.
        """
        version = self.store.version()
        parts = self.touched(boards)
        old = self.store.pieces("postings", version, parts)
        merged = snapshot.merge_snapshot(self.store.read("postings", pieces=old), None, snap, boards, now, day)
        added = self._write_postings(merged.rows, version + 1, TOLD)
        today = self.store.read("postings", pieces=added, beside=TOLD).select("id", F.lit(day).cast("date").alias("day"), F.explode("_events").alias("event"))
        texts = snapshot.read_texts(snap, boards).withColumn("sweep", F.lit(version + 1).cast("long"))
        added += self._write_text(texts, version + 1)
        number = self.spark.range(1).select(F.datediff(F.lit(day).cast("date"), F.lit("1970-01-01").cast("date"))).first()[0]
        told = [p for p in self.store.pieces("job_events", version) if p.sequence == number]
        added += self.store.write("job_events", snapshot.append_events(self.store.read("job_events", pieces=told), today), F.lit(0), number, ("id",))
        return Swept(self.store.publish([*old, *told], added), parts, sum(p.rows for p in old), added, merged.joined, today)

    def crowded(self) -> list[int]:
        """Parts whose texts are due for compaction: by the number of later pieces, or by what they hold."""
        pieces: dict[int, list[Piece]] = {}
        for p in self.store.pieces("posting_text"):
            pieces.setdefault(p.part, []).append(p)
        return [part for part, own in pieces.items() if len(own) > 1 + DELTAS or sum(p.rows for p in own[1:]) > SHARE * own[0].rows]

    def compact_text(self, parts: Iterable[int] | None = None) -> int:
        """Write the newest texts of crowded parts (or of ``parts``) as one piece each. Other parts keep their files."""
        parts = self.crowded() if parts is None else list(parts)
        version = self.store.version()
        old = self.store.pieces("posting_text", version, parts)
        if not old:
            return version
        return self.store.publish(old, self._write_text(self._newest(old), version + 1))
