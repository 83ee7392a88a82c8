"""The daily run over landed snapshots: merge, derive, report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import changes, snapshot
from ..session import materialize
from . import many
from .search import search

col = F.col


def sweep(current: DataFrame, text: DataFrame, events: DataFrame, companies: DataFrame, snap: DataFrame, boards: DataFrame, now, day) -> dict[str, DataFrame]:
    """One day's snapshot into all tables. The joined rows are written once and read back by every output."""
    merged = snapshot.merge_snapshot(current, text, snap, boards, now, day, store=True)
    moves = materialize(merged.events, "events")
    counts = snap.groupBy(F.concat_ws(":", "ats", "company_slug").alias("company_id")).agg(F.count(F.lit(1)).alias("jobs"))
    return {
        "postings": materialize(merged.postings, "postings"), "posting_text": merged.text,
        "job_events": snapshot.append_events(events, moves),
        "companies": snapshot.merge_companies(companies, boards, counts, now),
        "sweeps": snapshot.sweep_totals(merged.joined, moves, boards),
    }


def daily_report(view: DataFrame, postings: DataFrame, events: DataFrame, profiles: dict[str, dict], since=None,
                 texts: DataFrame | None = None, index: DataFrame | None = None, limit: int = 100) -> dict:
    """Per profile: matches among what is new, and standing totals; plus the latest moves.

    Totals of all profiles come from one scan of the view. Pages of what is new
    are searches over the new rows, which are stored once; a profile with a free
    text searches the view, as the rarity of its words is that of the corpus.
    """
    start, latest = changes.resolve_since(events, since)
    fresh = materialize(changes.new_since(events, start), "fresh")
    recent = materialize(view.join(fresh.select("id"), "id", "left_semi"), "recent")
    reports = {}
    for name, raw in profiles.items():
        options = {"texts": texts, "index": index, "limit": limit}
        reports[name] = search(view, raw, restrict_to=fresh, **options) if raw.get("text") else search(recent, raw, **options)
    totals = many.totals(view, profiles, texts, index, fresh)
    gone = changes.gone_since(events, postings, start)
    moves = events.where(col("day") >= F.lit(start).cast("date")).groupBy("event").agg(F.countDistinct("id").alias("postings"))
    return {"from": start, "latest": latest, "profiles": reports, "totals": totals, "gone": gone, "moves": moves,
            "changed": changes.changed_since(events, start), "new": fresh}
