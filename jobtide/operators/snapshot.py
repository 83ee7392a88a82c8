"""Daily full-board snapshots merged into the postings table, with an event log.

One full outer join on the posting id carries every rule: insert, overwrite,
coalesce, reopen, close, and which events to write. Ids are unique on both
sides, so the join has no hot key; the lookup of a posting's board is a left
join whose big side AQE splits when one board holds much of the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import SECTORS
from ..functions.scalar import external_job_url
from ..functions.text import title_case
from ..schemas import COMPANIES, POSTINGS_RAW, columns
from ..session import materialize

col = F.col
# Kept from the stored row when the new one does not say.
COALESCED = ["company_name", "location_raw", "locations_all", "country", "posted_at"]
HASHED = ["title", "location_raw", "employment_type", "comp_min", "comp_max", "department"]


def content_hash(length: Column, prefix: str = "") -> Column:
    """First 16 hex digits of the sha1 over seven fields; the text counts by its length only."""
    def text(name: str) -> Column:
        c = col(f"{prefix}{name}")
        if name.startswith("comp_"):  # whole figures are written without a decimal point
            c = F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))
        return F.coalesce(c, F.lit(""))

    parts = [text(name) for name in HASHED] + [length.cast("string")]
    joined = parts[0]
    for part in parts[1:]:
        joined = F.concat(joined, F.lit("\0"), part)
    return F.substring(F.sha1(joined), 1, 16)


@dataclass
class Merged:
    """Outcome of one merge; all frames hang off ``joined``."""

    joined: DataFrame
    postings: DataFrame
    text: DataFrame | None
    events: DataFrame
    rows: DataFrame  # postings with ``_events``, so that one pass can write both


def swept_listings(snapshot: DataFrame, boards: DataFrame) -> DataFrame:
    """Delivered rows of the boards swept today, with ``company_id``, ``board_name`` and ``_order``.

    Of a posting listed twice the last listing counts: the largest ``_order``,
    which is the ``position`` column where there is one, then the row's hash, so
    that its row and its text are taken from the same listing.
    """
    swept = boards.where(col("outcome") == "swept").select(F.concat_ws(":", "ats", "slug").alias("company_id"), col("name").alias("board_name"))
    place = col("position").cast("long") if "position" in snapshot.columns else F.lit(0).cast("long")
    keyed = snapshot.withColumn("company_id", F.concat_ws(":", "ats", "company_slug")).withColumn("_order", F.struct(place.alias("place"), F.xxhash64(*snapshot.columns).alias("hash")))
    return keyed.join(swept, "company_id")


def last_listing(listings: DataFrame) -> DataFrame:
    """(id, n): of each posting the ``n`` with the largest ``_order``.

    Wide values are reduced by sorting, so rows are dealt by id first: each task
    then sorts one share of a shuffle and not all that its scan reads.
    """
    return listings.repartition("id").groupBy("id").agg(F.max_by("n", "_order").alias("n"))


def join_snapshot(current: DataFrame, snapshot: DataFrame, boards: DataFrame) -> DataFrame:
    """Stored and new row side by side (structs ``o`` and ``n``) with the board's outcome today.

    Only rows of boards swept today can meet a new row, so only they are shuffled
    for the outer join; all other rows pass beside it.
    """
    outcomes = boards.select(F.concat_ws(":", "ats", "slug").alias("company_id"), "outcome")
    every = current.select("id", "company_id", F.struct(*[col(c) for c in columns(POSTINGS_RAW)]).alias("o")).join(outcomes, "company_id", "left").drop("company_id")
    swept = F.coalesce(col("outcome") == "swept", F.lit(False))
    stored = every.where(swept)
    fresh = swept_listings(snapshot, boards)
    # The text itself stays out of this shuffle: the row needs its length only.
    carried = [c for c in snapshot.columns if c != "description_text"]
    length = F.length("description_text").alias("text_length")
    fresh = last_listing(fresh.select("id", "_order", F.struct("company_id", "board_name", length, *carried).alias("n")))
    met = stored.join(fresh, "id", "full_outer")
    beside = every.where(~swept).withColumn("n", F.lit(None).cast(fresh.schema["n"].dataType))
    return met.unionByName(beside).withColumn("swept", swept)


def merged_columns(now) -> dict[str, Column]:
    """Every column of the merged row as an expression over ``o``, ``n`` and ``outcome``."""
    now = F.lit(now).cast("timestamp")
    old, new = col("o"), col("n")
    arrived, known = new["id"].isNotNull(), old["id"].isNotNull()
    length = F.when(new["has_text"], F.coalesce(new["text_length"], F.lit(0))).otherwise(
        F.coalesce(old["text_length"], F.lit(0)))
    place = {"location_raw", "locations_all", "country"}

    def fresh(name: str) -> Column:
        value = new[name]
        if name == "company_name":
            value = F.coalesce(value, new["board_name"])
        if name == "locations_all":
            value = F.coalesce(value, F.array().cast("array<string>"))
        if name in place:
            value = F.when(new["has_place"], value)
        return F.coalesce(value, old[name]) if name in COALESCED else value

    out: dict[str, Column] = {}
    kept_as_is = {"first_seen", "last_seen", "is_open", "content_hash", "text_length", "d_derived_at"}
    for name in columns(POSTINGS_RAW):
        if name not in kept_as_is:
            out[name] = F.when(arrived, fresh(name)).otherwise(old[name])
    # The hash sees the values as delivered, before older ones fill the gaps.
    delivered = {c: F.when(new["has_place"], new[c]) if c in place else new[c] for c in HASHED}
    hashed = F.struct(*[v.alias(k) for k, v in delivered.items()])
    closes = ~arrived & col("swept") & old["is_open"]
    dead = ~arrived & (col("outcome") == "dead")
    out["_hashed"], out["_length"] = hashed, length
    out["first_seen"] = F.coalesce(old["first_seen"], now)
    touched = ~arrived & (col("outcome") == "unchanged") & old["is_open"]
    out["last_seen"] = F.when(arrived | closes | F.coalesce(touched, F.lit(False)), now).otherwise(old["last_seen"])
    out["is_open"] = F.when(arrived, True).when(closes | F.coalesce(dead, F.lit(False)), False).otherwise(old["is_open"])
    out["_arrived"], out["_known"], out["_closes"] = arrived, known, known & closes
    return out


def merge_snapshot(current: DataFrame, text: DataFrame | None, snapshot: DataFrame, boards: DataFrame, now, day, store: bool = False) -> Merged:
    """Merge today's boards. Boards not read today, or read as an error, keep their rows untouched.

    A dead board closes its postings without an event; an unchanged one only
    renews ``last_seen``. Unread text keeps the stored text and its length.
    ``store`` writes the joined rows once for all outputs that hang off them.
    Without ``text`` no text is merged.
    """
    joined = join_snapshot(current, snapshot, boards)
    joined = materialize(joined, "joined") if store else joined
    rows = joined.select("o", "n", "outcome", *[c.alias(k) for k, c in merged_columns(now).items()])
    new_hash = content_hash(col("_length"), "_hashed.")
    rows = rows.withColumn("_new_hash", F.when(col("_arrived"), new_hash))
    moved = col("_arrived") & ~col("_new_hash").eqNullSafe(col("o.content_hash"))
    rows = rows.withColumns({
        "content_hash": F.coalesce("_new_hash", "o.content_hash"),
        "text_length": F.when(col("_arrived"), col("_length")).otherwise(col("o.text_length")),
        "d_derived_at": F.when(~moved, col("o.d_derived_at")),
        "_events": F.filter(F.array(
            F.when(col("_arrived") & ~col("_known"), "appeared"),
            F.when(col("_arrived") & col("_known") & ~col("o.is_open"), "reappeared"),
            F.when(moved & col("_known"), "changed"),
            F.when(col("_closes"), "disappeared"),
        ), lambda e: e.isNotNull()),
    })
    events = rows.select("id", F.lit(day).cast("date").alias("day"), F.explode("_events").alias("event"))
    texts = None if text is None else merge_text(text, snapshot, boards)
    return Merged(joined, rows.select(*columns(POSTINGS_RAW)), texts, events, rows.select(*columns(POSTINGS_RAW), "_events"))


def read_texts(snapshot: DataFrame, boards: DataFrame) -> DataFrame:
    """(id, company_id, text) of postings whose text was read on a board swept today; the text may be null."""
    listings = swept_listings(snapshot, boards)
    last = last_listing(listings.select("id", "_order", F.struct("has_text", "company_id", col("description_text").alias("text")).alias("n")))
    return last.where("n.has_text").select("id", "n.company_id", "n.text")


def merge_text(text: DataFrame, snapshot: DataFrame, boards: DataFrame) -> DataFrame:
    """Text that was read on a board swept today replaces the stored one, even by nothing; other text stays."""
    return latest_text(text.select("id", "text"), read_texts(snapshot, boards).select("id", "text", F.lit(0).alias("sweep")))


def latest_text(base: DataFrame, deltas: DataFrame) -> DataFrame:
    """(id, text): the newest text of every posting. ``deltas`` has a ``sweep`` and outranks ``base``, which has one row an id.

    Base rows stay where they are when the ids of the deltas are few enough to be broadcast.
    """
    newest = deltas.repartition("id").groupBy("id").agg(F.max_by("text", "sweep").alias("text"))
    return base.join(deltas.select("id").distinct(), "id", "left_anti").select("id", "text").unionByName(newest.select("id", "text"))


def append_events(log: DataFrame, events: DataFrame) -> DataFrame:
    """The log with today's events; one row per posting, day and event."""
    today = events.dropDuplicates(["id", "day", "event"]).join(log, ["id", "day", "event"], "left_anti")
    return log.unionByName(today)


def merge_companies(companies: DataFrame, boards: DataFrame, job_counts: DataFrame, now) -> DataFrame:
    """Boards read today into the company table: names fill gaps, counts and status follow, discovery keeps the first.

    ``job_counts`` has company_id and jobs (postings delivered today).
    """
    now = F.lit(now).cast("timestamp")
    today = boards.withColumn("company_id", F.concat_ws(":", "ats", "slug")).join(job_counts, "company_id", "left").select(
        col("company_id").alias("id"), F.struct(col("ats"), col("slug"), col("outcome"), col("name"), col("name_source"), col("url"),
                                               col("etag"), col("discovery"), F.coalesce("jobs", F.lit(0)).cast("long").alias("jobs")).alias("b"))
    old = companies.select("id", F.struct(*companies.columns).alias("c"))
    j = old.join(today, "id", "full_outer")
    swept = F.coalesce(col("b.outcome") == "swept", F.lit(False))
    seen = F.coalesce(col("b.outcome").isin("swept", "unchanged"), F.lit(False))
    here = col("b").isNotNull()
    status = F.when(col("b.outcome") == "swept", F.when(col("b.jobs") > 0, "live").otherwise("empty")).when(
        col("b.outcome").isin("dead", "error"), col("b.outcome")).otherwise(col("c.status"))
    named = col("b.name").isNotNull()
    new = {
        "ats": F.coalesce("c.ats", "b.ats"), "slug": F.coalesce("c.slug", "b.slug"),
        "name": F.when(swept, F.coalesce("b.name", "c.name")).otherwise(col("c.name")),
        "name_source": F.when(swept & named, F.coalesce("b.name_source", F.lit("api"))).otherwise(col("c.name_source")),
        "board_url": F.when(swept, F.coalesce("b.url", "c.board_url")).otherwise(col("c.board_url")),
        "job_count": F.when(swept, col("b.jobs")).otherwise(F.coalesce("c.job_count", F.lit(0))),
        "first_seen": F.coalesce("c.first_seen", now),
        "last_seen": F.when(seen | col("c").isNull(), now).otherwise(col("c.last_seen")),
        "last_swept": F.when(here, now).otherwise(col("c.last_swept")),
        "last_etag": F.when(swept, col("b.etag")).otherwise(col("c.last_etag")),
        "status": status, "discovery": F.coalesce("c.discovery", F.when(swept, col("b.discovery"))),
    }
    return j.select(*["id" if c == "id" else new.get(c, col(f"c.{c}")).alias(c) for c in columns(COMPANIES)])


def apply_resolved_boards(snapshot: DataFrame, resolved: DataFrame) -> DataFrame:
    """Verified names fill blank company names; boards whose hosted pages are off get working job links.

    ``resolved`` has ats, slug, name, careers_url, hosted_disabled.
    """
    r = resolved.select(col("ats"), col("slug").alias("company_slug"), F.trim("name").alias("_name"), F.trim("careers_url").alias("_careers"),
                        F.coalesce("hosted_disabled", F.lit(False)).alias("_off"))
    relink = F.coalesce(col("_off"), F.lit(False)) & (F.coalesce(col("_careers"), F.lit("")) != "")
    return snapshot.join(r, ["ats", "company_slug"], "left").select(*[
        {
            "company_name": F.coalesce("company_name", F.nullif(col("_name"), F.lit(""))),
            "url": F.when(relink, external_job_url(col("_careers"), col("native_id"))).otherwise(col("url")),
            "apply_url": F.when(~relink, col("apply_url")),
        }.get(c, col(c)).alias(c) for c in snapshot.columns])


def repair_links(postings: DataFrame, orgs: DataFrame) -> DataFrame:
    """Resolved organisation records overwrite names and the links of disabled boards in stored postings."""
    o = orgs.select("ats", col("slug").alias("company_slug"), col("name").alias("_name"), col("careers_url").alias("_careers"),
                    F.coalesce("hosted_disabled", F.lit(False)).alias("_off"))
    relink = F.coalesce(col("_off"), F.lit(False)) & col("_careers").isNotNull()
    return postings.join(o, ["ats", "company_slug"], "left").select(*[
        {
            "company_name": F.coalesce("_name", "company_name"),
            "url": F.when(relink, external_job_url(col("_careers"), col("native_id"))).otherwise(col("url")),
            "apply_url": F.when(~relink, col("apply_url")),
        }.get(c, col(c)).alias(c) for c in postings.columns])


def repair_companies(companies: DataFrame, orgs: DataFrame) -> DataFrame:
    o = orgs.select("ats", "slug", col("name").alias("_name"), col("website").alias("_site"))
    return companies.join(o, ["ats", "slug"], "left").select(*[
        {
            "name": F.coalesce("_name", "name"), "name_source": F.when(col("_name").isNotNull(), "api").otherwise(col("name_source")),
            "website": F.when(col("_name").isNotNull(), F.coalesce("_site", "website")).otherwise(col("website")),
        }.get(c, col(c)).alias(c) for c in companies.columns])


def needs_detail(listing: DataFrame, postings: DataFrame) -> DataFrame:
    """Listing rows whose posting has no stored text, or a stored place that is only a count of places."""
    described = postings.where(
        (col("text_length") > 0) & ~F.coalesce(col("location_raw").rlike("^[0-9].* Location"), F.lit(False))).select("id")
    return listing.join(described, "id", "left_anti")


def sweep_totals(joined: DataFrame, events: DataFrame, boards: DataFrame) -> DataFrame:
    """Per source: boards by outcome, postings delivered, added, changed and closed."""
    jobs = joined.where(col("n").isNotNull()).groupBy(F.concat_ws(":", "n.ats", "n.company_slug").alias("company_id"), col("n.ats").alias("ats")).agg(
        F.count(F.lit(1)).alias("jobs"))
    b = boards.withColumn("company_id", F.concat_ws(":", "ats", "slug")).join(jobs.drop("ats"), "company_id", "left")
    swept = col("outcome") == "swept"
    per_board = b.groupBy("ats").agg(
        F.count(F.lit(1)).alias("boards"), F.count_if(swept & (F.coalesce("jobs", F.lit(0)) > 0)).alias("live"),
        F.count_if(swept & (F.coalesce("jobs", F.lit(0)) == 0)).alias("empty"), F.count_if(col("outcome") == "dead").alias("dead"),
        F.count_if(col("outcome") == "error").alias("errors"), F.count_if(col("outcome") == "unchanged").alias("unchanged"),
        F.coalesce(F.sum("jobs"), F.lit(0)).alias("jobs"))
    moves = events.groupBy(F.substring_index("id", ":", 1).alias("ats")).agg(
        F.count_if(col("event") == "appeared").alias("added"), F.count_if(col("event") == "changed").alias("changed"),
        F.count_if(col("event") == "disappeared").alias("closed"))
    zero = {c: 0 for c in ("added", "changed", "closed")}
    return per_board.join(moves, "ats", "left").na.fill(zero)


def record_attempts(attempts: DataFrame, tried: DataFrame) -> DataFrame:
    """Probe verdicts into the attempt table; how a slug was first found stays."""
    first = ("strategy", "seed", "rank")
    t = tried.select("ats", "slug", F.struct(*[c for c in tried.columns if c not in ("ats", "slug")]).alias("t"))
    o = attempts.select("ats", "slug", F.struct(*[c for c in attempts.columns if c not in ("ats", "slug")]).alias("o"))
    return o.join(t, ["ats", "slug"], "full_outer").select("ats", "slug", *[
        (F.when(col("o").isNotNull(), col(f"o.{c}")).otherwise(col(f"t.{c}")) if c in first
         else F.when(col("t").isNotNull(), col(f"t.{c}")).otherwise(col(f"o.{c}"))).alias(c)
        for c in attempts.columns if c not in ("ats", "slug")])


def known_slugs(attempts: DataFrame, ats: str) -> DataFrame:
    return attempts.where(col("ats") == ats).select("slug").distinct()


def record_sectors(companies: DataFrame, read: DataFrame) -> DataFrame:
    """Sector readings (id, sector, blurb, src, at) into the company table; a value outside the list is NULL but stamped."""
    r = read.select("id", F.struct(
        F.when(col("sector").isin(list(SECTORS)), col("sector")).alias("sector"), F.nullif(F.trim("blurb"), F.lit("")).alias("blurb"),
        col("src").alias("sector_src"), col("at").alias("sector_at")).alias("r"))
    new = ("sector", "blurb", "sector_src", "sector_at")
    return companies.join(r, "id", "left").select(*[
        F.when(col("r").isNotNull(), col(f"r.{c}")).otherwise(col(c)).alias(c) if c in new else col(c) for c in companies.columns])


def fill_company_names(companies: DataFrame, postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nameless companies take their slug in title case; postings without a name take their company's."""
    blank = F.coalesce(col("name"), F.lit("")) == ""
    named = companies.withColumn("name_source", F.when(blank, "slug").otherwise(col("name_source"))).withColumn(
        "name", F.when(blank, title_case(col("slug"))).otherwise(col("name")))
    names = named.select(col("id").alias("company_id"), col("name").alias("_name"))
    filled = postings.join(names, "company_id", "left").select(*[
        F.coalesce(F.nullif(col("company_name"), F.lit("")), col("_name")).alias(c) if c == "company_name" else col(c) for c in postings.columns])
    return named, filled


def replay_events(observed: DataFrame, days: DataFrame) -> DataFrame:
    """Events of many daily snapshots of one board in a single pass: (id, day, event).

    ``observed`` has id, day and hash, one row per posting seen that day;
    ``days`` lists the swept days with their running number ``n``. A posting
    missing on the next swept day has disappeared; one back after a gap has
    reappeared.
    """
    from pyspark.sql import Window

    seen = observed.join(days, "day")
    last_day = days.agg(F.max("n").alias("last"))
    w = Window.partitionBy("id").orderBy("n")
    seen = seen.withColumns({
        "_pn": F.lag("n").over(w), "_ph": F.lag("hash").over(w), "_nn": F.lead("n").over(w)})
    seen = seen.withColumn("_one", F.lit(1)).join(F.broadcast(last_day.withColumn("_one", F.lit(1))), "_one")
    here = F.filter(F.array(
        F.when(col("_pn").isNull(), "appeared"), F.when(col("_pn") < col("n") - 1, "reappeared"),
        F.when(col("_pn").isNotNull() & ~col("hash").eqNullSafe(col("_ph")), "changed")), lambda e: e.isNotNull())
    gone = F.coalesce(col("_nn") > col("n") + 1, col("n") < col("last"))
    moves = F.concat(
        F.transform(here, lambda e: F.struct(col("n").alias("n"), e.alias("event"))),
        F.when(gone, F.array(F.struct((col("n") + 1).alias("n"), F.lit("disappeared").alias("event")))).otherwise(
            F.array().cast("array<struct<n:int,event:string>>")))
    out = seen.select("id", F.explode(moves).alias("m")).select("id", "m.n", "m.event")
    return out.join(F.broadcast(days), "n").select("id", "day", "event")


def replay_state(observed: DataFrame, days: DataFrame) -> DataFrame:
    """(id, first_seen, last_seen, is_open) after all days: what day-by-day merging leaves behind."""
    last = days.agg(F.max("n").alias("last")).withColumn("_one", F.lit(1))
    span = observed.join(days, "day").groupBy("id").agg(F.min("n").alias("lo"), F.max("n").alias("hi")).withColumn("_one", F.lit(1))
    span = span.join(F.broadcast(last), "_one").withColumn("is_open", col("hi") == col("last"))
    # A closed posting was last touched on the day it was found missing.
    span = span.withColumn("seen_n", F.when(col("is_open"), col("hi")).otherwise(col("hi") + 1))
    by_n = F.broadcast(days.select("n", "day"))
    first = by_n.select(col("n").alias("lo"), col("day").alias("first_seen"))
    final = by_n.select(col("n").alias("seen_n"), col("day").alias("last_seen"))
    return span.join(F.broadcast(first), "lo").join(F.broadcast(final), "seen_n").select("id", "first_seen", "last_seen", "is_open")
