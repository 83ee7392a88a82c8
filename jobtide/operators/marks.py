"""User marks: saved, applied and hidden postings, lists, and a three-way sync with an edited sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ACTED_ON, APPLICATION_STATUSES
from ..schemas import HIDDEN, SAVED, columns
from .rank import salary_label

col = F.col
KEY = ["user_id", "id"]


def upsert_saved(saved: DataFrame, patches: DataFrame, now) -> DataFrame:
    """Mark changes (user_id, id, status, note, title, company, url) into the saved table.

    Blank fields keep what was there; ``saved_at`` is the first save and
    ``applied_at`` the first time the posting was acted on.
    """
    now = F.lit(now).cast("timestamp")
    valid = patches.where(col("status").isNull() | col("status").isin(APPLICATION_STATUSES))
    p = valid.select(*KEY, F.struct("status", "note", "title", "company", "url").alias("p"))
    s = saved.select(*KEY, F.struct(*[c for c in saved.columns if c not in KEY]).alias("s"))
    j, touched = s.join(p, KEY, "full_outer"), col("p").isNotNull()
    status = F.coalesce("p.status", "s.status", F.lit("saved"))
    out = {
        "status": status, "note": F.coalesce("p.note", "s.note"), "saved_at": F.coalesce("s.saved_at", now),
        "updated_at": F.when(touched, now).otherwise(col("s.updated_at")),
        "applied_at": F.coalesce("s.applied_at", F.when(touched & status.isin(ACTED_ON), now)),
        **{c: F.coalesce(f"p.{c}", f"s.{c}") for c in ("title", "company", "url")},
    }
    return j.select(*KEY, *[out[c].alias(c) for c in columns(SAVED) if c not in KEY])


def unsave(saved: DataFrame, lists: DataFrame, items: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Saved marks and list items without the removed (user_id, id) pairs."""
    mine = items.join(lists.select("list_id", "user_id"), "list_id").join(removed.select(*KEY), KEY, "left_semi")
    return saved.join(removed, KEY, "left_anti"), items.join(mine.select("list_id", "id"), ["list_id", "id"], "left_anti")


def upsert_hidden(hidden: DataFrame, patches: DataFrame, now) -> DataFrame:
    """Hidden postings; ``hidden_at`` is the first time."""
    now = F.lit(now).cast("timestamp")
    p = patches.select(*KEY, F.struct("title", "company", "url").alias("p"))
    h = hidden.select(*KEY, F.struct("hidden_at", "title", "company", "url").alias("h"))
    j = h.join(p, KEY, "full_outer")
    out = {"hidden_at": F.coalesce("h.hidden_at", now), **{c: F.coalesce(f"p.{c}", f"h.{c}") for c in ("title", "company", "url")}}
    return j.select(*KEY, *[out[c].alias(c) for c in columns(HIDDEN) if c not in KEY])


def unhide(hidden: DataFrame, removed: DataFrame) -> DataFrame:
    return hidden.join(removed.select(*KEY), KEY, "left_anti")


def applied_ids(saved: DataFrame, user_id: str) -> DataFrame:
    return saved.where((col("user_id") == user_id) & col("status").isin(ACTED_ON)).select("id")


def hidden_ids(hidden: DataFrame, user_id: str) -> DataFrame:
    return hidden.where(col("user_id") == user_id).select("id")


def status_counts(saved: DataFrame) -> DataFrame:
    """Per user: one column per status, zero where none, and the total."""
    counts = [F.count_if(col("status") == s).alias(s) for s in APPLICATION_STATUSES]
    return saved.groupBy("user_id").agg(*counts, F.count(F.lit(1)).alias("total"))


def saved_in_list(saved: DataFrame, lists: DataFrame, items: DataFrame) -> DataFrame:
    """(list_id, added_at, saved columns): list items that are saved by the list's owner."""
    owned = items.join(lists.select("list_id", "user_id"), "list_id")
    return owned.join(saved, KEY).select("list_id", "added_at", *saved.columns)


def list_membership(lists: DataFrame, items: DataFrame) -> DataFrame:
    """(user_id, id, list_ids): the lists each posting is on."""
    owned = items.join(lists.select("list_id", "user_id"), "list_id")
    return owned.groupBy(*KEY).agg(F.array_sort(F.collect_set("list_id")).alias("list_ids"))


def lists_with_counts(lists: DataFrame, items: DataFrame) -> DataFrame:
    counts = items.groupBy("list_id").agg(F.count(F.lit(1)).alias("count"))
    return lists.join(counts, "list_id", "left").na.fill({"count": 0})


def hydrate_saved(saved: DataFrame, postings: DataFrame) -> DataFrame:
    """Saved rows with what the corpus says today; ``listed`` is NULL for postings the corpus does not hold."""
    live = postings.select(
        "id", col("title").alias("_title"), F.coalesce("company_name", "company_slug").alias("_company"),
        F.coalesce("apply_url", "url").alias("_url"), col("is_open").alias("listed"), col("d_workplace").alias("workplace"),
        col("d_seniority").alias("seniority"), col("d_job_function").alias("job_function"),
        salary_label(F.coalesce("d_salary_known", F.lit(False)), col("d_salary_min"), col("d_salary_max")).alias("salary_label"))
    out = saved.join(live, "id", "left")
    return out.select(
        *KEY, F.split("id", ":")[0].alias("ats"), F.coalesce("_company", "company").alias("company"),
        F.coalesce("_title", "title").alias("title"), F.coalesce("_url", "url").alias("url"), "status", "note", "saved_at",
        "updated_at", "applied_at", "listed", "workplace", "seniority", "job_function", "salary_label")


def three_way_sync(sheet: DataFrame, saved: DataFrame, fields: list[str]) -> DataFrame:
    """Sheet rows after a sync, with ``action`` added / updated / skipped / untouched.

    ``sheet`` has id, the fields and ``synced`` (map of what was last written);
    ``saved`` has id and the fields. A cell is written only when it is blank or
    still what was last written, and never with a blank: hand edits stay.
    """
    t = sheet.select("id", F.struct(*fields, "synced").alias("t"))
    s = saved.select("id", F.struct(*[F.coalesce(col(f).cast("string"), F.lit("")).alias(f) for f in fields]).alias("s"))
    j = t.join(s, "id", "full_outer")

    def write(f: str) -> Column:
        current, wanted = F.trim(F.coalesce(f"t.{f}", F.lit(""))), col(f"s.{f}")
        untouched = (current == "") | F.coalesce(current == F.try_element_at("t.synced", F.lit(f)), F.lit(False))
        return F.coalesce((wanted != "") & (current != wanted) & untouched, F.lit(False))

    wrote = F.lit(False)
    for f in fields:
        wrote = wrote | write(f)
    j = j.withColumn("action", F.when(col("t").isNull(), "added").when(col("s").isNull(), "untouched").when(wrote, "updated").otherwise("skipped"))
    stamp = F.create_map(*[x for f in fields for x in (F.lit(f), col(f"s.{f}"))])
    cells = [F.when(col("action") == "added", col(f"s.{f}")).when(write(f), col(f"s.{f}")).otherwise(col(f"t.{f}")).alias(f) for f in fields]
    return j.select("id", *cells, F.when(col("action").isin("added", "updated"), stamp).otherwise(col("t.synced")).alias("synced"), "action")
