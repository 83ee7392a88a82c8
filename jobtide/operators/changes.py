"""Reports over the event log, which is partitioned by day so each reads only its days."""

from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import EVENTS
from .rank import salary_label

col = F.col


def latest_day(events: DataFrame) -> date:
    return events.agg(F.max("day")).first()[0] or date.today()


def resolve_since(events: DataFrame, since=None) -> tuple[date, date]:
    """(from, latest): last-sweep, a date, yesterday or Nd, counted back from the latest event day."""
    latest = latest_day(events)
    text = "" if since is None else str(since)
    if text in ("", "last-sweep"):
        return latest, latest
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        return date.fromisoformat(text), latest
    number = "1" if text == "yesterday" else text.removesuffix("d")
    try:
        return latest - timedelta(days=int(float(number))), latest
    except ValueError:
        raise ValueError(f'Cannot read "{since}" as a date: use YYYY-MM-DD, yesterday, last-sweep or 7d') from None


def _since(events: DataFrame, start, kinds: list[str]) -> DataFrame:
    return events.where((col("day") >= F.lit(start).cast("date")) & col("event").isin(kinds))


def new_since(events: DataFrame, start) -> DataFrame:
    return _since(events, start, ["appeared", "reappeared"]).select("id").distinct()


def changed_since(events: DataFrame, start) -> DataFrame:
    return _since(events, start, ["changed"]).select("id").distinct()


def gone_since(events: DataFrame, postings: DataFrame, start) -> DataFrame:
    """Disappeared and still closed, newest first; one row per disappearance day."""
    gone = _since(events, start, ["disappeared"]).select("id", "day")
    columns = [c for c in ("title", "company_name", "url", "d_metros", "d_workplace", "last_seen") if c in postings.columns]
    return gone.join(postings.where(~col("is_open")).select("id", *columns), "id").orderBy(
        col("day").desc(), *[c for c in ("company_name", "id") if c in ("id", *columns)])


def activity(events: DataFrame, days: int = 30) -> DataFrame:
    """Events per day as columns, newest days first, zero where none."""
    wide = events.groupBy("day").pivot("event", EVENTS).count().na.fill(0)
    return wide.orderBy(col("day").desc()).limit(days)


def job_detail(postings: DataFrame, texts: DataFrame, companies: DataFrame, events: DataFrame, posting_id: str) -> DataFrame:
    """One posting with its text, company and events, newest first. The id filter reaches every scan."""
    mine = postings.where(col("id") == posting_id)
    log = events.where(col("id") == posting_id).groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("day", "event")), asc=False).alias("events"))
    company = companies.select(
        col("id").alias("company_id"), col("name").alias("company_display"), "name_source", "board_url", "website", "sector",
        col("blurb").alias("company_blurb"), "sector_src", "sector_at")
    return (
        mine.join(texts.where(col("id") == posting_id), "id", "left").join(company, "company_id", "left").join(log, "id", "left")
        .withColumn("salary_label", salary_label(F.coalesce("d_salary_known", F.lit(False)), col("d_salary_min"), col("d_salary_max")))
    )
