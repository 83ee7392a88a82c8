"""Scoring, orders, top-k, duplicate folding, paging and presentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .derive_text import round_half_up

col = F.col

# Score curve parameters.
RECENCY_DAYS, UNDATED = 90.0, 0.3
PAY_FLOOR, PAY_CEILING, UNPAID = 60_000.0, 250_000.0, 0.35
TEXT_FIELD_FACTOR = {"company": 1.0, "title": 0.6, "body": 0.05}
RARE = 100.0
UNDATED_AGE = 9999


def salary_top() -> Column:
    return F.when(col("salary_known"), F.coalesce("salary_max", "salary_min"))


def salary_bottom() -> Column:
    return F.when(col("salary_known"), F.coalesce("salary_min", "salary_max"))


def years_fit(p: dict) -> Column:
    lowest, highest = p["min_years_experience"], p["max_years_experience"]
    if lowest is None and highest is None:
        return F.lit(0.5)
    fits = F.lit(True)
    if highest is not None:
        fits = fits & (col("min_years") <= highest)
    if lowest is not None:
        fits = fits & (F.coalesce("max_years", "min_years") >= lowest)
    return F.when(col("years_known") & col("min_years").isNotNull(), F.when(fits, 1.0).otherwise(0.0)).otherwise(0.4)


def text_specificity(matches: Column, corpus: Column) -> Column:
    """1 for a rare word, falling to 0 for one every posting has."""
    matches, corpus = matches.cast("double"), corpus.cast("double")
    span = F.ln(corpus / RARE)
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.ln(corpus / matches) / span))
    return (
        F.when((F.coalesce(matches, F.lit(0.0)) <= 0) | (F.coalesce(corpus, F.lit(0.0)) <= 0) | (matches >= corpus), 0.0)
        .when(~(span > 0), 1.0).otherwise(clamped)
    )


def score(df: DataFrame, p: dict) -> DataFrame:
    """Add ``score_parts`` and ``score`` (two decimals).

    Uses title_hits; text_field, text_spec and description_hits when present.
    """
    w = p["weights"]
    part = {}
    factor = F.lit(0.0)
    if "text_field" in df.columns:
        for name, value in TEXT_FIELD_FACTOR.items():
            factor = F.when(col("text_field") == name, value).otherwise(factor)
        factor = factor * F.coalesce("text_spec", F.lit(1.0))
    part["text"] = factor * w["text_match"]
    part["title"] = F.size("title_hits") * F.lit(float(w["title_keyword"]))
    hits = F.size("description_hits") if "description_hits" in df.columns else F.lit(0)
    part["description"] = F.least(hits, F.lit(int(w["description_keyword_cap"]))) * F.lit(float(w["description_keyword"]))
    part["recency"] = F.coalesce(F.exp(-col("age_days") / RECENCY_DAYS), F.lit(UNDATED)) * w["recency"]
    pay = (salary_top() - PAY_FLOOR) / (PAY_CEILING - PAY_FLOOR)
    pay = F.when(pay.isNull(), UNPAID).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), pay)))
    part["salary"] = pay * w["salary"]
    part["years"] = years_fit(p) * w["years_fit"]
    part["quality"] = F.coalesce("quality", F.lit(0.0)) * w["quality"]
    df = df.withColumn("score_parts", F.struct(*[c.alias(k) for k, c in part.items()]))
    total = col("score_parts.text")
    for key in list(part)[1:]:
        total = total + col(f"score_parts.{key}")
    return df.withColumn("score", round_half_up(total, 2))


def rank_key(sort: str = "relevance") -> Column:
    """One ascending struct per sort: absent values last, then score, freshness and id."""
    def up(c):
        return [c.isNull(), c]

    def down(c):
        return [c.isNull(), -c]

    lead = {
        "relevance": [], "newest": up(col("age_days")), "oldest": down(col("age_days")),
        "salary-high": down(salary_top()), "salary-low": up(salary_bottom()), "quality": down(col("quality")),
        "company": [F.collate(F.coalesce("company_name", "company_slug", F.lit("")), "UNICODE_CI_AI")],
    }[sort]
    keys = [*lead, -col("score"), F.coalesce("age_days", F.lit(UNDATED_AGE)), col("id")]
    return F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])


def top_rows(df: DataFrame, sort: str, k: int, offset: int = 0) -> DataFrame:
    """The page's rows with their ``position``: one bounded heap per task, then a merge."""
    page = df.orderBy(rank_key(sort)).offset(offset).limit(k) if offset else df.orderBy(rank_key(sort)).limit(k)
    return page.withColumn("position", F.row_number().over(Window.orderBy(rank_key(sort))) + offset)


def collapse_duplicates(df: DataFrame, sort: str) -> DataFrame:
    """Keep the best copy per company and title; add ``duplicates`` and ``duplicate_metros``.

    Copies are reduced in the map tasks (best row, count, distinct metros), so a
    group that holds a third of all rows never gathers in one task.
    """
    df = df.withColumn("_title", F.coalesce("title_norm", "title_folded"))
    keys = ["company_slug", "_title"]
    columns = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(
        F.min_by(F.struct(*columns), rank_key(sort)).alias("_best"), (F.count(F.lit(1)) - 1).alias("duplicates"))
    metros = (
        df.select(*keys, F.explode("metros").alias("metro")).distinct()
        .groupBy(*keys).agg(F.array_sort(F.collect_list("metro")).alias("duplicate_metros"))
    )
    on = best["company_slug"].eqNullSafe(metros["company_slug"]) & best["_title"].eqNullSafe(metros["_title"])
    joined = best.join(metros, on, "left").select(
        best["company_slug"], "_best.*", "duplicates", F.coalesce("duplicate_metros", F.array().cast("array<string>")).alias("duplicate_metros"))
    return joined


def explain(hits: Column) -> Column:
    """First six description hits as one line; NULL without hits."""
    return F.when(F.size(hits) > 0, F.concat(F.lit("description: "), F.array_join(F.slice(hits, 1, 6), ", ")))


def money(c: Column) -> Column:
    thousands = F.format_string("$%dk", round_half_up(c / 1000).cast("long"))
    return F.when(c >= 1_000_000, F.format_string("$%.1fm", c / 1_000_000)).otherwise(thousands)


def salary_label(known: Column, low: Column, high: Column) -> Column:
    span = F.concat(money(low), F.lit("–"), money(high))
    return F.when(known, F.when(low != high, span).otherwise(money(F.coalesce(high, low))))


PRESENTED = [
    "id", "ats", "listed", "title", "company", "company_slug", "company_open_roles", "company_size", "sector",
    "company_blurb", "department", "url", "apply_url", "workplace", "workplace_guessed", "remote_scope", "metros",
    "countries", "seniority", "min_years", "max_years", "years_known", "salary_known", "salary_min", "salary_max",
    "salary_label", "salary_src", "pay_period", "currency", "equity", "employment_type", "job_function", "skills",
    "visa", "clearance", "degree", "age_days", "posted_at", "first_seen", "quality", "score", "score_parts",
    "title_hits", "description_hits", "text_hit", "why", "duplicates", "duplicate_metros", "unknown_on",
]


def present(page: DataFrame, links: DataFrame | None = None, companies: DataFrame | None = None) -> DataFrame:
    """Output fields of one page; wide columns are fetched for the page only.

    ``links`` has id, url, apply_url; ``companies`` has id (ats:slug) and blurb.
    """
    page = page.withColumn("company_id", F.concat_ws(":", "ats", "company_slug"))
    if links is not None:
        page = links.select("id", "url", "apply_url").join(F.broadcast(page), "id", "right")
    if companies is not None:
        blurbs = companies.select(col("id").alias("company_id"), col("blurb").alias("company_blurb"))
        page = blurbs.join(F.broadcast(page), "company_id", "right")
    made = {
        "company": col("company_name"), "salary_label": salary_label(col("salary_known"), col("salary_min"), col("salary_max")),
        "equity": F.coalesce("equity", F.lit(False)),
    }
    if "description_hits" in page.columns:
        made["why"] = explain(col("description_hits"))
    if "text_field" in page.columns:
        made["text_hit"] = col("text_field")
    page = page.withColumns(made)
    known = page.columns
    empty = F.array().cast("array<string>")
    fill = {"description_hits": empty, "duplicate_metros": empty}
    fields = [col(c) if c in known else fill.get(c, F.lit(None).cast("string")).alias(c) for c in PRESENTED]
    return page.select(*fields, *([col("position")] if "position" in known else []))


def sample_evenly(df: DataFrame, order, n: int, buckets: int | None = None) -> DataFrame:
    """Rows number floor(i * rows / n) of the order: evenly spaced and repeatable.

    Row numbers come from a range partitioning: each partition numbers its own
    rows and adds the sizes of those before it, so no task sees the whole table.
    """
    total = col("_total")

    def ceil_div(c: Column) -> Column:
        return F.call_function("div", c + total - 1, total)

    # Row rn is picked when some whole i lies in [rn * n / total, (rn + 1) * n / total).
    picked = (total <= n) | (ceil_div(col("_rn") * n) < ceil_div((col("_rn") + 1) * n))
    return _numbered(df, order, buckets).where(picked).drop("_rn", "_total")


def _numbered(df: DataFrame, order, buckets: int | None) -> DataFrame:
    parts = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Sizes and row numbers must rest on the same ranges, and a ranged plan run twice samples its bounds twice; so it is stored.
    ranged = materialize(df.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # one row per partition
    before = sizes.select(
        "_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_total"))
    local = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ranged.withColumn("_local", local).join(F.broadcast(before), "_p").withColumn(
        "_rn", col("_local") - 1 + col("_before")).drop("_p", "_local", "_before")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows of each group; the rank limit runs in the map tasks before the shuffle."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rn", rn).where(col("rn") <= k)
