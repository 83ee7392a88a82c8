"""What a company's own postings say about it, gathered for a reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import about_excerpt
from .facets import open_roles
from .rank import top_per_group

col = F.col
# How much of a company is gathered and shown.
RECENT_TITLES, LONG_TEXTS, MIN_TEXT = 60, 6, 200
MAX_TITLES, MAX_EXCERPTS, MIN_EXCERPT, BUDGET, OVERHEAD = 14, 3, 80, 6000, 24


def companies_to_read(companies: DataFrame, postings: DataFrame, all_companies: bool = False, limit: int | None = None) -> DataFrame:
    """Live companies with open roles that nobody has read, most roles first."""
    live = companies.where(col("status") == "live")
    if not all_companies:
        live = live.where(col("sector_at").isNull())
    roles = open_roles(postings, "company_id").withColumnRenamed("company_id", "id")
    out = live.join(roles, "id").orderBy(col("open_roles").desc(), "id")
    return out.limit(limit) if limit else out


def _in_order(pairs: Column, value: str) -> Column:
    return F.transform(F.array_sort(pairs), lambda x: x[value])


def gather(postings: DataFrame, texts: DataFrame) -> DataFrame:
    """(company_id, titles, texts): the latest 60 titles and 6 long texts of each company.

    The per-company limit runs before the shuffle, so a company with a third of
    all postings costs no more than any other.
    """
    opened = postings.where("is_open").select("id", "company_id", "title", "posted_at")
    order = [col("posted_at").desc_nulls_last(), col("id")]
    titles = top_per_group(opened, ["company_id"], order, RECENT_TITLES).groupBy("company_id").agg(
        _in_order(F.collect_list(F.struct("rn", "title")), "title").alias("titles"))
    long_texts = texts.where(F.length("text") > MIN_TEXT)
    newest = top_per_group(opened.join(long_texts.select("id"), "id", "left_semi"), ["company_id"], order, LONG_TEXTS)
    bodies = newest.join(long_texts, "id").groupBy("company_id").agg(_in_order(F.collect_list(F.struct("rn", "text")), "text").alias("texts"))
    return titles.join(bodies, "company_id", "full_outer")


def company_dossier(companies: DataFrame, gathered: DataFrame) -> DataFrame:
    """(id, dossier): names, distinct titles and distinct excerpts within a budget of characters."""
    df = companies.join(gathered.withColumnRenamed("company_id", "id"), "id", "left")
    name = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.nullif(col("slug"), F.lit("")), F.lit("unknown"))
    df = df.withColumn("_name", name)
    site = F.coalesce(F.concat(F.lit("Website: "), F.nullif(col("website"), F.lit(""))), F.concat(F.lit("Board: "), F.nullif(col("board_url"), F.lit(""))))
    # Titles equal but for case count once; the first spelling stays.
    distinct = F.aggregate(
        F.coalesce("titles", F.array().cast("array<string>")), F.array().cast("array<string>"),
        lambda kept, t: F.when(
            (F.coalesce(F.trim(t), F.lit("")) == "") | F.exists(kept, lambda k: F.lower(k) == F.lower(F.trim(t))), kept
        ).otherwise(F.concat(kept, F.array(F.trim(t)))))
    df = df.withColumn("_titles", distinct)
    more = F.when(F.size("_titles") > MAX_TITLES, F.format_string(" (and %d more)", F.size("_titles") - MAX_TITLES)).otherwise("")
    roles = F.when(F.size("_titles") > 0, F.concat(F.lit("Open roles: "), F.array_join(F.slice("_titles", 1, MAX_TITLES), "; "), more))
    head = F.concat_ws("\n", F.concat(F.lit("Company: "), col("_name")), F.when(
        col("slug") != col("_name"), F.concat(F.lit("Board slug: "), col("slug"))), site, roles)
    df = df.withColumn("_head", head).withColumn(
        "_cuts", F.transform(F.coalesce("texts", F.array().cast("array<string>")), lambda t: about_excerpt(t, col("_name"))))

    def add(acc: Column, cut: Column) -> Column:
        key = F.lower(F.substring(cut, 1, 200))
        skip = (F.size(acc["keys"]) >= MAX_EXCERPTS) | (acc["used"] >= BUDGET) | (F.length(cut) < MIN_EXCERPT) | F.array_contains(acc["keys"], key)
        piece = F.substring(cut, F.lit(1), F.greatest(F.lit(BUDGET) - acc["used"], F.lit(0)))
        grown = F.struct(
            (acc["used"] + F.length(piece) + OVERHEAD).alias("used"), F.concat(acc["keys"], F.array(key)).alias("keys"),
            F.concat(acc["text"], F.lit("\n\n--- from a posting ---\n"), piece).alias("text"))
        return F.when(skip, acc).otherwise(grown)

    start = F.struct(F.length("_head").alias("used"), F.array().cast("array<string>").alias("keys"), F.lit("").alias("text"))
    return df.select("id", F.concat(col("_head"), F.aggregate("_cuts", start, add)["text"]).alias("dossier"))
