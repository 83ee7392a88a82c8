"""Metro registry, aliases, bridge tables and place-name resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.countries import COUNTRY_NAMES
from ..functions.gazetteer import DEFAULT, Gazetteer
from ..functions.text import title_case

col = F.col


def bridge_tables(derived: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, metro) and (id, skill)."""
    return (
        derived.select("id", F.explode(F.array_distinct("d_metros")).alias("metro")),
        derived.select("id", F.explode(F.array_distinct("d_skills")).alias("skill")),
    )


def _majority(votes: DataFrame) -> DataFrame:
    """(metro, country): the most frequent country per metro, ties by code."""
    counts = votes.groupBy("metro", "country").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("metro").agg(F.min_by("country", F.struct((-col("n")).alias("n"), "country")).alias("best"))


def _registry(counts: DataFrame, best: DataFrame, places: Gazetteer) -> DataFrame:
    known = places.metro_frame(counts.sparkSession)
    return counts.join(F.broadcast(known), "metro", "left").join(best, "metro", "left").select(
        col("metro").alias("id"), F.coalesce("label", title_case(col("metro"))).alias("label"),
        F.coalesce("country", "best").alias("country"), "region", "job_count")


def metro_registry(derived: DataFrame, located: DataFrame, places: Gazetteer = DEFAULT) -> DataFrame:
    """Metros in use with their counts; a minted metro takes the majority country of the strings that named it."""
    counts = derived.select(F.explode("d_metros").alias("metro")).groupBy("metro").agg(F.count(F.lit(1)).alias("job_count"))
    votes = located.select(F.explode("cities").alias("c")).where(col("c.minted") & col("c.country").isNotNull()).select("c.metro", "c.country")
    return _registry(counts, _majority(votes), places)


def metro_aliases(registry: DataFrame, located: DataFrame, places: Gazetteer = DEFAULT) -> DataFrame:
    """(alias, metro_id): listed spellings of metros in use, overridden by observed ones, the most frequent winning."""
    spark = registry.sparkSession
    listed = places.city_frame(spark).join(registry.select(col("id").alias("metro")), "metro", "left_semi").select(
        col("city").alias("alias"), "metro", F.lit(0).cast("long").alias("n"))
    seen = located.select(F.explode("cities").alias("c")).groupBy(col("c.city").alias("alias"), col("c.metro").alias("metro")).agg(
        F.count(F.lit(1)).alias("n"))
    both = listed.unionByName(seen)
    return both.groupBy("alias").agg(F.min_by("metro", F.struct((-col("n")).alias("n"), "metro")).alias("metro_id"))


def rebuild_metro_registry(postings: DataFrame, aliases: DataFrame, places: Gazetteer = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """The registry from stored metros and countries alone, and the aliases whose metro survives."""
    spark = postings.sparkSession
    each = postings.select(F.explode("d_metros").alias("metro"), "d_countries")
    counts = each.groupBy("metro").agg(F.count(F.lit(1)).alias("job_count"))
    listed = F.broadcast(places.metro_frame(spark).select("metro"))
    votes = each.join(listed, "metro", "left_anti").select("metro", F.explode("d_countries").alias("country"))
    registry = _registry(counts, _majority(votes), places)
    used = registry.select(col("id").alias("metro_id"))
    fixed = places.city_frame(spark).select(col("city").alias("alias"), col("metro").alias("metro_id")).join(used, "metro_id", "left_semi")
    kept = aliases.join(used, "metro_id", "left_semi").join(fixed.select("alias"), "alias", "left_anti")
    return registry, kept.select("alias", "metro_id").unionByName(fixed.select("alias", "metro_id"))


def resolve_places(names: DataFrame, countries: DataFrame, metros: DataFrame) -> DataFrame:
    """(name, country, metro) for written ``name`` rows; both NULL when nothing is known by it.

    ``countries`` has code, those in the corpus. Tried in turn: country name or
    code, then metro id or label; first on the whole name, then on the part
    before a comma.
    """
    spark = names.sparkSession
    base = F.regexp_replace(F.regexp_replace(F.lower(F.trim("name")), "^the\\s+", ""), "\\s+", " ")
    n = names.where(F.trim("name") != "").withColumn("_a", base).withColumn(
        "_b", F.when(F.locate(",", col("_a")) > 1, F.trim(F.substring_index("_a", ",", 1))))
    spelled = [(name.lower(), code.lower(), 2) for code, name in COUNTRY_NAMES.items()]
    spelled += [(code.lower(), code.lower(), 1) for code in COUNTRY_NAMES]
    spelled += [(w, "gb", 0) for w in ("uk", "united kingdom", "england")]
    spelled += [(w, "us", 0) for w in ("usa", "us", "america", "united states", "the united states")]
    known = spark.createDataFrame(spelled, "key string, code string, rank int").join(countries.select("code").distinct(), "code", "left_semi")
    by_country = known.groupBy("key").agg(F.min_by("code", "rank").alias("country"))
    ids = metros.select(col("id").alias("key"), col("id").alias("metro"), F.struct(F.lit(0), F.lit(0).cast("long"), col("id")).alias("o"))
    labels = metros.select(F.lower("label").alias("key"), col("id").alias("metro"), F.struct(F.lit(1), -col("job_count"), col("id")).alias("o"))
    by_metro = ids.union(labels).groupBy("key").agg(F.min_by("metro", "o").alias("metro"))

    def lookup(df: DataFrame, table: DataFrame, value: str, key: str) -> DataFrame:
        return df.join(table.select(col("key").alias(key), col(value).alias(f"{value}{key}")), key, "left")

    for key in ("_a", "_b"):
        n = lookup(lookup(n, by_country, "country", key), by_metro, "metro", key)
    country = F.coalesce("country_a", "country_b")
    return n.select("name", country.alias("country"), F.when(country.isNull(), F.coalesce("metro_a", "metro_b")).alias("metro"))
