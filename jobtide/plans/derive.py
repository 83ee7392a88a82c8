"""Raw postings and their text to the ``d_*`` columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.gazetteer import DEFAULT, Gazetteer
from ..functions.text import fold, trim_space
from ..operators import derive_text as D
from ..operators.facets import top_counts
from ..operators.location import derive_location, remote_scope
from ..session import materialize
from .places import PlaceMemory

col = F.col


def derive(postings: DataFrame, texts: DataFrame, as_of, places: Gazetteer = DEFAULT, memory: PlaceMemory | None = None) -> DataFrame:
    """Postings with every derived column, plus ``cities`` and ``unmatched`` for the registry.

    Places are read once per distinct string, and with a ``memory`` only those it
    does not hold; everything else is row-local and reads each text once. All
    joins are on the posting id.
    """
    raw = [c for c in postings.columns if not c.startswith("d_") and c not in ("cities", "unmatched")]
    # What a text says is read where the text is scanned; only the findings are shuffled to the join.
    read = texts.select("id", D.read_text(col("text")).alias("_read"), F.length("text").alias("_length")).select(
        "id", col("_read.signals").alias("_signals"), col("_read.years").alias("_years"), "_length")
    df = postings.select(*raw).join(read, "id", "left").join(derive_location(postings, places, memory), "id")
    df = df.withColumns({
        "_title": fold(col("title")), "_dept": fold(F.concat_ws(" ", F.coalesce("department", F.lit("")), F.coalesce("team", F.lit("")))),
        "_pay": D.annual_salary(col("comp_min"), col("comp_max"), col("comp_currency"), col("comp_interval")),
        "_place": D.workplace(col("raw_workplace"), col("raw_remote"), col("remote_hint"), col("d_metros")),
    })
    years_known = col("_years").isNotNull()
    df = df.withColumn("_level", D.seniority(col("_title"), col("_years.min")))
    return df.select(
        *raw, col("_place.value").alias("d_workplace"), col("_place.src").alias("d_workplace_src"),
        F.when(col("_place.value") == "remote", remote_scope(col("d_countries"), col("d_supra"))).alias("d_remote_scope"),
        "d_metros", "d_countries", col("_pay.min").alias("d_salary_min"), col("_pay.max").alias("d_salary_max"),
        col("_pay.known").alias("d_salary_known"), col("_pay.src").alias("d_salary_src"), col("_years.min").alias("d_min_years"),
        col("_years.max").alias("d_max_years"), years_known.alias("d_years_known"), col("_level.level").alias("d_seniority"),
        col("_level.src").alias("d_seniority_src"), D.job_function(col("_title"), col("_dept")).alias("d_job_function"),
        F.coalesce(col("_signals.skills"), F.array().cast("array<string>")).alias("d_skills"), col("_signals.visa").alias("d_visa"), col("_signals.clearance").alias("d_clearance"),
        col("_signals.degree").alias("d_degree"),
        D.quality(col("_length"), col("_pay.known"), years_known, col("_place.value"), col("d_metros"), col("employment_type"),
                  col("department"), col("posted_at")).alias("d_quality"),
        F.lit(as_of).cast("timestamp").alias("d_derived_at"), "cities", "unmatched",
    )


def derive_incremental(postings: DataFrame, texts: DataFrame, as_of, places: Gazetteer = DEFAULT, limit: int | None = None,
                       memory: PlaceMemory | None = None) -> DataFrame:
    """Only rows whose stamp was cleared are derived; the others pass through.

    ``postings`` holds the earlier derived columns.
    """
    stale = postings.where(col("d_derived_at").isNull())
    stale = stale.orderBy("id").limit(limit) if limit else stale
    fresh = derive(materialize(stale, "stale") if limit else stale, texts, as_of, places, memory)
    kept = postings.where(col("d_derived_at").isNotNull())
    if limit:
        kept = postings.join(fresh.select("id"), "id", "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def derive_coverage(derived: DataFrame) -> dict[str, DataFrame]:
    """Coverage counts, distributions, biggest metros and most frequent unread fragments."""
    counts = derived.agg(
        F.count(F.lit(1)).alias("postings"), F.count_if(col("d_workplace") != "unknown").alias("workplace_known"),
        F.count_if(F.size("d_metros") > 0).alias("placed"), F.count_if(F.size("d_metros") > 1).alias("multi_metro"),
        F.count_if("d_salary_known").alias("salary_known"), F.count_if("d_years_known").alias("years_known"),
        F.count_if(col("d_seniority") != "unknown").alias("seniority_known"), F.count_if("d_visa").alias("visa_yes"),
        F.count_if(~col("d_visa")).alias("visa_no"), F.count_if("d_clearance").alias("clearance"), F.avg("d_quality").alias("mean_quality"))
    spread = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in {
        "workplace": col("d_workplace"), "seniority": col("d_seniority"), "job_function": col("d_job_function"),
        "salary_src": F.substring_index("d_salary_src", ":", 1), "degree": col("d_degree")}.items()])).alias("x")
    out = {"coverage": counts, "distributions": derived.select(spread).where(col("x.value").isNotNull()).groupBy("x.name", "x.value").agg(
        F.count(F.lit(1)).alias("postings"))}
    out["metros"] = top_counts(derived.select(F.explode("d_metros").alias("m")), "m", 30)
    if "unmatched" in derived.columns:
        out["unmatched"] = top_counts(derived.select(F.explode("unmatched").alias("u")), trim_space(col("u")), 40)
    return out
