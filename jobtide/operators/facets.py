"""Leave-one-out facet counts, the salary ladder, the funnel and corpus counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (
    AGE_BANDS, ATS_KEYS, COMPANY_SIZE_BANDS, DEGREES, FACET_CAP, FACET_CAPS, LADDER_MIN_FIGURES, LADDER_QUANTILES,
    PAY_PERIODS, REMOTE_SCOPES, SALARY_BANDS, SECTORS,
)
from ..session import materialize
from .derive_text import round_half_up
from .rank import money, salary_top

col = F.col


def age_bands(p: dict) -> list[tuple[str, float | None]]:
    """The standing bands plus the search's own, when it asks for another number of days."""
    days = p.get("posted_within_days")
    if days is None or any(limit == days for _, limit in AGE_BANDS):
        return AGE_BANDS
    shown = int(days) if float(days).is_integer() else days
    return [*AGE_BANDS, (f"≤{shown} day{'' if shown == 1 else 's'}", days)]


def _age_labels(p: dict) -> Column:
    """Every band a posting clears; bands are cumulative."""
    labels = [F.when(F.lit(True) if limit is None else col("age_days") <= limit, F.lit(label)) for label, limit in age_bands(p)]
    cleared = F.filter(F.array(*labels), lambda x: x.isNotNull())
    return F.when(col("age_days").isNull(), F.array(F.lit("unknown"))).otherwise(cleared)


def dimensions(p: dict) -> list[tuple[str, str | None, Column]]:
    """(dimension, criterion it belongs to, value or array of values)."""
    return [
        ("ats", "ats", col("ats")),
        ("metro", "metro", col("metros")),
        ("workplace", "workplace", F.coalesce("workplace", F.lit("unknown"))),
        ("seniority", "experience", F.coalesce("seniority", F.lit("unknown"))),
        ("employment_type", "employment_type", col("employment_type")),
        ("job_function", "job_function", F.coalesce("job_function", F.lit("other"))),
        ("salary_value", "salary", F.coalesce(salary_top().cast("string"), F.lit("unknown"))),
        ("age_band", "posted", _age_labels(p)),
        ("country", "metro", col("countries")),
        ("company_size", "company_size", col("company_size")),
        ("sector", "sector", col("sector")),
        ("remote_scope", "remote_scope", col("remote_scope")),
        ("pay_period", "pay_period", col("pay_period")),
        ("degree", "degree", col("degree")),
        ("visa", "visa", F.when(col("visa"), "sponsors").when(~col("visa"), "will not sponsor")),
        ("clearance", "clearance", F.when(col("clearance"), "requires clearance")),
        ("currency", "currency", col("currency")),
        ("equity", "equity", F.when(col("equity"), "yes").otherwise("not stated")),
        ("salary_source", "salary_source", F.when(~F.coalesce("salary_known", F.lit(False)), "not published")
         .when(col("salary_src") == "as-stated", "as-stated").otherwise("reinterpreted")),
        ("company", None, F.coalesce("company_name", "company_slug")),
        ("skill", None, col("skills")),
    ]


def _labelled(dim: str):
    return lambda v: F.struct(F.lit(dim).alias("dim"), v.alias("value"))


LIST_DIMENSIONS = {"metro", "age_band", "country", "skill"}
# Dimensions shown in a fixed order; all others by count.
ORDERS = {
    "ats": ATS_KEYS, "company_size": [b[0] for b in COMPANY_SIZE_BANDS], "remote_scope": REMOTE_SCOPES,
    "pay_period": PAY_PERIODS, "degree": DEGREES, "visa": ["sponsors", "will not sponsor"],
    "equity": ["yes", "not stated"], "salary_source": ["as-stated", "reinterpreted", "not published"],
}


def facet_counts(screened: DataFrame, p: dict) -> DataFrame:
    """(dim, value, n) over rows that failed nothing, or only the dimension's own criterion.

    One pass: each row emits its (dim, value) pairs and counts are combined in
    the map tasks, so the shuffle carries distinct values, not rows.
    """
    # Rows with two failures emit nothing here instead of being filtered first: a filter
    # over every criterion at once costs the optimizer far more than it saves the scan.
    screened = screened.withColumns({
        "_none": F.size("failed") == 0, "_only": F.when(F.size("failed") == 1, F.try_element_at("failed", F.lit(1)))})
    pairs = []
    for dim, criterion, value in dimensions(p):
        counts = col("_none") if criterion is None else col("_none") | F.coalesce(col("_only") == criterion, F.lit(False))
        items = F.transform(value, _labelled(dim)) if dim in LIST_DIMENSIONS else F.array(F.struct(F.lit(dim).alias("dim"), value.alias("value")))
        pairs.append(F.when(counts, items).otherwise(F.array().cast("array<struct<dim:string,value:string>>")))
    return (
        screened.select(F.explode_outer(F.concat(*pairs)).alias("x")).select("x.dim", "x.value")
        .where(col("value").isNotNull())
        .groupBy("dim", "value").agg(F.count(F.lit(1)).alias("n"))
    )


def exact_rank_values(hist: DataFrame, quantiles: list[float], width: int) -> DataFrame:
    """One row: known (total count) and q0..qk, the value at rank floor(q * (total - 1)).

    ``hist`` has value and n. Values are bucketed by ``width``; only the short
    list of bucket totals is summed in one place, ranks inside a bucket are
    found per bucket.
    """
    hist = hist.withColumn("_b", F.floor(col("value") / width))
    per_bucket = hist.groupBy("_b").agg(F.sum("n").alias("_bn"))
    ahead = per_bucket.select(
        "_b", F.coalesce(F.sum("_bn").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"),
        F.sum("_bn").over(Window.partitionBy(F.lit(0))).alias("_total"))
    running = F.sum("n").over(Window.partitionBy("_b").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    placed = hist.withColumn("_upto", running).join(F.broadcast(ahead), "_b").withColumn("_upto", col("_upto") + col("_ahead"))
    rank = [F.floor(F.lit(q) * (col("_total") - 1)) for q in quantiles]
    picks = [
        F.max(F.when((col("_upto") - col("n") <= r) & (r < col("_upto")), col("value"))).alias(f"q{i}") for i, r in enumerate(rank)
    ]
    return placed.agg(F.coalesce(F.max("_total"), F.lit(0)).alias("known"), *picks)


def nice_round(c: Column) -> Column:
    """Rounded to a step a reader would pick for that size of figure."""
    def to(step: int) -> Column:
        return (round_half_up(c / step) * step).cast("long")

    return F.when(c < 20_000, to(1_000)).when(c < 100_000, to(5_000)).when(c < 500_000, to(10_000)).otherwise(to(50_000))


def salary_ladder(hist: DataFrame) -> DataFrame:
    """One row with ``ladder``: array of (label, lo, hi) cut at rounded quintiles of (value, n).

    Too few figures or cuts that collapse give the standing bands.
    """
    stats = exact_rank_values(hist, LADDER_QUANTILES, width=10_000)
    cuts = F.array_distinct(F.filter(F.array(*[nice_round(col(f"q{i}")) for i in range(len(LADDER_QUANTILES))]), lambda c: c > 0))
    stats = stats.withColumn("_cuts", cuts)
    band = "struct<label:string,lo:bigint,hi:bigint>"
    nothing = F.lit(None).cast("bigint")
    first = F.struct(F.concat(F.lit("under "), money(col("_cuts")[0])).alias("label"), F.lit(0).cast("long").alias("lo"), col("_cuts")[0].alias("hi"))
    middle = F.zip_with(
        F.slice("_cuts", F.lit(1), F.size("_cuts") - 1), F.slice("_cuts", F.lit(2), F.size("_cuts") - 1),
        lambda a, b: F.struct(F.concat(money(a), F.lit("–"), money(b)).alias("label"), a.alias("lo"), b.alias("hi")))
    last = F.struct(F.concat(money(F.element_at("_cuts", -1)), F.lit("+")).alias("label"), F.element_at("_cuts", -1).alias("lo"), nothing.alias("hi"))
    standing = F.array(*[
        F.struct(F.lit(label).alias("label"), F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi"))
        for label, lo, hi in SALARY_BANDS])
    cut = F.concat(F.array(first), middle, F.array(last))
    fits = (col("known") >= LADDER_MIN_FIGURES) & (F.size("_cuts") >= 2)
    return stats.select(F.when(fits, cut).otherwise(standing).cast(f"array<{band}>").alias("ladder"))


def salary_facet(counts: DataFrame) -> DataFrame:
    """(dim, position, value, label, count, selected) of the salary bands, zero-filled, unknown first."""
    mine = counts.where(col("dim") == "salary_value").withColumn("v", F.expr("try_cast(value AS bigint)"))
    ladder = salary_ladder(mine.where(col("v").isNotNull()).select(col("v").alias("value"), "n")).withColumn("dim", F.lit("salary_value"))
    banded = mine.join(F.broadcast(ladder), "dim").select("n", F.coalesce(F.try_element_at(
        F.filter("ladder", lambda b: (col("v") >= b["lo"]) & (b["hi"].isNull() | (col("v") < b["hi"]))), F.lit(1))["label"],
        F.lit("unknown")).alias("value"))
    found = banded.groupBy("value").agg(F.sum("n").alias("count"))
    every = ladder.select(F.posexplode(F.concat(F.array(F.lit("unknown")), F.transform("ladder", lambda b: b["label"]))).alias("p", "value"))
    return every.join(F.broadcast(found), "value", "left").select(
        F.lit("salary_band").alias("dim"), (col("p") + 1).alias("position"), "value",
        F.when(col("value") == "unknown", "no figure published").otherwise(col("value")).alias("label"),
        F.coalesce("count", F.lit(0)).alias("count"), F.lit(False).alias("selected"))


def selected_values(p: dict) -> dict[str, list[str]]:
    return {
        "ats": p["ats"], "metro": p["metros"], "country": p["countries"], "workplace": p["workplace"],
        "seniority": p["seniority"], "employment_type": p["employment_type"], "job_function": p["job_functions"],
        "skill": p["skills"], "company": p["companies"], "company_size": p["company_size"],
        "sector": [*p["sectors"], *p["exclude_sectors"]], "remote_scope": p["remote_scope"], "pay_period": p["pay_period"],
        "currency": p["currencies"], "equity": ["yes"] if p["requires_equity"] else [],
        "salary_source": ["as-stated"] if p["salary_stated_only"] else [], "degree": p["degree"],
        "visa": ["sponsors"] if p["requires_visa_sponsorship"] else [],
    }


def _by_dim(pairs: dict, default) -> Column:
    out = F.lit(default)
    for dim, value in pairs.items():
        out = F.when(col("dim") == dim, value).otherwise(out)
    return out


def finish_facets(counts: DataFrame, p: dict, labels: DataFrame | None = None) -> DataFrame:
    """(dim, position, value, label, count, selected, truncated) ready to show.

    Each dimension keeps its first entries and whatever the search selected
    beyond them. The rank limit is applied in the map tasks, so a dimension with
    millions of companies does not gather in one task. ``labels`` has dim, value, label.
    """
    entries = counts.where(col("dim") != "salary_value")
    bands = entries.sparkSession.createDataFrame([(b, 0) for b, _ in age_bands(p)], "value string, n long")
    entries = entries.unionByName(bands.select(F.lit("age_band").alias("dim"), "value", "n"))
    entries = entries.groupBy("dim", "value").agg(F.sum("n").alias("count"))
    chosen = F.lit(False)
    for dim, values in selected_values(p).items():
        if values:
            chosen = chosen | ((col("dim") == dim) & col("value").isin(values))
    fixed = _by_dim({d: F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(v) for v in o]), col("value")), F.lit(0)), F.lit(1 << 30))
                     for d, o in ORDERS.items()}, 0).cast("long")
    entries = entries.select("dim", "value", "count", chosen.alias("selected"), fixed.alias("_fixed"))
    order = [col("_fixed"), col("count").desc(), col("value")]
    widest = max(FACET_CAPS.values())
    rn = F.row_number().over(Window.partitionBy("dim").orderBy(*order))
    head = entries.withColumn("_rn", rn).where(col("_rn") <= widest).where(col("_rn") <= _by_dim(FACET_CAPS, FACET_CAP)).drop("_rn")
    extra = entries.where("selected").join(head.select("dim", "value"), ["dim", "value"], "left_anti")
    kept = head.unionByName(extra).withColumn("position", F.row_number().over(Window.partitionBy("dim").orderBy(*order)))
    sizes = entries.groupBy("dim").agg(F.count(F.lit(1)).alias("_all"))
    kept = kept.withColumn("_kept", F.count(F.lit(1)).over(Window.partitionBy("dim"))).join(F.broadcast(sizes), "dim")
    static = {("company_size", b[0]): b[1] for b in COMPANY_SIZE_BANDS} | {("sector", k): v for k, v in SECTORS.items()}
    known = F.create_map(*[F.lit(x) for (d, v), label in static.items() for x in (f"{d}|{v}", label)])
    label = F.coalesce(F.try_element_at(known, F.concat_ws("|", "dim", "value")), col("value"))
    if labels is not None:
        kept = kept.join(labels.select("dim", "value", col("label").alias("_label")), ["dim", "value"], "left")
        label = F.coalesce(col("_label"), label)
    return kept.select("dim", "position", "value", label.alias("label"), "count", "selected", (col("_all") - col("_kept")).alias("truncated"))


def facets(screened: DataFrame, p: dict, labels: DataFrame | None = None) -> DataFrame:
    """All finished facets of one screened search in one frame.

    The counts are stored once: finishing reads them several times with
    different filters, and each of those would otherwise be its own scan.
    """
    counts = materialize(facet_counts(screened, p), "facet_counts")
    done = finish_facets(counts, p, labels)
    return done.unionByName(salary_facet(counts).withColumn("truncated", F.lit(0).cast("long")))


def funnel(flagged: DataFrame, p: dict) -> DataFrame:
    """One row of stage counts over the whole corpus, from flags and one pass.

    ``matched`` is before duplicate folding; a row both hidden and applied
    counts once, as hidden.
    """
    passed = col("considered") & col("titled")
    hidden, applied = F.coalesce("hidden", F.lit(False)), F.coalesce("applied", F.lit(False))
    inside, aside = passed & F.coalesce(col("bucket") == "in", F.lit(False)), passed & F.coalesce(col("bucket") == "aside", F.lit(False))
    shown = inside & ~hidden & ~applied
    counts = [
        F.count_if(col("listed")).alias("open_jobs"), F.count_if(col("considered")).alias("considered"),
        F.count_if(passed).alias("passed_title_gate"), F.count_if(shown).alias("matched"),
        F.count_if(aside & ~hidden & ~applied).alias("set_aside"), F.count_if(inside & hidden).alias("hidden"),
        F.count_if(inside & ~hidden & applied).alias("applied"),
    ]
    if not p["collapse_duplicates"]:
        return flagged.agg(*counts).withColumn("folded", F.lit(0).cast("long"))
    # Two levels: counts per (company, title) group first, then the sum over groups.
    groups = flagged.groupBy("company_slug", F.coalesce("title_norm", "title_folded").alias("_t")).agg(*counts)
    names = [c for c in groups.columns if c not in ("company_slug", "_t")]
    return groups.agg(*[F.sum(n).alias(n) for n in names], F.sum(F.greatest(col("matched") - 1, F.lit(0))).alias("folded"))


def company_size_band(open_roles: Column) -> Column:
    out = None
    for value, _, low, high in COMPANY_SIZE_BANDS:
        hit = open_roles >= low if high is None else open_roles.between(low, high)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(COMPANY_SIZE_BANDS[-1][0])


def open_roles(postings: DataFrame, key: str = "company_slug") -> DataFrame:
    """(key, open_roles) over open postings."""
    return postings.where("is_open").groupBy(key).agg(F.count(F.lit(1)).alias("open_roles"))


def top_counts(df: DataFrame, by: str | Column, n: int, name: str = "value") -> DataFrame:
    """The ``n`` most frequent values."""
    value = col(by) if isinstance(by, str) else by
    return df.select(value.alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("jobs")).orderBy(col("jobs").desc(), name).limit(n)


def vocabulary(postings: DataFrame, metros: DataFrame, limit: int = 200) -> dict[str, DataFrame]:
    """What a search may name: boards with open roles, biggest metros, countries seen."""
    return {
        "ats": postings.groupBy(col("ats").alias("value")).agg(F.count_if("is_open").alias("count")).where("count > 0").orderBy(col("count").desc(), "value"),
        "metros": metros.orderBy(col("job_count").desc(), "id").limit(limit).select("id", "label", "country"),
        "countries": postings.where("is_open").select(F.explode("d_countries").alias("code")).where("code != ''").distinct(),
    }


def corpus_meta(postings: DataFrame, companies: DataFrame, metros: DataFrame, events: DataFrame, run_meta: DataFrame,
                top_metros: int = 250, top_skills: int = 200, last_days: int = 60) -> dict[str, DataFrame]:
    """The corpus at a glance, one small frame per heading.

    Postings are read once: each emits what it counts for, and the counts, one
    row per company, skill and source, are stored for the headings to read.
    """
    def mark(kind: str, value: Column | None = None) -> Column:
        return F.struct(F.lit(kind).alias("kind"), (F.lit("") if value is None else value).alias("value"))

    none = F.array().cast("array<struct<kind:string,value:string>>")
    opened = F.array(mark("open"), mark("ats", col("ats")), mark("company", col("company_id")))
    marks = F.concat(
        F.array(mark("jobs")), F.when(col("is_open"), opened).otherwise(none), F.when(col("d_derived_at").isNotNull(), F.array(mark("derived"))).otherwise(none),
        F.transform(F.coalesce("d_skills", F.array().cast("array<string>")), lambda s: mark("skill", s)))
    tally = materialize(postings.select(F.explode(marks).alias("x")).select("x.*").groupBy("kind", "value").agg(F.count(F.lit(1)).alias("jobs")), "tally")

    def counted(kind: str) -> DataFrame:
        return tally.where(col("kind") == kind).select("value", "jobs")

    totals = tally.agg(*[F.coalesce(F.sum(F.when(col("kind") == k, col("jobs"))), F.lit(0)).alias(k) for k in ("jobs", "open", "derived")])
    live = col("status") == "live"
    boards = companies.agg(
        F.count(F.lit(1)).alias("companies"), F.count_if(live).alias("boards_live"),
        F.count_if(live & col("sector").isNotNull()).alias("sectors_read"))
    with_sector = companies.where(col("sector").isNotNull()).join(counted("company"), companies["id"] == col("value")).agg(
        F.coalesce(F.sum("jobs"), F.lit(0)).alias("jobs_with_sector"))
    sweeps = run_meta.where(col("key").startswith("last_sweep_") & (F.expr("try_cast(value AS bigint)") > 0)).groupBy("key").agg(
        F.max_by(F.expr("try_cast(value AS bigint)"), "at").alias("at"))
    return {
        "totals": totals, "boards": boards, "jobs_with_sector": with_sector,
        "metros": metros.orderBy(col("job_count").desc(), "id").limit(top_metros),
        "skills": counted("skill").orderBy(col("jobs").desc(), "value").limit(top_skills),
        "ats": counted("ats").select("value", col("jobs").alias("count")).orderBy(col("count").desc(), "value"),
        "last_sweep_by_ats": sweeps.select(F.substring("key", len("last_sweep_") + 1, 100).alias("ats"), "at"),
        "last_sweep": sweeps.agg(F.min("at").alias("at")),
        "days": events.groupBy("day").agg(F.count(F.lit(1)).alias("n")).orderBy(col("day").desc()).limit(last_days),
    }


def sector_mix(companies: DataFrame, per_company: DataFrame) -> DataFrame:
    """Companies and open jobs per sector over live boards; unread companies stay as NULL."""
    live = companies.where(col("status") == "live").join(
        per_company.withColumnRenamed("company_id", "id"), "id", "left")
    return live.groupBy("sector").agg(F.count(F.lit(1)).alias("companies"), F.sum(F.coalesce("open_roles", F.lit(0))).alias("jobs"))
