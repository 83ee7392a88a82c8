"""Criteria as nullable boolean columns: true = match, false = no, NULL = unknown.

``CRITERIA`` maps each key to (is it asked?, verdict column). Only asked
criteria become columns, and NULL carries "the posting does not say" through
Spark's own three-valued logic; the policy decides what an unknown does.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.gazetteer import DEFAULT as PLACES
from ..functions.text import all_terms, any_term, folded_terms, term_hits
from ..plans.profile import allowed_seniority

col = F.col


def _unknown() -> Column:
    return F.lit(None).cast("boolean")


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _known(c: Column) -> Column:
    """NULL for blank strings, so that ``isin`` answers unknown by itself."""
    return F.nullif(c, F.lit(""))


def listed(p: dict) -> Column:
    return F.coalesce(col("listed"), F.lit(False))


def ats(p: dict) -> Column:
    return F.coalesce(col("ats").isin(p["ats"]), F.lit(False))


def description(p: dict) -> Column:
    """``text_hit``/``text_missing`` come from the text gate; terms with no letter ask nothing."""
    if not searchable(p["description_keywords"]):
        return F.lit(True)
    return F.when(col("text_missing"), _unknown()).otherwise(F.coalesce(col("text_hit"), F.lit(False)))


def searchable(terms) -> list[str]:
    return [t for t in terms if re.search(r"[^\W_]", t)]


def metro(p: dict) -> Column:
    """Place: metros first, countries beside them, and countries alone for far-reaching remote roles."""
    wanted_metros, wanted_countries = p["metros"], p["countries"]
    homes = {PLACES.metros[m][1] for m in wanted_metros} if all(m in PLACES.metros for m in wanted_metros) else set()
    names_country = F.size("countries") > 0
    elsewhere = names_country & ~F.arrays_overlap("countries", _strings(sorted(homes))) if homes else F.lit(False)
    by_country = F.when(names_country, F.arrays_overlap("countries", _strings(wanted_countries))) if wanted_countries else F.lit(False)
    if wanted_metros:
        placeless = by_country if wanted_countries else F.when(elsewhere, False)
        verdict = (
            F.when(F.arrays_overlap("metros", _strings(wanted_metros)), True)
            .when(F.size("metros") == 0, placeless)
            .otherwise(by_country)
        )
    else:
        verdict = by_country
    if p["remote_counts_as_match"]:
        reach = by_country if wanted_countries else ~elsewhere
        verdict = F.when(col("workplace") == "remote", reach).otherwise(verdict)
    return verdict


def workplace(p: dict) -> Column:
    asked = p["workplace"]
    guessed = F.lit(True) if "onsite" in asked else _unknown() if "hybrid" in asked else F.lit(False)
    stated = F.nullif(_known(col("workplace")), F.lit("unknown"))
    return F.when(stated.isNull(), _unknown()).when(col("workplace_guessed"), guessed).otherwise(stated.isin(asked))


def experience(p: dict) -> Column:
    """Band and years must both fit, each only where it is known."""
    lowest, highest = p["min_years_experience"], p["max_years_experience"]
    band = F.nullif(_known(col("seniority")), F.lit("unknown"))
    years = F.when(col("years_known"), col("min_years"))
    fits = F.coalesce(band.isin(allowed_seniority(p)), F.lit(True))
    if highest is not None:
        fits = fits & F.coalesce(years <= highest, F.lit(True))
    if lowest is not None:
        fits = fits & F.coalesce(F.when(years.isNotNull(), F.coalesce("max_years", years)) >= lowest, F.lit(True))
    return F.when(band.isNotNull() | years.isNotNull(), fits)


def salary(p: dict) -> Column:
    """Ranges overlap: top reaches the floor asked for, bottom stays under the ceiling."""
    top, bottom = F.coalesce("salary_max", "salary_min"), F.coalesce("salary_min", "salary_max")
    fits = F.lit(True)
    if p["salary_min"] is not None:
        fits = fits & F.coalesce(top >= p["salary_min"], F.lit(False))
    if p["salary_max"] is not None:
        fits = fits & F.coalesce(bottom <= p["salary_max"], F.lit(False))
    return F.when(col("salary_known"), fits)


def employment_type(p: dict) -> Column:
    return _known(col("employment_type")).isin(p["employment_type"])


def posted(p: dict) -> Column:
    return col("age_days") <= p["posted_within_days"]


def job_function(p: dict) -> Column:
    named = _known(col("job_function"))
    return F.when(named.isin(p["job_functions"]), True).when(named != "other", False)


def skills(p: dict) -> Column:
    wanted = list(dict.fromkeys(p["skills"]))
    if not wanted:
        verdict = F.lit(True)
    elif p["skills_match"] == "all":
        verdict = F.when(F.size("skills") > 0, F.size(F.array_intersect("skills", _strings(wanted))) == len(wanted))
    else:
        verdict = F.when(F.size("skills") > 0, F.arrays_overlap("skills", _strings(wanted)))
    if p["exclude_skills"]:
        verdict = F.when(F.arrays_overlap("skills", _strings(p["exclude_skills"])), False).otherwise(verdict)
    return verdict


def company(p: dict) -> Column:
    names = [c.lower() for c in p["companies"]]
    by_slug, by_name = F.lower("company_slug").isin(names), F.lower("company_name").isin(names)
    return F.coalesce(by_slug, F.lit(False)) | F.coalesce(by_name, F.lit(False))


def company_size(p: dict) -> Column:
    return F.coalesce(col("company_size").isin(p["company_size"]), F.lit(False))


def sector(p: dict) -> Column:
    named = F.nullif(_known(col("sector")), F.lit("other"))
    verdict = F.lit(True)
    if p["sectors"]:
        verdict = F.when(col("sector").isin(p["sectors"]), True).when(named.isNotNull(), False)
    if p["exclude_sectors"]:
        verdict = F.when(named.isin(p["exclude_sectors"]), False).otherwise(verdict)
    return verdict


def remote_scope(p: dict) -> Column:
    office = F.nullif(_known(col("workplace")), F.lit("unknown")) != "remote"
    stated = _known(col("remote_scope"))
    return F.when(stated.isNotNull(), stated.isin(p["remote_scope"])).when(office, False)


def pay_period(p: dict) -> Column:
    return _known(col("pay_period")).isin(p["pay_period"])


def currency(p: dict) -> Column:
    return _known(col("currency")).isin(p["currencies"])


def equity(p: dict) -> Column:
    return F.when(col("equity"), True)


def salary_source(p: dict) -> Column:
    return F.when(col("salary_known"), F.coalesce(col("salary_src") == "as-stated", F.lit(False)))


def visa(p: dict) -> Column:
    if p["requires_visa_sponsorship"]:
        return col("visa")
    return F.coalesce(col("visa"), F.lit(True))


def clearance(p: dict) -> Column:
    return ~F.coalesce(col("clearance"), F.lit(False))


def degree(p: dict) -> Column:
    return _known(col("degree")).isin(p["degree"])


# In the order criteria are asked; key -> (asked?, verdict).
CRITERIA: dict[str, tuple[Callable[[dict], bool], Callable[[dict], Column]]] = {
    "listed": (lambda p: not p["include_unlisted"], listed),
    "ats": (lambda p: bool(p["ats"]), ats),
    "description": (lambda p: bool(p["description_keywords"]), description),
    "metro": (lambda p: bool(p["metros"] or p["countries"]), metro),
    "workplace": (lambda p: bool(p["workplace"]), workplace),
    "experience": (lambda p: allowed_seniority(p) is not None, experience),
    "salary": (lambda p: p["salary_min"] is not None or p["salary_max"] is not None, salary),
    "employment_type": (lambda p: bool(p["employment_type"]), employment_type),
    "posted": (lambda p: p["posted_within_days"] is not None, posted),
    "job_function": (lambda p: bool(p["job_functions"]), job_function),
    "skills": (lambda p: bool(p["skills"] or p["exclude_skills"]), skills),
    "company": (lambda p: bool(p["companies"]), company),
    "company_size": (lambda p: bool(p["company_size"]), company_size),
    "sector": (lambda p: bool(p["sectors"] or p["exclude_sectors"]), sector),
    "remote_scope": (lambda p: bool(p["remote_scope"]), remote_scope),
    "pay_period": (lambda p: bool(p["pay_period"]), pay_period),
    "currency": (lambda p: bool(p["currencies"]), currency),
    "equity": (lambda p: p["requires_equity"], equity),
    "salary_source": (lambda p: p["salary_stated_only"], salary_source),
    "visa": (lambda p: p["requires_visa_sponsorship"] is True or p["exclude_visa_refusal"], visa),
    "clearance": (lambda p: p["exclude_clearance"], clearance),
    "degree": (lambda p: bool(p["degree"]), degree),
}


def verdicts(p: dict) -> dict[str, Column]:
    """One nullable boolean per criterion the profile asks."""
    return {key: verdict(p) for key, (asked, verdict) in CRITERIA.items() if asked(p)}


def title_gate(p: dict, folded_title: Column | None = None) -> Column:
    """Binary: no excluded term, and any (or all) of the wanted ones."""
    title = col("title_folded") if folded_title is None else folded_title
    keep = F.lit(True)
    if folded_terms(p["exclude_title_keywords"]):
        keep = keep & ~any_term(title, p["exclude_title_keywords"])
    if folded_terms(p["title_keywords"]):
        matcher = all_terms if p["title_match"] == "all" else any_term
        keep = keep & matcher(title, p["title_keywords"])
    return keep


def _keys(pairs) -> Column:
    """Array of the keys whose condition holds."""
    pairs = [F.when(cond, F.lit(key)) for key, cond in pairs]
    if not pairs:
        return F.array().cast("array<string>")
    return F.filter(F.array(*pairs), lambda k: k.isNotNull())


def screen(df: DataFrame, p: dict) -> DataFrame:
    """Add title_hits, failed, unknown_on and bucket (in / aside / NULL = out).

    ``failed`` lists every criterion that rules the row out; facets use rows
    with at most one.
    """
    policy = {key: p["unknowns"].get(key, "include") for key in CRITERIA}
    named = {f"_v_{key}": v for key, v in verdicts(p).items()}
    df = df.withColumns(named) if named else df
    asked = [(name[3:], F.col(name)) for name in named]
    failed = _keys((k, ~F.coalesce(v, F.lit(policy[k] != "exclude"))) for k, v in asked)
    unknown = _keys((k, v.isNull()) for k, v in asked if policy[k] != "exclude")
    aside = F.lit(False)
    for k, v in asked:
        if policy[k] == "separate":
            aside = aside | v.isNull()
    df = df.withColumns({
        "title_hits": term_hits(col("title_folded"), p["title_keywords"]), "failed": failed, "unknown_on": unknown, "_aside": aside})
    df = df.withColumn("bucket", F.when(F.size("failed") == 0, F.when(col("_aside"), "aside").otherwise("in")))
    return df.drop(*named, "_aside")


def keep_bucket(df: DataFrame, p: dict, bucket: str) -> DataFrame:
    """Only the rows of one bucket (in or aside), with title_hits and unknown_on.

    The same rows ``screen`` would mark, but written as one condition per
    criterion, so each is pushed towards the scan by itself.
    """
    policy = {key: p["unknowns"].get(key, "include") for key in CRITERIA}
    asked = verdicts(p)
    for key, v in asked.items():
        df = df.where(F.coalesce(v, F.lit(policy[key] != "exclude")))
    silent = [v.isNull() for key, v in asked.items() if policy[key] == "separate"]
    if bucket == "in":
        for s in silent:
            df = df.where(~s)
    else:
        any_silent = F.lit(False)
        for s in silent:
            any_silent = any_silent | s
        df = df.where(any_silent)
    unknown = _keys((k, v.isNull()) for k, v in asked.items() if policy[k] != "exclude")
    return df.withColumns({"title_hits": term_hits(col("title_folded"), p["title_keywords"]), "unknown_on": unknown})


def classify(p: dict) -> Column:
    """in / aside / out straight from the verdicts, without the failed list."""
    out, aside = F.lit(False), F.lit(False)
    for key, v in verdicts(p).items():
        policy = p["unknowns"].get(key, "include")
        out = out | ~F.coalesce(v, F.lit(policy != "exclude"))
        if policy == "separate":
            aside = aside | v.isNull()
    return F.when(out, "out").when(aside, "aside").otherwise("in")


def unknown_shares(df: DataFrame, profiles: dict[str, dict]) -> DataFrame:
    """(criterion, unknown, rows): how often each criterion answers unknown when it alone is active.

    ``profiles`` maps a criterion key to a profile that asks it. One scan, one row per task shuffled.
    """
    counts = [F.count_if(CRITERIA[key][1](p).isNull()).alias(key) for key, p in profiles.items()]
    wide = df.agg(F.count(F.lit(1)).alias("rows"), *counts)
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("criterion"), col(k).alias("unknown")) for k in profiles])).alias("x")
    return wide.select("rows", pairs).select("x.criterion", "x.unknown", "rows")
