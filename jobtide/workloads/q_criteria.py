"""Criteria, policies, screening: registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import criteria
from ..plans.profile import normalize_profile
from . import views
from .registry import query

P = views.posting_sql()
# key -> (profile, SQL verdict: true / false / NULL). Written from the rules, not from the Spark code.
CASES: dict[str, tuple[str, dict, str]] = {
    "listed": ("listed", {}, "listed"),
    "ats": ("ats", {"ats": ["ashby", "lever"]}, "ats IN ('ashby', 'lever')"),
    "metro": ("metro", {"metros": ["nyc", "london"]},
              "CASE WHEN list_has_any(metros, ['nyc', 'london']) THEN true WHEN len(metros) > 0 THEN false "
              "WHEN len(countries) > 0 AND NOT list_has_any(countries, ['us', 'gb']) THEN false END"),
    "metro_unlisted": ("metro", {"metros": ["nyc", "nowhere-town"]},
                       "CASE WHEN list_has_any(metros, ['nyc', 'nowhere-town']) THEN true WHEN len(metros) > 0 THEN false END"),
    "metro_remote": ("metro", {"metros": ["nyc"], "remote_counts_as_match": True},
                     "CASE WHEN workplace = 'remote' THEN NOT (len(countries) > 0 AND NOT list_has_any(countries, ['us'])) "
                     "WHEN list_has_any(metros, ['nyc']) THEN true WHEN len(metros) > 0 THEN false "
                     "WHEN len(countries) > 0 AND NOT list_has_any(countries, ['us']) THEN false END"),
    "country": ("metro", {"countries": ["us", "de"]}, "CASE WHEN len(countries) > 0 THEN list_has_any(countries, ['us', 'de']) END"),
    "metro_country_remote": ("metro", {"metros": ["paris"], "countries": ["us"], "remote_counts_as_match": True},
                             "CASE WHEN workplace = 'remote' OR NOT list_has_any(metros, ['paris']) "
                             "THEN CASE WHEN len(countries) > 0 THEN list_has_any(countries, ['us']) END ELSE true END"),
    "workplace_onsite": ("workplace", {"workplace": ["onsite"]},
                         "CASE WHEN workplace = 'unknown' THEN NULL ELSE workplace = 'onsite' END"),
    "workplace_hybrid": ("workplace", {"workplace": ["hybrid", "remote"]},
                         "CASE WHEN workplace = 'unknown' OR workplace_guessed THEN NULL ELSE workplace IN ('hybrid', 'remote') END"),
    "workplace_remote": ("workplace", {"workplace": ["remote"]},
                         "CASE WHEN workplace = 'unknown' THEN NULL WHEN workplace_guessed THEN false ELSE workplace = 'remote' END"),
    "experience": ("experience", {"max_years_experience": 3},
                   "CASE WHEN seniority = 'unknown' AND NOT years_known THEN NULL "
                   "WHEN seniority NOT IN ('unknown', 'entry', 'junior', 'mid') THEN false WHEN years_known AND min_years > 3 THEN false ELSE true END"),
    "experience_floor": ("experience", {"min_years_experience": 4, "include_intern": True},
                         "CASE WHEN seniority = 'unknown' AND NOT years_known THEN NULL "
                         "WHEN seniority NOT IN ('unknown', 'mid', 'senior', 'manager') THEN false "
                         "WHEN years_known AND coalesce(max_years, min_years) < 4 THEN false ELSE true END"),
    "experience_bands": ("experience", {"seniority": ["senior", "intern"]},
                         "CASE WHEN seniority = 'unknown' AND NOT years_known THEN NULL ELSE seniority IN ('unknown', 'senior', 'intern') END"),
    "salary": ("salary", {"salary_min": 80000, "salary_max": 160000},
               "CASE WHEN salary_known THEN coalesce(salary_max, salary_min) >= 80000 AND coalesce(salary_min, salary_max) <= 160000 END"),
    "employment_type": ("employment_type", {"employment_type": ["FullTime"]}, "employment_type = 'FullTime'"),
    "posted": ("posted", {"posted_within_days": 30}, "age_days <= 30"),
    "job_function": ("job_function", {"job_functions": ["data", "sales"]},
                     "CASE WHEN job_function IN ('data', 'sales') THEN true WHEN job_function <> 'other' THEN false END"),
    "skills_any": ("skills", {"skills": ["spark", "excel"]}, "CASE WHEN len(skills) > 0 THEN list_has_any(skills, ['spark', 'excel']) END"),
    "skills_all_excluding": ("skills", {"skills": ["python", "sql"], "skills_match": "all", "exclude_skills": ["spark"]},
                             "CASE WHEN list_contains(skills, 'spark') THEN false WHEN len(skills) > 0 THEN list_has_all(skills, ['python', 'sql']) END"),
    "company": ("company", {"companies": ["SRC1", "company src2"]}, "lower(company_slug) = 'src1' OR coalesce(lower(company_name) = 'company src2', false)"),
    "visa": ("visa", {"requires_visa_sponsorship": True}, "visa"),
    "visa_refusal": ("visa", {"exclude_visa_refusal": True}, "visa IS NULL OR visa"),
    "clearance": ("clearance", {"exclude_clearance": True}, "clearance IS NULL"),
    "degree": ("degree", {"degree": ["none", "bachelors"]}, "degree IN ('none', 'bachelors')"),
    "remote_scope": ("remote_scope", {"remote_scope": ["worldwide"]},
                     "CASE WHEN remote_scope IS NOT NULL THEN remote_scope = 'worldwide' WHEN workplace IN ('onsite', 'hybrid') THEN false END"),
    "pay_period": ("pay_period", {"pay_period": ["hour"]}, "pay_period = 'HOUR'"),
    "currency": ("currency", {"currencies": ["usd", "GBP"]}, "currency IN ('USD', 'GBP')"),
    "equity": ("equity", {"requires_equity": True}, "CASE WHEN equity THEN true END"),
    "salary_source": ("salary_source", {"salary_stated_only": True}, "CASE WHEN salary_known THEN salary_src = 'as-stated' END"),
    "company_size": ("company_size", {"company_size": ["21-100", "6-20"]}, "company_size IN ('21-100', '6-20')"),
    "sector": ("sector", {"sectors": ["ai"], "exclude_sectors": ["gaming"]},
               "CASE WHEN sector = 'gaming' THEN false WHEN sector = 'ai' THEN true WHEN sector IS NULL OR sector = 'other' THEN NULL ELSE false END"),
    "sector_excluded": ("sector", {"exclude_sectors": ["gaming", "fintech"]}, "coalesce(sector NOT IN ('gaming', 'fintech'), true)"),
}
WORD = "CASE WHEN {v} IS NULL THEN 'unknown' WHEN {v} THEN 'match' ELSE 'no' END"


def _register_verdict(name: str, key: str, raw: dict, sql: str) -> None:
    def run(spark, sf_dir):
        p, _ = normalize_profile(raw)
        verdict = criteria.CRITERIA[key][1](p)
        word = F.when(verdict.isNull(), "unknown").when(verdict, "match").otherwise("no")
        return views.postings(spark, sf_dir).select("id", word.alias("verdict"))

    query(f"verdict_{name}", f"{P} SELECT id, {WORD.format(v='(' + sql + ')')} AS verdict FROM p")(run)


for _name, (_key, _raw, _sql) in CASES.items():
    _register_verdict(_name, _key, _raw, _sql)

# A search that asks many things at once. key order is the order criteria are asked.
MANY = {
    "metros": ["nyc", "london"], "workplace": ["hybrid", "remote"], "max_years_experience": 3, "salary_min": 80000,
    "salary_max": 160000, "employment_type": ["FullTime"], "posted_within_days": 180, "skills": ["spark", "excel"],
    "exclude_title_keywords": ["sont"],
}
MANY_SQL = {
    "listed": CASES["listed"][2], "metro": CASES["metro"][2], "workplace": CASES["workplace_hybrid"][2], "experience": CASES["experience"][2],
    "salary": CASES["salary"][2], "employment_type": CASES["employment_type"][2], "posted": "age_days <= 180", "skills": CASES["skills_any"][2],
}
FEW = {"workplace": ["hybrid", "remote"], "salary_min": 80000, "salary_max": 160000, "requires_visa_sponsorship": True, "job_functions": ["data", "sales"]}
FEW_SQL = {
    "listed": CASES["listed"][2], "workplace": CASES["workplace_hybrid"][2], "salary": CASES["salary"][2],
    "job_function": CASES["job_function"][2], "visa": CASES["visa"][2],
}


def screen_sql(verdicts: dict[str, str], unknowns: dict[str, str], where: str = "true", base: str = "p") -> str:
    """CTE ``s``: rows of ``base`` with failed and unknown keys and the bucket, from SQL verdicts."""
    wrote = ", ".join(f"({v}) AS v_{k}" for k, v in verdicts.items())
    failed = ", ".join(f"CASE WHEN {'v_' + k + ' IS NULL OR ' if unknowns.get(k) == 'exclude' else ''}v_{k} = false THEN '{k}' END" for k in verdicts)
    unknown = ", ".join(f"CASE WHEN v_{k} IS NULL THEN '{k}' END" for k in verdicts if unknowns.get(k) != "exclude")
    aside = " OR ".join(f"v_{k} IS NULL" for k in verdicts if unknowns.get(k) == "separate") or "false"
    return (
        f"v AS (SELECT *, {wrote} FROM {base} WHERE {where}), "
        f"w AS (SELECT *, list_filter([{failed}], lambda x: x IS NOT NULL) AS failed, list_filter([{unknown}], lambda x: x IS NOT NULL) AS unknown_on, "
        f"({aside}) AS any_aside FROM v), "
        "s AS (SELECT *, CASE WHEN len(failed) > 0 THEN 'out' WHEN any_aside THEN 'aside' ELSE 'in' END AS bucket FROM w)"
    )


def _screen(raw: dict, policies: dict):
    def run(spark, sf_dir):
        p, _ = normalize_profile({**raw, "unknowns": policies})
        df = views.postings(spark, sf_dir).where(criteria.title_gate(p))
        out = criteria.screen(df, p)
        return out.select(
            "id", F.coalesce("bucket", F.lit("out")).alias("bucket"), F.size("failed").alias("failures"),
            F.array_join("failed", ",").alias("failed"), F.array_join("unknown_on", ",").alias("unknown_on"))

    return run


SHOW = "SELECT id, bucket, len(failed) AS failures, array_to_string(failed, ',') AS failed, array_to_string(unknown_on, ',') AS unknown_on FROM s"
NO_SONT = "NOT regexp_matches(title_folded, '(^|[^a-z0-9])sont($|[^a-z0-9])')"
query("screen_three_valued", f"{P}, {screen_sql(MANY_SQL, {}, NO_SONT)} {SHOW}")(_screen(MANY, {}))
EXCLUDE = {"salary": "exclude", "visa": "exclude"}
query("screen_exclude_unknown", f"{P}, {screen_sql(FEW_SQL, EXCLUDE)} {SHOW}")(_screen(FEW, EXCLUDE))
SEPARATE = {"workplace": "separate", "job_function": "separate"}
query("screen_separate", f"{P}, {screen_sql(FEW_SQL, SEPARATE)} {SHOW}")(_screen(FEW, SEPARATE))


@query("classify_agrees", f"{P}, {screen_sql(FEW_SQL, {**SEPARATE, 'visa': 'exclude'})} SELECT id, bucket FROM s")
def classify_agrees(spark, sf_dir):
    p, _ = normalize_profile({**FEW, "unknowns": {**SEPARATE, "visa": "exclude"}})
    return views.postings(spark, sf_dir).select("id", criteria.classify(p).alias("bucket"))


SHARES = {"metro": "metro", "workplace": "workplace_hybrid", "experience": "experience", "salary": "salary", "employment_type": "employment_type",
          "posted": "posted", "job_function": "job_function", "visa": "visa", "degree": "degree", "sector": "sector", "equity": "equity",
          "currency": "currency", "pay_period": "pay_period", "remote_scope": "remote_scope", "salary_source": "salary_source", "skills": "skills_any"}
query("unknown_shares", P + " " + " UNION ALL ".join(
    f"SELECT '{k}' AS criterion, count(*) FILTER (WHERE ({CASES[c][2]}) IS NULL) AS unknown, count(*) AS rows FROM p" for k, c in SHARES.items()))(
    lambda spark, sf_dir: criteria.unknown_shares(
        views.postings(spark, sf_dir), {k: normalize_profile(CASES[c][1])[0] for k, c in SHARES.items()}))

EDGE = "regexp_matches(title_folded, '(^|[^a-z0-9]){}($|[^a-z0-9])')"


@query("title_gate_any", f"{P} SELECT id FROM p WHERE ({EDGE.format('the')} OR {EDGE.format('la')}) AND NOT {EDGE.format('of')}")
def title_gate_any(spark, sf_dir):
    p, _ = normalize_profile({"title_keywords": ["The", "là"], "exclude_title_keywords": ["OF"]})
    return views.postings(spark, sf_dir).where(criteria.title_gate(p)).select("id")


@query("title_gate_all", f"{P} SELECT id FROM p WHERE {EDGE.format('the')} AND {EDGE.format('and')}")
def title_gate_all(spark, sf_dir):
    p, _ = normalize_profile({"title_keywords": ["the", "and"], "title_match": "all"})
    return views.postings(spark, sf_dir).where(criteria.title_gate(p)).select("id")
