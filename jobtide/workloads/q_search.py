"""Facets, funnel, ranking and whole searches: registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import criteria, facets, rank
from ..plans.profile import normalize_profile
from ..plans.search import search
from ..session import materialize
from . import views
from .q_criteria import FEW, FEW_SQL, MANY, MANY_SQL, NO_SONT, SEPARATE, SHOW, screen_sql  # noqa: F401
from .registry import query

P = views.posting_sql()
FACETED = {**FEW, "unknowns": SEPARATE, "metros": ["nyc"], "posted_within_days": 200}
FACETED_SQL = {
    "listed": "listed",
    "metro": "CASE WHEN list_has_any(metros, ['nyc']) THEN true WHEN len(metros) > 0 THEN false "
             "WHEN len(countries) > 0 AND NOT list_has_any(countries, ['us']) THEN false END",
    "workplace": FEW_SQL["workplace"], "salary": FEW_SQL["salary"], "posted": "age_days <= 200",
    "job_function": FEW_SQL["job_function"], "visa": FEW_SQL["visa"],
}


def _screened(spark, sf_dir, raw):
    p, _ = normalize_profile(raw)
    return criteria.screen(views.postings(spark, sf_dir), p), p


def _stored_counts(spark, sf_dir):
    screened, p = _screened(spark, sf_dir, FACETED)
    return materialize(facets.facet_counts(screened, p), "facet_counts"), p


def _dims_sql(days: int) -> str:
    """(dim, criterion, value) rows per posting, from ``s``."""
    top = "CASE WHEN salary_known THEN coalesce(salary_max, salary_min) END"
    scalar = {
        "ats": ("ats", "ats"), "workplace": ("workplace", "workplace"), "seniority": ("experience", "seniority"),
        "employment_type": ("employment_type", "employment_type"), "job_function": ("job_function", "coalesce(job_function, 'other')"),
        "salary_value": ("salary", f"coalesce(CAST({top} AS VARCHAR), 'unknown')"), "company_size": ("company_size", "company_size"),
        "sector": ("sector", "sector"), "remote_scope": ("remote_scope", "remote_scope"), "pay_period": ("pay_period", "pay_period"),
        "degree": ("degree", "degree"), "visa": ("visa", "CASE WHEN visa THEN 'sponsors' WHEN NOT visa THEN 'will not sponsor' END"),
        "clearance": ("clearance", "CASE WHEN clearance THEN 'requires clearance' END"), "currency": ("currency", "currency"),
        "equity": ("equity", "CASE WHEN equity THEN 'yes' ELSE 'not stated' END"),
        "salary_source": ("salary_source", "CASE WHEN NOT salary_known THEN 'not published' WHEN salary_src = 'as-stated' THEN 'as-stated' ELSE 'reinterpreted' END"),
        "company": ("", "coalesce(company_name, company_slug)"),
    }
    lists = {
        "metro": ("metro", "metros"), "country": ("metro", "countries"), "skill": ("", "skills"),
        "age_band": ("posted", "CASE WHEN age_days IS NULL THEN ['unknown'] ELSE list_filter([" + ", ".join(
            f"CASE WHEN age_days <= {limit} THEN '{label}' END" for label, limit in
            (("≤7 days", 7), ("≤30 days", 30), ("≤90 days", 90), ("≤180 days", 180), ("any age", 1 << 30), (f"≤{days} days", days)))
            + "], lambda x: x IS NOT NULL) END"),
    }
    parts = [f"SELECT id, failed, '{d}' AS dim, '{c}' AS crit, CAST({v} AS VARCHAR) AS value FROM s" for d, (c, v) in scalar.items()]
    parts += [f"SELECT id, failed, '{d}' AS dim, '{c}' AS crit, unnest({v}) AS value FROM s" for d, (c, v) in lists.items()]
    return " UNION ALL ".join(parts)


SCREENED = f"{P}, {screen_sql(FACETED_SQL, SEPARATE)}"
COUNTS = (
    f"{SCREENED}, d AS ({_dims_sql(200)}), "
    "c AS (SELECT dim, value, count(*) AS n FROM d WHERE value IS NOT NULL AND (len(failed) = 0 OR (len(failed) = 1 AND failed[1] = crit)) GROUP BY dim, value)"
)


@query("facets_leave_one_out", f"{COUNTS} SELECT dim, value, n FROM c")
def facets_leave_one_out(spark, sf_dir):
    return facets.facet_counts(*_screened(spark, sf_dir, FACETED))


@query("facets_whole",
       f"{COUNTS}, x AS (SELECT dim, CAST(sum(n) AS BIGINT) AS total FROM c WHERE dim NOT IN ('company', 'salary_value') GROUP BY dim) SELECT * FROM x UNION ALL SELECT 'salary_band', CAST(sum(n) AS BIGINT) FROM c WHERE dim = 'salary_value'")
def facets_whole(spark, sf_dir):
    """All facets of a search at once: what each dimension adds up to."""
    found = search(views.postings(spark, sf_dir), FACETED)
    return found.facets.where("dim <> 'company'").groupBy("dim").agg(F.sum("count").alias("total"))


@query("facet_age_cumulative",
       f"{COUNTS}, bands AS (SELECT unnest(['≤7 days','≤30 days','≤90 days','≤180 days','any age','≤200 days','unknown']) AS value) "
       "SELECT value, coalesce(n, 0) AS n FROM bands LEFT JOIN (SELECT * FROM c WHERE dim = 'age_band') USING (value) WHERE value <> 'unknown' OR n IS NOT NULL")
def facet_age_cumulative(spark, sf_dir):
    done = facets.finish_facets(*_stored_counts(spark, sf_dir))
    return done.where("dim = 'age_band'").select("value", F.col("count").alias("n"))


# Cuts are values at sorted position floor(q * (n - 1)), then rounded and deduplicated.
NICE = ("CASE WHEN x < 20000 THEN round(x / 1000.0) * 1000 WHEN x < 100000 THEN round(x / 5000.0) * 5000 "
        "WHEN x < 500000 THEN round(x / 10000.0) * 10000 ELSE round(x / 50000.0) * 50000 END")
MONEY = "CASE WHEN {0} >= 1000000 THEN '$' || printf('%.1f', {0} / 1000000.0) || 'm' ELSE '$' || CAST(CAST(round({0} / 1000.0) AS BIGINT) AS VARCHAR) || 'k' END"


def ladder_sql(values: str) -> str:
    """CTE ``ladder`` (pos, label, lo, hi) for the CTE named ``values`` with column v."""
    return (
        f"sorted AS (SELECT list(v ORDER BY v) AS vs FROM {values} WHERE v IS NOT NULL), "
        "raw AS (SELECT unnest([1,2,3,4]) AS i, unnest([0.2,0.4,0.6,0.8]) AS q), "
        "picked AS (SELECT i, vs[CAST(floor(q * (len(vs) - 1)) AS BIGINT) + 1] AS x, len(vs) AS n FROM raw, sorted), "
        f"cuts AS (SELECT row_number() OVER (ORDER BY c) AS k, c FROM (SELECT DISTINCT CAST({NICE} AS BIGINT) AS c FROM picked) WHERE c > 0), "
        "fits AS (SELECT (SELECT count(*) FROM cuts) >= 2 AND (SELECT coalesce(max(n), 0) FROM picked) >= 40 AS ok), "
        f"own AS (SELECT k AS pos, CASE WHEN k = 1 THEN 'under ' || {MONEY.format('c')} ELSE {MONEY.format('prev')} || '–' || {MONEY.format('c')} END AS label, "
        "coalesce(prev, 0) AS lo, c AS hi FROM (SELECT k, c, lag(c) OVER (ORDER BY k) AS prev FROM cuts) "
        f"UNION ALL SELECT max(k) + 1, {MONEY.format('max(c)')} || '+', max(c), NULL FROM cuts), "
        "std AS (SELECT * FROM (VALUES (1,'<$80k',0,80000),(2,'$80–120k',80000,120000),(3,'$120–160k',120000,160000),(4,'$160–200k',160000,200000),"
        "(5,'$200k+',200000,NULL)) t(pos,label,lo,hi)), "
        "ladder AS (SELECT own.* FROM own, fits WHERE ok UNION ALL SELECT std.* FROM std, fits WHERE NOT ok)"
    )


@query("facet_salary_ladder",
       f"{SCREENED}, vals AS (SELECT CASE WHEN salary_known THEN coalesce(salary_max, salary_min) END AS v FROM s WHERE len(failed) = 0 OR (len(failed) = 1 AND failed[1] = 'salary')), "
       f"{ladder_sql('vals')}, banded AS (SELECT coalesce(label, 'unknown') AS value FROM vals LEFT JOIN ladder ON v >= lo AND (hi IS NULL OR v < hi)), "
       "every AS (SELECT 0 AS pos, 'unknown' AS value UNION ALL SELECT pos, label FROM ladder) "
       "SELECT pos + 1 AS position, every.value, count(banded.value) AS n FROM every LEFT JOIN banded ON every.value = banded.value GROUP BY ALL")
def facet_salary_ladder(spark, sf_dir):
    return facets.salary_facet(_stored_counts(spark, sf_dir)[0]).select("position", "value", F.col("count").alias("n"))


OFFER_TOP = "CAST(floor(l_extendedprice * 3 + 20000) AS BIGINT)"


@query("salary_ladder_offers", f"WITH offers AS (SELECT {OFFER_TOP} AS v FROM lineitem), {ladder_sql('offers')} SELECT pos AS position, label, lo, hi FROM ladder")
def salary_ladder_offers(spark, sf_dir):
    hist = views.table(spark, sf_dir, "lineitem").select(F.expr(OFFER_TOP).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    bands = facets.salary_ladder(hist).select(F.posexplode("ladder").alias("p", "b"))
    return bands.select((F.col("p") + 1).alias("position"), "b.label", "b.lo", "b.hi")


ORDERED = {
    "ats": ["ashby", "greenhouse", "lever", "workday"], "company_size": ["1", "2-5", "6-20", "21-100", "101-500", "500+"],
    "remote_scope": ["worldwide", "country", "region", "timezone"],
    "pay_period": ["YEAR", "HALF_YEAR", "MONTH", "SEMI_MONTH", "BIWEEK", "WEEK", "DAY", "HOUR", "NONE"],
    "degree": ["none", "bachelors", "masters", "phd"], "visa": ["sponsors", "will not sponsor"], "equity": ["yes", "not stated"],
    "salary_source": ["as-stated", "reinterpreted", "not published"],
}
PLACE = "CASE dim " + " ".join(f"WHEN '{d}' THEN list_position({o!r}, value)" for d, o in ORDERED.items()) + " ELSE 0 END"
ZEROES = "SELECT 'age_band' AS dim, unnest(['≤7 days','≤30 days','≤90 days','≤180 days','any age','≤200 days']) AS value, 0 AS n"


@query("facets_finished",
       f"{COUNTS}, e AS (SELECT dim, value, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM c UNION ALL {ZEROES}) WHERE dim <> 'salary_value' GROUP BY ALL), "
       f"r AS (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY {PLACE}, n DESC, value) AS position, count(*) OVER (PARTITION BY dim) AS all_n FROM e) "
       "SELECT dim, position, value, n, all_n - least(all_n, CASE dim WHEN 'metro' THEN 250 WHEN 'country' THEN 250 WHEN 'company' THEN 60 WHEN 'skill' THEN 60 ELSE 40 END) AS truncated, "
       "CASE WHEN dim IN ('metro') AND value = 'nyc' OR dim = 'workplace' AND value IN ('hybrid','remote') OR dim = 'job_function' AND value IN ('data','sales') "
       "OR dim = 'visa' AND value = 'sponsors' THEN 1 ELSE 0 END AS selected FROM r "
       "WHERE position <= CASE dim WHEN 'metro' THEN 250 WHEN 'country' THEN 250 WHEN 'company' THEN 60 WHEN 'skill' THEN 60 ELSE 40 END")
def facets_finished(spark, sf_dir):
    done = facets.finish_facets(*_stored_counts(spark, sf_dir))
    return done.select("dim", "position", "value", F.col("count").alias("n"), "truncated", F.col("selected").cast("int").alias("selected"))


CAP_SELECTED = ["Customer#000000003", "Customer#000000007"]


@query("facet_capped",
       "WITH c AS (SELECT c_name AS value, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1), "
       "r AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS rn, count(*) OVER () AS all_n FROM c), "
       f"k AS (SELECT * FROM r WHERE rn <= 60 OR value IN ({', '.join(repr(v) for v in CAP_SELECTED)})) "
       "SELECT 'company' AS dim, value, n, row_number() OVER (ORDER BY rn) AS position, all_n - count(*) OVER () AS truncated FROM k")
def facet_capped(spark, sf_dir):
    """A dimension with as many values as there are customers: first 60 and the selected ones."""
    p, _ = normalize_profile({"companies": CAP_SELECTED})
    c = views.table(spark, sf_dir, "customer").join(views.table(spark, sf_dir, "orders"), F.expr("o_custkey = c_custkey"))
    counts = c.groupBy(F.lit("company").alias("dim"), F.col("c_name").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return facets.finish_facets(materialize(counts, "facet_counts"), p).where("dim = 'company'").select("dim", "value", F.col("count").alias("n"), "position", "truncated")


def _flagged(spark, sf_dir, raw):
    """Every posting with gates, verdicts and marks; marks are two slices of the postings themselves."""
    view = views.postings(spark, sf_dir)
    hidden, applied = view.where("doc_id % 19 = 0").select("id"), view.where("doc_id % 23 = 0 OR doc_id % 38 = 0").select("id")
    restrict = view.where("doc_id % 3 <> 1").select("id")
    return search(view, raw, restrict_to=restrict, hidden=hidden, applied=applied)


FUNNEL = {**FEW, "unknowns": SEPARATE, "exclude_title_keywords": ["sont"]}
FLAGS = (
    f"{P}, {screen_sql(FEW_SQL, SEPARATE)}, f AS (SELECT *, doc_id % 3 <> 1 AS considered, ({NO_SONT}) AS titled, doc_id % 19 = 0 AS hidden, "
    "(doc_id % 23 = 0 OR doc_id % 38 = 0) AS applied FROM s)"
)
MATCHED = "considered AND titled AND bucket = 'in' AND NOT hidden AND NOT applied"
FUNNEL_COLUMNS = (
    "count(*) FILTER (WHERE listed) AS open_jobs, count(*) FILTER (WHERE considered) AS considered, "
    "count(*) FILTER (WHERE considered AND titled) AS passed_title_gate, "
    f"count(*) FILTER (WHERE {MATCHED}) AS matched, "
    "count(*) FILTER (WHERE considered AND titled AND bucket = 'aside' AND NOT hidden AND NOT applied) AS set_aside, "
    "count(*) FILTER (WHERE considered AND titled AND bucket = 'in' AND hidden) AS hidden, "
    "count(*) FILTER (WHERE considered AND titled AND bucket = 'in' AND NOT hidden AND applied) AS applied"
)


@query("funnel", f"{FLAGS} SELECT {FUNNEL_COLUMNS}, 0 AS folded FROM f")
def funnel(spark, sf_dir):
    return _flagged(spark, sf_dir, FUNNEL).funnel


@query("funnel_folded", f"{FLAGS} SELECT {FUNNEL_COLUMNS}, count(*) FILTER (WHERE {MATCHED}) - count(DISTINCT CASE WHEN {MATCHED} THEN company_slug || '|' || title_norm END) AS folded FROM f")
def funnel_folded(spark, sf_dir):
    return _flagged(spark, sf_dir, {**FUNNEL, "collapse_duplicates": True}).funnel


# -- ranking ------------------------------------------------------------------
RANKED = {"workplace": ["hybrid", "remote"], "max_years_experience": 6, "include_intern": True, "title_keywords": ["the", "la", "de", "und", "un"],
          "unknowns": {"workplace": "include"}}
RANKED_SQL = {"listed": "listed", "workplace": FEW_SQL["workplace"],
              "experience": "CASE WHEN seniority = 'unknown' AND NOT years_known THEN NULL WHEN seniority NOT IN ('unknown','intern','entry','junior','mid','senior','manager') THEN false "
                            "WHEN years_known AND min_years > 6 THEN false ELSE true END"}
TITLES = ["the", "la", "de", "und", "un"]
HITS = " + ".join(f"CASE WHEN regexp_matches(title_folded, '(^|[^a-z0-9]){t}($|[^a-z0-9])') THEN 1 ELSE 0 END" for t in TITLES)
SCORE = (
    "floor(((({hits}) * 10.0) + coalesce(exp(-age_days / 90.0), 0.3) * 8.0 + "
    "(CASE WHEN salary_known AND coalesce(salary_max, salary_min) IS NOT NULL THEN greatest(0.0, least(1.0, (coalesce(salary_max, salary_min) - 60000.0) / 190000.0)) ELSE 0.35 END) * 4.0 + "
    "(CASE WHEN years_known AND min_years IS NOT NULL THEN CASE WHEN min_years <= 6 THEN 1.0 ELSE 0.0 END ELSE 0.4 END) * 5.0 + quality * 3.0) * 100 + 0.5) / 100"
)
SCORED = f"{P}, {screen_sql(RANKED_SQL, {}, f'({HITS}) > 0')}, k AS (SELECT *, {SCORE.format(hits=HITS)} AS score FROM s WHERE bucket = 'in')"
TIES = "score DESC, coalesce(age_days, 9999), id"
TOP = "CASE WHEN salary_known THEN coalesce(salary_max, salary_min) END"
BOTTOM = "CASE WHEN salary_known THEN coalesce(salary_min, salary_max) END"
ORDER_SQL = {
    "relevance": TIES, "newest": f"age_days ASC NULLS LAST, {TIES}", "oldest": f"age_days DESC NULLS LAST, {TIES}",
    "salary-high": f"{TOP} DESC NULLS LAST, {TIES}", "salary-low": f"{BOTTOM} ASC NULLS LAST, {TIES}", "quality": f"quality DESC NULLS LAST, {TIES}",
    "company": f"lower(strip_accents(coalesce(company_name, company_slug))), {TIES}",
}


def _register_sort(sort: str) -> None:
    name = "rank_relevance_topk" if sort == "relevance" else f"sort_{sort.replace('-', '_')}"

    def run(spark, sf_dir):
        found = search(views.postings(spark, sf_dir), {**RANKED, "sort": sort})
        return found.results.select("id", "score", "position")

    query(name, f"{SCORED} SELECT id, score, row_number() OVER (ORDER BY {ORDER_SQL[sort]}) AS position FROM k ORDER BY {ORDER_SQL[sort]} LIMIT 100")(run)


for _sort in ORDER_SQL:
    _register_sort(_sort)


@query("score_all", f"{SCORED} SELECT id, score FROM k")
def score_all(spark, sf_dir):
    p, _ = normalize_profile(RANKED)
    kept = criteria.screen(views.postings(spark, sf_dir).where(criteria.title_gate(p)), p).where("bucket = 'in'")
    return rank.score(kept, p).select("id", "score")


@query("page_offset", f"{SCORED} SELECT id, row_number() OVER (ORDER BY {TIES}) AS position FROM k ORDER BY {TIES} LIMIT 25 OFFSET 50")
def page_offset(spark, sf_dir):
    return search(views.postings(spark, sf_dir), RANKED, limit=25, offset=50).results.select("id", "position")


@query("collapse_duplicates",
       f"{SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY company_slug, title_norm ORDER BY {TIES}) AS rn, "
       "count(*) OVER (PARTITION BY company_slug, title_norm) - 1 AS duplicates FROM k), "
       "m AS (SELECT company_slug, title_norm, string_agg(metro, ',' ORDER BY metro) AS duplicate_metros FROM (SELECT DISTINCT company_slug, title_norm, unnest(metros) AS metro FROM k) GROUP BY ALL) "
       "SELECT id, duplicates, coalesce(duplicate_metros, '') AS duplicate_metros FROM r LEFT JOIN m USING (company_slug, title_norm) WHERE rn = 1")
def collapse_duplicates(spark, sf_dir):
    p, _ = normalize_profile(RANKED)
    kept = criteria.screen(views.postings(spark, sf_dir).where(criteria.title_gate(p)), p).where("bucket = 'in'")
    folded = rank.collapse_duplicates(rank.score(kept, p), "relevance")
    return folded.select("id", "duplicates", F.array_join("duplicate_metros", ",").alias("duplicate_metros"))


LABEL = (
    "CASE WHEN NOT salary_known THEN NULL WHEN salary_min <> salary_max THEN " + MONEY.format("salary_min") + " || '–' || " + MONEY.format("salary_max")
    + " ELSE " + MONEY.format("coalesce(salary_max, salary_min)") + " END"
)


@query("present_page",
       f"{SCORED} SELECT id, coalesce(company_name, NULL) AS company, url, 'Blurb of ' || company_slug AS company_blurb, {LABEL} AS salary_label, "
       f"array_to_string(unknown_on, ',') AS unknown_on, CAST(CASE WHEN equity THEN 1 ELSE 0 END AS INTEGER) AS equity FROM k ORDER BY {TIES} LIMIT 40")
def present_page(spark, sf_dir):
    """A page whose links and company blurbs are fetched after the limit."""
    view = views.postings(spark, sf_dir)
    links = view.select("id", "url", F.lit(None).cast("string").alias("apply_url"))
    companies = view.select("ats", "company_slug").distinct().select(
        F.concat_ws(":", "ats", "company_slug").alias("id"), F.concat(F.lit("Blurb of "), "company_slug").alias("blurb"))
    page = search(view.drop("url"), RANKED, limit=40).results
    shown = rank.present(page.withColumns({"posted_at": F.lit(None).cast("timestamp"), "first_seen": F.lit(None).cast("timestamp")}), links, companies)
    return shown.select("id", "company", "url", "company_blurb", "salary_label", F.array_join("unknown_on", ",").alias("unknown_on"), F.col("equity").cast("int").alias("equity"))


@query("salary_label", f"{P} SELECT id, {LABEL} AS salary_label FROM p")
def salary_label(spark, sf_dir):
    return views.postings(spark, sf_dir).select("id", rank.salary_label(F.col("salary_known"), F.col("salary_min"), F.col("salary_max")).alias("salary_label"))


@query("sample_evenly",
       "WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn, count(*) OVER () AS n FROM orders), "
       "picks AS (SELECT DISTINCT CAST(i * n // 97 AS BIGINT) AS rn FROM (SELECT unnest(range(97)) AS i), (SELECT max(n) AS n FROM o)) "
       "SELECT o_orderkey FROM o JOIN picks USING (rn)")
def sample_evenly(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders")
    return rank.sample_evenly(orders, [F.col("o_orderkey")], 97).select("o_orderkey")


@query("top_n_per_company",
       "SELECT o_custkey, o_orderkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders WHERE o_orderstatus = 'O') WHERE rn <= 6")
def top_n_per_company(spark, sf_dir):
    opened = views.table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_custkey", "o_orderkey", "o_orderdate")
    return rank.top_per_group(opened, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey")], 6).select("o_custkey", "o_orderkey", "rn")


@query("search_page",
       f"{FLAGS}, k AS (SELECT *, {SCORE.format(hits='0').replace('CASE WHEN years_known AND min_years IS NOT NULL THEN CASE WHEN min_years <= 6 THEN 1.0 ELSE 0.0 END ELSE 0.4 END', '0.5')} AS score FROM f "
       "WHERE considered AND titled AND NOT hidden AND NOT applied), "
       f"a AS (SELECT 'results' AS list, id, score FROM k WHERE bucket = 'in' ORDER BY {TIES} LIMIT 100), "
       f"z AS (SELECT 'aside' AS list, id, score FROM k WHERE bucket = 'aside' ORDER BY {TIES} LIMIT 100) SELECT * FROM a UNION ALL SELECT * FROM z")
def search_page(spark, sf_dir):
    """A whole search with marks and a restricted set: both lists."""
    found = _flagged(spark, sf_dir, FUNNEL)
    return found.results.select(F.lit("results").alias("list"), "id", "score").unionByName(found.aside.select(F.lit("aside").alias("list"), "id", "score"))


@query("open_roles_band",
       "WITH r AS (SELECT o_custkey, count(*) AS open_roles FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) SELECT o_custkey, open_roles, "
       "CASE WHEN open_roles = 1 THEN '1' WHEN open_roles <= 5 THEN '2-5' WHEN open_roles <= 20 THEN '6-20' WHEN open_roles <= 100 THEN '21-100' WHEN open_roles <= 500 THEN '101-500' ELSE '500+' END AS band FROM r")
def open_roles_band(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderstatus") == "O").alias("is_open"))
    return facets.open_roles(orders, "o_custkey").withColumn("band", facets.company_size_band(F.col("open_roles")))


SECTOR_OF = "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'transportation-logistics' WHEN 'MACHINERY' THEN 'manufacturing-industrial' WHEN 'BUILDING' THEN 'construction' WHEN 'HOUSEHOLD' THEN 'consumer' END"


@query("sector_mix",
       f"WITH r AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) SELECT {SECTOR_OF} AS sector, count(*) AS companies, CAST(sum(coalesce(n, 0)) AS BIGINT) AS jobs "
       "FROM customer LEFT JOIN r ON o_custkey = c_custkey WHERE c_custkey % 9 <> 0 GROUP BY 1")
def sector_mix(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("company_id"), (F.col("o_orderstatus") == "O").alias("is_open"))
    companies = views.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.expr(SECTOR_OF).alias("sector"), F.when(F.expr("c_custkey % 9 <> 0"), "live").otherwise("dead").alias("status"))
    return facets.sector_mix(companies, facets.open_roles(orders, "company_id"))


@query("counts_by_workplace", f"{P} SELECT workplace AS value, count(*) AS jobs FROM p GROUP BY 1")
def counts_by_workplace(spark, sf_dir):
    return facets.top_counts(views.postings(spark, sf_dir), "workplace", 20)


@query("counts_top_metros", f"{P} SELECT m AS value, count(*) AS jobs FROM (SELECT unnest(metros) AS m FROM p) GROUP BY 1 ORDER BY jobs DESC, value LIMIT 20")
def counts_top_metros(spark, sf_dir):
    return facets.top_counts(views.postings(spark, sf_dir).select(F.explode("metros").alias("m")), "m", 20)


@query("counts_top_companies", f"{P} SELECT company_name AS value, count(*) AS jobs FROM p GROUP BY 1 ORDER BY jobs DESC, value NULLS FIRST LIMIT 20")
def counts_top_companies(spark, sf_dir):
    return facets.top_counts(views.postings(spark, sf_dir), "company_name", 20)


def _corpus(spark, sf_dir):
    """Stored tables of a small corpus: postings, companies, metros, events, run meta."""
    v = views.postings(spark, sf_dir)
    posts = v.select("id", "ats", F.col("listed").alias("is_open"), F.col("metros").alias("d_metros"), F.col("countries").alias("d_countries"),
                     F.col("skills").alias("d_skills"), F.concat_ws(":", "ats", "company_slug").alias("company_id"),
                     F.when(F.expr("doc_id % 5 <> 0"), F.lit("2026-01-01").cast("timestamp")).alias("d_derived_at"), "doc_id", "age_days")
    companies = v.groupBy("ats", "company_slug").agg(F.max("doc_id").alias("m")).select(
        F.concat_ws(":", "ats", "company_slug").alias("id"), F.when(F.expr("m % 4 <> 0"), "live").otherwise("empty").alias("status"),
        F.when(F.expr("m % 3 = 0"), "ai").alias("sector"))
    metros = posts.select(F.explode("d_metros").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("job_count")).select(
        "id", F.upper("id").alias("label"), F.lit("us").alias("country"), F.lit(None).cast("string").alias("region"), "job_count")
    events = posts.where("age_days IS NOT NULL").select(
        "id", F.expr("date_sub(DATE'2026-01-01', CAST(age_days AS INT))").alias("day"), F.lit("appeared").alias("event"))
    meta = posts.select(F.concat(F.lit("last_sweep_"), "ats").alias("key"), (F.col("doc_id") + 1).cast("string").alias("value"), F.col("doc_id").alias("at"))
    return posts, companies, metros, events, meta


@query("corpus_meta",
       f"{P}, co AS (SELECT ats || ':' || company_slug AS id, max(doc_id) AS m FROM p GROUP BY 1), o AS (SELECT ats || ':' || company_slug AS id, count(*) AS n FROM p WHERE listed GROUP BY 1), "
       "x AS (SELECT 'jobs' AS name, count(*) AS n FROM p UNION ALL SELECT 'open', count(*) FROM p WHERE listed UNION ALL SELECT 'derived', count(*) FROM p WHERE doc_id % 5 <> 0 "
       "UNION ALL SELECT 'companies', count(*) FROM co UNION ALL SELECT 'boards_live', count(*) FROM co WHERE m % 4 <> 0 UNION ALL SELECT 'sectors_read', count(*) FROM co WHERE m % 4 <> 0 AND m % 3 = 0 "
       "UNION ALL SELECT 'jobs_with_sector', coalesce(sum(n), 0) FROM o JOIN co USING (id) WHERE m % 3 = 0 UNION ALL SELECT 'ats:' || ats, count(*) FROM p WHERE listed GROUP BY ats "
       "UNION ALL SELECT 'metro:' || m, count(*) FROM (SELECT unnest(metros) AS m FROM p) GROUP BY m UNION ALL SELECT 'skill:' || s, count(*) FROM (SELECT unnest(skills) AS s FROM p) GROUP BY s "
       "UNION ALL SELECT 'sweep:' || ats, max(doc_id) + 1 FROM p GROUP BY ats UNION ALL SELECT 'stalest', min(m) FROM (SELECT max(doc_id) + 1 AS m FROM p GROUP BY ats) "
       "UNION ALL (SELECT 'day:' || CAST(DATE '2026-01-01' - CAST(age_days AS INTEGER) AS VARCHAR), count(*) FROM p WHERE age_days IS NOT NULL GROUP BY age_days ORDER BY age_days LIMIT 60)) "
       "SELECT name, CAST(n AS BIGINT) AS n FROM x")
def corpus_meta(spark, sf_dir):
    meta = facets.corpus_meta(*_corpus(spark, sf_dir))
    out = None
    for heading in ("totals", "boards", "jobs_with_sector"):
        df = meta[heading]
        long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("n")) for c in df.columns])).alias("x")).select("x.*")
        out = long if out is None else out.unionByName(long)
    for prefix, heading, name, n in (("ats:", "ats", "value", "count"), ("metro:", "metros", "id", "job_count"), ("skill:", "skills", "value", "jobs"),
                                     ("sweep:", "last_sweep_by_ats", "ats", "at"), ("day:", "days", "day", "n")):
        out = out.unionByName(meta[heading].select(F.concat(F.lit(prefix), F.col(name).cast("string")).alias("name"), F.col(n).cast("long").alias("n")))
    return out.unionByName(meta["last_sweep"].select(F.lit("stalest").alias("name"), F.col("at").cast("long").alias("n")))


@query("vocabulary",
       f"{P} SELECT 'ats' AS kind, ats AS value, count(*) AS n FROM p WHERE listed GROUP BY 2 UNION ALL SELECT 'metro', m, 0 FROM (SELECT DISTINCT unnest(metros) AS m FROM p) "
       "UNION ALL SELECT 'country', c, 0 FROM (SELECT DISTINCT unnest(countries) AS c FROM p WHERE listed)")
def vocabulary(spark, sf_dir):
    posts, _, metros, _, _ = _corpus(spark, sf_dir)
    v = facets.vocabulary(posts, metros)
    return v["ats"].select(F.lit("ats").alias("kind"), "value", F.col("count").alias("n")).unionByName(
        v["metros"].select(F.lit("metro").alias("kind"), F.col("id").alias("value"), F.lit(0).cast("long").alias("n"))).unionByName(
        v["countries"].select(F.lit("country").alias("kind"), F.col("code").alias("value"), F.lit(0).cast("long").alias("n")))
