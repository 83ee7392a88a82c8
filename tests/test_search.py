"""Search semantics on hand-made rows, and properties that must hold on real ones."""

import pytest
from pyspark.sql import functions as F

from jobtide.constants import DEFAULT_WEIGHTS
from jobtide.operators import criteria, facets, rank
from jobtide.plans.profile import allowed_seniority, normalize_profile
from jobtide.plans.search import search
from jobtide.workloads import views

SCHEMA = (
    "id string, ats string, listed boolean, title string, title_norm string, title_folded string, company_name string, company_slug string, company_size string, "
    "company_open_roles long, sector string, department string, employment_type string, workplace string, workplace_guessed boolean, remote_scope string, metros array<string>, "
    "countries array<string>, salary_min long, salary_max long, salary_known boolean, salary_src string, pay_period string, currency string, equity boolean, min_years double, "
    "max_years double, years_known boolean, seniority string, job_function string, skills array<string>, visa boolean, clearance boolean, degree string, age_days long, quality double"
)
BASE = dict(ats="ashby", listed=True, title="Engineer", title_norm="engineer", title_folded="engineer", company_slug="acme", company_size="1", company_open_roles=1,
            workplace="hybrid", workplace_guessed=False, metros=["nyc"], countries=["us"], salary_known=False, years_known=False, skills=[], age_days=10, quality=0.5)


def view(spark, *rows):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    data = [tuple({**BASE, "id": f"x:{i}", **r}.get(n) for n in names) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


@pytest.mark.parametrize("row,profile,want", [
    ({}, {"metros": ["nyc"]}, True), ({"metros": ["la"]}, {"metros": ["nyc"]}, False), ({"metros": [], "countries": []}, {"metros": ["nyc"]}, None),
    ({"metros": [], "countries": ["fr"]}, {"metros": ["nyc"]}, False), ({"metros": [], "countries": ["us"]}, {"metros": ["nyc"]}, None),
    ({"workplace": "remote", "metros": [], "countries": ["de"]}, {"metros": ["nyc"], "remote_counts_as_match": True}, False),
    ({"workplace": "remote", "metros": [], "countries": []}, {"metros": ["nyc"], "remote_counts_as_match": True}, True),
])
def test_metro(spark, row, profile, want):
    p, _ = normalize_profile(profile)
    assert view(spark, row).select(criteria.metro(p).alias("v")).first().v is want


@pytest.mark.parametrize("asked,want", [(["onsite"], True), (["hybrid"], None), (["remote"], False)])
def test_guessed_onsite(spark, asked, want):
    p, _ = normalize_profile({"workplace": asked})
    assert view(spark, {"workplace": "onsite", "workplace_guessed": True}).select(criteria.workplace(p).alias("v")).first().v is want


def test_policies(spark):
    rows = view(spark, {"salary_known": True, "salary_min": 100000, "salary_max": 120000}, {}, {"salary_known": True, "salary_min": 10000, "salary_max": 20000})
    for policy, buckets in (("include", ["in", "in", "out"]), ("exclude", ["in", "out", "out"]), ("separate", ["in", "aside", "out"])):
        p, _ = normalize_profile({"salary_min": 90000, "unknowns": {"salary": policy}})
        got = [r.b for r in criteria.screen(rows, p).orderBy("id").select(F.coalesce("bucket", F.lit("out")).alias("b")).collect()]
        assert got == buckets
        assert [r.b for r in rows.orderBy("id").select(criteria.classify(p).alias("b")).collect()] == buckets
        for bucket in ("in", "aside"):
            kept = {r.id for r in criteria.keep_bucket(rows, p, bucket).collect()}
            assert kept == {f"x:{i}" for i, b in enumerate(buckets) if b == bucket}


def test_failed_row_is_never_aside(spark):
    p, _ = normalize_profile({"salary_min": 90000, "workplace": ["remote"], "unknowns": {"salary": "separate"}})
    row = criteria.screen(view(spark, {}), p).first()
    assert row.bucket is None and row.failed == ["workplace"] and row.unknown_on == ["salary"]


def test_allowed_seniority():
    assert allowed_seniority(normalize_profile({})[0]) is None
    assert allowed_seniority(normalize_profile({"max_years_experience": 2})[0]) == ["entry", "junior"]
    assert allowed_seniority(normalize_profile({"max_years_experience": 0, "include_intern": True})[0]) == ["intern", "entry"]
    assert "junior" not in allowed_seniority(normalize_profile({"min_years_experience": 4})[0])


def test_profile_checks():
    p, warnings = normalize_profile({
        "ats": ["lever", "nope"], "currencies": ["usd", "dollars"], "unknowns": {"salary": "maybe", "nothing": "include"}, "sort": "up", "limit": 99999,
        "weights": {"recency": 2, "other": 1}, "families": ["data"], "new_field": 1, "exclude_companies": ["x"]})
    assert p["ats"] == ["lever"] and p["currencies"] == ["USD"] and p["sort"] == "relevance" and p["limit"] == 5000
    assert p["weights"] == {**DEFAULT_WEIGHTS, "recency": 2.0} and p["job_functions"] == ["data"] and p["extra"] == {"new_field": 1}
    assert len(warnings) == 7


def test_hidden_and_applied_count_once(spark):
    rows = view(spark, {}, {}, {})
    ids = spark.createDataFrame([("x:0",)], "id string")
    both = spark.createDataFrame([("x:0",), ("x:1",)], "id string")
    found = search(rows, {}, hidden=ids, applied=both)
    f = found.funnel.first()
    assert (f.hidden, f.applied, f.matched) == (1, 1, 1)
    assert [r.id for r in found.results.collect()] == ["x:2"]


def test_duplicates_fold_after_counting(spark):
    rows = view(spark, {"age_days": 3, "metros": ["la"]}, {"age_days": 1}, {"company_slug": "other"})
    found = search(rows, {"collapse_duplicates": True})
    f = found.funnel.first()
    assert (f.matched, f.folded) == (3, 1)
    first = {r.id: r for r in found.results.collect()}
    assert set(first) == {"x:1", "x:2"} and first["x:1"].duplicates == 1 and first["x:1"].duplicate_metros == ["la", "nyc"]


def test_absent_values_sort_last(spark):
    rows = view(spark, {"age_days": None}, {"age_days": 5}, {"age_days": 50})
    for sort, want in (("newest", ["x:1", "x:2", "x:0"]), ("oldest", ["x:2", "x:1", "x:0"])):
        assert [r.id for r in search(rows, {"sort": sort}).results.orderBy("position").collect()] == want


def test_company_sort_ignores_case_and_accents(spark):
    rows = view(spark, {"company_name": "zeta"}, {"company_name": "Éclair"}, {"company_name": "eclair"}, {"company_name": "Alpha"})
    got = [r.company_name for r in search(rows, {"sort": "company"}).results.orderBy("position").collect()]
    assert got == ["Alpha", "Éclair", "eclair", "zeta"]


def test_short_ladder_is_the_standing_one(spark):
    hist = spark.createDataFrame([(50_000 + i, 1) for i in range(39)], "value long, n long")
    labels = [b.label for b in facets.salary_ladder(hist).first().ladder]
    assert labels[0] == "<$80k" and len(labels) == 5
    wide = spark.createDataFrame([(20_000 + 5_000 * i, 1) for i in range(44)], "value long, n long")
    assert [b.label for b in facets.salary_ladder(wide).first().ladder][:2] == ["under $60k", "$60k–$110k"]


def test_ticked_facet_equals_its_count(spark, sf_dir):
    """The count beside a value is the result of asking for that value alone."""
    rows = views.postings(spark, sf_dir)
    base = {"salary_min": 60000, "workplace": ["remote"], "unknowns": {"workplace": "exclude"}}
    p, _ = normalize_profile(base)
    counts = {(r.dim, r.value): r.n for r in facets.facet_counts(criteria.screen(rows, p), p).collect()}
    for value in ("onsite", "hybrid"):
        alone, _ = normalize_profile({**base, "workplace": [value], "unknowns": {"workplace": "exclude"}})
        # A guessed on-site row answers the on-site question as well.
        n = criteria.keep_bucket(rows, alone, "in").where(f"workplace = '{value}'").count()
        assert counts[("workplace", value)] == n


def test_screen_equals_keep_bucket(spark, sf_dir):
    rows = views.postings(spark, sf_dir)
    p, _ = normalize_profile({"metros": ["nyc"], "salary_min": 70000, "skills": ["sql"], "unknowns": {"metro": "separate", "skills": "exclude"}})
    screened = {(r.id, r.bucket) for r in criteria.screen(rows, p).where("bucket IS NOT NULL").select("id", "bucket").collect()}
    kept = {(r.id, b) for b in ("in", "aside") for r in criteria.keep_bucket(rows, p, b).select("id").collect()}
    assert screened == kept


def test_sample_is_even(spark):
    got = sorted(r.i for r in rank.sample_evenly(spark.range(103).select(F.col("id").alias("i")), [F.col("i")], 10, buckets=3).collect())
    assert got == [int(k * 10.3) for k in range(10)]
    assert rank.sample_evenly(spark.range(5), [F.col("id")], 10).count() == 5


def test_sample_evenly_of_a_wide_frame(spark):
    wide = spark.range(20_000).select((F.col("id") * 7 % 20_000).alias("i"), F.md5(F.col("id").cast("string")).alias("a"), F.lit("x").alias("b"), F.rand(1).alias("c"), (F.col("id") % 3).alias("d"))
    got = sorted(r.i for r in rank.sample_evenly(wide.repartition(6), [F.col("i")], 97, buckets=5).collect())
    assert got == [k * 20_000 // 97 for k in range(97)]
    assert rank.sample_evenly(wide, [F.col("d")], 97, buckets=5).count() == 97


def test_index_alone_leaves_absent_text_unknown(spark, sf_dir):
    from jobtide.operators.textindex import build_token_index

    texts, postings = views.texts(spark, sf_dir), views.postings(spark, sf_dir)
    profile = {"description_keywords": ["the", "hathre"], "limit": 5000}
    index = build_token_index(texts)
    rows = [search(postings, profile, **options).results.select("id", "score", "description_hits").collect() for options in ({"texts": texts}, {"texts": texts, "index": index}, {"index": index})]
    by_id = [{r.id: (r.score, sorted(r.description_hits)) for r in found} for found in rows]
    assert by_id[0] and by_id[0] == by_id[1] == by_id[2]
