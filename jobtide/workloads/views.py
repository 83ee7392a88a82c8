"""Posting-shaped views over the driver's tables.

The tables hold no postings, so each view maps columns of a table onto the
fields operators read. A view is a list of column expressions in the SQL both
engines share; ``{arr}``, ``{none}`` and ``{str}`` stand for the few words they
spell differently. Only these inputs are shared: what is computed from them is
written in DataFrame code on one side and in SQL on the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold, norm_text
from ..operators.facets import company_size_band, open_roles
from .registry import spread, table

SPARK = {"arr": "array", "none": "CAST(array() AS array<string>)", "str": "STRING"}
DUCK = {"arr": "list_value", "none": "CAST([] AS VARCHAR[])", "str": "VARCHAR"}

POSTING = {
    "doc_id": "doc_id",
    "ats": "CASE lang WHEN 'en' THEN 'ashby' WHEN 'de' THEN 'greenhouse' WHEN 'fr' THEN 'lever' ELSE 'workday' END",
    "id": "CASE lang WHEN 'en' THEN 'ashby' WHEN 'de' THEN 'greenhouse' WHEN 'fr' THEN 'lever' ELSE 'workday' END || ':' || source || ':' || CAST(doc_id AS {str})",
    "listed": "doc_id % 11 <> 0",
    "title": "split_part(text, chr(10), 1)",
    "company_slug": "source",
    "company_name": "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 'Company ' || source END",
    "department": "CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'Dept ' || CAST(doc_id % 4 AS {str}) END",
    "employment_type": "CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'PartTime' WHEN 2 THEN 'Contract' ELSE 'FullTime' END",
    "workplace": "CASE doc_id % 4 WHEN 0 THEN 'onsite' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'remote' ELSE 'unknown' END",
    "workplace_guessed": "doc_id % 8 = 0",
    "remote_scope": "CASE WHEN doc_id % 4 = 2 AND doc_id % 3 = 0 THEN 'worldwide' WHEN doc_id % 4 = 2 AND doc_id % 3 = 1 THEN 'country' END",
    "metros": "CASE doc_id % 6 WHEN 0 THEN {none} WHEN 1 THEN {arr}('nyc') WHEN 2 THEN {arr}('nyc', 'sf-bay') WHEN 3 THEN {arr}('london') "
              "WHEN 4 THEN {arr}('paris') ELSE {arr}('nowhere-town') END",
    "countries": "CASE WHEN doc_id % 12 = 0 THEN {none} WHEN doc_id % 12 = 6 THEN {arr}('de') WHEN doc_id % 6 IN (1, 2) THEN {arr}('us') "
                 "WHEN doc_id % 6 = 3 THEN {arr}('gb') WHEN doc_id % 6 = 4 THEN {arr}('fr') ELSE {arr}('ca') END",
    "salary_known": "n_chars % 3 <> 0",
    "salary_max": "CAST(CASE WHEN n_chars % 3 = 1 THEN 30000 + (n_chars * 37) % 220000 WHEN n_chars % 6 = 5 THEN 45000 + (n_chars * 53) % 150000 END AS BIGINT)",
    "salary_min": "CAST(CASE WHEN n_chars % 3 = 1 THEN 22000 + (n_chars * 37) % 220000 WHEN n_chars % 6 = 2 THEN 45000 + (n_chars * 53) % 150000 END AS BIGINT)",
    "salary_src": "CASE WHEN n_chars % 3 = 0 THEN 'no-figure' WHEN n_chars % 5 = 0 THEN 'reinterpreted:YEAR->HOUR' ELSE 'as-stated' END",
    "pay_period": "CASE n_chars % 4 WHEN 0 THEN NULL WHEN 1 THEN 'HOUR' ELSE 'YEAR' END",
    "currency": "CASE n_chars % 5 WHEN 0 THEN NULL WHEN 1 THEN 'EUR' ELSE 'USD' END",
    "equity": "CASE WHEN toxic = 1 THEN true END",
    "min_years": "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(doc_id % 13 AS DOUBLE) END",
    "max_years": "CASE WHEN doc_id % 3 = 1 THEN CAST(doc_id % 13 + 2 AS DOUBLE) END",
    "years_known": "doc_id % 3 <> 0",
    "seniority": "CASE doc_id % 7 WHEN 0 THEN 'unknown' WHEN 1 THEN 'entry' WHEN 2 THEN 'junior' WHEN 3 THEN 'mid' WHEN 4 THEN 'senior' "
                 "WHEN 5 THEN 'manager' ELSE 'intern' END",
    "job_function": "CASE doc_id % 5 WHEN 0 THEN 'other' WHEN 1 THEN 'engineering' WHEN 2 THEN 'sales' WHEN 3 THEN 'data' END",
    "skills": "CASE doc_id % 4 WHEN 0 THEN {none} WHEN 1 THEN {arr}('python', 'sql') WHEN 2 THEN {arr}('excel') ELSE {arr}('python', 'spark', 'sql') END",
    "visa": "CASE quality WHEN 1 THEN true WHEN 0 THEN false END",
    "clearance": "CASE WHEN doc_id % 17 = 0 THEN true END",
    "degree": "CASE doc_id % 5 WHEN 1 THEN 'none' WHEN 2 THEN 'bachelors' WHEN 3 THEN 'phd' END",
    "age_days": "CAST(CASE WHEN doc_id % 13 = 0 THEN NULL ELSE (doc_id * 7) % 400 END AS BIGINT)",
    "quality": "CAST(doc_id % 9 AS DOUBLE) / 8",
    "sector": "CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'other' WHEN 2 THEN 'ai' WHEN 3 THEN 'fintech' ELSE 'gaming' END",
    "url": "'https://jobs.example.com/' || CAST(doc_id AS {str})",
    "text": "text",
}
# The folded forms, in SQL.
FOLD_SQL = "lower(trim(regexp_replace(strip_accents({c}), '\\s+', ' ', 'g')))"


def posting_sql() -> str:
    """CTEs ``b`` (raw view) and ``p`` (with folded title and company size)."""
    cols = ", ".join(f"{e.format(**DUCK)} AS {c}" for c, e in POSTING.items())
    return (
        f"WITH b AS (SELECT {cols} FROM documents LEFT JOIN labels USING (doc_id)), "
        "roles AS (SELECT company_slug, count(*) AS n FROM b WHERE listed GROUP BY company_slug), "
        "p AS (SELECT b.*, coalesce(roles.n, 1) AS company_open_roles, "
        "CASE WHEN coalesce(roles.n, 1) <= 1 THEN '1' WHEN roles.n <= 5 THEN '2-5' WHEN roles.n <= 20 THEN '6-20' "
        "WHEN roles.n <= 100 THEN '21-100' WHEN roles.n <= 500 THEN '101-500' ELSE '500+' END AS company_size, "
        f"{FOLD_SQL.format(c='title')} AS title_folded, lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) AS title_norm "
        "FROM b LEFT JOIN roles USING (company_slug))"
    )


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search view over documents and labels. The label table is small next to the documents; Spark decides how to join."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    base = spread(docs.join(labels, "doc_id", "left").selectExpr(*[f"{e.format(**SPARK)} AS {c}" for c, e in POSTING.items()]))
    roles = open_roles(base.withColumn("is_open", F.col("listed")))
    count = F.coalesce("open_roles", F.lit(1))
    return base.join(roles, "company_slug", "left").withColumns({
        "company_open_roles": count, "company_size": company_size_band(count),
        "title_folded": fold(F.col("title")), "title_norm": norm_text(F.col("title")),
    }).drop("open_roles")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, title, company, body) for the token index; every tenth body is empty and every eleventh row is missing."""
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.where("doc_id % 11 <> 5").selectExpr(
        f"{POSTING['id'].format(**SPARK)} AS id", "split_part(text, chr(10), 1) AS title", "'Company ' || source AS company",
        "CASE WHEN doc_id % 10 = 3 THEN '' ELSE text END AS body")


TEXTS_SQL = (
    f"t AS (SELECT {POSTING['id'].format(**DUCK)} AS id, split_part(text, chr(10), 1) AS title, 'Company ' || source AS company, "
    "CASE WHEN doc_id % 10 = 3 THEN '' ELSE text END AS body FROM documents WHERE doc_id % 11 <> 5)"
)


def whole_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, title, company, body) of every document."""
    return table(spark, sf_dir, "documents").selectExpr(f"{POSTING['id'].format(**SPARK)} AS id", "split_part(text, chr(10), 1) AS title", "'Company ' || source AS company", "text AS body")


WHOLE_SQL = f"t AS (SELECT {POSTING['id'].format(**DUCK)} AS id, split_part(text, chr(10), 1) AS title, 'Company ' || source AS company, text AS body FROM documents)"


def joined(c: str) -> str:
    """Array column as text, the same in both engines."""
    return f"array_to_string({c}, ',')"
