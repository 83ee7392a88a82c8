"""User marks and company reading: registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dossier, facets, marks
from ..schemas import COMPANIES
from . import views
from .q_snapshot import DAY, NOW, companies, fill
from .registry import query, table

P = views.posting_sql()
STATUS = "CASE o_orderkey % 5 WHEN 0 THEN 'saved' WHEN 1 THEN 'applied' WHEN 2 THEN 'offer' WHEN 3 THEN 'rejected' ELSE 'interviewing' END"
OLD = "o_orderkey % 3 <> 0"
PATCHED = "o_orderkey % 2 = 0"
NEW_STATUS = "CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'applied' WHEN 2 THEN 'bogus' ELSE 'saved' END"
VALID = f"({PATCHED}) AND coalesce({NEW_STATUS} <> 'bogus', true)"
OLD_STATUS = "CASE WHEN o_orderkey % 4 = 0 THEN 'saved' ELSE 'offer' END"


def _saved(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(OLD).selectExpr(
        "CAST(o_custkey AS STRING) AS user_id", "'x:' || o_orderkey AS id", f"{OLD_STATUS} AS status", "CASE WHEN o_orderkey % 5 = 0 THEN 'note' END AS note",
        "TIMESTAMP'2026-01-01' AS saved_at", "TIMESTAMP'2026-01-01' AS updated_at", "CASE WHEN o_orderkey % 4 <> 0 THEN TIMESTAMP'2026-01-01' END AS applied_at",
        "'t' AS title", "CAST(NULL AS STRING) AS company", "CAST(NULL AS STRING) AS url")


def _patches(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(PATCHED).selectExpr(
        "CAST(o_custkey AS STRING) AS user_id", "'x:' || o_orderkey AS id", f"{NEW_STATUS} AS status", "CASE WHEN o_orderkey % 6 = 0 THEN 'new note' END AS note",
        "CAST(NULL AS STRING) AS title", "'c' AS company", "CAST(NULL AS STRING) AS url")


@query("upsert_saved",
       f"WITH o AS (SELECT *, {OLD} AS old, {VALID} AS patch, {OLD_STATUS} AS os, {NEW_STATUS} AS ns FROM orders), s AS (SELECT *, CASE WHEN patch THEN coalesce(ns, CASE WHEN old THEN os END, 'saved') ELSE os END AS st FROM o WHERE old OR patch) "
       "SELECT CAST(o_custkey AS VARCHAR) AS user_id, 'x:' || o_orderkey AS id, st AS status, coalesce(CASE WHEN patch AND o_orderkey % 6 = 0 THEN 'new note' END, CASE WHEN old AND o_orderkey % 5 = 0 THEN 'note' END) AS note, "
       f"CASE WHEN old THEN '2026-01-01' ELSE '{DAY}' END AS saved_at, CASE WHEN patch THEN '{DAY}' ELSE '2026-01-01' END AS updated_at, "
       f"CASE WHEN old AND o_orderkey % 4 <> 0 THEN '2026-01-01' WHEN patch AND st <> 'saved' THEN '{DAY}' END AS applied_at, CASE WHEN old THEN 't' END AS title, CASE WHEN patch THEN 'c' END AS company FROM s")
def upsert_saved(spark, sf_dir):
    out = marks.upsert_saved(_saved(spark, sf_dir), _patches(spark, sf_dir), NOW)
    return out.select("user_id", "id", "status", "note", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("saved_at", "updated_at", "applied_at")], "title", "company")


@query("upsert_hidden",
       "SELECT CAST(o_custkey AS VARCHAR) AS user_id, 'x:' || o_orderkey AS id, CASE WHEN o_orderkey % 3 <> 0 THEN '2026-01-01' ELSE "
       f"'{DAY}' END AS hidden_at, CASE WHEN o_orderkey % 3 <> 0 THEN 't' END AS title, CASE WHEN o_orderkey % 2 = 0 THEN 'c' END AS company FROM orders WHERE (o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0) AND o_orderkey % 10 <> 0")
def upsert_hidden(spark, sf_dir):
    hidden = _saved(spark, sf_dir).select("user_id", "id", F.col("saved_at").alias("hidden_at"), "title", "company", "url")
    out = marks.upsert_hidden(hidden, _patches(spark, sf_dir), NOW)
    removed = table(spark, sf_dir, "orders").where("o_orderkey % 10 = 0").selectExpr("CAST(o_custkey AS STRING) AS user_id", "'x:' || o_orderkey AS id")
    return marks.unhide(out, removed).select("user_id", "id", F.date_format("hidden_at", "yyyy-MM-dd").alias("hidden_at"), "title", "company")


def _by_status(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(
        "CAST(o_custkey AS STRING) AS user_id", "'x:' || o_orderkey AS id", f"{STATUS} AS status", "CAST(NULL AS STRING) AS note", "TIMESTAMP'2026-01-01' AS saved_at",
        "TIMESTAMP'2026-01-01' AS updated_at", "CAST(NULL AS TIMESTAMP) AS applied_at", "'snap' AS title", "'snap co' AS company", "'snap url' AS url")


@query("status_counts", f"SELECT CAST(o_custkey AS VARCHAR) AS user_id, " + ", ".join(
    f"count(*) FILTER (WHERE {STATUS} = '{s}') AS {s}" for s in ("saved", "applied", "interviewing", "offer", "rejected")) + ", count(*) AS total FROM orders GROUP BY 1")
def status_counts(spark, sf_dir):
    return marks.status_counts(_by_status(spark, sf_dir))


@query("applied_ids", f"SELECT 'x:' || o_orderkey AS id FROM orders WHERE o_custkey = 7 AND {STATUS} <> 'saved'")
def applied_ids(spark, sf_dir):
    return marks.applied_ids(_by_status(spark, sf_dir), "7")


@query("hidden_ids", "SELECT 'x:' || o_orderkey AS id FROM orders WHERE o_custkey = 7")
def hidden_ids(spark, sf_dir):
    return marks.hidden_ids(_by_status(spark, sf_dir), "7")


def _lists(spark, sf_dir, listed="o_orderkey % 4 <> 1"):
    o = table(spark, sf_dir, "orders")
    lists = o.selectExpr("'l' || o_custkey || '-' || (o_orderkey % 3) AS list_id", "CAST(o_custkey AS STRING) AS user_id", "'name' AS name", "TIMESTAMP'2026-01-01' AS created_at").distinct()
    items = o.where(listed).selectExpr("'l' || o_custkey || '-' || (o_orderkey % 3) AS list_id", "'x:' || o_orderkey AS id", "o_orderdate AS added_at")
    return lists, items


ITEMS = "i AS (SELECT 'l' || o_custkey || '-' || (o_orderkey % 3) AS list_id, CAST(o_custkey AS VARCHAR) AS user_id, 'x:' || o_orderkey AS id, o_orderkey FROM orders WHERE o_orderkey % 4 <> 1)"


ALL_ITEMS = ITEMS.replace("WHERE o_orderkey % 4 <> 1", "")


@query("saved_in_list", f"WITH {ALL_ITEMS} SELECT list_id, id FROM i WHERE o_orderkey % 3 <> 0")
def saved_in_list(spark, sf_dir):
    return marks.saved_in_list(_saved(spark, sf_dir), *_lists(spark, sf_dir, "true")).select("list_id", "id")


@query("list_membership", f"WITH {ALL_ITEMS} SELECT user_id, id, string_agg(list_id, ',' ORDER BY list_id) AS list_ids FROM i GROUP BY 1, 2")
def list_membership(spark, sf_dir):
    return marks.list_membership(*_lists(spark, sf_dir, "true")).select("user_id", "id", F.array_join("list_ids", ",").alias("list_ids"))


@query("lists_with_counts", f"WITH {ITEMS}, l AS (SELECT DISTINCT 'l' || o_custkey || '-' || (o_orderkey % 3) AS list_id FROM orders) SELECT l.list_id, count(i.id) AS n FROM l LEFT JOIN i USING (list_id) GROUP BY 1")
def lists_with_counts(spark, sf_dir):
    return marks.lists_with_counts(*_lists(spark, sf_dir)).select("list_id", F.col("count").alias("n"))


@query("unsave", f"WITH {ITEMS} SELECT 'item' AS kind, list_id || '/' || id AS key FROM i WHERE o_orderkey % 8 <> 0 UNION ALL SELECT 'saved', 'x:' || o_orderkey FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 8 <> 0")
def unsave(spark, sf_dir):
    removed = table(spark, sf_dir, "orders").where("o_orderkey % 8 = 0").selectExpr("CAST(o_custkey AS STRING) AS user_id", "'x:' || o_orderkey AS id")
    saved, items = marks.unsave(_saved(spark, sf_dir), *_lists(spark, sf_dir), removed)
    return items.select(F.lit("item").alias("kind"), F.concat_ws("/", "list_id", "id").alias("key")).unionByName(saved.select(F.lit("saved").alias("kind"), F.col("id").alias("key")))


@query("hydrate_saved",
       f"SELECT 'x:' || o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 0 THEN 'Live ' || o_orderkey ELSE 'snap' END AS title, CASE WHEN o_orderkey % 4 = 0 THEN 'snap url' WHEN o_orderkey % 4 = 1 THEN 'apply' ELSE 'page' END AS url, "
       f"CASE WHEN o_orderkey % 4 <> 0 THEN CASE WHEN o_orderstatus = 'O' THEN 'yes' ELSE 'no' END END AS listed, {STATUS} AS status, CASE WHEN o_orderkey % 4 <> 0 THEN '$90k–$120k' END AS salary_label FROM orders")
def hydrate_saved(spark, sf_dir):
    posts = table(spark, sf_dir, "orders").where("o_orderkey % 4 <> 0").selectExpr(
        "'x:' || o_orderkey AS id", "'Live ' || o_orderkey AS title", "'Co' AS company_name", "'co' AS company_slug", "CASE WHEN o_orderkey % 4 = 1 THEN 'apply' END AS apply_url", "'page' AS url",
        "o_orderstatus = 'O' AS is_open", "'remote' AS d_workplace", "'senior' AS d_seniority", "'data' AS d_job_function", "true AS d_salary_known", "90000 AS d_salary_min", "120000 AS d_salary_max")
    out = marks.hydrate_saved(_by_status(spark, sf_dir), posts)
    return out.select("id", "title", "url", F.when(F.col("listed"), "yes").when(~F.col("listed"), "no").alias("listed"), "status", "salary_label")


# Sheet cells by key: blank, as last written, or edited by hand.
CELL = "CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN p_brand WHEN 2 THEN 'by hand' ELSE 'new ' || p_brand END"


@query("three_way_sync",
       f"SELECT 'p' || p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'new ' || p_brand WHEN p_partkey % 7 = 0 THEN {CELL} WHEN p_partkey % 4 IN (0, 1) THEN 'new ' || p_brand ELSE {CELL} END AS role, "
       "CASE WHEN p_partkey % 5 = 0 THEN 'added' WHEN p_partkey % 7 = 0 THEN 'untouched' WHEN p_partkey % 4 IN (0, 1) THEN 'updated' ELSE 'skipped' END AS action, "
       "CASE WHEN p_partkey % 5 = 0 OR p_partkey % 7 <> 0 AND p_partkey % 4 IN (0, 1) THEN 'new ' || p_brand ELSE p_brand END AS synced FROM part WHERE NOT (p_partkey % 5 = 0 AND p_partkey % 7 = 0)")
def three_way_sync(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    sheet = p.where("p_partkey % 5 <> 0").selectExpr("'p' || p_partkey AS id", f"{CELL} AS role", "'x' AS note", "map('role', p_brand, 'note', 'x') AS synced")
    saved = p.where("p_partkey % 7 <> 0").selectExpr("'p' || p_partkey AS id", "'new ' || p_brand AS role", "CAST(NULL AS STRING) AS note")
    out = marks.three_way_sync(sheet, saved, ["role", "note"])
    return out.select("id", "role", "action", F.try_element_at("synced", F.lit("role")).alias("synced"))


# -- company reading ----------------------------------------------------------------


def _company_postings(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.selectExpr("'o' || o_orderkey AS id", "'ashby:b' || o_custkey AS company_id", "o_orderstatus = 'O' AS is_open", "o_orderpriority || ' role' AS title", "o_orderdate AS posted_at")


@query("companies_to_read",
       "WITH r AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) SELECT 'ashby:b' || c_custkey AS id, n AS open_roles FROM customer JOIN r ON o_custkey = c_custkey "
       "WHERE c_custkey % 7 <> 0 ORDER BY n DESC, id LIMIT 50")
def companies_to_read(spark, sf_dir):
    c = companies(spark, sf_dir, "true").withColumn("sector_at", F.when(F.expr("CAST(substring(slug, 2) AS BIGINT) % 7 = 0"), F.lit(NOW).cast("timestamp")))
    return dossier.companies_to_read(c, _company_postings(spark, sf_dir), limit=50).select("id", "open_roles")


def _documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    posts = d.selectExpr("CAST(doc_id AS STRING) AS id", "source AS company_id", "doc_id % 11 <> 0 AS is_open", "'Title ' || (doc_id % 90) AS title",
                         "CAST(TIMESTAMP'2026-01-01' AS TIMESTAMP) - make_dt_interval(CAST((doc_id * 37) % 1000 AS INT)) AS posted_at")
    return posts, d.selectExpr("CAST(doc_id AS STRING) AS id", "text")


@query("dossier_gather",
       "WITH d AS (SELECT *, source AS c, row_number() OVER (PARTITION BY source ORDER BY (doc_id * 37) % 1000, CAST(doc_id AS VARCHAR)) AS rn FROM documents WHERE doc_id % 11 <> 0), "
       "l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY (doc_id * 37) % 1000, CAST(doc_id AS VARCHAR)) AS k FROM documents WHERE doc_id % 11 <> 0 AND length(text) > 200), "
       "t AS (SELECT c, string_agg('Title ' || (doc_id % 90), ';' ORDER BY rn) AS titles FROM d WHERE rn <= 60 GROUP BY 1), "
       "x AS (SELECT source AS c, string_agg(md5(text), ';' ORDER BY k) AS texts FROM l WHERE k <= 6 GROUP BY 1) SELECT c AS company_id, titles, texts FROM t FULL JOIN x USING (c)")
def dossier_gather(spark, sf_dir):
    """The newest titles and long texts per company."""
    g = dossier.gather(*_documents(spark, sf_dir))
    return g.select("company_id", F.array_join("titles", ";").alias("titles"), F.array_join(F.transform("texts", lambda t: F.md5(t)), ";").alias("texts"))


CUT = "trim(regexp_replace(regexp_replace(substr(text, 1, 1500), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))"


@query("company_dossier",
       "WITH d AS (SELECT source AS c, 'Title ' || (doc_id % 90) AS t, row_number() OVER (PARTITION BY source ORDER BY (doc_id * 37) % 1000, CAST(doc_id AS VARCHAR)) AS rn FROM documents WHERE doc_id % 11 <> 0), "
       "t AS (SELECT c, t, min(rn) AS rn FROM d WHERE rn <= 60 GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY rn) AS r, count(*) OVER (PARTITION BY c) AS n FROM t), "
       "h AS (SELECT c, 'Company: ' || upper(c) || chr(10) || 'Board slug: ' || c || chr(10) || 'Website: https://' || c || '.example.com' || chr(10) || 'Open roles: ' || string_agg(t, '; ' ORDER BY r) "
       "|| CASE WHEN any_value(n) > 14 THEN ' (and ' || (any_value(n) - 14) || ' more)' ELSE '' END AS head FROM o WHERE r <= 14 GROUP BY 1), "
       f"l AS (SELECT source AS c, {CUT} AS cut, row_number() OVER (PARTITION BY source ORDER BY (doc_id * 37) % 1000, CAST(doc_id AS VARCHAR)) AS k FROM documents WHERE doc_id % 11 <> 0 AND length(text) > 200), "
       "x AS (SELECT *, row_number() OVER (PARTITION BY c, lower(substr(cut, 1, 200)) ORDER BY k) AS again FROM l WHERE k <= 6 AND length(cut) >= 80), "
       "y AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY k) AS r FROM x WHERE again = 1), "
       "z AS (SELECT c, string_agg(chr(10) || chr(10) || '--- from a posting ---' || chr(10) || cut, '' ORDER BY k) AS body FROM y WHERE r <= 3 GROUP BY 1) "
       "SELECT h.c AS id, head || coalesce(body, '') AS dossier FROM h LEFT JOIN z USING (c)")
def company_dossier(spark, sf_dir):
    posts, texts = _documents(spark, sf_dir)
    c = fill(posts.select("company_id").distinct(), COMPANIES, id="company_id", slug="company_id", name="upper(company_id)", website="'https://' || company_id || '.example.com'", status="'live'")
    return dossier.company_dossier(c, dossier.gather(posts, texts))


@query("open_roles_by_slug", f"{P} SELECT company_slug, count(*) AS open_roles FROM p WHERE listed GROUP BY 1")
def open_roles_by_slug(spark, sf_dir):
    return facets.open_roles(views.postings(spark, sf_dir).withColumn("is_open", F.col("listed")).drop("open_roles"))
