"""Landed payloads, slug lists, slug store and sinks: registered queries and their SQL.

Payload bodies are JSON that Spark writes from rows of the tables, then reads
back through the source readers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.countries import COUNTRY_NAMES
from ..operators import slugs
from ..operators.snapshot import content_hash
from ..session import checkpoint_root
from ..sources import payloads, records, sink, slug_lists
from . import views
from .registry import query, spread, table

DUCK, SPARK = views.DUCK, views.SPARK


def _bodies(df, struct: str, slug: str = "'b' || o_custkey"):
    """One payload per row. Null fields are left out, as the sources do."""
    return df.select(F.expr(slug).alias("slug"), F.expr(f"to_json({struct})").alias("body"))


def _orders(spark, sf_dir):
    return spread(table(spark, sf_dir, "orders"))


# -- S1 ---------------------------------------------------------------------------
ASHBY_JSON = """named_struct('name', 'Board ' || o_custkey, 'jobs', array(
  named_struct('id', CASE WHEN o_orderkey % 10 = 0 THEN 'undefined' ELSE CAST(o_orderkey AS STRING) END, 'title', CASE WHEN o_orderkey % 11 = 0 THEN '  ' ELSE ' Role  ' || o_orderpriority || ' ' END,
    'department', o_orderpriority, 'employmentType', 'FullTime', 'location', CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'Berlin' END,
    'secondaryLocations', array(named_struct('location', 'Paris', 'address', CAST(NULL AS STRUCT<postalAddress: STRUCT<addressLocality: STRING, addressCountry: STRING>>)),
                                named_struct('location', NULL, 'address', named_struct('postalAddress', named_struct('addressLocality', 'Rome', 'addressCountry', 'Italy')))),
    'address', named_struct('postalAddress', named_struct('addressLocality', ' NYC ', 'addressRegion', 'NY', 'postalCode', '10001')),
    'jobUrl', CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'https://x/' || o_orderkey END, 'publishedAt', date_format(o_orderdate, "yyyy-MM-dd'T'HH:mm:ss'Z'"), 'workplaceType', 'Hybrid', 'isRemote', o_orderkey % 2 = 0,
    'compensation', named_struct('summaryComponents', array(
        named_struct('compensationType', 'Bonus', 'minValue', 1D, 'maxValue', 2D, 'currencyCode', 'USD', 'interval', '1 YEAR'),
        named_struct('compensationType', CASE WHEN o_orderkey % 5 = 0 THEN 'EquityPercentage' ELSE 'Salary' END, 'minValue', o_totalprice, 'maxValue', CAST(NULL AS DOUBLE), 'currencyCode', 'EUR', 'interval', CASE o_orderkey % 3 WHEN 0 THEN '6 MONTH' WHEN 1 THEN '1 HOUR' ELSE NULL END))),
    'descriptionPlain', 'Body ' || o_orderpriority)))"""


@query("ashby_postings",
       "SELECT 'ashby:b' || o_custkey || ':' || o_orderkey AS id, 'Role  ' || o_orderpriority AS title, 'role ' || lower(o_orderpriority) AS title_norm, 'Board ' || o_custkey AS company_name, "
       "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Berlin|' END || 'Paris|Rome, Italy| NYC , NY' AS places, 'NYC' AS city, coalesce(CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'https://x/' || o_orderkey END, 'https://jobs.ashbyhq.com/b' || o_custkey) AS url, "
       "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS posted, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS comp_min, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS comp_max, "
       "CASE WHEN o_orderkey % 5 <> 0 THEN CASE o_orderkey % 3 WHEN 0 THEN 'HALF_YEAR' WHEN 1 THEN 'HOUR' ELSE 'NONE' END END AS per, CASE WHEN o_orderkey % 5 = 0 THEN 'yes' END AS equity "
       "FROM orders WHERE o_orderkey % 10 <> 0 AND o_orderkey % 11 <> 0")
def ashby_postings(spark, sf_dir):
    got = payloads.ashby_postings(_bodies(_orders(spark, sf_dir), ASHBY_JSON))
    return got.select("id", "title", "title_norm", "company_name", F.array_join("locations_all", "|").alias("places"), "city", "url",
                      F.date_format("posted_at", "yyyy-MM-dd HH:mm:ss").alias("posted"), "comp_min", "comp_max", F.col("comp_interval").alias("per"), F.when(F.col("has_equity"), "yes").alias("equity"))


# -- S2 ---------------------------------------------------------------------------
GREENHOUSE_JSON = """named_struct('jobs', array(
  named_struct('id', CAST(NULL AS BIGINT), 'title', 'No id', 'company_name', CASE WHEN o_custkey % 2 = 0 THEN 'Co ' || o_custkey END, 'departments', NULL, 'offices', NULL, 'location', NULL, 'first_published', NULL, 'updated_at', NULL,
    'absolute_url', NULL, 'pay_input_ranges', NULL, 'content', NULL),
  named_struct('id', o_orderkey, 'title', 'Role ' || o_orderpriority, 'company_name', NULL, 'departments', array(named_struct('name', ' '), named_struct('name', o_orderpriority)),
    'offices', array(named_struct('name', 'HQ', 'location', 'London'), named_struct('name', 'HQ', 'location', ' ')), 'location', named_struct('name', ' Berlin '),
    'first_published', CASE WHEN o_orderkey % 3 <> 0 THEN '2026-01-05T00:00:00Z' END, 'updated_at', '2026-02-01T00:00:00Z', 'absolute_url', CASE WHEN o_orderkey % 2 = 0 THEN 'https://g/' || o_orderkey END,
    'pay_input_ranges', array(named_struct('title', 'Sign-on bonus', 'min_cents', 100, 'max_cents', 200, 'currency_type', 'USD'), named_struct('title', 'OTE', 'min_cents', 1000, 'max_cents', 2000, 'currency_type', 'usd'),
        named_struct('title', CASE WHEN o_orderkey % 4 = 0 THEN 'Hourly rate' WHEN o_orderkey % 4 = 1 THEN 'Commission' ELSE 'Base' END, 'min_cents', CAST(o_orderkey * 100 AS BIGINT), 'max_cents', NULL, 'currency_type', 'eur')),
    'content', '&lt;p&gt;Hello &amp;amp; ' || o_orderpriority || '&lt;/p&gt;&lt;ul&gt;&lt;li&gt;One&lt;/li&gt;&lt;/ul&gt;')))"""


@query("greenhouse_postings",
       "SELECT 'greenhouse:b' || o_custkey || ':' || o_orderkey AS id, CASE WHEN o_custkey % 2 = 0 THEN 'Co ' || o_custkey END AS company_name, o_orderpriority AS department, 'Berlin|HQ|London' AS places, "
       "CASE WHEN o_orderkey % 3 <> 0 THEN '2026-01-05' ELSE '2026-02-01' END AS posted, CASE WHEN o_orderkey % 2 = 0 THEN 'https://g/' || o_orderkey ELSE 'https://job-boards.greenhouse.io/b' || o_custkey || '/jobs/' || o_orderkey END AS apply_url, "
       "CASE WHEN (o_orderkey % 4 = 1 OR o_orderkey = 0) THEN 10.0 ELSE o_orderkey::DOUBLE END AS comp_min, CASE WHEN (o_orderkey % 4 = 1 OR o_orderkey = 0) THEN 20.0 ELSE o_orderkey::DOUBLE END AS comp_max, CASE WHEN (o_orderkey % 4 = 1 OR o_orderkey = 0) THEN 'USD' ELSE 'EUR' END AS cur, "
       "CASE WHEN o_orderkey % 4 = 0 AND o_orderkey > 0 THEN 'HOUR' ELSE 'YEAR' END AS per, 'Hello & ' || o_orderpriority || chr(10) || chr(10) || 'One' AS text FROM orders")
def greenhouse_postings(spark, sf_dir):
    got = payloads.greenhouse_postings(_bodies(_orders(spark, sf_dir), GREENHOUSE_JSON))
    return got.select("id", "company_name", "department", F.array_join("locations_all", "|").alias("places"), F.date_format("posted_at", "yyyy-MM-dd").alias("posted"), "apply_url", "comp_min", "comp_max",
                      F.col("comp_currency").alias("cur"), F.col("comp_interval").alias("per"), F.col("description_text").alias("text"))


# -- S3 ---------------------------------------------------------------------------
LEVER_JSON = """array(named_struct('id', CAST(o_orderkey AS STRING), 'text', 'Role ' || o_orderpriority,
  'categories', named_struct('commitment', CASE o_orderkey % 4 WHEN 0 THEN 'Full-time' WHEN 1 THEN 'Full time / Contract' WHEN 2 THEN 'Freelancer' ELSE 'Co-op' END, 'department', ' ' || o_orderpriority, 'team', ' ', 'location', 'Berlin', 'allLocations', array('Berlin', 'Paris ')),
  'country', CASE o_orderkey % 3 WHEN 0 THEN 'de' WHEN 1 THEN 'CI' ELSE 'Germany' END, 'workplaceType', CASE o_orderkey % 3 WHEN 0 THEN 'OnSite' WHEN 1 THEN 'unspecified' ELSE 'remote' END, 'createdAt', unix_millis(CAST(o_orderdate AS TIMESTAMP)), 'hostedUrl', 'https://l/' || o_orderkey,
  'description', '<div>Intro</div>', 'lists', array(named_struct('text', 'Needs', 'content', '<li>a</li><li>b</li>'), named_struct('text', ' ', 'content', ' ')), 'additional', 'End',
  'salaryRange', CASE WHEN o_orderkey % 5 <> 0 THEN named_struct('min', CAST(o_orderkey AS DOUBLE), 'max', CAST(o_orderkey + 10 AS DOUBLE), 'currency', 'gbp', 'interval', CASE o_orderkey % 2 WHEN 0 THEN 'per-hour-wage' ELSE 'weird' END) END))"""


@query("lever_postings",
       "SELECT 'lever:b' || o_custkey || ':' || o_orderkey AS id, o_orderpriority AS department, CASE o_orderkey % 4 WHEN 0 THEN 'FullTime' WHEN 2 THEN 'Contract' WHEN 3 THEN 'Intern' END AS employment_type, 'Berlin|Paris' AS places, "
       "CASE o_orderkey % 3 WHEN 0 THEN 'Germany' WHEN 1 THEN 'Ivory Coast' END AS country, CASE o_orderkey % 3 WHEN 0 THEN 'onsite' WHEN 2 THEN 'remote' END AS raw_workplace, strftime(o_orderdate, '%Y-%m-%d') AS posted, "
       "'https://l/' || o_orderkey || '/apply' AS apply_url, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey + 10 AS DOUBLE) END AS comp_max, CASE WHEN o_orderkey % 5 <> 0 THEN 'GBP' END AS cur, "
       "CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 2 = 0 THEN 'HOUR' END AS per, 'Intro' || chr(10) || chr(10) || 'Needs' || chr(10) || chr(10) || 'a' || chr(10) || 'b' || chr(10) || chr(10) || 'End' AS text FROM orders")
def lever_postings(spark, sf_dir):
    got = payloads.lever_postings(_bodies(_orders(spark, sf_dir), LEVER_JSON))
    return got.select("id", "department", "employment_type", F.array_join("locations_all", "|").alias("places"), "country", "raw_workplace", F.date_format("posted_at", "yyyy-MM-dd").alias("posted"), "apply_url",
                      "comp_max", F.col("comp_currency").alias("cur"), F.col("comp_interval").alias("per"), F.col("description_text").alias("text"))


# -- S4, S5: a customer is a board, an order a listed path, an order line a page ----------
SLUG = "'t' || o_custkey || '|wd5|Site_' || o_custkey"
PATH = "'/job/x/Role%20' || o_orderkey"


def _workday(spark, sf_dir):
    o = _orders(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("page"))
    row = f"named_struct('title', 'Role ' || o_orderpriority || CASE WHEN page = 2 THEN ' again' ELSE '' END, 'externalPath', {PATH}, 'locationsText', CASE WHEN o_orderkey % 3 = 0 THEN '3 Locations' ELSE 'Oslo' END)"
    pages = o.join(lines, "o_orderkey").select(F.expr(SLUG).alias("slug"), "page", F.expr(f"to_json(named_struct('total', 1, 'jobPostings', array({row})))").alias("body"))
    info = ("named_struct('jobPostingInfo', named_struct('title', 'Full ' || o_orderpriority, 'jobDescription', '<p>Text</p>', 'location', CASE WHEN o_orderkey % 4 = 0 THEN '2 Locations' ELSE 'Bergen' END, "
            "'additionalLocations', array('Rome', '4 locations'), 'startDate', '2026-01-03', 'timeType', 'Full time', 'remoteType', 'Hybrid', 'country', named_struct('descriptor', 'Norway'), "
            "'externalUrl', 'https://t.wd5.myworkdayjobs.com/AcmeGroup_External_Careers/job/' || o_orderkey))")
    details = o.where("o_orderkey % 2 = 0").select(F.expr(SLUG).alias("slug"), F.expr(PATH).alias("path"), F.expr(f"to_json({info})").alias("body"))
    return pages, details


LISTED = "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"
FIRST = "(SELECT min(l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey)"


@query("workday_postings",
       f"WITH o AS (SELECT *, o_orderkey % 2 = 0 AS d, CASE WHEN o_orderkey % 3 <> 0 THEN 'Oslo' END AS listed, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 4 <> 0 THEN 'Bergen' END AS detailed, {FIRST} AS page FROM orders WHERE {LISTED}) "
       f"SELECT 'workday:' || {SLUG} || ':Role ' || o_orderkey AS id, CASE WHEN d THEN 'Full ' || o_orderpriority ELSE 'Role ' || o_orderpriority || CASE WHEN page = 2 THEN ' again' ELSE '' END END AS title, "
       "coalesce(detailed, listed) AS place, CASE WHEN detailed IS NOT NULL AND listed IS NOT NULL THEN 'Bergen|Oslo' ELSE coalesce(detailed, listed, '') END || CASE WHEN d THEN CASE WHEN detailed IS NULL AND listed IS NULL THEN 'Rome' ELSE '|Rome' END ELSE '' END AS places, "
       "CASE WHEN d THEN 'Norway' END AS country, CASE WHEN d THEN 'FullTime' END AS employment_type, CASE WHEN d THEN '2026-01-03' END AS posted, CASE WHEN d THEN 'Text' END AS text, d AS has_text, coalesce(detailed, listed) IS NOT NULL AS has_place, "
       f"CASE WHEN d THEN 'https://t.wd5.myworkdayjobs.com/AcmeGroup_External_Careers/job/' || o_orderkey ELSE 'https://t' || o_custkey || '.wd5.myworkdayjobs.com/Site_' || o_custkey || {PATH} END AS url FROM o")
def workday_postings(spark, sf_dir):
    got = payloads.workday_postings(*_workday(spark, sf_dir))
    return got.select("id", "title", F.col("location_raw").alias("place"), F.array_join("locations_all", "|").alias("places"), "country", "employment_type",
                      F.date_format("posted_at", "yyyy-MM-dd").alias("posted"), F.col("description_text").alias("text"), "has_text", "has_place", "url")


@query("workday_board_names", f"SELECT DISTINCT {SLUG} AS slug, 'Acme Group' AS name FROM orders WHERE o_orderkey % 2 = 0")
def workday_board_names(spark, sf_dir):
    return payloads.workday_board_names(_workday(spark, sf_dir)[1])


# A board of 100 pages with 20 paths each is cut off; suppliers with an even key are such boards.
@query("workday_truncated", "SELECT 't' || s_suppkey || '|wd1|s' AS slug FROM supplier WHERE s_suppkey % 2 = 0")
def workday_truncated(spark, sf_dir):
    s = spread(table(spark, sf_dir, "supplier")).select("s_suppkey", F.explode(F.sequence(F.lit(1), F.when(F.expr("s_suppkey % 2 = 0"), 100).otherwise(99))).alias("page"))
    rows = "transform(sequence(1, 20), i -> named_struct('title', 'T', 'externalPath', '/j/' || page || '-' || i))"
    pages = s.select(F.expr("'t' || s_suppkey || '|wd1|s'").alias("slug"), "page", F.expr(f"to_json(named_struct('total', 5000, 'jobPostings', {rows}))").alias("body"))
    return payloads.workday_truncated(pages)


# -- S6-S10 and slugs ----------------------------------------------------------------


def _part_bodies(spark, sf_dir, struct: str):
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(f"to_json({struct})").alias("body"))


@query("slug_list_json_array", "SELECT p_partkey, unnest([p_name, p_brand, 'tok' || p_partkey]) AS candidate FROM part")
def slug_list_json_array(spark, sf_dir):
    bodies = table(spark, sf_dir, "part").select("p_partkey", F.expr(
        "concat('{\"data\":[\"', p_name, '\",\"', p_brand, '\",{\"x\":1,\"token\":\"tok', p_partkey, '\"}]}')").alias("body"))
    return slug_lists.parse_slug_list(bodies, {"format": "json-array", "jsonPath": "data"})


@query("slug_list_json_objects",
       "SELECT p_partkey, unnest(['a' || p_partkey, 'b' || p_partkey]) AS candidate FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, 'c' || p_partkey FROM part WHERE p_brand <> 'Brand#1'")
def slug_list_json_objects(spark, sf_dir):
    bodies = _part_bodies(spark, sf_dir, "array(named_struct('kind', CASE WHEN p_size % 2 = 0 THEN 'LIVE' ELSE 'dead' END, 'slug', array('a' || p_partkey, 'b' || p_partkey)))")
    one = slug_lists.parse_slug_list(bodies, {"format": "json-objects", "slugKey": "slug", "where": {"kind": ["live", "new"]}})
    keyed = _part_bodies(spark, sf_dir, "named_struct('x', named_struct('brand', p_brand, 'slug', 'c' || p_partkey))")
    two = slug_lists.parse_slug_list(keyed, {"format": "json-objects", "slugKey": "slug", "where": {"brand": {"not": "brand#1"}}})
    return one.unionByName(two)


@query("slug_list_json_keys", "SELECT p_partkey, unnest(['k' || p_partkey, 'second']) AS candidate FROM part")
def slug_list_json_keys(spark, sf_dir):
    bodies = _part_bodies(spark, sf_dir, "map('k' || p_partkey, 1, 'second', 2)")
    return slug_lists.parse_slug_list(bodies, {"format": "json-keys"})


@query("slug_list_text_lines", "SELECT p_partkey, unnest([p_brand, 'x' || p_partkey]) AS candidate FROM part")
def slug_list_text_lines(spark, sf_dir):
    bodies = table(spark, sf_dir, "part").select("p_partkey", F.expr("'# note\\n ' || p_brand || '\\r\\n\\nx' || p_partkey").alias("body"))
    return slug_lists.parse_slug_list(bodies, {"format": "text-lines"})


@query("slug_list_scrape", "SELECT page_id, unnest(regexp_extract_all(split_part(split_part(html, '<nav>', 2), '</nav>', 1), 'href=\"/([^\"]+)\"', 1)) AS candidate FROM pages")
def slug_list_scrape(spark, sf_dir):
    bodies = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("body"))
    return slug_lists.parse_slug_list(bodies, {"format": "regex-scrape", "pattern": 'href="/([^"]+)"', "between": ["<nav>", "</nav>"]})


@query("slug_list_csv", "SELECT 'b' || c_custkey AS candidate FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery')")
def slug_list_csv(spark, sf_dir):
    """A CSV list written from customers to the shared folder, then read with a filter."""
    path = f"{checkpoint_root(spark)}/jobtide/list-{uuid.uuid4().hex}"
    table(spark, sf_dir, "customer").selectExpr("'b' || c_custkey AS slug", "c_mktsegment AS segment", "c_name || ', \"Inc\"' AS label").write.csv(path, header=True, escape='"')
    return slug_lists.read_csv_slugs(spark, path, {"column": "slug", "where": {"segment": ["Building", "MACHINERY"]}})


@query("commoncrawl_urls", "SELECT url FROM pages WHERE page_id % 3 <> 0")
def commoncrawl_urls(spark, sf_dir):
    lines = table(spark, sf_dir, "pages").select(F.expr("CASE page_id % 3 WHEN 0 THEN '{broken ' || url WHEN 1 THEN to_json(named_struct('url', url, 'status', '200')) ELSE to_json(named_struct('a', 1, 'url', url)) END").alias("value"))
    return slug_lists.commoncrawl_urls(lines)


@query("wayback_urls", "SELECT url FROM pages WHERE page_id % 4 <> 0 UNION ALL SELECT 'https://extra' FROM pages WHERE page_id % 4 <> 0")
def wayback_urls(spark, sf_dir):
    bodies = table(spark, sf_dir, "pages").select(F.expr("CASE WHEN page_id % 4 = 0 THEN 'oops' ELSE to_json(array(array('original'), array(url), array('https://extra'), array(''))) END").alias("body"))
    return slug_lists.wayback_urls(bodies)


CRAWLS = "SELECT n_nationkey AS pos, 'crawl-' || n_nationkey AS id FROM nation"


@query("unread_crawls", "SELECT 'known' AS kind, 'crawl-' || n_nationkey AS id FROM nation WHERE n_nationkey BETWEEN 9 AND 11 UNION ALL SELECT 'unknown', 'crawl-' || n_nationkey FROM nation WHERE n_nationkey < 3")
def unread_crawls(spark, sf_dir):
    listing = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS pos", "'crawl-' || n_nationkey AS id")
    known = slug_lists.unread_crawls(listing, "crawl-12", 3).select(F.lit("known").alias("kind"), "id")
    return known.unionByName(slug_lists.unread_crawls(listing, "crawl-99", 3).select(F.lit("unknown").alias("kind"), "id"))


RAW_SLUG = (
    "CASE c_custkey % 9 WHEN 0 THEN ' https://jobs.lever.co/Acme' || c_custkey || '/abc?x=1 ' WHEN 1 THEN 'https://api.lever.co/v0/postings/p' || c_custkey || '?mode=json' WHEN 2 THEN 'https://example.com/x' || c_custkey "
    "WHEN 3 THEN '/Foo' || c_custkey || '/?q=1' WHEN 4 THEN 'careers' WHEN 5 THEN 'a%2Db' || c_custkey WHEN 6 THEN '-bad' || c_custkey WHEN 7 THEN 'Co.' || c_custkey || '/jobs' ELSE '' END"
)
CLEAN_SLUG = "CASE c_custkey % 9 WHEN 0 THEN 'acme' || c_custkey WHEN 1 THEN 'p' || c_custkey WHEN 3 THEN 'foo' || c_custkey WHEN 5 THEN 'a-b' || c_custkey WHEN 7 THEN 'co.' || c_custkey END"


@query("slug_normalise", f"SELECT c_custkey, {CLEAN_SLUG} AS slug FROM customer")
def slug_normalise(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", S.normalize_slug(F.expr(RAW_SLUG), "lever").alias("slug"))


SCALARS = {
    "real_place": "CASE WHEN c_custkey % 2 = 0 THEN c_custkey || ' Locations' ELSE ' Oslo ' END", "path": "'/en/job/Role%2B' || c_custkey || '/'",
    "board": "CASE c_custkey % 3 WHEN 0 THEN 'acme | wd' || c_custkey || ' | Site_1' WHEN 1 THEN 'wd1|wd5|site' ELSE 'a|b' END",
    "when_": "CASE WHEN c_custkey % 3 = 0 THEN 'soon' ELSE '2026-01-02T03:04:05Z' END",
}


@query("board_scalars",
       "SELECT c_custkey, CASE WHEN c_custkey % 2 = 1 THEN 'Oslo' END AS place, 'Role+' || c_custkey AS native_id, CASE WHEN c_custkey % 3 = 0 THEN 'acme/wd' || c_custkey || '/Site_1' END AS board, "
       "'c:b' || c_custkey || ':n' AS job_id, 'https://c/?a=1&ashby_jid=x%2F' || c_custkey AS link, CASE WHEN c_custkey % 3 <> 0 THEN '2026-01-02 03:04:05' END AS at, CASE WHEN c_custkey % 3 <> 0 THEN 30 END AS age FROM customer")
def board_scalars(spark, sf_dir):
    e = {k: F.expr(v) for k, v in SCALARS.items()}
    board, at = S.parse_board_slug(e["board"]), S.to_epoch(e["when_"])
    key = F.col("c_custkey").cast("string")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", S.real_place(e["real_place"]).alias("place"), S.native_id_from_path(e["path"]).alias("native_id"),
        F.when(board.isNotNull(), F.concat_ws("/", board["tenant"], board["dc"], board["site"])).alias("board"), S.job_id(F.lit("c"), F.concat(F.lit("b"), key), F.lit("n")).alias("job_id"),
        S.external_job_url(F.lit("https://c/?a=1"), F.concat(F.lit("x/"), key)).alias("link"), F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at"),
        S.age_days(at, F.lit("2026-02-01").cast("timestamp")).alias("age"))


@query("content_hash",
       "SELECT o_orderkey, left(sha1(o_orderpriority || chr(0) || o_clerk_place || chr(0) || chr(0) || price || chr(0) || chr(0) || o_orderstatus || chr(0) || length(o_orderpriority)), 16) AS hash "
       "FROM (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 'x' ELSE '' END AS o_clerk_place, CASE WHEN o_totalprice = floor(o_totalprice) THEN CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) ELSE CAST(o_totalprice AS VARCHAR) END AS price FROM orders)")
def content_hash_query(spark, sf_dir):
    df = _orders(spark, sf_dir).selectExpr(
        "o_orderkey", "o_orderpriority AS title", "CASE WHEN o_orderkey % 2 = 0 THEN 'x' END AS location_raw", "CAST(NULL AS STRING) AS employment_type", "o_totalprice AS comp_min",
        "CAST(NULL AS DOUBLE) AS comp_max", "o_orderstatus AS department")
    return df.select("o_orderkey", content_hash(F.length("title")).alias("hash"))


# -- slug store ------------------------------------------------------------------------
SOURCES = ["s0", "s1", "s2", "s3"]
PREV = "CASE p_partkey % 4 WHEN 0 THEN {arr}('s0') WHEN 1 THEN {arr}('s0', 's1') WHEN 2 THEN {arr}('s2', 's3') ELSE {arr}('s1') END"
OBS = "CASE WHEN p_partkey % 3 = 0 THEN {arr}('s0') ELSE {arr}('s3', 's1') END"
WAS, SEEN = "p_partkey % 5 <> 0", "p_partkey % 2 = 0"
ATS = "CASE WHEN p_size > 25 THEN 'lever' ELSE 'ashby' END"


def _store(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    prev = p.where(WAS).select(F.expr(ATS).alias("ats"), F.expr("'s' || p_partkey").alias("slug"), F.expr(PREV.format(**SPARK)).alias("sources"),
                               F.lit("2025-01-01").cast("timestamp").alias("first_seen"), F.lit("2025-12-01").cast("timestamp").alias("last_seen"))
    obs = p.where(SEEN).select(F.expr(ATS).alias("ats"), F.expr("'s' || p_partkey").alias("slug"), F.expr(OBS.format(**SPARK)).alias("sources"))
    carried = p.select(F.expr(ATS).alias("ats")).distinct().where("ats = 'lever'").withColumn("source", F.lit("s1"))
    return prev, obs, carried


MERGED = (
    f"WITH p AS (SELECT p_partkey, {ATS} AS ats, {WAS} AS was, {SEEN} AS seen, {PREV.format(**DUCK)} AS prev, {OBS.format(**DUCK)} AS obs FROM part WHERE ({WAS}) OR ({SEEN})), "
    "k AS (SELECT *, CASE WHEN was THEN list_filter(prev, lambda s: s = 's2' OR (s = 's1' AND ats = 'lever') OR (seen AND list_contains(obs, s))) ELSE CAST([] AS VARCHAR[]) END AS kept FROM p), "
    "st AS (SELECT ats, 's' || p_partkey AS slug, list_sort(list_distinct(CASE WHEN seen THEN list_concat(kept, obs) ELSE kept END)) AS sources, was, prev FROM k)"
)


def _merged_store(spark, sf_dir, **kw):
    prev, obs, carried = _store(spark, sf_dir)
    return slugs.merge_slug_store(prev, obs, carried, "2026-02-02", incremental=["s2"], **kw)


@query("slug_store_merge", f"{MERGED} SELECT ats, slug, array_to_string(sources, ',') AS sources, CASE WHEN was THEN '2025-01-01' ELSE '2026-02-02' END AS first_seen, CASE WHEN len(sources) > 0 THEN '2026-02-02' ELSE '2025-12-01' END AS last_seen FROM st")
def slug_store_merge(spark, sf_dir):
    m = _merged_store(spark, sf_dir)
    return m.select("ats", "slug", F.array_join(F.array_sort("sources"), ",").alias("sources"), *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("first_seen", "last_seen")])


@query("slug_store_prune", f"{MERGED} SELECT ats, count(*) AS n FROM st WHERE len(sources) > 0 GROUP BY 1")
def slug_store_prune(spark, sf_dir):
    return _merged_store(spark, sf_dir, prune_after_days=30).groupBy("ats").agg(F.count(F.lit(1)).alias("n"))


@query("slug_store_diff", f"{MERGED} SELECT ats, slug, CASE WHEN len(sources) > 0 THEN 'added' ELSE 'removed' END AS change FROM st WHERE (len(sources) > 0) <> was")
def slug_store_diff(spark, sf_dir):
    return slugs.diff_slug_store(_store(spark, sf_dir)[0], _merged_store(spark, sf_dir))


@query("slug_store_totals", f"{MERGED} SELECT ats, count(*) FILTER (WHERE len(sources) > 0) AS active, count(*) AS total FROM st GROUP BY 1")
def slug_store_totals(spark, sf_dir):
    return slugs.store_totals(_merged_store(spark, sf_dir))


@query("source_contribution", f"{MERGED}, e AS (SELECT ats, unnest(sources) AS source, len(sources) = 1 AS alone FROM st) SELECT ats, source, count(*) AS total, count(*) FILTER (WHERE alone) AS \"unique\" FROM e GROUP BY 1, 2")
def source_contribution(spark, sf_dir):
    return slugs.source_contribution(_merged_store(spark, sf_dir))


@query("unread_source_carry", f"SELECT DISTINCT {ATS} AS ats, p_brand AS source FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 7)")
def unread_source_carry(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return slugs.unread_source_carry(p.select(F.col("p_brand").alias("source"), F.expr(ATS).alias("ats")), p.where("p_size = 7").select(F.col("p_brand").alias("source")))


@query("collect_observations",
       f"WITH c AS (SELECT {CLEAN_SLUG} AS slug, 'src' || c_nationkey AS source, c_mktsegment AS file FROM customer) "
       "SELECT 'file' AS kind, source || '/' || file AS key, count(DISTINCT slug) || '/' || count(*) FILTER (WHERE slug IS NULL) AS value FROM c GROUP BY source, file "
       "UNION ALL SELECT 'slug', slug, string_agg(DISTINCT source, ',' ORDER BY source) FROM c WHERE slug IS NOT NULL GROUP BY slug")
def collect_observations(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.lit("lever").alias("ats"), F.expr("'src' || c_nationkey").alias("source"), F.col("c_mktsegment").alias("file"), F.expr(RAW_SLUG).alias("candidate"))
    observed, files = slug_lists.collect_observations(c, ["lever"])
    return files.select(F.lit("file").alias("kind"), F.concat_ws("/", "source", "file").alias("key"), F.concat_ws("/", F.col("accepted").cast("string"), F.col("rejected").cast("string")).alias("value")).unionByName(
        observed.select(F.lit("slug").alias("kind"), F.col("slug").alias("key"), F.array_join("sources", ",").alias("value")))


KNOWN, PROBED = "p_partkey % 3 <> 0", "p_partkey % 4 <> 3"
OLD_STATUS = "CASE WHEN p_partkey % 2 = 0 THEN 'exists' ELSE 'dead' END"
PROBE = "CASE p_partkey % 4 WHEN 0 THEN 'exists' WHEN 1 THEN 'dead' ELSE 'error' END"


def _verdicts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    none = "CAST(NULL AS STRING)"
    old = p.where(KNOWN).selectExpr(
        f"{ATS} AS ats", "'s' || p_partkey AS slug", f"{OLD_STATUS} AS status", "TIMESTAMP'2025-01-01' AS checked_at", "'Old' AS name", f"{none} AS website", f"{none} AS careers_url",
        "CAST(NULL AS BOOLEAN) AS allow_indexing", "CAST(NULL AS BOOLEAN) AS hosted_disabled", "CASE WHEN p_partkey % 5 = 0 THEN 'HTTP 500' END AS last_error", "CAST(NULL AS TIMESTAMP) AS last_error_at")
    probe = p.where(PROBED).selectExpr(f"{ATS} AS ats", "'s' || p_partkey AS slug", f"{PROBE} AS status", f"CASE WHEN {PROBE} = 'error' THEN 'HTTP 503' END AS error", f"CASE WHEN p_partkey % 8 = 0 THEN 'New' END AS name")
    return old, probe


VERDICT_CTE = (
    f"v AS (SELECT {ATS} AS ats, 's' || p_partkey AS slug, CASE WHEN ({PROBED}) AND {PROBE} <> 'error' THEN {PROBE} WHEN {KNOWN} THEN {OLD_STATUS} END AS status, "
    f"CASE WHEN ({PROBED}) AND {PROBE} <> 'error' AND p_partkey % 8 = 0 THEN 'New' WHEN {KNOWN} THEN 'Old' END AS name, "
    f"CASE WHEN ({PROBED}) AND {PROBE} = 'error' THEN 'HTTP 503' WHEN ({PROBED}) THEN NULL WHEN ({KNOWN}) AND p_partkey % 5 = 0 THEN 'HTTP 500' END AS last_error FROM part WHERE ({KNOWN}) OR ({PROBED}))"
)


@query("merge_verdicts", f"WITH {VERDICT_CTE} SELECT * FROM v")
def merge_verdicts(spark, sf_dir):
    return slugs.merge_verdicts(*_verdicts(spark, sf_dir), "2026-02-02").select("ats", "slug", "status", "name", "last_error")


@query("unresolved_candidates", f"{MERGED}, {VERDICT_CTE} SELECT ats, slug FROM st LEFT JOIN v USING (ats, slug) WHERE len(sources) > 0 AND status IS NULL")
def unresolved_candidates(spark, sf_dir):
    return slugs.unresolved_candidates(_merged_store(spark, sf_dir), slugs.merge_verdicts(*_verdicts(spark, sf_dir), "2026-02-02"))


@query("source_quality",
       f"{MERGED}, {VERDICT_CTE}, e AS (SELECT st.ats, unnest(sources) AS source, len(sources) = 1 AS alone, coalesce(status, 'unprobed') AS status FROM st LEFT JOIN v USING (ats, slug) WHERE len(sources) > 0) "
       "SELECT ats, source, count(*) AS total, count(*) FILTER (WHERE status = 'exists') AS live, count(*) FILTER (WHERE status = 'dead') AS dead, count(*) FILTER (WHERE status NOT IN ('exists', 'dead')) AS unprobed, "
       "count(*) FILTER (WHERE alone AND status <> 'dead') AS only, CAST(floor(100.0 * count(*) FILTER (WHERE status = 'dead') / nullif(count(*) FILTER (WHERE status IN ('exists', 'dead')), 0) + 0.5) AS BIGINT) AS dead_percent FROM e GROUP BY 1, 2")
def source_quality(spark, sf_dir):
    return slugs.source_quality(_merged_store(spark, sf_dir), slugs.merge_verdicts(*_verdicts(spark, sf_dir), "2026-02-02"))


@query("origin_coverage",
       f"{MERGED}, {VERDICT_CTE}, e AS (SELECT st.ats, list_has_any(sources, ['s1', 's2']) AS web, len(list_filter(sources, lambda s: s NOT IN ('s1', 's2', 'manual'))) > 0 AS repo FROM st JOIN v USING (ats, slug) WHERE len(sources) > 0 AND status = 'exists') "
       "SELECT ats, count(*) FILTER (WHERE repo) AS repos, count(*) FILTER (WHERE repo AND NOT web) AS repos_only, count(*) FILTER (WHERE web) AS web, count(*) FILTER (WHERE web AND NOT repo) AS web_only, count(*) FILTER (WHERE web OR repo) AS \"union\" FROM e GROUP BY 1")
def origin_coverage(spark, sf_dir):
    return slugs.origin_coverage(_merged_store(spark, sf_dir), slugs.merge_verdicts(*_verdicts(spark, sf_dir), "2026-02-02"), ["s1", "s2"])


SITE = "CASE c_custkey % 4 WHEN 0 THEN 'acme' || c_custkey || '_external_careers' WHEN 1 THEN 'external-foo' || c_custkey WHEN 2 THEN 'careers' ELSE 'bar' || c_custkey || '-jobs' END"


@query("recover_tenants",
       f"WITH t AS (SELECT c_custkey, {SITE} AS site FROM customer WHERE c_custkey % 4 <> 2 AND c_custkey % 10 <> 0) SELECT CASE c_custkey % 4 WHEN 0 THEN 'acme' || c_custkey WHEN 1 THEN 'foo' || c_custkey ELSE 'bar' || c_custkey END || '|wd3|' || site AS slug, "
       "CASE c_custkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 2 ELSE 2 END AS rank FROM t WHERE c_custkey % 7 <> 0")
def recover_tenants(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    store = c.select(F.expr(f"'WD3|wd1|' || {SITE}").alias("slug"))
    attempts = c.where("c_custkey % 10 = 0").select(F.expr(f"'wd3|wd1|' || {SITE}").alias("slug"), F.lit("dead").alias("verdict"))
    owner = "CASE c_custkey % 4 WHEN 0 THEN 'acme' || c_custkey WHEN 1 THEN 'foo' || c_custkey ELSE 'bar' || c_custkey END"
    probes = c.select(F.expr(owner).alias("tenant"), F.lit("wd3").alias("dc"), F.expr(SITE).alias("site"), F.expr("c_custkey % 7 <> 0").alias("live"))
    return slugs.recover_tenants(slugs.repair_targets(store, attempts), probes).select("slug", "rank")


# -- lists read in splits ---------------------------------------------------------------------


def _list_file(df, fmt: str, **options) -> str:
    """A list in the shared folder: one file while it is small, else one a task."""
    path = f"{checkpoint_root(df.sparkSession).rstrip('/')}/jobtide/list-{uuid.uuid4().hex}"
    df.write.format(fmt).options(**options).save(path)
    return path


@query("slug_list_json_split", "SELECT 's' || doc_id AS candidate, CASE WHEN doc_id % 3 = 0 THEN length(text) END AS n FROM documents WHERE text IS NOT NULL")
def slug_list_json_split(spark, sf_dir):
    """One JSON array of whole texts, full of commas, quotes and brackets, in files that follow each other, read in splits: an entry is an object or a string."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    entry = F.when(F.col("doc_id") % 3 == 0, F.to_json(F.struct(F.concat(F.lit("s"), "doc_id").alias("slug"), F.struct("text", F.array("source", "text").alias("more")).alias("body")))).otherwise(
        F.concat(F.lit('"s'), "doc_id", F.lit('"')))
    ends = F.broadcast(d.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).withColumn("_one", F.lit(1)))
    rows = d.withColumn("_one", F.lit(1)).join(ends, "_one").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    text = F.concat(F.when(F.col("doc_id") == F.col("low"), "[").otherwise(""), entry, F.when(F.col("doc_id") == F.col("high"), "]").otherwise(""))
    path = _list_file(rows.select(text.alias("value")), "text", lineSep=",")
    found = records.json_elements(spark, path, one=True)
    length = F.length(F.get_json_object("value", "$.body.more[1]"))
    return found.select(F.coalesce(F.get_json_object("value", "$.slug"), "value").alias("candidate"), length.alias("n"))


@query("slug_list_csv_split", "SELECT 's' || doc_id AS slug, md5(text) AS note FROM documents WHERE text IS NOT NULL AND trim(text, ' ' || chr(10) || chr(9) || chr(13)) <> ''")
def slug_list_csv_split(spark, sf_dir):
    """CSV files whose quoted cells hold whole texts with their line ends and quotes, read in splits."""
    d = table(spark, sf_dir, "documents").where("text is not null").where(F.regexp_replace("text", "\\s", "") != "").select(F.concat(F.lit("s"), "doc_id").alias("slug"), F.col("text").alias("the note"))
    path = _list_file(d.hint("rebalance"), "csv", header="true", quoteAll="true", escape='"', ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false")
    return records.csv_records(spark, path, ["slug", "the note"]).select("slug", F.md5("the note").alias("note"))


# -- sinks ---------------------------------------------------------------------------------


@query("write_corpus", "SELECT o_orderstatus AS ats, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def write_corpus(spark, sf_dir):
    """Two versions are written; readers see the last published one."""
    root = f"{checkpoint_root(spark)}/jobtide/corpus-{uuid.uuid4().hex}"
    posts = _orders(spark, sf_dir).selectExpr("'o' || o_orderkey AS id", "o_orderstatus AS ats", "o_totalprice")
    sink.write_corpus({"postings": posts.where("ats = 'O'"), "companies": table(spark, sf_dir, "customer")}, root, "1")
    sink.write_corpus({"postings": posts, "companies": table(spark, sf_dir, "customer")}, root, "2")
    return sink.read_table(spark, root, "postings").groupBy("ats").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("append_run_history", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS new_jobs FROM events GROUP BY 1")
def append_run_history(spark, sf_dir):
    path = f"{checkpoint_root(spark)}/jobtide/history-{uuid.uuid4().hex}"
    runs = table(spark, sf_dir, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("new_jobs"))
    sink.append_run_history(runs.where("day < '2024-01-10'"), path)
    sink.append_run_history(runs.where("day >= '2024-01-10'"), path)
    return spark.read.schema("day string, new_jobs long").json(path)


CODES = sorted(COUNTRY_NAMES)
CODE_SQL = f"[{', '.join(repr(c) for c in CODES)}][c_custkey % {len(CODES)} + 1]"
NAME_SQL = "map {" + ", ".join(f"'{c}': '{n}'" for c, n in COUNTRY_NAMES.items()) + "}"


@query("country_name",
       f"SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 THEN NULL ELSE ({NAME_SQL})[{CODE_SQL}] END AS name FROM customer")
def country_name(spark, sf_dir):
    """Every code, in either case and with spaces about it; three letters, or a name, are no code."""
    code = F.element_at(F.lit(CODES), (F.col("c_custkey") % len(CODES) + 1).cast("int"))
    written = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" "), F.lower(code), F.lit(" "))).when(F.col("c_custkey") % 3 == 1, F.concat(code, F.lit("X"))).otherwise(code)
    return table(spark, sf_dir, "customer").select("c_custkey", S.country_name(written).alias("name"))
