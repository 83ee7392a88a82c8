"""Snapshot merge, event log and change reports: registered queries and their SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import changes, snapshot
from ..plans import daily, many
from ..plans.textstore import TokenStore
from ..schemas import BOARDS, COMPANIES, POSTINGS_RAW, SNAPSHOT, columns
from ..session import checkpoint_root, materialize
from . import views
from .registry import query, spread, table

NOW, DAY, BEFORE = "2026-02-02 06:00:00", "2026-02-02", "2026-02-01 06:00:00"


def _types(ddl: str) -> dict:
    from pyspark.sql.types import StructType

    return {f.name: f.dataType for f in StructType.fromDDL(ddl).fields}


def fill(df, ddl: str, **made):
    """Frame of a table schema: given expressions, NULL for the rest."""
    types = _types(ddl)
    return df.select(*[(F.expr(made[c]) if c in made else F.lit(None)).cast(types[c]).alias(c) for c in columns(ddl)])


# Orders as postings: a customer is a board. Which rows are stored, delivered, changed or unread is a matter of keys.
STORED, DELIVERED = "o_orderkey % 7 <> 0", "o_orderkey % 5 <> 1"
OUTCOME = "CASE o_custkey % 10 WHEN 0 THEN 'dead' WHEN 1 THEN 'unchanged' WHEN 2 THEN 'error' WHEN 3 THEN NULL ELSE 'swept' END"
WAS_OPEN = "o_orderkey % 6 <> 5"
READ, PLACED = "o_orderkey % 4 <> 2", "o_orderkey % 9 <> 4"
OLD_PLACE = "'Old ' || o_orderpriority"
NEW_PLACE = "CASE WHEN o_orderkey % 8 = 3 THEN NULL ELSE 'New ' || o_orderpriority END"
OLD_TITLE, NEW_TITLE = "'Role ' || CAST(o_orderkey AS {str})", "'Role ' || CAST(o_orderkey AS {str}) || CASE WHEN o_orderkey % 11 = 0 THEN '!' ELSE '' END"
OLD_TEXT = "CASE WHEN o_orderkey % 13 <> 0 THEN 'Text ' || o_orderpriority END"
NEW_TEXT = "CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 'Text ' || o_orderpriority ELSE 'Longer text ' || o_orderpriority END"
ID = "'ashby:b' || CAST(o_custkey AS {str}) || ':' || CAST(o_orderkey AS {str})"
BOARD = "'ashby:b' || CAST(o_custkey AS {str})"
SPARK = views.SPARK


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders")


def current(spark, sf_dir):
    """Stored postings with their hashes, as an earlier sweep of the same merge would have left them."""
    o = _orders(spark, sf_dir).where(STORED)
    text_length = f"length({OLD_TEXT})"
    df = fill(
        o, POSTINGS_RAW, id=ID.format(**SPARK), ats="'ashby'", company_id=BOARD.format(**SPARK), company_slug="'b' || o_custkey", company_name="'Known'",
        native_id="CAST(o_orderkey AS STRING)", title=OLD_TITLE.format(**SPARK), location_raw=OLD_PLACE, locations_all=f"array({OLD_PLACE})", country="'us'",
        posted_at="o_orderdate", first_seen=f"TIMESTAMP'{BEFORE}'", last_seen=f"TIMESTAMP'{BEFORE}'", is_open=WAS_OPEN, text_length=text_length,
        comp_min="o_totalprice", department="o_orderpriority", d_derived_at=f"TIMESTAMP'{BEFORE}'", url="'u'", apply_url="'a'")
    return df.withColumn("content_hash", snapshot.content_hash(F.coalesce("text_length", F.lit(0))))


def stored_text(spark, sf_dir):
    return _orders(spark, sf_dir).where(STORED).select(F.expr(ID.format(**SPARK)).alias("id"), F.expr(OLD_TEXT).alias("text"))


def delivered(spark, sf_dir):
    return fill(
        _orders(spark, sf_dir).where(DELIVERED), SNAPSHOT, id=ID.format(**SPARK), ats="'ashby'", company_slug="'b' || o_custkey",
        native_id="CAST(o_orderkey AS STRING)", title=NEW_TITLE.format(**SPARK), department="o_orderpriority", location_raw=NEW_PLACE,
        locations_all=f"CASE WHEN {NEW_PLACE} IS NOT NULL THEN array({NEW_PLACE}) END", comp_min="o_totalprice", description_text=NEW_TEXT, has_text=READ,
        has_place=PLACED, url="'u2'")


def boards(spark, sf_dir):
    c = _orders(spark, sf_dir).select("o_custkey").distinct().where(f"{OUTCOME} IS NOT NULL")
    return fill(c, BOARDS, ats="'ashby'", slug="'b' || o_custkey", outcome=OUTCOME, name="CASE WHEN o_custkey % 4 = 0 THEN 'Board ' || o_custkey END", etag="'e'")


def _hash_sql(title: str, place: str, length: str) -> str:
    price = "CASE WHEN o_totalprice = floor(o_totalprice) THEN CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) ELSE CAST(o_totalprice AS VARCHAR) END"
    parts = [title, f"coalesce({place}, '')", "''", price, "''", "o_orderpriority", f"CAST({length} AS VARCHAR)"]
    return "left(sha1(" + " || chr(0) || ".join(f"({p})" for p in parts) + "), 16)"


DUCK = views.DUCK
MERGE = (
    f"WITH o AS (SELECT *, {ID.format(**DUCK)} AS id, {STORED} AS stored, {OUTCOME} AS outcome, {WAS_OPEN} AS was_open, {READ} AS has_text, {PLACED} AS has_place, "
    f"{OLD_PLACE} AS old_place, {NEW_PLACE} AS new_place, {OLD_TITLE.format(**DUCK)} AS old_title, {NEW_TITLE.format(**DUCK)} AS new_title, {OLD_TEXT} AS old_text, {NEW_TEXT} AS new_text, "
    f"({DELIVERED}) AND coalesce({OUTCOME} = 'swept', false) AS arrived FROM orders WHERE ({STORED}) OR (({DELIVERED}) AND coalesce({OUTCOME} = 'swept', false))), "
    "n AS (SELECT *, CASE WHEN has_text THEN coalesce(length(new_text), 0) ELSE coalesce(CASE WHEN stored THEN length(old_text) END, 0) END AS new_len, coalesce(length(old_text), 0) AS old_len FROM o), "
    f"h AS (SELECT *, {_hash_sql('old_title', 'old_place', 'old_len')} AS old_hash, {_hash_sql('new_title', 'CASE WHEN has_place THEN new_place END', 'new_len')} AS new_hash FROM n), "
    "m AS (SELECT *, arrived AND (NOT stored OR old_hash <> new_hash) AS moved, stored AND NOT arrived AND coalesce(outcome = 'swept', false) AND was_open AS closes FROM h), "
    "e AS (SELECT id, unnest(list_filter([CASE WHEN arrived AND NOT stored THEN 'appeared' END, CASE WHEN arrived AND stored AND NOT was_open THEN 'reappeared' END, "
    "CASE WHEN arrived AND stored AND moved THEN 'changed' END, CASE WHEN closes THEN 'disappeared' END], lambda x: x IS NOT NULL)) AS event FROM m)"
)
STATE = (
    f"SELECT id, CASE WHEN arrived THEN new_title ELSE old_title END AS title, CASE WHEN arrived THEN coalesce(CASE WHEN has_place THEN new_place END, CASE WHEN stored THEN old_place END) ELSE old_place END AS location_raw, "
    "CASE WHEN arrived AND NOT stored THEN CASE WHEN o_custkey % 4 = 0 THEN 'Board ' || o_custkey END WHEN arrived THEN coalesce(CASE WHEN o_custkey % 4 = 0 THEN 'Board ' || o_custkey END, 'Known') ELSE 'Known' END AS company_name, "
    "CASE WHEN arrived THEN true WHEN closes OR coalesce(outcome = 'dead', false) THEN false ELSE was_open END AS is_open, "
    f"CASE WHEN arrived OR closes OR (coalesce(outcome = 'unchanged', false) AND was_open) THEN '{DAY}' ELSE '2026-02-01' END AS last_seen, CASE WHEN stored THEN '2026-02-01' ELSE '{DAY}' END AS first_seen, "
    "CASE WHEN stored AND NOT moved THEN 1 ELSE 0 END AS still_derived, CASE WHEN arrived THEN new_hash ELSE old_hash END AS content_hash FROM m"
)


def _merged(spark, sf_dir):
    return snapshot.merge_snapshot(current(spark, sf_dir), stored_text(spark, sf_dir), delivered(spark, sf_dir), boards(spark, sf_dir), NOW, DAY)


@query("merge_snapshot", f"{MERGE} {STATE}")
def merge_snapshot(spark, sf_dir):
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return _merged(spark, sf_dir).postings.select(
        "id", "title", "location_raw", "company_name", "is_open", day("last_seen"), day("first_seen"),
        F.col("d_derived_at").isNotNull().cast("int").alias("still_derived"), "content_hash")


@query("merge_events", f"{MERGE} SELECT id, '{DAY}' AS day, event FROM e")
def merge_events(spark, sf_dir):
    return _merged(spark, sf_dir).events.select("id", F.col("day").cast("string").alias("day"), "event")


@query("merge_text", f"{MERGE} SELECT id, CASE WHEN arrived AND has_text THEN new_text WHEN stored THEN old_text END AS text FROM m WHERE stored OR has_text")
def merge_text(spark, sf_dir):
    """Text of boards swept today; unread text stays."""
    return _merged(spark, sf_dir).text


@query("append_events", f"{MERGE}, old AS (SELECT id, '{DAY}' AS day, event FROM e WHERE event = 'changed' UNION SELECT id, '2026-01-01', 'appeared' FROM m WHERE stored) "
       f"SELECT * FROM old UNION SELECT id, '{DAY}', event FROM e")
def append_events(spark, sf_dir):
    """A repeated run of the same day adds nothing twice."""
    today = _merged(spark, sf_dir).events
    first = current(spark, sf_dir).select("id", F.lit("2026-01-01").cast("date").alias("day"), F.lit("appeared").alias("event"))
    log = today.where("event = 'changed'").unionByName(first)
    return snapshot.append_events(log, today).select("id", F.col("day").cast("string").alias("day"), "event")


@query("sweep_totals",
       f"{MERGE}, b AS (SELECT o_custkey, {OUTCOME} AS outcome, count(*) FILTER (WHERE {DELIVERED}) AS jobs FROM orders GROUP BY 1) "
       "SELECT 'ashby' AS ats, count(*) AS boards, count(*) FILTER (WHERE outcome = 'swept' AND jobs > 0) AS live, count(*) FILTER (WHERE outcome = 'swept' AND jobs = 0) AS empty, "
       "count(*) FILTER (WHERE outcome = 'dead') AS dead, count(*) FILTER (WHERE outcome = 'error') AS errors, count(*) FILTER (WHERE outcome = 'unchanged') AS unchanged, "
       "CAST(sum(jobs) FILTER (WHERE outcome = 'swept') AS BIGINT) AS jobs, (SELECT count(*) FROM e WHERE event = 'appeared') AS added, (SELECT count(*) FROM e WHERE event = 'changed') AS changed, "
       "(SELECT count(*) FROM e WHERE event = 'disappeared') AS closed FROM b WHERE outcome IS NOT NULL")
def sweep_totals(spark, sf_dir):
    m = _merged(spark, sf_dir)
    return snapshot.sweep_totals(m.joined, m.events, boards(spark, sf_dir))


def companies(spark, sf_dir, known="c_custkey % 3 <> 0"):
    """Stored companies; by default a slice, so that boards without a company row are met too."""
    c = table(spark, sf_dir, "customer").where(known)
    return fill(c, COMPANIES, id="'ashby:b' || c_custkey", ats="'ashby'", slug="'b' || c_custkey", name="CASE WHEN c_custkey % 5 <> 0 THEN c_name END", name_source="CASE WHEN c_custkey % 5 <> 0 THEN 'api' END",
                job_count="1L", first_seen=f"TIMESTAMP'{BEFORE}'", last_seen=f"TIMESTAMP'{BEFORE}'", status="'live'", discovery="CASE WHEN c_custkey % 2 = 0 THEN 'list' END")


@query("merge_companies",
       f"WITH b AS (SELECT o_custkey AS k, {OUTCOME} AS outcome, count(*) FILTER (WHERE {DELIVERED}) AS jobs FROM orders GROUP BY 1, 2 HAVING {OUTCOME} IS NOT NULL), c AS (SELECT c_custkey AS k, c_name FROM customer WHERE c_custkey % 3 <> 0) "
       "SELECT 'ashby:b' || k AS id, coalesce(CASE WHEN outcome = 'swept' AND k % 4 = 0 THEN 'Board ' || k END, CASE WHEN k % 5 <> 0 THEN c_name END) AS name, "
       "CASE WHEN outcome = 'swept' THEN CASE WHEN jobs > 0 THEN 'live' ELSE 'empty' END WHEN outcome IN ('dead', 'error') THEN outcome WHEN c_name IS NOT NULL THEN 'live' END AS status, "
       "CASE WHEN outcome = 'swept' THEN jobs WHEN c_name IS NOT NULL THEN 1 ELSE 0 END AS job_count, "
       f"CASE WHEN outcome IN ('swept', 'unchanged') OR c_name IS NULL THEN '{DAY}' ELSE '2026-02-01' END AS last_seen, CASE WHEN outcome IS NOT NULL THEN '{DAY}' END AS last_swept FROM c FULL JOIN b USING (k)")
def merge_companies(spark, sf_dir):
    counts = delivered(spark, sf_dir).groupBy(F.concat_ws(":", "ats", "company_slug").alias("company_id")).agg(F.count(F.lit(1)).alias("jobs"))
    out = snapshot.merge_companies(companies(spark, sf_dir), boards(spark, sf_dir), counts, NOW)
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return out.select("id", "name", "status", "job_count", day("last_seen"), day("last_swept"))


RESOLVED_NAME, CAREERS = "CASE WHEN o_custkey % 3 = 0 THEN ' Org ' || o_custkey END", "'https://c.example.com/' || CASE WHEN o_custkey % 2 = 0 THEN 'jobs' ELSE 'jobs?x=1' END"
LINK = f"{CAREERS} || CASE WHEN o_custkey % 2 = 0 THEN '?' ELSE '&' END || 'ashby_jid=' || o_orderkey"


def _orgs(spark, sf_dir):
    return _orders(spark, sf_dir).select("o_custkey").distinct().where("o_custkey % 4 <> 3").selectExpr(
        "'ashby' AS ats", "'b' || o_custkey AS slug", f"{RESOLVED_NAME} AS name", "CAST(NULL AS STRING) AS website", f"{CAREERS} AS careers_url", "o_custkey % 4 = 1 AS hosted_disabled")


@query("apply_resolved_boards",
       f"SELECT {ID.format(**DUCK)} AS id, CASE WHEN o_custkey % 4 <> 3 THEN trim({RESOLVED_NAME}) END AS company_name, CASE WHEN o_custkey % 4 = 1 THEN {LINK} ELSE 'u2' END AS url FROM orders WHERE {DELIVERED}")
def apply_resolved_boards(spark, sf_dir):
    return snapshot.apply_resolved_boards(delivered(spark, sf_dir), _orgs(spark, sf_dir)).select("id", "company_name", "url")


@query("repair_links",
       f"SELECT {ID.format(**DUCK)} AS id, coalesce(CASE WHEN o_custkey % 4 <> 3 THEN {RESOLVED_NAME} END, 'Known') AS company_name, CASE WHEN o_custkey % 4 = 1 THEN {LINK} ELSE 'u' END AS url, "
       f"CASE WHEN o_custkey % 4 <> 1 THEN 'a' END AS apply_url FROM orders WHERE {STORED}")
def repair_links(spark, sf_dir):
    return snapshot.repair_links(current(spark, sf_dir), _orgs(spark, sf_dir)).select("id", "company_name", "url", "apply_url")


@query("repair_companies",
       "WITH g AS (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey % 4 <> 3) SELECT 'b' || c_custkey AS slug, "
       f"coalesce(CASE WHEN g.o_custkey IS NOT NULL THEN {RESOLVED_NAME} END, CASE WHEN c_custkey % 5 <> 0 THEN c_name END) AS name FROM customer LEFT JOIN g ON g.o_custkey = c_custkey")
def repair_companies(spark, sf_dir):
    return snapshot.repair_companies(companies(spark, sf_dir, "true"), _orgs(spark, sf_dir)).select("slug", "name")


@query("needs_detail",
       f"SELECT {ID.format(**DUCK)} AS id FROM orders WHERE NOT (({STORED}) AND coalesce(length({OLD_TEXT}), 0) > 0 AND o_orderkey % 17 <> 2)")
def needs_detail(spark, sf_dir):
    listing = _orders(spark, sf_dir).select(F.expr(ID.format(**SPARK)).alias("id"))
    stored = current(spark, sf_dir).withColumn("location_raw", F.when(F.expr("CAST(native_id AS BIGINT) % 17 = 2"), "3 Locations").otherwise(F.col("location_raw")))
    return snapshot.needs_detail(listing, stored)


def _attempts(spark, sf_dir, stored="k % 3 <> 0"):
    p = table(spark, sf_dir, "part")
    base = p.selectExpr("CASE p_partkey % 2 WHEN 0 THEN 'lever' ELSE 'ashby' END AS ats", "'s' || p_partkey AS slug", "200 AS status", "'live' AS verdict", "'old' AS strategy",
                        "CAST(NULL AS STRING) AS seed", "1 AS rank", f"TIMESTAMP'{BEFORE}' AS tried_at", "p_partkey AS k")
    tried = base.where("k % 4 < 2").withColumns({"status": F.lit(404), "verdict": F.lit("dead"), "strategy": F.lit("new"), "tried_at": F.lit(NOW).cast("timestamp")})
    return base.where(stored).drop("k"), tried.drop("k")


@query("record_attempts",
       "SELECT CASE p_partkey % 2 WHEN 0 THEN 'lever' ELSE 'ashby' END AS ats, 's' || p_partkey AS slug, CASE WHEN p_partkey % 4 < 2 THEN 'dead' ELSE 'live' END AS verdict, "
       "CASE WHEN p_partkey % 3 <> 0 THEN 'old' ELSE 'new' END AS strategy FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 4 < 2")
def record_attempts(spark, sf_dir):
    return snapshot.record_attempts(*_attempts(spark, sf_dir)).select("ats", "slug", "verdict", "strategy")


@query("known_slugs", "SELECT 's' || p_partkey AS slug FROM part WHERE p_partkey % 2 = 0")
def known_slugs(spark, sf_dir):
    return snapshot.known_slugs(_attempts(spark, sf_dir, "true")[0], "lever")


@query("record_sectors",
       "SELECT 'ashby:b' || c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'ai' END AS sector, CASE WHEN c_custkey % 2 = 0 THEN 'Does ' || c_mktsegment END AS blurb, "
       f"CASE WHEN c_custkey % 2 = 0 THEN '{DAY}' END AS sector_at FROM customer")
def record_sectors(spark, sf_dir):
    read = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").selectExpr(
        "'ashby:b' || c_custkey AS id", "CASE WHEN c_custkey % 4 = 0 THEN 'ai' ELSE 'unheard-of' END AS sector", "' Does ' || c_mktsegment AS blurb", "'m' AS src", f"TIMESTAMP'{NOW}' AS at")
    out = snapshot.record_sectors(companies(spark, sf_dir, "true"), read)
    return out.select("id", "sector", "blurb", F.date_format("sector_at", "yyyy-MM-dd").alias("sector_at"))


@query("fill_company_names",
       "WITH c AS (SELECT 'ashby:b' || c_custkey AS id, CASE WHEN c_custkey % 5 <> 0 THEN c_name ELSE 'B' || c_custkey END AS name, c_custkey FROM customer WHERE c_custkey % 3 <> 0) "
       f"SELECT {ID.format(**DUCK)} AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'Known' ELSE c.name END AS company_name FROM orders LEFT JOIN c ON c_custkey = o_custkey WHERE {STORED}")
def fill_company_names(spark, sf_dir):
    posts = current(spark, sf_dir).withColumn("company_name", F.when(F.expr("CAST(native_id AS BIGINT) % 2 = 0"), F.col("company_name")))
    return snapshot.fill_company_names(companies(spark, sf_dir), posts)[1].select("id", "company_name")


@query("daily_sweep",
       f"{MERGE}, l AS (SELECT event, count(*) AS n FROM e GROUP BY 1) SELECT 'open' AS name, count(*) AS n FROM ({STATE}) WHERE is_open UNION ALL SELECT 'rows', count(*) FROM m UNION ALL SELECT event, n FROM l")
def daily_sweep(spark, sf_dir):
    """One day through the daily plan: the merged table is stored once and read back by its outputs."""
    empty = spark.createDataFrame([], "id string, day date, event string")
    out = daily.sweep(current(spark, sf_dir), stored_text(spark, sf_dir), empty, companies(spark, sf_dir), delivered(spark, sf_dir), boards(spark, sf_dir), NOW, DAY)
    posts = out["postings"]
    parts = [posts.agg(F.count_if("is_open").alias("n")).select(F.lit("open").alias("name"), "n"), posts.agg(F.count(F.lit(1)).alias("n")).select(F.lit("rows").alias("name"), "n"),
             out["job_events"].groupBy(F.col("event").alias("name")).agg(F.count(F.lit(1)).alias("n"))]
    return reduce(lambda a, b: a.unionByName(b), parts)


# -- many days at once, from the events table: a user is a posting, a day a snapshot ----------------


def observed(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type <> 'error'")
    seen = e.groupBy(F.col("user_id").cast("string").alias("id"), F.to_date("ts").alias("day")).agg(F.floor(F.max("value") / 8).cast("string").alias("hash"))
    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day")).distinct()
    # Swept days are numbered one after the other, so a day without a sweep is no gap; one row per day.
    return seen, days.select("day", F.row_number().over(Window.orderBy("day")).alias("n"))


DAILY = (
    "WITH seen AS (SELECT CAST(user_id AS VARCHAR) AS id, CAST(ts AS DATE) AS day, CAST(floor(max(value) / 8) AS BIGINT) AS hash FROM events WHERE event_type <> 'error' GROUP BY 1, 2), "
    "days AS (SELECT day, row_number() OVER (ORDER BY day) AS n FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)), "
    "grid AS (SELECT i.id, d.day, d.n, s.hash, s.id IS NOT NULL AS here FROM (SELECT DISTINCT id FROM seen) i, days d LEFT JOIN seen s ON s.id = i.id AND s.day = d.day), "
    "w AS (SELECT *, lag(here) OVER (PARTITION BY id ORDER BY n) AS was, bool_or(here) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, "
    "last_value(hash IGNORE NULLS) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_hash FROM grid), "
    "ev AS (SELECT id, day, unnest(list_filter([CASE WHEN here AND NOT coalesce(before, false) THEN 'appeared' END, CASE WHEN here AND coalesce(before, false) AND NOT was THEN 'reappeared' END, "
    "CASE WHEN here AND coalesce(before, false) AND hash <> last_hash THEN 'changed' END, CASE WHEN NOT here AND was THEN 'disappeared' END], lambda x: x IS NOT NULL)) AS event FROM w)"
)


def replayed(spark, sf_dir):
    return snapshot.replay_events(*observed(spark, sf_dir))


@query("snapshot_events", f"{DAILY} SELECT id, CAST(day AS VARCHAR) AS day, event FROM ev")
def snapshot_events(spark, sf_dir):
    return replayed(spark, sf_dir).select("id", F.col("day").cast("string").alias("day"), "event")


@query("snapshot_state",
       f"{DAILY}, l AS (SELECT max(n) AS last FROM days), s AS (SELECT id, min(n) AS lo, max(n) AS hi FROM grid WHERE here GROUP BY 1) "
       "SELECT id, CAST(a.day AS VARCHAR) AS first_seen, CAST(b.day AS VARCHAR) AS last_seen, hi = last AS is_open FROM s, l JOIN days a ON a.n = lo JOIN days b ON b.n = CASE WHEN hi = last THEN hi ELSE hi + 1 END")
def snapshot_state(spark, sf_dir):
    s = snapshot.replay_state(*observed(spark, sf_dir))
    return s.select("id", F.col("first_seen").cast("string").alias("first_seen"), F.col("last_seen").cast("string").alias("last_seen"), "is_open")


LATEST = "(SELECT max(day) FROM ev)"


def _since(name: str, kinds: list[str], fn, since: str, days: int) -> None:
    listed = ", ".join(f"'{k}'" for k in kinds)

    def run(spark, sf_dir):
        log = materialize(replayed(spark, sf_dir), "job_events")
        return fn(log, changes.resolve_since(log, since)[0])

    query(name, f"{DAILY} SELECT DISTINCT id FROM ev WHERE event IN ({listed}) AND day >= {LATEST} - {days}")(run)


_since("new_since", ["appeared", "reappeared"], changes.new_since, "2d", 2)
_since("new_since_last_sweep", ["appeared", "reappeared"], changes.new_since, "last-sweep", 0)
_since("changed_since", ["changed"], changes.changed_since, "yesterday", 1)


@query("gone_since",
       f"{DAILY}, s AS (SELECT id, max(n) FILTER (WHERE here) AS hi FROM grid GROUP BY 1), l AS (SELECT max(n) AS last FROM days) "
       f"SELECT id, CAST(day AS VARCHAR) AS day FROM ev JOIN s USING (id), l WHERE event = 'disappeared' AND day >= {LATEST} - 7 AND hi < last")
def gone_since(spark, sf_dir):
    log = materialize(replayed(spark, sf_dir), "job_events")
    state = snapshot.replay_state(*observed(spark, sf_dir))
    return changes.gone_since(log, state, changes.resolve_since(log, "7d")[0]).select("id", F.col("day").cast("string").alias("day"))


@query("activity_pivot",
       f"{DAILY} SELECT CAST(day AS VARCHAR) AS day, " + ", ".join(f"count(*) FILTER (WHERE event = '{e}') AS {e}" for e in ("appeared", "changed", "disappeared", "reappeared"))
       + " FROM ev GROUP BY ev.day ORDER BY ev.day DESC LIMIT 14")
def activity_pivot(spark, sf_dir):
    return changes.activity(replayed(spark, sf_dir), 14).withColumn("day", F.col("day").cast("string"))


@query("job_detail",
       f"{DAILY} SELECT '8' AS id, (SELECT max(n) FILTER (WHERE here) FROM grid WHERE id = '8') = (SELECT max(n) FROM days) AS is_open, 'Text 8' AS text, 'Company 8' AS company_display, "
       "(SELECT string_agg(day || '/' || event, ',' ORDER BY day DESC, event DESC) FROM ev WHERE id = '8') AS events")
def job_detail(spark, sf_dir):
    seen, days = observed(spark, sf_dir)
    posts = snapshot.replay_state(seen, days).select("id", "is_open", F.col("id").alias("company_id"), F.lit(True).alias("d_salary_known"),
                                                     F.lit(90000).alias("d_salary_min"), F.lit(120000).alias("d_salary_max"))
    texts = seen.select("id").distinct().select("id", F.concat(F.lit("Text "), "id").alias("text"))
    comp = fill(seen.select("id").distinct(), COMPANIES, id="id", name="'Company ' || id")
    d = changes.job_detail(posts, texts, comp, snapshot.replay_events(seen, days), "8")
    return d.select("id", "is_open", "text", "company_display", F.array_join(F.transform("events", lambda x: F.concat_ws("/", x["day"].cast("string"), x["event"])), ",").alias("events"))


P = views.posting_sql()
REPORT = {"starter": {"employment_type": ["FullTime"], "posted_within_days": 200}, "one_source": {"employment_type": ["FullTime"], "posted_within_days": 200, "ats": ["lever"]}}
FRESH = "age_days IS NOT NULL AND age_days <= 60"


@query("daily_report",
       f"{P}, v AS (SELECT *, listed AND coalesce(employment_type = 'FullTime', true) AND coalesce(age_days <= 200, true) AS fits, {FRESH} AS fresh FROM p) "
       "SELECT 'starter' AS profile, count(*) FILTER (WHERE fits) AS standing, count(*) FILTER (WHERE fits AND fresh) AS new FROM v UNION ALL "
       "SELECT 'one_source', count(*) FILTER (WHERE fits AND ats = 'lever'), count(*) FILTER (WHERE fits AND fresh AND ats = 'lever') FROM v")
def daily_report(spark, sf_dir):
    """Several saved searches over one stored view: what is new, and standing totals."""
    view = views.postings(spark, sf_dir)
    events = view.where("age_days IS NOT NULL").select("id", F.expr("date_sub(DATE'2026-02-02', CAST(age_days AS INT))").alias("day"), F.lit("appeared").alias("event"))
    posts = view.select("id", "title", "company_name", F.col("listed").alias("is_open"))
    return daily.daily_report(view, posts, events, REPORT, since="2025-12-04")["totals"].select("profile", "standing", "new")


# Ten profiles: one criterion after another, as conditions on the view with the policy for silence they have.
TEN = {
    "visa": ({"requires_visa_sponsorship": True}, "coalesce(visa, true)"),
    "hybrid": ({"workplace": ["hybrid"], "employment_type": ["FullTime"]}, "(workplace = 'hybrid' OR workplace = 'unknown' OR workplace_guessed) AND coalesce(employment_type = 'FullTime', true)"),
    "recent": ({"posted_within_days": 30, "unknowns": {"posted": "exclude"}}, "coalesce(age_days <= 30, false)"),
    "lever": ({"ats": ["lever"]}, "ats = 'lever'"),
    "titled": ({"title_keywords": ["the"], "title_match": "any"}, "regexp_matches(title_folded, '(^|[^\\p{L}\\p{N}])the($|[^\\p{L}\\p{N}])')"),
    "data": ({"job_functions": ["data"], "unknowns": {"job_function": "exclude"}}, "job_function = 'data'"),
    "words": ({"description_keywords": ["of the"]}, "(body = '' OR body IS NULL OR {the})"),
    "free": ({"text": "the an"}, "{free}"),
    "without": ({"exclude_description_keywords": ["the"]}, "NOT coalesce({any}, false)"),
    "all": ({}, "true"),
}


def _ten_sql() -> str:
    folded = {f: views.FOLD_SQL.format(c=f"coalesce({f}, '')") for f in ("title", "company", "body")}
    word = "regexp_matches({f}, '(^|[^\\p{{L}}\\p{{N}}]){t}($|[^\\p{{L}}\\p{{N}}])')".format
    start = "regexp_matches({f}, '(^|[^\\p{{L}}\\p{{N}}]){t}')".format
    free = " AND ".join("(" + " OR ".join(how(f=f, t=t) for f in folded.values()) + ")" for t, how in (("the", start), ("an", word)))
    texts = views.TEXTS_SQL.replace("t AS (", "tt AS (", 1)
    marks = f"{texts}, x AS (SELECT id AS tid, body, {word(f=folded['body'], t='of[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}]+the')} AS m_the, {word(f=folded['body'], t='the')} AS m_any, ({free}) AS m_free FROM tt)"
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS profile, count(*) FILTER (WHERE fits) AS standing, count(*) FILTER (WHERE fits AND {FRESH}) AS new FROM (SELECT *, listed AND ("
        + sql.replace("{the}", "coalesce(m_the, false)").replace("{any}", "m_any").replace("{free}", "coalesce(m_free, false)") + ") AS fits FROM v)" for name, (_, sql) in TEN.items())
    return f"{P}, {marks}, v AS (SELECT * FROM p LEFT JOIN x ON tid = id) {rows}"


def _ten(spark, sf_dir, **how):
    view = views.postings(spark, sf_dir)
    fresh = view.where("age_days IS NOT NULL AND age_days <= 60").select("id")
    return many.totals(view, {name: profile for name, (profile, _) in TEN.items()}, fresh=fresh, **how).select("profile", "standing", "new")


@query("daily_totals", _ten_sql())
def daily_totals(spark, sf_dir):
    """Standing and new matches of ten profiles from one scan of the view and one of the texts."""
    return _ten(spark, sf_dir, texts=views.texts(spark, sf_dir))


@query("daily_totals_index", _ten_sql())
def daily_totals_index(spark, sf_dir):
    """The same from a token index."""
    store = TokenStore(spark, f"{checkpoint_root(spark).rstrip('/')}/jobtide/tokens-{uuid.uuid4().hex}")
    store.add(spread(views.texts(spark, sf_dir)))
    return _ten(spark, sf_dir, index=store.index())
