"""Derivations: registered queries and their SQL.

Raw postings are built from documents, customers and line items; titles and
texts carry a phrase chosen by row so that every rule meets real, long text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..constants import FX_USD, GUESS_ORDER, PERIODS_PER_YEAR
from ..functions import text as T
from ..functions.gazetteer import DEFAULT
from ..operators import derive_text as D, location, metros
from ..plans import derive as plan
from ..plans.places import PlaceMemory
from ..session import checkpoint_root, materialize
from . import views
from .registry import query, spread, table

AS_OF = "2026-01-01"
LEVELS = ["", "Senior ", "Principal ", "Junior ", "Head of ", "Chief ", "Intern - ", "Staff "]
ROLES = [
    "Software Engineer", "Account Manager", "Engineering Manager", "Registered Nurse", "Implementation Specialist", "Data Analyst",
    "Product Manager", "Recruiter", "Engineer II", "Developer C++", "Warehouse Driver", "Zzz Qqq", "Security Lead",
]
# sentence, years claimed (lowest, highest)
SENTENCES = [
    ("We are unable to provide visa sponsorship. 5+ years of experience in sales.", 5, None),
    ("Visa sponsorship is available. PhD or Bachelor's degree.", None, None),
    ("Requires an active TS/SCI clearance. At least two years of relevant experience.", 2, None),
    ("Bachelor's degree required. Must be 18 years of age or older.", None, None),
    ("We use Python, python, C++ and PostgreSQL on AWS.", None, None),
    ("We have been building products for the last 15 years.", None, None),
    ("3–7+ years of SaaS sales experience. 1+ year of experience with Salesforce.", 3, 7),
    ("High school diploma. MBA preferred. Open to sponsor.", None, None),
    ("", None, None),
    ("Field experience for at least 4.5 years required.", 4.5, None),
]
# place as written, its metros, its countries, supranational areas, remote wording
PLACES = [
    ("New York, NY", ["nyc"], ["us"], [], False), ("Newark, CA", ["sf-bay"], ["us"], [], False), ("Remote - US", [], ["us"], [], True),
    ("Dallas TX", ["dallas"], ["us"], [], False), ("US-MA-Boston", ["boston"], ["us"], [], False), ("London UK", ["london"], ["gb"], [], False),
    ("Paris, Île-de-France, France", ["paris"], ["fr"], [], False), ("Office MPS TN Nashville", ["nashville"], ["us"], [], False),
    ("Gurugram 10 C", ["delhi-ncr"], ["in"], [], False), ("Mexico > Mexico City : Building B", ["mexico-city"], ["mx"], [], False),
    ("829 Boston Post Road", [], [], [], False), ("Ho Chi Minh City", ["ho-chi-minh-city"], [], [], False),
    ("St Louis, MO", ["st-louis"], ["us"], [], False), ("Portland ME", ["portland-me"], [], [], False),
    ("Singapore, SG", ["singapore"], ["sg"], [], False), ("NYC | SF", ["nyc", "sf-bay"], ["us"], [], False),
    ("Toronto, ON, Canada", ["toronto"], ["ca"], [], False), ("Europe", [], [], ["europe"], False), ("Remote, Worldwide", [], [], ["worldwide"], True),
    ("Seoul, KR", ["seoul"], ["kr"], [], False), ("Rio de Janeiro", ["rio-de-janeiro"], [], [], False), ("Elche, Spain", ["elche"], ["es"], [], False),
]
MINTED = {"ho-chi-minh-city": ("Ho Chi Minh City", None), "st-louis": ("St Louis", "us"), "portland-me": ("Portland Me", None),
          "rio-de-janeiro": ("Rio De Janeiro", None), "elche": ("Elche", "es")}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _spark_list(items) -> str:
    return "array(" + ", ".join("'" + i.replace("'", "\\'") + "'" for i in items) + ")"


def _duck_list(items) -> str:
    return "[" + ", ".join(_q(i) for i in items) + "]"


def _duck_lists(lists) -> str:
    return "[" + ", ".join(f"CAST({_duck_list(x)} AS VARCHAR[])" for x in lists) + "]"


def _pick(items: str, i: str, spark: bool) -> str:
    return f"element_at({items}, CAST({i} AS INT) + 1)" if spark else f"({items})[{i} + 1]"


def raw_exprs(spark: bool) -> dict[str, str]:
    lst = _spark_list if spark else _duck_list
    word = views.SPARK if spark else views.DUCK
    places = lst([p[0] for p in PLACES])
    n = len(PLACES)
    title = (f"{_pick(lst(LEVELS), f'doc_id % {len(LEVELS)}', spark)} || {_pick(lst(ROLES), f'doc_id % {len(ROLES)}', spark)}")
    arr = "array" if spark else "list_value"
    return {
        "doc_id": "doc_id", "id": views.POSTING["id"].format(**word), "ats": views.POSTING["ats"].format(**word), "company_slug": "source",
        "title": title, "department": "CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Marketing' ELSE 'Misc' END",
        "employment_type": views.POSTING["employment_type"].format(**word),
        "locations_all": f"{arr}({_pick(places, f'doc_id % {n}', spark)}, {_pick(places, f'(doc_id * 5 + 3) % {n}', spark)})",
        "raw_workplace": "CASE doc_id % 6 WHEN 0 THEN 'Hybrid' WHEN 1 THEN 'On-Site' WHEN 2 THEN 'somewhere' END",
        "raw_remote": "CASE WHEN doc_id % 7 = 3 THEN false WHEN doc_id % 7 = 4 THEN true END",
        "comp_min": "CASE WHEN n_chars % 4 = 0 THEN NULL ELSE CAST(n_chars AS DOUBLE) END",
        "comp_max": "CASE WHEN n_chars % 5 = 0 THEN NULL ELSE CAST(n_chars * (1 + doc_id % 9) AS DOUBLE) END",
        "comp_currency": "CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'eur' WHEN 2 THEN 'XXX' ELSE 'USD' END",
        "comp_interval": "CASE doc_id % 6 WHEN 0 THEN 'YEAR' WHEN 1 THEN 'HOUR' WHEN 2 THEN 'MONTH' WHEN 3 THEN 'NONE' WHEN 4 THEN NULL ELSE 'YEAR' END",
        "posted": "doc_id % 8 <> 0",
        "text": f"text || chr(10) || chr(10) || {_pick(lst([s[0] for s in SENTENCES]), f'doc_id % {len(SENTENCES)}', spark)}",
    }


RAW = "r AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in raw_exprs(False).items()) + " FROM documents)"


def raw_postings(spark, sf_dir):
    df = spread(table(spark, sf_dir, "documents")).selectExpr(*[f"{e} AS {c}" for c, e in raw_exprs(True).items()])
    none = F.lit(None).cast("string")
    return df.withColumns({
        "location_raw": none, "city": none, "region": none, "country": none, "team": none,
        "posted_at": F.when(F.col("posted"), F.lit("2025-12-01").cast("timestamp"))})


def _hit(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {_q(pattern)})"


def _edge(col: str, term: str) -> str:
    escaped = "".join("\\" + c if c in ".*+?^${}()|[]\\" else c for c in term)
    right = "($|[^a-z0-9])" if term[-1].isalnum() else "($|[ ),./|])"
    left = "(^|[^a-z0-9])" if term[0].isalnum() else "(^|[ (,/|])"
    return _hit(col, left + escaped + right)


FOLDED = views.FOLD_SQL.format
TITLE_CASE = "CASE " + " ".join(
    f"WHEN {_hit('t', p)}{' AND NOT ' + _hit('t', D.FALSE_MANAGER) if level == 'manager' else ''} THEN '{level}'" for level, p in D.TITLE_RULES) + " END"
RANK = f"nullif(regexp_extract(t, {_q(D.RANK_SUFFIX)}, 1), '')"
RANK_LEVEL = "CASE rank " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in D.RANK_LEVELS.items()) + " END"
FUNCTION_CASE = "CASE " + " ".join(
    f"WHEN {' OR '.join(_edge(c, t) for t in terms)} THEN '{name}'" for c in ("t", "dept") for name, terms in D.FUNCTION_RULES.items()) + " ELSE 'other' END"


@query("seniority_from_title",
       f"WITH {RAW}, f AS (SELECT id, {FOLDED(c='title')} AS t FROM r), g AS (SELECT id, {TITLE_CASE} AS level, {RANK} AS rank FROM f) "
       f"SELECT id, coalesce(level, {RANK_LEVEL}) AS level, CASE WHEN level IS NOT NULL THEN 'title:' || level WHEN rank IS NOT NULL THEN 'title:rank-' || rank END AS src FROM g")
def seniority_from_title(spark, sf_dir):
    s = D.seniority_from_title(T.fold(F.col("title")))
    return raw_postings(spark, sf_dir).select("id", s.alias("s")).select("id", "s.level", "s.src")


@query("job_function", f"WITH {RAW}, f AS (SELECT id, {FOLDED(c='title')} AS t, {FOLDED(c='coalesce(department, chr(32))')} AS dept FROM r) SELECT id, {FUNCTION_CASE} AS fn FROM f")
def job_function(spark, sf_dir):
    return raw_postings(spark, sf_dir).select("id", D.job_function(T.fold(F.col("title")), T.fold(F.col("department"))).alias("fn"))


SKILL_LIST = "list_sort(list_filter([" + ", ".join(f"CASE WHEN {_edge('x', t)} THEN {_q(t)} END" for t in D.SKILL_TERMS) + "], lambda s: s IS NOT NULL))"
SIGNALS_SQL = (
    f"array_to_string({SKILL_LIST}, ',') AS skills, CASE WHEN {_hit('x', D.VISA_NO)} THEN 'no' WHEN {_hit('x', D.VISA_YES)} THEN 'yes' END AS visa, "
    f"CASE WHEN {_hit('x', D.CLEARANCE)} THEN 'yes' END AS clearance, CASE " + " ".join(f"WHEN {_hit('x', p)} THEN '{d}'" for d, p in D.DEGREE_RULES) + " END AS degree"
)


@query("text_signals", f"WITH {RAW}, f AS (SELECT id, {FOLDED(c='text')} AS x FROM r) SELECT id, {SIGNALS_SQL} FROM f")
def text_signals(spark, sf_dir):
    """Skills, visa, clearance and degree from whole texts, folded once."""
    s = raw_postings(spark, sf_dir).select("id", D.signals(F.col("text")).alias("s"))
    return s.select("id", F.array_join("s.skills", ",").alias("skills"), F.when(F.col("s.visa"), "yes").when(~F.col("s.visa"), "no").alias("visa"),
                    F.when(F.col("s.clearance"), "yes").alias("clearance"), "s.degree")


YEARS = [("NULL" if s[1] is None else str(s[1]), "NULL" if s[2] is None else str(s[2])) for s in SENTENCES]
YEAR_MIN = f"CAST(([{', '.join(y[0] for y in YEARS)}])[doc_id % {len(SENTENCES)} + 1] AS DOUBLE)"
YEAR_MAX = f"CAST(([{', '.join(y[1] for y in YEARS)}])[doc_id % {len(SENTENCES)} + 1] AS DOUBLE)"


@query("years_claims", f"WITH {RAW} SELECT id, {YEAR_MIN} AS min_years, {YEAR_MAX} AS max_years FROM r")
def years_claims(spark, sf_dir):
    y = raw_postings(spark, sf_dir).select("id", D.strictest_years(D.years_claims(F.col("text"))).alias("y"))
    return y.select("id", F.col("y.min").alias("min_years"), F.col("y.max").alias("max_years"))


def salary_sql(lo: str, hi: str, cur: str, per: str) -> str:
    """struct-like CASE columns (smin, smax, known, src) over a subquery with lo, hi, cur, per."""
    rate = "CASE cur " + " ".join(f"WHEN '{k}' THEN {v!r}::DOUBLE" for k, v in FX_USD.items()) + " END"
    factor = "CASE per " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in PERIODS_PER_YEAR.items()) + " END"

    def fits(f: str, ceiling: str) -> str:
        a, b = f"lo * rate * {f}", f"hi * rate * {f}"
        return (f"(lo IS NULL OR ({a} >= 5000 AND {a} <= {ceiling})) AND (hi IS NULL OR ({b} >= 5000 AND {b} <= {ceiling})) "
                f"AND (lo IS NULL OR hi IS NULL OR ({a} <= {b} AND {b} <= {a} * 8))")

    chain = f"WHEN fac IS NOT NULL AND {fits('fac', '2000000')} THEN per "
    for name in GUESS_ORDER:
        f = str(PERIODS_PER_YEAR[name])
        chain += f"WHEN {fits(f, f'CASE WHEN per = {_q(name)} THEN 2000000 ELSE 1000000 END')} THEN '{name}' "
    used_factor = "CASE used " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in PERIODS_PER_YEAR.items()) + " END"
    num = "CASE WHEN coalesce(lo, hi) = floor(coalesce(lo, hi)) THEN CAST(CAST(coalesce(lo, hi) AS BIGINT) AS VARCHAR) ELSE CAST(coalesce(lo, hi) AS VARCHAR) END"
    return (
        f"s1 AS (SELECT *, CASE WHEN {lo} > 0 THEN {lo} END AS lo, CASE WHEN {hi} > 0 THEN {hi} END AS hi, upper(coalesce(nullif({cur}, ''), 'USD')) AS cur, upper(coalesce({per}, '')) AS per FROM s0), "
        f"s2 AS (SELECT *, {rate} AS rate, {factor} AS fac FROM s1), s3 AS (SELECT *, CASE WHEN lo IS NULL AND hi IS NULL OR rate IS NULL THEN NULL {chain} END AS used FROM s2), "
        f"s4 AS (SELECT *, CAST(floor(lo * rate * {used_factor} + 0.5) AS BIGINT) AS smin, CAST(floor(hi * rate * {used_factor} + 0.5) AS BIGINT) AS smax, "
        f"CASE WHEN lo IS NULL AND hi IS NULL THEN 'no-figure' WHEN rate IS NULL THEN 'unknown-currency:' || cur WHEN used IS NULL THEN 'implausible:' || coalesce(nullif(per, ''), 'none') || ':' || {num} || cur "
        f"WHEN used = per THEN 'as-stated' ELSE 'reinterpreted:' || coalesce(nullif(per, ''), 'none') || '->' || used END AS ssrc FROM s3)"
    )


OFFER = {
    "low": "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_extendedprice END", "high": "CASE WHEN l_linenumber = 4 THEN NULL ELSE l_extendedprice + p_retailprice * l_quantity END",
    "currency": "CASE l_returnflag WHEN 'A' THEN 'EUR' WHEN 'N' THEN 'USD' ELSE CASE WHEN l_quantity > 25 THEN 'XXX' ELSE 'inr' END END",
    "period": "CASE WHEN l_linestatus = 'O' THEN 'YEAR' WHEN l_quantity < 10 THEN 'HOUR' WHEN l_quantity < 20 THEN 'MONTH' ELSE NULL END",
}


@query("annual_salary",
       "WITH s0 AS (SELECT l_orderkey, l_linenumber, " + ", ".join(f"{e} AS {c}" for c, e in OFFER.items()) + " FROM lineitem JOIN part ON p_partkey = l_partkey), "
       + salary_sql("low", "high", "currency", "period") + " SELECT l_orderkey, l_linenumber, smin, smax, ssrc FROM s4")
def annual_salary(spark, sf_dir):
    df = spread(table(spark, sf_dir, "lineitem")).join(table(spark, sf_dir, "part"), F.expr("p_partkey = l_partkey"))
    df = df.select("l_orderkey", "l_linenumber", *[F.expr(e).alias(c) for c, e in OFFER.items()])
    pay = D.annual_salary(F.col("low"), F.col("high"), F.col("currency"), F.col("period"))
    return df.select("l_orderkey", "l_linenumber", pay.alias("p")).select(
        "l_orderkey", "l_linenumber", F.col("p.min").alias("smin"), F.col("p.max").alias("smax"), F.col("p.src").alias("ssrc"))


# -- places -------------------------------------------------------------------
N = len(PLACES)
NATION_CODE = {
    "ALGERIA": "dz", "ARGENTINA": "ar", "BRAZIL": "br", "CANADA": "ca", "EGYPT": "eg", "ETHIOPIA": "et", "FRANCE": "fr", "GERMANY": "de",
    "INDIA": "in", "INDONESIA": "id", "JAPAN": "jp", "JORDAN": "jo", "KENYA": "ke", "MOROCCO": "ma", "PERU": "pe", "CHINA": "cn",
    "ROMANIA": "ro", "SAUDI ARABIA": "sa", "VIETNAM": "vn", "RUSSIA": "ru", "UNITED KINGDOM": "gb", "UNITED STATES": "us",
}
NAMES = list(NATION_CODE)
NAME = {True: _pick(_spark_list(NAMES), f"n_nationkey % {len(NAMES)}", True), False: _pick(_duck_list(NAMES), f"n_nationkey % {len(NAMES)}", False)}
CODE = _pick(_duck_list(list(NATION_CODE.values())), f"n_nationkey % {len(NAMES)}", False)


def _expected(column: int, i: str) -> str:
    return f"({_duck_lists([p[column] for p in PLACES])})[{i} + 1]"


def _customers(spark, sf_dir):
    """Customers as postings: two written places by key and a remote line with the nation."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.expr("n_nationkey = c_nationkey"))
    places = _spark_list([p[0] for p in PLACES])
    none = F.lit(None).cast("string")
    return c.select(
        F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("id"),
        F.expr(f"array({_pick(places, f'c_custkey % {N}', True)}, 'Remote - ' || {NAME[True]})").alias("locations_all"),
        F.expr(_pick(places, f"(c_custkey * 7 + 1) % {N}", True)).alias("location_raw"),
        none.alias("city"), none.alias("region"), none.alias("country"), none.alias("title"))


LOCATED = (
    f"WITH c AS (SELECT 'c:' || CAST(c_custkey AS VARCHAR) AS id, c_custkey % {N} AS i, (c_custkey * 7 + 1) % {N} AS j, {CODE} AS code FROM customer JOIN nation ON n_nationkey = c_nationkey), "
    f"l AS (SELECT id, i, j, list_sort(list_distinct(list_concat({_expected(1, 'i')}, {_expected(1, 'j')}))) AS metros, "
    f"list_sort(list_distinct(list_concat({_expected(2, 'i')}, {_expected(2, 'j')}, list_value(code)))) AS countries, "
    f"list_sort(list_distinct(list_concat({_expected(3, 'i')}, {_expected(3, 'j')}))) AS supra FROM c)"
)


@query("location", f"{LOCATED} SELECT id, {views.joined('metros')} AS metros, {views.joined('countries')} AS countries, {views.joined('supra')} AS supra, 1 AS remote FROM l")
def location_query(spark, sf_dir):
    got = location.derive_location(_customers(spark, sf_dir))
    return got.select("id", *[F.array_join(f"d_{c}", ",").alias(c) for c in ("metros", "countries", "supra")], F.col("remote_hint").cast("int").alias("remote"))


FIRST_DAY = "CAST(substr(id, 3) AS INT) % 5 = 0"


def _two_days(spark, sf_dir):
    """A fifth of the postings, then all of them, with one memory of places."""
    root = f"{checkpoint_root(spark).rstrip('/')}/jobtide/places-{uuid.uuid4().hex}"
    posts, counts = _customers(spark, sf_dir), []
    memory = PlaceMemory(spark, root, parts=4)
    for day, rows in (("first", posts.where(FIRST_DAY)), ("second", posts), ("again", posts)):
        before, got = memory.parsed["fragments"], location.derive_location(rows, memory=memory)
        counts.append((day, memory.parsed["fragments"] - before))
    return got, counts


@query("location_remembered", f"{LOCATED} SELECT id, {views.joined('metros')} AS metros, {views.joined('countries')} AS countries, {views.joined('supra')} AS supra, 1 AS remote FROM l")
def location_remembered(spark, sf_dir):
    """Places of all postings from a memory that was filled on two days."""
    got = _two_days(spark, sf_dir)[0]
    return got.select("id", *[F.array_join(f"d_{c}", ",").alias(c) for c in ("metros", "countries", "supra")], F.col("remote_hint").cast("int").alias("remote"))


@query("places_parsed",
       f"WITH c AS (SELECT 'c:' || CAST(c_custkey AS VARCHAR) AS id, ({_duck_list([p[0] for p in PLACES])})[c_custkey % {N} + 1] AS a, ({_duck_list([p[0] for p in PLACES])})[(c_custkey * 7 + 1) % {N} + 1] AS b, {NAME[False]} AS n_name "
       f"FROM customer JOIN nation ON n_nationkey = c_nationkey), f AS (SELECT id, a AS fragment FROM c UNION SELECT id, b FROM c UNION SELECT id, 'Remote - ' || n_name FROM c), o AS (SELECT DISTINCT fragment FROM f WHERE {FIRST_DAY}) "
       "SELECT 'first' AS day, count(*) AS strings FROM o UNION ALL SELECT 'second', count(DISTINCT fragment) - (SELECT count(*) FROM o) FROM f UNION ALL SELECT 'again', 0")
def places_parsed(spark, sf_dir):
    """How many strings each day had to read: those no day before had."""
    return spark.createDataFrame(_two_days(spark, sf_dir)[1], "day string, strings long")


@query("location_fragments",
       f"WITH c AS (SELECT 'c:' || CAST(c_custkey AS VARCHAR) AS id, ({_duck_list([p[0] for p in PLACES])})[c_custkey % {N} + 1] AS a, ({_duck_list([p[0] for p in PLACES])})[(c_custkey * 7 + 1) % {N} + 1] AS b, {NAME[False]} AS n_name "
       "FROM customer JOIN nation ON n_nationkey = c_nationkey) SELECT id, a AS fragment FROM c UNION SELECT id, b FROM c UNION SELECT id, 'Remote - ' || n_name FROM c")
def location_fragments(spark, sf_dir):
    return location.location_fragments(_customers(spark, sf_dir))


@query("remote_scope",
       f"{LOCATED} SELECT id, CASE WHEN len(supra) > 0 THEN CASE WHEN list_contains(supra, 'worldwide') THEN 'worldwide' ELSE 'region' END WHEN len(countries) = 1 THEN 'country' WHEN len(countries) > 1 THEN 'region' END AS scope FROM l")
def remote_scope(spark, sf_dir):
    got = location.derive_location(_customers(spark, sf_dir))
    return got.select("id", location.remote_scope(F.col("d_countries"), F.col("d_supra")).alias("scope"))


TITLED = [  # words put after an order's priority, and the metros and countries they give
    ("Enterprise Sales Representative – Saudi Arabia", [], ["sa"]), ("Data Collector (Football) - Abha, Saudi Arabia", [], ["sa"]),
    ("Real Estate Associate - Los Angeles", ["la"], ["us"]), ("Field Engineer – Smartcard (Munich OR Paris based)", ["munich", "paris"], ["de", "fr"]),
    ("Inspector - Indianapolis, IN", [], ["us"]), ("Sales Lead, Hong Kong", ["hong-kong"], ["hk"]), ("Full Stack - Remote US", [], ["us"]),
    ("Liaison, Pennsylvania", [], ["us"]), ("Software Engineer - Cambridge, UK", [], ["gb"]), ("Product Manager - Growth", [], []),
    ("Physical Therapist, PT - Home Health", [], []),
]


@query("title_places",
       f"WITH o AS (SELECT o_orderkey, o_orderkey % {len(TITLED)} AS i FROM orders) SELECT o_orderkey, array_to_string(({_duck_lists([sorted(t[1]) for t in TITLED])})[i + 1], ',') AS metros, "
       f"array_to_string(({_duck_lists([sorted(t[2]) for t in TITLED])})[i + 1], ',') AS countries FROM o")
def title_places(spark, sf_dir):
    titles = _spark_list([t[0] for t in TITLED])
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(f"'Ref ' || (o_orderkey % 1000) || ' | ' || {_pick(titles, f'o_orderkey % {len(TITLED)}', True)}").alias("title"))
    read = location.title_places(df.select("title").distinct())
    out = df.join(read, "title")
    return out.select("o_orderkey", *[F.array_join(F.array_sort(f"place.{c}"), ",").alias(c) for c in ("metros", "countries")])


ALL_METROS = {m: (label, country) for m, (label, country, _) in DEFAULT.metros.items()}
KNOWN = "(VALUES " + ", ".join(f"({_q(m)}, {_q(v[0])}, {_q(v[1]) if v[1] else 'NULL'})" for m, v in {**ALL_METROS, **MINTED}.items()) + ") k(id, label, country)"


@query("metro_registry", f"{LOCATED}, n AS (SELECT m AS id, count(*) AS job_count FROM (SELECT unnest(metros) AS m FROM l) GROUP BY 1) "
       f"SELECT n.id, coalesce(label, upper(n.id[1]) || n.id[2:]) AS label, country, job_count FROM n LEFT JOIN {KNOWN} ON k.id = n.id")
def metro_registry(spark, sf_dir):
    located = materialize(location.derive_location(_customers(spark, sf_dir)), "located")  # counted and voted on
    return metros.metro_registry(located, located).select("id", "label", "country", "job_count")


# The city each written place names, and its metro, in the order of PLACES.
CITIES_READ = [
    [("new york", "nyc")], [("newark", "sf-bay")], [], [("dallas tx", "dallas")], [("us-ma-boston", "boston")], [("london uk", "london")], [("paris", "paris")], [("nashville", "nashville")],
    [("gurugram", "delhi-ncr")], [("mexico city", "mexico-city")], [], [("ho chi minh city", "ho-chi-minh-city")], [("st louis", "st-louis")], [("portland me", "portland-me")],
    [("singapore", "singapore")], [("nyc", "nyc"), ("sf", "sf-bay")], [("toronto", "toronto")], [], [], [("seoul", "seoul")], [("rio de janeiro", "rio-de-janeiro")], [("elche", "elche")],
]


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(repr(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)


@query("metro_aliases",
       f"{LOCATED}, u AS (SELECT id, i AS x FROM l UNION SELECT id, j FROM l), s AS (SELECT alias, metro, count(*) AS n FROM u JOIN (VALUES {_values((i, *c) for i, cs in enumerate(CITIES_READ) for c in cs)}) v(x, alias, metro) USING (x) GROUP BY ALL), "
       f"g AS (SELECT alias, metro, 0 AS n FROM (VALUES {_values(DEFAULT.cities.items())}) v(alias, metro) WHERE metro IN (SELECT unnest(metros) FROM l)), "
       "r AS (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY n DESC, metro) AS rn FROM (SELECT * FROM s UNION ALL SELECT * FROM g)) SELECT alias, metro AS metro_id FROM r WHERE rn = 1")
def metro_aliases(spark, sf_dir):
    located = materialize(location.derive_location(_customers(spark, sf_dir)), "located")
    return metros.metro_aliases(metros.metro_registry(located, located), located)


P = views.posting_sql()


@query("rebuild_metro_registry",
       f"{P}, e AS (SELECT unnest(metros) AS id, countries FROM p), n AS (SELECT id, count(*) AS job_count FROM e GROUP BY 1), "
       "v AS (SELECT id, unnest(countries) AS country FROM e), w AS (SELECT id, country, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, country) AS rn FROM v GROUP BY 1, 2) "
       f"SELECT n.id, coalesce(k.label, 'Nowhere Town') AS label, coalesce(k.country, w.country) AS country, job_count FROM n LEFT JOIN {KNOWN} ON k.id = n.id LEFT JOIN w ON w.id = n.id AND rn = 1")
def rebuild_metro_registry(spark, sf_dir):
    v = views.postings(spark, sf_dir).select("id", F.col("metros").alias("d_metros"), F.col("countries").alias("d_countries"))
    none = spark.createDataFrame([], "alias string, metro_id string")
    return metros.rebuild_metro_registry(v, none)[0].select("id", "label", "country", "job_count")


@query("bridge_tables", f"{P} SELECT id, 'metro' AS kind, unnest(metros) AS value FROM p UNION ALL SELECT id, 'skill', unnest(skills) FROM p")
def bridge_tables(spark, sf_dir):
    v = views.postings(spark, sf_dir).select("id", F.col("metros").alias("d_metros"), F.col("skills").alias("d_skills"))
    m, s = metros.bridge_tables(v)
    return m.select("id", F.lit("metro").alias("kind"), F.col("metro").alias("value")).unionByName(s.select("id", F.lit("skill").alias("kind"), F.col("skill").alias("value")))


@query("resolve_places",
       f"WITH nat AS (SELECT n_nationkey, {NAME[False]} AS n_name FROM nation), n AS (SELECT n_nationkey, unnest([n_name, 'The ' || n_name || ', somewhere', 'New York City, NY', 'portland', 'Nowhere ' || n_name]) AS name, {CODE} AS code, n_name FROM nat), "
       f"live AS (SELECT DISTINCT {CODE} AS code FROM customer JOIN nation ON n_nationkey = c_nationkey) "
       "SELECT n_nationkey, name, CASE WHEN name LIKE '%' || n_name || '%' AND name NOT LIKE 'Nowhere%' AND code IN (SELECT code FROM live) THEN code END AS country, "
       "CASE WHEN name LIKE 'New York%' THEN 'nyc' WHEN name = 'portland' THEN 'portland' END AS metro FROM n")
def resolve_places(spark, sf_dir):
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    nation = nation.select("n_nationkey", F.expr(NAME[True]).alias("n_name"))
    names = nation.select("n_nationkey", F.explode(F.expr(
        "array(n_name, 'The ' || n_name || ', somewhere', 'New York City, NY', 'portland', 'Nowhere ' || n_name)")).alias("name"))
    code = F.create_map(*[F.lit(x) for pair in NATION_CODE.items() for x in pair])
    live = customer.join(nation, F.expr("n_nationkey = c_nationkey")).select(F.try_element_at(code, "n_name").alias("code")).where("code IS NOT NULL").distinct()
    counts = customer.groupBy((F.col("c_custkey") % 65).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("job_count"))
    known = DEFAULT.metro_frame(spark).withColumn("k", F.pmod(F.xxhash64("metro"), F.lit(65)).cast("int"))
    registry = known.join(counts, "k", "left").select(F.col("metro").alias("id"), "label", "country", F.coalesce("job_count", F.lit(0)).alias("job_count"))
    got = metros.resolve_places(names.select("name").distinct(), live, registry)
    return names.join(got, "name").select("n_nationkey", "name", "country", "metro")


# -- whole derivation -----------------------------------------------------------
WORKPLACE = (
    "CASE doc_id % 6 WHEN 0 THEN 'hybrid/ats-enum' WHEN 1 THEN 'onsite/ats-enum' WHEN 2 THEN 'unknown/ats-enum-unrecognised:somewhere' ELSE "
    "CASE WHEN remote THEN 'remote/location-text' WHEN doc_id % 7 = 3 THEN 'onsite/is-remote-false' WHEN len(metros) > 0 THEN 'onsite/default-has-metro' ELSE 'unknown/no-signal' END END"
)
REMOTES = "([" + ", ".join("true" if p[4] else "false" for p in PLACES) + "])"
ROLE_COUNTRY = "CAST([] AS VARCHAR[])"
DERIVED = (
    f"WITH {RAW}, e AS (SELECT *, doc_id % {N} AS i, (doc_id * 5 + 3) % {N} AS j, {FOLDED(c='title')} AS t, {FOLDED(c='coalesce(department, chr(32))')} AS dept, {FOLDED(c='text')} AS x FROM r), "
    f"g AS (SELECT *, list_sort(list_distinct(list_concat({_expected(1, 'i')}, {_expected(1, 'j')}))) AS metros, list_sort(list_distinct(list_concat({_expected(2, 'i')}, {_expected(2, 'j')}))) AS countries, "
    f"list_distinct(list_concat({_expected(3, 'i')}, {_expected(3, 'j')})) AS supra, {REMOTES}[i + 1] OR {REMOTES}[j + 1] AS remote, {YEAR_MIN} AS ymin, {YEAR_MAX} AS ymax, "
    f"{TITLE_CASE} AS by_title, {RANK} AS rank, {FUNCTION_CASE} AS fn, {SIGNALS_SQL} FROM e), "
    f"s0 AS (SELECT *, {WORKPLACE} AS place FROM g), {salary_sql('comp_min', 'comp_max', 'comp_currency', 'comp_interval')}, "
    "z AS (SELECT *, split_part(place, '/', 1) AS workplace, coalesce(by_title, " + RANK_LEVEL + ", CASE WHEN ymin <= 1 THEN 'entry' WHEN ymin <= 2 THEN 'junior' WHEN ymin <= 5 THEN 'mid' WHEN ymin <= 8 THEN 'senior' WHEN ymin > 8 THEN 'staff' END, 'unknown') AS seniority, "
    "ssrc = 'as-stated' OR ssrc LIKE 'reinterpreted%' AS known FROM s4), "
    "q AS (SELECT *, floor(((CASE WHEN length(text) > 400 THEN 1 ELSE 0 END + CASE WHEN known THEN 1 ELSE 0 END + CASE WHEN ymin IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN workplace <> 'unknown' THEN 1 ELSE 0 END "
    "+ CASE WHEN len(metros) > 0 THEN 1 ELSE 0 END + CASE WHEN employment_type IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN department IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN posted THEN 1 ELSE 0 END) / 8.0) * 100 + 0.5) / 100 AS quality FROM z)"
)


def _derived(spark, sf_dir):
    raw = raw_postings(spark, sf_dir)
    return plan.derive(raw.drop("text"), raw.select("id", "text"), AS_OF)


@query("derive_all",
       f"{DERIVED} SELECT id, place, CASE WHEN workplace = 'remote' THEN CASE WHEN len(supra) > 0 THEN CASE WHEN list_contains(supra, 'worldwide') THEN 'worldwide' ELSE 'region' END "
       "WHEN len(countries) = 1 THEN 'country' WHEN len(countries) > 1 THEN 'region' END END AS scope, array_to_string(metros, ',') AS metros, array_to_string(countries, ',') AS countries, "
       "smin, smax, ssrc, ymin, ymax, seniority, fn, skills, visa, clearance, degree, quality FROM q")
def derive_all(spark, sf_dir):
    d = _derived(spark, sf_dir)
    return d.select(
        "id", F.concat_ws("/", "d_workplace", "d_workplace_src").alias("place"), F.col("d_remote_scope").alias("scope"),
        F.array_join("d_metros", ",").alias("metros"), F.array_join("d_countries", ",").alias("countries"), F.col("d_salary_min").alias("smin"),
        F.col("d_salary_max").alias("smax"), F.col("d_salary_src").alias("ssrc"), F.col("d_min_years").alias("ymin"), F.col("d_max_years").alias("ymax"),
        F.col("d_seniority").alias("seniority"), F.col("d_job_function").alias("fn"), F.array_join("d_skills", ",").alias("skills"),
        F.when(F.col("d_visa"), "yes").when(~F.col("d_visa"), "no").alias("visa"), F.when(F.col("d_clearance"), "yes").alias("clearance"),
        F.col("d_degree").alias("degree"), F.col("d_quality").alias("quality"))


@query("derive_incremental",
       f"{DERIVED} SELECT id, CASE WHEN doc_id % 3 = 0 THEN 'kept' ELSE seniority END AS seniority, CASE WHEN doc_id % 3 = 0 THEN '2020-01-01' ELSE '{AS_OF}' END AS derived FROM q")
def derive_incremental(spark, sf_dir):
    """Only rows whose stamp was cleared are derived again."""
    raw = raw_postings(spark, sf_dir)
    stored = raw.drop("text").withColumns({
        "d_seniority": F.lit("kept"), "d_derived_at": F.when(F.expr("doc_id % 3 = 0"), F.lit("2020-01-01").cast("timestamp"))})
    out = plan.derive_incremental(stored, raw.select("id", "text"), AS_OF)
    return out.select("id", F.col("d_seniority").alias("seniority"), F.date_format("d_derived_at", "yyyy-MM-dd").alias("derived"))


@query("derive_coverage",
       f"{DERIVED}, c AS (SELECT 'postings' AS name, count(*)::DOUBLE AS n FROM q UNION ALL SELECT 'workplace_known', count(*) FROM q WHERE workplace <> 'unknown' UNION ALL SELECT 'placed', count(*) FROM q WHERE len(metros) > 0 "
       "UNION ALL SELECT 'multi_metro', count(*) FROM q WHERE len(metros) > 1 UNION ALL SELECT 'salary_known', count(*) FROM q WHERE known UNION ALL SELECT 'years_known', count(*) FROM q WHERE ymin IS NOT NULL "
       "UNION ALL SELECT 'seniority_known', count(*) FROM q WHERE seniority <> 'unknown' UNION ALL SELECT 'visa_yes', count(*) FROM q WHERE visa = 'yes' UNION ALL SELECT 'visa_no', count(*) FROM q WHERE visa = 'no' "
       "UNION ALL SELECT 'clearance', count(*) FROM q WHERE clearance = 'yes' UNION ALL SELECT 'mean_quality', round(avg(quality), 6) FROM q "
       "UNION ALL SELECT 'workplace:' || workplace, count(*) FROM q GROUP BY workplace UNION ALL SELECT 'seniority:' || seniority, count(*) FROM q GROUP BY seniority UNION ALL SELECT 'job_function:' || fn, count(*) FROM q GROUP BY fn "
       "UNION ALL SELECT 'salary_src:' || split_part(ssrc, ':', 1), count(*) FROM q GROUP BY split_part(ssrc, ':', 1) UNION ALL SELECT 'degree:' || degree, count(*) FROM q WHERE degree IS NOT NULL GROUP BY degree "
       "UNION ALL (SELECT 'metro:' || m, count(*) FROM (SELECT unnest(metros) AS m FROM q) GROUP BY m ORDER BY count(*) DESC, m LIMIT 30) "
       f"UNION ALL SELECT 'unmatched:829 boston post road', count(*) FROM q WHERE i = 10 OR j = 10 UNION ALL SELECT 'unmatched:building b', count(*) FROM q WHERE i = 9 OR j = 9) SELECT * FROM c")
def derive_coverage(spark, sf_dir):
    """The derivation report. The derived rows feed four reports, so they are stored once."""
    parts = plan.derive_coverage(materialize(_derived(spark, sf_dir).drop("text"), "derived"))
    cov = parts["coverage"]
    out = cov.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.round(F.col(c).cast("double"), 6).alias("n")) for c in cov.columns])).alias("x")).select("x.*")
    named = parts["distributions"].select(F.concat_ws(":", "name", "value").alias("name"), F.col("postings").cast("double").alias("n"))
    for prefix in ("metros", "unmatched"):
        tag = prefix.removesuffix("s") if prefix == "metros" else prefix
        named = named.unionByName(parts[prefix].select(F.concat(F.lit(f"{tag}:"), "value").alias("name"), F.col("jobs").cast("double").alias("n")))
    return out.unionByName(named)
