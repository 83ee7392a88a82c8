"""Text functions and text search: registered queries and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalar as S, text as T
from ..operators import rank, textindex
from ..plans.search import search
from ..plans.textstore import TokenStore
from ..session import checkpoint_root
from . import views
from .registry import query, spread, table

P = views.posting_sql()
FOLD = views.FOLD_SQL.format
T_CTE = f"WITH {views.WHOLE_SQL}"


def docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents"))


# -- scalar text functions over whole texts -----------------------------------


@query("fold_text", f"SELECT doc_id, md5({FOLD(c='text')}) AS folded FROM documents")
def fold_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(T.fold(F.col("text"))).alias("folded"))


@query("fold_lines_text",
       "SELECT doc_id, md5(lower(trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(text), '[^\\S\\n]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)))) AS folded FROM documents")
def fold_lines_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(T.fold_lines(F.col("text"))).alias("folded"))


@query("norm_titles", f"{P} SELECT id, title_norm FROM p")
def norm_titles(spark, sf_dir):
    return views.postings(spark, sf_dir).select("id", T.norm_text(F.col("title")).alias("title_norm"))


@query("slugify_titles", f"{P} SELECT id, trim(regexp_replace(replace(title_folded, '''', ''), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM p")
def slugify_titles(spark, sf_dir):
    return views.postings(spark, sf_dir).select("id", T.slugify(F.col("title")).alias("slug"))


@query("title_case_parts",
       "SELECT p_partkey, array_to_string(list_transform(string_split(regexp_replace(trim(replace(replace(p_name, '-', ' '), '_', ' ')), ' +', ' ', 'g'), ' '), "
       "lambda w: upper(w[1]) || w[2:]), ' ') AS name FROM part")
def title_case_parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.title_case(F.col("p_name")).alias("name"))


TERMS = ["the", "est", "und", "c++", "la", "para"]
EDGE = "regexp_matches({c}, '(^|[^a-z0-9]){t}($|[^a-z0-9])')"


def edge(term: str, c: str = "f") -> str:
    return "false" if term == "c++" else EDGE.format(c=c, t=term)


@query("term_hits", f"SELECT doc_id, array_to_string(list_filter([{', '.join(f'CASE WHEN {edge(t)} THEN {t!r} END' for t in TERMS)}], lambda x: x IS NOT NULL), ',') AS hits, "
       f"({' OR '.join(edge(t) for t in TERMS)}) AS any_hit, ({edge('the')} AND {edge('and')}) AS all_hit FROM (SELECT doc_id, {FOLD(c='text')} AS f FROM documents)")
def term_hits(spark, sf_dir):
    df = docs(spark, sf_dir).select("doc_id", T.fold(F.col("text")).alias("f"))
    return df.select("doc_id", F.array_join(T.term_hits(F.col("f"), TERMS), ",").alias("hits"), T.any_term(F.col("f"), TERMS).alias("any_hit"),
                     T.all_terms(F.col("f"), ["the", "and"]).alias("all_hit"))


NUMBER = "CASE p_partkey % 6 WHEN 0 THEN 'twelve' WHEN 1 THEN ' Five ' WHEN 2 THEN CAST(p_size AS {str}) WHEN 3 THEN CAST(p_size AS {str}) || '.5' WHEN 4 THEN '1,' || '250' ELSE p_name END"


@query("parse_numbers",
       "SELECT p_partkey, CAST(CASE p_partkey % 6 WHEN 0 THEN 12 WHEN 1 THEN 5 WHEN 2 THEN p_size WHEN 3 THEN p_size + 0.5 WHEN 4 THEN 1250 END AS DOUBLE) AS n FROM part")
def parse_numbers(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.parse_number_word(F.expr(NUMBER.format(**views.SPARK))).alias("n"))


# Pages use the entities amp, lt, gt, quot, apos and nbsp plus whatever the text brings.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&nbsp;", " "), ("&#39;", "''"), ("&eacute;", "é"), ("&copy;", "©"), ("&mdash;", "—"), ("&middot;", "·")]


def _decode_sql(c: str) -> str:
    for entity, char in ENTITIES:
        c = f"replace({c}, '{entity}', '{char}')"
    return f"replace({c}, '&amp;', '&')"


@query("decode_entities", f"SELECT page_id, md5({_decode_sql('html')}) AS decoded FROM pages")
def decode_entities(spark, sf_dir):
    return spread(table(spark, sf_dir, "pages")).select("page_id", F.md5(T.decode_entities(F.col("html"))).alias("decoded"))


def _html_sql(c: str) -> str:
    for tag in ("script", "style", "head", "noscript", "svg", "template"):
        c = f"regexp_replace({c}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', ' ', 'g')"
    steps = [
        ("(?i)</\\s*(li|tr|dt|dd)\\s*>", "''"), ("(?i)</?\\s*(td|th)\\b[^>]*>", "' '"),
        ("(?i)</?\\s*(p|div|ul|ol|dl|h[1-6]|blockquote|section|article|header|footer|pre|figcaption|table|thead|tbody)\\b[^>]*>", "chr(10) || chr(10)"),
        ("(?i)<\\s*br\\s*/?\\s*>|<\\s*(li|tr|dt|dd)\\b[^>]*>", "chr(10)"),
        ("(?s)<!--.*?-->|<!\\s*[a-zA-Z][^>]*>|</?\\s*[a-zA-Z][a-zA-Z0-9-]*(\\s[^>]*)?>", "''"),
    ]
    for pattern, by in steps:
        c = f"regexp_replace({c}, '{pattern}', {by}, 'g')"
    c = _decode_sql(c)
    for pattern, by in (("\\r\\n?", "chr(10)"), (" ", "' '"), ("[ \\t\\f\\v]+", "' '"), (" *\\n *", "chr(10)"), ("\\n{3,}", "chr(10) || chr(10)")):
        c = f"regexp_replace({c}, '{pattern}', {by}, 'g')"
    return f"trim({c}, ' ' || chr(10))"


@query("html_to_text", f"SELECT page_id, md5({_html_sql('html')}) AS plain, length({_html_sql('html')}) AS n FROM pages")
def html_to_text(spark, sf_dir):
    df = spread(table(spark, sf_dir, "pages")).select("page_id", T.html_to_text(F.col("html")).alias("t"))
    return df.select("page_id", F.md5("t").alias("plain"), F.length("t").alias("n"))


@query("about_excerpts",
       "SELECT doc_id, length(e) AS n, md5(e) AS excerpt FROM (SELECT doc_id, trim(regexp_replace(regexp_replace("
       "substr(CASE WHEN doc_id % 3 = 0 THEN 'Intro line' || chr(10) || 'About Us' || chr(10) || text ELSE text END, CASE WHEN doc_id % 3 = 0 THEN 12 ELSE 1 END, 1500), "
       "'[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS e FROM documents)")
def about_excerpts(spark, sf_dir):
    text = F.expr("CASE WHEN doc_id % 3 = 0 THEN 'Intro line' || chr(10) || 'About Us' || chr(10) || text ELSE text END")
    df = docs(spark, sf_dir).select("doc_id", S.about_excerpt(text, F.lit("Acme")).alias("e"))
    return df.select("doc_id", F.length("e").alias("n"), F.md5("e").alias("excerpt"))


VERDICTS = {  # inputs by part size class
    "sector": "CASE p_partkey % 4 WHEN 0 THEN ' AI ' WHEN 1 THEN 'nonsense' WHEN 2 THEN 'gaming' END",
    "confidence": "CASE p_partkey % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'odd' WHEN 2 THEN 'medium' ELSE 'high' END",
    "blurb": "CASE p_partkey % 3 WHEN 0 THEN '\"blurb: makes  ' || p_name || '\"' WHEN 1 THEN p_name || '!' END",
}


@query("clean_verdict",
       "SELECT p_partkey, CASE WHEN p_partkey % 5 NOT IN (0, 1) THEN CASE p_partkey % 4 WHEN 0 THEN 'ai' WHEN 2 THEN 'gaming' END END AS sector, "
       "CASE p_partkey % 3 WHEN 0 THEN 'makes ' || p_name || '.' WHEN 1 THEN p_name || '!' END AS blurb FROM part")
def clean_verdict(spark, sf_dir):
    v = {k: F.expr(e) for k, e in VERDICTS.items()}
    got = S.clean_verdict(v["sector"], v["blurb"], v["confidence"])
    return table(spark, sf_dir, "part").select("p_partkey", got.alias("v")).select("p_partkey", "v.sector", "v.blurb")


# -- the token index and what it answers ----------------------------------------

TOKENS = "unnest(list_filter(regexp_split_to_array({f}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''))"


@query("token_index",
       f"{T_CTE}, k AS (" + " UNION ALL ".join(f"SELECT id, '{f}' AS field, {TOKENS.format(f=FOLD(c=f))} AS token FROM t" for f in ("title", "company", "body"))
       + ") SELECT field, token, count(*) AS n, count(DISTINCT id) AS postings FROM k GROUP BY field, token")
def token_index(spark, sf_dir):
    texts = views.whole_texts(spark, sf_dir)
    entries = textindex.build_entries(spread(texts)).select("field", "token", "id", F.size("places").cast("long").alias("n"))
    if not textindex.ids_once(texts):
        # One row per posting first, so a word everywhere does not gather its postings in one task.
        entries = entries.groupBy("field", "token", "id").agg(F.sum("n").alias("n"))
    return entries.groupBy("field", "token").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("postings"))


WORD = "regexp_matches({f}, '(^|[^\\p{{L}}\\p{{N}}]){t}($|[^\\p{{L}}\\p{{N}}])')"
START = "regexp_matches({f}, '(^|[^\\p{{L}}\\p{{N}}]){t}')"
BODY = FOLD(c="body")


def build_store(spark, sf_dir) -> TokenStore:
    """A token store of all documents in a folder of its own: every query builds what it reads."""
    store = TokenStore(spark, f"{checkpoint_root(spark).rstrip('/')}/jobtide/tokens-{uuid.uuid4().hex}")
    store.add(spread(views.whole_texts(spark, sf_dir)))
    return store


#: Searches of a built store, for the bench to time apart from building.
LOOKUPS = {}


def lookup(name: str, sql: str):
    """Registers a query that builds the store and searches it; the search alone goes to LOOKUPS."""
    def register(fn):
        LOOKUPS[name] = fn
        query(name, sql)(lambda spark, sf_dir: fn(build_store(spark, sf_dir), spark, sf_dir))
        return fn

    return register


@lookup("text_any", f"{T_CTE} SELECT id FROM t WHERE {WORD.format(f=BODY, t='hathre')} OR {WORD.format(f=BODY, t='leaux')} OR {WORD.format(f=BODY, t='worthless')}")
def text_any(store, spark, sf_dir):
    return store.match(["hathre", "léaux", "worthless"], "any")


@lookup("text_all", f"{T_CTE} SELECT id FROM t WHERE {WORD.format(f=BODY, t='the')} AND {WORD.format(f=BODY, t='of')} AND {WORD.format(f=BODY, t='is')}")
def text_all(store, spark, sf_dir):
    return store.match(["The", "of", "is"], "all")


@lookup("text_phrase", f"{T_CTE} SELECT id FROM t WHERE {WORD.format(f=BODY, t='of[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}]+the')} "
       f"OR {WORD.format(f=BODY, t='que[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}]+la')}")
def text_phrase(store, spark, sf_dir):
    return store.match(["of the", "que la"], "any")


@query("text_scan", f"{T_CTE} SELECT id FROM t WHERE {WORD.format(f=BODY, t='of[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}]+the')} "
       f"OR {WORD.format(f=BODY, t='hathre')}")
def text_scan(spark, sf_dir):
    """The same phrases without an index: one narrow scan of the text."""
    return spread(views.whole_texts(spark, sf_dir)).where(textindex.match_terms_scan(F.col("body"), ["of the", "hathre"])).select("id")


ALL_FIELDS = ["title", "company", "body"]


def _every(words: dict[str, str], fields: list[str]) -> str:
    return " AND ".join("(" + " OR ".join(how.format(f=FOLD(c=f), t=w) for f in fields) + ")" for w, how in words.items())


QUERY_WORDS = {"comp": START, "src1": START, "th": WORD}
QUERY2 = {"the": START, "an": WORD}


@lookup("text_all_prefix", f"{T_CTE} SELECT id FROM t WHERE {_every({'company': START, 'src1': START, 'erth': START}, ALL_FIELDS)}")
def text_all_prefix(store, spark, sf_dir):
    return store.query("company src1 erth").select("id")


@lookup("text_field", f"{T_CTE} SELECT id, CASE WHEN {_every(QUERY2, ['company'])} THEN 'company' WHEN {_every(QUERY2, ['title'])} THEN 'title' ELSE 'body' END AS text_field "
       f"FROM t WHERE {_every(QUERY2, ALL_FIELDS)}")
def text_field(store, spark, sf_dir):
    return store.query("the an")


@query("text_query_scan", f"{T_CTE} SELECT id, CASE WHEN {_every(QUERY2, ['company'])} THEN 'company' WHEN {_every(QUERY2, ['title'])} THEN 'title' ELSE 'body' END AS text_field "
       f"FROM t WHERE {_every(QUERY2, ALL_FIELDS)}")
def text_query_scan(spark, sf_dir):
    """The same answer without an index."""
    return textindex.text_query_scan(spread(views.whole_texts(spark, sf_dir)), "the an")


@lookup("search_text_index", f"{T_CTE} SELECT id FROM t WHERE {_every(QUERY2, ALL_FIELDS)} AND NOT {WORD.format(f=BODY, t='hathre')}")
def search_text_index(store, spark, sf_dir):
    """Free text and an exclusion through the token index."""
    view = views.postings(spark, sf_dir)
    p = {"text": "the an", "exclude_description_keywords": ["hathre"], "include_unlisted": True}
    return search(view, p, index=store.index()).visible.select("id")


@lookup("text_exclude", f"{P}, {views.WHOLE_SQL} SELECT id FROM p WHERE id NOT IN (SELECT id FROM t WHERE {WORD.format(f=BODY, t='the')} OR {WORD.format(f=BODY, t='est')})")
def text_exclude(store, spark, sf_dir):
    return textindex.exclude_text(views.postings(spark, sf_dir), store.index(["the", "est"]), ["the", "est"]).select("id")


# A store through four days: some postings first, then the rest and changed ones, closed ones, some read again.
DAYS = [("doc_id % 3 <> 0", "body", "false"), ("doc_id % 3 = 0 OR doc_id % 5 = 1", "CASE WHEN doc_id % 5 = 1 THEN 'changed leaux ' || title ELSE body END", "doc_id % 5 = 1"),
        ("false", "body", "doc_id % 7 = 2"), ("doc_id % 11 = 3", "'hathre once more'", "doc_id % 11 = 3"), ("doc_id % 13 = 4", "body", "doc_id % 13 = 4")]
LAST = "CASE WHEN doc_id % 13 = 4 THEN body WHEN doc_id % 11 = 3 THEN 'hathre once more' WHEN doc_id % 7 = 2 THEN NULL WHEN doc_id % 5 = 1 THEN 'changed leaux ' || title ELSE body END"


def _followed(spark, sf_dir, parts: int = 4) -> TokenStore:
    store = TokenStore(spark, f"{checkpoint_root(spark).rstrip('/')}/jobtide/tokens-{uuid.uuid4().hex}", parts)
    texts = spread(views.whole_texts(spark, sf_dir)).withColumn("doc_id", F.element_at(F.split("id", ":"), -1).cast("long"))
    for read, body, void in DAYS:
        store.add(texts.where(read).withColumn("body", F.expr(body)).drop("doc_id"), texts.where(void).select("id"))
    return store


@query("token_segments",
       f"{T_CTE.replace(' FROM documents)', ', doc_id FROM documents)')}, n AS (SELECT id, {LAST} AS body FROM t) SELECT id FROM n WHERE {WORD.format(f=BODY, t='hathre')} OR {WORD.format(f=BODY, t='leaux')}")
def token_segments(spark, sf_dir):
    """Phrases in what was read last of every posting that is still there, after five days of segments and a merge."""
    return _followed(spark, sf_dir).match(["hathre", "léaux"], "any")


@query("term_table",
       f"{T_CTE}, k AS (" + " UNION ".join(f"SELECT id, {TOKENS.format(f=FOLD(c=f))} AS token FROM t" for f in ("title", "company", "body"))
       + ") SELECT word, token, count(*) AS postings FROM (SELECT unnest(['the', 'erth', 'src1', 'is']) AS word) JOIN k ON CASE WHEN length(word) >= 3 THEN starts_with(token, word) ELSE token = word END GROUP BY word, token")
def term_table(spark, sf_dir):
    """Tokens that some words start, with their numbers of postings, from the term table alone."""
    return build_store(spark, sf_dir).terms(["the", "erth", "src1", "is"])


@query("missing_text", f"{P}, {views.TEXTS_SQL} SELECT p.id FROM p LEFT JOIN t USING (id) WHERE body IS NULL OR body = ''")
def missing_text(spark, sf_dir):
    return textindex.missing_text(views.postings(spark, sf_dir), views.texts(spark, sf_dir), "body")


KEYWORDS = ["the", "of", "que"]


@query("description_gate",
       f"{P}, {views.TEXTS_SQL}, g AS (SELECT p.id, body IS NULL OR body = '' AS missing, {' OR '.join(WORD.format(f=BODY, t=k) for k in KEYWORDS)} AS hit FROM p LEFT JOIN t USING (id) WHERE listed) "
       "SELECT id, CASE WHEN missing THEN 'unknown' ELSE '' END AS unknown FROM g WHERE missing OR hit")
def description_gate(spark, sf_dir):
    """Postings with no text answer unknown, not no."""
    found = search(views.postings(spark, sf_dir), {"description_keywords": KEYWORDS, "limit": 5000}, texts=views.texts(spark, sf_dir))
    kept = found.flagged.where("bucket = 'in'")
    return kept.select("id", F.when(F.array_contains("unknown_on", "description"), "unknown").otherwise("").alias("unknown"))


@query("description_hits",
       f"{P}, {views.TEXTS_SQL}, h AS (SELECT p.id, p.age_days, list_filter([{', '.join(f'CASE WHEN {edge(k, BODY)} THEN {k!r} END' for k in KEYWORDS)}], lambda x: x IS NOT NULL) AS hits, "
       "body IS NULL OR body = '' AS missing FROM p LEFT JOIN t USING (id) WHERE listed) "
       "SELECT id, array_to_string(hits, ',') AS hits, CASE WHEN len(hits) > 0 THEN 'description: ' || array_to_string(hits, ', ') END AS why FROM h WHERE missing OR len(hits) > 0")
def description_hits(spark, sf_dir):
    """Whole-word keyword hits of surviving rows, however many there are."""
    found = search(views.postings(spark, sf_dir), {"description_keywords": KEYWORDS}, texts=views.texts(spark, sf_dir))
    kept = found.visible.where("listed AND (text_missing OR text_hit)")
    return kept.select("id", F.array_join("description_hits", ",").alias("hits"), rank.explain(F.col("description_hits")).alias("why"))


@lookup("text_specificity",
       f"{T_CTE}, w AS (SELECT unnest(['the', 'hathre', 'zzz', 'company']) AS word), m AS (SELECT word, count(id) AS m FROM w LEFT JOIN t ON "
       "regexp_matches(lower(strip_accents(title || ' ' || company || ' ' || body)), '(^|[^\\p{L}\\p{N}])' || word) GROUP BY word), n AS (SELECT count(*) AS n FROM documents) "
       "SELECT word, round(CASE WHEN m = 0 OR m >= n THEN 0 WHEN ln(n / 100.0) <= 0 THEN 1 ELSE greatest(0, least(1, ln(n::DOUBLE / m) / ln(n / 100.0))) END, 6) AS spec FROM m, n")
def text_specificity(store, spark, sf_dir):
    """Rarity of words: document counts from the term table where one token answers, else from postings."""
    found = store.rarity(["the", "hathre", "zzz", "company"], table(spark, sf_dir, "documents").count())
    return found.select("word", F.round("spec", 6).alias("spec"))


@query("search_text",
       f"{P}, {views.WHOLE_SQL}, h AS (SELECT id, CASE WHEN {_every(QUERY2, ['title'])} THEN 0.6 ELSE 0.05 END AS factor FROM t WHERE {_every(QUERY2, ALL_FIELDS)}), "
       "z AS (SELECT (SELECT count(*) FROM p)::DOUBLE AS n, (SELECT count(*) FROM h)::DOUBLE AS m), "
       "sp AS (SELECT CASE WHEN m = 0 OR m >= n THEN 0.0 WHEN NOT ln(n / 100.0) > 0 THEN 1.0 ELSE greatest(0.0, least(1.0, ln(n / m) / ln(n / 100.0))) END AS spec FROM z), "
       "k AS (SELECT id, age_days, floor((factor * spec * 30.0 + 0.0 + coalesce(exp(-age_days / 90.0), 0.3) * 8.0 + "
       "(CASE WHEN salary_known AND coalesce(salary_max, salary_min) IS NOT NULL THEN greatest(0.0, least(1.0, (coalesce(salary_max, salary_min) - 60000.0) / 190000.0)) ELSE 0.35 END) * 4.0 + 0.5 * 5.0 + quality * 3.0) * 100 + 0.5) / 100 AS score "
       "FROM p JOIN h USING (id), sp WHERE listed) SELECT id, score FROM k ORDER BY score DESC, coalesce(age_days, 9999), id LIMIT 50")
def search_text(spark, sf_dir):
    """Free text gates and ranks: field of the hit times rarity of the words."""
    return search(views.postings(spark, sf_dir), {"text": "the an", "limit": 50}, texts=spread(views.whole_texts(spark, sf_dir))).results.select("id", "score")
