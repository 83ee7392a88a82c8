"""The thin queries over the driver's tables: each derives its digest columns from what the operator returns."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_root, materialize
from . import byte_bpe, pii
from .exact_dedup import exact_dedup
from .hard_negatives import hard_negatives
from .jaccard_join import jaccard_groups
from .language_id import identify, train
from .lexical_scan import rank_documents
from .mixing import mix, training_order
from .neighbours import nearest
from .sharding import kd_shards
from .simhash import hex_fingerprint, simhash_groups
from .suffix_dedup import remove_repeats
from .token_output import read_tokens, write_tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_RANKS = "byte_bpe_50k.tiktoken"


@query("op1_pii")
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = pii.find(docs, pii.fit(docs)).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["base"])
    counts = [pii.count_base(F.col("spans"), k).cast("long").alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.written(base), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))


@query("op2_neighbours")
def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


@query("op3_token_output")
def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_root(spark).rstrip('/')}/jobtide/tokens-{uuid.uuid4().hex}"
    write_tokens(documents(spark, sf_dir), folder, public_tokenizers.path(WORD_TOKENIZER), source_col="source")
    return read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1
    model = train(docs.where(~held_out))
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


@query("op5_simhash")
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(documents(spark, sf_dir), shingle=3, radius=3)
    return found.select(F.col("id").alias("doc_id"), hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


@query("op6_byte_bpe")
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN
    encoded = byte_bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), path, pattern).select("doc_id", "ids")
    decoded = byte_bpe.decode(encoded, path)
    return decoded.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op7_mixing", r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS DOUBLE) AS w FROM d GROUP BY source),
r AS (SELECT *, 3.0::DOUBLE * source_size / w AS ratio FROM s),
l AS (SELECT *, (sum(source_size) OVER () - 3.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
  row_number() OVER (ORDER BY ratio, source IS NULL, source) AS place FROM r),
t AS (SELECT source, source_size, CASE WHEN water IS NULL OR ratio <= water THEN 3.0::DOUBLE * source_size ELSE w * water END AS target
  FROM (SELECT *, (SELECT level FROM l WHERE ratio >= level ORDER BY place LIMIT 1) AS water FROM l)),
b AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size = 0 THEN 0 ELSE floor(target / source_size) * size
  + least(size, greatest(floor(target) - floor(target / source_size) * source_size - before, 0)) END AS BIGINT) AS taken
FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source""")
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document gives to the training order, read back from the order as written."""
    plan = materialize(mix(documents(spark, sf_dir)).withColumn("row", F.monotonically_increasing_id()), "mix")
    given = training_order(plan).groupBy("row").agg(F.sum(F.col("end") - F.col("start")).alias("given"))
    return plan.join(given, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("given", F.lit(0)).cast("long").alias("taken"))


@query("op10_sharding")
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = kd_shards(documents(spark, sf_dir), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op8_suffix_dedup")
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op9_exact_dedup", f"""
WITH d AS (SELECT doc_id, {LOWER_SQL} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)""")
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


TERM_SQL = "list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"


@query("op11_lexical_scan", f"""
WITH i AS (SELECT DISTINCT item_id, unnest({TERM_SQL}) AS term FROM benchmark),
d AS (SELECT doc_id, {TERM_SQL.removeprefix('list_distinct(').removesuffix(')')} AS terms FROM documents),
s AS (SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS words FROM d WHERE len(terms) > 0),
o AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM o, s GROUP BY term, docs),
c AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // words)))) AS BIGINT) AS score
  FROM o JOIN w USING (term) JOIN i USING (term), s GROUP BY item_id, doc_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM c WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10""")
def op11_lexical_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=10)


@query("op12_jaccard_join", rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER_SQL}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 1), lambda k: array_to_string(ws[k:k + 2], ' ')) END) AS gram FROM w),
n AS (SELECT doc_id, count(gram) AS n_shingles FROM w LEFT JOIN g USING (doc_id) GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met FROM g a JOIN g b USING (gram) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * met >= 90 * (x.n_shingles + y.n_shingles - met)),
r AS (SELECT doc_id, doc_id AS seen FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.seen = e.a)
SELECT n.doc_id, n_shingles, min(seen) AS component_id FROM n JOIN r ON n.doc_id = r.doc_id GROUP BY ALL""")
def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_groups(documents(spark, sf_dir).select("doc_id", "text"), shingle=3, percent=90)
    return found.withColumnRenamed("id", "doc_id")


@query("op13_hard_negatives", """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""")
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(moved, F.col("id") % 50 == 0)
