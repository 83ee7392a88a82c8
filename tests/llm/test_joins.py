"""Lexical scan, Jaccard join and hard negatives on odd rows and against plain versions."""

import math
import random
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

from jobtide.llm import hard_negatives, jaccard_join, lexical_scan  # noqa: E402
from jobtide.llm.queries import QUERIES  # noqa: E402

LONG = "lorem ipsum dolor sit amet " * 4000
TEXTS = [None, "", "   \n", "Hello World, this is it.", "hello world, THIS is it.", "été Ñandú ß 日本語 😀 x", LONG, LONG + "end", "12 34 !!", "a", "Hello World, this is it."]
SCHEMA = "doc_id long, text string, lang string, id string, block int, gram string, place int, score long, rank int, n int, shared string, item_id string"


def odd_rows(spark):
    rows = [(i, t, "en", "x", 1, "g", 2, 3, 4, 5, "s", "i") for i, t in enumerate(TEXTS)]
    rows += [(None, "Hello World, this is it.", "en", "x", 1, "g", 2, 3, 4, 5, "s", "i"), rows[3], rows[6]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 11 — lexical scan

def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, k):
    """{item: [(score, doc_id), ...]}; null ids last."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, words = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = {}
    for item, text in items:
        scores = []
        for i, c in counts:
            m = 10 + 90 * sum(c.values()) * n_docs // words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out[item] = [(-s[0], s[3]) for s in sorted(scores)[:k]]
    return {i: r for i, r in out.items() if r}


def answers(df):
    got = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["item_id"], r["rank"])):
        got[r["item_id"]].append((r["score"], r["doc_id"]))
        assert r["rank"] == len(got[r["item_id"]])
    return dict(got)


@pytest.mark.parametrize("block_terms", [100_000, 5])
def test_lexical_scan_odd_rows(spark, block_terms):
    docs = odd_rows(spark)
    items = [(1, "Hello hello IPSUM"), (2, "日本語 x-ray été"), (3, None), (4, "..."), (5, "it"), (6, "unseen words"), (7, "a 12 34 amet")]
    df = spark.createDataFrame([*items, (None, "hello")], "item_id long, text string").withColumn("score", F.lit(1)).withColumn("term", F.lit("t"))
    found = answers(lexical_scan.rank_documents(docs, df, k=4, block_terms=block_terms))
    assert found == ranked([(r["doc_id"], r["text"]) for r in docs.collect()], items, 4)


def test_lexical_scan_empty(spark, empty):
    items = spark.createDataFrame([(1, "hello")], "item_id long, text string")
    assert lexical_scan.rank_documents(empty, items).count() == 0
    assert lexical_scan.rank_documents(odd_rows(spark), items.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, None), (2, " .. ")], "doc_id long, text string")
    assert lexical_scan.rank_documents(blank, items).count() == 0


def test_lexical_scan_shared_item_ids_and_ties(spark):
    docs = spark.createDataFrame([(i, "Tie me") for i in range(30)] + [(99, "other thing"), (98, "me")], "doc_id long, text string").repartition(5)
    items = spark.createDataFrame([(1, "tie"), (1, "other")], "item_id long, text string")
    found = answers(lexical_scan.rank_documents(docs, items, k=5))
    assert [d for _, d in found[1]] == [99, 0, 1, 2, 3]


def test_term_reader_counts_whole_terms():
    read = lexical_scan.TermReader(["a", "an", "été", "1"])
    length, places, counts = read("An a a, an-a été étéx banana 1 1a A_a")
    assert (length, dict(zip(places.tolist(), counts.tolist(), strict=True))) == (12, {0: 5, 1: 2, 2: 1, 3: 1})


# 12 — Jaccard join

def sets_of(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[k:k + size]) for k in range(len(words) - size + 1)} if len(words) >= size else {" ".join(words)} if words else set()


def joined(rows, percent=90, size=3):
    """[(id, n, component)] sorted."""
    sets = [(i, sets_of(t, size)) for i, t in rows]
    holders, parent = defaultdict(list), {i: i for i, _ in rows if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for at, (i, s) in enumerate(sets):
        if i is None:
            continue
        for other, both in Counter(o for g in s for o in holders[g]).items():
            if 100 * both >= percent * (len(s) + len(sets[other][1]) - both):
                a, b = root(i), root(sets[other][0])
                parent[max(a, b)] = min(a, b)
        for g in s:
            holders[g].append(at)
    return sorted(((i, len(s), None if i is None else root(i)) for i, s in sets), key=str)


def near_copies(seed, bases=6, copies=40):
    """Groups around the threshold: copies of a text with so many words changed that some link and some do not."""
    rng, rows = random.Random(seed), []
    passage = [f"p{k}" for k in range(30)]
    for b in range(bases):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([5, 12, 40, 130]))] + (passage if b % 2 else [])
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randrange(1 + max(1, len(words) // 30))):
                words[rng.randrange(len(words))] = f"w{rng.randrange(5000)}"
            rows.append(" ".join(words))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "percent", "size"), [(1, 90, 3), (2, 80, 5), (3, 60, 1)])
def test_jaccard_near_threshold(spark, seed, percent, size):
    rows = near_copies(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = jaccard_join.jaccard_groups(df, shingle=size, percent=percent).collect()
    assert sorted(map(tuple, found), key=str) == joined(rows, percent, size)


def test_jaccard_pieces_of_a_hot_gram(spark, monkeypatch):
    """With tiny pieces every n-gram of a group is compared across many pairs of pieces; pairs held back come in later rounds."""
    monkeypatch.setattr(jaccard_join, "TILE", 8)
    rows = near_copies(5, bases=2, copies=60)
    sets = jaccard_join.ordered_sets(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, "text", "doc_id").where("whole is not null").cache()
    first = sets.groupBy("whole").agg(F.min("id").alias("first"))
    one = sets.join(first, "whole").where("id = first").drop("first")
    members = sets.join(first, "whole").select(F.col("id").alias("a"), F.col("first").alias("b"))
    named = {r["node"]: r["component"] for r in jaccard_join.links(one, members, 90, most=1).collect()}
    assert [(i, n, named.get(i, i)) for i, n, _ in joined(rows)] == joined(rows)


def test_jaccard_query_and_odd_rows(spark, sf_dir, empty):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op12_jaccard_join"](spark, sf_dir).collect()), key=str) == joined(rows)
    odd = odd_rows(spark)
    found = jaccard_join.jaccard_groups(odd).collect()
    assert sorted(map(tuple, found), key=str) == joined([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert jaccard_join.jaccard_groups(empty).count() == 0
    with pytest.raises(ValueError):
        jaccard_join.jaccard_groups(odd, percent=0)


def test_jaccard_rare_first_order(spark):
    """Of a document with enough n-grams of its own nothing is kept; of others, n-grams come in order of their document count."""
    shared = "s1 s2 s3 s4 s5 s6"
    texts = [shared + f" a{k}" for k in range(4)] + ["s1 s2 s3", " ".join(f"u{k}" for k in range(50)) + " " + shared]
    rows = {r["id"]: r for r in jaccard_join.ordered_sets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 50, "text", "doc_id").collect()}
    assert rows[5]["shared"] is None and rows[5]["n"] == 54 and rows[0]["singles"] == 1 and len(rows[0]["shared"]) == 4
    grams = jaccard_join.shingle_hashes("s1 s2 s3", 3).view(np.int64)
    assert rows[0]["shared"][-1] == grams[0]  # held by one document more than the others


# 13 — hard negatives

def mined(rows, every=50, positives=5, negatives=3):
    """Rows are (id, label, integer vector)."""
    out = []
    for a, label, v in rows:
        if a % every:
            continue
        scored = sorted((-sum(int(x) * int(y) for x, y in zip(v, w, strict=True)), i, other == label) for i, other, w in rows if i != a)
        for s, p, _ in [r for r in scored if r[2]][:positives]:
            fits = [(-t, n) for t, n, same in scored if not same and 50 * -s <= 100 * -t <= 95 * -s][:negatives]
            out += [(a, p, k + 1, n, -s, t) for k, (t, n) in enumerate(fits)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("id", F.lit("x")).withColumn("shard", F.lit(1)).repartition(3)


@pytest.mark.parametrize("kind", ["clusters", "isotropic", "equal", "lattice"])
def test_hard_negatives_exact(spark, kind):
    rng = np.random.default_rng(4)
    n, d = 900, 8
    points = {"clusters": rng.normal(size=(12, d))[rng.integers(0, 12, n)] + 0.05 * rng.normal(size=(n, d)), "isotropic": rng.normal(size=(n, d)),
              "equal": np.ones((n, d)), "lattice": rng.integers(-1, 2, (n, d)) / 256}[kind]
    labels = rng.integers(0, 3, n)
    found = hard_negatives.hard_negatives(vectors(spark, [(i, p.tolist(), int(c)) for i, (p, c) in enumerate(zip(points, labels, strict=True))]), F.col("id") % 50 == 0, shard_rows=300)
    assert sorted(map(tuple, found.collect())) == mined([(i, c, np.floor(256 * p).astype(int)) for i, (p, c) in enumerate(zip(points, labels, strict=True))])


def test_hard_negatives_prunes_siblings():
    rng = np.random.default_rng(0)
    points = np.floor(256 * (np.repeat(rng.normal(size=(20, 16)), 100, axis=0) + 0.01 * rng.normal(size=(2000, 16)))).astype(np.int64)
    tree = hard_negatives.SplitTree(np.arange(2000), np.zeros(2000, np.int64), points, 1)
    seen, plain = [], hard_negatives.inner
    try:
        hard_negatives.inner = lambda a, b: seen.append(a.shape[0] * b.shape[0]) or plain(a, b)
        best = tree.search(np.array([0]), np.array([0]), points[:1], np.array([hard_negatives.NONE]), np.array([2**62]), True, 5)
    finally:
        hard_negatives.inner = plain
    assert sum(seen) <= 600 and [i for _, i in best[0]] == sorted(range(1, 2000), key=lambda i: (-int(points[i] @ points[0]), i))[:5]


def test_hard_negatives_odd_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.1], 1), (2, [0.9, 0.2], 2), (3, None, 1), (4, [], 1), (5, [1.0, None], 2), (6, [float("nan"), 1.0], 2),
            (7, [float("inf"), 1.0], 2), (8, [1e300, 1.0], 2), (9, [1.0, 1.0, 1.0], 2), (None, [1.0, 0.0], 2), (10, [0.8, 0.0], None), (11, [0.7, 0.0], 2), (2, [0.9, 0.2], 2), (50, [0.0, -1.0], 5),
            (12, [0.0, 0.0], 3), (11, [0.1, 0.0], 7)]
    found = sorted(map(tuple, hard_negatives.hard_negatives(vectors(spark, rows), F.col("id") % 50 == 0).collect()))
    whole = [(i, c, np.floor(256 * np.array(v)).astype(int)) for i, v, c in [rows[k] for k in (0, 1, 2, 12, 14, 15)]]
    assert found == mined(whole) and len(found) == 2
    assert hard_negatives.hard_negatives(vectors(spark, rows).limit(0), F.col("id") % 50 == 0).count() == 0
