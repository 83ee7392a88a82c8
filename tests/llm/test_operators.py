"""The ten operators on odd rows and against plain versions."""

import hashlib
import random
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from jobtide.llm import byte_bpe, exact_dedup, language_id, mixing, neighbours, pii, sharding, simhash, suffix_dedup, token_output  # noqa: E402
from jobtide.llm.components import components  # noqa: E402
from jobtide.llm.queries import QUERIES  # noqa: E402

WORDS, BYTES, PATTERN = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
LONG = "lorem ipsum dolor sit amet " * 4000
TEXTS = [None, "", "   \n", "Hello World, this is it.", "hello world, THIS is it.", "été Ñandú ß 日本語 😀 x", LONG, LONG + "end", "12 34 !!", "a", "Hello World, this is it."]
#: Columns whose names the operators use inside, or that clash with their own results.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, id string, batch string, row string, h string, bucket string, part int, shard int, kept string, n int, key string"


def odd_rows(spark):
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 3 == 0 else f"s{i % 2}", None, 7, "x", None, "r", "h", "b", 1, 2, "k", None, "k") for i, t in enumerate(TEXTS)]
    rows += [(None, "no id", "en", "s1", 1, 1, "x", "b", "r", "h", "b", 1, 2, "k", 1, "k"), rows[3], rows[3]]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return odd_rows(spark).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# 1 — personal data

WEIRD = [
    "a@b.c@d.e x@y.zz_q@r.s", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4 1.2.3", "+1 (988) 555-2485 4041894974608795 4041 8949 7460 8795",
    "é😀 bob@x.org 😀 +49 151 2345678", "a" * 3000 + "@" + "b." * 2000 + "c", "+1" * 3000, "1 " * 5000, " ".join(f"u{i}@m.org" for i in range(300)), "..@..", "a@-.-",
]


def spans_of(rows):
    return [[(s["start"], s["kind"], s["end"]) for s in r["spans"] if s["base"]] for r in rows]


def test_pii_base_spans(spark, odd, empty):
    df = spark.createDataFrame([(t,) for t in WEIRD], "text string")
    rows = pii.find(df, pii.SpanModel()).collect()
    assert spans_of(rows) == [brute.pii(r["text"]) for r in rows]
    rows = pii.find(odd, pii.SpanModel()).collect()
    assert len(rows) == odd.count() and spans_of(rows) == [brute.pii(r["text"]) for r in rows]
    assert pii.find(empty, pii.fit(empty)).count() == 0


def test_pii_query_and_model(spark, sf_dir, docs):
    found = by_id(QUERIES["op1_pii"](spark, sf_dir))
    for i, text in docs:
        spans = brute.pii(text)
        joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert found[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [found[i][f"n_{k}"] for k in pii.KINDS] == [Counter(k for _, k, _ in spans)[j] for j in range(4)]
        assert set(joined.split(",")) <= set(found[i]["spans"].split(",")) or not joined


def test_pii_trees_add_loose_spans(spark):
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = pii.fit(base, least=10)
    assert model.trees and model.thresholds
    texts = ["call (212) 555-0199 x", "bob [at] mail.example.com", "plain words 2024-01-02 and 17", "mail bob@x.org now"]
    rows = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").select("*", pii.redact(F.col("text"), F.col("spans")).alias("clean")).collect()
    extra = [[r["text"][s["start"]:s["end"]] for s in r["spans"] if not s["base"]] for r in rows]
    assert extra[2:] == [[], []] and (extra[0] == ["(212) 555-0199"] or extra[1] == ["bob [at] mail.example.com"])
    assert rows[3]["clean"] == "mail [email] now"


def test_native_plan_has_no_python(spark, sf_dir):
    plan = pii.find(spark.read.parquet(f"{sf_dir}/documents.parquet"), pii.SpanModel())._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))


@pytest.mark.parametrize("form", ["phone", "email", "card"])
def test_pii_natural_loose_forms_do_not_switch_their_generator_off(spark, form):
    """Production parameters, on a corpus where a loose form is as common as its base form."""
    rng = random.Random(6)

    def card():
        d = [rng.randrange(1, 10), *(rng.randrange(10) for _ in range(14))]
        odd = sum(sum(divmod(2 * x, 10)) if k % 2 == 0 else x for k, x in enumerate(d))
        return "".join(map(str, [*d, -odd % 10]))

    def row():
        a, b, c = rng.randrange(200, 999), rng.randrange(200, 999), rng.randrange(1000, 9999)
        n, name = card(), f"u{rng.randrange(999)}"
        loose = {"phone": f"({a}) {b}-{c}", "email": f"{name} [at] mail{b}.org", "card": ".".join(n[k:k + 4] for k in range(0, 16, 4))}[form]
        base = {"phone": f"+1 ({a}) {b}-{c}", "email": f"{name}@mail{b}.org", "card": n}[form]
        return f"some words {base} and more", f"other words {loose} at the end", f"version {a}.{b} of 2024-01-{a % 28 + 1:02d} and {b}", loose

    rows = [row() for _ in range(400)]
    docs = spark.createDataFrame([(3 * i + j, r[j]) for i, r in enumerate(rows) for j in range(3)], "doc_id long, text string")
    found = {r["doc_id"]: [r["text"][s["start"]:s["end"]] for s in r["spans"] if not s["base"]] for r in pii.find(docs, pii.fit(docs)).collect()}
    assert sum(r[3] in found[3 * i + 1] for i, r in enumerate(rows)) >= 0.9 * len(rows)
    assert not any(found[3 * i + 2] for i in range(len(rows)))


def test_pii_fits_on_all_documents(spark):
    """60 base addresses in 12,000 documents: a third of them holds too few to set the loose generator's threshold."""
    docs = spark.range(12000).selectExpr("id AS doc_id", "CASE WHEN id % 200 = 0 THEN concat('write to u', id, '@mail', id, '.org now') ELSE concat('see page 12 34 of ', id) END AS text")
    assert 4 in pii.fit(docs).thresholds
    examples = pii.training_rows(docs, "text")
    assert examples.where("generator = 4").agg(F.sum("weight")).first()[0] == 60 and examples.count() < 400


# 2 — nearest neighbours

def test_neighbours_recall(spark, sf_dir):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    some = table.where("vec_id % 100 = 0")
    rows = neighbours.nearest(table, some, floor=64).collect()
    base = table.orderBy("vec_id").collect()
    ids, vectors = [r["vec_id"] for r in base], np.array([r["embedding"] for r in base], float)
    found = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["rank"]):
        found[r["query_id"]].append(r["vec_id"])
    assert len(found) == some.count() and all(len(v) == 10 for v in found.values())
    recall = np.mean([len(set(v) & set(brute.nearest(ids, vectors, q))) / 10 for q, v in found.items()])
    assert recall >= 0.9


def test_neighbours_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [0.0, 2.0]), (8, []), (9, [1.0, 2.0, 3.0]), (100, [1.0, 0.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("shard", F.lit("clash"))
    out = [tuple(r) for r in neighbours.nearest(df, df.where("vec_id % 100 = 0"), k=3, sample=100).orderBy("query_id", "rank").collect()]
    assert out == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 100, 0.0), (100, 1, 0, 0.0), (100, 2, 1, 0.0), (100, 3, 2, 0.0)]
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0


def test_neighbours_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [1.0, 0.0]), (1, [0.0, 2.0]), (1, [0.0, 2.0]), (2, [3.0, 0.0]), (2, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    least = {i: min((np.array(v).tobytes(), v) for j, v in rows if j == i)[1] for i in (0, 1, 2)}
    want = sorted((float(np.linalg.norm(np.subtract(least[0], least[i]))), i) for i in (1, 2))
    out = [tuple(r) for r in neighbours.nearest(df, df.where("vec_id = 0"), k=10, sample=100).orderBy("query_id", "rank").collect()]
    assert out == [(0, k + 1, i, d) for k, (d, i) in enumerate(want)]


# 3 — token files

def plain_ids(texts, special=True):
    """The library as it comes; without ``special`` it takes special tokens' strings as ordinary text."""
    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = not special
    return [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]


def test_token_query(spark, sf_dir, docs):
    found, start = by_id(QUERIES["op3_token_output"](spark, sf_dir)), 0
    for (i, _), ids in zip(sorted(docs), plain_ids([t for _, t in sorted(docs)])):
        assert tuple(found[i]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_of_odd_rows(spark, odd, empty, tmp_path):
    token_output.write_tokens(odd, str(tmp_path / "a"), WORDS, file_ids=1000)
    rows = token_output.read_tokens(spark, str(tmp_path / "a")).collect()
    want = Counter((r["doc_id"], tuple(i)) for r, i in zip(odd.collect(), plain_ids([r["text"] for r in odd.collect()])))
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in rows) == want
    starts = sorted((r["start"], r["n_tokens"]) for r in rows)
    assert all(s + n == t for (s, n), (t, _) in zip(starts, starts[1:])) and starts[0][0] == 0
    token_output.write_tokens(empty, str(tmp_path / "b"), WORDS)
    assert token_output.read_tokens(spark, str(tmp_path / "b")).count() == 0


def test_token_file_reads_one_document():
    ids = [np.arange(n, dtype="<u4") for n in (5, 0, 70_000)]
    file = token_output.TokenFile(token_output.pack_file(ids, [3, 8, 9], b""), b"")
    assert file.find(9) == 2 and file.find(4) is None and file.ids(2).tolist() == list(range(70_000)) and file.ids(1).tolist() == []
    with pytest.raises(ValueError):
        token_output.TokenFile(token_output.pack_file(ids, [3, 8, 9], b""), b"other")


def test_word_encoder_equals_library():
    random.seed(3)
    parts = ["a", "A", " ", "\n", "\t", "́", "é", "'s", "..", ".", ",", "?!", "1", "23", "½", "_", "İ", "Σ", "日", "😀", " ", "\x1c", "<|endoftext|>", "don't", "\r", "--"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 25))) for _ in range(4000)]
    got = [[*i.tolist(), 1] for i in token_output.WordEncoder(WORDS).encode(pa.array(texts))]
    assert got == plain_ids(texts, special=False)


def test_special_tokens_in_a_text_equal_the_library(spark, tmp_path):
    plain = Tokenizer.from_file(WORDS)
    random.seed(4)
    parts = ["the", " ", "\n", "mark", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endoftext", "|>", "É", "́", ".", "İ", "<"]
    texts = ["the <|endoftext|> mark", *("".join(random.choice(parts) for _ in range(random.randint(0, 12))) for _ in range(2000))]
    want = [[*plain.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    token_output.write_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), str(tmp_path / "a"), WORDS)
    rows = token_output.read_tokens(spark, str(tmp_path / "a")).orderBy("doc_id").collect()
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in rows] == want


# 4 — language

def test_language_learns_from_the_rows_that_have_letters(spark):
    english, spanish = "the quick brown fox jumps over the lazy dog and runs home", "el perro corre por la calle y la casa es muy grande"
    rows = [(i, (english if i % 2 else spanish) if i % 200 < 2 else None if i % 3 else "12 34 !!", "en" if i % 2 else "es") for i in range(4000)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=5)
    assert set(model.languages) == {"en", "es"} and model.predict([english, spanish])[0] == ["en", "es"]


@pytest.mark.parametrize("ids", ["cast(null as bigint)", "7L", "id"])
def test_language_learns_whatever_the_ids(spark, ids):
    english, spanish = "the quick brown fox jumps over the lazy dog and runs home", "el perro corre por la calle y la casa es muy grande"
    rows = spark.range(20_000).selectExpr(f"{ids} as doc_id", f"if(id % 2 = 0, '{english}', '{spanish}') || if(id % 3 = 0, ' ' || id, '') as text", "if(id % 2 = 0, 'en', 'es') as lang")
    assert set(language_id.train(rows, per_language=50).languages) == {"en", "es"}
    same = spark.range(20_000).selectExpr(f"{ids} as doc_id", f"'{english}' as text", "'en' as lang")
    assert language_id.train(same, per_language=50).predict([english])[0] == ["en"]


def test_language_equals_plain_nearest_centroid(spark, docs):
    """The fitted model applied word for word: counts of hashed n-grams, weights, cosines one by one."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(table, per_language=60)
    texts = [t for _, t in docs[:60]] + ["", "12 !", "á", "zzz qqq"]

    def plain(text):
        letters = language_id.letters_of(text or "")
        if not letters:
            return "und", 0.0
        data, counts = f" {letters} ".encode(), Counter()
        for n in language_id.GRAMS:
            for k in range(len(data) - n + 1):
                code = n
                for byte in data[k:k + n]:
                    code = (code * 257 + byte) % 2**32
                counts[(code * 2654435761 % 2**32) >> 20] += 1
        weights = {g: c * float(model.idf[g]) for g, c in counts.items()}
        length = sum(w * w for w in weights.values()) ** 0.5
        cosines = [(sum(w * float(c[g]) for g, w in weights.items()) / length, name) for c, name in zip(model.centroids, model.languages, strict=True)]
        best = max(c for c, _ in cosines)
        return {name for c, name in cosines if c > best - 1e-5}, best

    rows = language_id.identify(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()
    for r in rows:
        name, score = plain(r["text"])
        assert r["lang_pred"] in name and abs(r["score"] - score) < 1e-4


def test_language_query(spark, sf_dir):
    found = QUERIES["op4_language_id"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").collect()
    held = [r for r in found if r["held_out"]]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in found if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1}
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found) and np.mean([r["rejected"] for r in found]) < 0.01


def test_language_odd_rows(spark, odd, empty):
    model = language_id.train(odd)
    found = language_id.identify(odd, model, prefix="x_").collect()
    assert len(found) == odd.count()
    assert {r["x_lang_pred"] for r in found if r["text"] in (None, "", "   \n", "12 34 !!")} == {"und"}
    assert {r["x_lang_pred"] for r in found if r["text"] in (LONG, "a")} == {"en"}
    none = language_id.train(empty)
    assert language_id.identify(empty, none).count() == 0 and {r["lang_pred"] for r in language_id.identify(odd, none).collect()} == {"und"}


# 5 — SimHash

def test_simhash_query(spark, sf_dir, docs):
    found = by_id(QUERIES["op5_simhash"](spark, sf_dir))
    prints = [(i, brute.fingerprint(t)) for i, t in docs]
    assert [found[i]["fingerprint"] for i, _ in prints] == [f"{p:016x}" for _, p in prints]
    assert [found[i]["component_id"] for i, _ in prints] == brute.groups(prints)


def test_simhash_odd_rows(spark, odd, empty):
    rows = simhash.simhash_groups(odd).collect()
    assert len(rows) == odd.count() and [r["component_id"] for r in rows if r["id"] is None] == [None]
    component = {r["id"]: r["component_id"] for r in rows}
    assert component[0] == component[1] == component[2] == 0 and component[3] == component[4] == component[10] == 3 and component[7] == component[6] == 6
    assert simhash.simhash_groups(empty).count() == 0 and simhash.keep_one(empty).columns == empty.columns


@pytest.mark.parametrize(("words", "radius"), [(1, 3), (2, 20), (16, 164)])
def test_bit_sliced_comparison(words, radius):
    rng = np.random.default_rng(0)
    n = 200
    prints = rng.integers(0, 2**63, (12, words)).astype(np.uint64)[rng.integers(0, 12, n)]
    for i in range(n):
        for _ in range(rng.integers(0, radius + 2)):
            prints[i, rng.integers(0, words)] ^= np.uint64(1) << np.uint64(rng.integers(0, 64))
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if np.bitwise_count(prints[i] ^ prints[j]).sum() <= radius}
    lane = np.arange(n)
    assert {p for u, v in simhash.near(prints, lane, lane + 1, np.full(n, n), radius) for p in zip(u.tolist(), v.tolist())} == want


def test_simhash_hot_bucket_is_cut(spark):
    """Buckets cut into pieces find the same groups."""
    random.seed(1)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(120):
        words = list(base)
        words[random.randrange(300)] = f"x{i}"
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = sorted(tuple(r) for r in simhash.simhash_groups(df).select("id", "component_id").collect())
    assert whole == sorted(tuple(r) for r in simhash.simhash_groups(df, tile=16).select("id", "component_id").collect())
    assert [c for _, c in whole] == brute.groups([(i, brute.fingerprint(t)) for i, t in enumerate(texts)])


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 300), (7, 7), (300, 100)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 100}


# 6 — byte BPE

def test_bpe_query(spark, sf_dir, docs):
    plain = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.ranks_of(BYTES), special_tokens={})
    found = by_id(QUERIES["op6_byte_bpe"](spark, sf_dir))
    for i, text in docs:
        ids = plain.encode_ordinary(text)
        assert tuple(found[i]) == (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_bpe_odd_rows(odd, empty):
    plain = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.ranks_of(BYTES), special_tokens={})
    for r in byte_bpe.decode(byte_bpe.encode(odd, BYTES, PATTERN), BYTES).collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == plain.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    assert byte_bpe.encode(empty, BYTES, PATTERN).count() == 0


def test_bpe_equals_library_and_edits():
    random.seed(1)
    own = byte_bpe.codec(BYTES, PATTERN)
    plain = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own.vocabulary.ranks, special_tokens={})
    parts = ["a", " ", "  ", "\n", "'s", "é", "the", "ing", "1", "23", "!", "...", "😀", "\t", "日本", " ", "\x1c", "==", "aaaa", "    "]
    for _ in range(3000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 30)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == plain.encode_ordinary(text)
    for text in ("a" * 3000, "ab" * 2000, "=" * 5000, " " * 2000):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == plain.encode_ordinary(text)
    for _ in range(300):
        data = bytes(random.choice(b"abcdeti \xc3\xa9") for _ in range(random.randint(0, 300)))
        i = random.randint(0, len(data))
        j, new = random.randint(i, len(data)), bytes(random.choice(b"theing") for _ in range(random.randint(0, 6)))
        edited = byte_bpe.PrefixEncoder(own.vocabulary, data).replace(i, j, new)
        assert edited.last == byte_bpe.PrefixEncoder(own.vocabulary, data[:i] + new + data[j:]).last
        assert byte_bpe.PrefixEncoder(own.vocabulary, data[:i]).append(data[i:]).ids() == byte_bpe.PrefixEncoder(own.vocabulary, data).ids()


# 7 — mixing

@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1000, "b": 1, "c": 2, None: 3}, {"a": 5}, {None: 10, "z": 90, "y": 1, "x": 400, "w": 7}])
def test_targets(spark, sizes):
    rows = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = brute.targets(sizes)
    assert {r["source"]: pytest.approx(r["target"]) for r in rows} == want


def test_mixing_query(spark, sf_dir):
    rows = QUERIES["op7_mixing"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source"), "doc_id").collect()
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
    want, taken = brute.targets(sizes), Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_mixing_odd_rows(odd, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and all(r["taken"] == 0 for r in rows if not (r["size"] or 0))
    assert rows == mixing.mix(odd.repartition(5)).collect() or sorted(map(str, rows)) == sorted(map(str, mixing.mix(odd.repartition(5)).collect()))
    order = mixing.curriculum(odd)
    assert order.columns == odd.columns and order.count() == sum(len(r["times"]) for r in mixing.mix(odd, whole_documents=True).collect())
    assert mixing.mix(empty).count() == 0 and mixing.curriculum(empty).count() == 0


def test_mixing_order(spark, sf_dir, odd):
    """Passes follow each other without gaps in the order of the schedules, and give what the mix takes."""
    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet"), odd):
        plan = mixing.mix(docs)
        order = mixing.training_order(plan).orderBy("start", "end").collect()
        assert [r["start"] for r in order] == [0, *[r["end"] for r in order]][:-1]
        at = [r["at"] for r in order]
        assert at == sorted(at) and at[-1] <= 1
        taken = plan.agg(F.sum("taken"), F.sum(F.size("times"))).first()
        assert (order[-1]["end"], len(order)) == tuple(taken)


def test_mixing_query_follows_the_order(spark, sf_dir, monkeypatch):
    """The query's words are those of the written training order."""
    from jobtide.llm import queries
    seen = []
    monkeypatch.setattr(queries, "training_order", lambda plan: seen.append(mixing.training_order(plan)) or seen[0].where("pass = 0"))
    once = QUERIES["op7_mixing"](spark, sf_dir).agg(F.sum("taken")).first()[0]
    assert once == seen[0].where("pass = 0").selectExpr("sum(end - start)").first()[0] < seen[0].selectExpr("sum(end - start)").first()[0]


def test_due_time_inverts_the_schedule(spark):
    df = spark.range(101).select((F.col("id") / 100).alias("share"))
    for k, knots in enumerate(mixing.SCHEDULES):
        got = [r[0] for r in df.select(mixing.due_time(F.col("share"), F.lit(k))).collect()]
        grid = np.linspace(0, 1, 20001)
        weight = np.interp(grid, np.linspace(0, 1, len(knots)), knots)
        integral = np.concatenate(([0], np.cumsum((weight[1:] + weight[:-1]) / 2)))
        assert np.allclose(np.interp(got, grid, integral / integral[-1]), np.arange(101) / 100, atol=1e-6)


# 8 — repeated passages

def digest(df):
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", removed, F.size("spans").cast("long"), F.sha2("kept", 256)).collect()), key=repr)


def test_repeats_of_odd_rows(spark, odd, empty):
    random.seed(5)
    passages = ["".join(random.choice("abcdé ") for _ in range(random.choice((49, 50, 51, 60, 90, 200)))) for _ in range(12)]
    rows = [(i, "".join(random.choice(passages)[random.randint(0, 20):] if random.random() < 0.5 else "".join(random.choice("abcd") for _ in range(random.randint(0, 80))) for _ in range(random.randint(0, 5)))) for i in range(80)]
    rows += [(200, "a" * 500), (201, "a" * 300), (202, None), (203, ""), (None, passages[5] * 2), (204, "ab" * 200), (205, "ab" * 100), (3, passages[6] + "zz"), (3, passages[6] + "zz")]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = sorted(brute.repeats(rows), key=repr)
    assert digest(suffix_dedup.remove_repeats(df)) == want
    assert digest(suffix_dedup.remove_repeats(df, batch_bytes=3000, batch_suffixes=500)) == want
    assert digest(suffix_dedup.remove_repeats(odd)) == sorted(brute.repeats([(r["doc_id"], r["text"]) for r in odd.collect()]), key=repr)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_family_scans_levels_as_batches_come():
    rng = np.random.default_rng(2)
    pool = np.array([rng.bytes(suffix_dedup.LENGTH) for _ in range(300)], f"S{suffix_dedup.LENGTH}")
    family, suffixes, worth = suffix_dedup.SuffixFamily(), [], []
    for size in (64, 1, 1, 2, 128, 16, 3, 1):
        suffixes.append(pool[rng.integers(0, 300, size)])
        worth.append(rng.integers(0, 1000, size))
        before = {s for l in family.levels for s in l.keys.tolist()}
        found = family.found
        family.add(suffixes[-1], worth[-1])
        assert (family.found > found) == bool(before & set(suffixes[-1].tolist()))
        sizes = [len(l.keys) for l in family.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))
        every, value = np.concatenate(suffixes), np.concatenate(worth)
        assert family.least().tolist() == [value[every == s].min() for s in every]  # right after every batch, not at the end alone
    assert family.found > 20 and len(family.levels) > 1
    family.add(suffixes[0][:0], worth[0][:0])
    assert len(family.least()) == sum(map(len, suffixes)) and suffix_dedup.SuffixFamily().least().tolist() == []


def test_repeats_query(spark, sf_dir, docs):
    assert sorted((tuple(r) for r in QUERIES["op8_suffix_dedup"](spark, sf_dir).collect()), key=repr) == sorted(brute.repeats(docs), key=repr)


# 9 — exact dedup (the query is also held against SQL)

def test_exact_odd_rows(odd, empty):
    rows = exact_dedup.exact_dedup(odd).collect()
    assert len(rows) == odd.count()
    kept = [r for r in rows if r["kept"]]
    assert len(kept) == len({(r["row"]["text"] or "").lower() for r in rows})
    equal = [r for r in rows if (r["row"]["text"] or "").lower() == "hello world, this is it."]
    assert {(r["keep_id"], r["group_size"]) for r in equal} == {(10, 5)} and sum(r["kept"] for r in equal) == 1
    assert {r["keep_id"] for r in rows if not r["row"]["text"]} == {1} and {r["keep_id"] for r in rows if r["row"]["doc_id"] is None} == {None}
    assert exact_dedup.keep_one(odd).columns == odd.columns and exact_dedup.exact_dedup(empty).count() == 0


def test_exact_recursion(spark):
    """A tiny bound makes every bucket split again and again; one content alone cannot split and stays."""
    df = spark.createDataFrame([(i, f"text {i % 50} " * 20) for i in range(400)], "doc_id long, text string")
    found = exact_dedup.exact_dedup(df, limit_bytes=300, fanout=2).collect()
    assert all(r["keep_id"] == 350 + r["row"]["doc_id"] % 50 and r["group_size"] == 8 for r in found) and len(found) == 400


def test_content_table_compares_contents():
    table = exact_dedup.ContentTable(4)
    places = [table.add(7, bytes([i % 40]), 1, (i, 0, 0)) for i in range(200)]
    assert places == [i % 40 for i in range(200)] and table.count == [5] * 40 and table.best[3] == (163, 0, 0)


# 10 — sharding

def test_sharding_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op10_sharding"](spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    total, slots = Counter(), defaultdict(list)
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        total[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert sorted(total) == list(range(16)) and len(rows) == len(texts)
    mean, largest = sum(total.values()) / 16, max(r["size"] for r in rows)
    assert max(abs(t - mean) for t in total.values()) <= max(largest, 0.02 * mean)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_sharding_tree_equals_plain_splits(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(w), int(t), int(a), int(b)) for w, t, a, b in zip(rng.integers(1, 50, 400), rng.integers(0, 1 << sharding.TIE, 400), rng.integers(0, 1 << 20, 400), rng.integers(0, 5, 400) * 1000, strict=True)]
    dims, levels = ["d_a", "d_b"], 3

    def plain(points, node, level):
        if level == levels or not points:
            return {p: node << (levels - level) for p in points}
        spans = [max(p[k] for p in points) - min(p[k] for p in points) for k in (2, 3)]
        dim = 2 if spans[0] >= spans[1] else 3
        ordered, total, below = sorted(points, key=lambda p: (p[dim], p[1])), sum(p[0] for p in points), 0
        for at, p in enumerate(ordered):
            if 2 * (below + p[0]) >= total:
                break
            below += p[0]
        cut = at + 1 if abs(2 * (below + p[0]) - total) <= abs(2 * below - total) else at
        return plain(ordered[:cut], 2 * node, level + 1) | plain(ordered[cut:], 2 * node + 1, level + 1)

    points = spark.createDataFrame(rows, "weight long, tie long, d_a long, d_b long").cache()
    cuts = sharding.split_tree(points, dims, levels, 0.0)
    found = {tuple(r)[:4]: r["leaf"] for r in points.withColumn("leaf", sharding._node(cuts, dims)).collect()}
    assert found == plain(rows, 0, 0) and len(set(found.values())) == 8
    with pytest.raises(ValueError):
        sharding.kd_shards(points, shards=12)


def test_sharding_odd_rows(spark, odd, empty):
    rows = sharding.kd_shards(odd, shards=4).collect()
    assert len(rows) == odd.count()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sharding.kd_shards(empty).count() == 0
    same = spark.createDataFrame([(i, "same text") for i in range(1000)], "doc_id long, text string")
    counts = Counter(r["shard"] for r in sharding.kd_shards(same, shards=8, source_col=None).collect())
    assert len(counts) == 8 and max(counts.values()) - min(counts.values()) <= 4
