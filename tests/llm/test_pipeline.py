"""Each stage of the pipeline on its own input, held against a plain version."""

import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import tiktoken

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
import corpus_pipeline as C  # noqa: E402
import public_tokenizers  # noqa: E402
from test_operators import SCHEMA, odd_rows  # noqa: E402

from jobtide.llm import byte_bpe, simhash  # noqa: E402
from jobtide.session import materialize  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in C.STAGES:
        out.append(materialize(stage(spark, out[-1], SF), name.replace(" ", "_")))
    return [[r.asDict() for r in df.collect()] for df in out]


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def test_order_and_columns(spark, stages):
    assert [n for n, _ in C.STAGES] == ["language id", "exact dedup", "near dedup", "mixing", "byte bpe"]
    assert all(s[0].keys() == stages[0][0].keys() for s in stages[:-1])


def test_language_keeps_clean_documents(stages):
    assert len(stages[1]) >= 0.99 * len(stages[0])


def test_exact_copies(stages):
    best = {}
    for r in stages[1]:
        key = (r["text"] or "").encode().lower()
        best[key] = max(best.get(key, -1), r["doc_id"])
    assert {r["doc_id"] for r in stages[2]} == set(best.values()) and len(stages[2]) == len(best)


def test_near_copies(stages):
    sets, kept = {r["doc_id"]: shingles(r["text"]) for r in stages[2]}, {r["doc_id"] for r in stages[3]}
    like = lambda a, b: len(a & b) / len(a | b)
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    pairs = {(a, b) for h in holders.values() for a in h for b in h if a < b}
    alike = {p: like(sets[p[0]], sets[p[1]]) for p in pairs}
    assert not [p for p, s in alike.items() if s >= 0.87 and set(p) <= kept]
    for i in set(sets) - kept:
        assert max((s for p, s in alike.items() if i in p), default=0) > 0.6


def linked(sets, least=0.8):
    """The smallest id reachable over exact similarities of ``least`` or more."""
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {i: low if x == high else x for i, x in label.items()}
    return label


def test_near_copies_hold_the_rule_on_both_sides(stages):
    sets, kept = {r["doc_id"]: shingles(r["text"]) for r in stages[2]}, {r["doc_id"] for r in stages[3]}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    pairs = {(a, b) for h in holders.values() for a in h for b in h if a < b}
    alike = {p for p in pairs if len(sets[p[0]] & sets[p[1]]) >= 0.8 * len(sets[p[0]] | sets[p[1]])}
    assert not [p for p in alike if set(p) <= kept]
    assert set(sets) - kept <= {i for p in alike for i in p}


@pytest.mark.parametrize("tile", [4096, 25])
def test_near_copies_of_many_likenesses(spark, tile):
    """Short texts (6 of 7 shingles and the like), repeated shingles, chains; also where a group is cut into pieces."""
    rng, texts = random.Random(5), []
    for n in (5, 8, 10, 12, 13, 14, 30, 60):
        for _ in range(6):
            words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            texts += [" ".join(words), " ".join(words[:-1] + ["x"]), " ".join(["x"] + words[1:]), " ".join(words[1:]), " ".join(words[:-1]), " ".join(words + words)]
    words = [f"v{k}" for k in range(40)]
    for k in range(60):
        words = words[1:] + [f"v{40 + k}"] if k % 2 else [w if rng.random() > 0.02 else f"u{k}" for w in words]
        texts.append(" ".join(words))
    texts += ["lorem ipsum dolor sit amet " * n + end for n in (3, 50, 51) for end in ("", "end")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = simhash.simhash_groups(docs, **simhash.NEAR_COPIES | {"tile": tile}).collect()
    assert {r["id"]: r["component_id"] for r in found} == linked({i: shingles(t) for i, t in enumerate(texts)})


def test_mixing_is_near_its_targets(stages):
    words = lambda r: len((r["text"] or "").split())
    size, taken, times = Counter(), Counter(), Counter(r["doc_id"] for r in stages[4])
    for r in stages[3]:
        size[r["source"]] += words(r)
    for r in stages[4]:
        taken[r["source"]] += words(r)
    want = brute.targets(size)
    largest = max(map(words, stages[3]))
    assert all(abs(taken[s] - want[s]) <= largest for s in size) and max(times.values()) <= 3


def test_encoding(stages):
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks_of(public_tokenizers.path(C.BYTE_RANKS)), special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in stages[4]}
    assert len(stages[5]) == len(stages[4])
    assert all(np.frombuffer(r["ids"], "<u4").tolist() == plain.encode_ordinary(texts[r["doc_id"]] or "") for r in stages[5][:200])


def test_encoding_of_all_rows(stages):
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks_of(public_tokenizers.path(C.BYTE_RANKS)), special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in stages[4]}
    assert Counter(r["doc_id"] for r in stages[5]) == Counter(r["doc_id"] for r in stages[4])
    assert all(np.frombuffer(r["ids"], "<u4").tolist() == plain.encode_ordinary(texts[r["doc_id"]] or "") for r in stages[5])


def test_odd_and_empty_tables(spark):
    for df in (odd_rows(spark), spark.createDataFrame([], SCHEMA)):
        docs = df
        for k, (_, stage) in enumerate(C.STAGES):
            docs = materialize(stage(spark, docs, SF), "odd")
            assert k == len(C.STAGES) - 1 or docs.columns == df.columns
        assert docs.count() <= 3 * df.count()
