"""Many saved searches in one scan: a bit per profile and bucket, one aggregate for all totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold
from ..operators import criteria, textindex
from .profile import normalize_profile

col = F.col
WORD = 62  # profiles whose bits share one long


def _asks(p: dict) -> bool:
    return bool(p["text"] or criteria.searchable(p["description_keywords"]) or p["exclude_description_keywords"])


def _bits(flags: list[tuple[int, Column]]) -> Column:
    """A long with bit i set where the flag of profile i holds."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(flag, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, flag in flags], F.lit(0).cast("long"))


def has_bit(bits: Column, i: int) -> Column:
    return bits.bitwiseAND(F.lit(1 << i)) != 0


def text_bits(texts: DataFrame, profiles: list[dict]) -> DataFrame:
    """(id, _has, _hit, _open) in one narrow scan: whether there is a body, whose keywords it holds, and which profiles' text gates it passes."""
    asked = [(i, p) for i, p in enumerate(profiles) if _asks(p)]

    def answer(t: Column) -> Column:
        def opens(p: dict) -> Column:
            gate = F.lit(True)
            words = list(dict.fromkeys(textindex.words_of(p["text"])))
            if p["text"]:
                each = [textindex.starts_words(t[f], words) for f in textindex.FIELDS] if words else []
                gate = reduce(lambda a, i: a & reduce(lambda x, y: x | y, [e[i] for e in each]), range(len(words)), gate) if words else F.lit(False)
            if p["exclude_description_keywords"]:
                gate = gate & ~textindex.holds_phrases(t["body"], p["exclude_description_keywords"])
            return gate

        hits = [(i, textindex.holds_phrases(t["body"], criteria.searchable(p["description_keywords"]), p["description_match"])) for i, p in asked if p["description_keywords"]]
        return F.struct(_bits(hits).alias("hit"), _bits([(i, opens(p)) for i, p in asked]).alias("open"))

    # Each field is folded once for all profiles.
    folded = F.struct(*[fold(F.coalesce(col(f), F.lit(""))).alias(f) for f in textindex.FIELDS])
    return texts.select("id", (F.coalesce("body", F.lit("")) != "").alias("_has"), F.transform(F.array(folded), answer)[0].alias("_t")).select("id", "_has", col("_t.hit").alias("_hit"), col("_t.open").alias("_open"))


def index_bits(index: DataFrame, profiles: list[dict]) -> DataFrame:
    """The same from a token index: all phrases of all profiles are looked up together."""
    terms: list[str] = []
    for p in profiles:
        terms += [t for t in [*criteria.searchable(p["description_keywords"]), *p["exclude_description_keywords"]] if textindex.words_of(t) and t not in terms]
    parts = [textindex.phrase_hits(index, terms).select("id", F.concat(F.lit("t"), col("term").cast("string")).alias("found"))] if terms else []
    parts += [textindex.text_query(index, p["text"]).select("id", F.lit(f"q{i}").alias("found")) for i, p in enumerate(profiles) if p["text"]]
    parts.append(index.where(col("field") == "body").select("id", F.lit("b").alias("found")))
    found = reduce(DataFrame.unionByName, parts).distinct().groupBy("id").agg(F.collect_set("found").alias("found"))  # at most one entry a term, a query and the body

    def has(name: str) -> Column:
        return F.array_contains("found", name)

    def keywords(p: dict) -> Column:
        each = [has(f"t{terms.index(t)}") for t in criteria.searchable(p["description_keywords"])]
        return reduce(lambda a, b: a & b if p["description_match"] == "all" else a | b, each) if each else F.lit(False)

    def opens(i: int, p: dict) -> Column:
        gate = has(f"q{i}") if p["text"] else F.lit(True)
        for t in p["exclude_description_keywords"]:
            gate = gate & ~has(f"t{terms.index(t)}") if t in terms else gate
        return gate

    asked = [(i, p) for i, p in enumerate(profiles) if _asks(p)]
    return found.select("id", has("b").alias("_has"), _bits([(i, keywords(p)) for i, p in asked]).alias("_hit"), _bits([(i, opens(i, p)) for i, p in asked]).alias("_open"))


def mark(view: DataFrame, profiles: list[dict], texts: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """``view`` with ``in_bits`` and ``aside_bits``: bit i says that profile i shows the row or sets it aside. At most WORD profiles.

    The view is scanned once; where profiles ask for text, the texts (or the
    index) are read once as well and joined by id.
    """
    if len(profiles) > WORD:
        raise ValueError(f"at most {WORD} profiles share a scan")
    df, inside, aside = view, [], []
    if any(_asks(p) for p in profiles):
        if texts is None and index is None:
            raise ValueError("these profiles search text: pass texts or index")
        found = index_bits(index, profiles) if index is not None else text_bits(texts, profiles)
        df = df.join(found, "id", "left")
    for i, p in enumerate(profiles):
        gate = criteria.title_gate(p)
        if _asks(p):
            df = df.withColumns({"text_hit": has_bit(F.coalesce("_hit", F.lit(0)), i), "text_missing": ~F.coalesce("_has", F.lit(False))})
            # A row without a text passes an exclusion and fails a free text.
            gate = gate & F.coalesce(has_bit(col("_open"), i), F.lit(not p["text"]))
        df = df.withColumn(f"_c{i}", F.when(gate, criteria.classify(p)))
        inside.append((i, col(f"_c{i}") == "in"))
        aside.append((i, col(f"_c{i}") == "aside"))
    return df.select(*view.columns, _bits(inside).alias("in_bits"), _bits(aside).alias("aside_bits"))


def totals(view: DataFrame, profiles: dict[str, dict], texts: DataFrame | None = None, index: DataFrame | None = None, fresh: DataFrame | None = None) -> DataFrame:
    """(profile, standing, standing_aside, new, new_aside) of every profile, by one scan for each WORD of them.

    Rows of ``fresh`` (id) count as new. Duplicates are not folded.
    """
    names, out = list(profiles), None
    marked = view if fresh is None else view.join(fresh.select("id").distinct().withColumn("_new", F.lit(True)), "id", "left")
    for at in range(0, len(names), WORD):
        some = names[at:at + WORD]
        rows = mark(marked, [normalize_profile(profiles[n])[0] for n in some], texts, index)
        new = F.coalesce("_new", F.lit(False)) if fresh is not None else F.lit(False)
        counts = []
        for i, name in enumerate(some):
            shown, kept = has_bit(col("in_bits"), i), has_bit(col("aside_bits"), i)
            counts.append(F.struct(F.lit(name).alias("profile"), F.count_if(shown).alias("standing"), F.count_if(kept).alias("standing_aside"),
                                   F.count_if(shown & new).alias("new"), F.count_if(kept & new).alias("new_aside")))
        one = rows.agg(F.array(*counts).alias("x")).select(F.explode("x").alias("x")).select("x.*")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else view.sparkSession.createDataFrame([], "profile string, standing long, standing_aside long, new long, new_aside long")
