"""Personal data by candidate gradient boosting, in DataFrame expressions alone.

Generators of high recall propose overlapping spans: the four base patterns and
loose forms of them. Boosted trees score each span by its format and context, and
a threshold per generator, calibrated for precision on held-out candidates,
selects the spans to redact. Base findings that pass their checks always stay.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

# The base patterns, written so that a match is found in linear time: no match can begin inside a run of characters
# that its first part would have taken whole, but for the place where the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Loose forms: a spelled-out address, a number without its country sign (where one with it is passed over), a card in odd groups.
LOOSE_EMAIL = (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]\x20?(?:at|At|AT)\x20?[\])]\x20?[A-Za-z0-9-]++"
               r"(?:\.[A-Za-z0-9-]++|\x20?[\[(]\x20?(?:dot|Dot|DOT)\x20?[\])]\x20?[A-Za-z0-9-]++)++")
LOOSE_PHONE = PHONE + r"|(?<![0-9A-Za-z.,/-])(?:\([0-9]{2,4}\)|00?[0-9]{1,4}|[0-9]{3})[\x20./-]{0,2}[0-9]{3,4}(?:[\x20./-][0-9]{2,4}){1,3}(?![0-9A-Za-z])"
LOOSE_CARD = r"(?<![0-9])[0-9](?:[\x20.-]{0,2}[0-9])++"
#: (pattern, place of its kind in KINDS, whether it is a base pattern)
GENERATORS = ((EMAIL, 0, True), (IP, 1, True), (CARD, 2, True), (PHONE, 3, True), (LOOSE_EMAIL, 0, False), (LOOSE_PHONE, 3, False), (LOOSE_CARD, 2, False))
#: How a base form is rewritten into a loose one to make training examples of what the loose generators are to find.
REWRITES = ((r"([A-Za-z0-9._%+-])@([A-Za-z0-9-])", "$1 [at] $2"), (r"\+([0-9][\x20().0-9-]+[0-9])", "$1"), (r"(?<![0-9])([0-9]{4})([0-9]{4})([0-9]{4})([0-9]{2,4})(?![0-9])", "$1.$2.$3.$4"))

#: A loose phone number grouped as such numbers are written.
GROUPED = r"^(?:\([0-9]{2,4}\)|0[0-9]{1,4}|[0-9]{3})[\x20./-]{0,2}[0-9]{3,4}(?:[\x20./-][0-9]{2,4}){1,2}$"
CUES = r"(?i)(tel|phone|call|mobile|fax|mail|contact|write|card|visa|credit|host|server|address|anruf|appel|correo|llam|courriel)"
NOISE = r"(?i)(version|isbn|order|invoice|ref|section|page|chapter|build|serial|sku|item)"
CONTEXT = 24
BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (start, end, hit, before, after), in code points, end exclusive.

    The text is cut at the matches; a match begins after the lengths of all
    before it, which are summed block by block so that many matches stay cheap.
    """

    def placed(pieces: Column, hits: Column) -> Column:
        steps = F.transform(hits, lambda h, i: F.length(F.get(pieces, i)) + F.length(h))

        def located(lengths: Column) -> Column:
            sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: total(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))))
            bases = F.aggregate(sums, F.array(F.lit(0)), lambda a, s: F.array_append(a, F.element_at(a, -1) + s))

            def span(base: Column) -> Column:
                def at(h: Column, i: Column) -> Column:
                    block = F.floor(i / BLOCK).cast("int")
                    start = F.get(base, block) + total(F.slice(lengths, block * BLOCK + 1, i - block * BLOCK)) + F.length(F.get(pieces, i))
                    return let(start, lambda s: F.struct(
                        s.alias("start"), (s + F.length(h)).alias("end"), h.alias("hit"), F.right(F.get(pieces, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(pieces, i + 1), F.lit(1)).alias("after")))

                return F.transform(hits, at)

            return let(bases, span)

        return let(steps, located)

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(F.size(hits) > 0, let(F.split(text, pattern, -1), lambda pieces: placed(pieces, hits))))
    return F.coalesce(found, F.array().cast("array<struct<start:int,end:int,hit:string,before:string,after:string>>"))


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    def value(i: Column) -> Column:
        d = F.substring(number, -i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return total(F.transform(F.sequence(F.lit(1), F.length(number)), value)) % 10 == 0


def octets(hit: Column) -> Column:
    """Whether all parts between dots are at most 255; zeros in front do not count."""
    part = lambda p: let(F.regexp_replace(p, "^0+(?=.)", ""), lambda x: (F.length(x) < 3) | ((F.length(x) == 3) & (x <= "255")))
    return F.forall(F.split(hit, r"\."), part)


def valid(kind: int, hit: Column) -> Column:
    """The check of the base kind."""
    n = F.length(digits(hit))
    return (F.lit(True), octets(hit), let(digits(hit), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)), n.between(10, 15))[kind]


def char_class(c: Column) -> Column:
    return F.when(c.isNull() | (c == "") | c.rlike(r"\s"), 0).when(c.rlike("[0-9]"), 2).when(c.rlike(r"\p{L}"), 1).otherwise(3)


#: Names of the features, in order.
FEATURES = ("generator", "length", "digits", "separators", "letters", "plus", "bracket", "luhn", "octets", "dots", "prior", "next", "cue", "noise", "distinct", "grouping")


def features(generator: int, c: Column) -> Column:
    hit = c["hit"]
    d = digits(hit)
    count = lambda pattern: F.length(hit) - F.length(F.regexp_replace(hit, pattern, ""))
    return F.array(*[x.cast("double") for x in (
        F.lit(generator), F.length(hit), F.length(d), count(r"[\x20-]"), count("[A-Za-z]"), F.startswith(hit, F.lit("+")), hit.rlike(r"[(\[]"),
        let(d, lambda n: F.when(F.length(n).between(12, 19), luhn(n)).otherwise(False)), F.when(hit.rlike(r"^[0-9]+(\.[0-9]+){3}$"), octets(hit)).otherwise(False), count(r"\."),
        char_class(F.right(c["before"], F.lit(1))), char_class(c["after"]), c["before"].rlike(CUES), c["before"].rlike(NOISE),
        F.size(F.array_distinct(F.split(d, ""))), F.length(F.regexp_extract(hit, "([0-9]+)$", 1)))])


def _candidate(g: int, kind: int, base: bool) -> Callable[[Column], Column]:
    return lambda c: F.struct(
        c["start"].alias("start"), F.lit(kind).alias("kind"), c["end"].alias("end"), F.lit(g).alias("generator"), F.lit(base).alias("base"),
        (valid(kind, c["hit"]) if base else F.lit(False)).alias("ok"), features(g, c).alias("f"))


def candidates(text: Column, loose: bool = False) -> Column:
    """All generators' spans, or those of the loose ones: (start, kind, end, generator, base, ok, f). Overlaps are left in."""
    parts = []
    for g, (pattern, kind, base) in enumerate(GENERATORS):
        if loose and base:
            continue
        found = matches(text, pattern)
        if g == 5:
            found = F.filter(found, lambda c: ~F.startswith(c["hit"], F.lit("+")))
        if g == 6:
            found = F.filter(found, lambda c: F.length(digits(c["hit"])).between(13, 19))
        parts.append(F.transform(found, _candidate(g, kind, base)))
    return F.concat(*parts)


# --- the trees -------------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class SpanModel:
    """Boosted trees as nested (feature, bound, low, high) or leaf values, with their weights; thresholds per generator."""

    trees: list[tuple[float, object]] = field(default_factory=list)
    thresholds: dict[int, float] = field(default_factory=dict)

    def probability(self, f: Column) -> Column:
        margin = sum((F.lit(w) * _tree_column(t, f) for w, t in self.trees), F.lit(0.0))
        return 1 / (1 + F.exp(-2 * margin))


def _tree_column(tree, f: Column) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    feature, bound, low, high = tree
    return F.when(F.get(f, F.lit(feature)) <= F.lit(bound), _tree_column(low, f)).otherwise(_tree_column(high, f))


def _parse(lines: list[str]):
    """One tree from the public description of a fitted model."""
    line = lines.pop(0).strip()
    if line.startswith("Predict:"):
        return float(line.split(":")[1])
    feature, bound = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    low = _parse(lines)
    lines.pop(0)
    return int(feature), float(bound), low, _parse(lines)


def _read_trees(model) -> list[tuple[float, object]]:
    parts = re.split(r"\n\s*Tree \d+ \(weight [^)]*\):\n", model.toDebugString)[1:]
    return list(zip(model.treeWeights, [_parse(p.rstrip("\n").split("\n")) for p in parts], strict=True))


def feature(c: Column, name: str) -> Column:
    return F.get(c["f"], F.lit(FEATURES.index(name)))


def supported(hit: Column, c: Column) -> Column:
    """Whether something speaks for a loose span: its spelled-out form, a cue before it, a usual grouping, or Luhn's sum."""
    cue = (feature(c, "cue") == 1) & (feature(c, "noise") == 0)
    grouped = (feature(c, "digits").between(10, 15)) & (feature(c, "noise") == 0) & hit.rlike(GROUPED)
    return (c["kind"] == 0) | cue | ((c["kind"] == 3) & grouped) | ((c["kind"] == 2) & (feature(c, "luhn") == 1))


def training_rows(docs: DataFrame, text_col: str) -> DataFrame:
    """(generator, fold, label, f, weight): the different examples of all documents and how often each occurs. Base spans are labelled by their checks, and so are loose spans that a rewrite of a
    base form made. A loose span that stands in the text as it is may be a real one: it is negative only where
    nothing speaks for it and no base finding holds it, and has no label otherwise."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    loose = text
    for pattern, to in REWRITES:
        loose = F.regexp_replace(loose, pattern, to)
    fold = F.pmod(F.xxhash64(text), F.lit(2)).alias("fold")
    hit = lambda t, c: F.substring(t, c["start"] + 1, c["end"] - c["start"])
    named = lambda t, c: F.concat_ws(":", c["generator"], hit(t, c))
    t, m = F.col("t"), F.col("m")
    # Where no rewrite changed the text there is nothing new to find.
    both = docs.select(text.alias("t"), loose.alias("m"), fold).select("t", "m", "fold", candidates(t).alias("own"), F.when(t != m, candidates(m, loose=True)).alias("new"))
    sure = F.filter("own", lambda c: c["base"] & c["ok"])

    def unlabelled(c: Column) -> Column:
        return ~c["base"] & (supported(hit(t, c), c) | F.exists(sure, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))

    def example(label: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda c: F.struct(c["generator"].alias("generator"), label(c).cast("double").alias("label"), c["f"].alias("f"))

    kept = F.transform(F.filter("own", lambda c: ~unlabelled(c)), example(lambda c: F.when(c["base"], c["ok"]).otherwise(False)))
    # What no generator finds in the text as it is lies where a rewrite happened.
    before = F.transform(F.filter("own", lambda c: ~c["base"]), lambda c: named(t, c))
    label = lambda c: F.when(c["kind"] == 2, feature(c, "luhn")).when(c["kind"] == 3, feature(c, "digits").between(10, 15).cast("double")).otherwise(1.0)
    made = F.when(t != m, F.transform(F.filter("new", lambda c: ~F.array_contains(before, named(m, c))), example(label)))
    # Both kinds from one pass over the texts.
    rows = both.select("fold", F.explode(F.concat(kept, F.coalesce(made, F.array().cast("array<struct<generator:int,label:double,f:array<double>>>")))).alias("x"))
    return rows.groupBy("x.generator", "fold", "x.label", "x.f").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def fit(docs: DataFrame, text_col: str = "text", trees: int = 12, depth: int = 3, precision: float = 0.98, least: int = 20) -> SpanModel:
    """Fits on the candidates of all documents; equal examples are one row with a weight.

    One half trains the trees, the other sets each generator's threshold: the
    lowest at which the share of true spans above it is ``precision``, counted
    on at least ``least`` spans. A generator that reaches it nowhere adds nothing.
    """
    rows = training_rows(docs, text_col).select("generator", "fold", "label", "weight", array_to_vector("f").alias("features")).persist()
    try:
        labels, n = rows.where("fold = 0").agg(F.count_distinct("label"), F.count(F.lit(1))).first()
        if labels < 2:
            return SpanModel()
        # Split points are looked for among all examples: the library samples where there are more than maxBins squared.
        booster = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, maxBins=max(32, math.isqrt(n) + 1), stepSize=0.3, seed=1)
        found = booster.fit(rows.where("fold = 0"))
        scored = found.transform(rows.where("fold = 1")).select("generator", "label", "weight", F.floor(F.get(vector_to_array("probability"), F.lit(1)) * 200).alias("bin"))
        bins = scored.groupBy("generator", "bin").agg(F.sum(F.col("label") * F.col("weight")).alias("true"), F.sum("weight").alias("n")).collect()
        thresholds = {}
        for g, (_, _, base) in enumerate(GENERATORS):
            true = n = 0.0
            for b in sorted((b for b in bins if b["generator"] == g), key=lambda b: -b["bin"]):
                true, n = true + b["true"], n + b["n"]
                if n >= least and true >= precision * n and not base:
                    thresholds[g] = b["bin"] / 200
        return SpanModel(_read_trees(found), thresholds)
    finally:
        rows.unpersist()


def find(docs: DataFrame, model: SpanModel, text_col: str = "text", out_col: str = "spans") -> DataFrame:
    """Adds ``out_col``: array of (start, kind, end, base), by start, kind, end; offsets in code points, end exclusive.

    Base findings that pass their checks are all there. Other spans are added
    where the trees' probability reaches their generator's threshold and no base
    finding overlaps them. Null text is empty. Row-local: repeated rows and
    other columns pass through; ``out_col`` must be free. An empty table gives
    an empty result.
    """

    def chosen(all_spans: Column) -> Column:
        def merged(base: Column) -> Column:
            extra = F.filter(all_spans, lambda c: ~c["base"] & (model.probability(c["f"]) >= _bound(model, c["generator"])))
            extra = F.filter(extra, lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
            return F.array_sort(F.array_distinct(F.concat(base, F.transform(extra, _bare))))

        return let(F.transform(F.filter(all_spans, lambda c: c["base"] & c["ok"]), _bare), merged)

    return docs.withColumn(out_col, let(candidates(F.coalesce(F.col(text_col), F.lit(""))), chosen))


def _bare(c: Column) -> Column:
    return F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), c["base"].alias("base"))


def _bound(model: SpanModel, generator: Column) -> Column:
    out = F.lit(math.inf)
    for g, t in model.thresholds.items():
        out = F.when(generator == g, F.lit(t)).otherwise(out)
    return out


def count_base(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind)))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans are one."""
    names = F.array(*[F.lit(k) for k in KINDS])
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        gap = F.concat(a["out"], F.substring(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0))), F.when(s["start"] >= a["at"], F.concat(F.lit("["), F.get(names, s["kind"]), F.lit("]"))).otherwise(""))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), gap.alias("out"))

    return F.aggregate(spans, zero, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
