"""Mixing sources to target weights along a curriculum that changes over training time.

Every source has a target of words and a weight schedule over time 0..1. The
integral of the schedule says which share of the target is due at each time;
inverting it gives the time at which a document's words are due, and sorting by
that time gives the training order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import WORDS, power_of_two, running_total, shuffle_partitions

#: Weight at equally spaced times, for each of the weight classes in turn; straight lines between.
SCHEDULES = ((1.0, 1.0, 1.0), (2.0, 1.0, 0.5), (0.5, 1.0, 2.0))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(source, source_size, turn, target) from (source, source_size).

    Sources take ``weights`` in turn by code point, null last. They share the sum
    of all sizes by weight; a share above ``cap`` sizes stops there and the
    excess is shared again until none is above. The fixed point is a water level:
    a source is full where cap * size / weight lies under it, so sorting by that
    ratio and two running sums find it without a loop. One row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("turn", ((F.row_number().over(by_name) - 1) % len(weights)).cast("int"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("turn") + 1)
    ratio = ranked.withColumn("w", w).withColumn("ratio", F.lit(cap) * F.col("source_size") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").isNull(), "source")
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - cap * F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum("w").over(
        order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = ratio.withColumn("level", level).withColumn("place", F.row_number().over(order))
    # The first source, by ratio, that its level leaves below the cap sets the level for all after it.
    settled = levels.withColumn("water", F.min_by("level", F.when(F.col("ratio") >= F.col("level"), F.col("place"))).over(whole))
    target = F.when(F.col("water").isNull() | (F.col("ratio") <= F.col("water")), F.lit(cap) * F.col("source_size")).otherwise(F.col("w") * F.col("water"))
    return settled.select("source", "source_size", "turn", target.cast("double").alias("target"))


def order_key(value: Column) -> Column:
    """A uniform 64-bit number in the order of the value's MD5, which other engines can compute too."""
    head = F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    return (head - F.lit(1 << 59)) * F.lit(16)


def due_time(share: Column, turn: Column, schedules=SCHEDULES) -> Column:
    """The time by which ``share`` of a source's target is due: the inverse of its schedule's integral."""
    out = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        step = 1.0 / (len(knots) - 1)
        areas = [(a + b) / 2 * step for a, b in zip(knots, knots[1:], strict=False)]
        total, done, time = sum(areas), 0.0, F.lit(1.0)
        pieces = []
        for i, area in enumerate(areas):
            a, slope = knots[i], (knots[i + 1] - knots[i]) / step
            left = share * total - F.lit(done)
            # a t + slope t^2 / 2 = left, solved in the form that also holds for slope 0
            t = 2 * left / (F.lit(a) + F.sqrt(F.greatest(F.lit(a * a) + 2 * slope * left, F.lit(0.0))))
            pieces.append((done + area, F.lit(i * step) + t))
            done += area
        for bound, value in reversed(pieces):
            time = F.when(share * total <= F.lit(bound), value).otherwise(time)
        out = F.when(turn == k, time).otherwise(out)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


def mix(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3),
        cap: float = 3.0, whole_documents: bool = False) -> DataFrame:
    """(id, text_hash, source, size, source_size, target, taken, times): what the mix takes of each row, and when.

    Size is the number of words; a null or empty text has none and is not taken.
    A source is gone through as often as its target asks, in the order of the
    documents' hashes; the last pass ends at the target, inside a document, or,
    with ``whole_documents``, at the end of a document nearest to it. ``times``
    holds the position in training of each pass over the row. A null source is
    a source of its own. Repeated rows are taken like different ones; reruns
    agree. No row is taken more than ``cap`` times its size.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    sizes = materialize(docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(source_col).cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("size")).withColumn("mix", order_key(F.col("id"))), "sizes")
    targets = source_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    placed = running_total(sizes, "source", "mix", ["id", "text_hash"], "size", "before", power_of_two(shuffle_partitions(spark)))
    given = targets.withColumnRenamed("source", "_source")
    known = placed.join(given, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    full = F.floor(F.col("target") / F.col("source_size"))
    rest = F.floor(F.col("target")) - full * F.col("source_size")
    part = F.when(F.col("before") + F.col("size") / 2 <= rest, F.col("size")).otherwise(0) if whole_documents else F.least(F.col("size"), F.greatest(rest - F.col("before"), F.lit(0)))
    empty = F.col("size") == 0
    taken = known.withColumn("full", F.when(empty, F.lit(0)).otherwise(full).cast("int")).withColumn("part", F.when(empty, F.lit(0)).otherwise(part).cast("long"))
    passes = F.col("full") + (F.col("part") > 0).cast("int")
    middle = lambda k: (k * F.col("source_size") + F.col("before") + F.col("size") / 2) / F.col("target")
    times = F.when(passes > 0, F.transform(F.sequence(F.lit(0), passes - 1), lambda k: due_time(F.least(middle(k), F.lit(1.0)), F.col("turn")))).otherwise(F.array().cast("array<double>"))
    return taken.select(F.col("id").alias(id_col), "text_hash", "source", "size", "source_size", "target", (F.col("full") * F.col("size") + F.col("part")).alias("taken"), times.alias("times"))


def training_order(plan: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``mix`` once a pass, with pass, at, start and end for ``times``: stretches of words of the whole training, in its order.

    A pass lies at its position ``at`` of 0..1, which the schedules give; the
    stretches follow each other without gaps. Written in the order of ``start``,
    range by range; rows that are not taken have no pass.
    """
    parts = shuffle_partitions(plan.sparkSession)
    each = plan.select("*", F.posexplode("times").alias("pass", "at")).drop("times")
    words = F.least(F.col("size"), F.col("taken") - F.col("pass") * F.col("size"))
    # The position as a number over the whole range of a long, so that ranges of it are cut evenly; no schedule crowds one.
    place = (F.floor(F.col("at") * F.lit(float((1 << 53) - 1))) - F.lit(1 << 52)) * F.lit(1 << 11)
    passes = each.withColumns({"_words": words, "_place": place.cast("long"), "_all": F.lit(0)})
    placed = running_total(passes, "_all", "_place", [id_col, "text_hash", "pass"], "_words", "start", power_of_two(parts))
    stretches = placed.withColumn("end", F.col("start") + F.col("_words")).drop("_words", "_place", "_all")
    return materialize(stretches.repartitionByRange(parts, "start", "end").sortWithinPartitions("start", "end"), "order")


def curriculum(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` in training order, each as often as the mix takes it, whole documents only; same columns.

    Rows are found again by id and text. Rows that share both count as copies of
    one document, which is taken as often as all of them together. Rows are
    sorted within ranges of the position.
    """
    plan = mix(docs, text_col, id_col, whole_documents=True, **options)
    known = lambda c: F.coalesce(c.cast("string"), F.lit("")).alias("_key")
    again = plan.groupBy(known(F.col(id_col)), F.col("text_hash").alias("_text")).agg(F.flatten(F.collect_list("times")).alias("_times")).where(F.size("_times") > 0)
    # Copies are folded and found again by the same keys, so the texts are dealt out once for both.
    rows = docs.select(F.struct("*").alias("_row"), known(F.col(id_col)), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_text")).dropDuplicates(["_key", "_text"])
    once = rows.join(again, ["_key", "_text"])
    copies = once.select("_row", "_key", F.explode("_times").alias("_at"))
    return copies.repartitionByRange(shuffle_partitions(docs.sparkSession), "_at", "_key").sortWithinPartitions("_at", "_key").select("_row.*")
