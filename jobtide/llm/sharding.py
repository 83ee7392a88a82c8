"""Sharding by a k-d tree over metadata.

Leaves are found by splitting again and again at the byte-weighted median of the
dimension in which a node is widest. The points are groups of equal texts, so
copies stay together; a group too heavy for that is split into its documents.
Medians are found for all nodes of a level at once, by histograms of summed
bytes that zoom in on the bin holding the middle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import power_of_two, running_total, shuffle_partitions

LEVELS = 20  # bits of a dimension's place
TIE = 40  # bits that order points of the same place
BINS = 2048


def _place(value: Column, low: float, high: float) -> Column:
    """A value's place between low and high, in 2^LEVELS steps."""
    span = high - low
    step = F.floor((value - F.lit(low)) / F.lit(span if span else 1.0) * F.lit(float(2**LEVELS - 1)))
    return F.least(F.greatest(step, F.lit(0)), F.lit(2**LEVELS - 1)).cast("long")


def _node(cuts: list[dict], dims: list[str], node: int = 0, level: int = 0) -> Column:
    """Node of a point after the given levels: one bit per level, a comparison per inner node."""
    if level == len(cuts):
        return F.lit(node)
    if node not in cuts[level]:
        return F.lit(node << (len(cuts) - level))
    dim, cut = cuts[level][node]
    left, right = (_node(cuts, dims, 2 * node + side, level + 1) for side in (0, 1))
    return F.when(_key(dims[dim]) > F.lit(cut), right).otherwise(left)


def _key(dim: str) -> Column:
    return F.col(dim) * F.lit(1 << TIE) + F.col("tie")


def split_tree(points: DataFrame, dims: list[str], levels: int, tolerance: float) -> list[dict]:
    """Cuts per level. ``points``: (weight, tie, one place column per dimension).

    The driver holds, for each of at most 2^levels nodes, a range per dimension
    and a histogram of BINS sums: a size set by the shard count alone.
    """
    cuts: list[dict] = []
    for _ in range(levels):
        at = points.withColumn("node", _node(cuts, dims))
        boxes = at.groupBy("node").agg(F.sum("weight").alias("w"), *[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]).collect()
        state = {}
        for b in boxes:
            dim = max(range(len(dims)), key=lambda k: (b[f"hi_{dims[k]}"] - b[f"lo_{dims[k]}"], -k))
            lo, hi = b[f"lo_{dims[dim]}"] << TIE, ((b[f"hi_{dims[dim]}"] + 1) << TIE) - 1
            state[b["node"]] = {"dim": dim, "lo": lo, "hi": hi, "w": b["w"], "below": 0, "done": False}
        while open_nodes := {n: s for n, s in state.items() if not s["done"]}:
            bin_of = F.lit(None).cast("long")
            for n, s in open_nodes.items():
                s["step"] = (s["hi"] - s["lo"]) // BINS + 1
                key = _key(dims[s["dim"]])
                inside = (F.col("node") == n) & (key >= F.lit(s["lo"])) & (key <= F.lit(s["hi"]))
                bin_of = F.when(inside, F.expr(f"({dims[s['dim']]} * {1 << TIE}L + tie - {s['lo']}L) div {s['step']}L")).otherwise(bin_of)
            sums = at.select("node", "weight", bin_of.alias("bin")).where("bin is not null").groupBy("node", "bin").agg(F.sum("weight").alias("w")).collect()
            for n, s in open_nodes.items():
                below = s["below"]
                for b, w in sorted((r["bin"], r["w"]) for r in sums if r["node"] == n):
                    if 2 * (below + w) >= s["w"]:
                        break
                    below += w
                first, last = s["lo"] + b * s["step"], min(s["hi"], s["lo"] + (b + 1) * s["step"] - 1)
                if w <= tolerance * s["w"] or first == last:
                    s["done"] = True
                    s["cut"] = last if abs(2 * (below + w) - s["w"]) <= abs(2 * below - s["w"]) else first - 1
                else:
                    s["lo"], s["hi"], s["below"] = first, last, below
        cuts.append({n: (s["dim"], s["cut"]) for n, s in state.items()})
    return cuts


def kd_shards(docs: DataFrame, shards: int = 16, text_col: str = "text", id_col: str = "doc_id", source_col: str | None = "source",
              group_share: float = 0.005, tolerance: float = 0.0005) -> DataFrame:
    """(id, size, text_crc32, shard, slot) for each row; the shards' sizes are near equal.

    ``shards`` is a power of two, or a ValueError is raised. Size is the UTF-8 bytes of the text (null:
    none) plus 1, so a null text ranks with an empty one. The dimensions are the
    logarithm of the size, the id and the hashed source, each taken once for a
    group of equal texts (largest size, smallest id and source); nulls take the
    lowest place. Groups stay in one shard, but for those that outweigh both
    ``group_share`` of a shard's bytes and the largest single text: of these
    there are at most shards / group_share, and their rows are placed one by one. ``slot`` numbers a
    shard's rows from 0 without gaps. Repeated rows each get a slot; an empty
    table gives an empty result.
    """
    if shards < 1 or shards & (shards - 1):
        raise ValueError(f"the number of shards is a power of two, not {shards}")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = F.coalesce(F.crc32(F.col(source_col).cast("string")), F.lit(0)) if source_col else F.lit(0).cast("long")
    rows = materialize(docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"), F.xxhash64(text).alias("digest"),
        source.alias("source"), F.xxhash64(F.col(id_col), text).alias("mix")), "rows")
    total, largest = [x or 0 for x in rows.agg(F.sum("size"), F.max("size")).first()]
    groups = rows.groupBy("digest", "crc").agg(F.sum("size").alias("bytes"))
    heavy = groups.where(F.col("bytes") > F.lit(max(total * group_share / shards, largest))).select("digest", "crc", F.lit(True).alias("heavy"))
    # Bounded: each heavy group holds over group_share / shards of all bytes.
    marked = rows.join(F.broadcast(heavy), ["digest", "crc"], "left").withColumn(
        "tie", F.shiftrightunsigned(F.when(F.col("heavy"), F.col("mix")).otherwise(F.xxhash64("digest", "crc")), 64 - TIE)).drop("heavy")
    points = materialize(marked.groupBy("digest", "crc", "tie").agg(
        F.sum("size").alias("weight"), F.max(F.log2(F.col("size").cast("double"))).alias("x_size"), F.min(F.coalesce(F.col("id"), F.lit(0))).cast("double").alias("x_id"),
        F.min("source").cast("double").alias("x_source")), "points")
    names = ["x_size", "x_id", "x_source"]
    span = points.agg(*[f(n).alias(f"{k}{n}") for n in names for k, f in (("lo", F.min), ("hi", F.max))]).first()
    dims = [n.replace("x_", "d_") for n in names]
    placed = points.select("digest", "crc", "tie", "weight", *[_place(F.col(n), span[f"lo{n}"] or 0.0, span[f"hi{n}"] or 0.0).alias(d) for n, d in zip(names, dims, strict=True)])
    cuts = split_tree(placed, dims, shards.bit_length() - 1, tolerance)
    leaves = placed.select("digest", "crc", "tie", _node(cuts, dims).cast("int").alias("shard"))
    sharded = materialize(marked.join(leaves, ["digest", "crc", "tie"]).select("id", "size", "crc", "shard", "mix", F.lit(1).alias("one")), "sharded")
    slots = running_total(sharded, "shard", "mix", ["id"], "one", "slot", power_of_two(shuffle_partitions(spark)))
    return slots.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", F.col("slot").cast("long").alias("slot"))
