"""Large lists read in splits: records of quoted CSV and elements of JSON arrays.

A file is read in pieces between separators (line ends, or commas), in as many
tasks as it has splits. Whether a separator ends a record depends on all text
before it: on open quotes and brackets. A first scan says what each split does to
that state, for either way it may begin; chained per file, that gives the state
each split begins in, and a second scan cuts records. Records that cross splits
come out in parts and are put together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

col = F.col
MARKS = re.compile(r'\\.|["\[\]{}]', re.S)
SPLIT = "path string, block long, out_quoted boolean, out_depth long, in_quoted boolean, in_depth long"
PART = "path string, block long, n long, opens boolean, closes boolean, first boolean, value string"


class Quotes:
    """CSV: a line end inside quotes is text. Doubled quotes leave the state as it was."""

    separator = "\n"

    @staticmethod
    def after(piece: str, quoted: bool, depth: int) -> tuple[bool, int, str]:
        return quoted ^ (piece.count('"') % 2 == 1), depth, piece

    @staticmethod
    def ends(quoted: bool, depth: int) -> bool:
        return not quoted


class Brackets:
    """JSON: a comma ends an element of the outer array outside strings and inner brackets. The outer brackets are cut off."""

    separator = ","

    @staticmethod
    def after(piece: str, quoted: bool, depth: int) -> tuple[bool, int, str]:
        begin, end = 0, len(piece)
        for m in MARKS.finditer(piece):
            mark = m[0]
            if mark == '"':
                quoted = not quoted
            elif quoted or len(mark) > 1:
                continue
            elif mark in "[{":
                depth += 1
                begin = m.end() if depth == 1 else begin
            else:
                depth -= 1
                end = m.start() if depth == 0 else end
        return quoted, depth, piece[begin:end]

    @staticmethod
    def ends(quoted: bool, depth: int) -> bool:
        return not quoted and depth <= 1


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str]]:
    for batch in batches:
        for path, block, piece in zip(*[batch.column(c).to_pylist() for c in ("path", "block", "value")], strict=True):
            yield (path, block), piece


def _effects(rule):
    """Per split: the state after it, for a start outside and inside quotes, at depth 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, done = None, None, []
        for key, piece in _pieces(batches):
            if key != at:
                done += [(*at, *state[0], *state[1])] if at else []
                at, state = key, [(False, 0), (True, 0)]
            state = [rule.after(piece, *s)[:2] for s in state]
        done += [(*at, *state[0], *state[1])] if at else []
        yield pa.RecordBatch.from_arrays([pa.array([d[j] for d in done], t) for j, t in enumerate((pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64()))],
                                         names=["path", "block", "out_quoted", "out_depth", "in_quoted", "in_depth"])

    return run


def _cut(rule, begins, firsts):
    """Records of a split. ``opens``: nothing of it lies in a split before; ``closes``: nothing in one behind. ``firsts``: splits that begin a list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, held, opens, state, out = None, 0, [], True, (False, 0), []

        def put(closes: bool) -> None:
            nonlocal n, held, opens
            out.append((*at, n, opens, closes, at in firsts and n == 0, rule.separator.join(held)))
            n, held, opens = n + 1, [], True

        def batch() -> pa.RecordBatch:
            nonlocal out
            rows, out = out, []
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=["path", "block", "n", "opens", "closes", "first", "value"])

        for key, piece in _pieces(batches):
            if key != at:
                if held:
                    put(False)
                at, n, state = key, 0, begins[key]
                opens = rule.ends(*state)
            quoted, depth, text = rule.after(piece, *state)
            state = quoted, depth
            held.append(text)
            if rule.ends(*state):
                put(True)
            if len(out) >= 10_000:
                yield batch()
        if held:
            put(False)
        yield batch()

    return run


def read_records(spark: SparkSession, path: str, rule, one: bool = False) -> DataFrame:
    """(path, first, value): the records of all files under ``path``; ``first`` marks the first of each file.

    With ``one`` the files are one list, cut behind separators that end a
    record, in the order of their names: as many tasks write a long one. The driver holds one row per split. A file that ends inside quotes or
    brackets ends its last record. Empty files have no records.
    """
    read = spark.read.text(path, lineSep=rule.separator)
    pieces = read.select(col("_metadata.file_path").alias("path"), col("_metadata.file_block_start").alias("block"), "value")
    begins, firsts, state, file = {}, set(), (False, 0), None
    for r in pieces.mapInArrow(_effects(rule), SPLIT).orderBy("path", "block").collect():
        if file is None or (r["path"] != file and not one):
            state = (False, 0)
            firsts.add((r["path"], r["block"]))
        file = r["path"]
        begins[r["path"], r["block"]] = state
        state = (r["in_quoted"], state[1] + r["in_depth"]) if state[0] else (r["out_quoted"], state[1] + r["out_depth"])
    parts = pieces.mapInArrow(_cut(rule, begins, firsts), PART)
    whole = parts.where("opens and closes").select("path", "first", "value")
    # Records that cross splits: a part that opens begins a new one. There is at most one such part at either end of a split.
    order = Window.partitionBy("path").orderBy("block", "n")
    crossing = parts.where("not (opens and closes)").withColumn("record", F.sum(col("opens").cast("int")).over(order))
    joined = crossing.groupBy("path", "record").agg(F.max("first").alias("first"), F.array_sort(F.collect_list(F.struct("block", "n", "value"))).alias("p"))
    return whole.unionByName(joined.select("path", "first", F.array_join(F.transform("p", lambda x: x["value"]), rule.separator).alias("value")))


def json_elements(spark: SparkSession, path: str, one: bool = False) -> DataFrame:
    """``value`` rows: the elements of files that each hold one JSON array, or, with ``one``, hold one together. Strings come without quotes, the rest as written."""
    found = read_records(spark, path, Brackets, one).where(F.trim(F.regexp_replace("value", "\\s", "")) != "")
    return found.select(F.from_json(F.concat(F.lit("["), "value", F.lit("]")), "array<string>")[0].alias("value"))


def csv_records(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of CSV files whose first record is a header, under these column names; cells are strings, trimmed, empty ones null; line ends inside cells stay as written."""
    found = read_records(spark, path, Quotes).where(~col("first")).select(F.regexp_replace("value", "\r$", "").alias("value")).where(F.trim("value") != "")
    schema = ", ".join(f"`{c}` string" for c in columns)
    options = {"escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    return found.select(F.from_csv("value", schema, options).alias("row")).select("row.*")
