"""Company-slug lists in six formats, archive URL pages, and crawl bookmarks.

Whole files come as one (body) row each, so many list files parse in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import normalize_slug
from . import records

col = F.col
# Object fields that may hold a slug when a list holds objects.
SLUGISH_KEYS = ["slug", "token", "board_token", "boardToken", "company", "name", "id", "url"]


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """(path, body): one row per file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), col("value").alias("body"))


def source_where(record, where: dict | None) -> Column:
    """Case-insensitive equality, membership or ``{"not": ...}`` on a record's fields.

    ``record`` gives a column per field name.
    """
    out = F.lit(True)
    for field, expected in (where or {}).items():
        negate = isinstance(expected, dict) and "not" in expected
        wanted = expected["not"] if negate else expected
        values = [str(v).lower() for v in (wanted if isinstance(wanted, (list, tuple)) else [wanted])]
        hit = F.lower(F.coalesce(record(field).cast("string"), F.lit(""))).isin(values)
        out = out & (~hit if negate else hit)
    return out


def _json_at(body: Column, path: str | None) -> Column:
    return F.get_json_object(body, "$." + path) if path else body


def _entry(e: Column) -> Column:
    """The candidate of a list entry: a string, or an object read through the first slug-like string field."""
    return F.when(e.startswith("{"), F.coalesce(*[F.get_json_object(e, f"$.{k}") for k in SLUGISH_KEYS])).otherwise(e)


def read_slug_source(spark: SparkSession, path: str, spec: dict) -> DataFrame:
    """``candidate`` rows of the files of one source, in any of the formats.

    JSON arrays, CSV and text lines are read in splits, however large a file is;
    ``split: False`` reads each JSON or CSV file whole. The other formats, and
    arrays inside a document (``jsonPath``), take a task per file.
    """
    kind, split = spec["format"], spec.get("split", True)
    if kind == "csv":
        return read_csv_slugs(spark, path, spec)
    if kind == "json-array" and split and not spec.get("jsonPath"):
        return records.json_elements(spark, path).select(_entry(col("value")).alias("candidate"))
    if kind == "text-lines":
        return parse_slug_list(spark.read.text(path).select(col("value").alias("body")), spec)
    return parse_slug_list(read_bodies(spark, path), spec).select("candidate")


def parse_slug_list(bodies: DataFrame, spec: dict) -> DataFrame:
    """``body`` rows to ``candidate`` rows; other columns ride along.

    spec: format, and jsonPath, slugKey, where, column, pattern, between as the format needs.
    """
    kind, keep = spec["format"], [c for c in bodies.columns if c != "body"]
    body = _json_at(col("body"), spec.get("jsonPath"))
    if kind == "json-array":
        items = bodies.select(*keep, F.explode(F.from_json(body, "array<string>")).alias("e"))
        return items.select(*keep, _entry(col("e")).alias("candidate"))
    if kind == "json-objects":
        objects = F.coalesce(F.from_json(body, "array<string>"), F.map_values(F.from_json(body, "map<string,string>")))
        items = bodies.select(*keep, F.explode(objects).alias("e"))
        items = items.where(source_where(lambda f: F.get_json_object("e", f"$.{f}"), spec.get("where")))
        value = F.get_json_object("e", f"$.{spec['slugKey']}")
        values = F.when(value.startswith("["), F.from_json(value, "array<string>")).otherwise(F.array(value))
        return items.select(*keep, F.explode(values).alias("candidate"))
    if kind == "json-keys":
        return bodies.select(*keep, F.explode(F.json_object_keys(body)).alias("candidate"))
    if kind == "text-lines":
        lines = bodies.select(*keep, F.explode(F.split("body", "\\r?\\n")).alias("l")).select(*keep, F.trim("l").alias("candidate"))
        return lines.where((col("candidate") != "") & ~col("candidate").startswith("#"))
    if kind == "regex-scrape":
        scope, between = col("body"), spec.get("between")
        if between:
            scope = F.when(scope.contains(between[0]), F.substring(scope, F.locate(between[0], scope) + len(between[0]), F.length(scope)))
            if len(between) > 1 and between[1]:
                scope = F.substring_index(scope, between[1], 1)
        pattern = "(?i)" + spec["pattern"]
        group = 1 if "(" in spec["pattern"].replace("(?", "").replace("\\(", "") else 0
        return bodies.select(*keep, F.explode(F.regexp_extract_all(scope, F.lit(pattern), F.lit(group))).alias("candidate"))
    raise ValueError(f"unknown slug list format {kind!r}")


def read_csv_slugs(spark: SparkSession, path: str, spec: dict) -> DataFrame:
    """``candidate`` rows of a CSV list with a header; ``column`` is a name or an index.

    Files are read in splits at record ends, quoted line ends included;
    ``split: False`` reads each file whole.
    """
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    if spec.get("split", True):
        df = records.csv_records(spark, path, df.columns)  # the header alone is read the other way
    column = spec["column"]
    name = df.columns[column] if isinstance(column, int) else column
    missing = [c for c in [name, *(spec.get("where") or {})] if c not in df.columns]
    if missing:
        raise ValueError(f"column {missing[0]!r} not found in header {df.columns}")
    return df.where(source_where(lambda f: col(f"`{f}`"), spec.get("where"))).select(col(f"`{name}`").alias("candidate"))


def commoncrawl_urls(lines: DataFrame) -> DataFrame:
    """``value`` rows of JSON lines to ``url``; unreadable lines and lines without one are skipped."""
    return lines.select(F.get_json_object("value", "$.url").alias("url")).where(col("url").isNotNull())


def wayback_urls(bodies: DataFrame) -> DataFrame:
    """``body`` rows holding an array of rows, header first, to ``url``."""
    rows = F.from_json("body", "array<array<string>>")
    return bodies.select(F.explode(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))).alias("r")).select(
        F.try_element_at("r", F.lit(1)).alias("url")).where(F.coalesce(col("url"), F.lit("")) != "")


def unread_crawls(listing: DataFrame, bookmark: str | None, most: int) -> DataFrame:
    """Crawls to read from (id, pos), newest first at pos 0: the oldest ``most`` of those newer than the bookmark.

    A bookmark that is not listed gives the newest ``most``.
    """
    mark = listing.where(col("id") == bookmark).agg(F.min("pos").alias("mark"))
    at = mark.withColumn("_one", F.lit(1))
    tagged = listing.withColumn("_one", F.lit(1)).join(F.broadcast(at), "_one").drop("_one")
    newer = tagged.where(col("mark").isNull() | (col("pos") < col("mark")))
    order = F.when(col("mark").isNull(), col("pos")).otherwise(-col("pos"))
    return newer.orderBy(order).limit(most).select("id", "pos")


def collect_observations(candidates: DataFrame, systems: list[str]) -> tuple[DataFrame, DataFrame]:
    """(ats, source, file, candidate) rows to observed slugs and to accepted/rejected counts per file.

    ``systems`` lists the applicant tracking systems present; each has its own slug rules.
    """
    slug = F.lit(None).cast("string")
    for ats in systems:
        slug = F.when(col("ats") == ats, normalize_slug(col("candidate"), ats)).otherwise(slug)
    read = candidates.select("ats", "source", "file", slug.alias("slug"))
    observed = read.where(col("slug").isNotNull()).groupBy("ats", "slug").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    # Counted per slug first, so one huge list does not gather its slugs in one task.
    per_slug = read.groupBy("ats", "source", "file", "slug").agg(F.count(F.lit(1)).alias("n"))
    files = per_slug.groupBy("ats", "source", "file").agg(
        F.count("slug").alias("accepted"), F.coalesce(F.sum(F.when(col("slug").isNull(), col("n"))), F.lit(0)).alias("rejected"))
    return observed, files
