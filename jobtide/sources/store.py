"""Versions of tables that share files.

A table is cut into parts; a part is a list of folders, and a version is a small
table that says which. A new version writes folders for what changed and names
the old ones for the rest, so that any published version reads whole and what
did not change is never written again. One writer works on a store at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sink import publish, published_version

PIECES = "name string, part int, sequence long, folder string, rows long"
PARTS = 64


def part_of(key: Column, parts: int = PARTS) -> Column:
    """Part of a key by its md5, so that any engine finds the same one."""
    return (F.conv(F.substring(F.md5(key), 1, 7), 16, 10).cast("long") % parts).cast("int")


@dataclass(frozen=True)
class Piece:
    """One folder of one part. Later pieces of a part have larger sequences."""

    name: str
    part: int
    sequence: int
    folder: str
    rows: int


class TableStore:
    """Tables under ``root``. ``schemas`` gives the DDL of each table, for tables without rows."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str]):
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), schemas
        self.known: dict[int, list[Piece]] = {0: []}  # a published version never changes

    def version(self) -> int:
        """The newest published version; 0 before the first."""
        return published_version(self.spark, self.root)

    def pieces(self, name: str | None = None, version: int | None = None, parts: Iterable[int] | None = None) -> list[Piece]:
        """Pieces of a version. Their number is bounded by parts times pieces a part, so the driver holds them."""
        version = self.version() if version is None else version
        if version not in self.known:
            rows = self.spark.read.schema(PIECES).parquet(f"{self.root}/_versions/v={version}").orderBy("name", "part", "sequence", "folder")
            self.known[version] = [Piece(*r) for r in rows.collect()]
        wanted = None if parts is None else set(parts)
        return [p for p in self.known[version] if name in (None, p.name) and (wanted is None or p.part in wanted)]

    def read(self, name: str, version: int | None = None, parts: Iterable[int] | None = None, pieces: list[Piece] | None = None, beside: str = "") -> DataFrame:
        """The rows of a version, of some parts, or of the pieces named. Other files are not listed. ``beside`` as in ``write``."""
        pieces = self.pieces(name, version, parts) if pieces is None else pieces
        schema = ", ".join(filter(None, [self.schemas[name], beside]))
        if not pieces:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[p.folder for p in pieces])

    def write(self, name: str, df: DataFrame, part: Column, sequence: int = 0, order: tuple[str, ...] = (), beside: str = "") -> list[Piece]:
        """Folders for the rows of ``df``, one a part; nothing is published yet.

        ``beside`` is the DDL of columns that the files hold beside the table's
        own; only a ``read`` that names them sees them.

        Rebalancing brings a part's rows together, splits a part that holds much
        and fills files evenly.
        """
        path = f"{self.root}/{name}/{uuid.uuid4().hex}"
        columns = [f.name for f in self.read(name, pieces=[], beside=beside).schema.fields]
        out = df.select(*columns, part.alias("_part")).hint("rebalance", "_part")
        out.sortWithinPartitions("_part", *order).write.partitionBy("_part").parquet(path)
        counts = self.spark.read.schema("_part int").parquet(path).groupBy("_part").count().collect()
        return [Piece(name, r["_part"], sequence, f"{path}/_part={r['_part']}", r["count"]) for r in sorted(counts)]

    def publish(self, drop: Iterable[Piece], add: Iterable[Piece]) -> int:
        """A new version: the newest one without ``drop`` and with ``add``. Files stay; older versions still read."""
        version, gone = self.version(), {p.folder for p in drop}
        kept = [p for p in self.pieces(version=version) if p.folder not in gone]
        rows = self.spark.createDataFrame([astuple(p) for p in [*kept, *add]], PIECES)
        # A writer that died before publishing may have left this version; nobody reads it.
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/_versions/v={version + 1}")
        publish(self.spark, self.root, version + 1)
        return version + 1
