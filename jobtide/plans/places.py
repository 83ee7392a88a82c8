"""Places already read: a stored table of written places, so that a day parses new strings only.

Rows carry a stamp of the place tables they were read with. With other tables
nothing stored counts any more, and strings are read anew as they come.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.gazetteer import DEFAULT, Gazetteer
from ..operators.location import parse_fragments, title_places
from ..sources.store import TableStore, part_of

col = F.col
CITIES = "array<struct<city:string,metro:string,minted:boolean,country:string>>"
READ = f"metros array<string>, countries array<string>, supra array<string>, cities {CITIES}"
SCHEMAS = {
    "fragments": f"fragment string, {READ}, remote boolean, unmatched array<string>, stamp string",
    "titles": f"title string, place struct<metros:array<string>,countries:array<string>,supra:array<string>,cities:{CITIES}>, stamp string",
}
PARTS = 32
PIECES = 8  # a part with more is written as one


def stamp_of(places: Gazetteer) -> str:
    """The same for equal place tables."""
    tables = [places.metros, places.cities, places.countries, places.regions]
    return hashlib.sha256(json.dumps([sorted((k, repr(v)) for k, v in t.items()) for t in tables]).encode()).hexdigest()[:16]


class PlaceMemory:
    """Strings read so far under ``root``. ``parsed`` counts, by table, the strings that calls on this object had to read."""

    def __init__(self, spark: SparkSession, root: str, places: Gazetteer = DEFAULT, parts: int = PARTS):
        self.places, self.parts, self.stamp = places, parts, stamp_of(places)
        self.store = TableStore(spark, root, SCHEMAS)
        self.parsed = {name: 0 for name in SCHEMAS}

    def _current(self, name: str) -> DataFrame:
        return self.store.read(name).where(col("stamp") == self.stamp).drop("stamp")

    def _remember(self, name: str, key: str, wanted: DataFrame, read: Callable[[DataFrame], DataFrame]) -> DataFrame:
        unseen = wanted.select(key).where(col(key).isNotNull()).distinct().join(self._current(name).select(key), key, "left_anti")
        version = self.store.version()
        added = self.store.write(name, read(unseen).withColumn("stamp", F.lit(self.stamp)), part_of(col(key), self.parts), version + 1, (key,))
        if added:
            self.parsed[name] += sum(p.rows for p in added)
            self.store.publish([], added)
            self._tidy(name, key)
        return self._current(name)

    def _tidy(self, name: str, key: str) -> None:
        """Parts of many pieces become one piece of what still counts; strings read twice, by runs at once, are kept once."""
        pieces: dict[int, list] = {}
        for p in self.store.pieces(name):
            pieces.setdefault(p.part, []).append(p)
        old = [p for own in pieces.values() if len(own) > PIECES for p in own]
        if old:
            rows = self.store.read(name, pieces=old).where(col("stamp") == self.stamp).dropDuplicates([key])
            self.store.publish(old, self.store.write(name, rows, part_of(col(key), self.parts), self.store.version() + 1, (key,)))

    def fragments(self, wanted: DataFrame) -> DataFrame:
        """What ``parse_fragments`` says of every string remembered, those in ``wanted`` (fragment) included."""
        return self._remember("fragments", "fragment", wanted, lambda df: parse_fragments(df, self.places))

    def titles(self, wanted: DataFrame) -> DataFrame:
        """What ``title_places`` says of every title remembered, those in ``wanted`` (title) included."""
        return self._remember("titles", "title", wanted, lambda df: title_places(df, self.places))
