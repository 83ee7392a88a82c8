"""Language identification by nearest centroid.

A text becomes a normalised TF-IDF vector of hashed letter n-grams. Each language
has several centroids from spherical k-means; the nearest by cosine names the
language, and a text too far from it for its length is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import slices, strings

DIMENSIONS = 4096
GRAMS = (2, 3)
NO_LETTERS = re.compile(r"[\W\d_]+")
UNKNOWN = "und"
LENGTHS = 12  # classes of length, by the power of two of the letters
ROWS = 256


def letters_of(text: str) -> str:
    return NO_LETTERS.sub(" ", text.lower()).strip()


def gram_counts(letters: str) -> np.ndarray:
    """Counts of hashed n-grams of the UTF-8 bytes, words set apart by single spaces."""
    data = np.frombuffer(f" {letters} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    out = np.zeros(DIMENSIONS, np.float32)
    for n in GRAMS:
        code = np.full(max(0, len(data) - n + 1), n, np.uint32)
        for k in range(n):
            code = code * np.uint32(257) + data[k:len(data) - n + 1 + k]
        out += np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=DIMENSIONS)
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length == 0, 1, length)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids; seeds are the row nearest the mean, then each time the row farthest from all seeds."""
    seeds = [int(np.argmax(x @ x.mean(0)))]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmin((x @ x[seeds].T).max(1))))
    c = x[seeds]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = unit(np.stack([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))]))
    return c


def length_class(letters: str) -> int:
    return min(LENGTHS - 1, len(letters).bit_length())


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    floor: np.ndarray  # least cosine by class of length; below it a text is rejected

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[bool]]:
        """Language, cosine and rejection of each text; one without a letter is ``und`` and rejected."""
        letters = [letters_of(t) for t in texts]
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        cosine = unit(np.stack([gram_counts(t) for t in letters]) * self.idf) @ self.centroids.T if texts else np.zeros((0, 1))
        best = cosine.argmax(1)
        score = np.clip(cosine[np.arange(len(best)), best], 0.0, 1.0).astype(float)
        named = [self.languages[b] if t else UNKNOWN for b, t in zip(best, letters, strict=True)]
        scores = [float(s) if t else 0.0 for s, t in zip(score, letters, strict=True)]
        return named, scores, [not t or s < self.floor[length_class(t)] for s, t in zip(scores, letters, strict=True)]


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = 1000, clusters: int = 4,
          quantile: float = 0.001, slack: float = 0.7) -> LanguageModel:
    """Fits on at most ``per_language`` labelled rows of each language, those of the smallest hashes of id and text.

    Rows without label, text or letter teach nothing; null and repeated ids are
    told apart by their texts. A text is rejected when its
    cosine lies below ``slack`` times the ``quantile`` of the sample's texts, cut
    to all shorter lengths too, in its class of length.
    """
    mixed = F.xxhash64(id_col, text_col)
    # What ``letters_of`` leaves something of.
    docs = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"[\p{L}\p{Nl}\p{No}]"))
    # Rows are hashed evenly, so a cut at a few times the wanted share of different ones leaves a bounded number to rank, however common a language is.
    sizes = docs.groupBy(F.col(lang_col).alias("_lang")).agg(F.approx_count_distinct(mixed).alias("_rows"))
    place = mixed.cast("double") / F.lit(2.0**64) + F.lit(0.5)
    # One row per language, as many as the model holds centroids for.
    few = docs.join(F.broadcast(sizes), docs[lang_col] == F.col("_lang")).where(place * F.col("_rows") <= 4 * per_language)
    usable = few.select(F.col(id_col).alias("id"), mixed.alias("mixed"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sample = materialize(usable.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("mixed", "id"))).where(F.col("_n") <= per_language).select("lang", "text"), "languages")

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in slices(batches, ROWS):
            for text in strings(batch, "text"):
                seen += gram_counts(letters_of(text)) > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([seen.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["seen", "n"])

    parts = sample.mapInArrow(presence, "seen binary, n long").collect()
    n = sum(p["n"] for p in parts)
    idf = np.log((1 + n) / (1 + sum((np.frombuffer(p["seen"], np.int64) for p in parts), np.zeros(DIMENSIONS, np.int64)))).astype(np.float32) + np.float32(0.1)

    def cluster(rows: pd.DataFrame) -> pd.DataFrame:
        letters = [t for t in map(letters_of, rows["text"]) if t]
        if not letters:
            return pd.DataFrame({"lang": [], "centroids": [], "floor": []})
        c = spherical_kmeans(unit(np.stack([gram_counts(t) for t in letters]) * idf), clusters)
        floor = np.ones(LENGTHS)
        for size in range(LENGTHS):
            cut = [t[: (1 << size) - 1] for t in letters if len(t) >= (1 << size) >> 1] if size else []
            cut = [t for t in map(str.strip, cut) if t]
            if cut:
                floor[size] = np.quantile((unit(np.stack([gram_counts(t) for t in cut]) * idf) @ c.T).max(1), quantile)
            elif size > 1:
                floor[size] = floor[size - 1]
        floor[-1] = min(floor[-1], floor[-2])
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "centroids": [c.astype(np.float32).tobytes()], "floor": [floor.tobytes()]})

    fitted = sorted(sample.groupBy("lang").applyInPandas(cluster, "lang string, centroids binary, floor binary").collect())
    blocks = [np.frombuffer(f["centroids"], np.float32).reshape(-1, DIMENSIONS) for f in fitted]
    floors = [np.frombuffer(f["floor"]) for f in fitted]
    return LanguageModel([f["lang"] for f, b in zip(fitted, blocks, strict=True) for _ in b], np.concatenate(blocks) if blocks else np.zeros((0, DIMENSIONS), np.float32),
                         idf, slack * np.min(floors, axis=0) if floors else np.ones(LENGTHS))


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Adds ``lang_pred``, ``score`` (cosine, 0 to 1) and ``rejected``, named with ``prefix`` before them.

    Reads nothing but the text; null is like a text without letters: ``und``,
    score 0, rejected. Row-local: repeated rows and other columns pass through,
    whatever their names, as long as the three new names are free; choose a
    ``prefix`` where they are not. An empty table gives an empty result.
    """
    names = [f"{prefix}{n}" for n in ("lang_pred", "score", "rejected")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            lang, score, rejected = model.predict(strings(batch, text_col))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                                             names=[*batch.schema.names, *names])

    added = [T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True)]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))
