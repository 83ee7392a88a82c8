"""Token ids in binary files: one zstandard frame per document under a shared dictionary.

A file is a header, the document ids, token counts and frame offsets, then the
frames. The header names the dictionary by its hash, and the offset index lets a
reader decompress one short document without touching the others. Files are
written as binary rows through Spark's own writer, so they live in any store
that Spark can write.
"""

from __future__ import annotations

import hashlib
import math
import os
import re
import string
import struct
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_slices, shuffle_partitions

MAGIC = b"IDSZSTD1"
HEADER = struct.Struct("<8s32sQB7x")
NO_ID = -(1 << 63)
# Bounds of a worker's memory: stretches remembered, characters of one, rows worked on at once.
KEPT, BYTES = 1 << 19, 2 << 20  # words remembered; text encoded at once
CLASSES = 64  # of a source's rows, ranked apart
LATIN_END = "\u0250"  # letters below it are composed already
MARKS = string.punctuation
DOTTED = "\u0130"  # the one letter that lower-cases to a letter and a mark


# --- the file format -------------------------------------------------------------------------------------------------

def width_of(ids: list[np.ndarray]) -> int:
    """Bytes of an id: two where all fit."""
    return 2 if all(not len(a) or int(a.max()) < 1 << 16 for a in ids) else 4


def serialise(ids: np.ndarray, width: int) -> bytes:
    return ids.astype(f"<u{width}").tobytes()


def pack_file(ids: list[np.ndarray], doc_ids: list[int | None], dictionary: bytes, level: int = 3) -> bytes:
    """One file of documents in the given order."""
    width = width_of(ids)
    compressor = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(dictionary), write_checksum=False, write_dict_id=False)
    frames = [compressor.compress(serialise(a, width)) for a in ids]
    offsets = np.concatenate(([0], np.cumsum([len(f) for f in frames], dtype=np.uint64))).astype("<u8")
    keys = np.array([NO_ID if d is None else d for d in doc_ids], "<i8")
    counts = np.array([len(a) for a in ids], "<u4")
    head = HEADER.pack(MAGIC, hashlib.sha256(dictionary).digest(), len(ids), width)
    return b"".join([head, keys.tobytes(), counts.tobytes(), offsets.tobytes(), *frames])


class TokenFile:
    """Random access to the documents of one file."""

    def __init__(self, data: bytes, dictionary: bytes):
        magic, digest, n, self.width = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the file was written with another dictionary")
        at = HEADER.size
        self.doc_ids = np.frombuffer(data, "<i8", n, at)
        self.counts = np.frombuffer(data, "<u4", n, at + 8 * n)
        self.offsets = np.frombuffer(data, "<u8", n + 1, at + 12 * n)
        self.frames = memoryview(data)[at + 20 * n + 8:]
        self.reader = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def ids(self, i: int) -> np.ndarray:
        """The ids of the i-th document; only its own frame is read."""
        size = self.width * int(self.counts[i])
        data = self.reader.decompress(bytes(self.frames[int(self.offsets[i]):int(self.offsets[i + 1])]), max_output_size=size)
        return np.frombuffer(data, f"<u{self.width}").astype("<u4")

    def find(self, doc_id: int) -> int | None:
        """Place of a document in the file, which is in ascending order of ids."""
        i = bisect_left(self.doc_ids, doc_id)
        return i if i < len(self.doc_ids) and self.doc_ids[i] == doc_id else None


@lru_cache(maxsize=4)
def _dictionary(data: bytes):
    return zstandard.ZstdCompressionDict(data) if data else None


# --- ids of a text ---------------------------------------------------------------------------------------------------

class WordEncoder:
    """A byte-level tokenizer that lower-cases and drops white space, asked once per distinct stretch between plain spaces and line ends.

    With ``special`` the strings of special tokens, as they are written, become their ids, as the library does by
    default; otherwise they are ordinary text.
    """

    def __init__(self, path: str, special: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker per core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # Special tokens are cut out of the raw text before; what lower-casing makes look like one is ordinary text.
        self.tokenizer.encode_special_tokens = True
        self.marks: dict[str, np.ndarray] = {}
        for i, t in self.tokenizer.get_added_tokens_decoder().items() if special else ():
            if not t.special or t.normalized or t.single_word:
                raise ValueError(f"added token {t.content!r} is not matched in the raw text")
            self.marks[t.content] = np.array([i], np.uint32)
        # The library takes the leftmost, and of those at one place the longest.
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.marks, key=len, reverse=True))) + ")") if self.marks else None
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._forget()

    def _forget(self) -> None:
        """Empties the table: a word's place, and there the start and length of its ids in one pool."""
        self.known, self.pool, self.starts, self.lengths = {"": 0}, array("I"), array("q", [0]), array("q", [0])

    def _ask(self, words: list[str]) -> list:
        """Ids of words. What normalising and splitting leave as it is, a run of small Latin letters, goes to the library's model at once."""
        tokenize, as_bytes = self.tokenizer.model.tokenize, self.bytes.pre_tokenize_str
        as_is = [None if not w.isalpha() else w if w.isascii() else as_bytes(w)[0][0] if max(w) < LATIN_END and w == w.lower() else None for w in words]
        rest = iter(self.tokenizer.encode_batch_fast([w for w, a in zip(words, as_is, strict=True) if a is None], add_special_tokens=False))
        return [next(rest).ids if a is None else [t.id for t in tokenize(a)] for a in as_is]

    def _keep(self, words: list[str], ids: list) -> None:
        at, sizes = len(self.starts), array("q", map(len, ids))
        self.known.update(zip(words, range(at, at + len(words)), strict=True))
        self.starts.extend(accumulate(sizes[:-1], initial=len(self.pool)) if words else ())
        self.lengths.extend(sizes)
        self.pool.extend(chain.from_iterable(ids))

    def _learn(self, new: list[str]) -> None:
        """Marks of ASCII punctuation after letters or digits are a piece of their own, so they are cut off first."""
        ends = {}
        for w in new:
            if w[-1] in MARKS and (stem := w.rstrip(MARKS)).isalnum() and DOTTED not in stem:
                ends[w] = stem, w[len(stem):]
        known = self.known
        asked = [x for x in dict.fromkeys(chain((w for w in new if w not in ends), chain.from_iterable(ends.values()))) if x not in known]
        self._keep(asked, self._ask(asked))
        pool, starts, lengths = self.pool, self.starts, self.lengths

        def own(word: str) -> array:
            at = known[word]
            return pool[starts[at]:starts[at] + lengths[at]]

        self._keep(list(ends), [own(stem) + own(tail) for stem, tail in ends.values()])

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        held = np.flatnonzero(pc.match_substring_regex(texts, self.cut.pattern).to_numpy(zero_copy_only=False)).tolist() if self.cut else []
        if not held:
            return self._encode_plain(texts)
        pieces = {k: self.cut.split(texts[k].as_py()) for k in held}  # every second piece is a special token
        flat = [[t] if k not in pieces else pieces[k][::2] for k, t in enumerate(texts.to_pylist())]
        ids = iter(self._encode_plain(pa.array([t for ts in flat for t in ts], pa.large_string())))
        out = []
        for k, ts in enumerate(flat):
            own = [next(ids) for _ in ts]
            marks = [self.marks[m] for m in pieces[k][1::2]] if k in pieces else []
            out.append(np.concatenate([x for pair in zip(own, [*marks, np.zeros(0, np.uint32)], strict=True) for x in pair]))
        return out

    def _encode_plain(self, texts: pa.Array) -> list[np.ndarray]:
        if len(self.known) > KEPT or len(self.pool) > 16 * KEPT:
            self._forget()
        spaced = texts
        for c in "\n\t\r":
            spaced = pc.replace_substring(spaced, c, " ")
        # A-Z would be lower-cased by the tokenizer anyway. (ascii_lower is wrong on slices; the replacing has made whole arrays.)
        stretches = pc.split_pattern(pc.ascii_lower(spaced), " ")
        coded = stretches.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        self._learn([w for w in words if w not in self.known])
        known = self.known
        place = np.array([known[w] for w in words], np.int64)
        starts, lengths, pool = np.frombuffer(self.starts, np.int64)[place], np.frombuffer(self.lengths, np.int64)[place], np.frombuffer(self.pool, np.uint32)
        at = coded.indices.to_numpy()
        sizes = lengths[at]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        ids = pool[np.arange(ends[-1]) + np.repeat(starts[at] - ends[:-1], sizes)] if len(pool) else np.zeros(0, np.uint32)
        offsets = stretches.offsets.to_numpy()
        bounds = ends[offsets - offsets[0]]
        return [ids[low:high] for low, high in zip(bounds[:-1], bounds[1:], strict=True)]


@lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path, special=True)


# --- Spark -----------------------------------------------------------------------------------------------------------

def train_dictionary(docs: DataFrame, tokenizer_path: str, text_col: str = "text", id_col: str = "doc_id", source_col: str | None = None,
                     sample_docs: int = 512, sample_ids: int = 8 << 10, dictionary_bytes: int = 64 << 10) -> bytes:
    """The shared dictionary, from one stretch of ``sample_ids`` ids of each of at most ``sample_docs`` documents.

    Documents are taken by the smallest hashes of id and text, from every source of
    ``source_col`` in turn, and a stretch begins where the hash says, so reruns
    agree. Only the dictionary rests on the sample: every document is written
    whole. Too few documents to train on give an empty dictionary.
    """
    key = F.xxhash64(id_col, text_col)
    rows = docs.select(key.alias("k"), F.xxhash64(F.col(source_col) if source_col else F.lit(0)).alias("source")).withColumn("class", F.pmod("k", F.lit(CLASSES)))
    # Each source is ranked in classes first, which leaves few rows of it however large it is.
    few = rows.withColumn("place", F.row_number().over(Window.partitionBy("source", "class").orderBy("k"))).where(F.col("place") <= max(1, 4 * sample_docs // CLASSES))
    ranked = few.withColumn("turn", F.row_number().over(Window.partitionBy("source").orderBy("k"))).where(F.col("turn") <= sample_docs)
    keys = [r["k"] for r in ranked.orderBy("turn", "k").limit(sample_docs).collect()]
    if not keys:
        return b""

    def serialised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, text_col, BYTES):
            ids = word_encoder(tokenizer_path).encode(batch.column(text_col))
            begins = [k % max(1, len(i) - sample_ids + 1) for k, i in zip(batch.column("k").to_pylist(), ids, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([serialise(i[b:b + sample_ids], width_of([i])) for b, i in zip(begins, ids, strict=True)], pa.binary())], names=["ids"])

    chosen = docs.select(key.alias("k"), text_col).where(F.col("k").isin(keys)).limit(2 * sample_docs)
    samples = sorted(r[0] for r in chosen.mapInArrow(serialised, "ids binary").collect() if r[0])
    try:
        return zstandard.train_dictionary(dictionary_bytes, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1, text_col: str = "text", id_col: str = "doc_id",
                 file_ids: int = 1 << 20, dictionary: bytes | None = None, source_col: str | None = None) -> None:
    """Encodes every whole text, appends ``end_id`` and writes files in ascending order of ``id_col``.

    Null text is empty (its file entry holds the end id alone); null ids come
    first; rows that repeat an id are all written, in the order of their texts'
    hashes. Documents are cut into id ranges at approximate quantiles, so each
    task writes one stretch of the order. A file closes after ``file_ids`` ids;
    one document is never split. ``source_col`` spreads the dictionary's sample
    over sources. An empty table gives no file, and reading it no rows.
    """
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, tokenizer_path, text_col, id_col, source_col) if dictionary is None else dictionary
    parts = 4 * shuffle_partitions(spark)
    cuts = docs.agg(F.percentile_approx(id_col, [k / parts for k in range(1, parts)], 20 * parts)).first()[0] or [0]
    splits = [-math.inf, *sorted({float(c) for c in cuts}), math.inf]
    keyed = docs.select(id_col, text_col, F.coalesce(F.col(id_col).cast("double"), F.lit(-math.inf)).alias("_at"))
    ranged = Bucketizer(splits=splits, inputCol="_at", outputCol="_part").transform(keyed).select(id_col, text_col, F.col("_part").cast("int").alias("part"))
    ordered = ranged.repartition("part").sortWithinPartitions("part", F.col(id_col).asc_nulls_first(), F.xxhash64(text_col))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer_path)
        at, before, ids, keys, held = None, 0, [], [], 0

        def closed():
            return pa.RecordBatch.from_arrays([
                pa.array([at], pa.int32()), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([held], pa.int64()),
                pa.array([pack_file(ids, keys, dictionary)], pa.binary())], names=["part", "before", "docs", "ids", "file"])

        for batch in byte_slices(batches, text_col, BYTES):
            encoded = encoder.encode(batch.column(text_col))
            for p, k, e in zip(batch.column("part").to_pylist(), batch.column(id_col).to_pylist(), encoded, strict=True):
                if ids and (p != at or held >= file_ids):
                    yield closed()
                    before, ids, keys, held = before + held if p == at else 0, [], [], 0
                at = p
                ids.append(np.append(e, np.uint32(end_id)))
                keys.append(k)
                held += len(ids[-1])
        if ids:
            yield closed()

    ordered.mapInArrow(pack, "part int, before long, docs long, ids long, file binary").write.parquet(f"{folder}/files")
    spark.createDataFrame([(dictionary, hashlib.sha256(dictionary).hexdigest())], "dictionary binary, sha256 string").coalesce(1).write.parquet(f"{folder}/dictionary")


def read_tokens(spark: SparkSession, folder: str, id_name: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids) of every document in the folder's files; ids are little-endian unsigned 32-bit.

    ``start`` counts the ids of all documents before. A part's files know what
    stands before them in the part; the parts' totals, one row for each of the
    writer's id ranges, are summed up and broadcast. Ids are not shuffled.
    """
    dictionary = spark.read.parquet(f"{folder}/dictionary").first()["dictionary"]
    files = spark.read.parquet(f"{folder}/files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.groupBy("part").agg(F.sum("ids").alias("total")).select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, data in zip(batch.column("begin").to_pylist(), batch.column("file").to_pylist(), strict=True):
                file = TokenFile(data, dictionary)
                starts = begin + np.concatenate(([0], np.cumsum(file.counts, dtype=np.int64)))[:-1]
                yield pa.RecordBatch.from_arrays([
                    pa.array([None if k == NO_ID else k for k in file.doc_ids.tolist()], pa.int64()), pa.array(starts), pa.array(file.counts.astype(np.int64)),
                    pa.array([file.ids(i).tobytes() for i in range(len(starts))], pa.binary())], names=[id_name, "start", "n_tokens", "ids"])

    placed = files.join(F.broadcast(bases), "part").select((F.col("base") + F.col("before")).alias("begin"), "file")
    return placed.mapInArrow(unpack, f"{id_name} long, start long, n_tokens long, ids binary")
