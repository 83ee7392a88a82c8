"""Token index over title, company and body, and the searches it answers.

The index is a table (token, field, id, pos) written sorted by token, so a
query reads only the row groups of its own words. Stored, all places of a word
in a field are one entry. Phrases need no self-join:
every occurrence votes for the position its phrase would start at, and a start
with all its words present is a hit.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, fold_literal, let

col = F.col
NOT_WORD = "[^\\p{L}\\p{N}]+"
FIELDS = ["company", "title", "body"]  # best field first
PREFIX_MIN = 3  # fixed value: shorter words must match whole


def words_of(term: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", fold_literal(term)) if w]


def build_token_index(texts: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """``texts`` has id and text columns named after the fields; narrow, no shuffle."""
    fields = fields or [f for f in FIELDS if f in texts.columns]
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), col(f).alias("text")) for f in fields])).alias("x")
    tokens = F.filter(F.split(fold(col("x.text")), NOT_WORD), lambda t: t != "")
    return texts.select("id", each).select("id", "x.field", F.posexplode(tokens).alias("pos", "token"))


ENTRY = "token string, field string, id string, first boolean, places array<int>"
WORDS_AT_ONCE = 1 << 20  # what a task holds at a time, at six bytes a word, or one text
# What stands between words, but for single blanks, which stay.
WORD_GAP = "[^\\p{L}\\p{N} ][^\\p{L}\\p{N}]*| [^\\p{L}\\p{N}]+"


def build_entries(texts: DataFrame, fields: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """``build_token_index`` with one row per posting, field and word: its places, and whether it is the word's first row of the posting.

    Narrow. Rows are fewer by what a text repeats, and postings of a word are its
    first rows where ids are not repeated. They come in long runs sorted by token,
    which spares a later sort most of its comparisons. With ``parts``, a column
    ``part`` says which a token is in, as ``part_of`` does, and runs are sorted by
    it first; it is found once for all rows of a run that share the token.
    """
    fields = fields or [f for f in FIELDS if f in texts.columns]
    # What tasks run stands inside, so that workers need no module of ours. Texts cross as one string each, not as words.
    spaced = texts.select("id", *[F.trim(F.regexp_replace(fold(col(f)), WORD_GAP, " ")).alias(f) for f in fields])
    schema = ENTRY if parts is None else f"{ENTRY}, part int"

    def entries_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Entries of some texts; columns after the id are texts with their words a blank apart."""
        ids = batch.column(0)
        words, owner, field, place = [], [], [], []
        for n, name in enumerate(fields):
            column = pc.split_pattern(batch.column(name), " ")
            sizes = np.diff(column.offsets.to_numpy())
            words.append(column.flatten())
            owner.append(np.repeat(np.arange(len(sizes)), sizes))
            field.append(np.full(len(words[-1]), n))
            place.append(np.arange(len(words[-1])) - np.repeat(np.cumsum(sizes) - sizes, sizes))
        coded = pa.chunked_array(words, pa.string()).combine_chunks().dictionary_encode()
        code, owner, field, place = coded.indices.to_numpy(), np.concatenate(owner), np.concatenate(field), np.concatenate(place)
        blank = coded.dictionary.index("").as_py()  # what a split leaves of an empty text
        kept = np.flatnonzero(code != blank)
        # By part, word, posting and field; places stay in their order.
        rank = np.empty(len(coded.dictionary), np.int64)
        rank[pc.array_sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
        if parts is not None:
            hashes = b"".join([hashlib.md5(w).digest()[:4] for w in coded.dictionary.cast(pa.binary()).to_pylist()])
            part = ((np.frombuffer(hashes, ">u4") >> 4) % parts).astype(np.int32)  # seven hexadecimal digits
            rank += part.astype(np.int64) * len(rank)
        word = rank[code[kept]] * batch.num_rows + owner[kept]
        key = word * len(fields) + field[kept]
        count = max(len(key), 1)
        if key.max(initial=0) < (1 << 62) // count:  # keys that end in their place are sorted without it, several times as fast
            order = np.sort(key * count + np.arange(len(key))) % count
        else:
            order = np.argsort(key, kind="stable")
        kept, word, key = kept[order], word[order], key[order]
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        at = kept[starts]
        first = np.diff(word[starts], prepend=-1) != 0
        places = pa.ListArray.from_arrays(pa.array(np.append(starts, len(kept)), pa.int32()), pa.array(place[kept], pa.int32()))
        columns = [coded.dictionary.take(pa.array(code[at])), pa.array(fields, pa.string()).take(pa.array(field[at])), ids.take(pa.array(owner[at])), pa.array(first), places]
        names = ["token", "field", "id", "first", "places"]
        if parts is not None:
            columns, names = [*columns, pa.array(part[code[at]])], [*names, "part"]
        return pa.RecordBatch.from_arrays(columns, names)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, at = np.cumsum(sum(pc.binary_length(batch.column(f)).to_numpy().astype(np.int64) for f in fields)), 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 6 * WORDS_AT_ONCE, "right")))
                yield entries_of(batch.slice(at, end - at))
                at = end

    return spaced.mapInArrow(entries, schema)


def ids_once(texts: DataFrame) -> bool:
    """Whether no id is repeated; only the ids are read."""
    return texts.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(col("n") > 1).isEmpty()


def write_token_index(index: DataFrame, path: str, files: int) -> None:
    """Range-partitioned and sorted by token; a token with very many hits is split by id."""
    index.repartitionByRange(files, "token", "id").sortWithinPartitions("token", "id", "pos").write.mode("error").parquet(path)


def phrase_hits(index: DataFrame, terms: list[str], field: str | None = "body") -> DataFrame:
    """(id, term): postings whose field holds the words of the term in a row."""
    slots: dict[str, list[tuple[int, int]]] = {}
    lengths = {}
    for n, term in enumerate(terms):
        words = words_of(term)
        lengths[n] = len(words)
        for at, word in enumerate(words):
            slots.setdefault(word, []).append((n, at))
    if not slots:
        return index.select("id", F.lit(0).alias("term")).where("false")
    hits = index.where(col("token").isin(list(slots)))
    if field is not None:
        hits = hits.where(col("field") == field)
    where = F.create_map(*[x for word, uses in slots.items() for x in (
        F.lit(word), F.array(*[F.struct(F.lit(n).alias("term"), F.lit(at).alias("at")) for n, at in uses]))])
    votes = hits.select("id", "field", "pos", F.explode(F.try_element_at(where, col("token"))).alias("s"))
    # Nearly every vote is a start of its own, so a map task would only gather them in memory: they are dealt by id first.
    votes = votes.repartition("id")
    length = F.create_map(*[F.lit(x) for pair in lengths.items() for x in pair])
    starts = (
        votes.groupBy("id", "field", col("s.term").alias("term"), (col("pos") - col("s.at")).alias("start"))
        .agg(F.count(F.lit(1)).alias("n")).where(col("n") == F.try_element_at(length, col("term")))
    )
    return starts.select("id", "term").distinct()


def match_terms(index: DataFrame, terms: list[str], mode: str = "any", field: str | None = "body") -> DataFrame:
    """Ids whose field holds any (or all) of the phrases."""
    asked = [t for t in terms if words_of(t)]
    hits = phrase_hits(index, asked, field)
    if mode == "any" or not asked:
        return hits.select("id").distinct()
    return hits.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(col("n") == len(asked)).select("id")


def text_query(index: DataFrame, text: str) -> DataFrame:
    """(id, text_field): postings where every word starts some token, and the best single field that has them all.

    ``text_field`` is company or title when that field alone holds every word,
    else body.
    """
    words = list(dict.fromkeys(words_of(text)))
    tests = [col("token").startswith(w) if len(w) >= PREFIX_MIN else col("token") == w for w in words]
    if not words:
        return index.select("id", F.lit("body").alias("text_field")).where("false")
    any_word = tests[0]
    for t in tests[1:]:
        any_word = any_word | t
    # Per posting and field: which words occur; then per posting over fields.
    per_field = index.where(any_word).groupBy("id", "field").agg(*[F.bool_or(t).alias(f"w{i}") for i, t in enumerate(tests)])
    full = F.lit(True)
    for i in range(len(words)):
        full = full & col(f"w{i}")
    ranks = F.when(full & (col("field") == "company"), 1).when(full & (col("field") == "title"), 2).otherwise(3)
    per_posting = per_field.groupBy("id").agg(F.min(ranks).alias("rank"), *[F.bool_or(f"w{i}").alias(f"w{i}") for i in range(len(words))])
    return per_posting.where(full).select("id", F.when(col("rank") == 1, "company").when(col("rank") == 2, "title").otherwise("body").alias("text_field"))


def exclude_text(df: DataFrame, index: DataFrame, terms: list[str]) -> DataFrame:
    """Rows whose body holds none of the phrases."""
    return df.join(match_terms(index, terms, "any"), "id", "left_anti")


def missing_text(postings: DataFrame, texts: DataFrame, text: str = "text") -> DataFrame:
    """Ids of postings with no text row, or an empty one."""
    has = texts.where(col(text).isNotNull() & (col(text) != "")).select("id")
    return postings.select("id").join(has, "id", "left_anti")


def phrase_pattern(term: str) -> str:
    """Pattern for a phrase in folded text: the scan that answers without an index.

    The first word comes before its own left guard, so places without it are passed over cheaply.
    """
    words = words_of(term)
    edge = "[\\p{L}\\p{N}]"
    rest = "".join(NOT_WORD + w for w in words[1:])
    return f"{words[0]}(?<!{edge}{words[0]}){rest}(?!{edge})"


def holds_phrases(folded: Column, terms: list[str], mode: str = "any") -> Column:
    """Whether folded text holds any (or all) of the phrases."""
    asked = [t for t in terms if words_of(t)]
    out = None
    for term in asked:
        hit = folded.contains(words_of(term)[-1]) & folded.rlike(phrase_pattern(term))
        out = hit if out is None else (out & hit if mode == "all" else out | hit)
    return F.lit(False) if out is None else out


def starts_words(folded: Column, words: list[str]) -> Column:
    """Array of booleans: which words some token of folded text starts with."""
    edge = "[\\p{L}\\p{N}]"
    return F.array(*[folded.contains(w) & folded.rlike(f"{w}(?<!{edge}{w})" + ("" if len(w) >= PREFIX_MIN else f"(?!{edge})")) for w in words])


def match_terms_scan(text: Column, terms: list[str], mode: str = "any") -> Column:
    """The answer of ``match_terms`` as an expression over the text itself; no shuffle."""
    return let(fold(text), lambda folded: holds_phrases(folded, terms, mode)) if any(words_of(t) for t in terms) else F.lit(False)


def text_query_scan(texts: DataFrame, text: str) -> DataFrame:
    """The answer of ``text_query`` from the texts themselves; no shuffle."""
    words = list(dict.fromkeys(words_of(text)))
    if not words:
        return texts.select("id", F.lit("body").alias("text_field")).where("false")
    found = texts.select("id", *[let(fold(col(f)), lambda folded: starts_words(folded, words)).alias(f) for f in FIELDS])
    somewhere = F.lit(True)
    for i in range(len(words)):
        somewhere = somewhere & (col("company")[i] | col("title")[i] | col("body")[i])

    def whole(field: str) -> Column:
        return F.forall(field, lambda x: x)

    return found.where(somewhere).select("id", F.when(whole("company"), "company").when(whole("title"), "title").otherwise("body").alias("text_field"))
