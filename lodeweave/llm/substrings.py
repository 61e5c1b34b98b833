"""Dedup of repeated passages, anchored at rolling-hash triggers.

A text is a line of words. A rolling hash over some words (two fifths of a
passage) is least at one position of every window of the others: these positions
are triggers, and cut the line into phrases as prefix-free parsing does. Whether a
position is a trigger depends only on the words near it, so equal passages are cut
alike, and each has a trigger of its own with its words.

Prefix-free parsing goes on to sort: it builds the dictionary of phrases, the
parse, and suffix arrays of both, from which the order of all suffixes of the
corpus follows. Here nothing is sorted as suffixes. Which positions agree over a
passage's length asks only for classes, not for an order: first classes of the
words at triggers, each trigger sent once, then, for passages whose own trigger
recurs, classes of the whole passages. A suffix order over a partitioned corpus
would take several shuffles of all positions; classes take one for each depth.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import MARKS, again, marked, slices, span_hashes, text_bytes, unused, words

#: Words of the shortest passage that counts as repeated.
LENGTH = 50


def _gram(length: int) -> int:
    """Return the words of a rolling hash: with 20 of 50, every 31 positions have a trigger, on average one in 16."""
    return max(1, length * 2 // 5)


def _own_triggers(grams: np.ndarray, wide: int) -> np.ndarray:
    """Return for each position at which a window of ``wide`` positions begins the first of its least."""
    best, have = np.arange(len(grams)), 1
    while have < wide:
        step = min(have, wide - have)
        a, b = best[:-step], best[step:]
        best = np.where(grams[b] < grams[a], b, a)
        have += step
    return best


def _parsed(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Return word hashes, texts' bounds, the places and owners of all passages, and the places and rolling hashes of their triggers."""
    _, _, hashes, bounds = words(raw, offsets)
    gram, n = _gram(length), len(hashes)
    if n < length:
        nothing = np.empty(0, np.int64)
        return hashes, bounds, nothing, nothing, nothing, np.empty(0, np.uint64)
    at = np.arange(n - gram + 1)
    grams = span_hashes(hashes, at, at + gram)  # those that run on into the next text are in no passage's window
    trigger = _own_triggers(grams, length - gram + 1)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(trigger)]
    begin = np.flatnonzero(np.arange(len(trigger)) + length <= bounds[owner + 1])
    return hashes, bounds, begin, owner[begin], trigger[begin], grams


def _triggers(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Return owners, places and keys of the triggers of all passages."""
    _, bounds, _, owner, trigger, grams = _parsed(raw, offsets, length)
    new = np.flatnonzero(np.r_[True, trigger[1:] != trigger[:-1]]) if len(trigger) else trigger
    return owner[new], trigger[new] - bounds[owner[new]], grams[trigger[new]]


def _passages(raw: np.ndarray, offsets: np.ndarray, found: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Return owners, places and keys of the passages of ``length`` words whose trigger is in one of the ranges found, which recur."""
    hashes, bounds, begin, owner, trigger, _ = _parsed(raw, offsets, length)
    edge = np.zeros(len(hashes) + 1, np.int32)
    for i, ranges in enumerate(found):
        np.add.at(edge, bounds[i] + ranges[0], 1)
        np.add.at(edge, bounds[i] + ranges[1] + 1, -1)
    some = np.cumsum(edge)[trigger] > 0
    begin, owner = begin[some], owner[some]
    return owner, begin - bounds[owner], span_hashes(hashes, begin, begin + length) if len(begin) else np.empty(0, np.uint64)


def _keyed(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("version"), F.col(text).alias("text")).where("doc_id is not null and text is not null")


def _rows(batch: pa.RecordBatch, owner: np.ndarray, place: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, ...]:
    place = place.astype(np.int32)
    return keys.view(np.int64), batch.column(0).to_numpy()[owner], batch.column(1).to_numpy()[owner], place, place


def _ranges(lists: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Return the firsts and lasts of each list of ranges."""
    return [(x.values.field(0).to_numpy(), x.values.field(1).to_numpy()) for x in lists]


def repeated_words(docs: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Return ``(doc_id, version, spans)``: ranges of words at which passages of ``length`` words begin that occur earlier.

    Triggers are shuffled once; texts of documents with triggers that recur are
    read again for the passages, which are shuffled once. Either way a task sends
    a key that it sees often only once (see :func:`shared.marked`), so a passage
    that a third of all documents have is no burden to one task.
    """
    rows = _keyed(docs, text, key)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from marked((_rows(batch, *_triggers(*text_bytes(batch.column(2)), length)) for batch in slices(batches)), True)

    found = again(rows.mapInArrow(parse, MARKS), True)
    texts = rows.join(found, ["doc_id", "version"]).select("doc_id", "version", "text", "spans")

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from marked((_rows(batch, *_passages(*text_bytes(batch.column(2)), _ranges(batch.column(3)), length)) for batch in slices(batches)), False)

    return again(texts.mapInArrow(passages, MARKS), False)


def _spans(texts: pa.Array, marks: pa.Array, length: int) -> list[list[dict[str, int]]]:
    """Return, for texts and the ranges of words at which repeated passages begin, the unions of these that overlap or touch."""
    raw, offsets = text_bytes(texts)
    starts, ends, _, bounds = words(raw, offsets)
    out = []
    for i, (first, last) in enumerate(_ranges(marks)):
        order = np.argsort(first, kind="stable")
        first, last = first[order].astype(np.int64), np.maximum.accumulate(last[order].astype(np.int64))
        cut = np.flatnonzero(first[1:] - last[:-1] > length)
        firsts, lasts = first[np.r_[0, cut + 1]], last[np.r_[cut, len(last) - 1]] + length - 1
        lo, hi = starts[bounds[i] + firsts] - offsets[i], ends[bounds[i] + lasts] - offsets[i]
        out.append([dict(zip(("first_word", "last_word", "start", "stop"), map(int, x), strict=True)) for x in zip(firsts, lasts, lo, hi, strict=True)])
    return out


def repeated_spans(docs: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Return ``(doc_id, version, spans)``: the passages of each document that occur earlier.

    A passage of ``length`` words is repeated if the same words stand earlier, in
    a document of smaller key or before it in the same one; ``spans`` are the
    unions of a document's repeated passages that overlap or touch, each with
    its ``first_word`` and ``last_word`` (from 0) and the bytes from ``start`` to
    before ``stop``. ``version`` is xxhash64 of the text. Longer repeats are found
    from end to end, as all passages within them are.

    A word is a run of letters, digits and non-ASCII characters; case and all
    else are ignored. Rows with a null key or text have no passages; nor do texts
    under ``length`` words. Keys must be integers. A row that comes twice isn't a
    copy of itself; texts with the same key are compared like documents, in the
    order of ``version``. A text of any length is taken whole; a worker holds it
    some fifteen times over. Other columns don't matter. An empty table gives an
    empty result.
    """
    places = _keyed(docs, text, key).join(repeated_words(docs, length, text, key).withColumnRenamed("spans", "marks"), ["doc_id", "version"]).select("doc_id", "version", "text", "marks")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_spans(batch.column(2), batch.column(3), length), _SPANS)], names=["doc_id", "version", "spans"])

    found = places.mapInArrow(spans, "doc_id long, version long, spans array<struct<first_word: int, last_word: int, start: long, stop: long>>")
    return found.dropDuplicates(["doc_id", "version"])  # of rows that come twice


_SPANS = pa.list_(pa.struct([("first_word", pa.int32()), ("last_word", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())]))


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """Return a text without spans of its UTF-8 bytes, and without the blanks that then lead."""
    raw, out, at = text.encode(), bytearray(), 0
    for start, stop in spans:
        out += raw[at:start]
        at = stop
        while at < len(raw) and raw[at] in b" \t":
            at += 1
    return (bytes(out) + raw[at:]).decode()


def dedup_passages(docs: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Return the rows of ``docs``, all columns, without passages that occur earlier; the first occurrence stays.

    All rows stay, also those of which no word is left. Other columns may have
    any names and types. See :func:`repeated_spans`.
    """
    own, version, marks = unused(docs, "own", "version", "marks")
    found = repeated_words(docs, length, text, key).select(F.col("doc_id").alias(own), F.col("version").alias(version), F.col("spans").alias(marks))
    schema = docs.schema
    index = schema.fieldNames().index(text)
    joined = docs.join(found, (F.col(key).cast("long") == F.col(own)) & (F.xxhash64(F.col(text)) == F.col(version)), "left").drop(own, version)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            marks = batch.column(batch.num_columns - 1)
            columns = batch.columns[:-1]
            some = np.flatnonzero(marks.is_valid().to_numpy(zero_copy_only=False))
            if len(some):
                texts = columns[index].to_pylist()
                who = pa.array(some)
                for i, spans in zip(some, _spans(columns[index].take(who), marks.take(who), length), strict=True):
                    texts[i] = without_spans(texts[i], [(s["start"], s["stop"]) for s in spans])
                columns[index] = pa.array(texts, columns[index].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return joined.mapInArrow(cut, T.StructType(schema.fields))


_UPPER = "".join(chr(c) for c in (*range(0x41, 0x5B), *range(0xC0, 0xDF)) if c != 0xD7)
_LOWER = "".join(chr(ord(c) + 32) for c in _UPPER)
_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
#: Passages are compared as texts, for documents of which each has a key of its own.
ORACLE = f"""
WITH d AS (SELECT doc_id, translate(text, '{_UPPER}', '{_LOWER}') AS low FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
a AS (SELECT doc_id, regexp_extract_all(low, '{_WORD}') AS ws, string_split_regex(low, '{_WORD}') AS gaps FROM d),
u AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS w, unnest(gaps[1:len(ws)]) AS gap FROM a),
b AS (SELECT doc_id, i, w, CAST(sum(strlen(gap) + strlen(w)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS stop FROM u),
p AS (SELECT doc_id, i, string_agg(w, ' ') OVER o AS passage, lead(i, {LENGTH - 1}) OVER (PARTITION BY doc_id ORDER BY i) AS last FROM b WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {LENGTH - 1} FOLLOWING)),
r AS (SELECT doc_id, i, rank() OVER (PARTITION BY passage ORDER BY doc_id, i) AS place FROM p WHERE last IS NOT NULL),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {LENGTH} THEN 0 ELSE 1 END AS new FROM r WHERE place > 1),
s AS (SELECT doc_id, min(i) AS first, max(i) + {LENGTH - 1} AS last FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g) GROUP BY doc_id, span)
SELECT s.doc_id, CAST(s.first - 1 AS INTEGER) AS first_word, CAST(s.last - 1 AS INTEGER) AS last_word, x.stop - strlen(x.w) AS start, y.stop AS stop FROM s JOIN b x ON x.doc_id = s.doc_id AND x.i = s.first JOIN b y ON y.doc_id = s.doc_id AND y.i = s.last
"""
