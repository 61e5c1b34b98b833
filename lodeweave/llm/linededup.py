"""Line dedup: runs of lines that occurred before, found by winnowing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import MARKS, again, byte_hashes, marked, mix, settled, slices, span_hashes, text_bytes, unused

#: Lines in the shortest run that counts as repeated whatever its size; also the winnowing window.
RUN = 3
#: Bytes of a line that counts as repeated by itself.
LONG = 20

_BLANK = np.zeros(256, bool)
_BLANK[[9, 11, 12, 13, 32]] = True
_ALONE = np.uint64(0xA24BAED4963EE407)


def lines_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Return numbers in their text, hashes, texts' numbers and sizes of all lines that aren't blank; hashes and sizes ignore blanks at both ends."""
    breaks = np.flatnonzero(raw == 10)
    starts = np.r_[offsets[:-1], breaks + 1]  # of each text's first line, and after each break
    owner = np.r_[np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1]
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    first = np.searchsorted(owner, np.arange(len(offsets) - 1))
    number = np.arange(len(owner)) - first[owner]
    ends = np.r_[starts[1:] - 1, len(raw)]
    last = np.r_[owner[1:] != owner[:-1], True]
    ends = np.where(last, offsets[owner + 1], ends)
    black = np.flatnonzero(~(_BLANK[raw] | (raw == 10)))
    if not len(black):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    lo, hi = np.searchsorted(black, starts), np.searchsorted(black, ends)
    full = hi > lo
    lo, hi = lo[full], hi[full]
    first, last = black[lo], black[hi - 1] + 1
    return number[full], byte_hashes(raw, first, last), owner[full], last - first


def _fingerprints(keys: pa.Array, versions: pa.Array, raw: np.ndarray, offsets: np.ndarray, run: int, long: int) -> pa.RecordBatch:
    """Return the winnowed positions of a batch, each with the windows whose least line it is, and long lines as windows of their own."""
    number, hashes, owner, size = lines_of(raw, offsets)
    n = len(hashes)
    at = np.arange(max(n - run + 1, 0))
    at = at[owner[at] == owner[at + run - 1]] if n else at
    window = span_hashes(hashes, at, at + run) if n else np.empty(0, np.uint64)
    best = at.copy()
    for k in range(1, run):  # the rightmost least hash of each window
        best = np.where(hashes[at + k] <= hashes[best], at + k, best)
    cut = np.flatnonzero(np.r_[True, best[1:] != best[:-1]]) if len(at) else np.empty(0, np.int64)
    alone = np.flatnonzero(size >= long)
    single = mix(hashes[alone] ^ _ALONE)
    bounds = pa.array(np.r_[cut, len(at) + np.arange(len(alone) + 1)].astype(np.int32))
    first, last = number[np.r_[at, alone]], number[np.r_[at + run - 1, alone]]
    spans = pa.StructArray.from_arrays([pa.array(np.r_[window, single].view(np.int64)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names=["window", "first", "last"])
    who = pa.array(owner[np.r_[best[cut], alone]])
    return pa.RecordBatch.from_arrays([keys.take(who), versions.take(who), pa.array(np.r_[hashes[best[cut]], single].view(np.int64)), pa.ListArray.from_arrays(bounds, spans)], names=["doc_id", "version", "fingerprint", "windows"])


_SCHEMA = "doc_id long, version long, fingerprint long, windows array<struct<window: long, first: int, last: int>>"


def repeated_lines(docs: DataFrame, run: int = RUN, long: int = LONG, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Return ``(doc_id, version, spans)``: for each document with lines to delete, their ``first`` and ``last`` numbers, from 0.

    ``version`` is xxhash64 of the text. A run of ``run`` lines, or a line of
    ``long`` bytes, is repeated if the same begins earlier, in the order of key,
    version and line. All lines of repeated runs go, so longer matches are
    covered from end to end by the runs within them. See :func:`dedup_lines` for
    what lines and special cases are.

    Winnowing picks the least line hash of every window of ``run`` lines, so two
    equal runs always share a fingerprint; a long line is one by itself. Counts of
    fingerprints are summed before and after a shuffle; those that occur once end
    there. The others' positions are joined with these counts, and a match at a
    position is extended both ways by comparing the windows that hang on it, of
    which a task sends each only once.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("version"), F.col(text).alias("text"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield _fingerprints(batch.column(0), batch.column(1), *text_bytes(batch.column(2)), run, long)

    prints = settled(rows.where("doc_id is not null and text is not null").mapInArrow(emit, _SCHEMA), "lines")
    often = settled(prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fingerprint"), "often")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat() -> Iterator[tuple[np.ndarray, ...]]:
            for batch in batches:
                sizes, spans = np.diff(batch.column(2).offsets.to_numpy()), batch.column(2).flatten()
                window, first, last = (spans.field(k).to_numpy() for k in range(3))
                yield window, np.repeat(batch.column(0).to_numpy(), sizes), np.repeat(batch.column(1).to_numpy(), sizes), first, last

        yield from marked(flat(), False)

    positions = prints.join(often, "fingerprint", "left_semi").select("doc_id", "version", "windows")
    return again(positions.mapInArrow(local, MARKS), False)


def without_lines(text: str, spans: list[tuple[int, int]]) -> str:
    """Return a text without the lines of the spans; blank lines stay."""
    lines = text.split("\n")
    gone = {i for first, last in spans for i in range(first, last + 1)}
    return "\n".join(line for i, line in enumerate(lines) if i not in gone or not line.strip(" \t\r\v\f"))


def dedup_lines(docs: DataFrame, run: int = RUN, long: int = LONG, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Return the rows of ``docs``, all columns, without the lines of later repeated runs.

    A run is ``run`` lines, or one line of ``long`` bytes or more; shorter lines
    go only as part of a run. Lines are what lies between line feeds, compared
    without blanks at their ends; blank lines don't count as lines of a run and
    are never deleted. A document keeps its row even where all its lines go. Of
    equal runs the one in the document of the smallest key stays, within one
    document the first. Keys must be integers. Rows with a null key or text pass
    unchanged and aren't compared; an empty table gives an empty one. A row that
    comes twice isn't a copy of itself: both are cut alike. Rows with the same
    key and other texts are compared like documents. A text of any length is
    taken whole; a worker holds it some ten times over. Other columns may have
    any names and types.
    """
    own, version, found = unused(docs, "own", "version", "found")
    spans = repeated_lines(docs, run, long, text, key).select(F.col("doc_id").alias(own), F.col("version").alias(version), F.col("spans").alias(found))
    schema = docs.schema
    index = schema.fieldNames().index(text)
    joined = docs.join(spans, (F.col(key).cast("long") == F.col(own)) & (F.xxhash64(F.col(text)) == F.col(version)), "left").drop(own, version)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(iter([whole]), text):
                found = batch.column(batch.num_columns - 1)
                columns = batch.columns[:-1]
                if found.null_count < len(found):
                    texts = columns[index].to_pylist()
                    for i in np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False)):
                        texts[i] = without_lines(texts[i], [(s["first"], s["last"]) for s in found[int(i)].as_py()])
                    columns[index] = pa.array(texts, columns[index].type)
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return joined.mapInArrow(cut, T.StructType(schema.fields))


_TRIM = "' ' || chr(9) || chr(11) || chr(12) || chr(13)"
ORACLE = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
b AS (SELECT doc_id, i, line, trim(line, {_TRIM}) AS bare FROM l),
w AS (SELECT doc_id, i, {" || chr(10) || ".join(f"lead(bare, {k}) OVER o" if k else "bare" for k in range(RUN))} AS win, lead(i, {RUN - 1}) OVER o AS last FROM b WHERE bare <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY i)
  UNION ALL SELECT doc_id, i, bare, i FROM b WHERE strlen(bare) >= {LONG}),
r AS (SELECT doc_id, i, last, rank() OVER (PARTITION BY win ORDER BY doc_id, i) AS place FROM w WHERE win IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(range(i, last + 1)) AS i FROM r WHERE place > 1),
k AS (SELECT b.doc_id, string_agg(line, chr(10) ORDER BY b.i) AS text FROM b LEFT JOIN g ON g.doc_id = b.doc_id AND g.i = b.i WHERE g.i IS NULL OR bare = '' GROUP BY b.doc_id)
SELECT d.doc_id, CASE WHEN d.doc_id IS NULL OR d.text IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id
"""
