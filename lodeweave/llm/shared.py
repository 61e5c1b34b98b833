"""Helpers that several operators use: shared folder, tables, text batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeweave.storage import read, settled, shared_dir

__all__ = ["read", "settled", "shared_dir"]

#: Bytes of text that a Python worker handles at once; arrays of a few times eight bytes each are made of it.
SLICE_BYTES = 2 << 20


def unused(df: DataFrame, *wanted: str) -> list[str]:
    """Return names like those wanted that no column of a table has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.MapType, T.VariantType)) or isinstance(kind, T.ArrayType) and _has_map(kind.elementType)


def row_hash(df: DataFrame) -> Column:
    """Return a hash of all columns of a table; those that hold maps, which Spark doesn't hash, count as their JSON."""
    own = [(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]
    return F.xxhash64(*[F.to_json(F.struct(c.alias("c"))) if _has_map(kind) else c for c, kind in own])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Return the UTF-8 bytes of a string column end to end, and n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each has at most ``size`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(_POWERS, default=0)
    if size < n:
        size = 1 << max(16, int(n - 1).bit_length())
        _POWERS.clear()
        up, down = np.full(size, _BASE), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _POWERS[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[size]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes whose prefix sums are held at once.
_STEP = 1 << 20
_LENGTH = np.uint64(0xD6E8FEB86659FD93)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Return a 64-bit hash of values[start:end] for each span; equal spans get equal hashes wherever they lie."""
    up, down = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    out = (sums[ends] - sums[starts]) * down[starts]
    return mix(out + (ends - starts).astype(np.uint64) * _LENGTH)


def byte_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Return a 64-bit hash of raw[start:end] for each span of bytes; spans are in order and don't overlap.

    It is that of :func:`span_hashes`, made in steps, so that a long text takes
    no more memory for it than a short one.
    """
    up, down = _powers(_STEP + 1)
    out = np.zeros(len(starts), np.uint64)
    for low in range(0, len(raw), _STEP):
        high = min(low + _STEP, len(raw))
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTE[raw[low:high]] * up[: high - low], out=sums[1:])
        some = slice(int(np.searchsorted(ends, low, "right")), int(np.searchsorted(starts, high, "left")))
        first, last = starts[some], ends[some]
        part = sums[np.minimum(last, high) - low] - sums[np.maximum(first, low) - low]
        scale = down[np.maximum(first - low, 0)]
        if len(first) and first[0] < low:  # a span that began in an earlier step
            scale[0] = pow(int(_BASE), low - int(first[0]), 2**64)
        out[some] += part * scale
    return mix(out + (ends - starts).astype(np.uint64) * _LENGTH)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True


def lowered(raw: np.ndarray) -> np.ndarray:
    """Return bytes in lower case, of ASCII and Latin-1 letters; lengths stay."""
    low = _LOWER[raw]
    if len(raw) > 1:
        upper = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        low[1:][upper] += 32
    return low


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Return starts, ends and hashes of all words, and the n + 1 offsets of each text's words.

    A word is a longest run of ASCII letters, digits and non-ASCII bytes within
    one text; its hash ignores case.
    """
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = _WORD[raw]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(raw))])
    cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]  # words that run on into the next text
    if len(cuts):
        starts, ends = np.sort(np.r_[starts, cuts]), np.sort(np.r_[ends, cuts])
    return starts, ends, byte_hashes(lowered(raw), starts, ends), np.searchsorted(starts, offsets)


#: Rows in which a task looks for equal keys before any is shuffled: 40 MB.
GATHERED = 1 << 20
MARKS = "key long, doc_id long, version long, first int, last int, sure boolean"
_MARKED = ["key", "doc_id", "version", "first", "last"]
Rows = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _joined(rows: Rows) -> Rows:
    """Return rows, their keys replaced, with ranges that overlap or touch in one document made one."""
    order = np.lexsort((rows[3], rows[2], rows[1]))
    _, doc, version, first, last = (x[order] for x in rows)
    new = np.r_[True, (doc[1:] != doc[:-1]) | (version[1:] != version[:-1])]
    end = last.astype(np.int64) + (np.cumsum(new) << 32)  # the greatest end so far, in each document by itself
    reach = np.maximum.accumulate(end)
    cut = np.flatnonzero(np.r_[True, first[1:] > (reach[:-1] & 0xFFFFFFFF) + 1] | new)
    doc, version, first = doc[cut], version[cut], first[cut]
    last = (reach[np.r_[cut[1:], len(reach)] - 1] & 0xFFFFFFFF).astype(np.int32)
    spread = mix(doc.view(np.uint64) ^ mix(version.view(np.uint64)) ^ first.astype(np.uint64)).view(np.int64)
    return spread, doc, version, first, last


def _marked(rows: Rows, everyone: bool) -> Iterator[pa.RecordBatch]:
    """Yield one row for each key, and those already sure to have an equal (or an earlier equal) key, whose ranges are joined."""
    order = np.lexsort((rows[3], rows[2], rows[1], rows[0]))
    rows = tuple(x[order] for x in rows)
    key = rows[0]
    head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    group = np.repeat(head, np.diff(np.r_[head, len(key)]))
    tied = (rows[1] == rows[1][group]) & (rows[2] == rows[2][group]) & (rows[3] == rows[3][group])  # a row that comes twice is one
    other = np.zeros(len(key), bool)
    other[group[~tied]] = True  # heads of groups with another member
    known = other[group] if everyone else ~tied
    for sure, part in ((False, tuple(x[head] for x in rows)), (True, _joined(tuple(x[known] for x in rows)) if known.any() else None)):
        if part is not None:
            yield pa.RecordBatch.from_arrays([*map(pa.array, part), pa.array(np.full(len(part[0]), sure))], names=[*_MARKED, "sure"])


def marked(rows: Iterator[Rows], everyone: bool, size: int = GATHERED) -> Iterator[pa.RecordBatch]:
    """Look for equal keys among up to ``size`` rows, or a few more, at a time, before they are shuffled.

    So of a key that a third of all rows have, one row travels for each so many
    rows; what is sure already travels under keys of its own, by document.
    """
    held: list[Rows] = []
    for part in rows:
        held.append(part)
        if sum(len(h[0]) for h in held) >= size:
            yield from _marked(tuple(np.concatenate(x) for x in zip(*held, strict=True)), everyone)
            held = []
    if held and sum(len(h[0]) for h in held):
        yield from _marked(tuple(np.concatenate(x) for x in zip(*held, strict=True)), everyone)


def again(marks: DataFrame, everyone: bool) -> DataFrame:
    """Return ``(doc_id, version, spans)``: the ranges, ``first`` to ``last``, whose key has an earlier occurrence, or (``everyone``) another one.

    Earlier is by document key, version and place. A row that comes twice isn't
    another occurrence.
    """
    if everyone:
        same = Window.partitionBy("key", "sure")
        found = marks.withColumn("n", F.count(F.lit(1)).over(same)).withColumn("other", F.col("n") > 1)
    else:
        found = marks.withColumn("other", F.rank().over(Window.partitionBy("key", "sure").orderBy("doc_id", "version", "first")) > 1)
    return found.where("sure or other").groupBy("doc_id", "version").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("spans"))
