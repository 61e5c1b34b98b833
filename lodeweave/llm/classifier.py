"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import slices, text_bytes, words

#: Labelled rows on which a model is fitted, at most: those with the least hash of their key.
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LEAST, L2 = 60, 4, 64, 0.15, 20, 1.0
#: Documents with a lower probability of good quality are rejected.
THRESHOLD = 0.5

FEATURES = (
    "log_bytes", "log_words", "log_lines", "mean_word", "long_words", "distinct_words", "root_distinct", "same_as_last",
    "upper", "digits", "blanks", "sentence_marks", "commas", "symbols", "other_marks", "non_ascii",
    "mean_line_words", "ended_lines", "bars", "repeated_pairs",
)

_CLASS = np.zeros(256, np.uint8)
for _code, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\r", ".!?", ",;:", "#$%&*+<=>@^_~\\", "\"'()-/[]`{}", "|"), 1):
    _CLASS[list(_chars.encode())] = _code
_CLASS[128:192] = 9
_CLASS[192:] = 10
_END = np.zeros(256, bool)
_END[list(b".!?\"')")] = True


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _distinct(keys: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Return the number of distinct keys of each owner."""
    if not len(keys):
        return np.zeros(n)
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    new = np.r_[True, (k[1:] != k[:-1]) | (o[1:] != o[:-1])]
    return np.bincount(o[new], minlength=n).astype(float)


def _kinds(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Return for each text how many bytes it has of each class, made in steps of a bounded number of bytes."""
    n = len(offsets) - 1
    table = np.zeros(n * 11)
    for low in range(0, len(raw), 1 << 20):
        high = min(low + (1 << 20), len(raw))
        which = np.repeat(np.arange(n), np.diff(np.clip(offsets, low, high)))
        table += np.bincount(which * 11 + _CLASS[raw[low:high]], minlength=n * 11)
    return table.reshape(n, 11)[:, 1:]


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Return the FEATURES of each text; an empty one has zeros."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    starts, ends, hashes, bounds = words(raw, offsets)
    count = np.diff(bounds).astype(float)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    per = np.maximum(count, 1)
    length = (ends - starts).astype(float)
    table = _kinds(raw, offsets)
    whole = np.maximum(size, 1)
    same = np.r_[False, (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])] if len(hashes) else np.zeros(0, bool)
    inner = np.flatnonzero(owner[1:] == owner[:-1])
    pairs = hashes[inner] * np.uint64(3) + hashes[inner + 1]
    distinct = _distinct(hashes, owner, n)
    breaks = np.flatnonzero(raw == 10)
    which = np.searchsorted(offsets, breaks, "right") - 1
    lines = np.bincount(which, minlength=n) + (size > 0)
    some = np.flatnonzero(size > 0)
    tails, line = np.r_[breaks, offsets[some + 1]] - 1, np.r_[which, some]  # the bytes that end lines, and their texts
    tails, line = tails[tails >= offsets[line]], line[tails >= offsets[line]]
    ended = np.bincount(line, weights=_END[raw[tails]].astype(float), minlength=n)
    columns = [
        np.log1p(size), np.log1p(count), np.log1p(lines), _sums(length, bounds) / per, _sums(length > 14, bounds) / per,
        distinct / per, distinct / np.sqrt(per), _sums(same, bounds) / per,
        table[:, 0] / whole, table[:, 1] / whole, table[:, 2] / whole, table[:, 3] / per, table[:, 4] / per, table[:, 5] / per,
        table[:, 6] / per, table[:, 9] / whole,
        count / np.maximum(lines, 1), ended / np.maximum(lines, 1), table[:, 7] / per, (np.maximum(count - 1, 0) - _distinct(pairs, owner[inner], n)) / np.maximum(count - 1, 1),
    ]
    return np.stack(columns, axis=1)


@dataclass(frozen=True)
class Forest:
    """Trees as arrays: node i of tree t tests ``feature`` against ``cut`` and goes on to 2 i + 1 or 2 i + 2; leaves hold ``value``."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Return the probability of each row; all rows step down each tree together."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += value[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Fit trees to labels 0 and 1 by second-order boosting on histograms of BINS quantile bins.

    Without rows the model gives 0.5 to all; with labels of one kind, nearly that label.
    """
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    rate = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(rate / (1 - rate)))
    if len(np.unique(y)) < 2:
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    m = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    offset = np.arange(m) * BINS
    score = np.full(len(y), base)
    out: tuple[list, list, list] = ([], [], [])
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)  # an inner node without a split sends all left
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            slot = ((node - first)[:, None] * (m * BINS) + offset + binned).ravel()
            shape = (width, m, BINS)
            hist = [np.bincount(slot, np.repeat(w, m), width * m * BINS).reshape(shape) for w in (g, h, np.ones(len(y)))]
            left = [np.cumsum(a, axis=2) for a in hist]
            right = [a[:, :, -1:] - a for a in left]
            gain = left[0] ** 2 / (left[1] + L2) + right[0] ** 2 / (right[1] + L2)
            gain[(left[2] < LEAST) | (right[2] < LEAST)] = -np.inf
            whole = left[0][:, :, -1:] ** 2 / (left[1][:, :, -1:] + L2)
            flat = (gain - whole).reshape(width, -1)
            best = flat.argmax(axis=1)
            at = first + np.arange(width)
            for k in np.flatnonzero(flat[np.arange(width), best] > 1e-9):
                j, b = divmod(int(best[k]), BINS)
                if b < len(cuts[j]):
                    feature[at[k]], cut[at[k]] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - inner
        value = -RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + L2)
        score += value[leaf]
        for part, new in zip(out, (feature, cut, value), strict=True):
            part.append(new)
    return Forest(*(np.stack(a) for a in out), base)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, text: str = "text", key: str = "doc_id", label: str = "quality") -> Forest:
    """Fit a model on the documents that labels name.

    Of the labels with a document key and a value, the ``rows`` keys of least
    hash are taken: the only bound, and the sample is the same whatever the
    partitions. It is small by that bound, so it's broadcast to pick the
    documents, and only their statistics come to the driver, a row a key: of
    documents with the same key those of the least statistics. Labels that
    contradict each other count as their rounded mean; labels without a document,
    or with a null, don't count.
    """
    named = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").alias("id")).agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("y"))
    taken = named.orderBy(F.xxhash64("id"), "id").limit(rows)
    found = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(taken), F.col("key") == F.col("id")).select("text", "y", F.xxhash64("id").alias("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = statistics(*text_bytes(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64())), batch.column(1), batch.column(2)], names=["x", "y", "id"])

    single = found.mapInArrow(run, "x array<double>, y int, id long").groupBy("id").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    got = single.select("x", "y").orderBy("y", "x").toArrow()  # in an order of its own, so sums come out alike
    x = np.array(got["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(x, got["y"].to_numpy().astype(float))


def _probabilities(model: Forest, texts: pa.Array) -> np.ndarray:
    raw, offsets = text_bytes(texts)
    return np.where(np.diff(offsets) > 0, model.score(statistics(raw, offsets)), 0.0)


def classify(docs: DataFrame, model: Forest, threshold: float = THRESHOLD, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Return ``(doc_id, quality_score, keep)`` for each row.

    One scan, no shuffle: each Arrow batch is turned to statistics and sent down
    the trees as arrays. Null and empty texts score 0 and aren't kept; a score at
    the threshold is kept; a null key stays null; repeated rows are scored alike;
    a text of any length is scored whole, and a worker holds it some fifteen
    times over; an empty table gives an empty result; other columns don't matter.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("quality_score", T.DoubleType()), T.StructField("keep", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            p = _probabilities(model, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(p >= threshold)], names=schema.names)

    return rows.mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Forest, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """Return the rows of ``docs``, all columns, that the model doesn't reject; see :func:`classify`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            p = _probabilities(model, batch.column(batch.schema.get_field_index(text)))
            yield batch.filter(pa.array(p >= threshold))

    return docs.mapInArrow(run, docs.schema)
