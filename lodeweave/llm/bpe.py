"""BPE encoding by tree concatenation, and decoding."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Splits text before the merges of the rank files; merges never cross its pieces.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of unsplit text that are encoded at once; longer pieces are halved.
LEAF = 256
#: Bytes of a text above which its parts are encoded by several tasks.
SEGMENT = 1 << 20

_LOADED: dict[bytes, Bpe] = {}


class Bpe:
    """A vocabulary of byte sequences with ranks; the pair of least rank merges first."""

    def __init__(self, data: bytes, pattern: str = PATTERN):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.long = re.compile(rf"\S{{{LEAF},}}|\s{{{LEAF},}}")
        self.bytes = {rank: token for token, rank in ranks.items()}

    def leaf(self, data: bytes) -> list[int]:
        """Encode bytes that no pattern splits, by merging directly."""
        return self.encoding._core_bpe.encode_single_piece(data)

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Return the encoding of two encoded halves of unsplit bytes, put together.

        The last tokens of the left and the first of the right are encoded anew,
        twice as many each time, until the new tokens begin with the first and
        end with the last token of that window. Merges by rank give a sequence if
        and only if they give each pair of neighbours in it; within the window
        they do, and outside, with the tokens that agree, they did in the halves.
        """
        if not left or not right:
            return left or right
        k = 1
        while True:
            k *= 2
            lo, hi = max(0, len(left) - k), min(len(right), k)
            window = left[lo:] + right[:hi]
            data = b"".join([self.bytes[t] for t in window])
            again = self.leaf(data) if len(data) <= 8 * LEAF else self.halves(data)
            if (lo == 0 or again[0] == left[lo]) and (hi == len(right) or again[-1] == right[hi - 1]):
                return left[:lo] + again + right[hi:]

    def concatenate(self, parts: list[list[int]]) -> list[int]:
        """Join encoded neighbours two by two until one is left."""
        while len(parts) > 1:
            parts = [self.join(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def halves(self, data: bytes) -> list[int]:
        """Encode bytes that no pattern splits: leaves first, then joins up the tree."""
        if len(data) <= LEAF:
            return self.leaf(data) if data else []
        count = 1 << (-(-len(data) // LEAF) - 1).bit_length()
        size = -(-len(data) // count)
        return self.concatenate([self.leaf(data[i : i + size]) for i in range(0, len(data), size)])

    def encode(self, text: str) -> np.ndarray:
        """Encode a text."""
        if not self.long.search(text):
            return np.asarray(self.encoding.encode_ordinary(text), np.int32)
        out: list[int] = []
        for piece in self.pattern.finditer(text):
            data = piece[0].encode()
            out += self.leaf(data) if len(data) <= LEAF else self.halves(data)
        return np.asarray(out, np.int32)

    def parts(self, text: str, size: int = SEGMENT) -> Iterator[tuple[int, bytes, bool]]:
        """Cut a text into parts to encode apart: ``(piece, bytes, split)``.

        Parts are whole pieces of the pattern together, up to ``size`` bytes, with
        ``split`` true; a longer piece is cut into equal parts that share its
        number, with ``split`` false, to be joined up the tree.
        """
        number, held, total = 0, [], 0
        for piece in self.pattern.finditer(text):
            data = piece[0].encode()
            if held and total + len(data) > size:
                yield number, b"".join(held), True
                number, held, total = number + 1, [], 0
            if len(data) > size:
                count = 1 << (-(-len(data) // size) - 1).bit_length()
                step = -(-len(data) // count)
                for i in range(0, len(data), step):
                    yield number, data[i : i + step], False
                number += 1
            else:
                held.append(data)
                total += len(data)
        if held:
            yield number, b"".join(held), True

    def decode(self, tokens: np.ndarray) -> str:
        """Return the text of tokens; bytes that aren't UTF-8 become U+FFFD."""
        return self.encoding.decode_bytes(tokens.tolist()).decode("utf-8", "replace")


def loaded(data: bytes) -> Bpe:
    """Return the vocabulary of a rank file's bytes; a worker builds it once."""
    key = hashlib.sha256(data).digest()
    if key not in _LOADED:
        _LOADED[key] = Bpe(data)
    return _LOADED[key]


def _lists(tokens: list[np.ndarray | None]) -> pa.Array:
    bounds = np.r_[0, np.cumsum([0 if t is None else len(t) for t in tokens])].astype(np.int32)
    flat = np.concatenate([t for t in tokens if t is not None] or [np.empty(0, np.int32)])
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat, pa.int32()), mask=pa.array([t is None for t in tokens]))


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, segment: int = SEGMENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Return ``(doc_id, n_tokens, tokens)`` for each row.

    The driver reads the rank file, whose bytes travel with the tasks. Texts up
    to ``segment`` bytes are encoded where they lie, without a shuffle. Longer
    ones are cut into parts at pieces of the pattern, or within a piece that is
    itself longer; parts are spread over tasks, encoded, and brought together by
    document, where cut pieces are joined up the tree. Within a task unsplit
    pieces over 256 bytes take the same way, so no text takes quadratic time.

    A null text has null tokens, an empty one none; a null key stays null;
    repeated rows come as often as they did; an empty table gives an empty
    result; other columns don't matter.
    """
    with open(vocabulary, "rb") as f:
        data = f.read()
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    schema = "doc_id long, n_tokens int, tokens array<int>"

    def result(keys: pa.Array, tokens: list[np.ndarray | None]) -> pa.RecordBatch:
        counts = pa.array([None if t is None else len(t) for t in tokens], pa.int32())
        return pa.RecordBatch.from_arrays([keys, counts, _lists(tokens)], names=["doc_id", "n_tokens", "tokens"])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(data)
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                yield result(batch.column(0), [None if t is None else bpe.encode(t) for t in batch.column(1).to_pylist()])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(data)
        for batch in batches:
            for i in range(batch.num_rows):
                for k, (piece, part, split) in enumerate(bpe.parts(batch.column(2)[i].as_py(), segment)):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([k], pa.int32()), pa.array([piece], pa.int32()), pa.array([split]), pa.array([part])], names=["doc_id", "version", "part", "piece", "split", "data"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(data)
        for batch in batches:
            tokens = [bpe.encode(d.decode()) if s else np.asarray(bpe.halves(d), np.int32) for s, d in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], _lists(tokens)], names=["doc_id", "version", "part", "piece", "split", "tokens"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(data)
        for batch in batches:
            for i in range(batch.num_rows):
                members = batch.column(1)[i].values
                numbers = members.field("part").to_numpy()
                copies = int((numbers == 0).sum())  # of rows that come twice
                by: dict[int, list[list[int]]] = {}
                for at in np.unique(numbers, return_index=True)[1].tolist():
                    m = members[at].as_py()
                    by.setdefault(m["piece"], []).append(m["tokens"])
                joined = np.asarray([t for piece in sorted(by) for t in bpe.concatenate(by[piece])], np.int32)
                for _ in range(copies):
                    yield result(batch.column(0).slice(i, 1), [joined])

    long = rows.where(size > segment).select("doc_id", F.xxhash64("text").alias("version"), "text")
    spread = long.mapInArrow(cut, "doc_id long, version long, part int, piece int, split boolean, data binary").repartition("doc_id", "version", "part")
    encoded = spread.mapInArrow(parts, "doc_id long, version long, part int, piece int, split boolean, tokens array<int>")
    gathered = encoded.groupBy("doc_id", "version").agg(F.collect_list(F.struct("part", "piece", "tokens")).alias("parts")).select("doc_id", "parts")
    return rows.where(size <= segment).mapInArrow(short, schema).unionByName(gathered.mapInArrow(whole, schema))


def decode(tokens: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Return the rows of :func:`encode` with their ``text``; null tokens have a null text."""
    with open(vocabulary, "rb") as f:
        data = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(data)
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                lists = batch.column(2)
                texts = [bpe.decode(v.values.to_numpy()) if v.is_valid else None for v in lists]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "tokens", "text"])

    return tokens.select("doc_id", "n_tokens", "tokens").mapInArrow(run, "doc_id long, n_tokens int, tokens array<int>, text string")
