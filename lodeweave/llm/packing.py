"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Permitted sequence lengths, in tokens of a byte-level vocabulary (one byte each).
CAPACITIES = (2048, 4096, 8192, 16384)
#: What a sequence costs besides its length, in tokens: optimiser and launch overhead of one more row.
OVERHEAD = 64
#: Pieces that one task packs together; waste comes from each task's last bins, so thousands are plenty.
GROUP = 50_000

SCHEMA = T.StructType([
    T.StructField("bin_id", T.StringType(), False),
    T.StructField("capacity", T.IntegerType(), False),
    T.StructField("used", T.IntegerType(), False),
    T.StructField("doc_ids", T.ArrayType(T.LongType()), False),
    T.StructField("starts", T.ArrayType(T.LongType()), False),
    T.StructField("lengths", T.ArrayType(T.IntegerType()), False),
])


def _cost(capacity: int, overhead: int) -> int:
    return capacity + overhead


def _downsize(used: int, capacities: tuple[int, ...]) -> int:
    return capacities[bisect_left(capacities, used)]


def _best_fit(lengths: list[int], opening: int, capacities: tuple[int, ...]) -> tuple[list[list[int]], list[int]]:
    """Place falling lengths, each in the open bin that it fills best; new bins have ``opening``, or the least that holds the piece."""
    bins: list[list[int]] = []
    free: list[int] = []
    rooms: dict[int, list[int]] = {}
    known: list[int] = []  # sorted room sizes for which a bin is open
    for i, n in enumerate(lengths):
        at = bisect_left(known, n)
        if at < len(known):
            room = known[at]
            stack = rooms[room]
            b = stack.pop()
            if not stack:
                known.pop(at)
        else:
            b, room = len(bins), max(opening, _downsize(n, capacities))
            bins.append([])
            free.append(0)
        bins[b].append(i)
        left = room - n
        free[b] = left
        if left > 0:
            stack = rooms.setdefault(left, [])
            if not stack:
                insort(known, left)
            stack.append(b)
    return bins, free


def _filled(room: int, known: list[int], count: dict[int, int]) -> list[int]:
    """Return lengths that fill a room, always the greatest that fits of those left; nothing is taken."""
    taken: list[int] = []
    at = bisect_right(known, room)
    while at and room >= known[0]:
        n = known[at - 1]
        times = min(room // n, count[n])
        taken += [n] * times
        room -= times * n
        at = min(at - 1, bisect_right(known, room))
    return taken


def _opened(falling: list[int], capacities: tuple[int, ...], overhead: int) -> list[list[int]]:
    """Pack falling lengths bin by bin, choosing for each bin the size at which it opens.

    A bin is opened for the greatest length that is left. For each size that
    holds it, what would fill it of all that is left is found, and the size that
    it then needs; the one of least cost for each token in it is opened.
    """
    places: dict[int, list[int]] = {}
    for i in range(len(falling) - 1, -1, -1):
        places.setdefault(falling[i], []).append(i)
    count = {n: len(p) for n, p in places.items()}
    known = sorted(count)
    out = []

    def drop(x: int) -> None:
        count[x] -= 1
        if not count[x]:
            known.pop(bisect_left(known, x))

    while known:
        n = known[-1]
        drop(n)
        best: tuple[int, int, list[int]] | None = None
        for c in capacities[bisect_left(capacities, n) :]:
            fill = _filled(c - n, known, count)
            used = n + sum(fill)
            cost = _cost(_downsize(used, capacities), overhead)
            if best is None or cost * best[1] < best[0] * used:
                best = cost, used, fill
        out.append([n, *best[2]])
        for x in best[2]:
            drop(x)
    return [[places[x].pop() for x in b] for b in out]


def pack_lengths(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> list[tuple[int, list[int]]]:
    """Pack lengths, none over the largest capacity; return ``(capacity, indices)`` for each bin.

    The permitted lengths are optimised jointly: each bin opens at the size that
    costs least for what it can hold of all that is left (:func:`_opened`). For
    comparison, best fit by falling length runs once for each size, at which all
    its bins open. Each bin is downsized to the least capacity that holds its
    contents, and the packing of least total cost (lengths plus an overhead a
    bin) is kept; of equal ones the first.
    """
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    falling = [lengths[i] for i in order]
    best: tuple[int, list[tuple[int, list[int]]]] | None = None
    for bins in (_opened(falling, capacities, overhead), *(_best_fit(falling, opening, capacities)[0] for opening in capacities)):
        sized = [(_downsize(sum(falling[i] for i in b), capacities), [order[i] for i in b]) for b in bins]
        total = sum(_cost(c, overhead) for c, _ in sized)
        if best is None or total < best[0]:
            best = total, sized
    return best[1] if best else []


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, group: int = GROUP, text: str = "text", key: str = "doc_id", size: str | None = None) -> DataFrame:
    """Pack whole documents into training sequences of several permitted lengths.

    A document longer than the largest capacity is cut into pieces of that
    length, of which the last is shorter. Only keys and lengths move: pieces are
    spread by hash over as many groups as their number asks for (``group`` pieces
    each), and each group is packed by itself with :func:`pack_lengths`.

    Returns a row for each sequence: ``bin_id``, ``capacity``, ``used`` tokens,
    and the ``doc_ids``, ``starts`` and ``lengths`` of its pieces in order.
    Lengths are those of texts in a byte-level vocabulary, a token a byte, or, if
    ``size`` names a column (as ``n_tokens`` of encoded documents), what it holds.

    Null and empty texts have no tokens and are in no sequence; a null key is
    packed as a null; keys must be integers. Repeated rows are packed as often as
    they come; equal lengths are taken in the order of key and start. A text of
    any length is cut into pieces by its size alone. An empty table gives no
    sequence; other columns don't matter. ``group`` bounds what a task holds: best
    fit is over all pieces below it, and within groups above.
    """
    capacities = tuple(sorted(capacities))
    largest = capacities[-1]
    length = F.octet_length(F.col(text)) if size is None else F.col(size)
    sizes = docs.select(F.col(key).cast("long").alias("doc_id"), length.cast("long").alias("n")).where("n > 0")
    pieces = sizes.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(largest).cast("long"))).alias("start"), "n")
    pieces = pieces.select("doc_id", "start", F.least(F.lit(largest), F.col("n") - F.col("start")).cast("int").alias("length"))
    total = sizes.agg(F.coalesce(F.sum(F.ceil(F.col("n") / largest)), F.lit(0)).alias("pieces")).first()["pieces"]
    groups = max(1, math.ceil(total / group))
    grouped = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "start"), F.lit(groups)).cast("int"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "start", "length"], na_position="first", ignore_index=True)
        part, ids = int(frame["part"].iloc[0]), [None if pd.isna(x) else int(x) for x in frame["doc_id"].astype("Int64")]
        starts, lengths = frame["start"].tolist(), frame["length"].tolist()
        rows = [
            (f"{part}-{k}", c, sum(lengths[i] for i in b), [ids[i] for i in b], [starts[i] for i in b], [lengths[i] for i in b])
            for k, (c, b) in enumerate(pack_lengths(lengths, capacities, overhead))
        ]
        return pd.DataFrame(rows, columns=SCHEMA.names)

    return grouped.groupBy("part").applyInPandas(run, SCHEMA)
