"""Nearest neighbours by randomly rotated one-bit codes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.storage import Rounds

from .shared import settled

K = 10
#: Vectors in a block, at most: what is compared with what in one step.
BLOCK = 4096
#: Cells of the coarse division, at most; centres, radii and sizes of cells are what the driver and each task hold of the index.
MAX_CELLS = 1024
#: Vectors, of least hash, to which the cells' centres are fitted, at most. All vectors are indexed, whatever this is.
FIT_ROWS = 65_536
#: Bytes, whatever the vectors' length: of a block; of the centres, which the driver holds; of the vectors to which one task fits them; of the blocks that a worker holds at once.
BLOCK_BYTES, CENTRE_BYTES, FIT_BYTES, SHARD_BYTES = 16 << 20, 4 << 20, 32 << 20, 64 << 20
#: Partitions in which blocks and queries meet, at most.
MAX_TASKS = 10_000
ROUNDS = 4
#: Queries are those rows whose key is divisible by this.
EVERY = 20
#: Standard deviations of the estimate that its bounds are wide.
WIDTH = 1.9
_SEED = 7


@lru_cache(maxsize=1)
def rotation(d: int) -> np.ndarray:
    """Return the random rotation of ``d`` dimensions, the same on all workers."""
    q, r = np.linalg.qr(np.random.default_rng(_SEED).standard_normal((d, d)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def coded(vectors: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Return packed sign bits of the rotated residuals, the residuals' lengths and the codes' inner products with their directions."""
    d = vectors.shape[1]
    residual = vectors - centre
    length = np.linalg.norm(residual, axis=1)
    turned = residual @ rotation(d).T / np.maximum(length, 1e-12)[:, None]
    return np.packbits(turned > 0, axis=1), length, np.abs(turned).sum(axis=1) / math.sqrt(d)


def nearest(queries: np.ndarray, limit: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, bits: np.ndarray, length: np.ndarray, match: np.ndarray, centre: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Yield (query numbers, ids, squared distances) of each query's k nearest vectors of a block, no farther than its limit.

    The inner product of a residual's direction with a query is estimated from
    its code alone; the estimate's error has a known spread, so each distance has
    a lower and an upper bound. Vectors whose lower bound is beyond the k-th
    upper bound, or the limit, are passed over; the others' distances are found
    exactly.
    """
    d = vectors.shape[1]
    signs = (np.unpackbits(bits, axis=1)[:, :d].astype(np.float32) * 2 - 1) / np.float32(math.sqrt(d))
    turn, safe = rotation(d), np.maximum(match, 1e-6)
    spread = np.sqrt(np.maximum(1 - safe**2, 0)) / safe / math.sqrt(max(d - 1, 1))
    for start in range(0, len(queries), 256):
        q = queries[start : start + 256]
        residual = q - centre
        away = np.linalg.norm(residual, axis=1)
        product = (residual @ turn.T) @ signs.T / safe  # |residual| times the estimated cosine
        guess = length**2 + (away**2)[:, None] - 2 * length * product
        margin = 2 * WIDTH * length * spread * away[:, None] + 1e-6
        same = own[start : start + 256, None] == ids[None, :]
        upper = guess + margin
        upper[same] = np.inf
        bound = limit[start : start + 256].copy()
        if len(ids) > k:
            bound = np.minimum(bound, np.partition(upper, k, axis=1)[:, k])
        wanted = (guess - margin <= bound[:, None]) & ~same
        rows, columns = np.nonzero(wanted)
        exact = np.empty(len(rows), np.float32)
        step = max(1, (1 << 21) // d)
        for a in range(0, len(rows), step):
            part = slice(a, a + step)
            diff = q[rows[part]] - vectors[columns[part]]
            exact[part] = np.einsum("ij,ij->i", diff, diff)
        order = np.lexsort((ids[columns], exact, rows))
        rows, columns, exact = rows[order], columns[order], exact[order]
        first = np.searchsorted(rows, np.arange(len(q)))
        keep = np.arange(len(rows)) - first[rows] < k
        yield rows[keep] + start, ids[columns[keep]], exact[keep]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.float32)


def _unit(vectors: DataFrame, key: str, embedding: str) -> tuple[DataFrame, int]:
    """Return ``(id, v)``, one unit vector for each key, of the length that most have, and that length."""
    good = vectors.select(F.col(key).cast("long").alias("id"), F.col(embedding).cast("array<float>").alias("v")).where("id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = float('infinity')) and exists(v, x -> x <> 0)")
    sizes = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return good.limit(0), 1
    one = good.where(F.size("v") == sizes["d"]).groupBy("id").agg(F.min("v").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1)).astype(np.float64)
            x /= np.abs(x).max(axis=1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.astype(np.float32).ravel()), x.shape[1]).cast(pa.list_(pa.float32()))], names=["id", "v"])

    return one.mapInArrow(run, "id long, v array<float>"), sizes["d"]


def _closest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d2 = (x**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * x @ centres.T
    cell = d2.argmin(axis=1)
    return cell, np.linalg.norm(x - centres[cell], axis=1)


def fitted(sample: np.ndarray, count: int) -> np.ndarray:
    """Return cell centres: the sample's first rows to begin with, then some rounds of means."""
    centres = sample[:count].copy()
    for _ in range(ROUNDS):
        cell = np.concatenate([_closest(sample[i : i + 4096], centres)[0] for i in range(0, len(sample), 4096)])
        order = np.argsort(cell, kind="stable")
        own, first = np.unique(cell[order], return_index=True)
        means = np.add.reduceat(sample[order].astype(np.float64), first) / np.diff(np.r_[first, len(order)])[:, None]
        centres[own] = means
    return centres


def _chained(centres: np.ndarray) -> np.ndarray:
    """Return centres in an order in which each is followed by the nearest of those left."""
    order, left = [0], np.arange(1, len(centres))
    while len(left):
        i = int(((centres[left] - centres[order[-1]]) ** 2).sum(axis=1).argmin())
        order.append(int(left[i]))
        left = np.delete(left, i)
    return centres[order]


def _centres(unit: DataFrame, n: int, d: int, rows: int, count: int) -> np.ndarray:
    """Return cell centres, fitted by one task to ``rows`` rows of least hash; the driver gets only them."""
    hashed = unit.withColumn("h", F.xxhash64("id"))
    share = (rows + 8 * math.sqrt(rows) + 64) / n
    if share < 1:  # little more than what is wanted goes to that task
        hashed = hashed.where(F.col("h") <= int(share * 2**64) - 2**63)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = [_matrix(batch.column(0)) for batch in batches if batch.num_rows]
        if sample:
            x = _chained(fitted(np.concatenate(sample), count))
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), d).cast(pa.list_(pa.float32()))], names=["v"])

    return _matrix(hashed.orderBy("h", "id").limit(rows).select("v").mapInArrow(fit, "v array<float>").toArrow()["v"].combine_chunks())


def _merged(far: np.ndarray, to: np.ndarray, rows: np.ndarray, ids: np.ndarray, distances: np.ndarray) -> np.ndarray:
    """Put candidates, in order of their rows and distances and as many a row as there are places at most, among the nearest so far; return the rows."""
    k = far.shape[1]
    some, first, size = np.unique(rows, return_index=True, return_counts=True)
    both, names = (np.concatenate([x[some], np.full((len(some), k), fill, x.dtype)], axis=1) for x, fill in ((far, np.inf), (to, 0)))
    at = np.repeat(np.arange(len(some)), size), k + np.arange(len(rows)) - np.repeat(first, size)
    both[at], names[at] = distances, ids
    order = np.lexsort((names, both), axis=1)[:, :k]
    far[some], to[some] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)
    return some


_BLOCKS = "block int, cell int, ids binary, vectors binary, bits binary, length binary, matching binary, asks binary"


def neighbours(vectors: DataFrame, k: int = K, block: int = BLOCK, max_cells: int = MAX_CELLS, fit_rows: int = FIT_ROWS, every: int = EVERY, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Return ``(vec_id, neighbour_id, rank, similarity)``: the ``k`` nearest others, by cosine, of each query.

    Queries are the rows whose key is divisible by ``every`` (1 for all rows);
    they are held against all rows. Rows are divided into at most ``max_cells``
    cells, whose centres are fitted to at most ``fit_rows`` rows of least hash,
    and cells into blocks of about ``block`` rows, with one-bit codes of their
    residuals. More cells make blocks tighter, more rows to fit to make centres
    truer; neither changes which rows are indexed, which is all of them.

    A query is first held against its own block; the k-th distance found there
    bounds what can still matter, and it goes on only to cells that can hold
    something nearer, by the triangle inequality on their centre and radius. So
    nothing is missed but by the codes' bounds, at ``WIDTH`` standard deviations
    (tests measure a recall of 0.95 against brute force). Where vectors have no
    clusters, all blocks are visited. Queries travel once for each shard of
    blocks (``SHARD_BYTES``), which a worker holds while they pass by it. One
    task fits the centres, to ``FIT_BYTES`` at most, and the driver gets those,
    ``CENTRE_BYTES`` at most, and a row a cell: so neither's memory depends on
    the number of vectors or, up to some thousand elements, on their length.

    Null keys, null or empty vectors, vectors with a null, NaN or infinite
    element, zero vectors, and those of another length than most have no row and
    are nobody's neighbour; keys must be integers. Repeated rows count once; of
    several vectors with one key the least counts. Ties go to the smaller id;
    with fewer than ``k`` others all are returned. An empty table gives an empty
    result; other columns don't matter.
    """
    unit, d = _unit(vectors, key, embedding)
    rounds = Rounds(unit.sparkSession, "neighbours")
    unit = rounds.settle(unit)
    n = unit.count()
    schema = "vec_id long, neighbour_id long, distance float"
    if n == 0:
        return unit.select(F.col("id").alias("vec_id"), F.col("id").alias("neighbour_id"), F.lit(0).alias("rank"), F.lit(0.0).alias("similarity"))
    block = max(1, min(block, BLOCK_BYTES // (4 * d)))
    rows = max(1, min(fit_rows, n, FIT_BYTES // (4 * d)))
    centres = _centres(unit, n, d, rows, max(1, min(max_cells, rows, n // block, CENTRE_BYTES // (4 * d))))
    cells = len(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                cell, away = _closest(_matrix(part.column(1)), centres)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(away.astype(np.float32))], names=["id", "v", "cell", "away"])

    placed = rounds.settle(unit.mapInArrow(assign, "id long, v array<float>, cell int, away float"))
    rounds.forget(1)
    counts = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"), F.max("away").alias("radius"))
    found = {r.cell: (r.parts, r.radius) for r in counts.collect()}  # a row a cell, of which there are max_cells at most
    parts = np.array([found.get(c, (0, 0.0))[0] for c in range(cells)])
    radii = np.array([found.get(c, (0, 0.0))[1] for c in range(cells)], np.float32)
    ends = np.cumsum(parts)  # a cell's blocks have the numbers before this
    total, spread = int(ends[-1]), placed.sparkSession.sparkContext.defaultParallelism
    a_shard = max(1, min(SHARD_BYTES // (4 * d * block), total // (4 * spread)))
    shards = -(-total // a_shard)
    where = {name: F.element_at(F.array(*[F.lit(int(x)) for x in values]), F.col("cell") + 1) for name, values in (("parts", np.maximum(parts, 1)), ("first", ends - parts))}
    numbered = placed.withColumn("block", (F.pmod(F.xxhash64("id"), where["parts"]) + where["first"]).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        x, cell, ids = _matrix(table["v"].combine_chunks()), table["cell"][0].as_py(), table["id"].to_numpy()
        bits, length, match = coded(x, centres[cell])
        values = [table["block"][0].as_py(), cell, ids.tobytes(), x.tobytes(), bits.tobytes(), length.astype(np.float32).tobytes(), match.astype(np.float32).tobytes(), (ids % every == 0).tobytes()]
        types = [pa.int32(), pa.int32()] + [pa.binary()] * 6
        names = ["block", "cell", "ids", "vectors", "bits", "length", "matching", "asks"]
        return pa.table([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

    blocks = rounds.settle(numbered.select("block", "cell", "id", "v").groupBy("block").applyInArrow(build, _BLOCKS))
    rounds.forget(1)

    def opened(row: dict) -> tuple[np.ndarray, ...]:
        ids = np.frombuffer(row["ids"], np.int64)
        return np.frombuffer(row["vectors"], np.float32).reshape(-1, d), ids, np.frombuffer(row["bits"], np.uint8).reshape(len(ids), -1), np.frombuffer(row["length"], np.float32), np.frombuffer(row["matching"], np.float32), centres[row["cell"]]

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                asks = np.frombuffer(row["asks"], bool)
                x, ids, *codes = opened(row)
                own, names = x[asks], ids[asks]
                if not len(own):
                    continue
                got = list(nearest(own, np.full(len(own), np.inf, np.float32), names, x, ids, *codes, k))
                q, to, far = (np.concatenate([g[j] for g in got]) for j in range(3))
                limit = np.full(len(own), np.inf, np.float32)
                last = np.flatnonzero(np.r_[q[1:] != q[:-1], True]) if len(q) else np.empty(0, np.int64)
                enough = last[last - np.searchsorted(q, q[last]) == k - 1] if len(q) else last
                limit[q[enough]] = far[enough]
                lists = np.searchsorted(q, np.arange(len(own) + 1)).astype(np.int32)
                near = pa.ListArray.from_arrays(pa.array(lists), pa.StructArray.from_arrays([pa.array(to), pa.array(far)], names=["id", "distance"]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), row["block"], np.int32)), pa.array(names), pa.FixedSizeListArray.from_arrays(pa.array(own.ravel()), d).cast(pa.list_(pa.float32())), pa.array(limit), near], names=["block", "id", "v", "bound", "near"])

    own = settled(blocks.mapInArrow(inside, "block int, id long, v array<float>, bound float, near array<struct<id: long, distance: float>>"), "own")

    def onward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                x, limit, home, ids = _matrix(batch.column(2)), batch.column(3).to_numpy(), batch.column(0).to_numpy(), batch.column(1).to_numpy()
                away = np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * x @ centres.T, 0))
                may = (away - radii - 1e-3 <= np.sqrt(limit)[:, None]) & (parts > 0)
                for shard in range(shards):
                    low, high = np.searchsorted(ends, [shard * a_shard, min((shard + 1) * a_shard, total) - 1], "right")
                    rows = may[:, low : high + 1].any(axis=1) & ((home != shard) | (a_shard > 1))
                    if rows.any():
                        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *(pa.array([v[rows].tobytes()]) for v in (ids, x, limit, home))], names=["shard", "ids", "vectors", "limits", "homes"])

    sent = own.select("block", "id", "v", "bound").mapInArrow(onward, "shard int, ids binary, vectors binary, limits binary, homes binary")

    def held_against(row: dict, held: list[tuple]) -> pa.RecordBatch:
        ids, x, home = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], np.float32).reshape(-1, d), np.frombuffer(row["homes"], np.int32)
        limit, far, to = np.frombuffer(row["limits"], np.float32).copy(), np.full((len(ids), k), np.inf, np.float32), np.zeros((len(ids), k), np.int64)
        for name, cell, mine in held:
            away = np.linalg.norm(x - centres[cell], axis=1)
            rows = np.flatnonzero((away - radii[cell] - 1e-3 <= np.sqrt(limit)) & (home != name))
            if not len(rows):
                continue
            for q, other, distance in nearest(x[rows], limit[rows], ids[rows], *mine, k):
                near = distance <= limit[rows[q]]
                if near.any():
                    some = _merged(far, to, rows[q[near]], other[near], distance[near])
                    limit[some] = np.minimum(limit[some], far[some, k - 1])
        q, place = np.nonzero(far < np.inf)
        return pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(to[q, place]), pa.array(far[q, place])], names=["vec_id", "neighbour_id", "distance"])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["shard"] != shard:
                    shard, held = row["shard"], []
                if row["asks"]:
                    yield held_against(row, held)
                else:
                    held.append((row["block"], row["cell"], opened(row)))

    meeting = blocks.drop("asks").withColumn("shard", F.floor(F.col("block") / a_shard).cast("int")).withColumn("asks", F.lit(False)).unionByName(sent.withColumn("asks", F.lit(True)), allowMissingColumns=True)
    tasks = min(shards, MAX_TASKS)
    others = meeting.repartitionById(tasks, F.col("shard") % tasks).sortWithinPartitions("shard", "asks").mapInArrow(across, schema)
    first = own.select(F.col("id").alias("vec_id"), F.explode("near").alias("n")).select("vec_id", F.col("n.id").alias("neighbour_id"), F.col("n.distance").alias("distance"))
    order = Window.partitionBy("vec_id").orderBy("distance", "neighbour_id")
    ranked = first.unionByName(others).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("vec_id", "neighbour_id", "rank", F.round(1 - F.col("distance").cast("double") / 2, 6).alias("similarity"))
