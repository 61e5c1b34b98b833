"""Near duplicates by SimHash, found with meet-in-the-middle ball hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import mix, row_hash, settled, slices, text_bytes, unused, words

#: Bits of a fingerprint, all of which are in blocks; a pair meets if it's within RADIUS in any block.
SIZE, BLOCKS, BITS = 384, 12, 32
#: Bits in which two blocks may differ. Every block emits all its variants within half of that: 33.
RADIUS = 2
#: Bits, of all SIZE, in which near duplicates may differ: 15 %, an angle of 26 degrees. All pairs up to
#: BLOCKS * (RADIUS + 1) - 1 = 35 bits meet; of those at 40, 45, 50 and 56 bits, 99.98, 99.4, 96 and 86 of 100 do.
DISTANCE = 56
#: Variants that are compared in one part: 12 MB packed.
PART = 2_000_000
#: Members of a bucket that are compared at once; larger buckets are cut into pairs of pieces, each compared by itself.
TILE = 1024
#: Pairs of codes that are compared at once: some 60 MB.
PAIRS = 250_000
#: Edges up to which one task finds components: 16 MB.
SMALL = 1_000_000

_WIDTH = SIZE // 64
_CODES = [f"c{k}" for k in range(_WIDTH)]
_PLANES = [np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64) for k in range(_WIDTH)]
_VARIANTS = BITS + 1
#: Terms whose signs are unpacked at once, and in how many parts of one a term's weight is rounded, so sums are exact.
_STEP, _UNIT = 8192, 16


def _signs(hashes: np.ndarray) -> np.ndarray:
    """Return each word hash's signs, packed as bits."""
    out = np.empty((len(hashes), _WIDTH), np.uint64)
    for low in range(0, len(hashes), 1 << 16):
        for k, plane in enumerate(_PLANES):
            out[low : low + (1 << 16), k] = mix(hashes[low : low + (1 << 16)] + plane)
    return out.view(np.uint8).reshape(len(hashes), SIZE // 8)


def fingerprints(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Return each text's fingerprint, as 64-bit values, and its number of words.

    A feature is a word without regard to case, weighted by the fourth root of
    its count. So the frequent words that all texts of a language share don't
    make texts alike that have nothing else in common. Weights are whole numbers
    of sixteenths: sums are exact, and equal texts have equal fingerprints
    whatever else is in the batch. Signs are held as bits, and unpacked for some
    thousand terms at once.
    """
    _, _, hashes, bounds = words(raw, offsets)
    n = len(offsets) - 1
    if not len(hashes):
        return np.zeros((n, _WIDTH), np.uint64), np.diff(bounds)
    vocabulary, index = np.unique(hashes, return_inverse=True)
    signs = _signs(vocabulary)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    terms, counts = np.unique(owner * len(vocabulary) + index, return_counts=True)
    owner, terms = np.divmod(terms, len(vocabulary))
    weights = np.rint(counts**0.25 * _UNIT).astype(np.float32)
    total = np.zeros((n, SIZE))
    for low in range(0, len(terms), _STEP):
        bits = np.unpackbits(signs[terms[low : low + _STEP]], axis=1, bitorder="little").astype(np.float32)
        own, weight = owner[low : low + _STEP], weights[low : low + _STEP]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        for a, b in zip(first, np.r_[first[1:], len(own)], strict=True):
            total[own[a]] += weight[a:b] @ bits[a:b]
    half = np.bincount(owner, weights, n)
    return np.packbits(2 * total > half[:, None], axis=1, bitorder="little").view(np.uint64), np.diff(bounds)


def fingerprint(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Return ``(doc_id, c0, c1, ...)`` for each row with a key and at least one word."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            codes, n = fingerprints(*text_bytes(batch.column(1)))
            some = n > 0
            columns = [batch.column(0).filter(pa.array(some)), *(pa.array(np.ascontiguousarray(codes[some, k]).view(np.int64)) for k in range(_WIDTH))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *_CODES])

    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in _CODES))


def blocks(codes: np.ndarray) -> np.ndarray:
    """Return the blocks of fingerprints as numbers."""
    return np.ascontiguousarray(codes).view(np.uint32).reshape(len(codes), BLOCKS)


def _collisions(codes: DataFrame) -> DataFrame:
    """Return ``(ids, block, bits, sides)``: codes, with the bit that each flips, that have a variant of a block in common.

    A variant differs from the block by one bit at most, half the radius. They
    are shuffled as packed arrays, those of a batch of codes for the same part in
    one row: 32 bits of the variant's hash, of which the part is a function as
    well, by how much its code's number is above that of the variant before, and
    which bit was flipped. Hashes of different variants may be equal; pairs are
    verified on whole codes.

    Two blocks that are within the radius have two variants or more in common;
    their pair counts in just one of these buckets, where the code of smaller id
    flips the lower bit or none (see :func:`near_pairs`). Buckets in which no pair
    counts, as those that equal blocks have in common but for the block itself,
    end here. Those of more than TILE members are cut into pairs of pieces, which
    leave the task PART members at a time.
    """
    flips = np.array([0, *(1 << i for i in range(BITS))], np.uint64)
    tags = np.arange(BLOCKS, dtype=np.uint64) << np.uint64(BITS)
    parts = max(1, math.ceil(codes.count() * _VARIANTS / PART))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            cuts = np.r_[0, np.flatnonzero(np.diff(ids) != 1) + 1, len(ids)]  # ids are numbered as written
            for lo, hi in ((i, min(i + 4096, b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True) for i in range(a, b, 4096)):
                own = blocks(np.stack([c.to_numpy()[lo:hi] for c in batch.columns[1:]], axis=1)).astype(np.uint64) | tags
                for block in range(BLOCKS):
                    hashes = mix((own[:, block, None] ^ flips).reshape(-1))
                    part = ((hashes >> np.uint64(32)) % np.uint64(parts)).astype(np.int64) * BLOCKS + block
                    order = np.argsort(part, kind="stable")
                    keys, part, code, bit = hashes[order].astype(np.uint32), part[order], order // _VARIANTS, (order % _VARIANTS).astype(np.uint8)
                    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                    ends = np.r_[first[1:], len(order)]
                    step = np.diff(code, prepend=0)
                    step[first] = code[first]
                    thin = np.maximum.reduceat(step, first) < 256
                    steps = [step[a:b].astype(np.uint8 if t else np.uint16).tobytes() for a, b, t in zip(first, ends, thin, strict=True)]
                    packed = [pa.array([x[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary()) for x in (keys, bit)]
                    yield pa.RecordBatch.from_arrays([pa.array(part[first]), pa.array(np.full(len(first), ids[lo])), *packed, pa.array(steps, pa.binary())], names=["part", "base", "keys", "bits", "steps"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        block = table["part"][0].as_py() % BLOCKS
        rows = table.select(["base", "keys", "bits", "steps"]).to_pydict()
        keys = np.concatenate([np.frombuffer(x, np.uint32) for x in rows["keys"]])
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        order = order[np.r_[same, False] | np.r_[False, same]]
        keys = keys[order]
        ids = np.concatenate([np.cumsum(np.frombuffer(s, np.uint8 if len(s) == len(b) else np.uint16), dtype=np.int64) + base for s, b, base in zip(rows["steps"], rows["bits"], rows["base"], strict=True)])[order]
        bit = np.concatenate([np.frombuffer(x, np.uint8) for x in rows["bits"]])[order].astype(np.int8)
        order = np.lexsort((ids, keys))
        keys, ids, bit = keys[order], ids[order], bit[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
        ends = np.r_[first[1:], len(keys)].astype(np.int64)
        group = np.repeat(np.arange(len(first)), ends - first)
        # a pair counts if the bit rises with the id, or is none twice: some do if the least bit before one is below its own
        down = (len(first) - group) * 64
        before = np.r_[64, (np.minimum.accumulate(down + bit) - down)[:-1]] if len(keys) else np.empty(0, np.int64)
        before[first] = 64
        kept = np.bincount(group, (before < bit) | ((before == 0) & (bit == 0)), len(first)) > 0

        def cut(at: np.ndarray, side: np.ndarray, sizes: list[int] | np.ndarray) -> pa.RecordBatch:
            bounds = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (ids[at], bit[at], side)]
            return pa.RecordBatch.from_arrays([lists[0], pa.array(np.full(len(sizes), block, np.int8)), *lists[1:]], names=["ids", "block", "bits", "sides"])

        small = kept & (ends - first <= TILE)
        at = np.flatnonzero(small[group])
        yield cut(at, np.zeros(len(at), np.int8), (ends - first)[small])
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b in zip(first[kept & ~small], ends[kept & ~small], strict=True):
            pieces = [np.arange(i, min(i + TILE, b)) for i in range(a, b, TILE)]
            for i, x in enumerate(pieces):
                for y in pieces[i:]:
                    held.append((x, np.zeros(len(x), np.int8)) if x is y else (np.r_[x, y], np.r_[np.full(len(x), 1, np.int8), np.full(len(y), 2, np.int8)]))
                    if len(held) * 2 * TILE >= PART:
                        yield cut(*map(np.concatenate, zip(*held, strict=True)), [len(h[0]) for h in held])
                        held = []
        if held:
            yield cut(*map(np.concatenate, zip(*held, strict=True)), [len(h[0]) for h in held])

    packed = codes.mapInArrow(emit, "part long, base long, keys binary, bits binary, steps binary")
    return packed.groupBy("part").applyInArrow(meet, "ids array<long>, block byte, bits array<byte>, sides array<byte>")


def _members(sets: DataFrame, codes: DataFrame) -> DataFrame:
    """Return ``(members)``: for each set of more than two codes these codes, each with its ``(block, bit, side)`` in every bucket that has just this set."""
    own = F.transform("buckets", lambda x: F.struct(x["block"].alias("block"), F.get(x["bits"], F.col("pos")).alias("bit"), F.get(x["sides"], F.col("pos")).alias("side")))
    each = sets.where("size(ids) > 2").select(F.xxhash64("ids").alias("set"), F.hash("ids").alias("twin"), "buckets", F.posexplode("ids").alias("pos", "id")).select("set", "twin", "id", own.alias("own"))
    return each.join(codes, "id").groupBy("set", "twin").agg(F.collect_list(F.struct("id", "own", *_CODES)).alias("members")).select("members")  # of at most 2 * TILE


def _couples(sets: DataFrame, codes: DataFrame, distance: int) -> DataFrame:
    """Return ``(id, root, links)`` as :func:`_verified` does, for sets of two codes, which most are: their distance is found by two joins."""
    packed = F.transform("buckets", lambda x: x["block"].cast("int") * 4096 + F.get(x["bits"], F.lit(0)).cast("int") * 64 + F.get(x["bits"], F.lit(1)).cast("int"))
    both = sets.where("size(ids) = 2").select(F.col("ids")[0].alias("a"), F.col("ids")[1].alias("b"), packed.alias("own"))
    named = lambda side: codes.select(F.col("id").alias(side), *[F.col(c).alias(f"{side}{k}") for k, c in enumerate(_CODES)])
    apart = sum((F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in range(_WIDTH)), F.lit(0))
    near = both.join(named("a"), "a").join(named("b"), "b").where(apart <= distance).select("a", "b", "own", *[f"{side}{k}" for side in "ab" for k in range(_WIDTH)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, own = batch.num_rows, batch.column(2)
            words = np.stack([np.concatenate([batch.column(3 + side * _WIDTH + k).to_numpy() for side in (0, 1)]) for k in range(_WIDTH)], axis=1).view(np.uint64)
            pair = np.repeat(np.arange(n), np.diff(own.offsets.to_numpy()))
            value = own.flatten().to_numpy()
            which, bit = np.stack([pair, pair + n], axis=1).ravel(), np.stack([value // 64 % 64, value % 64], axis=1).ravel()
            got = [x for x, _ in near_pairs(words, which, bit, np.zeros(len(bit), np.int8), np.repeat(value // 4096, 2), np.full(len(value), 2), distance)]
            some = pa.array(np.concatenate(got) if got else np.empty(0, np.int64))
            a, b = batch.column(0).take(some), batch.column(1).take(some)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]), pa.concat_arrays([a, a]), pa.array(np.ones(2 * len(some), np.int64))], names=["id", "root", "links"])

    return near.mapInArrow(run, "id long, root long, links long")


def _pairs(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yield places (a, b), a before b, of all pairs within buckets that lie end to end; a bounded number at once."""
    place = np.concatenate([np.arange(s) for s in sizes]) if len(sizes) else np.empty(0, np.int64)
    more = np.repeat(sizes, sizes) - 1 - place  # members after each
    total = np.cumsum(more)
    start = 0
    while start < len(more):
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + PAIRS, "right")))
        a = np.repeat(np.arange(start, stop), more[start:stop])
        first = np.cumsum(more[start:stop]) - more[start:stop]
        yield a, a + 1 + np.arange(len(a)) - np.repeat(first, more[start:stop])
        start = stop


def _labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Return for each thing the least one that it's connected with, by pairs or by the labels so far."""
    label = label.copy()
    while True:
        x, y = label[a], label[b]
        if np.array_equal(x, y):
            return label
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, further := label[label]):
            label = further


def near_pairs(codes: np.ndarray, which: np.ndarray, bit: np.ndarray, side: np.ndarray, block: np.ndarray, sizes: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yield near pairs, as places among ``codes``, that count in these buckets: each pair of codes counts in one bucket of all.

    That is the bucket of the first block in which the pair is within the
    radius, and there the one in which the code of smaller id flips the lower bit
    or both flip none. Buckets lie end to end, their members in order of id;
    ``which`` are the members' codes.
    """
    own = blocks(codes)
    flips = np.array([0, *(1 << i for i in range(BITS))], np.uint32)
    for a, b in _pairs(sizes):
        few = ((bit[a] < bit[b]) | ((bit[a] == 0) & (bit[b] == 0))) & ((side[a] != side[b]) | (side[a] == 0))
        a, b = a[few], b[few]
        x, y, where = which[a], which[b], block[a]
        true = (own[x, where] ^ flips[bit[a]]) == (own[y, where] ^ flips[bit[b]])
        x, y, where = x[true], y[true], where[true]
        near = np.bitwise_count(codes[x] ^ codes[y]).sum(axis=1) <= distance
        x, y, where = x[near], y[near], where[near]
        counts = (np.bitwise_count(own[x] ^ own[y]) <= RADIUS).argmax(axis=1) == where
        yield x[counts], y[counts]


def _verified(members: DataFrame, distance: int) -> DataFrame:
    """Return ``(id, root, links)`` for members of buckets that have near pairs: what chains of these connect, and how many each has."""

    def part(column: pa.ListArray) -> pa.RecordBatch:
        sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten()
        group = np.repeat(np.arange(len(sizes)), sizes)
        ids, own = flat.field(0).to_numpy(), flat.field(1)
        order = np.lexsort((ids, group))
        codes = np.stack([flat.field(k + 2).to_numpy()[order] for k in range(_WIDTH)], axis=1).view(np.uint64)
        ids, start = ids[order], own.offsets.to_numpy()[:-1][order] - own.offsets[0].as_py()
        first = np.cumsum(sizes) - sizes
        times = np.diff(own.offsets.to_numpy())[order][first] if len(sizes) else sizes  # buckets of each set
        blocked, bit, side = (own.flatten().field(k).to_numpy() for k in range(3))
        total = sizes * times
        within = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
        n = np.repeat(sizes, total)
        which = np.repeat(first, total) + within % np.maximum(n, 1)
        at = start[which] + within // np.maximum(n, 1)
        names, index = np.unique(ids, return_inverse=True)
        root, links = np.arange(len(names)), np.zeros(len(names), np.int64)
        for a, b in near_pairs(codes, which, bit[at], side[at], blocked[at], np.repeat(sizes, times), distance):  # counted as they come: there may be millions
            a, b = index[a], index[b]
            links += np.bincount(a, minlength=len(names)) + np.bincount(b, minlength=len(names))
            root = _labels(root, a, b)
        some = links > 0
        return pa.RecordBatch.from_arrays([pa.array(names[some], pa.int64()), pa.array(names[root[some]], pa.int64()), pa.array(links[some])], names=["id", "root", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, low = batch.column(0), 0
            held = np.diff(column.offsets.to_numpy())
            while low < len(column):
                high = max(low + 1, int(np.searchsorted(np.cumsum(held[low:]), 20_000, "right")) + low)
                yield part(column.slice(low, high - low))
                low = high

    return members.mapInArrow(run, "id long, root long, links long")


def _components_here(edges: DataFrame) -> DataFrame:
    """Find components by arrays, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.stack([c.to_numpy() for c in batch.columns]) for batch in batches]
        if parts:
            ids, index = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
            a, b = index.reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[_labels(np.arange(len(ids)), a, b)])], names=["id", "root"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "id long, root long")


def components(edges: DataFrame, what: str = "stars", small: int | None = None) -> DataFrame:
    """Return ``(id, root)``: each id of the edges with the least id that it's connected to.

    Edges are written once and counted. Up to ``small`` of them (``SMALL``) are
    found by one task. Otherwise large-star and small-star steps go by turns;
    each round's edges are written to the shared folder, and rounds end when they
    no longer change, after about the logarithm of the longest path.
    """
    now, before = settled(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), what), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if before is None and state[0] <= (SMALL if small is None else small):
            return _components_here(now)
        if state == before or not state[0]:
            break
        before = state
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(down, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))
        now = settled(small.where("a <> b").distinct(), what)
    roots = now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("root")))
    return roots.groupBy("id").agg(F.min("root").alias("root"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Return ``(doc_id, group_id, links)`` for each document that has near duplicates.

    ``group_id`` is the least key of the document's group, ``links`` the number
    of different fingerprints that are near its own (of all of its texts, where
    a key has several); copies with its own fingerprint aren't counted.

    Two documents are near duplicates if their 384-bit SimHashes differ in at
    most ``distance`` bits and, in one of twelve 32-bit blocks, in at most two.
    Up to 35 bits that is so of every pair; further on a few don't meet: of
    pairs at 40 bits one in 5,000, at 45 one in 170, at 50 one in 26, at 56 one
    in 7. Groups are what chains of such pairs connect.

    Equal fingerprints are one code from here on, whatever the number of copies.
    Each block of a code emits the 33 variants within one bit; two blocks within
    two bits have a variant in common. Variants are shuffled together; each set
    of codes that meets in one or more buckets is compared on whole fingerprints,
    which travel once for all of these. Every pair counts in
    one bucket, and what leaves a bucket is, for each member, what it's connected
    to and how many links it has: not pairs, so the result grows with the
    documents even where thousands are alike. No bucket is capped; large ones
    are compared in pieces.

    Keys must be integers. Texts without a word (null or empty) and rows without
    a key are nobody's duplicates. Ties don't arise: distances are whole numbers
    and the bound is inclusive. A repeated row, or another text with the same
    key, is one member of its group; a key whose texts are in several groups
    connects them. A text of any length is one fingerprint; a worker holds it and
    some eighty bytes a word. An empty table gives an empty result; other columns
    don't matter.
    """
    prints = settled(fingerprint(docs, text, key).distinct(), "simhash")
    codes = settled(prints.select(*_CODES).distinct().withColumn("id", F.monotonically_increasing_id()), "codes")  # numbered once, as it's written
    sets = settled(_collisions(codes.select("id", *_CODES)).groupBy("ids").agg(F.collect_list(F.struct("block", "bits", "sides")).alias("buckets")), "sets")
    near = settled(_verified(_members(sets, codes), distance).unionByName(_couples(sets, codes, distance)), "near")
    linked = components(near.select(F.col("id").alias("a"), F.col("root").alias("b")), "stars")
    counts = near.groupBy("id").agg(F.sum("links").alias("links"))
    found = codes.join(counts, "id", "left").join(linked, "id", "left").select(*_CODES, F.coalesce("root", "id").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    keyed = settled(prints.join(found, _CODES).groupBy("doc_id", "root").agg(F.sum("links").alias("links")), "placed")
    # keys whose texts have several codes connect these
    split = keyed.groupBy("doc_id").agg(F.min("root").alias("a"), F.collect_set("root").alias("roots")).where("size(roots) > 1").select("a", F.explode("roots").alias("b"))
    again = components(split, "keys").select(F.col("id").alias("root"), F.col("root").alias("top"))
    final = keyed.join(again, "root", "left").groupBy("doc_id", F.coalesce("top", "root").alias("root")).agg(F.sum("links").alias("links"))
    least = final.groupBy("root").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return final.join(least, "root").select("doc_id", "group_id", "links")


def _once(df: DataFrame, by: str, rank: str, hashed: str) -> DataFrame:
    """Return of rows with the same ``by`` the one of the least ``hashed``."""
    place = Window.partitionBy(by).orderBy(hashed)
    return df.withColumn(rank, F.row_number().over(place)).where(F.col(rank) == 1).drop(rank)


def dedup_documents(docs: DataFrame, distance: int = DISTANCE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Return the rows of ``docs``, all columns, of which one document of each group of near duplicates stays: that of the least key.

    Rows with a null key, and texts without a word, stay. Of rows with the same
    key one stays, with the least hash over its columns (maps count as JSON); so
    rows that come twice become one. Other columns may have any names and types.
    See :func:`near_duplicates`.
    """
    gone_key, place, hashed = unused(docs, "gone", "place", "hashed")
    gone = near_duplicates(docs, distance, text, key).where("doc_id <> group_id").select(F.col("doc_id").alias(gone_key))
    kept = docs.where(F.col(key).isNotNull()).withColumn(hashed, row_hash(docs)).join(gone, F.col(key).cast("long") == F.col(gone_key), "left_anti")
    return _once(kept, key, place, hashed).drop(hashed).unionByName(docs.where(F.col(key).isNull()))


def dedup_texts(docs: DataFrame, distance: int = DISTANCE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Return the rows of ``docs`` as :func:`dedup_documents` does, but compare texts with the same key like documents.

    Members of groups are keys with a text, by a 64-bit hash of both: of each
    group the one of the least key, then of the least xxhash64 of the text, stays.
    So a repeated key neither drops a text that is nobody's near duplicate nor
    connects groups. Of rows with the same key and text one stays, with the
    least hash over its columns.
    """
    member = F.xxhash64(F.col(key), F.col(text))
    some = docs.where(F.col(key).isNotNull())
    slim = some.where(F.col(text).isNotNull()).select(member.alias("id"), F.struct(F.col(key).cast("long").alias("key"), F.xxhash64(F.col(text)).alias("version")).alias("rank"), F.col(text).alias("text"))
    groups = settled(near_duplicates(slim, distance, "text", "id").select(F.col("doc_id").alias("id"), "group_id"), "texts")
    ranked = groups.join(slim.select("id", "rank"), "id")
    first = ranked.groupBy("group_id").agg(F.min_by("id", "rank").alias("stays"))
    own, gone_member, place, hashed = unused(docs, "member", "gone", "place", "hashed")
    gone = groups.join(first, "group_id").where("id <> stays").select(F.col("id").alias(gone_member))
    kept = some.withColumn(own, member).withColumn(hashed, row_hash(docs)).join(gone, F.col(own) == F.col(gone_member), "left_anti")
    return _once(kept, own, place, hashed).drop(own, hashed).unionByName(docs.where(F.col(key).isNull()))
