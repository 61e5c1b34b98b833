"""Line, passage and document dedup against brute force."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest

from lodeweave.llm import linededup, shared, simhash, substrings
from lodeweave.llm.shared import text_bytes


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=repr)


def brute_lines(docs, run, long=linededup.LONG):
    """Runs of lines, and lines of some size by themselves, that were seen before."""
    seen, gone = set(), {}
    for key, text in sorted(docs):
        kept = [(i, x.strip(" \t\r\v\f")) for i, x in enumerate(text.split("\n")) if x.strip(" \t\r\v\f")]
        for k in range(len(kept) - run + 1):
            part = tuple(x for _, x in kept[k : k + run])
            if part in seen:
                gone.setdefault(key, set()).update(range(kept[k][0], kept[k + run - 1][0] + 1))
            seen.add(part)
        for i, line in kept:
            if len(line.encode()) >= long:
                if ("alone", line) in seen:
                    gone.setdefault(key, set()).add(i)
                seen.add(("alone", line))
    return [(key, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(key, ()) or not x.strip(" \t\r\v\f"))) for key, t in docs]


@pytest.mark.parametrize("run, long", [(1, 20), (2, 20), (3, 20), (5, 20), (3, 1 << 30), (3, 1)])
def test_lines_brute(sample, run, long):
    docs = [(r.doc_id, r.text) for r in sample.collect()]
    assert texts(linededup.dedup_lines(sample, run, long)) == sorted(brute_lines(docs, run, long), key=repr)


def test_lines_ties_and_loops(spark):
    docs = [(1, "a\nb\na\nb\na\nb"), (2, "b\na\n\nb\nq"), (3, "\n\n\n"), (4, "z\nz\nz\nz")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for run in (1, 2, 3):
        assert texts(linededup.dedup_lines(df, run)) == sorted(brute_lines(docs, run), key=repr)


def test_lines_awkward(awkward, nothing):
    out = linededup.dedup_lines(awkward)
    assert out.columns == awkward.columns and out.count() == awkward.count()
    kept = [r.text for r in out.where("doc_id = 2").collect()]
    assert len(kept) == 2 and all("line two" not in t and t.endswith("end") for t in kept)
    assert out.where("doc_id is null and text is not null").count() == 1
    assert out.where("doc_id = 3 and text is null").count() == 1
    assert linededup.dedup_lines(nothing).count() == 0


WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def brute_spans(docs, length):
    """Words in lower case of ASCII and Latin-1; spans as unions of windows seen before."""
    seen, out = set(), {}
    for key, text in sorted(docs):
        raw = text.encode()
        low = re.sub(rb"\xc3([\x80-\x96\x98-\x9e])", lambda m: b"\xc3" + bytes([m[1][0] + 32]), raw).lower()
        found = [(m.start(), m.end()) for m in WORD.finditer(raw)]
        at = [low[a:b] for a, b in found]
        hit = []
        for k in range(len(at) - length + 1):
            part = tuple(at[k : k + length])
            if part in seen:
                hit.append(k)
            seen.add(part)
        spans = []
        for k in hit:
            if spans and k <= spans[-1][1] + 1:
                spans[-1][1] = k + length - 1
            else:
                spans.append([k, k + length - 1])
        out.update({key: [(a, b, found[a][0], found[b][1]) for a, b in spans]} if spans else {})
    return out


def found_spans(df, length):
    return {r.doc_id: [tuple(s) for s in r.spans] for r in substrings.repeated_spans(df, length).collect()}


@pytest.mark.parametrize("length", [7, 20, 50])
def test_passages_brute(sample, length):
    docs = [(r.doc_id, r.text) for r in sample.collect()]
    assert found_spans(sample, length) == brute_spans(docs, length)


def test_passages_low_entropy(spark):
    rng = np.random.default_rng(5)
    docs = [(i, " ".join(rng.choice(["a", "b"], 400, p=[0.9, 0.1]))) for i in range(12)] + [(50, "a " * 500), (51, "b " + "a " * 300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for length in (5, 12, 50):
        assert found_spans(df, length) == brute_spans(docs, length)


def test_passages_planted(spark):
    rng = np.random.default_rng(6)
    vocabulary = [f"v{i}" for i in range(5000)]
    plant = " ".join(rng.choice(vocabulary, 51))
    docs = [(i, " ".join([*rng.choice(vocabulary, 200), plant, *rng.choice(vocabulary, 150)])) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = found_spans(df, 50)
    assert found == brute_spans(docs, 50)
    assert set(found) == set(range(1, 300)) and all(s[0][0] <= 200 and s[0][1] >= 250 for s in found.values())
    cut = dict(texts(substrings.dedup_passages(df, 50)))
    assert cut[0] == docs[0][1] and all(345 <= len(cut[i].split()) <= 350 for i in range(1, 300))


def test_passages_awkward(awkward, nothing):
    out = substrings.dedup_passages(awkward)
    assert out.columns == awkward.columns and out.count() == awkward.count()
    assert {r.text for r in out.where("doc_id = 2").collect()} == {"before after\nline one\nline two\nline three\nend"}
    assert out.where("doc_id is null and text is not null").count() == 1
    assert substrings.repeated_spans(awkward).where("doc_id = 2").count() == 1
    assert substrings.dedup_passages(nothing).count() == 0


def brute_groups(docs, distance):
    """Groups by all pairs of whole fingerprints that meet in a block."""
    codes, n = simhash.fingerprints(*text_bytes(pa.array([t for _, t in docs])))
    bits = simhash.blocks(codes)
    root = {k: k for k, _ in docs}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(docs)):
        if n[i]:
            apart = np.bitwise_count(codes[i] ^ codes).sum(axis=1)
            block = np.bitwise_count(bits[i] ^ bits).min(axis=1)
            for j in np.flatnonzero((apart <= distance) & (block <= simhash.RADIUS) & (n > 0)):
                a, b = find(docs[i][0]), find(docs[j][0])
                root[max(a, b)] = min(a, b)
    top = {k: find(k) for (k, _), m in zip(docs, n) if m}
    size = Counter(top.values())
    return {k: g for k, g in top.items() if size[g] > 1}


@pytest.mark.parametrize("distance", [10, 65, 110])
def test_simhash_brute(sample, distance):
    docs = [(r.doc_id, r.text) for r in sample.collect()]
    assert {r.doc_id: r.group_id for r in simhash.near_duplicates(sample, distance).collect()} == brute_groups(docs, distance)


def test_simhash_recall(spark):
    """Copies with 3 to 8 % of the words replaced are found; texts of their own aren't."""
    rng = np.random.default_rng(7)
    vocabulary = np.array([f"v{i}" for i in range(20_000)])
    weights = 1 / np.arange(10, 20_010)
    weights /= weights.sum()
    docs, own = [], []
    for i in range(150):
        base = rng.choice(vocabulary, rng.integers(80, 500), p=weights)
        docs.append((i, " ".join(base)))
        copy = base.copy()
        change = rng.random(len(copy)) < rng.uniform(0.03, 0.08)
        copy[change] = rng.choice(vocabulary, change.sum())
        docs.append((1000 + i, " ".join(copy)))
    for i in range(300):
        docs.append((5000 + i, " ".join(rng.choice(vocabulary, rng.integers(80, 500), p=weights))))
    got = {r.doc_id: r.group_id for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sum(got.get(1000 + i) == i for i in range(150)) >= 0.9 * 150
    assert not [k for k in got if k >= 5000]


def test_simhash_recall_plain(spark):
    """Of all pairs within DISTANCE, whether or not they meet in a block, nine in ten are in one group; who has no such pair is in none."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    codes, n = simhash.fingerprints(*text_bytes(pa.array([t for _, t in docs])))
    apart = [np.bitwise_count(codes[i + 1 :] ^ codes[i]).sum(axis=1) for i in range(len(docs))]
    near = [(i, i + 1 + j) for i, d in enumerate(apart) for j in np.flatnonzero(d <= simhash.DISTANCE) if n[i] and n[i + 1 + j]]
    pairs = [(docs[i][0], docs[j][0]) for i, j in near if (codes[i] != codes[j]).any()]
    got = {r.doc_id: r.group_id for r in simhash.near_duplicates(table).collect()}
    assert len(pairs) > 50 and sum(a in got and got[a] == got.get(b) for a, b in pairs) >= 0.9 * len(pairs)
    assert set(got) <= {docs[k][0] for p in near for k in p}


def brute_links(docs, distance):
    """How many other fingerprints are near each document's."""
    codes, n = simhash.fingerprints(*text_bytes(pa.array([t for _, t in docs])))
    single = np.unique(codes[n > 0], axis=0)
    bits = simhash.blocks(single)
    near = {}
    for i, c in enumerate(single):
        meet = (np.bitwise_count(c ^ single).sum(axis=1) <= distance) & (np.bitwise_count(bits[i] ^ bits).min(axis=1) <= simhash.RADIUS)
        near[c.tobytes()] = int(meet.sum()) - 1
    return {k: near[codes[i].tobytes()] for i, (k, _) in enumerate(docs) if n[i]}


@pytest.fixture(scope="module")
def crowd():
    """Two texts with 150 copies each, of which each differs in a few words of its own; and some exact copies."""
    rng = np.random.default_rng(13)
    docs = []
    for base in range(2):
        own = [f"{base}w{i}" for i in range(150)]
        for k in range(150):
            copy = list(own)
            for at in rng.integers(0, 150, rng.integers(1, 9)):
                copy[at] = f"other{rng.integers(0, 10**6)}"
            docs.append((1000 * base + k, " ".join(copy)))
    return docs + [(5000 + i, docs[i][1]) for i in range(40)]


@pytest.mark.parametrize("tile", [4, 64, simhash.TILE])
def test_simhash_links_in_a_crowd(spark, crowd, tile, monkeypatch):
    """Each near pair counts once, whatever the pieces in which buckets are compared."""
    monkeypatch.setattr(simhash, "TILE", tile)
    want, groups = brute_links(crowd, simhash.DISTANCE), brute_groups(crowd, simhash.DISTANCE)
    got = simhash.near_duplicates(spark.createDataFrame(crowd, "doc_id long, text string")).collect()
    assert {r.doc_id: r.group_id for r in got} == groups and {r.doc_id: r.links for r in got} == {k: want[k] for k in groups}
    assert sum(want.values()) > 10_000


def test_simhash_links(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    want = brute_links(docs, simhash.DISTANCE)
    got = simhash.near_duplicates(table).collect()
    assert len(got) > 50 and {r.doc_id: r.links for r in got} == {r.doc_id: want[r.doc_id] for r in got}


class Caught:
    """Stands for a table: keeps the functions that are to run over it."""

    def __init__(self, rows):
        self.rows, self.functions = rows, []

    def count(self):
        return self.rows

    def groupBy(self, *_):
        return self

    def mapInArrow(self, f, schema):
        self.functions.append(f)
        return self

    applyInArrow = mapInArrow


def peak_mb(batches):
    """The most memory while batches are made and dropped; how many rows, and the rows of the batch that has most."""
    import tracemalloc

    tracemalloc.start()
    sizes = [b.num_rows for b in batches]
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return peak, sum(sizes), max(sizes)


def codes_with_one_block(n):
    """Different fingerprints that are near each other: they have block 0 in common, and differ in a few of the other bits."""
    rng = np.random.default_rng(37)
    flips = np.zeros((n, simhash.SIZE), bool)
    flips[np.arange(n)[:, None], rng.integers(simhash.BITS, simhash.SIZE, (n, 12))] = True
    return np.unique(np.packbits(flips, axis=1, bitorder="little").view(np.uint64), axis=0)


def test_simhash_memory_of_many_pairs():
    """A set of codes that are all near each other is compared without all its pairs in memory."""
    codes = codes_with_one_block(2000)
    n = len(codes)
    own = [{"block": 0, "bit": 0, "side": 0}]
    rows = [{"id": i, "own": own, **{f"c{k}": int(x) for k, x in enumerate(c.view(np.int64))}} for i, c in enumerate(codes)]
    kind = pa.struct([("id", pa.int64()), ("own", pa.list_(pa.struct([("block", pa.int8()), ("bit", pa.int8()), ("side", pa.int8())]))), *[(f"c{k}", pa.int64()) for k in range(simhash.SIZE // 64)]])
    batch = pa.RecordBatch.from_arrays([pa.array([rows], pa.list_(kind))], names=["members"])
    simhash._verified(table := Caught(n), simhash.DISTANCE)
    got = pa.Table.from_batches(list(table.functions[0](iter([batch])))).to_pydict()
    assert got == {"id": list(range(n)), "root": [0] * n, "links": [n - 1] * n}
    assert peak_mb(table.functions[0](iter([batch])))[0] < 120


def test_simhash_memory_of_a_large_bucket(monkeypatch):
    """The pieces of a bucket, of which there are with the square of its members, leave its task part by part, and are all there."""
    monkeypatch.setattr(simhash, "TILE", 64)
    codes = codes_with_one_block(20_000)
    n, width = len(codes), simhash.SIZE // 64
    simhash._collisions(table := Caught(n))
    emit, meet = table.functions
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), *(pa.array(np.ascontiguousarray(codes[:, k]).view(np.int64)) for k in range(width))], names=["id", *(f"c{k}" for k in range(width))])
    own = [b.filter(pa.compute.equal(b["part"], 0)) for b in emit(iter([batch]))]
    peak, rows, most = peak_mb(meet(iter(own)))
    pieces = -(-n // 64)
    assert rows == pieces * (pieces + 1) // 2 and most < rows / 2
    assert peak < 150


@pytest.mark.parametrize("small", [None, 0])
def test_simhash_components_here_and_in_rounds(spark, monkeypatch, small):
    """Few edges are written once and take one task; more take rounds; both give the same."""
    written = []
    monkeypatch.setattr(simhash, "settled", lambda df, what, f=simhash.settled: written.append(what) or f(df, what))
    rng = np.random.default_rng(41)
    order = rng.permutation(3000)
    edges = [(int(a), int(b)) for a, b in zip(order[:-1], order[1:])] + [(5000, 5001), (5001, 5000), (5002, 5002), (-7, 6000), (-9, 6000)]
    got = {r.id: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long"), small=small).collect()}
    assert got == {int(i): 0 for i in order} | {5000: 5000, 5001: 5000, 6000: -9, -7: -9, -9: -9}
    assert (len(written) == 1) == (small is None)
    assert simhash.components(spark.createDataFrame([], "a long, b long"), small=small).count() == 0


def test_simhash_recall_by_distance():
    """Of random fingerprints at a distance, as many meet in a block as the module says; up to 35 bits all do."""
    rng = np.random.default_rng(17)
    for apart, least in ((20, 1), (35, 1), (45, 0.985), (50, 0.945), (56, 0.83)):
        flips = np.argsort(rng.random((4000, simhash.SIZE)), axis=1) < apart
        bits = simhash.blocks(np.packbits(flips, axis=1, bitorder="little").view(np.uint64))
        assert (np.bitwise_count(bits).min(axis=1) <= simhash.RADIUS).mean() >= least


def test_simhash_recall_by_change(spark):
    """Of copies in which 5 % of the words are others, nearly all pairs within DISTANCE meet; at 10 and 15 % fewer are that near."""
    rng = np.random.default_rng(19)
    for share, least in ((0.05, 0.98), (0.10, 0.9), (0.15, 0.8)):
        docs = []
        for i in range(2000):
            base = [f"v{w}" for w in rng.zipf(1.3, 200) % 5000]
            copy = [f"n{rng.integers(10**6)}" if rng.random() < share else w for w in base]
            docs += [" ".join(base), " ".join(copy)]
        codes, _ = simhash.fingerprints(*text_bytes(pa.array(docs)))
        near = np.bitwise_count(codes[::2] ^ codes[1::2]).sum(axis=1) <= simhash.DISTANCE
        bits = simhash.blocks(codes)
        meet = np.bitwise_count(bits[::2] ^ bits[1::2]).min(axis=1) <= simhash.RADIUS
        print(f"{share:.0%} of words replaced: {near.mean():.3f} within {simhash.DISTANCE} bits, of which {meet[near].mean() if near.any() else 1:.3f} meet")
        assert not near.any() or meet[near].mean() >= least


def test_equal_texts_have_equal_fingerprints():
    """Whatever else is in the batch, and where it's cut."""
    rng = np.random.default_rng(23)
    text = " ".join(f"w{i}" for i in rng.integers(0, 3000, 6000))
    fill = [" ".join(f"f{i}" for i in rng.integers(0, 9000, n)) for n in (5000, 9000, 1, 7777)]
    codes, _ = simhash.fingerprints(*text_bytes(pa.array([text, fill[0], text, fill[1], fill[2], text, fill[3], text])))
    assert all(np.array_equal(codes[0], codes[i]) for i in (2, 5, 7))


@pytest.mark.parametrize("n", [2_000_000, 20_000_000])
def test_memory_of_long_texts(n):
    """A text of other and other words takes a bounded multiple of its size in every operator that reads words or lines."""
    import tracemalloc

    from lodeweave.llm import classifier

    unit = " ".join(f"w{i}" for i in np.random.default_rng(0).integers(0, 10**7, 250_000))
    raw = np.frombuffer((unit * (n // len(unit) + 1)).encode()[:n], np.uint8)
    at = np.array([0, len(raw)])
    for f in (lambda: simhash.fingerprints(raw, at), lambda: classifier.statistics(raw, at), lambda: substrings._triggers(raw, at, 50), lambda: substrings._passages(raw, at, [(np.array([0]), np.array([9]))], 50), lambda: linededup.lines_of(raw, at)):
        tracemalloc.start()
        f()
        peak = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        assert peak < (150 if n < 10**7 else 500)


@pytest.mark.parametrize("everyone", [False, True])
def test_equal_keys_found_in_pieces(spark, everyone):
    """Whether equal keys meet in one task's rows or only after the shuffle, the same ranges come out."""
    rng = np.random.default_rng(29)
    n = 4000
    key = np.where(rng.random(n) < 0.33, 7, rng.integers(0, 900, n))
    doc, version, first = rng.integers(0, 40, n), rng.integers(0, 2, n), rng.integers(0, 60, n).astype(np.int32)
    rows = [(key[i : i + 500], doc[i : i + 500], version[i : i + 500], first[i : i + 500], first[i : i + 500]) for i in range(0, n, 500)]
    seen = {}
    for k, *place in sorted(set(zip(key.tolist(), doc.tolist(), version.tolist(), first.tolist()))):
        seen.setdefault(k, []).append(tuple(place))
    want = {}
    for places in seen.values():
        for d, v, f in places[0 if everyone and len(places) > 1 else 1 :]:
            want.setdefault((d, v), set()).add(f)
    for size in (1, 1000, 1 << 20):
        batches = [b for half in (rows[:4], rows[4:]) for b in shared.marked(iter(half), everyone, size)]
        marks = spark.createDataFrame(pa.Table.from_batches(batches).to_pandas())
        got = {(r.doc_id, r.version): {w for s in r.spans for w in range(s.first, s.last + 1)} for r in shared.again(marks, everyone).collect()}
        assert got == want
        hot = sum(((t := b.to_pydict())["key"].count(7) for b in batches if not b.column(5)[0].as_py()), 0)
        assert hot == (8 if size == 1 else 4 if size == 1000 else 2)  # once for each so many rows


def test_any_other_columns(spark):
    """Columns with the operators' own names, and of types that can't be hashed or compared."""
    names = "own version found gone place hashed member marks spans words key first last sure id rank group_id n window gathered own_ `__lw_key` `__lw_place`".split()
    run = " ".join(f"w{i}" for i in range(60)) + "\nline one\nline two\nline three"
    rows = [(k, run + f" {k}", {"a": k}, [{"b": [k]}], *["x"] * len(names)) for k in (1, 2, 2, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, am array<map<string,array<int>>>, " + ", ".join(f"{n} string" for n in names))
    assert linededup.dedup_lines(df).columns == df.columns and linededup.dedup_lines(df).count() == 4
    assert substrings.dedup_passages(df).columns == df.columns and substrings.dedup_passages(df).count() == 4
    for f in (simhash.dedup_documents, simhash.dedup_texts):
        assert f(df).columns == df.columns and [r.doc_id for r in f(df).collect()] == [1]


def test_simhash_components(spark):
    rng = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {}

    def find(k):
        root.setdefault(k, k)
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.id: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {k for e in edges if e[0] != e[1] for k in e}
    assert got == {k: find(k) for k in linked}


def test_simhash_awkward(awkward, nothing):
    out = simhash.dedup_documents(awkward)
    assert out.columns == awkward.columns
    keys = Counter(r.doc_id for r in out.collect())
    assert keys == {1: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1, 9: 1, None: 2}  # 2 is a near copy of 1
    assert simhash.dedup_documents(nothing).count() == 0


def test_simhash_repeated_keys(spark, awkward, nothing):
    """In the pipeline, texts with the same key stay unless they are near duplicates, and don't connect groups."""
    import corpus_pipeline

    a, b, c = (" ".join(f"{x}{i}" for i in range(80)) for x in "abc")
    rows = [(1, a, 1), (2, b, 2), (3, a + " more", 3), (3, b + " more", 4), (3, c, 5), (3, c, 5), (3, c, 6), (4, None, 7), (4, "", 8), (None, a, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = corpus_pipeline.dedup_documents(spark, docs, "")
    assert got.columns == docs.columns
    assert texts(got) == sorted([(1, a), (2, b), (3, c), (4, None), (4, ""), (None, a)], key=repr)
    got = corpus_pipeline.dedup_documents(spark, awkward, "")
    assert Counter(r.doc_id for r in got.collect()) == {1: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 2, 9: 1, None: 2}
    assert corpus_pipeline.dedup_documents(spark, nothing, "").count() == 0
