"""Classifier, tokens, neighbours."""

import os
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lodeweave.llm import ann, bpe, classifier
from lodeweave.llm.shared import text_bytes

DATA = "/root/testdata/sf0.1"


def test_classifier_held_out(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    seen, unseen = labels.where("doc_id % 10 < 6"), labels.where("doc_id % 10 >= 6")
    model = classifier.train(docs, seen)
    got = classifier.classify(docs, model).join(unseen, "doc_id").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert len(bad) > 100 and good.keep.mean() > 0.995 and (~bad.keep).mean() > 0.97


def walk(model, row):
    total = model.base
    for feature, cut, value in zip(model.feature, model.cut, model.value, strict=True):
        node = 0
        while node < 2**classifier.DEPTH - 1:
            node = 2 * node + 1 + int(row[feature[node]] > cut[node])
        total += value[node - (2**classifier.DEPTH - 1)]
    return 1 / (1 + np.exp(-total))


def test_forest_traversal_and_fit():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 6))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (x[:, 2] > 1)).astype(float)
    model = classifier.fit(x[:2000], y[:2000])
    assert np.allclose(model.score(x[:50]), [walk(model, r) for r in x[:50]])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.93


def test_forest_without_labels():
    x = np.zeros((5, len(classifier.FEATURES)))
    assert np.all(classifier.fit(x[:0], np.zeros(0)).score(x) == 0.5)
    assert np.all(classifier.fit(x, np.ones(5)).score(x) > 0.9)


def test_statistics_do_not_depend_on_the_batch(sample):
    texts = [r.text for r in sample.limit(60).collect()] + ["", "a", "\n", "é"]
    whole = classifier.statistics(*text_bytes(pa.array(texts)))
    assert np.allclose(whole, np.concatenate([classifier.statistics(*text_bytes(pa.array([t]))) for t in texts]))
    assert not whole[-4].any() and np.isfinite(whole).all()


def brute_statistics(text):
    """The features of one text, by regular expressions and counting."""
    raw = text.encode()
    found = re.findall(rb"[0-9A-Za-z\x80-\xff]+", raw)
    low = [re.sub(rb"\xc3([\x80-\x96\x98-\x9e])", lambda m: b"\xc3" + bytes([m[1][0] + 32]), w).lower() for w in found]
    n, per, size, lines = len(found), max(len(found), 1), max(len(raw), 1), raw.count(b"\n") + bool(raw)
    has = lambda chars: sum(b in chars for b in raw)
    pairs = list(zip(low, low[1:]))
    return [
        np.log1p(len(raw)), np.log1p(n), np.log1p(lines), sum(map(len, found)) / per, sum(len(w) > 14 for w in found) / per,
        len(set(low)) / per, len(set(low)) / np.sqrt(per), sum(a == b for a, b in pairs) / per,
        has(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / size, has(b"0123456789") / size, has(b" \t\n\r") / size, has(b".!?") / per, has(b",;:") / per,
        has(b"#$%&*+<=>@^_~\\") / per, has(b"\"'()-/[]`{}") / per, sum(b >= 192 for b in raw) / size,
        n / max(lines, 1), sum(x[-1:] != b"" and x[-1:] in b".!?\"')" for x in raw.split(b"\n")) / max(lines, 1), has(b"|") / per, (len(pairs) - len(set(pairs))) / max(n - 1, 1),
    ]


def test_statistics_brute(sample):
    texts = [r.text for r in sample.collect()] + ["", "a", "\n", "\n\nx.\n", "é É|É a A", "- x\n\n- y)", "one two one two one"]
    assert np.allclose(classifier.statistics(*text_bytes(pa.array(texts))), [brute_statistics(t) for t in texts])


def slow_fit(x, y, trees):
    """Boosting with every cut of every feature tried by itself, as nested pairs; returns the scores of the rows."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, classifier.BINS + 1)[1:-1])) for j in range(x.shape[1])]
    rate = (y.sum() + 0.5) / (len(y) + 1)
    score = np.full(len(y), np.log(rate / (1 - rate)))

    def grow(rows, g, h, depth):
        value = -classifier.RATE * g[rows].sum() / (h[rows].sum() + classifier.L2)
        if depth == classifier.DEPTH:
            return [(rows, value)]
        best, split = 1e-9, None
        for j, own in enumerate(cuts):
            for c in own:
                left, right = rows[x[rows, j] <= c], rows[x[rows, j] > c]
                if min(len(left), len(right)) >= classifier.LEAST:
                    gain = sum(g[r].sum() ** 2 / (h[r].sum() + classifier.L2) * s for r, s in ((left, 1), (right, 1), (rows, -1)))
                    if gain > best + 1e-12:
                        best, split = gain, (left, right)
        return grow(split[0], g, h, depth + 1) + grow(split[1], g, h, depth + 1) if split else [(rows, value)]

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        for rows, value in grow(np.arange(len(y)), p - y, np.maximum(p * (1 - p), 1e-9), 0):
            score[rows] += value
    return 1 / (1 + np.exp(-score))


def test_fit_brute(monkeypatch):
    monkeypatch.setattr(classifier, "TREES", 6)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4)).round(2)
    y = ((x[:, 0] + x[:, 1] ** 2 + rng.normal(size=300) * 0.3) > 0.8).astype(float)
    assert np.allclose(classifier.fit(x, y).score(x), slow_fit(x, y, 6))


def test_classifier_awkward(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (7, 0, 0), (7, 0, 0), (8, 1, 0), (8, 0, 0), (None, 1, 0), (3, None, 0), (77, 0, 0)], "doc_id long, quality int, toxic int")
    model = classifier.train(awkward, labels)
    out = classifier.classify(awkward, model)
    assert out.columns == ["doc_id", "quality_score", "keep"] and out.count() == awkward.count()
    assert {(r.quality_score, r.keep) for r in out.where("doc_id in (3, 4)").collect()} == {(0.0, False)}
    kept = classifier.keep_good(awkward, model)
    assert kept.columns == awkward.columns and kept.count() == out.where("keep").count()
    assert classifier.classify(nothing, model).count() == 0
    many = spark.createDataFrame([(1, "good words here " * k) for k in (3, 1, 2)] * 50 + [(2, "x")], "doc_id long, text string")
    assert classifier.train(many, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).base == pytest.approx(np.log(3))  # a row a key
    assert classifier.train(nothing, labels).base == 0.0 and classifier.train(awkward, labels.limit(0)).base == 0.0


@pytest.fixture(scope="module")
def vocabulary():
    with open(bpe.VOCABULARY, "rb") as f:
        return bpe.loaded(f.read())


def test_bpe_tree_equals_direct(vocabulary):
    rng = random.Random(3)
    alphabets = ["ab", "thea ", "0123456789", "éñçüß", "aaaaab", "  \n\t", "日本語テキスト", "etaoinshrdlu"]
    for trial in range(120):
        text = "".join(rng.choices(alphabets[trial % len(alphabets)], k=rng.randint(300, 3000)))
        data = text.encode()
        assert vocabulary.halves(data) == vocabulary.leaf(data), trial


def test_bpe_join_at_every_cut(vocabulary):
    data = ("internationalisierungen" * 3 + "aaaaaaaaaaaaaaaaaaaaaa" + "éééé").encode()
    whole = vocabulary.leaf(data)
    for i in range(len(data) + 1):
        assert vocabulary.join(vocabulary.leaf(data[:i]) if i else [], vocabulary.leaf(data[i:]) if i < len(data) else []) == whole


def test_bpe_round_trip(spark, sample, vocabulary):
    rng = random.Random(4)
    long = ["".join(rng.choices("abcdefgh", k=60_000)), " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 4000))) for _ in range(40)), "\n" * 9000 + "x" + " " * 9000]
    docs = sample.select("doc_id", "text").unionByName(spark.createDataFrame([(10_000_000 + i, t) for i, t in enumerate(long)], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for segment in (1 << 20, 700):
        got = bpe.decode(bpe.encode(docs, segment=segment)).collect()
        assert len(got) == len(texts)
        for r in got:
            assert r.text == texts[r.doc_id] and r.n_tokens == len(r.tokens)
            if segment == 700:
                assert r.tokens == vocabulary.encoding.encode_ordinary(r.text)


def test_bpe_awkward(awkward, nothing):
    for segment in (1 << 20, 40):
        got = bpe.decode(bpe.encode(awkward, segment=segment))
        assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(((r.doc_id, r.text) for r in awkward.collect()), key=repr)
        assert got.where("doc_id = 3 and tokens is null and n_tokens is null").count() == 1
        assert got.where("doc_id = 4 and n_tokens = 0").count() == 1
    assert bpe.encode(nothing).count() == 0


def exact(x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = x @ x.T
    np.fill_diagonal(sim, -9)
    return np.sort(sim, axis=1)[:, ::-1][:, :k]


def recall(got, best, k, every):
    """Share of the queries' true neighbours, or others as near, that were found; every query has k rows."""
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    assert sorted(by) == list(range(0, len(best), every))
    hits = 0
    for i in by:
        mine = sorted(by[i], key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, k + 1)) and len({r.neighbour_id for r in mine}) == k
        hits += sum(r.similarity >= best[i][-1] - 2e-6 for r in mine)
    return hits / (len(by) * k)


def test_neighbours_recall(spark):
    """The query's own form and all rows as queries, on the data's vectors, in few and in many blocks."""
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    x = np.stack([r.embedding for r in table.orderBy("vec_id").collect()]).astype(float)
    assert np.array_equal([r.vec_id for r in table.orderBy("vec_id").select("vec_id").collect()], np.arange(len(x)))
    best = exact(x, 10)
    for block, every in ((ann.BLOCK, ann.EVERY), (300, ann.EVERY), (300, 1)):
        assert recall(ann.neighbours(table, block=block, every=every).collect(), best, 10, every) >= 0.95


def test_neighbours_fitted_on_few(spark):
    """Cells that are fitted to a few rows index all the same."""
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    x = np.stack([r.embedding for r in table.orderBy("vec_id").collect()]).astype(float)
    assert recall(ann.neighbours(table, block=100, fit_rows=40).collect(), exact(x, 10), 10, ann.EVERY) >= 0.95


def test_neighbours_without_structure(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 30))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    assert recall(ann.neighbours(df, k=5, block=200, every=1).collect(), exact(x.astype(np.float32).astype(float), 5), 5, 1) >= 0.9


def test_neighbours_of_long_vectors(spark, tmp_path, monkeypatch):
    """The driver gathers centres only, whatever the vectors' length; a worker holds several blocks at once."""
    x = np.random.default_rng(5).normal(size=(4000, 600)).astype(np.float32)
    lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 600).cast(pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": lists}), tmp_path / "long.parquet")
    table, sizes = spark.read.parquet(str(tmp_path / "long.parquet")), []
    gather = type(table).toArrow

    def counted(df):
        got = gather(df)
        sizes.append(got.nbytes)
        return got

    monkeypatch.setattr(type(table), "toArrow", counted)
    assert recall(ann.neighbours(table, block=20).collect(), exact(x.astype(float), 10), 10, ann.EVERY) >= 0.9
    assert 0 < max(sizes) <= 1 << 20 < x.nbytes


def test_neighbours_awkward(spark):
    v = [1.0, 0.0, 2.0]
    rows = [(1, v, 9), (1, v, 9), (2, v, 9), (3, v, 8), (4, [0.0, 1.0, 0.0], 1), (5, None, 1), (None, v, 1), (6, [], 1), (7, [0.0, 0.0, 0.0], 1), (8, [float("nan"), 1.0, 1.0], 1), (9, [1.0, None, 2.0], 1), (10, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = sorted((r.vec_id, r.rank, r.neighbour_id, r.similarity) for r in ann.neighbours(df, every=1).collect())
    assert [g[:3] for g in got] == [(1, 1, 2), (1, 2, 3), (1, 3, 4), (2, 1, 1), (2, 2, 3), (2, 3, 4), (3, 1, 1), (3, 2, 2), (3, 3, 4), (4, 1, 1), (4, 2, 2), (4, 3, 3)]
    assert all(abs(s - (0 if 4 in (a, b) else 1)) < 1e-5 for a, _, b, s in got)
    assert {r.vec_id for r in ann.neighbours(df, every=2).collect()} == {2, 4}
    assert ann.neighbours(df).count() == 0
    assert ann.neighbours(df.limit(0), every=1).count() == 0
    assert ann.neighbours(df.where("vec_id = 4"), every=1).count() == 0


def test_vocabulary_is_not_in_the_repository():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert not [f for _, _, fs in os.walk(root) for f in fs if f.endswith((".tiktoken", ".model"))]
