"""The pipeline, stage by stage, and its rows as a whole."""

import numpy as np
import pyarrow as pa
from test_dedup import brute_groups, brute_lines, brute_spans
from test_layout import check_bins

import __spark_entry__
import corpus_pipeline
from lodeweave.llm import classifier, packing, substrings
from lodeweave.llm.shared import text_bytes

FOLDER = "/root/testdata/sf0.001"


def pairs(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_stages_against_brute_force(spark, sample):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    docs = pairs(sample)
    model = classifier.train(sample, labels)
    score = model.score(classifier.statistics(*text_bytes(pa.array([t for _, t in docs]))))
    docs = [d for d, p in zip(docs, score, strict=True) if p >= classifier.THRESHOLD and d[1]]
    step = sample
    want = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, FOLDER).cache()
        assert step.columns == sample.columns
        if name == "line dedup":
            want = brute_lines(want, 3)
        elif name == "near dedup":
            groups = brute_groups(want, 56)
            want = [d for d in want if groups.get(d[0], d[0]) == d[0]]
        elif name == "passage dedup":
            spans = brute_spans(want, 50)
            want = [(k, substrings.without_spans(t, [s[2:] for s in spans.get(k, [])])) for k, t in want]
        assert pairs(step) == sorted(want), name
        assert all(r.n_chars == len(r.text) for r in step.collect())
    bins = corpus_pipeline.STAGES[-1][1](spark, step, FOLDER).collect()
    check_bins(want, bins, packing.CAPACITIES)
    assert sorted(map(repr, corpus_pipeline.run(spark, FOLDER).collect())) == sorted(map(repr, bins))


def test_clean_documents_stay(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    kept = corpus_pipeline.classify_quality(spark, docs, "/root/testdata/sf0.01")
    good = labels.where("quality = 1")
    assert kept.join(good, "doc_id").count() >= 0.995 * good.count()


def test_awkward_tables(spark, awkward, nothing, tmp_path):
    spark.createDataFrame([(1, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for df in (awkward, nothing):
        for _, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, str(tmp_path))
        assert np.all([len(r.doc_ids) > 0 for r in df.collect()])


def test_registered():
    assert [name for name, _ in corpus_pipeline.STAGES][-1] == "packing"
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
