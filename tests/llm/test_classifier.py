import zlib

import numpy as np
import pytest

from patternlake.llm.classifier import Indicators, fit, op10_quality, packed, score, train, unpacked
from patternlake.llm.common import table


def test_indicators_are_the_distinct_ngrams():
    one = Indicators(1 << 12)
    text = b"abcabc\xff\x00" * 50
    grams = {text[i : i + n] for n in (2, 3, 4) for i in range(len(text) - n + 1)}
    want = {(((int.from_bytes(g, "big") + len(g)) * 2654435761) % (1 << 32)) >> 20 for g in grams}
    assert set(one.of(text).tolist()) == want and len(one.of(b"")) == 0 and len(one.of(b"a")) == 0
    assert set(one.of(text).tolist()) == want  # nothing is left from other texts


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(1)
    rows = [np.unique(np.concatenate([rng.integers(0, 40, 8), rng.integers(0, 8, 4) + (40 if i % 3 else 48)])) for i in range(90)]
    labels = [int(i % 3 > 0) for i in range(90)]
    assert all(unpacked(packed(r, d), d).tolist() == r.tolist() for r in rows for d in (64, 512, 1 << 18))
    assert len(packed(np.arange(1 << 12), 1 << 12)) == 1 << 9
    model = fit([packed(r, 64) for r in rows], labels, 64, epochs=400)
    y = np.where(np.array(labels) == 1, 1.0, -1.0)
    x = np.zeros((90, 65))
    for i, r in enumerate(rows):
        x[i, r] = model.ratio[r] / np.sqrt((model.ratio[r] ** 2).sum())
    x[:, 64] = 1
    ratio = np.where(model.ratio == 0, 1, model.ratio)
    w = np.append(model.weight / ratio, model.bias)
    primal = lambda w: 0.5 * w @ w + np.maximum(0, 1 - y * (x @ w)).sum()
    best = primal(w)
    assert all(primal(w + 0.01 * rng.standard_normal(65)) >= best - 1e-3 for _ in range(200))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = {r.doc_id: r for r in score(docs, train(docs, labels, label_col="quality")).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    tested = [(got[i], q) for i, q in truth.items() if got[i].held_out]
    right = sum(r.predicted == q for r, q in tested) / len(tested)
    pairs = [(a.score, b.score) for a, q in tested for b, p in tested if q > p]
    assert right > 0.93 and sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs) > 0.95, (right, len(tested))


def test_odd_input(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "text"), (3, "x" * 3_000_000), (3, "y")], "doc_id long, text string").selectExpr("*", "1 AS label", "2 AS key", "3 AS score", "4 AS digest")
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = score(df, train(df, none, label_col="quality")).collect()
    assert len(rows) == 5 and {r.score for r in rows} == {0.5}
    one = spark.createDataFrame([(2, 1), (2, 1), (3, None), (None, 0), (9, 0)], "doc_id long, quality int")
    rows = score(df, train(df, one, label_col="quality")).collect()
    assert len({r.score for r in rows}) == 1 and all(r.predicted == 1 for r in rows)
    assert score(df.filter("false"), train(df, one, label_col="quality")).collect() == []
    with pytest.raises(ValueError):
        Indicators(1000)


def test_whole_query_against_one_process(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in table(spark, sf_dir, "documents").collect()}
    marks = {}
    for r in table(spark, sf_dir, "labels").collect():
        if r.quality is not None and r.doc_id in docs and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            marks[r.doc_id] = min(marks.get(r.doc_id, 1), r.quality)
    dims, model = 1 << 18, train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), label_col="quality")
    counts = np.ones((2, dims))
    grams = {}
    for i, text in docs.items():
        data = text.encode()
        grams[i] = sorted({(((int.from_bytes(data[k : k + n], "big") + n) * 2654435761) % (1 << 32)) >> 14 for n in (2, 3, 4) for k in range(len(data) - n + 1)})
        if i in marks:
            counts[marks[i], grams[i]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    assert len(marks) > 50 and np.allclose(model.ratio, ratio)
    for r in op10_quality(spark, sf_dir).collect():
        f = grams[r.doc_id]
        size = np.sqrt((ratio[f] ** 2).sum())
        margin = model.bias + (model.weight[f].sum() / size if size else 0)
        assert abs(r.score - 1 / (1 + np.exp(-2 * margin))) < 1e-9


def test_neither_order_nor_repeats_change_the_model(spark, sf_dir):
    from pyspark.sql import functions as F

    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    twin = docs.filter("doc_id % 5 = 0").select("doc_id", F.concat("text", F.lit(" other text")).alias("text"))
    rows = docs.unionByName(twin)
    want = train(rows, labels, label_col="quality", max_train=60)
    for df in (twin.unionByName(docs), rows.unionByName(docs).orderBy(F.rand(5)), rows.unionByName(rows).repartition(7)):
        got = train(df, labels.unionByName(labels), label_col="quality", max_train=60)
        assert (got.weight == want.weight).all() and got.bias == want.bias
