import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeweave.llm import quality, queries

from .conftest import frame, messy_rows


def auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_accuracy(spark, sf01):
    rows = {r["doc_id"]: r for r in queries.op5_quality(spark, sf01).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf01}/labels.parquet").collect()}
    assert len(rows) == 1000
    for k, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    own = [k for k in labels if k in rows and rows[k]["held_out"]]
    s, y = np.array([rows[k]["score"] for k in own]), np.array([labels[k] for k in own])
    assert auc(s, y) > 0.85 and ((s >= 0.7) == y).mean() > 0.75


def test_held_out_labels_and_other_columns_change_nothing(spark, sf01):
    docs, labels = spark.read.parquet(f"{sf01}/documents.parquet"), spark.read.parquet(f"{sf01}/labels.parquet")
    want = {r["doc_id"]: r["score"] for r in quality.quality(docs, labels, "doc_id", "text").collect()}
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumns({"lang": F.lit("zz"), "source": F.lit(None).cast("string"), "n_chars": F.lit(-1)})
    got = {r["doc_id"]: r["score"] for r in quality.quality(other, flipped, "doc_id", "text").collect()}
    assert got == want


def test_pairwise_terms_by_the_identity():
    rng = np.random.default_rng(1)
    m = quality.FactorisationMachine(0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    index, value = np.array([0, 3, 8, 2, 3]), rng.normal(size=5)
    got = m.raw(index, value, np.array([0, 3, 5]))
    for row, span in enumerate([slice(0, 3), slice(3, 5)]):
        i, x = index[span], value[span]
        want = 0.3 + (m.w[i] * x).sum() + sum(m.v[i[a]] @ m.v[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert got[row] == pytest.approx(want)


def test_features_of_one_text_do_not_depend_on_its_batch():
    texts = [t for _, t in messy_rows()]
    i, v, stop = quality.features(pa.array(texts, pa.string()))
    for n, t in enumerate(texts):
        a, b, s = quality.features(pa.array([t], pa.string()))
        assert np.array_equal(i[stop[n] : stop[n + 1]], a) and np.array_equal(v[stop[n] : stop[n + 1]], b) and s[-1] == len(a)


def test_pairs_are_learnt():
    """The sign of a product, which no linear score can tell."""
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 2, 1200), rng.integers(0, 2, 1200)
    index = np.stack([a, 2 + b], axis=1).ravel()
    model = quality.fit(index, np.ones(2400, np.float32), np.arange(0, 2401, 2), (a ^ b).astype(float), epochs=30)
    p = model.score(np.array([0, 2, 0, 3, 1, 2, 1, 3]), np.ones(8, np.float32), np.arange(0, 9, 2))
    assert p[0] < 0.3 < 0.7 < p[1] and p[3] < 0.3 < 0.7 < p[2]


@pytest.mark.parametrize("labelled", [[], [(5, 1), (7, 1)], [(5, None), (None, 1), (999, 0)]])
def test_nothing_to_learn(spark, messy, labelled):
    labels = spark.createDataFrame(labelled, "doc_id long, quality int")
    rows = quality.quality(messy, labels, "doc_id", "text").collect()
    assert len(rows) == len(messy_rows()) and {r["score"] for r in rows} == {quality.PRIOR}


def test_messy_and_empty(spark, messy, nothing):
    labels = spark.createDataFrame([(k, i % 2) for i, (k, _) in enumerate(messy_rows())] + [(5, 0), (5, 1)], "doc_id long, quality int")
    rows = quality.quality(messy, labels, "doc_id", "text").collect()
    assert len(rows) == len(messy_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 6}) == 1
    assert quality.quality(nothing, labels, "doc_id", "text").count() == 0
    model = quality.train(messy, labels, "doc_id", "text", "quality", F.lit(True))
    assert quality.scored(messy, "text", model).select("row.*").columns == messy.columns
