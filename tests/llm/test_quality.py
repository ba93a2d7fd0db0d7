import math
import random
import zlib

import numpy as np
import pytest

from parlance.llm import quality, queries


def test_held_out_accuracy(spark):
    got = queries.op10_quality_classifier(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.93
    assert all(r["predicted"] == 1 for r in rows if r["quality"] == 1)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) for r in got.collect())
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, queries.op10_quality_classifier(spark, "/root/testdata/sf0.01").collect()))


def test_held_out_labels_are_not_used(spark, documents, sf_dir):
    from pyspark.sql import functions as F

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.fold() == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.fit(documents, x) for x in (labels, turned))
    assert (a[0] == b[0]).all() and a[1] == b[1]


def plain_ftrl(rows, epochs):
    """FTRL-proximal a coordinate at a time, over dictionaries."""
    z, n = {}, {}

    def weight(i):
        l1 = 0 if i == "bias" else quality.L1
        if abs(z.get(i, 0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(epochs):
        for found, x, label in rows:
            pairs = [*zip(found.tolist(), x.tolist()), ("bias", 1.0)]
            w = {i: weight(i) for i, _ in pairs}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in pairs)))
            for i, v in pairs:
                g = (p - label) * v
                sigma = (math.sqrt(n.get(i, 0) + g * g) - math.sqrt(n.get(i, 0))) / quality.ALPHA
                z[i] = z.get(i, 0) + g - sigma * w[i]
                n[i] = n.get(i, 0) + g * g
    return {i: weight(i) for i in z}


def test_training_agrees_with_plain_ftrl():
    rnd, hashes = random.Random(9), quality.Hashes()
    words = ["good", "bad", "fine", "junk", "the", "a", "of", "x1", "z"]
    rows = []
    for _ in range(200):
        text = " ".join(rnd.choices(words, k=rnd.randint(0, 12)))
        rows.append((*quality.features(text, hashes, 10), float("good" in text)))
    weights, bias = quality.train(rows, 10, 3)
    want = plain_ftrl(rows, 3)
    assert bias == pytest.approx(want.pop("bias"))
    assert {i: pytest.approx(w, abs=1e-6) for i, w in want.items() if w} == {int(i): float(weights[i]) for i in np.flatnonzero(weights)}


def test_sample_is_bounded(spark):
    docs = spark.range(3000).selectExpr("id % 40 AS doc_id", "concat('w', id, ' a b c') AS text")
    labels = spark.range(40).selectExpr("id AS doc_id", "id % 2 AS quality")
    seen = []
    train = quality.train
    quality.train = lambda rows, bits: seen.append(len(rows)) or train(rows, bits)
    try:
        a, b = quality.fit(docs, labels, 25), quality.fit(docs.repartition(7), labels, 25)
        quality.fit(docs, labels, 5000)
    finally:
        quality.train = train
    assert seen[:2] == [25, 25] and seen[2] == docs.where(quality.fold() != 0).count()
    assert (a[0] == b[0]).all() and a[1] == b[1]
    found, x = np.arange(10, dtype=np.int32), np.array([1, 3, 2, 3, 1, 1, 1, 1, 1, 9], np.float32)
    assert quality.heaviest(found, x, 4)[0].tolist() == [1, 2, 3, 9]


def test_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1), (1, 0), (6, 0), (7, None), (None, 1), (8, 1), (9, 0)], "doc_id long, quality int").selectExpr("*", "'x' AS text")
    model = quality.fit(awkward, labels)
    got = quality.scores(awkward, model).collect()
    assert len(got) == awkward.count() and all(0 <= r["score"] <= 1 for r in got)
    assert not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert len({r["score"] for r in got if r["doc_id"] in (2, 3, 4)}) == 1
    none = quality.fit(nothing, labels.where("false"))
    assert {r["score"] for r in quality.scores(awkward, none).collect()} == {0.5}
    assert quality.scores(nothing, model).count() == 0
    kept = quality.keep_good(awkward, model)
    assert kept.columns == awkward.columns
    want = sorted(r["doc_id"] or 0 for r in got if r["predicted"])
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == want
