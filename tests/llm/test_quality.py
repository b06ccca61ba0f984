"""The classifier on held-out rows, its trees against plain traversal, and edge cases."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from headway.llm import quality
from headway.llm.tables import table

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    out = quality.quality(table(spark, SF, "documents"), table(spark, SF, "labels"))
    rows = out.join(table(spark, SF, "labels"), "doc_id").where("held_out").collect()
    assert len(rows) > 40
    right = sum(r.predicted == r.quality for r in rows)
    assert right >= 0.97 * len(rows)
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out.collect())


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_other_columns_and_held_out_labels_do_not_change_scores(spark, docs):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["one", "two", "three", "###", "a|b"]) for _ in range(rng.randint(1, 40)))) for i in range(120)]
    marks = [(i, int("###" not in t), 0) for i, t in rows]
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    flipped = [(i, 1 - q if i in held else q, 1) for i, q, _ in marks]
    scores = lambda df, lab: {r.doc_id: r.score for r in quality.quality(df, labels(spark, lab)).collect()}
    a = scores(docs(rows), marks)
    other = docs(rows, 5).withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("z"))
    assert scores(other, flipped) == a


def test_nulls_empties_repeats_extra_columns_and_no_labels(spark, docs):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x"), (4, "long " * 20000), (5, "\n\n"), (6, "é|é")]
    df = docs(rows).withColumn("score", F.lit("x")).withColumn("quality", F.lit(0)).withColumn("x", F.lit(1)).withColumn("y", F.lit(1))
    none = quality.quality(df, labels(spark, [])).collect()
    assert len(none) == len(rows) and {r.score for r in none} == {0.5} and {r.predicted for r in none} == {1}
    some = quality.quality(df, labels(spark, [(1, 1, 0), (3, 0, 0), (3, 1, 0), (None, 1, 0), (4, None, 0), (99, 1, 1)])).collect()
    assert len(some) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in some)
    assert {r.held_out for r in some if r.doc_id is None} == {False}
    assert quality.quality(docs([]), labels(spark, [])).count() == 0


def test_flat_traversal_equals_walking_the_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 6))
    y = (x[:, 0] * x[:, 1] + 0.3 * x[:, 2] > 0).astype(float)
    t = quality.grow(x, y)
    p = quality.predict(t, x)
    assert ((p > 0.5) == (y > 0)).mean() > 0.95
    for i in range(0, 500, 25):
        total = t.start
        for f, limit, value in zip(t.feature, t.limit, t.value, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(x[i, f[node]] > limit[node])
            total += value[node - len(f)]
        assert abs(p[i] - 1 / (1 + np.exp(-total))) < 1e-12
