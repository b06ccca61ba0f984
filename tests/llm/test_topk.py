"""Exact top-k against sorting all scores."""

import math
import random

import pytest
from pyspark.sql import functions as F

from headway.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=50, k=5):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in good:
        if i % every == 0:
            queries[i] = min(v, queries.get(i, v))
    out = []
    for i, q in queries.items():
        scores = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in good if j != i and len(v) == len(q))
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA).repartition(parts)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def vectors(seed, n, dim, values):
    rng = random.Random(seed)
    return [(i, [values(rng) for _ in range(dim)]) for i in range(n)]


@pytest.mark.parametrize("values", [lambda r: r.gauss(0, 0.2), lambda r: r.choice([-1.0, 0.0, 1.0]), lambda r: r.gauss(0, 3e4)])
def test_equals_sorting_everything(spark, values):
    rows = vectors(1, 400, 6, values)
    rows = [(i, [float(f) for f in spark_float(v)]) for i, v in rows]
    assert got(topk.top_k(table(spark, rows))) == brute(rows)


def spark_float(v):
    import numpy as np

    return np.array(v, dtype=np.float32).tolist()


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_VALUES", 8)
    rows = [(i, spark_float(v)) for i, v in vectors(2, 350, 3, lambda r: r.gauss(0, 1))]
    assert got(topk.top_k(table(spark, rows))) == brute(rows)


def test_one_very_common_vector(spark):
    rows = [(i, [1.0, 0.5]) for i in range(300)] + [(i, spark_float(v)) for i, v in vectors(3, 60, 2, lambda r: r.gauss(0, 1))[0:0]]
    rows += [(300 + i, [0.25 * (i % 3), 2.0]) for i in range(60)]
    assert got(topk.top_k(table(spark, rows, 5))) == brute(rows)


def test_nulls_odd_lengths_repeats_and_extra_columns(spark):
    rows = [(0, [1.0, 2.0]), (50, [float("nan"), 1.0]), (100, [0.5, None]), (150, None), (None, [1.0, 1.0]), (200, [1.0]), (1, [1.0]), (250, []), (2, []), (3, [3.0, 1.0]), (3, [3.0, 1.0]), (4, [float("inf"), 0.0]), (300, [1.0, -1.0]), (-50, [2.0, 2.0])]
    df = table(spark, rows).withColumn("id", F.lit("x")).withColumn("v", F.lit(1)).withColumn("score", F.lit(None).cast("int"))
    assert got(topk.top_k(df)) == brute(rows)


def test_empty_table(spark):
    assert topk.top_k(table(spark, [])).count() == 0
