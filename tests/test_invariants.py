"""Invariants: the one-pass scorer equals the per-combination loop it replaces."""

from functools import reduce

from pyspark.sql import functions as F

from headway.functions.constants import BINS, ENVIRONMENTS, KIND_VALUES
from headway.operators import scoring as S
from headway.plans import domain as D

SF = "/root/testdata/sf0.001"
KEYS = ["environment", "block_start", "route_id", "stop_id", "direction_id", "bin", "kind", "in_next_two"]


def _loop_score(preds, matches):
    """The scheduled job's shape: one grouped query per (environment, kind,
    bin, next-two), each with its own WHERE clause, unioned."""
    base = S.attach_matches(
        preds.withColumn("block_start", F.col("file_timestamp") - F.pmod("file_timestamp", F.lit(300))), matches
    )
    instant = F.coalesce("arrival_time", "departure_time")
    lead = instant - F.col("file_timestamp")
    err = F.when(F.col("arrival_time").isNotNull(), F.col("ve_arrival_time") - F.col("arrival_time")).otherwise(
        F.col("ve_departure_time") - F.col("departure_time")
    )
    parts = []
    for env in ENVIRONMENTS:
        for kind in [None, *KIND_VALUES]:
            for name, (lo, hi, emin, emax) in BINS.items():
                for nxt in (True, False):
                    kind_ok = F.col("kind").isNull() if kind is None else F.col("kind") == kind
                    nth_ok = F.col("nth_at_stop").isin(1, 2) if nxt else (
                        ~F.col("nth_at_stop").isin(1, 2) | F.col("nth_at_stop").isNull())
                    q = base.filter(
                        (F.col("environment") == env) & kind_ok & instant.isNotNull() & (instant > F.col("file_timestamp"))
                        & (lead >= lo) & (lead < hi) & nth_ok & (F.col("file_timestamp") > F.col("block_start"))
                        & F.col("stop_id").isNotNull()
                    ).withColumn("err", err)
                    parts.append(
                        q.groupBy("environment", "block_start", "route_id", "stop_id", "direction_id").agg(
                            F.count(F.lit(1)).cast("int").alias("num_predictions"),
                            F.sum(F.when((F.col("err") > emin) & (F.col("err") < emax), 1).otherwise(0)).cast("int").alias("num_accurate_predictions"),
                            F.avg("err").alias("mean_error"),
                        ).withColumn("bin", F.lit(name)).withColumn("kind", F.lit(kind).cast("string")).withColumn("in_next_two", F.lit(nxt))
                    )
    return reduce(lambda a, b: a.unionByName(b), parts)


def _rows(df):
    cols = KEYS + ["num_predictions", "num_accurate_predictions", "mean_error"]
    return sorted(
        (tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect()), key=str
    )


def test_one_pass_equals_96_query_loop(spark):
    preds, matches = D.predictions(spark, SF), D.matches(spark, SF)
    assert _rows(S.score(preds, matches)) == _rows(_loop_score(preds, matches))


def test_bin_counts_sum_to_eligible_rows(spark):
    preds, matches = D.predictions(spark, SF), D.matches(spark, SF)
    total = S.score(preds, matches).agg(F.sum("num_predictions")).first()[0]
    assert total == S.scorable_predictions(preds).count() > 0
