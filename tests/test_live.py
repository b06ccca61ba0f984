"""Matching and scoring as event-time streams against the batch operators."""

import os

import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from headway.operators import events as E
from headway.operators import ingest as IN
from headway.operators import matching as M
from headway.operators import scoring as S
from headway.plans import domain as D
from headway.sources import adapters as A
from headway.streaming import live as L

SF = "/root/testdata/sf0.001"
T0 = 1705363200  # of the synthetic feeds


def landed(df, path, cut):
    """Write one file for each value of ``cut``, in its order, rows shuffled: a micro-batch each."""
    os.makedirs(path)
    t = df.withColumn("cut", cut.cast("long")).orderBy(F.rand(7)).toArrow()
    for i, v in enumerate(sorted(set(t["cut"].to_pylist()))):
        f = f"{path}/{i}.parquet"
        pq.write_table(t.filter(pc.equal(t["cut"], v)).drop_columns(["cut"]), f)
        os.utime(f, (10**9 + i, 10**9 + i))  # the file source takes the oldest first


def run(spark, make, tmp, p, f, name):
    ins = [spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(path)) for d, path in ((p, tmp / "p"), (f, tmp / "f"))]
    q = L.start_live(make(*ins), str(tmp / name), str(tmp / f"{name}-ckpt"))
    assert q.awaitTermination(600) and q.exception() is None
    out = spark.read.parquet(str(tmp / name))
    return out, q.recentProgress


def rows(df, cols):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*cols).collect()), key=repr)


def end_of_time(spark, p, f):
    """Predictions and facts long after all others, in two files, move the watermark past them."""
    far = F.explode(F.array(*[F.lit(1706615520 + d * 86400).cast("long") for d in (10, 20)]))
    last_p = p.limit(1).withColumn("file_timestamp", far).withColumn("id", F.lit("-1").cast(p.schema["id"].dataType))
    last_p = last_p.withColumn("arrival_time", F.col("file_timestamp") + 100)  # a row that is not scored tells a scoring stream no time
    last_f = f.limit(1).withColumn("fact_time", far)
    return p.unionByName(last_p), f.unionByName(last_f)


def test_match_and_score_streams_equal_batch(spark, tmp_path):
    events = D.vehicle_events(spark, SF)
    p = D.predictions(spark, SF).drop("file_date")
    matches = M.match_all(p, E.event_touches(events))
    assert matches.count() > 0
    p2, f2 = end_of_time(spark, p, L.event_facts(events))
    day = lambda c: F.floor(F.col(c) / 345600)
    landed(p2, str(tmp_path / "p"), day("file_timestamp"))
    landed(f2, str(tmp_path / "f"), day("fact_time"))
    got, progress = run(spark, L.match_stream, tmp_path, p2, f2, "matches")
    assert len(progress) > 5 and L.refused(progress) == 0
    assert rows(got, M.MATCH_COLUMNS) == rows(matches, M.MATCH_COLUMNS)
    got, progress = run(spark, L.score_stream, tmp_path, p2, f2, "accuracy")
    exp = S.score(p, matches)
    got = got.filter(F.col("block_start") < 1706615520)  # without the rows that moved the watermark
    assert L.refused(progress) == 0 and exp.filter("num_accurate_predictions < num_predictions").count() > 0
    assert rows(got, exp.columns) == rows(exp, exp.columns)


def made(spark, ps, fs):
    """Predictions ``(file time, vehicle, arrival)`` and arrivals ``(time, vehicle)`` at one stop."""
    cols = "id string, environment string, vehicle_id string, trip_id string, route_id string, direction_id int, stop_id string, file_timestamp long, arrival_time long, departure_time long, kind string, nth_at_stop int"
    p = [(f"{t}/{v}/{i}", "prod", v, "t", "Red", 0, "s", t, a, None, "mid_trip", 1) for i, (t, v, a) in enumerate(ps)]
    f = [("prod", "t", 0, v, "s", t, t, None, None, t, True) for t, v in fs]
    return spark.createDataFrame(p, cols), spark.createDataFrame(f, L.FACT_SCHEMA)


def test_unmatched_come_out_once_and_late_ones_are_counted(spark, tmp_path):
    day = 86400
    ps = [(T0 + 10, "a", T0 + 200), (T0 + 20, "b", T0 + 200), (T0 + 30, "late", T0 + 90)]
    ps += [(T0 + d * day + 7, "z", T0 + d * day + 60) for d in (1, 2, 4)]
    fs = [(T0 + 190, "a"), (T0 + 195, "b"), *[(T0 + d * day, "x") for d in (1, 2, 4)]]
    p, f = made(spark, ps, fs)
    # a row is late by the watermark of the batch before; two days later it is for both
    cut = lambda t, late: F.when(late, 3).otherwise(F.floor((F.col(t) - T0) / day)).cast("long")
    landed(p, str(tmp_path / "p"), cut("file_timestamp", F.col("vehicle_id") == "late"))
    landed(f, str(tmp_path / "f"), cut("fact_time", F.col("vehicle_id") == "b"))
    got, progress = run(spark, L.score_stream, tmp_path, p, f, "out")
    # of a and b in the first block, a was matched; what vehicle b did was told three days later
    assert rows(got, ["block_start", "num_predictions", "num_accurate_predictions"]) == [(T0, 2, 1), (T0 + day, 1, 0), (T0 + 2 * day, 1, 0)]
    assert L.refused(progress) >= 2


def test_state_does_not_grow(spark, tmp_path):
    ps = [(T0 + h * 3600 + k * 60 + 7, f"v{k}", T0 + h * 3600 + 1200) for h in range(0, 168, 12) for k in range(20)]
    fs = [(T0 + h * 3600 + 1190, f"v{k}") for h in range(0, 168, 12) for k in range(20)]
    p, f = made(spark, ps, fs)
    landed(p, str(tmp_path / "p"), F.floor((F.col("file_timestamp") - T0) / 43200))
    landed(f, str(tmp_path / "f"), F.floor((F.col("fact_time") - T0) / 43200))
    got, progress = run(spark, L.match_stream, tmp_path, p, f, "out")
    kept = [sum(op["numRowsTotal"] for op in b["stateOperators"]) for b in progress if b["numInputRows"]]
    assert len(kept) == 14 and max(kept[7:]) <= max(kept[:7]) <= 200
    assert got.count() == 13 * 20


def test_ranks_of_pages_that_land_apart(spark, tmp_path):
    docs = A.trip_update_docs(spark, SF)
    exp = IN.flatten_trip_updates(docs).withColumn("id", IN.prediction_id())
    raw = IN.trip_update_rows(docs).withColumn("id", IN.prediction_id())
    one = raw.limit(1).withColumn("file_timestamp", F.lit(T0 + 400 * 86400).cast("long")).withColumn("id", F.lit("last"))
    raw = raw.unionByName(raw.filter("update_pos = 0")).unionByName(one)  # some twice
    path = str(tmp_path / "raw")
    # odd updates of a day land one file after the even ones
    landed(raw, path, F.floor(F.col("file_timestamp") / 345600) * 2 + F.col("update_pos") % 2)
    src = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = L.start_live(L.ranked_stream(src, "5 days"), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    assert q.awaitTermination(600) and L.refused(q.recentProgress) == 0
    cols = ["id", "stop_id", "nth_at_stop", "trip_id", "arrival_time"]
    assert rows(spark.read.parquet(str(tmp_path / "out")), cols) == rows(exp, cols)
