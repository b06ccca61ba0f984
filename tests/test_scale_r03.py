"""Growth of the jobs named in FINDINGS_r03, on rows built here."""

import datetime as dt
import re

from pyspark.sql import functions as F

from headway.functions.times import service_day_window
from headway.operators import departures as DP
from headway.operators import events as E
from headway.operators import ingest as IN
from headway.operators import matching as M
from headway.plans import catalog as C
from headway.plans import domain as D
from headway.sources import adapters as A


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _events(spark, path):
    rows = [
        (i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=37 * i), i % 7 if i % 50 else None,
         ["click", "view", "purchase", "signup", "error"][i % 5], float(i % 90), '{"k": %d}' % (i % 100) if i % 41 else None)
        for i in range(1500)
    ]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    df.write.parquet(f"{path}/events.parquet")
    return str(path)


def test_feed_scores_parse_each_document_once(spark, tmp_path):
    """scoring reads stored tables, never the documents again."""
    d = _events(spark, tmp_path)
    for name in ("score_subway_feeds", "score_cr_feeds"):
        df = C.REGISTRY[name][0](spark, d)
        assert "FileScan json" not in _plan(df), name
        assert df.count() > 0


def test_trip_update_documents_need_one_exchange(spark, tmp_path):
    """the events are dealt once, while narrow; the landed files are compressed."""
    d = _events(spark, tmp_path)
    docs = A.trip_update_docs(spark, d)
    assert len(re.findall(r"Exchange hashpartitioning", _plan(docs))) == 1
    n = docs.select(F.explode("entity").alias("e")).select(F.explode("e.trip_update.stop_time_update")).count()
    raw = A.predictions_raw(spark, d)
    assert n == raw.count() + raw.filter(F.pmod(A.idiv(F.col("file_timestamp"), 60), F.lit(10)) == 0).count()
    assert all(f.endswith(".json.gz") for f in D.landed(spark, d, "trip_updates").inputFiles())


def test_accuracy_lines_are_narrow(spark, tmp_path):
    """no text is shuffled, the rows come out as before."""
    li = [
        (1, 1000, 35, 3, 17.0, 1234.56, 0.05, "A", "O"),
        (1, None, 36, 4, 18.0, 200.0, 0.1, "R", "F"),
        (2, 191, None, 7, None, None, 0.0, None, None),
    ]
    spark.createDataFrame(
        li, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
            "l_discount double, l_returnflag string, l_linestatus string",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(
        [(1, dt.datetime(1996, 3, 5)), (2, dt.datetime(1996, 3, 6))], "o_orderkey long, o_orderdate timestamp_ntz"
    ).write.parquet(f"{tmp_path}/orders.parquet")
    assert "string" not in {t for _, t in A.accuracy_lines(spark, str(tmp_path)).dtypes}
    got = {r["bin"]: r for r in D.accuracy_hist(spark, str(tmp_path)).collect()}
    a, b, c = got["6-8 min"], got["8-10 min"], got["12-30 min"]
    assert (a["environment"], a["minute_of_hour"], a["hour_of_day"]) == ("dev-blue", 55, 3 + 1000 % 24)
    assert (a["route_id"], a["stop_id"]) == (A.ROUTE[1000 % 8], A.STOP[1000 // 8 % 8])
    assert (a["kind"], a["in_next_two"], a["num_predictions"], a["num_accurate_predictions"]) == ("at_terminal", True, 17, 12)
    assert round(a["mean_error"], 2) == -65.44 and round(a["root_mean_squared_error"], 2) == 34.56
    assert (b["hour_of_day"], b["kind"], b["direction_id"], b["num_accurate_predictions"]) == (None, None, 0, 9)
    assert (c["minute_of_hour"], c["num_predictions"], c["in_next_two"], c["mean_error"]) == (None, None, None, None)


def test_events_are_parsed_once_and_predictions_dealt_once(spark, tmp_path):
    """what is built from the stored events parses no JSON; the rank needs one exchange of narrow rows."""
    d = _events(spark, tmp_path)
    stored = D.events(spark, d)
    p = A.predictions(spark, d, stored)
    for df in (A.vehicle_positions(spark, d, stored), A.vehicle_snapshots(spark, d, stored), p):
        assert "get_json_object" not in _plan(df)
    [dealt] = re.findall(r"Exchange hashpartitioning\((\w+)#", _plan(p))
    assert dealt == "file_time"
    old = IN.rank_at_stop(IN.keep_scorable_updates(A.predictions_raw(spark, d)), tie_break=["id"])
    assert sorted(map(repr, p.collect())) == sorted(map(repr, old.collect())) and p.count() > 0
    rows = A.vehicle_positions(spark, d, stored).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, A.vehicle_positions(spark, d).collect())) and rows


def test_departure_service_day_converts_once(spark):
    """one zone conversion; the windows of every day, those of a clock change too, in any session time zone."""
    days = [dt.date(2024, 1, 15) + dt.timedelta(days=i) for i in range(366)]
    xs = {}
    for day in days:
        lo, hi = service_day_window(day)
        xs |= {lo - 1: None, lo: day, lo + 1: day, (lo + hi) // 2: day, hi - 3600: day, hi - 1: day, hi: day, hi + 1: None}
    df = spark.createDataFrame([(x,) for x in xs] + [(None,)], "x long")
    was = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Asia/Tokyo", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = {r.x: r.d for r in df.select("x", DP.departure_service_day("x").alias("d")).collect()}
            assert got == xs | {None: None}, zone
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)
    plan = _plan(df.select(DP.departure_service_day("x").alias("d")))
    assert len(re.findall(r"convert_timezone|from_utc_timestamp", plan)) <= 2  # the test of it and its value


def test_joins_sort_by_keys_of_many_values(spark, tmp_path):
    """the environment, one of three, is no first key of the joins that move every record."""
    d = _events(spark, tmp_path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p, ev = D.predictions(spark, d), D.vehicle_events(spark, d)
        plans = [
            E.vehicle_transitions(D.positions(spark, d), None, sequence=D.snapshot_log(spark, d)),
            M.match_all(p, E.event_touches(ev)),
        ]
        first = [k for df in plans for k in re.findall(r"SortMergeJoin \[(\w+)#", _plan(df))]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert first.count("environment") == 1, first  # the join to the few snapshots is the only one
