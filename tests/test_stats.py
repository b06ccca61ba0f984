import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from headway.functions.columns import accuracy_percentage
from headway.operators import filters as FL
from headway.operators import stats as ST
from headway.functions.constants import expand_stop_groups

ACC = ("environment string, service_date date, hour_of_day int, minute_of_hour int, route_id string, stop_id string, "
       "direction_id int, bin string, kind string, in_next_two boolean, num_predictions int, "
       "num_accurate_predictions int, mean_error double, root_mean_squared_error double")
D1, D2 = dt.date(2019, 1, 1), dt.date(2019, 1, 2)


def _acc(spark, rows):
    full = [(e, d, h, m, "Red", "70061", 0, "0-3 min", "mid_trip", True, n, a, me, rm) for e, d, h, m, n, a, me, rm in rows]
    return spark.createDataFrame(full, ACC)


def test_hourly_and_daily(spark):
    df = _acc(spark, [("prod", D1, 10, 0, 101, 99, 1.0, 1.0), ("prod", D1, 10, 5, 108, 102, 1.0, 1.0),
                      ("prod", D2, 11, 0, 225, 211, 1.0, 1.0), ("prod", D2, 11, 5, 270, 261, 1.0, 1.0)])
    h = [(r.hour_of_day, r.num_predictions, r.num_accurate_predictions) for r in ST.stats_by_chart_range(df, "Hourly").collect()]
    assert h == [(10, 209, 201), (11, 495, 472)]
    d = [(r.service_date, r.num_predictions, r.num_accurate_predictions) for r in ST.stats_by_chart_range(df, "Daily").collect()]
    assert d == [(D1, 209, 201), (D2, 495, 472)]


def test_pooled_errors(spark):
    df = _acc(spark, [("prod", D1, 10, 0, 5, 0, 5.0, 5.0), ("prod", D1, 10, 5, 10, 0, -10.0, 10.0)])
    [r] = ST.accuracy_context(df).collect()
    assert math.isclose(r.mean_error, -5.0)
    df = _acc(spark, [("prod", D1, 10, 0, 5, 0, 5.0, 5.0), ("prod", D1, 10, 5, 10, 0, 10.0, 10.0)])
    [r] = ST.accuracy_context(df).collect()
    assert math.isclose(r.root_mean_squared_error, math.sqrt(75))


def test_subhourly_buckets(spark):
    rows = [("prod", D1, 10, m, 352, 336, 0.0, 0.0) for m in range(0, 60, 5)]
    df = _acc(spark, rows)
    out = ST.stats_by_chart_range(df, "Hourly", resolution="15").collect()
    assert [r.resolution_bucket for r in out] == [0, 15, 30, 45]
    assert sum(r.num_predictions for r in out) == 4224
    assert sum(r.num_accurate_predictions for r in out) == 4032


def test_env_alignment_fills_zero(spark):
    df = _acc(spark, [("prod", D1, 10, 0, 10, 5, 1.0, 1.0), ("dev-green", D1, 11, 0, 4, 4, 1.0, 1.0)])
    rows = {r.hour_of_day: r for r in ST.env_comparison(df, "Hourly").collect()}
    assert (rows[10].prod_num_predictions, rows[10].dev_green_num_predictions, rows[10].dev_green_mean_error) == (10, 0, None)
    assert (rows[11].prod_num_predictions, rows[11].dev_green_num_accurate) == (0, 4)


def test_percentages(spark):
    df = spark.createDataFrame([(201, 209), (872, 1095), (323, 840), (135, 216), (1, 0)], "a int, n int")
    got = [r.p for r in df.select(accuracy_percentage("a", "n").alias("p")).collect()]
    assert got == [96.17, 79.63, 38.45, 62.5, 0.0]


def test_export_rows_header(spark, tmp_path):
    df = _acc(spark, [("prod", D1, 10, 0, 10, 5, 1.4, 2.6), ("dev-green", D1, 10, 0, 3, 3, 1.0, 1.0)])
    rows = ST.export_rows(df, "Hourly")
    ST.write_csv(rows, str(tmp_path / "out"), "Hourly")
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*.csv")))
    assert text.splitlines()[0] == "Hourly,Prod Accuracy,Err,RMSE,Count"
    assert "10,50.0,1.0,3.0,10" in text


def test_filter_errors(spark):
    df = _acc(spark, [("prod", D1, 10, 0, 10, 5, 1.0, 1.0)])
    assert FL.filter_accuracy(df, {"chart_range": "Daily"})[1] == "No start or end date given."
    assert FL.filter_accuracy(df, {"chart_range": "Hourly"})[1] == "No service date given."
    q, err = FL.filter_accuracy(df, {"chart_range": "Daily", "date_start": "2019-01-01", "date_end": "2019-02-06"})
    assert err == "Dates can't be more than 5 weeks apart" and q.count() == 0
    assert FL.filter_accuracy(df, {"chart_range": "Daily", "date_start": "2019-01-02", "date_end": "2019-01-01"})[1] == "Start date is after end date"
    assert FL.filter_accuracy(df, {"chart_range": "Hourly", "service_date": "nope"})[1] == "Can't parse service date."
    q, err = FL.filter_accuracy(df, {"chart_range": "Hourly", "service_date": "2019-01-01"})
    assert err is None and q.count() == 1


def test_each_filter(spark):
    rows = [
        ("prod", D1, 10, 0, "Red", "70061", 0, "0-3 min", "mid_trip", True, 1, 1, 0.0, 0.0),
        ("prod", D1, 10, 0, "Blue", "70838", 1, "3-6 min", "at_terminal", False, 1, 1, 0.0, 0.0),
        ("prod", D1, 10, 0, "CR-Lowell", "X", 1, "3-6 min", None, None, 1, 1, 0.0, 0.0),
    ]
    df = spark.createDataFrame(rows, ACC)
    assert FL.filter_by_route(df, "Red,CR-Lowell", "subway").count() == 1
    assert FL.filter_by_route(df, "CR-Lowell", "subway").count() == 0
    assert FL.filter_by_route(df, "", None).count() == 3
    assert FL.filter_by_route(df, None, "commuter_rail").count() == 1
    assert FL.filter_by_stop(df, ["_terminal"]).count() == 1
    assert FL.filter_by_direction(df, "1").count() == 2
    assert FL.filter_by_direction(df, "2").count() == 3
    assert FL.filter_by_bin(df, "All").count() == 3
    assert FL.filter_by_bin(df, "0-3 min").count() == 1
    assert FL.filter_by_kind(df, ["mid_trip", None]).count() == 1
    assert FL.filter_by_in_next_two(df, "true").count() == 1
    assert FL.filter_by_in_next_two(df, "false").count() == 1
    assert "70105" in expand_stop_groups(["_braintree_branch"])


def test_accuracy_report(spark):
    df = _acc(spark, [("prod", D1, 10, 0, 10, 5, 1.0, 1.0), ("dev-green", D1, 10, 5, 4, 4, 1.0, 1.0),
                      ("prod", D2, 11, 0, 7, 7, 1.0, 1.0)])
    rows, ctx, err = ST.accuracy_report(df, {"chart_range": "Hourly", "service_date": "2019-01-01",
                                             "timeframe_resolution": "15"})
    assert err is None
    assert [(r.hour_of_day, r.resolution_bucket, r.prod_num_predictions, r.dev_green_num_predictions) for r in rows.collect()] == [(10, 0, 10, 4)]
    assert {r.environment: r.num_predictions for r in ctx.collect()} == {"prod": 10, "dev-green": 4}
    rows, ctx, err = ST.accuracy_report(df, {"chart_range": "Daily"})
    assert err == "No start or end date given." and rows.count() == 0 and ctx.count() == 0


def test_export_subhourly_labels(spark):
    df = _acc(spark, [("prod", D1, 25, m, 10, 5, 1.0, 1.0) for m in (0, 5, 20)])
    got = [(r["Hourly"], r["Count"]) for r in ST.export_rows(df, "Hourly", resolution="15").collect()]
    assert got == [("25:00", 20), ("25:15", 10)]
