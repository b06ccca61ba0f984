import math

from headway.operators import scoring as S

PRED_SCHEMA = ("id long, file_timestamp long, environment string, trip_id string, vehicle_id string, stop_id string, "
               "route_id string, arrival_time long, departure_time long, direction_id int, kind string, nth_at_stop int")
MATCH_SCHEMA = "prediction_id long, touch_time long, ev_arrival_time long, ev_departure_time long, ev_departure_snapshot long"
FT = 1540908010  # 10 s into a 5-minute block


def _pred(i, arr, dep, kind="mid_trip", nth=3, ft=FT, stop="70063", env="prod"):
    return (i, ft, env, "t", "v", stop, "Red", arr, dep, 0, kind, nth)


def _score(spark, preds, matches, lag=None):
    p = spark.createDataFrame(preds, PRED_SCHEMA)
    m = spark.createDataFrame(matches, MATCH_SCHEMA)
    return S.score(p, m, visibility_lag_s=lag).collect()


def test_bin_counts_mean_and_rmse(spark):
    # 3-6 min bin, tolerance (-90, 120): errors 15, 45, -95, 130 -> 2 accurate
    lead = 200
    preds = [_pred(i, FT + lead, None) for i in range(4)]
    errs = [15, 45, -95, 130]
    matches = [(i, FT + 100, FT + lead + e, None, None) for i, e in enumerate(errs)]
    [r] = _score(spark, preds, matches)
    assert (r.bin, r.num_predictions, r.num_accurate_predictions) == ("3-6 min", 4, 2)
    assert math.isclose(r.mean_error, sum(errs) / 4)
    assert math.isclose(r.root_mean_squared_error, math.sqrt(sum(e * e for e in errs) / 4))
    assert (r.hour_of_day, r.minute_of_hour, str(r.service_date)) == (10, 0, "2018-10-30")


def test_tolerance_is_strict(spark):
    lead = 200
    preds = [_pred(i, FT + lead, None) for i in range(2)]
    matches = [(0, FT, FT + lead - 90, None, None), (1, FT, FT + lead + 120, None, None)]
    [r] = _score(spark, preds, matches)
    assert (r.num_predictions, r.num_accurate_predictions) == (2, 0)


def test_arrival_graded_over_departure(spark):
    # 0-3 min bin (-60, 60); arrival errors 10 and 45 accurate, departure-only 25 accurate, arrival 80 not
    lead = 100
    preds = [_pred(0, FT + lead, FT + lead + 30), _pred(1, FT + lead, FT + lead + 30),
             _pred(2, None, FT + lead), _pred(3, FT + lead, None)]
    matches = [(0, FT, FT + lead + 10, FT + lead + 500, FT), (1, FT, FT + lead + 45, None, None),
               (2, FT, None, FT + lead + 25, FT), (3, FT, FT + lead + 80, None, None)]
    [r] = _score(spark, preds, matches)
    assert (r.num_predictions, r.num_accurate_predictions) == (4, 3)
    assert math.isclose(r.mean_error, (10 + 45 + 25 + 80) / 4)


def test_in_next_two_split_and_unmatched(spark):
    preds = [_pred(i, FT + 100, None, nth=n) for i, n in enumerate([1, 2, 3, None])]
    rows = _score(spark, preds, [])
    got = {r.in_next_two: (r.num_predictions, r.num_accurate_predictions, r.mean_error) for r in rows}
    assert got == {True: (2, 0, None), False: (2, 0, None)}


def test_block_boundary_kind_and_lead_filters(spark):
    preds = [
        _pred(0, FT - 10 + 100, None, ft=FT - 10),  # exactly on the block start: never scored
        _pred(1, FT + 100, None, kind="bogus"),  # unknown kind
        _pred(2, FT - 5, None),  # predicted instant before the file time
        _pred(3, FT + 1800, None),  # lead outside every bin
        _pred(4, FT + 100, None, stop=None),  # null stop cannot be stored
        _pred(5, FT + 100, None, env="staging"),
        _pred(6, FT + 100, None, kind=None),  # null kind is its own group
    ]
    rows = _score(spark, preds, [])
    assert [(r.kind, r.num_predictions) for r in rows] == [(None, 1)]


def test_visibility_lag_masks_late_links(spark):
    lead = 100
    preds = [_pred(0, FT + lead, None), _pred(1, None, FT + lead)]
    block = FT - 10
    matches = [(0, block + 3000, FT + lead, None, None), (1, FT, None, FT + lead, block + 3000)]
    [r] = _score(spark, preds, matches, lag=2430)
    assert (r.num_predictions, r.num_accurate_predictions, r.mean_error) == (2, 0, None)
    [r] = _score(spark, preds, matches, lag=None)
    assert (r.num_predictions, r.num_accurate_predictions) == (2, 2)


def test_validate_accuracy(spark):
    df = spark.createDataFrame(
        [("prod", "6-12 min", "mid_trip", 1), ("prod", "6-8 min", None, 1), ("prod", "0-3 min", "bogus", 1),
         ("prod", "0-3 min", None, None)],
        "environment string, bin string, kind string, num_predictions int",
    )
    for c, t in [("service_date", "date"), ("hour_of_day", "int"), ("minute_of_hour", "int"), ("stop_id", "string"),
                 ("route_id", "string"), ("direction_id", "int"), ("num_accurate_predictions", "int")]:
        from pyspark.sql import functions as F

        df = df.withColumn(c, F.lit(0 if t != "string" else "x").cast(t) if t != "date" else F.current_date())
    got = [r.is_valid for r in S.validate_accuracy(df).collect()]
    assert got == [True, False, False, False]


def test_score_block_is_one_block_of_score(spark):
    preds = [_pred(0, FT + 100, None), _pred(1, FT + 400, None, ft=FT + 300)]
    p = spark.createDataFrame(preds, PRED_SCHEMA)
    m = spark.createDataFrame([], MATCH_SCHEMA)
    block = FT - 10
    one = S.score_block(p, m, block, visibility_lag_s=None).collect()
    assert [(r.block_start, r.num_predictions) for r in one] == [(block, 1)]
    assert len(S.score(p, m, visibility_lag_s=None).collect()) == 2
