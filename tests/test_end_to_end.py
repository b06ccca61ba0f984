"""Positions -> dwells -> touches -> matches -> accuracy rows -> departure reports."""

import datetime as dt

from headway.operators import departures as DP
from headway.operators import events as E
from headway.operators import matching as M
from headway.operators import scoring as S
from headway.functions.times import service_day_window

POS = ("environment string, mode string, id string, label string, is_deleted boolean, trip_id string, "
       "route_id string, direction_id int, current_status string, stop_id string, timestamp long, snapshot_time long")
PRED = ("id long, file_timestamp long, environment string, trip_id string, vehicle_id string, stop_id string, "
        "route_id string, arrival_time long, departure_time long, direction_id int, kind string, nth_at_stop int")

DAY = dt.date(2019, 7, 1)
T0 = service_day_window(DAY)[0] + 3 * 3600 + 17  # 07:00:17 local, inside the departure service day


def _chain(spark, preds):
    pos = spark.createDataFrame(
        [("prod", "subway", "v1", "L1", False, "trip1", "Red", 0, st, stop, ts, ts)
         for st, stop, ts in [("INCOMING_AT", "70061", T0), ("STOPPED_AT", "70061", T0 + 60), ("IN_TRANSIT_TO", "70063", T0 + 120)]],
        POS,
    )
    snaps = pos.select("environment", "mode", "snapshot_time").distinct()
    ev = E.vehicle_events(E.vehicle_transitions(pos, snaps))
    p = spark.createDataFrame(preds, PRED)
    m = M.match_all(p, E.event_touches(ev))
    return ev, p, m


def test_terminal_match_scored_accurate(spark):
    arr = T0 + 60
    preds = [(i, arr - err - 400, "prod", "trip1", None, "70061", "Red", arr - err, None, 0, None, None)
             for i, err in [(1, 15), (2, 45)]]
    ev, p, m = _chain(spark, preds)
    assert {r.prediction_id: r.match_type for r in m.collect()} == {1: "terminal", 2: "terminal"}
    rows = S.score(p, m).collect()
    assert [(r.bin, r.num_predictions, r.num_accurate_predictions, r.mean_error) for r in rows] == [("6-12 min", 2, 2, 30.0)]


def test_departure_reports(spark):
    dep = T0 + 120
    preds = [
        # linked to the dwell and made before the departure: the departure counts as predicted
        (1, T0 + 30, "prod", "trip1", "v1", "70061", "Red", None, dep + 5, 0, None, 1),
        # same trip, never linked (other stop): the trip counts as unrealised at 70065
        (2, T0 + 30, "prod", "trip2", "v9", "70065", "Red", None, dep + 5, 0, None, 1),
    ]
    ev, p, m = _chain(spark, preds)
    mp = M.with_matches(p, m)
    [u] = DP.unpredicted_summary(ev, mp, date=DAY, env="prod").collect()
    assert (u.route_id, u.departures, u.unpredicted, u.pct_unpredicted) == ("Red", 1, 0, 0.0)
    got = {(r.stop_id, r.trips, r.missed_trips) for r in DP.missed_by_stop(
        mp.withColumn("stop_id", mp.stop_id), spark.createDataFrame([], "id string, description string"),
        route_id="Red", date=DAY, env="prod").collect()}
    # 70065 is not a terminal, so only the matched terminal trip is reported
    assert got == {("70061", 1, 0)}
