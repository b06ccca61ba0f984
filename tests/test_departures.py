import datetime as dt

from headway.operators import departures as DP

EV = ("environment string, vehicle_id string, stop_id string, arrival_snapshot long, trip_id string, route_id string, "
      "is_deleted boolean, departure_time long")
MP = ("id long, environment string, route_id string, stop_id string, trip_id string, vehicle_id string, "
      "file_timestamp long, departure_time long, ev_environment string, ev_vehicle_id string, ev_stop_id string, "
      "ev_arrival_snapshot long, matched boolean")
DAY = dt.date(2019, 7, 1)
LO, HI = 1561968000, 1561968000 + 22 * 3600


def _ev(spark, rows):
    return spark.createDataFrame(rows, EV)


def _mp(spark, rows):
    return spark.createDataFrame(rows or [], MP)


def test_service_window_and_exclusions(spark):
    ev = _ev(spark, [
        ("prod", "v1", "70061", 1, "t1", "Red", False, LO + 60),      # 04:01 in
        ("prod", "v2", "70061", 2, "t2", "Red", False, HI - 60),      # 01:59 next day in
        ("prod", "v3", "70061", 3, "t3", "Red", False, LO - 60),      # 03:59 out
        ("prod", "v4", "70061", 4, "t4", "Red", False, HI + 60),      # 02:01 out
        ("prod", "v5", "70061", 5, "t5", "Red", True, LO + 60),       # deleted
        ("prod", "v6", "70061", 6, None, "Red", False, LO + 60),      # no trip
        ("prod", "v7", "70063", 7, "t7", "Red", False, LO + 60),      # not a terminal
        ("prod", "v8", "70061", 8, "t8", "Red", None, LO + 60),       # null is_deleted
    ])
    [r] = DP.unpredicted_summary(ev, _mp(spark, []), date=DAY, env="prod").collect()
    assert (r.route_id, r.departures, r.unpredicted, r.pct_unpredicted) == ("Red", 2, 2, 100.0)
    assert DP.unpredicted_summary(ev, _mp(spark, []), date=dt.date(2019, 7, 5), env="prod").count() == 0


def test_prediction_before_departure_counts(spark):
    ev = _ev(spark, [("prod", f"v{i}", "70197", i, f"t{i}", "Green-C", False, LO + 600) for i in range(4)])
    mp = _mp(spark, [
        (1, "dev-green", "Green-C", "70197", "t0", "v0", LO + 100, LO + 600, "prod", "v0", "70197", 0, True),  # any env counts
        (2, "prod", "Green-C", "70197", "t1", "v1", LO + 700, LO + 600, "prod", "v1", "70197", 1, True),  # after departure
        (3, "prod", "Green-C", "70197", "t2", "v2", LO + 100, None, "prod", "v2", "70197", 2, True),  # no departure time
    ])
    stops = spark.createDataFrame([("70197", "Park Street - Green Line - (C) Cleveland Circle")], "id string, description string")
    [r] = DP.unpredicted_by_stop(ev, mp, stops, route_id="Green-C", date=DAY, env="prod").collect()
    assert (r.stop_id, r.stop_name, r.departures, r.unpredicted, r.pct_unpredicted) == (
        "70197", "Park Street - Green Line - (C) Cleveland Circle", 4, 3, 75.0)
    detail = DP.unpredicted_detail(ev, mp, route_id="Green-C", stop_id="70197", date=DAY, env="prod").collect()
    assert [(d.vehicle_id, d.departure) for d in detail][0] == ("v1", "2019-07-01 04:10:00 EDT")


def test_unknown_stop_name_falls_back_to_id(spark):
    ev = _ev(spark, [("prod", "v1", "70036", 1, "t1", "Orange", False, LO + 60), ("prod", "v2", "70036", 2, "t2", "Orange", False, LO + 60)])
    mp = _mp(spark, [(1, "prod", "Orange", "70036", "t1", "v1", LO, LO + 60, "prod", "v1", "70036", 1, True)])
    stops = spark.createDataFrame([("other", "x")], "id string, description string")
    [r] = DP.unpredicted_by_stop(ev, mp, stops, route_id="Orange", date=DAY, env="prod").collect()
    assert (r.stop_id, r.stop_name, r.departures, r.unpredicted, r.pct_unpredicted) == ("70036", "70036", 2, 1, 50.0)


def test_route_order(spark):
    rows = [("prod", f"v{i}", "70061", i, f"t{i}", r, False, LO + 60) for i, r in enumerate(["Mattapan", "Blue", "Red", "Zed"])]
    got = [r.route_id for r in DP.unpredicted_summary(_ev(spark, rows), _mp(spark, []), date=DAY, env="prod").collect()]
    assert got == ["Red", "Zed", "Blue", "Mattapan"]


def test_missed_departures(spark):
    mp = _mp(spark, [
        (1, "prod", "route1", "70061", "trip1", "v1", LO + 10, LO + 600, None, None, None, None, False),
        (2, "prod", "route1", "70061", "trip1", "v1", LO + 70, LO + 660, None, None, None, None, False),
        (3, "prod", "route1", "70061", "trip2", "v2", LO + 10, LO + 600, "prod", "v2", "70061", 5, True),
        (4, "prod", "route1", "70061", "trip2", "v2", LO + 20, LO + 620, None, None, None, None, False),
        (5, "prod", "route1", "70061", "trip3", "v3", LO + 10, LO + 600, "prod", "v3", "70061", 6, True),
    ])
    [r] = DP.missed_summary(mp, date=DAY, env="prod").collect()
    assert (r.route_id, r.trips, r.missed_trips) == ("route1", 3, 2)
    t = DP.totals(DP.missed_summary(mp, date=DAY, env="prod"), "trips", "missed_trips", []).first()
    assert (t.total_trips, t.total_missed_trips) == (3, 2)
    det = DP.missed_detail(mp, route_id="route1", stop_id="70061", date=DAY, env="prod").collect()
    assert [(d.vehicle_id, d.trip_id, d.predictions) for d in det] == [("v1", "trip1", 2), ("v2", "trip2", 1)]
    assert det[0].first_departure == "2019-07-01 04:10:00 EDT"


def test_totals_zero_base(spark):
    s = spark.createDataFrame([("r", 0, 0)], "route_id string, departures long, unpredicted long")
    assert DP.totals(s, "departures", "unpredicted", []).first().total_pct == 0.0
