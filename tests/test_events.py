from headway.operators import events as E
from headway.operators import matching as M

POS = ("environment string, mode string, id string, label string, is_deleted boolean, trip_id string, "
       "route_id string, direction_id int, current_status string, stop_id string, timestamp long, snapshot_time long")


def _pos(spark, rows, route="Red"):
    full = [("prod", "subway", v, "L" + v, False, "trip1", route, 0, st, stop, ts, ts) for v, st, stop, ts in rows]
    df = spark.createDataFrame(full, POS)
    snaps = df.select("environment", "mode", "snapshot_time").distinct()
    return df, snaps


def _events(spark, rows, route="Red"):
    p, s = _pos(spark, rows, route)
    return E.vehicle_events(E.vehicle_transitions(p, s)), p, s


def test_arrival_then_departure(spark):
    ev, _, _ = _events(spark, [("v1", "INCOMING_AT", "A", 100), ("v1", "STOPPED_AT", "A", 200), ("v1", "IN_TRANSIT_TO", "B", 230)])
    [r] = ev.collect()
    assert (r.stop_id, r.arrival_time, r.departure_time, r.closed_with) == ("A", 200, 230, 1)


def test_stopped_to_stopped_elsewhere_and_first_sight(spark):
    ev, _, _ = _events(spark, [("v1", "STOPPED_AT", "A", 100), ("v1", "STOPPED_AT", "B", 160)])
    got = sorted((r.stop_id, r.arrival_time, r.departure_time) for r in ev.collect())
    assert got == [("A", 100, 160), ("B", 160, None)]


def test_moving_to_stopped_at_other_stop_records_nothing(spark):
    p, s = _pos(spark, [("v1", "IN_TRANSIT_TO", "A", 100), ("v1", "STOPPED_AT", "B", 160), ("v1", "STOPPED_AT", "B", 220)])
    t = {r.snapshot_time: r.transition for r in E.vehicle_transitions(p, s).collect()}
    assert t == {100: "new", 160: "none", 220: "none"}


def test_absent_for_one_snapshot_is_new_again(spark):
    rows = [("v1", "STOPPED_AT", "A", 100), ("v2", "STOPPED_AT", "X", 200), ("v1", "STOPPED_AT", "A", 300)]
    p, s = _pos(spark, rows)
    t = {(r.id, r.snapshot_time): r.transition for r in E.vehicle_transitions(p, s).collect()}
    assert t[("v1", 300)] == "new_arrival"
    dropped = {(r.snapshot_time, r.dropped, r.labels) for r in E.dropped_vehicles(p, s).collect()}
    assert dropped == {(200, 1, "Lv1"), (300, 1, "Lv2")}


def test_two_open_dwells_closed_at_once(spark):
    rows = [("v1", "STOPPED_AT", "A", 1000), ("v1", "INCOMING_AT", "A", 1500), ("v1", "STOPPED_AT", "A", 1800),
            ("v1", "IN_TRANSIT_TO", "B", 2200)]
    ev, _, _ = _events(spark, rows, route="Red")
    assert sorted((r.arrival_time, r.departure_time, r.closed_with) for r in ev.collect()) == [(1000, 2200, 2), (1800, 2200, 2)]
    [a] = E.departure_anomalies(ev).collect()
    assert a.dwells_closed == 2
    # an anomalous departure touches no predictions
    touches = E.event_touches(ev).collect()
    assert sorted(r.touch_time for r in touches) == [1000, 1800]


def test_mattapan_dwell_limit_is_strict(spark):
    rows = [("v1", "STOPPED_AT", "A", 1000), ("v1", "INCOMING_AT", "A", 1500), ("v1", "STOPPED_AT", "A", 1800),
            ("v1", "IN_TRANSIT_TO", "B", 2200)]
    ev, _, _ = _events(spark, rows, route="Mattapan")
    assert sorted((r.arrival_time, r.departure_time, r.closed_with) for r in ev.collect()) == [(1000, None, None), (1800, 2200, 1)]


def test_missing_required_field_rejects_event(spark):
    df = spark.createDataFrame([("prod", "subway", "v1", "  ", False, "t", "Red", 0, "STOPPED_AT", "A", 100, 100)], POS)
    ev = E.vehicle_events(E.vehicle_transitions(df, df.select("environment", "mode", "snapshot_time")))
    assert ev.count() == 0


PRED = "id long, environment string, vehicle_id string, trip_id string, direction_id int, stop_id string, file_timestamp long"


def test_matching_windows(spark):
    ev, _, _ = _events(spark, [("v1", "STOPPED_AT", "A", 10000)])
    preds = spark.createDataFrame(
        [(1, "prod", "v1", "x", 0, "A", 9990), (2, "prod", "v1", "x", 0, "A", 9900), (3, "prod", "v1", "x", 0, "B", 9990),
         (4, "prod", "v1", "x", 0, "A", 10000 - 3600), (5, "prod", "v1", "x", 0, "A", 10000 - 1800),
         (6, "prod", None, "trip1", 0, "A", 10000 - 2400), (7, "prod", None, "trip1", 0, "A", 10000 - 2401),
         (8, "prod", None, "trip1", 1, "A", 9990), (9, "prod", "v1", "x", 0, "A", 10001)],
        PRED,
    )
    m = {r.prediction_id: r.match_type for r in M.match_all(preds, E.event_touches(ev)).collect()}
    assert m == {1: "standard", 2: "standard", 6: "terminal"}
    filled = {r.id: r.vehicle_id for r in M.with_matches(preds, M.match_all(preds, E.event_touches(ev))).collect()}
    assert filled[6] == "v1"


def test_prediction_made_during_dwell_matches_at_departure(spark):
    ev, _, _ = _events(spark, [("v1", "STOPPED_AT", "A", 10000), ("v1", "IN_TRANSIT_TO", "B", 10100)])
    preds = spark.createDataFrame([(1, "prod", "v1", "x", 0, "A", 10050)], PRED)
    [r] = M.match_all(preds, E.event_touches(ev)).collect()
    assert (r.touch_time, r.ev_arrival_snapshot, r.ev_departure_time) == (10100, 10000, 10100)


def test_first_touch_wins(spark):
    rows = [("v1", "STOPPED_AT", "A", 10000), ("v1", "IN_TRANSIT_TO", "B", 10100), ("v1", "STOPPED_AT", "A", 10200)]
    ev, _, _ = _events(spark, rows)
    preds = spark.createDataFrame([(1, "prod", "v1", "x", 0, "A", 9999)], PRED)
    [r] = M.match_all(preds, E.event_touches(ev)).collect()
    assert r.touch_time == 10000


def test_hot_vehicle_stop_pairs_stay_bounded(spark):
    """One vehicle cycling at one stop for 50 hours (stopped at A, moving to
    B, incoming at A, ...): 1000 arrivals and 1000 departures on the same
    (environment, vehicle, stop).  A plain equi-join would pair ~500k
    candidates; the bucketed joins pair a few rows per arrival / prediction."""
    t = 1_700_000_000
    cycle = [("STOPPED_AT", "A"), ("IN_TRANSIT_TO", "B"), ("INCOMING_AT", "A")]
    rows = [("v1", *cycle[i % 3], t + 60 * i) for i in range(3000)]
    p, s = _pos(spark, rows)
    tr = E.vehicle_transitions(p, s)
    arr, dep = E.arrivals(tr), E.departures(tr)
    n_arr = arr.count()
    assert n_arr == 1000 and dep.count() == 1000
    # each arrival meets only the departures of the buckets its dwell window
    # touches (~20 here: a dwell every 3 minutes, two 30-minute buckets),
    # not all 1000 departures of the key
    assert E.dwell_candidates(arr, dep).count() <= 25 * n_arr
    ev = E.vehicle_events(tr)
    assert ev.filter("closed_with = 1").count() == 1000
    touches = E.event_touches(ev)
    preds = spark.createDataFrame([(i, "prod", "v1", "x", 0, "A", t + 60 * i - 30) for i in range(0, 3000, 3)], PRED)
    cands = M.standard_candidates(preds, touches).count()
    # two 40-minute buckets of touches per prediction, not the key's 2000 touches
    assert cands <= 60 * preds.count()
    assert M.match_standard(preds, touches).count() == 1000


def test_rejected_arrivals_say_what_they_lack(spark):
    t = spark.createDataFrame(
        [("prod", "v1", "l", False, "t", "Red", 0, "s", 10, 10, "arrival"), ("prod", "v2", " ", False, None, "Red", 0, "s", 10, 10, "new_arrival"),
         ("prod", "v3", "l", None, "t", "Red", None, "s", None, 10, "departure_arrival"), ("prod", "v4", "l", False, "t", "Red", 0, "", 10, 10, "none")],
        "environment string, id string, label string, is_deleted boolean, trip_id string, route_id string, direction_id int, stop_id string, timestamp long, snapshot_time long, transition string")
    assert [r.vehicle_id for r in E.arrivals(t).collect()] == ["v1"]
    assert sorted((r.vehicle_id, r.missing) for r in E.rejected_arrivals(t).collect()) == [("v2", "vehicle_label,trip_id"), ("v3", "is_deleted,direction_id")]
