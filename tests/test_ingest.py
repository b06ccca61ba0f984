import json
import os

from pyspark.sql import functions as F

from headway.operators import ingest as IN
from headway.sources import schemas as SC

DATA = os.path.join(os.path.dirname(__file__), "data")


def test_flatten_and_rank(spark):
    """Ranks at a stop, a stop-less update, a missing update list, updates without times or stops_away, platform ids."""
    docs = spark.read.schema(SC.TRIP_UPDATES).option("multiLine", True).json(os.path.join(DATA, "trip_updates_*.json"))
    rows = IN.flatten_trip_updates(docs).collect()
    for env in ["prod", "dev-green"]:
        got = sorted(
            ((r.trip_id, r.stop_id, r.direction_id, r.kind, r.nth_at_stop) for r in rows if r.environment == env),
            key=str,
        )
        want = sorted(
            [
                ("north-1", "70061", 0, "at_terminal", 2),
                ("north-1", "70065", 0, "at_terminal", 1),
                ("north-2", "70061", 0, "mid_trip", 1),
                ("north-2", "70065", 0, "reverse", 2),
                ("loop", None, 1, "mid_trip", None),
            ],
            key=str,
        )
        assert got == want
    assert {r.file_timestamp for r in rows} == {1706000000}


def test_one_file_fetched_twice_is_ranked_twice(spark, tmp_path):
    upd = [{"stop_id": "70063", "stops_away": 2, "arrival": {"time": 1000 + t}} for t in (30, 10, 20)]
    for fetched in (5, 65):
        doc = {"header": {"timestamp": 900}, "environment": "prod", "fetched_at": fetched, "entity": [
            {"id": "e", "is_deleted": False, "trip_update": {"trip": {"trip_id": "t"}, "vehicle": {"id": "v"}, "stop_time_update": upd}}]}
        (tmp_path / f"{fetched}.json").write_text(json.dumps(doc))
    rows = IN.flatten_trip_updates(spark.read.schema(SC.TRIP_UPDATES).json(str(tmp_path))).withColumn("id", IN.prediction_id()).collect()
    assert sorted((r.arrival_time, r.nth_at_stop) for r in rows) == [(1010, 1), (1010, 1), (1020, 2), (1020, 2), (1030, 3), (1030, 3)]
    assert len({r.id for r in rows}) == 6


def test_snapshot_without_entity_yields_nothing(spark, tmp_path):
    p = tmp_path / "empty.json"
    p.write_text(json.dumps({"header": {"timestamp": 1}, "environment": "prod"}))
    docs = spark.read.schema(SC.TRIP_UPDATES).json(str(p))
    assert IN.flatten_trip_updates(docs).count() == 0


def test_commuter_rail_predictions(spark, tmp_path):
    def pred(vehicle):
        return {
            "attributes": {"arrival_time": None, "departure_time": "2019-03-28T15:31:00-04:00", "status": "On time",
                           "schedule_relationship": None, "direction_id": 0, "stop_sequence": 1},
            "relationships": {"vehicle": {"data": {"id": vehicle} if vehicle else None},
                              "trip": {"data": {"id": "CR-trip"}}, "route": {"data": {"id": "CR-Lowell"}},
                              "stop": {"data": {"id": "North Station"}}},
        }
    doc = {"data": [pred("vehicle_id"), pred(None), pred("vehicle_id")], "last_modified": "Tue, 30 Oct 2018 17:33:15 GMT"}
    p = tmp_path / "cr.json"
    p.write_text(json.dumps(doc))
    rows = IN.flatten_cr_predictions(spark.read.schema(SC.CR_PREDICTIONS).json(str(p))).collect()
    assert [(r.stop_id, r.direction_id, r.vehicle_id) for r in rows] == [("North Station", 0, "vehicle_id")] * 2
    assert {r.file_timestamp for r in rows} == {1540920795}
    assert {r.departure_time for r in rows} == {1553801460}
    assert {r.environment for r in rows} == {"prod"}


def _vehicle(stop="70063", status="STOPPED_AT", direction=0, vid="v1"):
    return {"is_deleted": False, "vehicle": {"current_status": status, "stop_id": stop, "timestamp": 100,
            "trip": {"direction_id": direction, "route_id": "Red", "trip_id": "t1"},
            "vehicle": {"id": vid, "label": "L" + vid}}}


def test_vehicle_parse_status(spark, tmp_path):
    doc = {"entity": [_vehicle(), _vehicle(stop=None, vid="v2"), _vehicle(status="BOGUS", vid="v3"),
                      _vehicle(direction=2, vid="v4"), _vehicle(stop="Alewife-02", vid="v5")],
           "environment": "prod", "mode": "subway", "snapshot_time": 100, "last_modified": "x"}
    p = tmp_path / "vp.json"
    p.write_text(json.dumps(doc))
    docs = spark.read.schema(SC.VEHICLE_FEED).json(str(p))
    assert [tuple(r) for r in IN.snapshots_of(docs).collect()] == [("prod", "subway", 100)]
    st = {r.id: r.parse_status for r in IN.parse_vehicle_feed(docs).collect()}
    assert st == {"v1": "valid", "v2": "ignore", "v3": "error", "v4": "error", "v5": "valid"}
    # numbers where text belongs, text where numbers belong, and a record without the stop's key
    odd = [_vehicle(stop=70063, vid="n1"), _vehicle(vid="n2"), _vehicle(vid="n3"), _vehicle(vid="n4"), _vehicle(vid="n5"), _vehicle(status=1, vid="n6")]
    odd[1]["vehicle"]["trip"]["trip_id"] = 5
    odd[2]["vehicle"]["timestamp"] = "100"
    odd[3]["is_deleted"] = "no"
    del odd[4]["vehicle"]["stop_id"]
    q = tmp_path / "odd" / "vp.json"
    q.parent.mkdir()
    q.write_text(json.dumps({**doc, "entity": odd}))
    st = {r.id: r.parse_status for r in IN.parse_vehicle_feed(spark.read.schema(SC.VEHICLE_FEED).json(str(q))).collect()}
    assert st == {"n1": "ignore", "n2": "error", "n3": "error", "n4": "error", "n5": "error", "n6": "error"}
    pos = {r.id: r.stop_id for r in IN.vehicle_positions_from_feed(docs).collect()}
    assert pos == {"v1": "70063", "v5": "70061"}


def test_commuter_rail_stop_without_data_is_rejected_and_bad_times_are_null(spark, tmp_path):
    def vehicle(vid, stop, at):
        return {"id": vid, "attributes": {"current_status": "STOPPED_AT", "label": "x", "updated_at": at, "direction_id": 1},
                "relationships": {"route": {"data": {"id": "CR-Lowell"}}, "trip": {"data": {"id": "t"}}, "stop": {"data": stop}}}

    doc = {"data": [vehicle("1", None, "2019-03-28T13:57:57-04:00"), vehicle("2", {"id": "S"}, "garbage"), vehicle("3", {"id": None}, "2019-03-28T13:57:57-04:00")],
           "snapshot_time": 10, "last_modified": "x"}
    p = tmp_path / "cr.json"
    p.write_text(json.dumps(doc))
    rows = IN.parse_cr_vehicles(spark.read.schema(SC.CR_VEHICLES).json(str(p))).collect()
    assert sorted((r.id, r.timestamp) for r in rows) == [("2", None), ("3", 1553795877)]


def test_last_record_per_vehicle_wins(spark, tmp_path):
    a, b = _vehicle(stop="70063"), _vehicle(stop="70065")
    doc = {"entity": [a, b], "environment": "prod", "mode": "subway", "snapshot_time": 5, "last_modified": "x"}
    p = tmp_path / "vp.json"
    p.write_text(json.dumps(doc))
    pos = IN.vehicle_positions_from_feed(spark.read.schema(SC.VEHICLE_FEED).json(str(p))).collect()
    assert [(r.id, r.stop_id) for r in pos] == [("v1", "70065")]


def test_commuter_rail_vehicles(spark, tmp_path):
    doc = {"data": [{"id": "1702", "attributes": {"current_status": "STOPPED_AT", "label": "1702",
                     "updated_at": "2019-03-28T13:57:57-04:00", "direction_id": 1},
                     "relationships": {"route": {"data": {"id": "CR-Lowell"}}, "stop": {"data": {"id": "North Station"}},
                                       "trip": {"data": {"id": "CR-1"}}}},
                    {"id": "bad", "attributes": {"current_status": "STOPPED_AT", "label": "x", "direction_id": 1},
                     "relationships": {"route": {"data": {"id": "CR-Lowell"}}, "stop": {"data": {"id": "S"}},
                                       "trip": {"data": {"id": "CR-2"}}}}],
           "snapshot_time": 10, "last_modified": "x"}
    p = tmp_path / "cr.json"
    p.write_text(json.dumps(doc))
    docs = spark.read.schema(SC.CR_VEHICLES).json(str(p))
    rows = IN.parse_cr_vehicles(docs).collect()
    assert [(r.id, r.timestamp, r.environment, r.is_deleted) for r in rows] == [("1702", 1553795877, "prod", False)]
    # only the prod tracker reads commuter-rail vehicles
    other = IN.parse_cr_vehicles(docs, environment="dev-green")
    assert other.count() == 0 and other.columns == IN.parse_cr_vehicles(docs).columns


def test_dedupe_snapshots(spark):
    df = spark.createDataFrame(
        [("prod", "subway", 1, "A"), ("prod", "subway", 2, "A"), ("prod", "subway", 3, "B"), ("dev-green", "subway", 2, "A")],
        "environment string, mode string, snapshot_time long, last_modified string",
    )
    got = sorted((r.environment, r.snapshot_time) for r in IN.dedupe_snapshots(df).collect())
    assert got == [("dev-green", 2), ("prod", 1), ("prod", 3)]
    told = df.unionByName(spark.createDataFrame([("prod", "subway", 4, None), ("prod", "subway", 5, None)], df.schema))
    got = sorted((r.environment, r.snapshot_time) for r in IN.dedupe_snapshots(told).collect())
    assert got == [("dev-green", 2), ("prod", 1), ("prod", 3), ("prod", 4), ("prod", 5)]


def test_generic_stop_ids(spark):
    from headway.functions.columns import generic_stop_id

    ids = ["Alewife-01", "Braintree-02", "Forest Hills-01", "Oak Grove-02", "Union Square-03", "70511", "70061", None]
    df = spark.createDataFrame([(i,) for i in ids], "s string")
    got = [r.g for r in df.select(generic_stop_id(F.col("s")).alias("g")).collect()]
    assert got == ["70061", "70105", "70001", "70036", "70503", "70512", "70061", None]
