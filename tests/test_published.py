"""Published versions: the tracker's tables, retention, the stored backfill cursor, reconciliation by digest."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from headway.operators import maintenance as MT
from headway.sources import schemas as SC
from headway.streaming import backfill as B
from headway.streaming import snapshots as SN
from headway.streaming.published import Published, StaleVersion

T = 1705363200


def snap(t, ids, env="prod", told=None, page=0, bad=()):
    """A feed document; ``bad``: entities to add as they are."""
    ent = [{"is_deleted": False, "vehicle": {"current_status": "STOPPED_AT", "stop_id": "70061", "timestamp": t,
            "trip": {"direction_id": 0, "route_id": "Red", "trip_id": "t" + i}, "vehicle": {"id": i, "label": "l" + i}}} for i in ids]
    d = {"entity": [*ent, *bad], "environment": env, "mode": "subway", "snapshot_time": t, "page": page}
    return d | ({"last_modified": told} if told else {})


def docs(spark, tmp, name, *ds):
    path = str(tmp / f"{name}.json")
    with open(path, "w") as f:
        f.writelines(json.dumps(d) + "\n" for d in ds)
    return spark.read.schema(SC.VEHICLE_FEED).json(path)


def moves(spark, root):
    return sorted((r.environment, r.snapshot_time, r.id, r.transition) for r in SN.stored_transitions(spark, root).collect())


def test_a_feed_far_behind_loses_nothing_and_all_is_counted(spark, tmp_path):
    root = str(tmp_path / "tr")
    http = "Tue, 16 Jan 2024 00:00:0%d GMT"
    no_stop = {"is_deleted": False, "vehicle": {"current_status": "STOPPED_AT", "stop_id": 5, "timestamp": T, "trip": {"direction_id": 0, "route_id": "Red", "trip_id": "x"}, "vehicle": {"id": "n", "label": "n"}}}
    broken = {"is_deleted": False, "vehicle": {"current_status": "FLYING"}}
    SN.store_batch(docs(spark, tmp_path, "0", snap(T, "ab", told=http % 0, bad=[no_stop, broken]), snap(T + 5, "a", told=http % 5)), root, 0)
    late = [snap(T - 6 * 3600 + 10 * k, "z", env="dev-green", told=f"odd {k}") for k in range(3)]
    again = [snap(T + 9, "abc", told=http % 5), snap(T + 5, "b", told=http % 5, page=1)]  # fetched twice; and a second page
    SN.store_batch(docs(spark, tmp_path, "1", *late, *again), root, 1)
    SN.store_batch(docs(spark, tmp_path, "2", snap(T + 7300, "a"), snap(T - 3 * 3600, "z", env="dev-green"), snap(T + 12, "zz", told=http % 0)), root, 2)
    t0 = T - 6 * 3600
    assert moves(spark, root) == sorted([
        ("prod", T, "a", "new_arrival"), ("prod", T, "b", "new_arrival"), ("prod", T + 5, "a", "none"), ("prod", T + 5, "b", "none"),
        ("prod", T + 7300, "a", "none"), ("prod", T + 7300, "b", "dropped"),
        ("dev-green", t0, "z", "new_arrival"), ("dev-green", t0 + 10, "z", "none"), ("dev-green", t0 + 20, "z", "none"), ("dev-green", T - 3 * 3600, "z", "none")])
    c = {(r.environment, r.batch): r for r in SN.stored(spark, root, "counts").collect()}
    told = lambda *k: tuple(c[k][x] for x in ("documents", "taken", "repeated", "valid", "ignored", "errors"))
    assert told("prod", 0) == (2, 2, 0, 3, 1, 1)
    assert told("prod", 1) == (2, 1, 3, 1, 0, 0) and told("dev-green", 1) == (3, 3, 0, 3, 0, 0)
    assert told("prod", 2) == (2, 1, 2, 1, 0, 0)
    q = SN.stored(spark, root, "quarantine").collect()
    assert sorted((r.parse_status, r.pos, json.loads(r.entity)["vehicle"]["current_status"]) for r in q) == [("error", 3, "FLYING"), ("ignore", 2, "STOPPED_AT")]


def test_versions_replays_and_killed_runs(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "tr")
    SN.store_batch(docs(spark, tmp_path, "0", snap(T, "ab"), snap(T + 10, "ab", page=0)), root, 0)
    first = Published(spark, root).latest()
    before = moves(spark, root)
    assert SN.store_batch(docs(spark, tmp_path, "0", snap(T, "ab")), root, 0) == first  # replayed

    late = docs(spark, tmp_path, "1", snap(T + 5, "a"))
    with monkeypatch.context() as m:
        m.setattr(Published, "commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            SN.store_batch(late, root, 1)
    assert moves(spark, root) == before and Published(spark, root).latest() == first
    reader = Published(spark, root)
    old = reader.read("transitions", SN.SCHEMAS["transitions"], first)  # pinned before the hour is written anew
    SN.store_batch(late, root, 1)
    assert old.count() == len(before)
    after = [("prod", T, "a", "new_arrival"), ("prod", T, "b", "new_arrival"), ("prod", T + 5, "a", "none"), ("prod", T + 5, "b", "dropped"), ("prod", T + 10, "a", "none"), ("prod", T + 10, "b", "new_arrival")]
    assert moves(spark, root) == after

    with pytest.raises(StaleVersion):  # another tracker that still builds on the first version
        reader.commit(first, replace={"transitions": {next(iter(first.tables["transitions"])): ["write=x"]}})
    assert moves(spark, root) == after
    assert reader.commit(first, add={"other": {"a=1": ["write=y"]}}).number == 3  # what nobody touched goes on top

    many = len([w for ws in Published(spark, root).latest().tables["records"].values() for w in ws])
    SN.store_batch(docs(spark, tmp_path, "2", snap(T + 4 * 3600, "a")), root, 2)
    rows = moves(spark, root)
    SN.compact_tracker(spark, root, T + 3600)
    assert len(Published(spark, root).latest().tables["records"]) == 2 < many + 1
    assert moves(spark, root) == rows
    assert Published(spark, root).vacuum(keep=1, older_than_ms=-1) > 0 and moves(spark, root) == rows
    SN.prune_tracker(spark, root, T + 5 * 3600)
    assert moves(spark, root) == [] and SN.stored(spark, root, "records").count() == 2  # the newest hour: a vehicle and a heartbeat
    SN.store_batch(docs(spark, tmp_path, "3", snap(T + 5 * 3600, "a")), root, 3)
    assert moves(spark, root) == [("prod", T + 5 * 3600, "a", "none")]


def test_facts_for_the_live_streams(spark, tmp_path):
    root, facts = str(tmp_path / "tr"), str(tmp_path / "facts")
    go = lambda d: d | {"entity": [{**e, "vehicle": {**e["vehicle"], "current_status": "IN_TRANSIT_TO", "stop_id": "70063"}} for e in d["entity"]]}
    SN.store_batch(docs(spark, tmp_path, "0", snap(T, "a")), root, 0, facts_path=facts)
    SN.store_batch(docs(spark, tmp_path, "1", go(snap(T + 60, "a"))), root, 1, facts_path=facts)
    got = sorted((r.fact_time, r.arrival_snapshot, r.departure_snapshot, r.touches) for r in spark.read.parquet(facts).collect())
    assert got == [(T, T, None, True), (T + 60, T, T + 60, True)]


def accuracy(spark, days, start=dt.date(2024, 1, 1)):
    return spark.createDataFrame([(100 * d + i, start + dt.timedelta(days=d), f"r{i}") for d in days for i in range(3)], "id long, service_date date, route_id string")


def test_backfill_cursor_is_stored_with_the_rows(spark, tmp_path, monkeypatch):
    src, root, today = accuracy(spark, range(20)), str(tmp_path / "b"), dt.date(2024, 1, 18)
    assert B.run_backfill(spark, src, root, today)["rows_copied"] == 21 and B.cursor(spark, root) == dt.date(2024, 1, 8)
    with monkeypatch.context() as m:
        m.setattr(Published, "commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            B.run_backfill(spark, src, root, today)
    assert B.cursor(spark, root) == dt.date(2024, 1, 8) and B.copied(spark, root).count() == 21

    base = Published(spark, root).latest()  # of two runs at once, the second to publish fails
    assert B.run_backfill(spark, src, root, today)["status"] == "copied"
    with pytest.raises(StaleVersion):
        Published(spark, root).commit(base, writer=B.WRITER, batch=2, notes={"cursor": "2024-01-15"})
    last = B.run_backfill(spark, src, root, today)
    assert (last["status"], last["next_cursor"]) == ("skipped", "2024-01-15") and B.cursor(spark, root) == dt.date(2024, 1, 15)
    got = B.copied(spark, root).select("id").collect()
    assert sorted(r.id for r in got) == sorted(100 * d + i for d in range(14) for i in range(3))
    assert B.run_backfill(spark, src.limit(0), str(tmp_path / "none"), today)["status"] == "empty"


def test_reconciliation_joins_differing_dates_only(spark):
    a, b = accuracy(spark, range(30)), accuracy(spark, range(30))
    assert MT.differing_dates(a, b).count() == 0 and MT.unmatched_rows(a, b).count() == 0
    b = b.filter("id != 501").withColumn("id", F.when(F.col("id") == 902, 9999).otherwise(F.col("id")))
    b = b.withColumn("service_date", F.when(F.col("id") == 1101, dt.date(2024, 3, 1)).otherwise(F.col("service_date")))  # moved: in both copies
    b = b.unionByName(spark.createDataFrame([(None, dt.date(2024, 1, 3), "x")], b.schema))
    dates = {r.service_date.day for r in MT.differing_dates(a, b).collect()}
    assert dates == {6, 10, 12, 1, 3}
    got = sorted(((r.side, r.id, r.service_date.day) for r in MT.unmatched_rows(a, b).collect()), key=repr)
    assert got == sorted([("monolithic", 501, 6), ("monolithic", 902, 10), ("partitioned", 9999, 10), ("monolithic", None, 3)], key=repr)


def test_retention_drops_expired_days_without_reading_them(spark, tmp_path):
    day = lambda n: int(dt.datetime(2024, 1, n, tzinfo=dt.timezone.utc).timestamp())
    p, e = str(tmp_path / "p"), str(tmp_path / "e")
    for batch in (0, 1):
        rows = spark.createDataFrame([(day(n) + 3600, dt.date(2024, 1, n), "prod") for n in range(1, 16)], "file_timestamp long, file_date date, environment string")
        rows.write.partitionBy("file_date", "environment").parquet(f"{p}/batch_id={batch}")
    for n in (1, 2):  # unreadable: nobody looks inside
        for batch in (0, 1):
            d = f"{p}/batch_id={batch}/file_date=2024-01-0{n}/environment=prod"
            for f in os.listdir(d):
                if f.endswith(".parquet"):
                    open(f"{d}/{f}", "wb").close()
    events = [(day(n) + 60, None if n == 3 else day(n) + 50, dt.date(2024, 1, n)) for n in range(1, 16)]
    spark.createDataFrame(events, "arrival_snapshot long, arrival_time long, event_date date").write.partitionBy("event_date").parquet(e)
    as_of = day(15)  # seven days back: the 8th
    assert len(MT.prune_stored_predictions(spark, p, as_of)) == 14
    kept = spark.read.parquet(p)
    assert MT.prune_predictions(kept, as_of).count() == kept.count() == 16
    assert len(MT.prune_stored_events(spark, e, as_of)) == 4
    assert sorted(r.event_date.day for r in spark.read.parquet(e).collect()) == [3, *range(6, 16)]  # the 3rd has an open record
    assert MT.prune_stored_predictions(spark, p, as_of) == []
