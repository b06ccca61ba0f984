"""The streaming tracker must produce the batch transitions."""

import json
import os

from pyspark.sql import functions as F

from headway.operators import events as E
from headway.sources import adapters as A
from headway.sources import schemas as SC
from headway.streaming import jobs as J
from headway.streaming.tracker import track, tracker_input
from headway.operators import ingest as IN

SF = "/root/testdata/sf0.001"
KEY = ["environment", "mode", "id", "snapshot_time"]


def _batch(spark):
    t = E.vehicle_transitions(A.vehicle_positions(spark, SF), A.vehicle_snapshots(spark, SF))
    return {tuple(r[k] for k in KEY): r.transition for r in t.collect()}


def test_tracker_on_batch_input_equals_batch_transitions(spark):
    docs = A.vehicle_feed_docs(spark, SF)
    recs = IN.parse_vehicle_feed(docs).filter(F.col("parse_status") == "valid")
    out = track(tracker_input(recs, docs.select("environment", "mode", "snapshot_time"))).collect()
    got = {tuple(r[k] for k in KEY): r.transition for r in out if r.transition != "dropped"}
    assert got == _batch(spark)
    dropped = sorted((r.environment, r.snapshot_time, r.old_label) for r in out if r.transition == "dropped")
    exp = E.dropped_vehicles(A.vehicle_positions(spark, SF), A.vehicle_snapshots(spark, SF)).collect()
    exp_rows = sorted((r.environment, r.snapshot_time, lab) for r in exp for lab in r.labels.split(","))
    assert dropped == exp_rows


def test_streaming_micro_batches_equal_batch(spark, tmp_path):
    docs = A.vehicle_feed_docs(spark, SF).orderBy("snapshot_time").collect()
    landing = tmp_path / "landing"
    landing.mkdir()
    out, ckpt = str(tmp_path / "transitions"), str(tmp_path / "ckpt")
    times = sorted({d.snapshot_time for d in docs})
    chunks = [times[: len(times) // 2], times[len(times) // 2:]]
    for i, chunk in enumerate(chunks):
        with open(landing / f"part-{i}.json", "w") as f:
            for d in docs:
                if d.snapshot_time in chunk:
                    f.write(json.dumps(d.asDict(recursive=True)) + "\n")
        q = J.start_vehicle_tracker(spark, str(landing), out, ckpt, available_now=True, one_doc_per_file=False)
        q.awaitTermination(300)
    got_rows = J.stored_transitions(spark, out).collect()
    got = {tuple(r[k] for k in KEY): r.transition for r in got_rows if r.transition != "dropped"}
    assert got == _batch(spark)


def test_read_feed_schema_multiline(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text(json.dumps({"entity": [], "environment": "prod", "mode": "subway", "snapshot_time": 5, "last_modified": "x"}, indent=2))
    s = J.read_feed(spark, str(tmp_path), SC.VEHICLE_FEED)
    assert s.isStreaming


def test_scoring_run_is_idempotent(spark, tmp_path):
    from headway.plans import domain as D

    tr = str(tmp_path / "tr")
    pr = str(tmp_path / "pr")
    D.transitions(spark, SF).write.parquet(tr)
    D.predictions(spark, SF).write.parquet(pr)
    out = str(tmp_path / "acc")
    start, end = 1705363200, 1705363200 + 31 * 86400
    J.run_scoring(spark, tr, pr, out, end, start)
    first = sorted(map(tuple, spark.read.parquet(out).collect()), key=str)
    J.run_scoring(spark, tr, pr, out, end, start)
    second = sorted(map(tuple, spark.read.parquet(out).collect()), key=str)
    assert first == second and len(first) > 0
    # a later run that starts in the middle of a service day leaves the blocks before it alone
    J.run_scoring(spark, tr, pr, out, end, start + 3 * 86400 + 4321)
    assert sorted(map(tuple, spark.read.parquet(out).collect()), key=str) == first
    # and the default start scores the current service day only
    J.run_scoring(spark, tr, pr, out, start + 86400)
    assert sorted(map(tuple, spark.read.parquet(out).collect()), key=str) == first
    # same rows as the batch scorer over the whole history
    from headway.operators import scoring as S

    batch = S.score(D.predictions(spark, SF), D.matches(spark, SF))
    assert batch.count() == len(first)


def test_prediction_ingest_stream_equals_batch_flatten(spark, tmp_path):
    docs = A.trip_update_docs(spark, SF)
    landing = str(tmp_path / "tu")
    docs.write.json(landing)
    out, ckpt = str(tmp_path / "pred"), str(tmp_path / "ckpt")
    q = J.start_prediction_ingest(spark, landing, out, ckpt, available_now=True, one_doc_per_file=False)
    q.awaitTermination(300)
    assert {"batch_id", "file_date", "environment"} <= set(spark.read.parquet(out).columns)
    got = J.stored_predictions(spark, out)
    cols = ["environment", "file_timestamp", "trip_id", "stop_id", "arrival_time", "departure_time", "kind", "nth_at_stop"]
    exp = IN.flatten_trip_updates(docs).select(*cols)
    assert got.count() == exp.count() > 0
    at = exp.agg({"file_timestamp": "min"}).first()[0] + 86400
    part = J.stored_predictions(spark, out, at, at + 3600)
    assert "PartitionFilters: [isnotnull(file_date" in part._jdf.queryExecution().toString()
    assert part.count() == exp.filter((F.col("file_timestamp") >= at) & (F.col("file_timestamp") < at + 3600)).count()
    assert got.select(*cols).exceptAll(exp).count() == 0
    assert got.select("id").distinct().count() == got.count()


def test_block_scorer_stream(spark, tmp_path):
    from headway.plans import domain as D

    tr, pr = str(tmp_path / "tr"), str(tmp_path / "pr")
    D.transitions(spark, SF).write.parquet(tr)
    D.predictions(spark, SF).write.parquet(pr)
    out = str(tmp_path / "acc")
    q = J.start_block_scorer(spark, pr, tr, out, str(tmp_path / "ckpt"))
    q.awaitTermination(300)
    got = spark.read.parquet(out)
    now = spark.read.parquet(pr).agg({"file_timestamp": "max"}).first()[0]
    exp = J.score_closed_blocks(spark.read.parquet(tr), spark.read.parquet(pr), now)
    assert got.count() == exp.count() > 0
    assert got.agg({"num_predictions": "sum"}).first()[0] == exp.agg({"num_predictions": "sum"}).first()[0]


def test_block_scorer_scores_every_block_between_two_runs(spark, tmp_path):
    """A backlog over many service dates, in one batch and in two that lie days apart."""
    from headway.plans import domain as D

    tr, pr = str(tmp_path / "tr"), str(tmp_path / "pr")
    D.transitions(spark, SF).write.parquet(tr)
    p = D.predictions(spark, SF)
    exp = J.score_closed_blocks(spark.read.parquet(tr), p, p.agg({"file_timestamp": "max"}).first()[0])
    dates = {r.service_date for r in exp.select("service_date").distinct().collect()}
    assert len(dates) >= 6
    cols = [c for c in exp.columns if c not in ("mean_error", "root_mean_squared_error")]
    want = sorted(map(tuple, exp.select(cols).collect()), key=str)

    out, ckpt = str(tmp_path / "acc"), str(tmp_path / "ckpt")
    cut = 1705363200 + 5 * 86400
    p.filter(F.col("file_timestamp") < cut).write.parquet(pr)
    J.start_block_scorer(spark, pr, tr, out, ckpt).awaitTermination(300)
    p.filter(F.col("file_timestamp") >= cut).write.mode("append").parquet(pr)
    J.start_block_scorer(spark, pr, tr, out, ckpt).awaitTermination(300)
    assert sorted(map(tuple, spark.read.parquet(out).select(cols).collect()), key=str) == want


def test_pages_of_one_snapshot_in_two_batches_rank_together(spark, tmp_path):
    def doc(page, stop_times):
        upd = [{"stop_id": "70063", "stops_away": 1, "arrival": {"time": t}} for t in stop_times]
        return {"header": {"timestamp": 1000}, "environment": "prod", "page": page, "fetched_at": 1010, "entity": [
            {"id": "e", "is_deleted": False, "trip_update": {"trip": {"trip_id": f"t{page}"}, "vehicle": {"id": "v"}, "stop_time_update": upd}}]}

    landing, out, ckpt = tmp_path / "l", str(tmp_path / "o"), str(tmp_path / "c")
    landing.mkdir()
    for page, times in ((0, [1300, 1100]), (20, [1200])):
        (landing / f"{page}.json").write_text(json.dumps(doc(page, times)))
        J.start_prediction_ingest(spark, str(landing), out, ckpt).awaitTermination(300)
    rows = J.stored_predictions(spark, out).collect()
    assert sorted((r.arrival_time, r.nth_at_stop) for r in rows) == [(1100, 1), (1200, 2), (1300, 3)]
    assert len({r.id for r in rows}) == 3


def test_pages_of_one_vehicle_snapshot_in_two_batches(spark, tmp_path):
    """One file a run; the second page of each snapshot lands apart, one only after the next snapshot."""

    def doc(t, page, ids):
        ent = [{"is_deleted": False, "vehicle": {"current_status": "IN_TRANSIT_TO", "stop_id": "70061", "timestamp": t,
                "trip": {"direction_id": 0, "route_id": "Red", "trip_id": "t" + i}, "vehicle": {"id": i, "label": "l" + i}}} for i in ids]
        return {"entity": ent, "environment": "prod", "mode": "subway", "snapshot_time": t, "page": page}

    pages = [(3590, 0, "ab"), (3590, 1, "cd"), (3605, 0, "ab"), (3605, 1, "c"), (3620, 0, "a"), (7210, 0, "ab"), (3620, 1, "bc"), (7210, 1, "e")]
    landing, out, ckpt = tmp_path / "l", str(tmp_path / "o"), str(tmp_path / "c")
    landing.mkdir()
    for n, (t, page, ids) in enumerate(pages):
        (landing / f"{n}.json").write_text(json.dumps(doc(t, page, ids)))
        J.start_vehicle_tracker(spark, str(landing), out, ckpt).awaitTermination(300)
    got = sorted((r.snapshot_time, r.id, r.prev_snapshot_time, r.transition) for r in J.stored_transitions(spark, out).collect())
    new = [(3590, i, None, "new") for i in "abcd"]
    second = [(3605, i, 3590, "none") for i in "abc"] + [(3605, "d", 3590, "dropped")]
    third = [(3620, i, 3605, "none") for i in "abc"]
    last = [(7210, "a", 3620, "none"), (7210, "b", 3620, "none"), (7210, "c", 3620, "dropped"), (7210, "e", 3620, "new")]
    assert got == new + second + third + last


def test_tracker_deals_out_the_vehicles_of_a_feed(spark):
    docs = A.vehicle_feed_docs(spark, SF)
    recs = IN.parse_vehicle_feed(docs).filter(F.col("parse_status") == "valid")
    plan = track(tracker_input(recs, docs.select("environment", "mode", "snapshot_time")))._jdf.queryExecution().toString()
    assert "TransformWithState" not in plan and "Python" not in plan
    assert "SortMergeJoin [environment" in plan or "HashJoin [environment" in plan


def test_stream_keeps_snapshots_without_last_modified(spark, tmp_path):
    def doc(t, told):
        d = {"entity": [], "environment": "prod", "mode": "subway", "snapshot_time": t, "page": 0}
        return d | ({"last_modified": told} if told else {})

    landing = tmp_path / "l"
    landing.mkdir()
    for t, told in ((1000, None), (1001, None), (1002, "a"), (1003, "a"), (1004, None), (1005, "b")):
        (landing / f"{t}.json").write_text(json.dumps(doc(t, told)))
    q = J.dedupe_stream(J.read_feed(spark, str(landing), SC.VEHICLE_FEED)).writeStream.format("parquet")
    q = q.option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    got = sorted(r.snapshot_time for r in spark.read.parquet(str(tmp_path / "o")).collect())
    assert len(got) == 5 and {1000, 1001, 1004, 1005} < set(got)


def test_service_day_start():
    # 2018-10-30 01:00 New York belongs to the 10-29 service day, which starts 10-29 03:00 EDT
    assert J.service_day_start(1540875600) == 1540796400
    assert J.service_day_start(1540908000) == 1540882800


def test_commuter_rail_streams_equal_batch(spark, tmp_path):
    docs = A.cr_vehicle_docs(spark, SF)
    rows = docs.orderBy("snapshot_time").collect()
    landing, out, ckpt = tmp_path / "landing", str(tmp_path / "tr"), str(tmp_path / "ckpt")
    landing.mkdir()
    times = sorted({r.snapshot_time for r in rows})
    for i in range(3):  # a few micro-batches
        part = set(times[i * len(times) // 3 : (i + 1) * len(times) // 3])
        (landing / f"{i}.json").write_text("".join(json.dumps(r.asDict(recursive=True)) + "\n" for r in rows if r.snapshot_time in part))
        J.start_vehicle_tracker(spark, str(landing), out, ckpt, one_doc_per_file=False, mode="commuter_rail").awaitTermination(300)
    got = {tuple(r[k] for k in KEY): r.transition for r in J.stored_transitions(spark, out).collect() if r.transition != "dropped"}
    snaps = docs.select(F.lit("prod").alias("environment"), F.lit("commuter_rail").alias("mode"), "snapshot_time").distinct()
    exp = E.vehicle_transitions(IN.parse_cr_vehicles(docs), snaps).collect()
    assert got == {tuple(r[k] for k in KEY): r.transition for r in exp} and len(got) > 100

    docs = A.cr_prediction_docs(spark, SF)
    land = str(tmp_path / "cp")
    docs.write.json(land)
    J.start_prediction_ingest(spark, land, str(tmp_path / "cpo"), str(tmp_path / "cpc"), one_doc_per_file=False, mode="commuter_rail").awaitTermination(300)
    got = J.stored_predictions(spark, str(tmp_path / "cpo"))
    cols = ["file_timestamp", "vehicle_id", "trip_id", "stop_id", "arrival_time", "departure_time", "id"]
    exp = IN.flatten_cr_predictions(docs).select(cols)
    assert got.count() == exp.count() == got.select("id").distinct().count() > 0
    assert got.select(cols).exceptAll(exp).count() == 0


def test_matching_day_by_day_equals_the_whole_history(spark, tmp_path):
    import datetime as dt

    from headway import cli
    from headway.plans import domain as D

    tr, pr, ev, ma = (str(tmp_path / n) for n in ("tr", "pr", "ev", "ma"))
    D.transitions(spark, SF).write.parquet(tr)
    D.predictions(spark, SF).write.partitionBy("file_date").parquet(pr)
    for n in (2, 0, 1, 0):  # any order, and one day twice
        first = dt.date(2024, 1, 16) + dt.timedelta(days=10 * n)
        assert cli.main(["match", "--transitions", tr, "--predictions", pr, "--events", ev, "--matches", ma,
                         "--first", str(first), "--last", str(first + dt.timedelta(days=9))]) == 0
    cols = ["environment", "vehicle_id", "stop_id", "arrival_snapshot", "departure_snapshot", "closed_with"]
    got, exp = (sorted(map(tuple, x.select(cols).collect()), key=str) for x in (spark.read.parquet(ev), D.vehicle_events(spark, SF)))
    assert got == exp and got
    cols = ["prediction_id", "match_type", "touch_time", "ev_vehicle_id", "ev_arrival_snapshot"]
    got, exp = (sorted(map(tuple, x.select(cols).collect()), key=str) for x in (spark.read.parquet(ma), D.matches(spark, SF)))
    assert got == exp and got
    # and the reports of one day from the stored tables
    days = [r.service_day for r in catalog_rows(spark, "unpredicted_summary") if r.environment == "prod"]
    day = max(set(days), key=days.count)
    for report, name in (("unpredicted-summary", "unpredicted_summary"), ("missed-summary", "missed_summary")):
        out = str(tmp_path / report)
        assert cli.main(["departures", "--events", ev, "--predictions", pr, "--matches", ma, "--report", report, "--date", str(day), "--out", out]) == 0
        rows = spark.read.csv(out, header=True).collect()
        want = [r for r in catalog_rows(spark, name) if r.environment == "prod" and r.service_day == day]
        assert [r.route_id for r in rows] == [r.route_id for r in want] and rows


def catalog_rows(spark, name):
    from headway.plans import catalog

    return catalog.REGISTRY[name][0](spark, SF).collect()
