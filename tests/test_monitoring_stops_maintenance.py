import datetime as dt

from headway.operators import maintenance as MT
from headway.operators import monitoring as MO
from headway.operators import stops as SP

ACC = "environment string, service_date date, route_id string, num_predictions int, num_accurate_predictions int"


def _drop(spark, y, p):
    d = dt.date(2020, 1, 2)
    df = spark.createDataFrame(
        [("prod", d, "Red", 100, int(round(y * 100))), ("prod", d - dt.timedelta(days=1), "Red", 100, int(round(p * 100)))], ACC
    )
    r = [x for x in MO.accuracy_drops(df).collect() if x.route_id == "Red" and x.service_date == d]
    return r[0].drop


def test_drop_threshold(spark):
    assert _drop(spark, 0.69, 0.80) is True
    assert _drop(spark, 0.80, 0.90) is False
    assert _drop(spark, 0.90, 0.80) is False


def test_route_daily_accuracy_zero_fill(spark):
    df = spark.createDataFrame([("prod", dt.date(2020, 1, 1), "Red", 10, 5), ("dev-green", dt.date(2020, 1, 1), "Blue", 10, 5)], ACC)
    got = {r.route_id: r.accuracy for r in MO.route_daily_accuracy(df).collect()}
    assert got["Red"] == 0.5 and got["Blue"] == 0.0 and len(got) == 8


def test_stop_names(spark):
    stops = spark.createDataFrame(
        [("70150", "subway", "Kenmore", "Park Street & North", "d"), ("70151", "subway", "Kenmore", "Park Street & North", "d"),
         ("70238", "subway", "Cleveland Circle", "Park Street & North", "x"), ("Andover", "subway", "Andover", None, None),
         ("dummystop1", "subway", "Dummy Stop Name", None, "dd"), ("dummystop2", "subway", "Dummy Stop Name", None, "dd")],
        "id string, mode string, name string, platform_name string, description string",
    )
    names = {r.id: r.display_name for r in SP.stop_dim(stops).collect()}
    assert names["70238"] == "Cleveland Circle (Park Street & North)"
    assert names["Andover"] == "Andover"
    assert names["70150"] == "Kenmore (Park Street & North) - 70150"
    assert names["dummystop1"] == "Dummy Stop Name - dummystop1"
    keys = spark.createDataFrame([("70238",), ("nope",)], "stop_id string")
    got = {r.stop_id: r.station_name for r in SP.station_names(keys, SP.stop_dim(stops)).collect()}
    assert got == {"70238": "Cleveland Circle (Park Street & North)", "nope": "nope"}


def test_prune(spark):
    now = 10_000_000
    lb = 7 * 86400
    preds = spark.createDataFrame([(1, now - lb - 1), (2, now - lb), (3, now)], "id long, file_timestamp long")
    assert sorted(r.id for r in MT.prune_predictions(preds, now).collect()) == [2, 3]
    ev = spark.createDataFrame([(1, now - lb - 1801), (2, now - lb - 100), (3, now), (4, None)], "id long, arrival_time long")
    assert sorted(r.id for r in MT.prune_events(ev, now).collect()) == [2, 3, 4]


def test_backfill_window():
    assert MT.backfill_window(dt.date(2026, 1, 1), dt.date(2026, 3, 1)) == (
        dt.date(2026, 1, 1), dt.date(2026, 1, 7), "copied", dt.date(2026, 1, 8))
    assert MT.backfill_window(dt.date(2026, 1, 1), dt.date(2026, 1, 9))[2:] == ("skipped", dt.date(2026, 1, 1))
    assert MT.backfill_window(dt.date(2026, 1, 1), dt.date(2026, 1, 10))[2] == "copied"


def test_reconcile(spark):
    a = spark.createDataFrame([(1, dt.date(2020, 1, 1)), (2, dt.date(2020, 1, 2))], "id long, service_date date")
    b = spark.createDataFrame([(2, dt.date(2020, 1, 2)), (3, dt.date(2020, 1, 3))], "id long, service_date date")
    got = {r.side: (r.row_count, r.unmatched, r.min_service_date) for r in MT.reconcile(a, b).collect()}
    assert got == {"monolithic": (2, 1, dt.date(2020, 1, 1)), "partitioned": (2, 1, dt.date(2020, 1, 3))}


def test_consolidate_bins(spark):
    df = spark.createDataFrame([("6-8 min",), ("8-10 min",), ("10-12 min",), ("0-3 min",)], "bin string")
    assert sorted(r.bin for r in MT.consolidate_bins(df).collect()) == ["0-3 min", "6-12 min"]


def test_write_accuracy_weekly_partitions(spark, tmp_path):
    df = spark.createDataFrame([("prod", dt.date(2026, 1, 7), "Red"), ("prod", dt.date(2026, 1, 12), "Red")],
                               "environment string, service_date date, route_id string")
    MT.write_accuracy(df, str(tmp_path / "acc"))
    parts = sorted(p.name for p in (tmp_path / "acc").iterdir() if p.name.startswith("week_start="))
    assert parts == ["week_start=2026-01-05", "week_start=2026-01-12"]
    # overwriting one date leaves the other alone
    MT.write_accuracy(df.filter("service_date = DATE'2026-01-07'"), str(tmp_path / "acc"))
    assert spark.read.parquet(str(tmp_path / "acc")).count() == 2


def test_backfill_then_final_copy_reconciles(spark):
    src = spark.createDataFrame([(i, dt.date(2020, 1, 1) + dt.timedelta(days=i)) for i in range(20)], "id long, service_date date")
    rows, report = MT.backfill_run(src, dt.date(2020, 1, 1), dt.date(2021, 1, 1))
    r = report.first()
    assert (r.status, r.rows_copied, r.next_cursor) == ("copied", 7, dt.date(2020, 1, 8))
    copied = rows.unionByName(MT.final_copy(src, r.next_cursor))
    got = {x.side: x.unmatched for x in MT.reconcile(src, copied).collect()}
    assert got == {"monolithic": 0, "partitioned": 0}
