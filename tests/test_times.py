import datetime as dt

from pyspark.sql import functions as F

from headway.functions import times as T
from headway.operators.departures import departure_service_day
from headway.operators.maintenance import next_partition


def _one(spark, col, value, typ="long"):
    return spark.createDataFrame([(value,)], f"x {typ}").select(col.alias("r")).first()["r"]


def test_service_date_info_golden_cases(spark):
    # 2018-10-30 10:00, 01:00 and 10:07 New York
    cases = [
        (1540908000, dt.date(2018, 10, 30), 10, 0, 1540908000),
        (1540875600, dt.date(2018, 10, 29), 25, 0, 1540875600),
        (1540908420, dt.date(2018, 10, 30), 10, 5, 1540908300),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "x long")
    out = T.with_service_date_info(df, "x").orderBy("x").collect()
    got = {r.x: (r.service_date, r.hour_of_day, r.minute_of_hour, r.block_start, r.block_end) for r in out}
    for x, d, h, m, b in cases:
        assert got[x] == (d, h, m, b, b + 300)


def test_format_unix(spark):
    assert _one(spark, T.format_unix(F.col("x")), 1561989600) == "2019-07-01 10:00:00 EDT"
    assert _one(spark, T.format_unix(F.col("x")), 1547474400) == "2019-01-14 09:00:00 EST"
    assert _one(spark, T.format_unix(F.col("x")), None) == "N/A"


def test_iso_and_http_dates(spark):
    assert _one(spark, T.iso8601_to_epoch(F.col("x")), "2019-03-28T13:57:57-04:00", "string") == 1553795877
    assert _one(spark, T.rfc1123_to_epoch(F.col("x")), "Tue, 30 Oct 2018 17:33:15 GMT", "string") == 1540920795


def test_week_partition():
    assert next_partition(dt.date(2026, 1, 5)) == (dt.date(2026, 1, 12), dt.date(2026, 1, 19), "week_of_2026_01_12")


def test_week_label(spark):
    r = spark.createDataFrame([(dt.date(2026, 1, 7),)], "d date").select(
        T.week_start("d").alias("w"), T.week_label("d").alias("l")
    ).first()
    assert (r.w, r.l) == (dt.date(2026, 1, 5), "week_of_2026_01_05")


def test_departure_service_day_window(spark):
    lo, hi = T.service_day_window(dt.date(2019, 7, 1))
    assert lo == 1561968000  # 2019-07-01 04:00 EDT
    assert hi == lo + 22 * 3600  # 2019-07-02 02:00 EDT, inclusive
    rows = [(lo + 60,), (hi - 60,), (lo - 60,), (hi + 60,), (hi,)]
    df = spark.createDataFrame(rows, "x long").select("x", departure_service_day("x").alias("d"))
    got = {r.x: r.d for r in df.collect()}
    assert got[lo + 60] == dt.date(2019, 7, 1)
    assert got[hi - 60] == dt.date(2019, 7, 1)
    assert got[hi] == dt.date(2019, 7, 1)
    assert got[lo - 60] is None
    assert got[hi + 60] is None


def test_spring_forward_window_end():
    # 2019-03-10 02:00 does not exist in New York; the window ends at 03:00 EDT
    _, hi = T.service_day_window(dt.date(2019, 3, 9))
    assert hi == 1552201200
