"""Report sums kept beside the published accuracy table."""

import datetime as dt
import random

import pytest

from headway.operators import stats as ST
from headway.streaming import accuracy as AC
from headway.streaming.published import Published, StaleVersion

DAY = dt.date(2024, 1, 15)
SCHEMA = ("environment string, service_date date, hour_of_day int, minute_of_hour int, route_id string, stop_id string, direction_id int, bin string, "
          "kind string, in_next_two boolean, num_predictions int, num_accurate_predictions int, mean_error double, root_mean_squared_error double, block_start long")


def block(rng, n):
    """The rows of the ``n``-th block, of a day from 3 o'clock on."""
    day, at = DAY + dt.timedelta(days=n // 288), n % 288
    out = []
    for _ in range(rng.randint(1, 4)):
        k, none = rng.randint(1, 50), rng.random() < 0.2
        out.append((rng.choice(["prod", "dev-green"]), day, 3 + at // 12, at % 12 * 5, rng.choice("AB"), rng.choice("xyz"), 0, "0-3 min", rng.choice([None, "mid_trip"]), True,
                    k, rng.randint(0, k), None if none else rng.uniform(-90, 90), None if none else rng.uniform(0, 120), 1705305600 + n * 300))
    return out


def rounded(df):
    return [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()]


def test_sums_equal_a_scan_after_any_rescoring(spark, tmp_path):
    rng, root, now = random.Random(9), str(tmp_path / "a"), {}
    for run in ([*range(0, 30), 290], [5, 6, 7, 28, 40], [290, 291, 0], [5]):
        rows = {n: block(rng, n) for n in run}
        now |= rows
        AC.publish_accuracy(spark, spark.createDataFrame([r for b in rows.values() for r in b], SCHEMA), root)
    exp = spark.createDataFrame([r for b in now.values() for r in b], SCHEMA)
    assert sorted(map(repr, AC.accuracy(spark, root).select(exp.columns).collect())) == sorted(map(repr, exp.collect()))
    kept = AC.report_rows(spark, root)
    assert kept.count() < exp.count()
    for chart in ("Daily", "Hourly", "By Station"):
        assert rounded(ST.stats_by_chart_range(kept, chart)) == rounded(ST.stats_by_chart_range(exp, chart))
    first = AC.report_rows(spark, root, last=DAY)
    assert rounded(ST.stats_by_chart_range(first, "Daily")) == rounded(ST.stats_by_chart_range(exp.filter(exp.service_date == DAY), "Daily"))


def test_two_runs_over_one_hour_at_once(spark, tmp_path, monkeypatch):
    rng, root = random.Random(1), str(tmp_path / "a")
    rows = lambda n: spark.createDataFrame(block(rng, n), SCHEMA)
    AC.publish_accuracy(spark, rows(0), root)
    stale = Published(spark, root).latest()
    AC.publish_accuracy(spark, rows(1), root)
    before = rounded(AC.report_rows(spark, root).orderBy(*AC.KEYS))
    with monkeypatch.context() as m:
        m.setattr(Published, "latest", lambda self, real=Published.latest, seen=[]: seen.append(1) or (stale if len(seen) == 1 else real(self)))
        with pytest.raises(StaleVersion):
            AC.publish_accuracy(spark, rows(2), root)
    assert rounded(AC.report_rows(spark, root).orderBy(*AC.KEYS)) == before


def test_rows_that_the_insert_check_refuses_are_kept_apart(spark, tmp_path):
    root = str(tmp_path / "a")
    good = [r for r in block(random.Random(3), 4)][:1]
    bad = [(*good[0][:4], None, *good[0][5:]), (*good[0][:7], "never", *good[0][8:])]  # no route, no such bin
    AC.publish_accuracy(spark, spark.createDataFrame(good + bad, SCHEMA), root)
    assert AC.accuracy(spark, root).count() == 1 and AC.report_rows(spark, root).count() == 1
    assert sorted((r.route_id is None, r.bin == "never") for r in AC.rejected(spark, root).collect()) == [(False, True), (True, False)]
    AC.publish_accuracy(spark, spark.createDataFrame(bad[:1], SCHEMA), root)  # the block again: what it had goes
    assert (AC.accuracy(spark, root).count(), AC.report_rows(spark, root).count(), AC.rejected(spark, root).count()) == (0, 0, 1)
