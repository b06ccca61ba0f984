"""Physical-plan properties that must hold at any scale."""

import pytest

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    import __spark_entry__ as E

    return {name: _plan(fn(spark, SF)) for name, fn in E.queries().items()}


def test_no_cartesian_or_nested_loop_joins(plans):
    bad = {k for k, p in plans.items() if "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p}
    assert not bad


def test_no_python_udfs_in_batch_queries(plans):
    bad = {k for k, p in plans.items() if "BatchEvalPython" in p or "ArrowEvalPython" in p or "FlatMapGroupsInPandas" in p}
    assert not bad


def test_timeframe_filter_prunes_week_partitions(spark):
    import __spark_entry__ as E

    p = _plan(E.queries()["filter_timeframe"](spark, SF))
    assert "PartitionFilters: [isnotnull(week_start" in p
    assert "GreaterThanOrEqual(service_date" in p


def test_projection_reaches_scan(spark):
    import __spark_entry__ as E

    p = _plan(E.queries()["stats_by_station"](spark, SF))
    scans = [line for line in p.splitlines() if "FileScan parquet" in line]
    assert scans and all("mean_error" in s and "trip_id" not in s and "bin" not in s.split("ReadSchema")[-1] for s in scans)


def test_interval_joins_carry_time_bucket(spark):
    from headway.operators import events as E
    from headway.operators import matching as M
    from headway.plans import domain as D

    ev = D.vehicle_events(spark, SF)
    m = _plan(M.match_all(D.predictions(spark, SF), E.event_touches(ev)))
    joins = [line for line in m.splitlines() if "Join" in line and "[" in line]
    assert joins and all("bucket" in j for j in joins)
    d = _plan(E.vehicle_events(D.transitions(spark, SF)))
    assert any("bucket" in line for line in d.splitlines() if "Join" in line and "Inner" in line)


def test_scoring_is_one_grouped_pass(spark):
    from headway.operators import scoring as S
    from headway.plans import domain as D

    p = _plan(S.score(D.predictions(spark, SF), D.matches(spark, SF)))
    assert p.count("Exchange hashpartitioning") <= 2
    assert "partial_count" in p or "partial_sum" in p


def test_one_day_report_prunes_prediction_partitions(spark):
    import datetime as dt

    from headway.operators import departures as DP
    from headway.operators import matching as M
    from headway.plans import domain as D

    mp = M.with_matches(D.predictions(spark, SF), D.matches(spark, SF))
    p = _plan(DP.missed_summary(mp, date=dt.date(2024, 1, 15), env="prod"))
    assert "PartitionFilters: [isnotnull(file_date" in p
