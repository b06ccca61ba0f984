"""Reports come back in their documented order."""

from headway.functions.columns import route_rank
from headway.operators import departures as DP
from headway.operators import stats as ST
from headway.plans import catalog
from headway.plans import domain as D

SF = "/root/testdata/sf0.001"


def ordered(keys):
    return len(keys) > 3 and keys == sorted(keys)


def test_hours_and_days_ascend(spark):
    acc = D.accuracy_hist(spark, SF)
    assert ordered([r.hour_of_day for r in ST.stats_by_chart_range(acc, "Hourly").collect()])
    assert ordered([(r.hour_of_day, r.resolution_bucket) for r in ST.stats_by_chart_range(acc, "Hourly", 15).collect()])
    assert ordered([r.service_date for r in ST.stats_by_chart_range(acc, "Daily").collect()])


def test_departure_summaries_by_day_and_route(spark):
    ev, mp = catalog._matched(spark, SF)
    for df in (DP.unpredicted_summary(ev, mp), DP.missed_summary(mp)):
        got = df.withColumn("_rank", route_rank("route_id")).collect()
        assert ordered([(r.environment, r.service_day, r._rank, r.route_id) for r in got])


def test_departures_by_stop(spark):
    ev, mp = catalog._matched(spark, SF)
    stops = D.stops(spark, SF) if hasattr(D, "stops") else catalog.SP.stop_dim(catalog.SP.stops_from_feed(D.landed(spark, SF, "stops")))
    assert ordered([(r.environment, r.service_day, r.route_id, r.stop_id) for r in DP.unpredicted_by_stop(ev, mp, stops).collect()])
    assert ordered([(r.environment, r.service_day, r.route_id, -r.trips, r.stop_id) for r in DP.missed_by_stop(mp, stops).collect()])


def test_details(spark):
    ev, mp = catalog._matched(spark, SF)
    got = DP.unpredicted_detail(ev, mp).collect()
    assert ordered([(r.environment, r.service_day, r.route_id, r.stop_id, r.departure_time) for r in got])
    got = DP.missed_detail(mp).collect()
    key = lambda x: (x is None, x or "")
    assert ordered([(r.environment, r.service_day, r.route_id, r.stop_id, key(r.vehicle_id)) for r in got])


def test_stations_by_accuracy(spark):
    got = ST.stations_by_accuracy(D.accuracy_hist(spark, SF)).collect()
    assert ordered([(r.prod_accuracy, r.dev_green_accuracy, r.stop_id) for r in got])
