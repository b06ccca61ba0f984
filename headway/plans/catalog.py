"""Registered queries: name -> (DataFrame builder, oracle SQL).

Every builder takes (spark, sf_dir) and returns a lazy DataFrame over the
whole driver tables.  Every SQL string is the same computation written
independently for DuckDB (see ``headway.plans.oracle``).  Column names and
types agree on both sides; doubles are rounded to 6 places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.operators import events as E
from headway.operators import matching as M
from headway.operators import scoring as S
from headway.operators import stats as ST
from headway.operators import filters as FL
from headway.plans import domain as D
from headway.plans.oracle import r6, with_ctes
from headway.session import materialize

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn: Builder) -> Builder:
        REGISTRY[name] = (fn, sql)
        return fn

    return deco


def r6c(*names: str) -> dict[str, F.Column]:
    return {n: F.round(F.col(n), 6) for n in names}


POOLED_SQL = f"""CAST(sum(num_predictions) AS BIGINT) AS num_predictions,
       CAST(sum(num_accurate_predictions) AS BIGINT) AS num_accurate_predictions,
       {r6('sum(mean_error * num_predictions) / nullif(sum(num_predictions), 0)')} AS mean_error,
       {r6('sqrt(sum(root_mean_squared_error * root_mean_squared_error * num_predictions) / nullif(sum(num_predictions), 0))')} AS root_mean_squared_error"""


# ---- scoring / matching / events ----------------------------------------------------

@register("score_accuracy", with_ctes(["accuracy"], f"""
SELECT environment, service_date, hour_of_day, minute_of_hour, route_id, stop_id, direction_id, bin, kind,
       in_next_two, num_predictions, num_accurate_predictions, {r6('mean_error')} AS mean_error,
       {r6('root_mean_squared_error')} AS root_mean_squared_error, block_start
FROM accuracy"""))
def q_score_accuracy(spark, d):
    return S.score(D.predictions(spark, d), D.matches(spark, d)).withColumns(r6c("mean_error", "root_mean_squared_error"))


@register("validate_accuracy", with_ctes(["hist"], """
SELECT bin, kind, CAST(count(*) AS BIGINT) AS n_rows,
       CAST(count(*) FILTER (WHERE (kind IS NULL OR kind IN ('mid_trip', 'at_terminal', 'reverse'))
            AND bin IN ('0-3 min', '3-6 min', '6-12 min', '12-30 min')
            AND service_date IS NOT NULL AND hour_of_day IS NOT NULL AND minute_of_hour IS NOT NULL
            AND stop_id IS NOT NULL AND route_id IS NOT NULL AND direction_id IS NOT NULL
            AND num_predictions IS NOT NULL AND num_accurate_predictions IS NOT NULL) AS BIGINT) AS n_valid
FROM hist GROUP BY bin, kind"""))
def q_validate_accuracy(spark, d):
    v = S.validate_accuracy(D.accuracy_hist(spark, d))
    return v.groupBy("bin", "kind").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("is_valid"), 1)).alias("n_valid")
    )


@register("vehicle_transitions", with_ctes(["transitions"], """
SELECT environment, mode, transition, CAST(count(*) AS BIGINT) AS n,
       CAST(count(DISTINCT id) AS BIGINT) AS vehicles
FROM transitions GROUP BY environment, mode, transition"""))
def q_vehicle_transitions(spark, d):
    return D.transitions(spark, d).groupBy("environment", "mode", "transition").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("vehicles")
    )


EVENT_COLS = [
    "environment", "vehicle_id", "vehicle_label", "is_deleted", "route_id", "direction_id", "trip_id", "stop_id",
    "arrival_time", "arrival_snapshot", "departure_time", "departure_snapshot", "closed_with",
]


@register("vehicle_events", with_ctes(["vehicle_events"], f"SELECT {', '.join(EVENT_COLS)} FROM vehicle_events"))
def q_vehicle_events(spark, d):
    return D.vehicle_events(spark, d).select(*EVENT_COLS)


@register("departure_anomalies", with_ctes(["vehicle_events"], """
SELECT environment, vehicle_id, stop_id, departure_snapshot, CAST(count(*) AS BIGINT) AS dwells_closed,
       min(arrival_snapshot) AS first_arrival_snapshot, max(route_id) AS route_id
FROM vehicle_events WHERE closed_with > 1
GROUP BY environment, vehicle_id, stop_id, departure_snapshot"""))
def q_departure_anomalies(spark, d):
    return E.departure_anomalies(D.vehicle_events(spark, d))


@register("dropped_vehicles", with_ctes(["vehicle_positions", "seq"], """
SELECT c.environment, c.mode, s.next_snapshot_time AS snapshot_time, CAST(count(*) AS BIGINT) AS dropped,
       string_agg(c.label, ',' ORDER BY c.label) AS labels
FROM vehicle_positions c
JOIN seq s ON s.environment = c.environment AND s.mode = c.mode AND s.snapshot_time = c.snapshot_time
WHERE s.next_snapshot_time IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM vehicle_positions n WHERE n.environment = c.environment AND n.mode = c.mode
                  AND n.id = c.id AND n.snapshot_time = s.next_snapshot_time)
GROUP BY c.environment, c.mode, s.next_snapshot_time"""))
def q_dropped_vehicles(spark, d):
    return E.dropped_vehicles(D.positions(spark, d), None, sequence=D.snapshot_log(spark, d))


@register("vehicle_events_top100", with_ctes(["vehicle_events"], f"""
SELECT {', '.join(EVENT_COLS)} FROM vehicle_events
ORDER BY arrival_time ASC NULLS LAST, environment, vehicle_id, stop_id, arrival_snapshot LIMIT 100"""))
def q_vehicle_events_top100(spark, d):
    return E.vehicle_events_top(D.vehicle_events(spark, d).select(*EVENT_COLS), 100)


MATCH_OUT = ["prediction_id", "match_type", "touch_time", "ev_environment", "ev_vehicle_id", "ev_stop_id", "ev_arrival_snapshot"]


@register("match_standard", with_ctes(["match_standard"], f"SELECT {', '.join(MATCH_OUT)} FROM match_standard"))
def q_match_standard(spark, d):
    return M.match_standard(D.predictions(spark, d), E.event_touches(D.vehicle_events(spark, d))).select(*MATCH_OUT)


@register("match_terminal", with_ctes(["match_terminal"], f"SELECT {', '.join(MATCH_OUT)} FROM match_terminal"))
def q_match_terminal(spark, d):
    return M.match_terminal(D.predictions(spark, d), E.event_touches(D.vehicle_events(spark, d))).select(*MATCH_OUT)


@register("match_all", with_ctes(["matched_predictions"], """
SELECT id, environment, vehicle_id, stop_id, file_timestamp, ev_vehicle_id, ev_arrival_snapshot, matched
FROM matched_predictions"""))
def q_match_all(spark, d):
    m = D.matches(spark, d)
    return M.with_matches(D.predictions(spark, d), m).select(
        "id", "environment", "vehicle_id", "stop_id", "file_timestamp", "ev_vehicle_id", "ev_arrival_snapshot", "matched"
    )


@register("nth_at_stop", with_ctes(["predictions"], """
SELECT id, environment, file_timestamp, stop_id, stops_away, arrival_time, departure_time, nth_at_stop
FROM predictions"""))
def q_nth_at_stop(spark, d):
    return D.predictions(spark, d).select(
        "id", "environment", "file_timestamp", "stop_id", "stops_away", "arrival_time", "departure_time", "nth_at_stop"
    )


# ---- statistics -----------------------------------------------------------------------

@register("stats_hourly", with_ctes(["hist"], f"""
SELECT environment, service_date, hour_of_day, {POOLED_SQL}
FROM hist GROUP BY environment, service_date, hour_of_day"""))
def q_stats_hourly(spark, d):
    return ST.stats_by_chart_range(D.accuracy_hist(spark, d), "Hourly", extra_keys=["service_date"]).withColumns(
        r6c("mean_error", "root_mean_squared_error")
    )


@register("stats_subhourly", with_ctes(["hist"], f"""
SELECT environment, service_date, hour_of_day, CAST(minute_of_hour // 15 * 15 AS INTEGER) AS resolution_bucket,
       {POOLED_SQL}
FROM hist GROUP BY environment, service_date, hour_of_day, minute_of_hour // 15 * 15"""))
def q_stats_subhourly(spark, d):
    return ST.stats_by_chart_range(
        D.accuracy_hist(spark, d), "Hourly", resolution="15", extra_keys=["service_date"]
    ).withColumns(r6c("mean_error", "root_mean_squared_error"))


@register("stats_daily", with_ctes(["hist"], f"""
SELECT environment, service_date, {POOLED_SQL} FROM hist GROUP BY environment, service_date"""))
def q_stats_daily(spark, d):
    return ST.stats_by_chart_range(D.accuracy_hist(spark, d), "Daily").withColumns(
        r6c("mean_error", "root_mean_squared_error")
    )


@register("stats_by_station", with_ctes(["hist"], f"""
SELECT environment, stop_id, {POOLED_SQL} FROM hist GROUP BY environment, stop_id"""))
def q_stats_by_station(spark, d):
    return ST.stats_by_chart_range(D.accuracy_hist(spark, d), "By Station").withColumns(
        r6c("mean_error", "root_mean_squared_error")
    )


@register("stats_overall", with_ctes(["hist"], f"SELECT environment, {POOLED_SQL} FROM hist GROUP BY environment"))
def q_stats_overall(spark, d):
    return ST.accuracy_context(D.accuracy_hist(spark, d)).withColumns(r6c("mean_error", "root_mean_squared_error"))


def _env_cols_sql() -> str:
    parts = []
    for env in ["prod", "dev-green", "dev-blue"]:
        p = env.replace("-", "_")
        n = f"CASE WHEN environment = '{env}' THEN num_predictions END"
        parts.append(
            f"""CAST(coalesce(sum({n}), 0) AS BIGINT) AS {p}_num_predictions,
       CAST(coalesce(sum(CASE WHEN environment = '{env}' THEN num_accurate_predictions END), 0) AS BIGINT) AS {p}_num_accurate,
       {r6(f"sum(CASE WHEN environment = '{env}' THEN mean_error * num_predictions END) / nullif(sum({n}), 0)")} AS {p}_mean_error,
       {r6(f"sqrt(sum(CASE WHEN environment = '{env}' THEN root_mean_squared_error * root_mean_squared_error * num_predictions END) / nullif(sum({n}), 0))")} AS {p}_rmse"""
        )
    return ",\n       ".join(parts)


@register("env_comparison", with_ctes(["hist"], f"""
SELECT service_date, {_env_cols_sql()}
FROM hist WHERE environment IN ('prod', 'dev-green', 'dev-blue') GROUP BY service_date"""))
def q_env_comparison(spark, d):
    w = ST.env_comparison(D.accuracy_hist(spark, d), "Daily")
    return w.withColumns(r6c(*[c for c in w.columns if c.endswith("_mean_error") or c.endswith("_rmse")]))


@register("accuracy_series", with_ctes(["hist"], """
SELECT service_date, environment,
       round(CASE WHEN coalesce(sum(num_predictions), 0) = 0 THEN 0.0
                  ELSE sum(num_accurate_predictions) / sum(num_predictions) END, 6) AS accuracy
FROM (SELECT h.service_date, e.environment,
             CASE WHEN h.environment = e.environment THEN h.num_predictions END AS num_predictions,
             CASE WHEN h.environment = e.environment THEN h.num_accurate_predictions END AS num_accurate_predictions
      FROM hist h, (SELECT unnest(['prod', 'dev-green', 'dev-blue']) AS environment) e)
GROUP BY service_date, environment"""))
def q_accuracy_series(spark, d):
    return ST.accuracy_series(D.accuracy_hist(spark, d), "Daily").withColumns(r6c("accuracy"))


@register("stations_by_accuracy", with_ctes(["hist"], """
SELECT stop_id,
       round(CASE WHEN sum(CASE WHEN environment = 'prod' THEN num_predictions END) > 0
             THEN sum(CASE WHEN environment = 'prod' THEN num_accurate_predictions END)
                  / sum(CASE WHEN environment = 'prod' THEN num_predictions END) ELSE 0.0 END, 6) AS prod_accuracy,
       round(CASE WHEN sum(CASE WHEN environment = 'dev-green' THEN num_predictions END) > 0
             THEN sum(CASE WHEN environment = 'dev-green' THEN num_accurate_predictions END)
                  / sum(CASE WHEN environment = 'dev-green' THEN num_predictions END) ELSE 0.0 END, 6) AS dev_green_accuracy,
       round(CASE WHEN sum(CASE WHEN environment = 'dev-blue' THEN num_predictions END) > 0
             THEN sum(CASE WHEN environment = 'dev-blue' THEN num_accurate_predictions END)
                  / sum(CASE WHEN environment = 'dev-blue' THEN num_predictions END) ELSE 0.0 END, 6) AS dev_blue_accuracy
FROM hist WHERE environment IN ('prod', 'dev-green', 'dev-blue') GROUP BY stop_id"""))
def q_stations_by_accuracy(spark, d):
    return ST.stations_by_accuracy(D.accuracy_hist(spark, d)).withColumns(
        r6c("prod_accuracy", "dev_green_accuracy", "dev_blue_accuracy")
    )


@register("export_rows", with_ctes(["hist"], """
SELECT service_date, strftime(service_date, '%Y-%m-%d') AS "Daily",
       CASE WHEN sum(num_predictions) <> 0 THEN round(100.0 * sum(num_accurate_predictions) / sum(num_predictions), 2)
            ELSE 0.0 END AS "Prod Accuracy",
       round(coalesce(sum(mean_error * num_predictions) / nullif(sum(num_predictions), 0), 0.0), 0) AS "Err",
       round(coalesce(sqrt(sum(root_mean_squared_error * root_mean_squared_error * num_predictions)
             / nullif(sum(num_predictions), 0)), 0.0), 0) AS "RMSE",
       CAST(sum(num_predictions) AS BIGINT) AS "Count"
FROM hist WHERE environment = 'prod' GROUP BY service_date"""))
def q_export_rows(spark, d):
    return ST.export_rows(D.accuracy_hist(spark, d), "Daily")


# ---- filters ------------------------------------------------------------------------------

HIST_COLS = [
    "environment", "service_date", "hour_of_day", "minute_of_hour", "route_id", "stop_id", "direction_id", "bin",
    "kind", "in_next_two", "num_predictions", "num_accurate_predictions", "mean_error", "root_mean_squared_error",
]
HIST_SEL = ", ".join(HIST_COLS[:-2]) + ", " + r6("mean_error") + " AS mean_error, " + r6("root_mean_squared_error") + " AS root_mean_squared_error"


def _hist_out(df):
    return df.select(*HIST_COLS).withColumns(r6c("mean_error", "root_mean_squared_error"))


def _hist_r(spark, d):
    return _hist_out(D.accuracy_hist(spark, d))


@register("filter_route", with_ctes(["hist"], f"""
SELECT {HIST_SEL} FROM hist WHERE route_id IN ('Green-B', 'Green-C', 'Green-D', 'Green-E')"""))
def q_filter_route(spark, d):
    # the "Green-All" option intersected with the subway mode
    return _hist_out(FL.filter_by_route(D.accuracy_hist(spark, d), "Green-B,Green-C,Green-D,Green-E,CR-Lowell", "subway"))


@register("filter_stop_group", with_ctes(["hist"], f"""
SELECT {HIST_SEL} FROM hist WHERE stop_id IN (SELECT unnest(['70001','70036','70038','70059','70061','70094',
  '70105','70106','70160','70161','70196','70197','70198','70199','70201','70202','70205','70206','70238','70260',
  '70261','70276','71199','70503']) UNION ALL SELECT '70065')"""))
def q_filter_stop_group(spark, d):
    return _hist_out(FL.filter_by_stop(D.accuracy_hist(spark, d), ["_terminal", "70065"]))


@register("filter_direction", with_ctes(["hist"], f"SELECT {HIST_SEL} FROM hist WHERE direction_id = 1"))
def q_filter_direction(spark, d):
    return _hist_out(FL.filter_by_direction(D.accuracy_hist(spark, d), "1"))


@register("filter_bin", with_ctes(["hist"], f"SELECT {HIST_SEL} FROM hist WHERE bin IN ('0-3 min', '12-30 min')"))
def q_filter_bin(spark, d):
    return _hist_out(FL.filter_by_bin(D.accuracy_hist(spark, d), "0-3 min,12-30 min"))


@register("filter_kind", with_ctes(["hist"], f"SELECT {HIST_SEL} FROM hist WHERE kind IN ('mid_trip', 'reverse')"))
def q_filter_kind(spark, d):
    return _hist_out(FL.filter_by_kind(D.accuracy_hist(spark, d), ["mid_trip", "reverse"]))


@register("filter_in_next_two", with_ctes(["hist"], f"SELECT {HIST_SEL} FROM hist WHERE NOT in_next_two"))
def q_filter_in_next_two(spark, d):
    return _hist_out(FL.filter_by_in_next_two(D.accuracy_hist(spark, d), "false"))


@register("filter_timeframe", with_ctes(["hist"], f"""
SELECT {HIST_SEL} FROM hist WHERE service_date BETWEEN DATE '1996-03-01' AND DATE '1996-04-05'"""))
def q_filter_timeframe(spark, d):
    return _hist_out(FL.filter_by_timeframe(D.accuracy_hist(spark, d), "Daily", None, "1996-03-01", "1996-04-05"))


ALL_FILTERS = {
    "route_ids": "Red,Orange,Blue", "mode": "subway", "stop_ids": ["_near_terminal"], "direction_id": "0",
    "bin": "All", "kinds": ["at_terminal", "mid_trip"], "in_next_two": "true", "chart_range": "By Station",
    "date_start": "1995-06-01", "date_end": "1995-07-01",
}


@register("filter_all", with_ctes(["hist"], f"""
SELECT environment, stop_id, {POOLED_SQL} FROM hist
WHERE route_id IN ('Blue', 'Orange', 'Red')
  AND stop_id IN (SELECT unnest(['70038','70040','70042','70044','70053','70055','70057','70059','70106','70110',
      '70112','70114','70232','70234','70236','70238','70160','70162','70164','70166','70260','70254','70256','70258',
      '70155','70157','70159','70196','70197','70198','70199','70202','70204','70206','70261','70263','70265','70267',
      '70270','70272','70274','70276','70001','70003','70005','70007','70032','70034','70036','70278','70088','70090',
      '70092','70094','70100','70102','70104','70105','70061','70063','70065','70067']))
  AND direction_id = 0 AND kind IN ('at_terminal', 'mid_trip') AND in_next_two
  AND service_date BETWEEN DATE '1995-06-01' AND DATE '1995-07-01'
GROUP BY environment, stop_id"""))
def q_filter_all(spark, d):
    q, err = FL.filter_accuracy(D.accuracy_hist(spark, d), ALL_FILTERS)
    assert err is None, err
    return ST.stats_by_chart_range(q, "By Station").withColumns(r6c("mean_error", "root_mean_squared_error"))


# ---- departures -----------------------------------------------------------------------------

from headway.operators import departures as DP  # noqa: E402
from headway.operators import maintenance as MT  # noqa: E402
from headway.operators import monitoring as MO  # noqa: E402
from headway.operators import stops as SP  # noqa: E402
from headway.operators import ingest as IN  # noqa: E402
from headway.plans.oracle import ROUTE_SQL, STOP_DIM_KEY_SQL, TERMINALS_SQL, fmt_unix  # noqa: E402
from headway.sources import adapters as A  # noqa: E402


def _matched(spark, d):
    ev = D.vehicle_events(spark, d)
    return ev, M.with_matches(D.predictions(spark, d), D.matches(spark, d))


ROUTE_RANK_SQL = ("CASE route_id WHEN 'Red' THEN 0 WHEN 'Blue' THEN 1 WHEN 'Orange' THEN 2 WHEN 'Green-B' THEN 3 "
                  "WHEN 'Green-C' THEN 4 WHEN 'Green-D' THEN 5 WHEN 'Green-E' THEN 6 WHEN 'Mattapan' THEN 7 ELSE 0 END")


@register("unpredicted_summary", with_ctes(["flagged_departures"], f"""
SELECT environment, service_day, route_id, CAST(count(*) AS BIGINT) AS departures,
       CAST(count(*) FILTER (WHERE NOT predicted) AS BIGINT) AS unpredicted,
       {r6('count(*) FILTER (WHERE NOT predicted) * 100.0 / count(*)')} AS pct_unpredicted
FROM flagged_departures WHERE stop_id IN {TERMINALS_SQL}
GROUP BY environment, service_day, route_id"""))
def q_unpredicted_summary(spark, d):
    ev, mp = _matched(spark, d)
    return DP.unpredicted_summary(ev, mp).withColumns(r6c("pct_unpredicted"))


@register("unpredicted_by_stop", with_ctes(["flagged_departures", "stops_dim"], f"""
SELECT f.environment, f.service_day, f.route_id, f.stop_id, f.departures, f.unpredicted, f.pct_unpredicted,
       CASE WHEN s.id IS NULL THEN f.stop_id ELSE s.description END AS stop_name
FROM (SELECT environment, service_day, route_id, stop_id, CAST(count(*) AS BIGINT) AS departures,
             CAST(count(*) FILTER (WHERE NOT predicted) AS BIGINT) AS unpredicted,
             {r6('count(*) FILTER (WHERE NOT predicted) * 100.0 / count(*)')} AS pct_unpredicted,
             {STOP_DIM_KEY_SQL} AS dim_key
      FROM flagged_departures WHERE stop_id IN {TERMINALS_SQL}
      GROUP BY environment, service_day, route_id, stop_id) f
LEFT JOIN stops_dim s ON s.id = f.dim_key"""))
def q_unpredicted_by_stop(spark, d):
    ev, mp = _matched(spark, d)
    return DP.unpredicted_by_stop(ev, mp, A.stops_dim(spark, d), dim_key=A.stop_dim_key(F.col("stop_id"))).withColumns(
        r6c("pct_unpredicted")
    )


@register("unpredicted_detail", with_ctes(["flagged_departures"], f"""
SELECT environment, service_day, route_id, stop_id, vehicle_id, trip_id, departure_time,
       {fmt_unix('departure_time')} AS departure
FROM flagged_departures WHERE NOT predicted"""))
def q_unpredicted_detail(spark, d):
    ev, mp = _matched(spark, d)
    return DP.unpredicted_detail(ev, mp)


@register("unpredicted_totals", with_ctes(["flagged_departures"], f"""
SELECT environment, service_day, CAST(sum(departures) AS BIGINT) AS total_departures,
       CAST(sum(unpredicted) AS BIGINT) AS total_unpredicted,
       round(CASE WHEN sum(departures) > 0 THEN sum(unpredicted) * 100.0 / sum(departures) ELSE 0.0 END, 6) AS total_pct
FROM (SELECT environment, service_day, route_id, count(*) AS departures,
             count(*) FILTER (WHERE NOT predicted) AS unpredicted
      FROM flagged_departures WHERE stop_id IN {TERMINALS_SQL}
      GROUP BY ALL)
GROUP BY environment, service_day"""))
def q_unpredicted_totals(spark, d):
    ev, mp = _matched(spark, d)
    return DP.totals(DP.unpredicted_summary(ev, mp), "departures", "unpredicted", ["environment", "service_day"]).withColumns(
        r6c("total_pct")
    )


_MISSED_INNER = """
      SELECT environment, service_day, route_id, {extra} trip_id, max(CASE WHEN NOT matched THEN 1 ELSE 0 END) AS um
      FROM eligible_departure_predictions
      WHERE stop_id IN {terms} AND trip_id IS NOT NULL
      GROUP BY ALL"""


@register("missed_summary", with_ctes(["eligible_departure_predictions"], f"""
SELECT environment, service_day, route_id, CAST(count(*) AS BIGINT) AS trips, CAST(sum(um) AS BIGINT) AS missed_trips,
       {r6('sum(um) * 100.0 / count(*)')} AS pct_missed
FROM ({_MISSED_INNER.format(extra='', terms=TERMINALS_SQL)})
GROUP BY environment, service_day, route_id"""))
def q_missed_summary(spark, d):
    _, mp = _matched(spark, d)
    return DP.missed_summary(mp).withColumns(r6c("pct_missed"))


@register("missed_by_stop", with_ctes(["eligible_departure_predictions", "stops_dim"], f"""
SELECT f.environment, f.service_day, f.route_id, f.stop_id, f.trips, f.missed_trips, f.pct_missed,
       CASE WHEN s.id IS NULL THEN f.stop_id ELSE s.description END AS stop_name
FROM (SELECT environment, service_day, route_id, stop_id, CAST(count(*) AS BIGINT) AS trips,
             CAST(sum(um) AS BIGINT) AS missed_trips, {r6('sum(um) * 100.0 / count(*)')} AS pct_missed,
             {STOP_DIM_KEY_SQL} AS dim_key
      FROM ({_MISSED_INNER.format(extra='stop_id,', terms=TERMINALS_SQL)})
      GROUP BY environment, service_day, route_id, stop_id) f
LEFT JOIN stops_dim s ON s.id = f.dim_key"""))
def q_missed_by_stop(spark, d):
    _, mp = _matched(spark, d)
    return DP.missed_by_stop(mp, A.stops_dim(spark, d), dim_key=A.stop_dim_key(F.col("stop_id"))).withColumns(r6c("pct_missed"))


@register("missed_detail", with_ctes(["eligible_departure_predictions"], f"""
SELECT environment, service_day, route_id, stop_id, vehicle_id, trip_id,
       {fmt_unix('min(departure_time)')} AS first_departure, {fmt_unix('max(departure_time)')} AS last_departure,
       {fmt_unix('min(file_timestamp)')} AS first_file, {fmt_unix('max(file_timestamp)')} AS last_file,
       CAST(count(*) AS BIGINT) AS predictions, min(departure_time) AS min_departure
FROM eligible_departure_predictions WHERE NOT matched
GROUP BY environment, service_day, route_id, stop_id, vehicle_id, trip_id"""))
def q_missed_detail(spark, d):
    _, mp = _matched(spark, d)
    return DP.missed_detail(mp)


@register("missed_totals", with_ctes(["eligible_departure_predictions"], f"""
SELECT environment, service_day, CAST(sum(trips) AS BIGINT) AS total_trips, CAST(sum(missed_trips) AS BIGINT) AS total_missed_trips,
       round(CASE WHEN sum(trips) > 0 THEN sum(missed_trips) * 100.0 / sum(trips) ELSE 0.0 END, 6) AS total_pct
FROM (SELECT environment, service_day, route_id, count(*) AS trips, sum(um) AS missed_trips
      FROM ({_MISSED_INNER.format(extra='', terms=TERMINALS_SQL)}) GROUP BY ALL)
GROUP BY environment, service_day"""))
def q_missed_totals(spark, d):
    _, mp = _matched(spark, d)
    return DP.totals(DP.missed_summary(mp), "trips", "missed_trips", ["environment", "service_day"]).withColumns(r6c("total_pct"))


# ---- monitoring ---------------------------------------------------------------------------------

@register("route_daily_accuracy", with_ctes(["route_daily", "route_spine"], """
SELECT s.route_id, s.service_date, coalesce(r.num_predictions, 0) AS num_predictions,
       coalesce(r.num_accurate_predictions, 0) AS num_accurate_predictions,
       round(CASE WHEN coalesce(r.num_predictions, 0) <> 0 THEN r.num_accurate_predictions / r.num_predictions ELSE 0.0 END, 6) AS accuracy
FROM route_spine s LEFT JOIN route_daily r ON r.route_id = s.route_id AND r.service_date = s.service_date"""))
def q_route_daily_accuracy(spark, d):
    return MO.route_daily_accuracy(D.accuracy_hist(spark, d)).withColumns(r6c("accuracy"))


@register("accuracy_drop", with_ctes(["route_daily"], f"""
SELECT s.route_id, s.service_date, round(coalesce(y.acc, 0.0), 6) AS yesterday_accuracy,
       round(coalesce(p.acc, 0.0), 6) AS previous_day_accuracy,
       coalesce(y.acc, 0.0) < coalesce(p.acc, 0.0) - 0.1 AS "drop"
FROM (SELECT DISTINCT d.service_date, unnest({ROUTE_SQL}) AS route_id
      FROM (SELECT service_date FROM route_daily UNION SELECT service_date + 1 FROM route_daily) d) s
LEFT JOIN (SELECT route_id, service_date, CASE WHEN num_predictions <> 0 THEN num_accurate_predictions / num_predictions ELSE 0.0 END AS acc FROM route_daily) y
  ON y.route_id = s.route_id AND y.service_date = s.service_date
LEFT JOIN (SELECT route_id, service_date, CASE WHEN num_predictions <> 0 THEN num_accurate_predictions / num_predictions ELSE 0.0 END AS acc FROM route_daily) p
  ON p.route_id = s.route_id AND p.service_date = s.service_date - 1"""))
def q_accuracy_drop(spark, d):
    return MO.accuracy_drops(D.accuracy_hist(spark, d)).withColumns(r6c("yesterday_accuracy", "previous_day_accuracy"))


# ---- stops ------------------------------------------------------------------------------------------

@register("stop_dim", with_ctes(["stops_dim"], """
SELECT id, mode, name, platform_name, description, unique_info,
       CASE WHEN unique_info THEN base ELSE base || ' - ' || id END AS display_name
FROM (SELECT *, count(*) OVER (PARTITION BY mode, description, name, platform_name) = 1 AS unique_info,
             CASE WHEN platform_name IS NULL THEN name ELSE name || ' (' || platform_name || ')' END AS base
      FROM stops_dim)"""))
def q_stop_dim(spark, d):
    return SP.stop_dim(SP.stops_from_feed(D.landed(spark, d, "stops")))


# ---- maintenance ------------------------------------------------------------------------------------

PRUNE_AS_OF = 1705363200 + 6 * 3600 + 7 * 86400  # cutoff = 2024-01-16 01:00 New York


@register("prune_predictions", with_ctes(["predictions"], f"""
SELECT id, environment, file_timestamp FROM predictions WHERE file_timestamp >= {PRUNE_AS_OF - 7 * 86400}"""))
def q_prune_predictions(spark, d):
    return MT.prune_predictions(D.predictions(spark, d), PRUNE_AS_OF).select("id", "environment", "file_timestamp")


@register("prune_events", with_ctes(["vehicle_events"], f"""
SELECT environment, vehicle_id, stop_id, arrival_snapshot, arrival_time FROM vehicle_events
WHERE arrival_time IS NULL OR arrival_time >= {PRUNE_AS_OF - 7 * 86400 - 1800}"""))
def q_prune_events(spark, d):
    return MT.prune_events(D.vehicle_events(spark, d), PRUNE_AS_OF).select(
        "environment", "vehicle_id", "stop_id", "arrival_snapshot", "arrival_time"
    )


@register("weekly_partitions", with_ctes(["hist"], """
SELECT CAST(date_trunc('week', service_date) AS DATE) AS week_start,
       'week_of_' || strftime(date_trunc('week', service_date), '%Y_%m_%d') AS week_label,
       CAST(count(*) AS BIGINT) AS n_rows, min(service_date) AS first_date, max(service_date) AS last_date
FROM hist GROUP BY ALL"""))
def q_weekly_partitions(spark, d):
    return MT.with_week_partition(D.accuracy_hist(spark, d)).groupBy("week_start", "week_label").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("service_date").alias("first_date"), F.max("service_date").alias("last_date")
    )


@register("backfill_window", with_ctes(["hist"], """
SELECT first_service_date, CAST(first_service_date + 6 AS DATE) AS last_service_date, 'copied' AS status,
       CAST(first_service_date + 7 AS DATE) AS next_cursor,
       CAST(count(*) FILTER (WHERE service_date BETWEEN first_service_date AND first_service_date + 6) AS BIGINT) AS rows_copied
FROM hist, (SELECT min(service_date) AS first_service_date FROM hist) GROUP BY first_service_date"""))
def q_backfill_window(spark, d):
    """One backfill run: the cursor starts at the earliest service date (read
    once, like the migration-state row); ``today`` is far after the window."""
    import datetime as _dt

    acc = D.accuracy_hist(spark, d)
    cursor = MT.earliest_service_date(acc).first()["first_service_date"]
    _, report = MT.backfill_run(acc, cursor, today=cursor + _dt.timedelta(days=3650))
    return report


@register("reconcile_copies", """
WITH a AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS service_date FROM orders),
     b AS (SELECT CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN -o_orderkey ELSE o_orderkey END AS id,
                  CAST(o_orderdate AS DATE) AS service_date FROM orders),
     u AS (SELECT CASE WHEN b.id IS NULL THEN 'monolithic' ELSE 'partitioned' END AS side,
                  coalesce(a.service_date, b.service_date) AS service_date
           FROM a FULL OUTER JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL)
SELECT t.side, t.row_count, CAST(coalesce(s.unmatched, 0) AS BIGINT) AS unmatched, s.min_service_date, s.max_service_date
FROM (SELECT 'monolithic' AS side, CAST(count(*) AS BIGINT) AS row_count FROM a
      UNION ALL SELECT 'partitioned', CAST(count(*) AS BIGINT) FROM b) t
LEFT JOIN (SELECT side, count(*) AS unmatched, min(service_date) AS min_service_date, max(service_date) AS max_service_date
           FROM u GROUP BY side) s ON s.side = t.side""")
def q_reconcile_copies(spark, d):
    a, b = A.accuracy_copies(spark, d)
    return MT.reconcile(a, b).select("side", "row_count", F.col("unmatched").cast("long").alias("unmatched"), "min_service_date", "max_service_date")


@register("reconcile_by_date", """
WITH a AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS service_date FROM orders),
     b AS (SELECT CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN -o_orderkey ELSE o_orderkey END AS id,
                  CAST(o_orderdate AS DATE) AS service_date FROM orders)
SELECT CASE WHEN b.id IS NULL THEN 'monolithic' ELSE 'partitioned' END AS side,
       coalesce(a.service_date, b.service_date) AS service_date, CAST(count(*) AS BIGINT) AS unmatched
FROM a FULL OUTER JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL GROUP BY ALL""")
def q_reconcile_by_date(spark, d):
    a, b = A.accuracy_copies(spark, d)
    return MT.reconcile_by_date(a, b)


@register("consolidate_bins", with_ctes(["hist"], f"""
SELECT environment, service_date, hour_of_day, minute_of_hour, route_id, stop_id, direction_id,
       CASE WHEN bin = '6-8 min' THEN '6-12 min' ELSE bin END AS bin, kind, in_next_two, num_predictions,
       num_accurate_predictions, {r6('mean_error')} AS mean_error, {r6('root_mean_squared_error')} AS root_mean_squared_error
FROM hist WHERE bin NOT IN ('8-10 min', '10-12 min')"""))
def q_consolidate_bins(spark, d):
    return MT.consolidate_bins(_hist_r(spark, d))


# ---- ingest ---------------------------------------------------------------------------------------------

FLAT_COLS = ["file_timestamp", "environment", "trip_id", "vehicle_id", "is_deleted", "stop_id", "route_id",
             "arrival_time", "departure_time", "stops_away", "direction_id", "kind", "nth_at_stop"]


@register("flatten_trip_updates", with_ctes(["fetched_raw"], f"""
SELECT {', '.join(FLAT_COLS)} FROM (
  SELECT *, false AS is_deleted, CAST(row_number() OVER (
           PARTITION BY environment, file_timestamp, nth_fetch, stop_id
           ORDER BY CASE WHEN stops_away = 0 THEN 0 ELSE 1 END, coalesce(arrival_time, departure_time) NULLS LAST,
                    id // 500, first_id, id) AS INTEGER) AS nth_at_stop
  FROM (SELECT *, min(id) OVER (PARTITION BY environment, file_timestamp, nth_fetch, id // 500, trip_id, vehicle_id, route_id,
                                direction_id) AS first_id
        FROM fetched_raw)
  WHERE stops_away IS NOT NULL AND (arrival_time IS NOT NULL OR departure_time IS NOT NULL))"""))
def q_flatten_trip_updates(spark, d):
    return IN.flatten_trip_updates(D.landed(spark, d, "trip_updates")).select(*FLAT_COLS)


@register("classify_kind", with_ctes(["fetched_raw"], """
SELECT kind, CAST(count(*) AS BIGINT) AS n FROM fetched_raw
WHERE stops_away IS NOT NULL AND (arrival_time IS NOT NULL OR departure_time IS NOT NULL) GROUP BY kind"""))
def q_classify_kind(spark, d):
    return IN.flatten_trip_updates(D.landed(spark, d, "trip_updates")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@register("generic_stop_id", with_ctes(["fetched_raw"], """
SELECT stop_id, CAST(count(*) AS BIGINT) AS n FROM fetched_raw GROUP BY stop_id"""))
def q_generic_stop_id(spark, d):
    from headway.functions.columns import generic_stop_id

    docs = D.landed(spark, d, "trip_updates")
    raw = docs.select(F.explode("entity").alias("e")).select(F.explode("e.trip_update.stop_time_update").alias("u"))
    return raw.groupBy(generic_stop_id(F.col("u.stop_id")).alias("stop_id")).agg(F.count(F.lit(1)).alias("n"))


POS_COLS = ["environment", "mode", "snapshot_time", "id", "label", "is_deleted", "trip_id", "route_id", "direction_id",
            "current_status", "stop_id", "timestamp"]


@register("vehicle_positions", with_ctes(["vehicle_positions"], f"SELECT {', '.join(POS_COLS)} FROM vehicle_positions"))
def q_vehicle_positions(spark, d):
    return IN.vehicle_positions_from_feed(D.landed(spark, d, "vehicle_feed")).select(*POS_COLS)


@register("dedupe_snapshots", with_ctes(["snapshots"], """
SELECT environment, mode, min(snapshot_time) AS snapshot_time FROM snapshots WHERE snapshot_time // 300 % 7 <> 0
GROUP BY environment, mode, snapshot_time // 600
UNION ALL SELECT environment, mode, snapshot_time FROM snapshots WHERE snapshot_time // 300 % 7 = 0"""))
def q_dedupe_snapshots(spark, d):
    return IN.snapshots_of(IN.dedupe_snapshots(A.refetched(D.landed(spark, d, "vehicle_feed"))))


CR_COLS = ["environment", "file_timestamp", "vehicle_id", "trip_id", "route_id", "direction_id", "arrival_time",
           "departure_time", "stop_id"]


@register("flatten_cr_predictions", with_ctes(["predictions_raw"], """
SELECT 'prod' AS environment, file_timestamp, vehicle_id, trip_id, route_id, direction_id, arrival_time, departure_time, stop_id
FROM predictions_raw WHERE vehicle_id IS NOT NULL"""))
def q_flatten_cr_predictions(spark, d):
    return IN.flatten_cr_predictions(D.landed(spark, d, "cr_predictions")).select(*CR_COLS)


@register("cr_vehicle_positions", with_ctes(["cr_vehicle_positions"], f"""
SELECT 'prod' AS environment, 'commuter_rail' AS mode, snapshot_time, id, label, false AS is_deleted, trip_id, route_id,
       direction_id, current_status, stop_id, timestamp FROM cr_vehicle_positions"""))
def q_cr_vehicle_positions(spark, d):
    return IN.parse_cr_vehicles(D.landed(spark, d, "cr_vehicles")).select(*POS_COLS)


@register("export_rows_station", with_ctes(["hist", "stops_dim"], """
SELECT h.stop_id, coalesce(n.display_name, h.stop_id) AS "By Station",
       CASE WHEN h.n <> 0 THEN round(100.0 * h.a / h.n, 2) ELSE 0.0 END AS "Prod Accuracy",
       round(coalesce(h.me, 0.0), 0) AS "Err", round(coalesce(h.rm, 0.0), 0) AS "RMSE", h.n AS "Count"
FROM (SELECT stop_id, CAST(sum(num_predictions) AS BIGINT) AS n, sum(num_accurate_predictions) AS a,
             sum(mean_error * num_predictions) / nullif(sum(num_predictions), 0) AS me,
             sqrt(sum(root_mean_squared_error * root_mean_squared_error * num_predictions) / nullif(sum(num_predictions), 0)) AS rm
      FROM hist WHERE environment = 'prod' GROUP BY stop_id) h
LEFT JOIN (SELECT CASE id WHEN '0' THEN '70061' WHEN '1' THEN '70063' WHEN '2' THEN '70105' WHEN '3' THEN '70036'
                          WHEN '4' THEN '70001' WHEN '5' THEN '70197' END AS stop_id,
                  CASE WHEN count(*) OVER (PARTITION BY mode, description, name, platform_name) = 1 THEN base
                       ELSE base || ' - ' || id END AS display_name
           FROM (SELECT *, CASE WHEN platform_name IS NULL THEN name ELSE name || ' (' || platform_name || ')' END AS base
                 FROM stops_dim)
           QUALIFY id IN ('0', '1', '2', '3', '4', '5')) n
  ON n.stop_id = h.stop_id"""))
def q_export_rows_station(spark, d):
    names = A.fixture_station_names(SP.stop_dim(SP.stops_from_feed(D.landed(spark, d, "stops"))))
    return ST.export_rows(D.accuracy_hist(spark, d), "By Station", station_names=names)


# ---- from the landed feeds to scores --------------------------------------------------------------------

_SCORE_SELECT = f"""
SELECT environment, service_date, hour_of_day, minute_of_hour, route_id, stop_id, direction_id, bin, kind,
       in_next_two, num_predictions, num_accurate_predictions, {r6('mean_error')} AS mean_error,
       {r6('root_mean_squared_error')} AS root_mean_squared_error, block_start
FROM """


def _score_feeds(spark, d: str, feed: str, predictions: DataFrame, positions: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Scores from parsed feeds.  Matching and scoring read the predictions, the transitions and the events several times,
    so each is stored once; the documents are parsed once for each."""

    def stored(name: str, build) -> DataFrame:
        return materialize(spark, build, f"{feed}_{name}", (d,))

    pos = stored("positions", lambda: positions)
    log = stored("snapshot_log", lambda: E.snapshot_sequence(snapshots))
    tr = stored("transitions", lambda: E.vehicle_transitions(pos, None, sequence=log))
    ev = stored("events", lambda: E.vehicle_events(tr))
    p = stored("predictions", lambda: predictions)
    acc = S.score(p, M.match_all(p, E.event_touches(ev)))
    return acc.withColumns(r6c("mean_error", "root_mean_squared_error"))


@register("score_subway_feeds", with_ctes(["accuracy_feed"], _SCORE_SELECT + "accuracy_feed"))
def q_score_subway_feeds(spark, d):
    p = IN.flatten_trip_updates(D.landed(spark, d, "trip_updates")).withColumn("id", IN.prediction_id())
    docs = D.landed(spark, d, "vehicle_feed")
    return _score_feeds(spark, d, "subway", p, IN.vehicle_positions_from_feed(docs), IN.snapshots_of(docs))


@register("score_cr_feeds", with_ctes(["accuracy_cr"], _SCORE_SELECT + "accuracy_cr"))
def q_score_cr_feeds(spark, d):
    docs = D.landed(spark, d, "cr_vehicles")
    snaps = docs.select(F.lit("prod").alias("environment"), F.lit("commuter_rail").alias("mode"), "snapshot_time").distinct()
    p = IN.flatten_cr_predictions(D.landed(spark, d, "cr_predictions"))
    return _score_feeds(spark, d, "commuter_rail", p, IN.parse_cr_vehicles(docs), snaps)
