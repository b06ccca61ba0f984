"""Oracle SQL (DuckDB dialect) for every registered query.

Written independently of the DataFrame code: the adapter mapping is
re-stated as CTEs over the driver's pre-registered views and every query
is a plain brute-force SQL formulation (self joins, windows, correlated
EXISTS) of the same semantics.  Doubles are rounded to 6 places and
integers cast to the same width as on the Spark side.
"""

from __future__ import annotations

import re

ENV_SQL = "['prod','dev-green','dev-blue']"
ROUTE_SQL = "['Red','Blue','Orange','Green-B','Green-C','Green-D','Green-E','Mattapan']"
STOP_SQL = "['70061','70063','70105','70036','70001','70197','70260','70065']"
HIST_BINS_SQL = "['0-3 min','3-6 min','6-8 min','8-10 min','10-12 min','6-12 min','12-30 min']"
TERMINALS_SQL = (
    "('70001','70036','70038','70059','70061','70094','70105','70106','70160','70161','70196','70197',"
    "'70198','70199','70201','70202','70205','70206','70238','70260','70261','70276','71199','70503')"
)
SUBWAY_ROUTES_SQL = "('Red','Blue','Orange','Green-B','Green-C','Green-D','Green-E','Mattapan')"


def local_ts(x: str) -> str:
    return f"timezone('America/New_York', to_timestamp({x}))"


def svc_date(x: str) -> str:
    lt = local_ts(x)
    return f"(CASE WHEN hour({lt}) < 3 THEN CAST({lt} AS DATE) - 1 ELSE CAST({lt} AS DATE) END)"


def svc_hour(x: str) -> str:
    lt = local_ts(x)
    return f"CAST(CASE WHEN hour({lt}) < 3 THEN hour({lt}) + 24 ELSE hour({lt}) END AS INTEGER)"


def svc_minute(x: str) -> str:
    return f"CAST(minute({local_ts(x)}) // 5 * 5 AS INTEGER)"


CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, deps: list[str], body: str) -> None:
    CTES[name] = (deps, body)


cte("base", [], """
  SELECT event_id, event_type, value,
         CAST(user_id AS BIGINT) AS v,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         1705363200 + user_id % 30 * 86400 + (CAST(floor(epoch(ts)) AS BIGINT) - 1704067200) // 60 AS t
  FROM events""")

cte("vehicle_positions", ["base"], f"""
  SELECT {ENV_SQL}[v % 3 + 1] AS environment, 'subway' AS mode, 'V' || v AS id, 'L' || v AS label,
         k = 99 AS is_deleted, 'T' || v || '-' || (t // 900) AS trip_id,
         {ROUTE_SQL}[v % 8 + 1] AS route_id, CAST(v % 2 AS INTEGER) AS direction_id,
         CASE WHEN event_type IN ('purchase', 'error') THEN 'STOPPED_AT'
              WHEN event_type = 'signup' THEN 'INCOMING_AT' ELSE 'IN_TRANSIT_TO' END AS current_status,
         {STOP_SQL}[((t // 900) + v) % 8 + 1] AS stop_id, t AS timestamp,
         (t // 300) * 300 + 300 AS snapshot_time
  FROM (SELECT *, row_number() OVER (PARTITION BY v, t // 300 ORDER BY t DESC, event_id DESC) AS rn FROM base)
  WHERE rn = 1""")

cte("cr_vehicle_positions", ["base"], f"""
  SELECT 'V' || v AS id, 'L' || v AS label, 'T' || v || '-' || (t // 900) AS trip_id, {ROUTE_SQL}[v % 8 + 1] AS route_id,
         CAST(v % 2 AS INTEGER) AS direction_id,
         CASE WHEN event_type IN ('purchase', 'error') THEN 'STOPPED_AT'
              WHEN event_type = 'signup' THEN 'INCOMING_AT' ELSE 'IN_TRANSIT_TO' END AS current_status,
         {STOP_SQL}[((t // 900) + v) % 8 + 1] AS stop_id, t AS timestamp, (t // 300) * 300 + 300 AS snapshot_time
  FROM (SELECT *, row_number() OVER (PARTITION BY v, t // 300 ORDER BY t DESC, event_id DESC) AS rn
        FROM base WHERE event_id % 23 <> 0)
  WHERE rn = 1""")

cte("snapshots", ["base"], f"""
  SELECT unnest({ENV_SQL}) AS environment, 'subway' AS mode, snapshot_time
  FROM (SELECT DISTINCT (t // 300) * 300 + 300 AS snapshot_time FROM base)""")

cte("seq", ["snapshots"], """
  SELECT *, lag(snapshot_time) OVER (PARTITION BY environment, mode ORDER BY snapshot_time) AS prev_snapshot_time,
            lead(snapshot_time) OVER (PARTITION BY environment, mode ORDER BY snapshot_time) AS next_snapshot_time
  FROM snapshots""")

cte("transitions", ["vehicle_positions", "seq"], """
  SELECT c.*, s.prev_snapshot_time, o.label AS old_label, o.route_id AS old_route_id, o.trip_id AS old_trip_id,
         o.stop_id AS old_stop_id, o.current_status AS old_current_status,
         CASE WHEN o.id IS NULL AND c.current_status = 'STOPPED_AT' THEN 'new_arrival'
              WHEN o.id IS NULL THEN 'new'
              WHEN c.stop_id IS NOT DISTINCT FROM o.stop_id AND c.current_status = 'STOPPED_AT'
                   AND o.current_status <> 'STOPPED_AT' THEN 'arrival'
              WHEN c.stop_id IS DISTINCT FROM o.stop_id AND o.current_status = 'STOPPED_AT'
                   AND c.current_status = 'STOPPED_AT' THEN 'departure_arrival'
              WHEN c.stop_id IS DISTINCT FROM o.stop_id AND o.current_status = 'STOPPED_AT' THEN 'departure'
              ELSE 'none' END AS transition
  FROM vehicle_positions c
  JOIN seq s ON s.environment = c.environment AND s.mode = c.mode AND s.snapshot_time = c.snapshot_time
  LEFT JOIN vehicle_positions o ON o.environment = c.environment AND o.mode = c.mode AND o.id = c.id
       AND o.snapshot_time = s.prev_snapshot_time""")

cte("arrivals", ["transitions"], """
  SELECT environment, id AS vehicle_id, label AS vehicle_label, is_deleted, route_id, direction_id, trip_id,
         stop_id, timestamp AS arrival_time, snapshot_time AS arrival_snapshot
  FROM transitions
  WHERE transition IN ('new_arrival', 'arrival', 'departure_arrival')
    AND nullif(trim(id), '') IS NOT NULL AND nullif(trim(environment), '') IS NOT NULL
    AND nullif(trim(label), '') IS NOT NULL AND nullif(trim(route_id), '') IS NOT NULL
    AND nullif(trim(trip_id), '') IS NOT NULL AND nullif(trim(stop_id), '') IS NOT NULL
    AND is_deleted IS NOT NULL AND direction_id IS NOT NULL""")

cte("departures", ["transitions"], """
  SELECT environment, id AS vehicle_id, old_route_id AS route_id, old_stop_id AS stop_id,
         timestamp AS departure_time, snapshot_time AS departure_snapshot
  FROM transitions WHERE transition IN ('departure', 'departure_arrival')""")

cte("closing", ["arrivals", "departures"], """
  SELECT a.environment, a.vehicle_id, a.stop_id, a.arrival_snapshot,
         min(d.departure_snapshot) AS departure_snapshot,
         arg_min(d.departure_time, d.departure_snapshot) AS departure_time
  FROM arrivals a JOIN departures d
    ON d.environment = a.environment AND d.vehicle_id = a.vehicle_id AND d.stop_id = a.stop_id
   AND d.departure_snapshot > a.arrival_snapshot
   AND a.arrival_time > d.departure_snapshot - CASE WHEN d.route_id = 'Mattapan' THEN 1200 ELSE 1800 END
  GROUP BY a.environment, a.vehicle_id, a.stop_id, a.arrival_snapshot""")

cte("vehicle_events", ["arrivals", "closing"], """
  SELECT a.*, c.departure_snapshot, c.departure_time,
         CAST(CASE WHEN c.departure_snapshot IS NOT NULL THEN count(*) OVER
              (PARTITION BY a.environment, a.vehicle_id, a.stop_id, c.departure_snapshot) END AS INTEGER) AS closed_with
  FROM arrivals a LEFT JOIN closing c
    ON c.environment = a.environment AND c.vehicle_id = a.vehicle_id AND c.stop_id = a.stop_id
   AND c.arrival_snapshot = a.arrival_snapshot""")

cte("touches", ["vehicle_events"], """
  SELECT environment, vehicle_id, stop_id, arrival_snapshot, trip_id, direction_id, arrival_time,
         departure_time, departure_snapshot, arrival_snapshot AS touch_time FROM vehicle_events
  UNION ALL
  SELECT environment, vehicle_id, stop_id, arrival_snapshot, trip_id, direction_id, arrival_time,
         departure_time, departure_snapshot, departure_snapshot AS touch_time FROM vehicle_events
  WHERE closed_with = 1""")

cte("predictions_raw", ["base"], f"""
  SELECT event_id AS id, t - t % 60 AS file_timestamp, {ENV_SQL}[v % 3 + 1] AS environment,
         'T' || v || '-' || ((t // 900) + k % 2) AS trip_id,
         CASE WHEN k % 10 = 0 THEN NULL ELSE 'V' || v END AS vehicle_id,
         {STOP_SQL}[((t // 900) + v + k % 2) % 8 + 1] AS stop_id, {ROUTE_SQL}[v % 8 + 1] AS route_id,
         CASE WHEN k % 7 = 0 THEN NULL ELSE t - t % 60 + CAST(floor(value * 12) AS BIGINT) END AS arrival_time,
         CASE WHEN k % 5 = 0 THEN NULL ELSE t - t % 60 + CAST(floor(value * 12) AS BIGINT) + 30 END AS departure_time,
         CAST(CASE WHEN k % 11 = 0 THEN NULL ELSE k % 4 END AS INTEGER) AS stops_away,
         CAST(v % 2 AS INTEGER) AS direction_id,
         CASE event_type WHEN 'click' THEN 'mid_trip' WHEN 'view' THEN 'at_terminal'
                         WHEN 'purchase' THEN 'reverse' END AS kind
  FROM base""")

cte("fetched_raw", ["predictions_raw"], """
  SELECT p.*, f.nth_fetch FROM predictions_raw p JOIN (VALUES (1), (2)) f(nth_fetch)
    ON f.nth_fetch = 1 OR p.file_timestamp // 60 % 10 = 0""")

cte("predictions", ["predictions_raw"], """
  SELECT *, CAST(CASE WHEN stop_id IS NOT NULL THEN row_number() OVER (
           PARTITION BY environment, file_timestamp, stop_id
           ORDER BY CASE WHEN stops_away = 0 THEN 0 ELSE 1 END, coalesce(arrival_time, departure_time) NULLS LAST, id)
         END AS INTEGER) AS nth_at_stop
  FROM predictions_raw
  WHERE stops_away IS NOT NULL AND (arrival_time IS NOT NULL OR departure_time IS NOT NULL)""")

_MATCH_SELECT = """
  SELECT p.id AS prediction_id, t.touch_time, t.environment AS ev_environment, t.vehicle_id AS ev_vehicle_id,
         t.stop_id AS ev_stop_id, t.arrival_snapshot AS ev_arrival_snapshot, t.arrival_time AS ev_arrival_time,
         t.departure_time AS ev_departure_time, t.departure_snapshot AS ev_departure_snapshot,
         row_number() OVER (PARTITION BY p.id ORDER BY t.touch_time, t.arrival_snapshot, t.vehicle_id) AS rn"""

cte("match_standard", ["predictions", "touches"], f"""
  SELECT * EXCLUDE (rn), 'standard' AS match_type FROM ({_MATCH_SELECT}
  FROM predictions p JOIN touches t
    ON p.vehicle_id IS NOT NULL AND t.environment = p.environment AND t.vehicle_id = p.vehicle_id
   AND t.stop_id = p.stop_id AND p.file_timestamp <= t.touch_time AND p.file_timestamp > t.touch_time - 1800)
  WHERE rn = 1""")

cte("match_terminal", ["predictions", "touches"], f"""
  SELECT * EXCLUDE (rn), 'terminal' AS match_type FROM ({_MATCH_SELECT}
  FROM predictions p JOIN touches t
    ON p.vehicle_id IS NULL AND t.environment = p.environment AND t.trip_id = p.trip_id
   AND t.direction_id = p.direction_id AND t.stop_id = p.stop_id
   AND p.file_timestamp <= t.touch_time AND p.file_timestamp >= t.touch_time - 2400)
  WHERE rn = 1""")

cte("matches", ["match_standard", "match_terminal"], """
  SELECT * FROM match_standard UNION ALL SELECT * FROM match_terminal""")

cte("matched_predictions", ["predictions", "matches"], """
  SELECT p.* REPLACE (coalesce(p.vehicle_id, m.ev_vehicle_id) AS vehicle_id),
         m.ev_arrival_snapshot, m.ev_vehicle_id, m.ev_arrival_snapshot IS NOT NULL AS matched
  FROM predictions p LEFT JOIN matches m ON m.prediction_id = p.id""")

cte("scorable", ["predictions"], """
  SELECT *, file_timestamp - file_timestamp % 300 AS block_start,
         CASE WHEN coalesce(arrival_time, departure_time) - file_timestamp >= -30
                   AND coalesce(arrival_time, departure_time) - file_timestamp < 180 THEN '0-3 min'
              WHEN coalesce(arrival_time, departure_time) - file_timestamp >= 180
                   AND coalesce(arrival_time, departure_time) - file_timestamp < 360 THEN '3-6 min'
              WHEN coalesce(arrival_time, departure_time) - file_timestamp >= 360
                   AND coalesce(arrival_time, departure_time) - file_timestamp < 720 THEN '6-12 min'
              WHEN coalesce(arrival_time, departure_time) - file_timestamp >= 720
                   AND coalesce(arrival_time, departure_time) - file_timestamp < 1800 THEN '12-30 min'
         END AS bin,
         coalesce(nth_at_stop IN (1, 2), false) AS in_next_two
  FROM predictions
  WHERE environment IN ('prod', 'dev-green', 'dev-blue')
    AND (kind IS NULL OR kind IN ('mid_trip', 'at_terminal', 'reverse'))
    AND coalesce(arrival_time, departure_time) IS NOT NULL
    AND coalesce(arrival_time, departure_time) > file_timestamp
    AND file_timestamp % 300 <> 0 AND stop_id IS NOT NULL""")

cte("graded", ["scorable", "matches"], """
  SELECT s.*, CASE WHEN s.arrival_time IS NOT NULL THEN ve_arrival_time - s.arrival_time
                   ELSE ve_departure_time - s.departure_time END AS err
  FROM (SELECT s.*,
               CASE WHEN m.touch_time <= s.block_start + 2430 THEN m.ev_arrival_time END AS ve_arrival_time,
               CASE WHEN m.touch_time <= s.block_start + 2430 AND m.ev_departure_snapshot <= s.block_start + 2430
                    THEN m.ev_departure_time END AS ve_departure_time
        FROM scorable s LEFT JOIN matches m ON m.prediction_id = s.id WHERE s.bin IS NOT NULL) s""")

cte("accuracy", ["graded"], f"""
  SELECT environment, {svc_date('block_start')} AS service_date, {svc_hour('block_start')} AS hour_of_day,
         {svc_minute('block_start')} AS minute_of_hour, route_id, stop_id, direction_id, bin, kind, in_next_two,
         num_predictions, num_accurate_predictions, mean_error, root_mean_squared_error, block_start
  FROM (SELECT environment, block_start, route_id, stop_id, direction_id, bin, kind, in_next_two,
               CAST(count(*) AS INTEGER) AS num_predictions,
               CAST(sum(CASE WHEN err > (CASE bin WHEN '0-3 min' THEN -60 WHEN '3-6 min' THEN -90
                                                  WHEN '6-12 min' THEN -150 ELSE -240 END)
                              AND err < (CASE bin WHEN '0-3 min' THEN 60 WHEN '3-6 min' THEN 120
                                                  WHEN '6-12 min' THEN 210 ELSE 360 END)
                             THEN 1 ELSE 0 END) AS INTEGER) AS num_accurate_predictions,
               avg(err) AS mean_error, sqrt(avg(err * err)) AS root_mean_squared_error
        FROM graded GROUP BY ALL)""")

cte("hist", [], f"""
  SELECT {ENV_SQL}[l_suppkey % 3 + 1] AS environment, CAST(o_orderdate AS DATE) AS service_date,
         CAST(3 + l_partkey % 24 AS INTEGER) AS hour_of_day, CAST(l_suppkey % 12 * 5 AS INTEGER) AS minute_of_hour,
         {ROUTE_SQL}[l_partkey % 8 + 1] AS route_id, {STOP_SQL}[(l_partkey // 8) % 8 + 1] AS stop_id,
         CAST(l_linenumber % 2 AS INTEGER) AS direction_id, {HIST_BINS_SQL}[l_linenumber] AS bin,
         CASE l_returnflag WHEN 'A' THEN 'at_terminal' WHEN 'N' THEN 'mid_trip' END AS kind,
         l_linestatus = 'O' AS in_next_two,
         CAST(trunc(l_quantity) AS INTEGER) AS num_predictions,
         CAST(floor(l_quantity * (1.0 - l_discount * 5)) AS INTEGER) AS num_accurate_predictions,
         l_extendedprice % 200 - 100 AS mean_error, l_extendedprice % 200 AS root_mean_squared_error
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")

cte("stops_dim", [], """
  SELECT CAST(p_partkey AS VARCHAR) AS id, 'subway' AS mode, p_name AS name,
         CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_brand || '-' || p_size END AS platform_name,
         CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_name || ' - ' || p_type END AS description
  FROM part""")


def with_ctes(deps: list[str], body: str) -> str:
    """``WITH`` prefix holding ``deps`` and everything they need, in order."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for d in deps:
        visit(d)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]}\n)" for n in order) + "\n" + body


def r6(x: str) -> str:
    return f"round({x}, 6)"


def dep_day(x: str) -> str:
    """Departure service day (04:00 .. 02:00 next day local, inclusive)."""
    d = f"CAST({local_ts(x)} AS DATE)"
    at = lambda h: f"CAST(epoch(timezone('America/New_York', CAST({d} + INTERVAL {h} HOUR AS TIMESTAMP))) AS BIGINT)"
    return f"(CASE WHEN {x} >= {at(4)} THEN {d} WHEN {x} <= {at(2)} THEN {d} - 1 END)"


def fmt_unix(x: str) -> str:
    off = f"(CAST(epoch({local_ts(x)}) AS BIGINT) - {x}) // 3600"
    return (
        f"(CASE WHEN {x} IS NULL THEN 'N/A' ELSE strftime({local_ts(x)}, '%Y-%m-%d %H:%M:%S') || ' ' || "
        f"CASE {off} WHEN -4 THEN 'EDT' WHEN -5 THEN 'EST' ELSE 'UTC' || {off} END END)"
    )


STOP_DIM_KEY_SQL = (
    "CASE stop_id WHEN '70061' THEN '0' WHEN '70063' THEN '1' WHEN '70105' THEN '2' WHEN '70036' THEN '3' "
    "WHEN '70001' THEN '4' WHEN '70197' THEN '5' END"
)

cte("eligible_departures", ["vehicle_events"], f"""
  SELECT *, {dep_day('departure_time')} AS service_day FROM vehicle_events
  WHERE trip_id IS NOT NULL AND departure_time IS NOT NULL AND is_deleted = false
    AND {dep_day('departure_time')} IS NOT NULL""")

cte("flagged_departures", ["eligible_departures", "matched_predictions"], """
  SELECT d.*, EXISTS (SELECT 1 FROM matched_predictions p
                      WHERE p.environment = d.environment AND p.ev_vehicle_id = d.vehicle_id
                        AND p.stop_id = d.stop_id AND p.ev_arrival_snapshot = d.arrival_snapshot
                        AND p.file_timestamp < d.departure_time AND p.departure_time IS NOT NULL) AS predicted
  FROM eligible_departures d""")

cte("eligible_departure_predictions", ["matched_predictions"], f"""
  SELECT *, {dep_day('file_timestamp')} AS service_day FROM matched_predictions
  WHERE departure_time IS NOT NULL AND {dep_day('file_timestamp')} IS NOT NULL""")

cte("route_daily", ["hist"], f"""
  SELECT route_id, service_date,
         CAST(sum(num_predictions) AS BIGINT) AS num_predictions,
         CAST(sum(num_accurate_predictions) AS BIGINT) AS num_accurate_predictions
  FROM hist WHERE environment = 'prod' AND route_id IN {SUBWAY_ROUTES_SQL}
  GROUP BY route_id, service_date""")

cte("route_spine", ["hist"], f"""
  SELECT DISTINCT service_date, unnest({ROUTE_SQL}) AS route_id
  FROM hist WHERE environment = 'prod' AND route_id IN {SUBWAY_ROUTES_SQL}""")


def restate(suffix: str, names: list[str], **swap: str) -> None:
    """CTEs ``names`` once more, with ``suffix``, over other inputs (``swap``: old name -> new name)."""
    to = swap | {n: n + suffix for n in names}
    for n in names:
        deps, body = CTES[n]
        body = re.sub(r"\b(FROM|JOIN) (\w+)\b", lambda m: f"{m[1]} {to.get(m[2], m[2])}", body)
        cte(n + suffix, [to.get(d, d) for d in deps], body)


_SCORING = ["match_standard", "match_terminal", "matches", "scorable", "graded", "accuracy"]
_EVENTS = ["seq", "transitions", "arrivals", "departures", "closing", "vehicle_events", "touches"]

# subway, straight from the landed feeds: every fetch of a file counts
cte("predictions_feed", ["fetched_raw"], """
  SELECT * REPLACE (id * 2 + nth_fetch AS id), CAST(CASE WHEN stop_id IS NOT NULL THEN row_number() OVER (
           PARTITION BY environment, file_timestamp, nth_fetch, stop_id
           ORDER BY CASE WHEN stops_away = 0 THEN 0 ELSE 1 END, coalesce(arrival_time, departure_time) NULLS LAST,
                    id // 500, first_id, id) END AS INTEGER) AS nth_at_stop
  FROM (SELECT *, min(id) OVER (PARTITION BY environment, file_timestamp, nth_fetch, id // 500, trip_id, vehicle_id, route_id,
                                direction_id) AS first_id
        FROM fetched_raw)
  WHERE stops_away IS NOT NULL AND (arrival_time IS NOT NULL OR departure_time IS NOT NULL)""")
restate("_feed", _SCORING, predictions="predictions_feed")

# commuter rail, from its own two feeds
cte("vehicle_positions_cr", ["cr_vehicle_positions"], """
  SELECT *, 'prod' AS environment, 'commuter_rail' AS mode, false AS is_deleted FROM cr_vehicle_positions""")
cte("snapshots_cr", ["base"], """
  SELECT DISTINCT 'prod' AS environment, 'commuter_rail' AS mode, (t // 300) * 300 + 300 AS snapshot_time FROM base""")
cte("predictions_cr", ["predictions_raw"], """
  SELECT * REPLACE ('prod' AS environment, CAST(NULL AS VARCHAR) AS kind), CAST(NULL AS INTEGER) AS nth_at_stop
  FROM predictions_raw WHERE vehicle_id IS NOT NULL""")
restate("_cr", _EVENTS + _SCORING, snapshots="snapshots_cr", vehicle_positions="vehicle_positions_cr", predictions="predictions_cr")
