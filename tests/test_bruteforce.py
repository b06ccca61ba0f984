"""Randomised snapshots: Spark operators vs a plain-Python brute force."""

import random

import pytest

from headway.operators import events as E
from headway.operators import matching as M
from headway.streaming.tracker import classify

POS = ("environment string, mode string, id string, label string, is_deleted boolean, trip_id string, "
       "route_id string, direction_id int, current_status string, stop_id string, timestamp long, snapshot_time long")
PRED = "id long, environment string, vehicle_id string, trip_id string, direction_id int, stop_id string, file_timestamp long"
STATUSES = ["STOPPED_AT", "INCOMING_AT", "IN_TRANSIT_TO"]


def _fixture(seed=7, n_snap=240, step=240):
    rnd = random.Random(seed)
    snaps = [10_000_000 + step * i for i in range(n_snap)]
    vehicles = {"v1": "Red", "v2": "Mattapan", "v3": "Red"}
    rows = []
    for s in snaps:
        for v, route in vehicles.items():
            if rnd.random() < 0.1:
                continue  # absent from this snapshot
            rows.append(("prod", "subway", v, "L" + v, False, f"t{v}-{s // 3600}", route, int(v[-1]) % 2,
                         rnd.choice(STATUSES), rnd.choice(["A", "B", "C"]), s - rnd.randrange(0, 60), s))
    preds = []
    for i in range(600):
        v = rnd.choice(list(vehicles))
        s = rnd.choice(snaps)
        preds.append((i, "prod", None if rnd.random() < 0.2 else v, f"t{v}-{s // 3600}", int(v[-1]) % 2,
                      rnd.choice(["A", "B", "C"]), s - rnd.randrange(0, 3000)))
    return snaps, rows, preds


def _brute(snaps, rows, preds):
    by = {(r[2], r[11]): dict(zip(["label", "trip_id", "route_id", "direction_id", "current_status", "stop_id", "timestamp"],
                                  [r[3], r[5], r[6], r[7], r[8], r[9], r[10]])) for r in rows}
    arrivals, departures = [], []
    prev_snap = {s: (snaps[i - 1] if i else None) for i, s in enumerate(snaps)}
    for (v, s), rec in by.items():
        old = by.get((v, prev_snap[s])) if prev_snap[s] is not None else None
        t = classify(rec, old)
        if t in ("new_arrival", "arrival", "departure_arrival"):
            arrivals.append(dict(vehicle_id=v, stop_id=rec["stop_id"], arrival_time=rec["timestamp"], arrival_snapshot=s,
                                 trip_id=rec["trip_id"], direction_id=rec["direction_id"]))
        if t in ("departure", "departure_arrival"):
            departures.append(dict(vehicle_id=v, stop_id=old["stop_id"], route_id=old["route_id"],
                                   departure_time=rec["timestamp"], departure_snapshot=s))
    for a in arrivals:
        cands = [d for d in departures if d["vehicle_id"] == a["vehicle_id"] and d["stop_id"] == a["stop_id"]
                 and d["departure_snapshot"] > a["arrival_snapshot"]
                 and a["arrival_time"] > d["departure_snapshot"] - (1200 if d["route_id"] == "Mattapan" else 1800)]
        first = min(cands, key=lambda d: d["departure_snapshot"]) if cands else None
        a["departure_snapshot"] = first["departure_snapshot"] if first else None
        a["departure_time"] = first["departure_time"] if first else None
    for a in arrivals:
        a["closed_with"] = (sum(1 for b in arrivals if b["vehicle_id"] == a["vehicle_id"] and b["stop_id"] == a["stop_id"]
                                and b["departure_snapshot"] == a["departure_snapshot"])
                            if a["departure_snapshot"] is not None else None)
    touches = [(a["arrival_snapshot"], a) for a in arrivals] + [
        (a["departure_snapshot"], a) for a in arrivals if a["closed_with"] == 1]
    matches = {}
    for pid, env, v, trip, direction, stop, ft in preds:
        best = None
        for t, a in touches:
            if a["stop_id"] != stop or not ft <= t:
                continue
            if v is not None and a["vehicle_id"] == v and ft > t - 1800:
                ok = True
            elif v is None and a["trip_id"] == trip and a["direction_id"] == direction and ft >= t - 2400:
                ok = True
            else:
                ok = False
            if ok and (best is None or (t, a["arrival_snapshot"], a["vehicle_id"]) < best[0]):
                best = ((t, a["arrival_snapshot"], a["vehicle_id"]), a)
        if best:
            matches[pid] = (best[0][0], best[1]["vehicle_id"], best[1]["arrival_snapshot"])
    return arrivals, matches


@pytest.mark.parametrize("seed", [7, 11, 23])
def test_events_and_matches_match_brute_force(spark, seed):
    snaps, rows, preds = _fixture(seed)
    arrivals, bmatches = _brute(snaps, rows, preds)
    pos = spark.createDataFrame(rows, POS)
    snap_df = spark.createDataFrame([("prod", "subway", s) for s in snaps], "environment string, mode string, snapshot_time long")
    ev = E.vehicle_events(E.vehicle_transitions(pos, snap_df))
    got = sorted((r.vehicle_id, r.stop_id, r.arrival_snapshot, r.departure_snapshot, r.closed_with) for r in ev.collect())
    exp = sorted((a["vehicle_id"], a["stop_id"], a["arrival_snapshot"], a["departure_snapshot"], a["closed_with"]) for a in arrivals)
    assert got == exp and len(exp) > 50
    assert any(a["closed_with"] and a["closed_with"] > 1 for a in arrivals)
    m = M.match_all(spark.createDataFrame(preds, PRED), E.event_touches(ev))
    gotm = {r.prediction_id: (r.touch_time, r.ev_vehicle_id, r.ev_arrival_snapshot) for r in m.collect()}
    assert gotm == bmatches and len(bmatches) > 50


def test_scoring_matches_brute_force(spark):
    """Score the sf0.001 predictions in plain Python and compare."""
    import math

    from headway.functions.constants import BINS, ENVIRONMENTS, KIND_VALUES, VISIBILITY_LAG_S
    from headway.operators import scoring as S
    from headway.plans import domain as D

    d = "/root/testdata/sf0.001"
    preds = D.predictions(spark, d)
    matches = D.matches(spark, d)
    m = {r.prediction_id: r for r in matches.collect()}
    groups = {}
    for p in preds.collect():
        ft = p.file_timestamp
        inst = p.arrival_time if p.arrival_time is not None else p.departure_time
        if p.environment not in ENVIRONMENTS or (p.kind is not None and p.kind not in KIND_VALUES):
            continue
        if inst is None or inst <= ft or ft % 300 == 0 or p.stop_id is None:
            continue
        lead = inst - ft
        b = next((n for n, (lo, hi, _, _) in BINS.items() if lo <= lead < hi), None)
        if b is None:
            continue
        block = ft - ft % 300
        mm = m.get(p.id)
        seen = mm is not None and mm.touch_time <= block + VISIBILITY_LAG_S
        va = mm.ev_arrival_time if seen else None
        vd = mm.ev_departure_time if seen and mm.ev_departure_snapshot is not None and mm.ev_departure_snapshot <= block + VISIBILITY_LAG_S else None
        if p.arrival_time is not None:
            err = None if va is None else va - p.arrival_time
        else:
            err = None if vd is None else vd - p.departure_time
        emin, emax = BINS[b][2], BINS[b][3]
        key = (p.environment, block, p.route_id, p.stop_id, p.direction_id, b, p.kind, p.nth_at_stop in (1, 2))
        g = groups.setdefault(key, [0, 0, []])
        g[0] += 1
        g[1] += 1 if err is not None and emin < err < emax else 0
        if err is not None:
            g[2].append(err)
    exp = {}
    for k, (n, a, errs) in groups.items():
        me = sum(errs) / len(errs) if errs else None
        rm = math.sqrt(sum(e * e for e in errs) / len(errs)) if errs else None
        exp[k] = (n, a, None if me is None else round(me, 6), None if rm is None else round(rm, 6))
    got = {}
    for r in S.score(preds, matches).collect():
        k = (r.environment, r.block_start, r.route_id, r.stop_id, r.direction_id, r.bin, r.kind, r.in_next_two)
        got[k] = (r.num_predictions, r.num_accurate_predictions,
                  None if r.mean_error is None else round(r.mean_error, 6),
                  None if r.root_mean_squared_error is None else round(r.root_mean_squared_error, 6))
    assert got == exp and len(exp) > 100
