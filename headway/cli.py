"""Command-line entry points for the scheduled jobs (spark-submit friendly).

  python -m headway.cli track-vehicles  --landing L --out T --checkpoint C [--mode commuter_rail] [--facts F] [--continuous]
  python -m headway.cli ingest-predictions --landing L --out P --checkpoint C [--mode commuter_rail] [--continuous]
  python -m headway.cli score           --transitions T --predictions P --out A --now EPOCH [--since EPOCH] [--publish]
  python -m headway.cli score-blocks    --predictions P --transitions T --out A --checkpoint C [--publish] [--continuous]
  python -m headway.cli match           --transitions T --predictions P --events E --matches M --first DATE [--last DATE] [--rejects R]
  python -m headway.cli departures      --events E --predictions P --matches M --report R --date DATE --out CSV [--env prod] [--route R] [--stop S] [--stops DOCS]
  python -m headway.cli report          --accuracy A --out CSV --chart-range Hourly --service-date 2024-01-15 [filters]
  python -m headway.cli prune           --predictions P --events E --as-of EPOCH [--transitions T] [--out-predictions P2 --out-events E2]
  python -m headway.cli backfill        --source A --dest B [--cursor 2024-01-01] [--today 2024-03-01]
  python -m headway.cli live            --predictions P --facts F --out A --checkpoint C --what score|match --env prod [--continuous]
  python -m headway.cli reconcile       --a A --b B [--key id]
  python -m headway.cli drops           --accuracy A --today 2024-01-16

Every path is a shared-storage location; checkpoints must live there too.
Times are explicit arguments: no job reads the wall clock except as a
default for ``--today``.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys

from pyspark.sql import functions as F


def _spark():
    from headway.session import get_spark

    return get_spark()


def _date(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


# report -> (function of headway.operators.departures, reads events, by stop, arguments it takes beside date and env)
DEPARTURE_REPORTS = {
    "unpredicted-summary": ("unpredicted_summary", True, False, []),
    "unpredicted-by-stop": ("unpredicted_by_stop", True, True, ["route_id"]),
    "unpredicted-detail": ("unpredicted_detail", True, False, ["route_id", "stop_id"]),
    "missed-summary": ("missed_summary", False, False, []),
    "missed-by-stop": ("missed_by_stop", False, True, ["route_id"]),
    "missed-detail": ("missed_detail", False, False, ["route_id", "stop_id"]),
}


def _departures(spark, a) -> None:
    from headway.operators import departures as DP
    from headway.operators import matching as M
    from headway.operators import stops as SP
    from headway.sources import schemas as SC
    from headway.streaming.jobs import stored_predictions

    name, events, by_stop, takes = DEPARTURE_REPORTS[a.report]
    lo, hi = DP.service_day_window(a.date)
    # an event of the day may have been predicted a match window and a dwell before it
    predictions = stored_predictions(spark, a.predictions, lo - 7200, hi + 1)
    matched = M.with_matches(predictions, spark.read.parquet(a.matches).drop("file_date"))
    args = ([spark.read.parquet(a.events)] if events else []) + [matched]
    if by_stop:
        docs = spark.read.schema(SC.STOPS).json(a.stops) if a.stops else spark.createDataFrame([], SC.STOPS)
        args.append(SP.stop_dim(SP.stops_from_feed(docs)))
    more = {k: getattr(a, k.removesuffix("_id")) for k in takes}
    out = getattr(DP, name)(*args, date=a.date, env=a.env, **more)
    out.coalesce(1).write.mode("overwrite").option("header", True).csv(a.out)  # a report: one row per route, stop or departure of a day


def _accuracy(spark, path: str):
    """A published accuracy table at its latest version, or a plain one."""
    from headway.streaming.accuracy import accuracy
    from headway.streaming.published import Published

    return accuracy(spark, path) if Published(spark, path).numbers() else spark.read.parquet(path)


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="headway")
    sub = ap.add_subparsers(dest="cmd", required=True)

    p = sub.add_parser("track-vehicles")
    p.add_argument("--landing", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--checkpoint", required=True)
    p.add_argument("--mode", default="subway", choices=["subway", "commuter_rail"])
    p.add_argument("--facts", help="also append what is seen of vehicle events here, for `live`")
    p.add_argument("--continuous", action="store_true")

    p = sub.add_parser("ingest-predictions")
    p.add_argument("--landing", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--checkpoint", required=True)
    p.add_argument("--mode", default="subway", choices=["subway", "commuter_rail"])
    p.add_argument("--continuous", action="store_true")

    p = sub.add_parser("score")
    p.add_argument("--transitions", required=True)
    p.add_argument("--predictions", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--now", type=int, required=True)
    p.add_argument("--since", type=int, help="first block to score; default: start of the service day of the last closed block")
    p.add_argument("--publish", action="store_true", help="publish the run and its report sums in one version of --out")

    p = sub.add_parser("score-blocks")
    p.add_argument("--predictions", required=True)
    p.add_argument("--transitions", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--checkpoint", required=True)
    p.add_argument("--continuous", action="store_true")
    p.add_argument("--publish", action="store_true", help="publish the runs and their report sums in versions of --out")

    p = sub.add_parser("live")
    for opt in ["predictions", "facts", "out", "checkpoint"]:
        p.add_argument("--" + opt, required=True)
    p.add_argument("--what", default="score", choices=["score", "match"])
    p.add_argument("--env", default="prod", help="a watermark is a stream's: one run for each environment")
    p.add_argument("--continuous", action="store_true")

    p = sub.add_parser("match")
    for opt in ["transitions", "predictions", "events", "matches"]:
        p.add_argument("--" + opt, required=True)
    p.add_argument("--rejects", help="store the arrivals that make no event here, with what they lack")
    p.add_argument("--first", type=_date, required=True)
    p.add_argument("--last", type=_date)

    p = sub.add_parser("departures")
    for opt in ["events", "predictions", "matches", "out"]:
        p.add_argument("--" + opt, required=True)
    p.add_argument("--report", required=True, choices=sorted(DEPARTURE_REPORTS))
    p.add_argument("--date", type=_date, required=True)
    p.add_argument("--env", default="prod")
    p.add_argument("--route")
    p.add_argument("--stop")
    p.add_argument("--stops", help="landed stops documents (JSON) for the descriptions of the by-stop reports")

    p = sub.add_parser("report")
    p.add_argument("--accuracy", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--chart-range", default="Hourly", choices=["Hourly", "Daily", "By Station"])
    p.add_argument("--timeframe-resolution", default="60")
    for opt in ["service-date", "date-start", "date-end", "route-ids", "mode", "direction-id", "bin", "in-next-two"]:
        p.add_argument("--" + opt)
    p.add_argument("--stops", help="landed stops documents (JSON) for station names in By Station reports")
    p.add_argument("--stop-ids", nargs="*")
    p.add_argument("--kinds", nargs="*")

    p = sub.add_parser("prune")
    p.add_argument("--predictions", required=True)
    p.add_argument("--events", required=True)
    p.add_argument("--out-predictions", help="write the kept rows here; default: drop expired days in place")
    p.add_argument("--out-events")
    p.add_argument("--transitions", help="a tracker's root, pruned and compacted in place")
    p.add_argument("--as-of", type=int, required=True)

    p = sub.add_parser("backfill")
    p.add_argument("--source", required=True)
    p.add_argument("--dest", required=True)
    p.add_argument("--cursor", type=_date, help="copy from here into a plain table; default: the cursor stored in the published table --dest")
    p.add_argument("--today", type=_date, default=dt.datetime.now(dt.timezone.utc).date())

    p = sub.add_parser("reconcile")
    p.add_argument("--a", required=True)
    p.add_argument("--b", required=True)
    p.add_argument("--key", default="id")

    p = sub.add_parser("drops")
    p.add_argument("--accuracy", required=True)
    p.add_argument("--today", type=_date, default=dt.datetime.now(dt.timezone.utc).date())

    a = ap.parse_args(argv)
    spark = _spark()

    if a.cmd == "track-vehicles":
        from headway.streaming.jobs import start_vehicle_tracker

        start_vehicle_tracker(spark, a.landing, a.out, a.checkpoint, available_now=not a.continuous, mode=a.mode, facts_path=a.facts).awaitTermination()
    elif a.cmd == "ingest-predictions":
        from headway.streaming.jobs import start_prediction_ingest

        start_prediction_ingest(spark, a.landing, a.out, a.checkpoint, available_now=not a.continuous, mode=a.mode).awaitTermination()
    elif a.cmd == "score":
        from headway.streaming.jobs import run_scoring

        run_scoring(spark, a.transitions, a.predictions, a.out, a.now, a.since, a.publish)
    elif a.cmd == "score-blocks":
        from headway.streaming.jobs import start_block_scorer

        start_block_scorer(
            spark, a.predictions, a.transitions, a.out, a.checkpoint, available_now=not a.continuous, publish=a.publish
        ).awaitTermination()
    elif a.cmd == "live":
        from headway.streaming import live as L

        of = F.col("environment") == a.env
        p, f = (spark.readStream.schema(spark.read.parquet(x).schema).parquet(x).filter(of) for x in (a.predictions, a.facts))
        out = (L.score_stream if a.what == "score" else L.match_stream)(p, f)
        L.start_live(out, a.out, a.checkpoint, available_now=not a.continuous).awaitTermination()
    elif a.cmd == "match":
        from headway.streaming.jobs import run_matching

        print(json.dumps(run_matching(spark, a.transitions, a.predictions, a.events, a.matches, a.first, a.last or a.first, a.rejects)))
    elif a.cmd == "departures":
        _departures(spark, a)
    elif a.cmd == "report":
        from headway.operators import filters as FL
        from headway.operators import stats as ST

        params = {
            "chart_range": a.chart_range, "service_date": a.service_date, "date_start": a.date_start,
            "date_end": a.date_end, "route_ids": a.route_ids, "mode": a.mode, "direction_id": a.direction_id,
            "bin": a.bin, "in_next_two": a.in_next_two, "stop_ids": a.stop_ids, "kinds": a.kinds,
        }
        q, err = FL.filter_accuracy(_accuracy(spark, a.accuracy), params)
        if err:
            print(json.dumps({"error": err}))
            return 2
        names = None
        if a.stops and a.chart_range == "By Station":
            from headway.operators import stops as SP
            from headway.sources import schemas as SC

            dim = SP.stop_dim(SP.stops_from_feed(spark.read.schema(SC.STOPS).json(a.stops)))
            names = dim.select(F.col("id").alias("stop_id"), F.col("display_name").alias("station_name"))
        ST.write_csv(ST.export_rows(q, a.chart_range, a.timeframe_resolution, station_names=names), a.out, a.chart_range)
    elif a.cmd == "prune":
        from headway.operators import maintenance as MT

        if a.out_predictions:
            MT.prune_predictions(spark.read.parquet(a.predictions), a.as_of).write.mode("overwrite").parquet(a.out_predictions)
        else:
            print(json.dumps({"predictions": MT.prune_stored_predictions(spark, a.predictions, a.as_of)}))
        if a.out_events:
            MT.prune_events(spark.read.parquet(a.events), a.as_of).write.mode("overwrite").parquet(a.out_events)
        else:
            print(json.dumps({"events": MT.prune_stored_events(spark, a.events, a.as_of)}))
        if a.transitions:
            from headway.functions.constants import MAX_DWELL_S, PRUNE_LOOKBACK_S
            from headway.streaming import snapshots as SN
            from headway.streaming.published import Published

            SN.prune_tracker(spark, a.transitions, a.as_of - PRUNE_LOOKBACK_S - MAX_DWELL_S)
            SN.compact_tracker(spark, a.transitions, a.as_of - 86400)
            Published(spark, a.transitions).vacuum()
    elif a.cmd == "backfill":
        from headway.operators import maintenance as MT

        if a.cursor is None:
            from headway.streaming.backfill import run_backfill

            print(json.dumps(run_backfill(spark, spark.read.parquet(a.source), a.dest, a.today)))
            return 0
        rows, report = MT.backfill_run(spark.read.parquet(a.source), a.cursor, a.today)
        first, last, status, nxt = MT.backfill_window(a.cursor, a.today)
        if status == "copied":
            MT.write_accuracy(rows.drop("week_start") if "week_start" in rows.columns else rows, a.dest)
        print(json.dumps({"first": str(first), "last": str(last), "status": status, "next_cursor": str(nxt)}))
    elif a.cmd == "reconcile":
        from headway.operators import maintenance as MT

        out = MT.reconcile(spark.read.parquet(a.a), spark.read.parquet(a.b), key=a.key)
        print(json.dumps([r.asDict() for r in out.collect()], default=str))  # two rows: one per side
    elif a.cmd == "drops":
        from headway.operators import monitoring as MO

        out = MO.check_accuracy(_accuracy(spark, a.accuracy), a.today).filter(F.col("drop"))
        print(json.dumps([r.asDict() for r in out.collect()], default=str))  # at most one row per subway route
    return 0


if __name__ == "__main__":
    sys.exit(main())
