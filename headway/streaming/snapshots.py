"""What the vehicle tracker stores of a micro-batch, in one published version.

Tables of a tracker's root (``published.Published``), by feed (environment and
mode) and hour:

* ``snapshots``: which pages of which snapshots have been taken.  A re-fetched
  snapshot is told by the feed's Last-Modified, which is looked up here, under
  the hour it names; so no feed waits for another, and none is too late;
* ``records``: the valid vehicles, and a heartbeat row for each page;
* ``quarantine``: entities that were not used, as they came, with the reason;
* ``counts``: what every batch made of every feed's documents and entities;
* ``transitions``: those of the snapshots, one row a vehicle.

Snapshots newer than all of their feed append their transitions, from their own
records and those of the snapshot before.  Others (a later page of a snapshot, a
late snapshot) have their hours, and the feed's next one, computed anew from the
records and replaced.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from headway.functions.constants import MAX_DWELL_S
from headway.functions.times import rfc1123_to_epoch
from headway.operators import events as E
from headway.operators import ingest as IN
from headway.streaming.published import Published, Version, compacted
from headway.streaming.tracker import OUTPUT_SCHEMA, RECORD_SCHEMA, track, tracker_input

HOUR_S, DAY_S = 3600, 86400
FEED = "environment string, mode string"
SCHEMAS = {
    "snapshots": f"told string, page int, snapshot_time long, {FEED}, told_hour long",
    "records": f"snapshot_time long, pos int, id string, {RECORD_SCHEMA}, {FEED}, feed_hour long",
    "quarantine": f"snapshot_time long, pos int, id string, label string, trip_id string, route_id string, stop_id string, timestamp long, parse_status string, entity string, {FEED}, feed_hour long",
    "counts": f"batch long, documents long, taken long, repeated long, valid long, ignored long, errors long, {FEED}, feed_hour long",
    "transitions": ", ".join(f for f in OUTPUT_SCHEMA.split(", ") if f not in FEED.split(", ")) + f", {FEED}, feed_hour long",
}
BY = {t: [*E.FEED_KEYS, s.rsplit(", ", 1)[1].split()[0]] for t, s in SCHEMAS.items()}
OTHER_HOURS = 1000  # partitions of Last-Modified values that are no times


def _columns(table: str) -> list[str]:
    return [f.split()[0] for f in SCHEMAS[table].split(", ")]


def _hour(c: str):
    return F.col(c) - F.pmod(c, F.lit(HOUR_S))


def part(env: str, mode: str, hour: int, name: str = "feed_hour") -> str:
    return f"environment={env}/mode={mode}/{name}={hour}"


def feed_of(partition: str) -> tuple[str, str, int]:
    env, mode, hour = (x.split("=", 1)[1] for x in partition.split("/"))
    return env, mode, int(hour)


def told(docs: DataFrame) -> DataFrame:
    """``docs`` with what tells their snapshot (``told``, under ``told_hour``) and their ``page``; one without Last-Modified is told by its time."""
    named = F.col("last_modified").isNotNull()
    at = F.when(named, rfc1123_to_epoch("last_modified")).otherwise(F.col("snapshot_time"))
    hour = F.coalesce(at - F.pmod(at, F.lit(HOUR_S)), -1 - F.pmod(F.xxhash64("last_modified"), F.lit(OTHER_HOURS)))
    page = F.coalesce("page", F.lit(0)) if "page" in docs.columns else F.lit(0)
    name = F.coalesce("last_modified", F.concat(F.lit("snapshot "), F.col("snapshot_time").cast("string")))
    return docs.withColumns({"told": name, "told_hour": hour.cast("long"), "page": page.cast("int")})


def marked_new(docs: DataFrame, seen: DataFrame) -> DataFrame:
    """``told`` documents with ``new``: whether this is the first of its page, of the snapshot's first fetch."""
    key = [*E.FEED_KEYS, "told"]
    have = seen.groupBy(*key).agg(F.min("snapshot_time").alias("_first"), F.collect_set("page").alias("_pages"))
    docs = docs.join(have, key, "left")
    first = F.coalesce("_first", F.min("snapshot_time").over(Window.partitionBy(*key)))
    nth = F.row_number().over(Window.partitionBy(*key, "snapshot_time", "page").orderBy("snapshot_time"))
    unseen = ~F.coalesce(F.array_contains("_pages", F.col("page")), F.lit(False))
    return docs.withColumn("new", (F.col("snapshot_time") == first) & unseen & (nth == 1)).drop("_first", "_pages")


def _any(conditions):
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _is_feed(feed: tuple[str, str]):
    return (F.col("environment") == feed[0]) & (F.col("mode") == feed[1])


def store_batch(docs: DataFrame, root: str, batch: int, writer: str = "tracker", rail: bool = False, facts_path: str | None = None) -> Version:
    """Store one micro-batch of landed snapshots; a batch that is stored already is left out."""
    spark = docs.sparkSession
    p = Published(spark, root)
    base = p.latest()
    if base.writers.get(writer, -1) >= batch:
        return base
    docs = told(docs)
    entities = F.coalesce(F.array_size("data" if rail else "entity"), F.lit(0))
    hours = {part(*r, "told_hour") for r in docs.select(*E.FEED_KEYS, "told_hour").distinct().collect()}  # a few for each feed
    docs = marked_new(docs, p.read("snapshots", SCHEMAS["snapshots"], base, keep=hours.__contains__)).persist()
    new = docs.filter("new")
    recs = (IN.parse_cr_feed(new, raw=True) if rail else IN.parse_vehicle_feed(new, raw=True)).withColumn("feed_hour", _hour("snapshot_time")).persist()

    per_feed = docs.groupBy(*E.FEED_KEYS).agg(
        F.count(F.lit(1)).alias("documents"), F.count_if("new").alias("taken"), F.sum(F.when(F.col("new"), 0).otherwise(entities)).alias("repeated"),
        F.min(F.when(F.col("new"), F.col("snapshot_time"))).alias("first"), F.max(F.when(F.col("new"), F.col("snapshot_time"))).alias("last"))
    status = recs.groupBy(*E.FEED_KEYS).agg(*[F.count_if(F.col("parse_status") == s).alias(n) for s, n in (("valid", "valid"), ("ignore", "ignored"), ("error", "errors"))])
    counts = per_feed.join(status, E.FEED_KEYS, "left").na.fill(0, ["valid", "ignored", "errors"]).collect()  # one row a feed
    told_rows = [(batch, *(int(r[c]) for c in ("documents", "taken", "repeated", "valid", "ignored", "errors")), r.environment, r.mode, (r["first"] or 0) // HOUR_S * HOUR_S) for r in counts]
    add = {"counts": p.write(spark.createDataFrame(told_rows, SCHEMAS["counts"]), "counts", BY["counts"])} if told_rows else {}
    feeds = {(r.environment, r.mode): (r["first"], r["last"]) for r in counts if r.taken}

    replace, drop, marks = {}, {}, dict(base.notes.get(writer, {}))
    if feeds:
        add["snapshots"] = p.write(new.select(*_columns("snapshots")), "snapshots", BY["snapshots"])
        rows = tracker_input(recs.filter(F.col("parse_status") == "valid"), new.select(*E.FEED_KEYS, "snapshot_time"))
        add["records"] = p.write(rows.withColumn("feed_hour", _hour("snapshot_time")).select(*_columns("records")), "records", BY["records"])
        if any(r.ignored or r.errors for r in counts):
            add["quarantine"] = p.write(recs.filter(F.col("parse_status") != "valid").select(*_columns("quarantine")), "quarantine", BY["quarantine"])
        records = {q: w + add["records"].get(q, []) for q, w in ({q: [] for q in add["records"]} | base.tables.get("records", {})).items()}
        have: dict[tuple[str, str], list[int]] = {}
        for env, mode, hour in sorted(map(feed_of, records)):
            have.setdefault((env, mode), []).append(hour)

        need, out_of, again = set(), [], {}
        for feed, (first, _) in feeds.items():
            mark = marks.get("/".join(feed))
            mine = {feed_of(q)[2] for q in add["records"] if feed_of(q)[:2] == feed}
            if mark is None or first > mark:
                need |= {part(*feed, h) for h in mine} | ({part(*feed, mark // HOUR_S * HOUR_S)} if mark is not None else set())
                out_of.append((_is_feed(feed) & (F.col("snapshot_time") >= (mark or 0)), _is_feed(feed) & (F.col("snapshot_time") > (-1 if mark is None else mark))))
            else:
                # an hour's first snapshot follows the last one of the feed's hour before
                at = have[feed]
                touched = mine | {h for i in (bisect_right(at, m) for m in mine) for h in at[i : i + 1]}
                before = {at[i - 1] for i in (bisect_left(at, h) for h in touched) if i}
                need |= {part(*feed, h) for h in touched | before}
                again |= {part(*feed, h): None for h in touched}
                out_of.append((_is_feed(feed), _is_feed(feed) & F.col("feed_hour").isin(sorted(touched))))
        stored = p.read("records", SCHEMAS["records"], base._replace(tables={"records": records}), keep=need.__contains__)
        t = track(stored.filter(_any(c for c, _ in out_of)).drop("feed_hour")).withColumn("feed_hour", _hour("snapshot_time"))
        wrote = p.write(t.filter(_any(c for _, c in out_of)).select(*_columns("transitions")), "transitions", BY["transitions"])
        replace["transitions"] = {q: w for q, w in wrote.items() if q in again}
        add["transitions"] = {q: w for q, w in wrote.items() if q not in again}
        drop["transitions"] = [q for q in again if q not in wrote]
        for feed, (_, last) in feeds.items():
            key = "/".join(feed)
            marks[key] = max(last, marks.get(key, last))
        if facts_path:
            now = {t_: dict(base.tables.get(t_, {})) for t_ in ("transitions",)}
            for q, w in add["transitions"].items():
                now["transitions"][q] = now["transitions"].get(q, []) + w
            now["transitions"].update(replace["transitions"])
            write_facts(p, base._replace(tables=now), {f: first for f, (first, _) in feeds.items()}, f"{facts_path}/batch_id={batch}")
    done = p.commit(base, replace=replace, add=add, drop=drop, writer=writer, batch=batch, notes=marks)
    recs.unpersist()
    docs.unpersist()
    return done


def write_facts(p: Published, v: Version, since: dict[tuple[str, str], int], path: str) -> None:
    """What the feeds' snapshots from ``since`` on tell of vehicle events.  A batch that is replayed writes its own folder anew."""
    from headway.streaming.live import event_facts

    back = 2 * MAX_DWELL_S  # to the arrivals that are open, and to those closed with them

    def keep(q: str) -> bool:
        env, mode, hour = feed_of(q)
        return (env, mode) in since and hour + HOUR_S > since[env, mode] - back

    t = p.read("transitions", SCHEMAS["transitions"], v, keep=keep).filter(F.col("transition") != "dropped")
    # vehicle events are told by environment; a feed's vehicles are its own
    first = F.coalesce(*[F.when(_is_feed(f), F.lit(s)) for f, s in since.items()])
    starts = t.select(F.col("environment"), F.col("id").alias("vehicle_id"), first.alias("since")).groupBy("environment", "vehicle_id").agg(F.min("since").alias("since"))
    facts = event_facts(E.vehicle_events(t)).join(starts, ["environment", "vehicle_id"]).filter(F.col("fact_time") >= F.col("since")).drop("since")
    facts.write.mode("overwrite").parquet(path)


def stored_transitions(spark: SparkSession, path: str, from_s: int | None = None, to_s: int | None = None) -> DataFrame:
    """Transitions of the hours that hold ``from_s`` to ``to_s``: those a tracker has published at ``path``, in one version, or a plain Parquet table."""
    p = Published(spark, path)
    if not p.numbers():
        return spark.read.parquet(path)
    lo, hi = (-(2**62) if from_s is None else from_s - HOUR_S), (2**62 if to_s is None else to_s)
    return p.read("transitions", SCHEMAS["transitions"], keep=lambda q: lo <= feed_of(q)[2] <= hi).select(*[f.split()[0] for f in OUTPUT_SCHEMA.split(", ")], "feed_hour")


def stored(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of a tracker's root at its latest version."""
    return Published(spark, path).read(table, SCHEMAS[table])


def prune_tracker(spark: SparkSession, path: str, before_s: int) -> Version:
    """Take the partitions of hours that end by ``before_s`` out of all tables, by their names: no row is read or written.

    The newest hour of records of each feed stays: the next snapshot follows it.
    Snapshots whose Last-Modified is no time stay, since their age is not known."""
    p = Published(spark, path)
    base = p.latest()
    newest: dict[tuple[str, str], int] = {}
    for env, mode, hour in map(feed_of, base.tables.get("records", {})):
        newest[env, mode] = max(hour, newest.get((env, mode), hour))

    def old(table: str, q: str) -> bool:
        env, mode, hour = feed_of(q)
        return 0 <= hour and hour + HOUR_S <= before_s and not (table == "records" and hour == newest[env, mode])

    drop = {t: [q for q in base.tables.get(t, {}) if old(t, q)] for t in SCHEMAS}
    return p.commit(base, drop=drop) if any(drop.values()) else base


def compact_tracker(spark: SparkSession, path: str, before_s: int) -> Version:
    """Rewrite every hour that ended by ``before_s`` and has files of many batches as one file a table."""
    p = Published(spark, path)
    for table, schema in SCHEMAS.items():
        parts = [q for q in p.latest().tables.get(table, {}) if feed_of(q)[2] + HOUR_S <= before_s]
        compacted(p, table, schema, parts, BY[table])
    return p.latest()
