"""Driver test tables -> domain tables.

The test tables are not transit data, so a fixed deterministic mapping
turns them into feeds and tables of the accuracy domain (see FIXTURES.md
section 2).  The same mapping is written as SQL in
``headway.plans.oracle`` so the two sides stay independent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.functions.columns import pick
from headway.functions.times import ntz_to_epoch
from headway.operators.ingest import keep_scorable_updates, rank_at_stop

# Fixture lists (test-data mapping, FIXTURES.md section 2)
ENV = ["prod", "dev-green", "dev-blue"]
ROUTE = ["Red", "Blue", "Orange", "Green-B", "Green-C", "Green-D", "Green-E", "Mattapan"]
STOP = ["70061", "70063", "70105", "70036", "70001", "70197", "70260", "70065"]
HIST_BINS = ["0-3 min", "3-6 min", "6-8 min", "8-10 min", "10-12 min", "6-12 min", "12-30 min"]

# Every user is a vehicle with one night shift: its events of 30 days in the 12 hours from 19:00 New York of its day,
# 2024-01-15 and the 29 days after it in turn.  So the fleet of every day grows with the users.
EVENTS_ORIGIN = 1704067200
DOMAIN_ORIGIN = 1705363200
DAYS = 30
DAY_S = 86400


def idiv(c: Column, n: int) -> Column:
    """Floor division of a non-negative integer column (exact, no doubles)."""
    return ((c - F.pmod(c, F.lit(n))) / n).cast("long")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _table(spark, sf_dir, "events")
    sec = ntz_to_epoch("ts")
    return ev.select(
        "event_id",
        "event_type",
        "value",
        F.col("user_id").cast("long").alias("v"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        (F.lit(DOMAIN_ORIGIN) + F.pmod(F.col("user_id"), F.lit(DAYS)) * DAY_S + idiv(sec - F.lit(EVENTS_ORIGIN), 60)).alias("t"),
    )


def vehicle_positions(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """One vehicle record per (v, 5-minute slot): the latest event by (t, event_id).

    Here and below, ``events`` may pass stored ``base_events``."""
    b = base_events(spark, sf_dir) if events is None else events
    latest = (
        b.groupBy("v", idiv(F.col("t"), 300).alias("slot"))
        .agg(F.max(F.struct("t", "event_id", "k", "event_type")).alias("r"))
        .select("v", "slot", "r.*")
    )
    return _position_rows(latest)


def vehicle_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a vehicle record of its 5-minute snapshot, so a vehicle may stand in a snapshot several times."""
    return _position_rows(base_events(spark, sf_dir), F.col("event_id"), F.col("v"))


def _position_rows(rows: DataFrame, *more: Column) -> DataFrame:
    v, t, k = F.col("v"), F.col("t"), F.col("k")
    hour15 = idiv(t, 900)
    status = (
        F.when(F.col("event_type").isin("purchase", "error"), F.lit("STOPPED_AT"))
        .when(F.col("event_type") == "signup", F.lit("INCOMING_AT"))
        .otherwise(F.lit("IN_TRANSIT_TO"))
    )
    return rows.select(
        *more,
        pick(ENV, F.pmod(v, F.lit(3))).alias("environment"),
        F.lit("subway").alias("mode"),
        F.concat(F.lit("V"), v.cast("string")).alias("id"),
        F.concat(F.lit("L"), v.cast("string")).alias("label"),
        (k == 99).alias("is_deleted"),
        F.concat(F.lit("T"), v.cast("string"), F.lit("-"), hour15.cast("string")).alias("trip_id"),
        pick(ROUTE, F.pmod(v, F.lit(8))).alias("route_id"),
        F.pmod(v, F.lit(2)).cast("int").alias("direction_id"),
        status.alias("current_status"),
        pick(STOP, F.pmod(hour15 + v, F.lit(8))).alias("stop_id"),
        t.alias("timestamp"),
        (idiv(t, 300) * 300 + 300).alias("snapshot_time"),
    )


def vehicle_snapshots(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Every environment's feed is polled at every snapshot time seen in the data."""
    b = base_events(spark, sf_dir) if events is None else events
    return (
        b.select((idiv(F.col("t"), 300) * 300 + 300).alias("snapshot_time"))
        .distinct()
        .select(
            F.explode(F.array(*[F.lit(e) for e in ENV])).alias("environment"),
            F.lit("subway").alias("mode"),
            "snapshot_time",
        )
    )


def predictions_raw(spark: SparkSession, sf_dir: str, keep_k: bool = False) -> DataFrame:
    """Flat prediction rows before the P2 filter and the nth-at-stop rank."""
    return _prediction_rows(base_events(spark, sf_dir), *(["k"] if keep_k else []))


def _file_time() -> Column:
    return F.col("t") - F.pmod(F.col("t"), F.lit(60))


def _prediction_rows(b: DataFrame, *more: str) -> DataFrame:
    v, t, k = F.col("v"), F.col("t"), F.col("k")
    ft = F.col("file_time") if "file_time" in b.columns else _file_time()
    lead = F.floor(F.col("value") * 12).cast("long")
    kind = (
        F.when(F.col("event_type") == "click", F.lit("mid_trip"))
        .when(F.col("event_type") == "view", F.lit("at_terminal"))
        .when(F.col("event_type") == "purchase", F.lit("reverse"))
    )
    hour15 = idiv(t, 900)
    null_long = F.lit(None).cast("long")
    return b.select(
        F.col("event_id").alias("id"),
        ft.alias("file_timestamp"),
        pick(ENV, F.pmod(v, F.lit(3))).alias("environment"),
        F.concat(F.lit("T"), v.cast("string"), F.lit("-"), (hour15 + F.pmod(k, F.lit(2))).cast("string")).alias("trip_id"),
        F.when(F.pmod(k, F.lit(10)) == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("V"), v.cast("string")))
        .alias("vehicle_id"),
        F.lit(False).alias("is_deleted"),
        F.lit(None).cast("string").alias("boarding_status"),
        F.lit(None).cast("string").alias("schedule_relationship"),
        pick(STOP, F.pmod(hour15 + v + F.pmod(k, F.lit(2)), F.lit(8))).alias("stop_id"),
        pick(ROUTE, F.pmod(v, F.lit(8))).alias("route_id"),
        F.when(F.pmod(k, F.lit(7)) == 0, null_long).otherwise(ft + lead).alias("arrival_time"),
        F.when(F.pmod(k, F.lit(5)) == 0, null_long).otherwise(ft + lead + 30).alias("departure_time"),
        F.lit(None).cast("int").alias("stop_sequence"),
        F.when(F.pmod(k, F.lit(11)) == 0, F.lit(None).cast("int")).otherwise(F.pmod(k, F.lit(4))).cast("int").alias("stops_away"),
        F.pmod(v, F.lit(2)).cast("int").alias("direction_id"),
        kind.alias("kind"),
        *more,
    )


def predictions(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Stored predictions: P2 filter, then nth_at_stop within each snapshot.  The
    events are dealt by file time while they are narrow, so the rank needs no
    further exchange."""
    b = base_events(spark, sf_dir) if events is None else events
    dealt = b.withColumn("file_time", _file_time()).repartition("file_time")
    return rank_at_stop(keep_scorable_updates(_prediction_rows(dealt)), tie_break=["id"])


def prediction_accuracy_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A many-day accuracy table derived from lineitem joined to orders."""
    return accuracy_rows_of(accuracy_lines(spark, sf_dir))


def accuracy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem joined to orders with what the accuracy rows need and no more: small numbers in place of keys and
    texts, so that few bytes a row are shuffled."""
    li = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.pmod("l_partkey", F.lit(192)).cast("short").alias("part"),  # 192: the hours (24) and 8 stops of 8 routes
        F.pmod("l_suppkey", F.lit(12)).cast("byte").alias("supp"),
        F.col("l_linenumber").alias("line"),
        F.col("l_quantity").cast("int").alias("num_predictions"),
        F.floor(F.col("l_quantity") * (F.lit(1.0) - F.col("l_discount") * 5)).cast("int").alias("num_accurate_predictions"),
        (F.col("l_extendedprice") % 200).alias("error"),
        F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).cast("byte").alias("flag"),
        (F.col("l_linestatus") == "O").alias("in_next_two"),
    )
    od = _table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("service_date"))
    return li.join(od, li.l_orderkey == od.o_orderkey, "inner").drop("l_orderkey", "o_orderkey")


def accuracy_rows_of(lines: DataFrame, *more: str) -> DataFrame:
    """The accuracy rows of ``accuracy_lines`` (and the columns ``more`` of theirs)."""
    kind = (
        F.when(F.col("flag") == 1, F.lit("at_terminal"))
        .when(F.col("flag") == 2, F.lit("mid_trip"))
        .otherwise(F.lit(None).cast("string"))
    )
    part, supp = F.col("part").cast("long"), F.col("supp").cast("long")
    return lines.select(
        pick(ENV, F.pmod(supp, F.lit(3))).alias("environment"),
        "service_date",
        (F.lit(3) + F.pmod(part, F.lit(24))).cast("int").alias("hour_of_day"),
        (F.pmod(supp, F.lit(12)) * 5).cast("int").alias("minute_of_hour"),
        pick(ROUTE, F.pmod(part, F.lit(8))).alias("route_id"),
        pick(STOP, F.pmod(idiv(part, 8), F.lit(8))).alias("stop_id"),
        F.pmod(F.col("line"), F.lit(2)).cast("int").alias("direction_id"),
        pick(HIST_BINS, F.col("line") - 1).alias("bin"),
        kind.alias("kind"),
        "in_next_two",
        "num_predictions",
        "num_accurate_predictions",
        (F.col("error") - 100).alias("mean_error"),
        F.col("error").alias("root_mean_squared_error"),
        *more,
    )


def stops_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop dimension from ``part``; the first six fixture stops map onto
    p_partkey 0..5 so that description lookups hit, the last two miss."""
    p = _table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    size = F.col("p_size")
    return p.select(
        F.col("p_partkey").cast("string").alias("id"),
        F.lit("subway").alias("mode"),
        F.col("p_name").alias("name"),
        F.when(F.pmod(size, F.lit(5)) == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.col("p_brand"), F.lit("-"), size.cast("string")))
        .alias("platform_name"),
        F.when(F.pmod(size, F.lit(7)) == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.col("p_name"), F.lit(" - "), F.col("p_type")))
        .alias("description"),
    )


def stop_dim_key(stop: Column) -> Column:
    """Fixture stop id -> stop-dim id: the first six fixture stops map onto
    part keys 0..5, the other two stay unknown (null)."""
    out = None
    for i, sid in enumerate(STOP[:6]):
        out = F.when(stop == sid, F.lit(str(i))) if out is None else out.when(stop == sid, F.lit(str(i)))
    return out


# A landed document holds at most PAGE_ROWS consecutive event ids, so no
# document (one collect_list group) grows with the data volume.
PAGE_ROWS = 500

# platform-specific ids a feed may report for the terminal fixture stops
PLATFORM_IDS = {"70061": "Alewife-0", "70105": "Braintree-0", "70001": "Forest Hills-0", "70036": "Oak Grove-0"}
KIND_UNCERTAINTY = {"mid_trip": 60, "at_terminal": 120, "reverse": 360}


def trip_update_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested trip-update snapshots (``TRIP_UPDATES`` schema) built from the flat
    fixture rows: one document per (environment, file time), one entity per
    trip/vehicle, updates in event order.  Terminal stops are reported by
    platform id on every third row, and a kind is encoded as its uncertainty
    (rows without a kind carry 90 s or nothing, which maps to no kind).  A
    snapshot is landed in pages of at most ``PAGE_ROWS`` consecutive rows, and
    some files are fetched twice.

    The events are dealt by document while they are narrow; updates, entities
    and documents are then built where they are, without a further exchange."""
    paged = base_events(spark, sf_dir).withColumns({
        "env_no": F.pmod(F.col("v"), F.lit(len(ENV))),
        "file_time": _file_time(),
        "page": idiv(F.col("event_id"), PAGE_ROWS).cast("int"),
    })
    doc_keys = ["env_no", "file_time", "page"]
    raw = _prediction_rows(paged.repartition(*doc_keys), "k", *doc_keys)
    unc = F.when(F.col("kind").isNull(), F.when(F.pmod(F.col("k"), F.lit(2)) == 0, F.lit(90)))
    for kind, u in KIND_UNCERTAINTY.items():
        unc = unc.when(F.col("kind") == kind, F.lit(u))
    raw_stop = F.col("stop_id")
    for sid, prefix in PLATFORM_IDS.items():
        raw_stop = F.when(
            (F.col("stop_id") == sid) & (F.pmod(F.col("k"), F.lit(3)) == 0),
            F.concat(F.lit(prefix), (F.lit(1) + F.pmod(F.col("k"), F.lit(2))).cast("string")),
        ).otherwise(raw_stop)
    upd = raw.select(
        *doc_keys, "trip_id", "vehicle_id", "route_id", "direction_id", "id",
        F.struct(
            F.when(F.col("arrival_time").isNotNull(), F.struct(F.col("arrival_time").alias("time"), unc.cast("int").alias("uncertainty"))).alias("arrival"),
            F.when(F.col("departure_time").isNotNull(), F.struct(F.col("departure_time").alias("time"), unc.cast("int").alias("uncertainty"))).alias("departure"),
            F.col("boarding_status"),
            F.col("schedule_relationship"),
            raw_stop.alias("stop_id"),
            F.col("stop_sequence"),
            F.col("stops_away"),
        ).alias("u"),
    )
    trip_keys = [*doc_keys, "trip_id", "vehicle_id", "route_id", "direction_id"]
    ent = upd.groupBy(*trip_keys).agg(
        F.min("id").alias("first_id"),
        F.transform(F.array_sort(F.collect_list(F.struct("id", "u"))), lambda x: x["u"]).alias("updates"),
    )
    ent = ent.select(
        *doc_keys, "first_id",
        F.struct(
            F.concat(F.lit("E"), F.col("first_id").cast("string")).alias("id"),
            F.lit(False).alias("is_deleted"),
            F.struct(
                F.struct("trip_id", "route_id", "direction_id").alias("trip"),
                F.struct(F.col("vehicle_id").alias("id")).alias("vehicle"),
                F.col("updates").alias("stop_time_update"),
            ).alias("trip_update"),
        ).alias("e"),
    )
    docs = ent.groupBy(*doc_keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("first_id", "e"))), lambda x: x["e"]).alias("entity")
    )
    # files of every tenth minute are fetched twice
    ft = F.col("file_time")
    fetches = F.when(F.pmod(idiv(ft, 60), F.lit(10)) == 0, F.array(ft + 10, ft + 70)).otherwise(F.array(ft + 10))
    return docs.select(
        F.struct(ft.alias("timestamp")).alias("header"), "entity", pick(ENV, F.col("env_no")).alias("environment"), "page",
        F.explode(fetches).alias("fetched_at"),
    )


def accuracy_copies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two whole copies of an id-keyed table that disagree: the second copy
    re-keys the urgent pending orders (as a faulty copy would), so each side
    has rows the other lacks while no row is dropped."""
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    a = o.select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("service_date"))
    rekey = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT")
    b = o.select(
        F.when(rekey, -F.col("o_orderkey")).otherwise(F.col("o_orderkey")).alias("id"),
        F.to_date("o_orderdate").alias("service_date"),
    )
    return a, b


# A landed vehicle document holds at most PAGE_VEHICLES consecutive vehicles of a snapshot.
PAGE_VEHICLES = 100


def vehicle_feed_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested vehicle-position snapshots (``VEHICLE_FEED`` schema): the polled
    snapshots of each environment in pages of at most ``PAGE_VEHICLES``
    vehicles, every event of theirs in time order, and one document with an
    empty entity list for a feed without vehicles."""
    pos = vehicle_records(spark, sf_dir).withColumn(
        "stop_id",
        F.when((F.col("stop_id") == "70061") & (F.pmod(F.col("timestamp"), F.lit(2)) == 0), F.lit("Alewife-01"))
        .when((F.col("stop_id") == "70036") & (F.pmod(F.col("timestamp"), F.lit(2)) == 0), F.lit("Oak Grove-02"))
        .otherwise(F.col("stop_id")),
    )
    ent = pos.groupBy("environment", "mode", "snapshot_time", idiv(F.col("v"), PAGE_VEHICLES).cast("int").alias("page")).agg(
        F.transform(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        F.col("timestamp").alias("_t"),
                        F.col("event_id").alias("_k"),
                        F.struct(
                            F.col("is_deleted"),
                            F.struct(
                                "current_status", "stop_id", "timestamp",
                                F.struct("direction_id", "route_id", "trip_id").alias("trip"),
                                F.struct("id", "label").alias("vehicle"),
                            ).alias("vehicle"),
                        ).alias("e"),
                    )
                )
            ),
            lambda x: x["e"],
        ).alias("entity")
    )
    snaps = vehicle_snapshots(spark, sf_dir)
    docs = snaps.join(ent, ["environment", "mode", "snapshot_time"], "left")
    return docs.select(
        F.coalesce("entity", F.array().cast(ent.schema["entity"].dataType)).alias("entity"),
        "environment", "mode", "snapshot_time",
        F.concat(F.lit("t"), F.col("snapshot_time").cast("string")).alias("last_modified"),
        F.coalesce("page", F.lit(0)).alias("page"),
    )


def refetched(docs: DataFrame) -> DataFrame:
    """Vehicle snapshots where the feed's Last-Modified only changes every ten
    minutes, so every other fetch repeats the previous one; every seventh
    fetch comes without the header."""
    changed = F.concat(F.lit("lm"), idiv(F.col("snapshot_time"), 600).cast("string"))
    return docs.withColumn("last_modified", F.when(F.pmod(idiv(F.col("snapshot_time"), 300), F.lit(7)) != 0, changed))


def _iso_local(x: Column) -> Column:
    """Epoch seconds -> ISO-8601 New York wall time with its UTC offset."""
    from headway.functions.times import epoch_to_utc_ntz, local_wall_clock

    local = local_wall_clock(x)
    off = F.timestamp_diff("HOUR", epoch_to_utc_ntz(x), local)
    return F.when(x.isNotNull(), F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.format_string("%+03d:00", off)))


def _http_date(x: Column) -> Column:
    from headway.functions.times import epoch_to_utc_ntz

    return F.concat(F.date_format(epoch_to_utc_ntz(x), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))


def _rel(c: Column) -> Column:
    return F.struct(F.when(c.isNotNull(), F.struct(c.alias("id"))).alias("data"))


def cr_prediction_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON:API prediction snapshots (``CR_PREDICTIONS`` schema), one per file
    time, times as ISO-8601 with offset and the HTTP Last-Modified header."""
    raw = predictions_raw(spark, sf_dir)
    item = F.struct(
        F.struct(
            _iso_local(F.col("arrival_time")).alias("arrival_time"),
            _iso_local(F.col("departure_time")).alias("departure_time"),
            F.col("boarding_status").alias("status"),
            F.col("schedule_relationship"),
            F.col("direction_id"),
            F.col("stop_sequence"),
        ).alias("attributes"),
        F.struct(
            _rel(F.col("vehicle_id")).alias("vehicle"), _rel(F.col("trip_id")).alias("trip"),
            _rel(F.col("route_id")).alias("route"), _rel(F.col("stop_id")).alias("stop"),
        ).alias("relationships"),
    )
    docs = raw.groupBy("file_timestamp", idiv(F.col("id"), PAGE_ROWS).cast("int").alias("page")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("id").alias("_k"), item.alias("p")))), lambda x: x["p"]).alias("data")
    )
    return docs.select("data", _http_date(F.col("file_timestamp")).alias("last_modified"), "page")


def cr_vehicle_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON:API vehicle snapshots (``CR_VEHICLES`` schema), in pages of vehicles like the subway feed;
    every 23rd record has a stop relationship without data."""
    pos = vehicle_records(spark, sf_dir).withColumn("stop_id", F.when(F.pmod("event_id", F.lit(23)) != 0, F.col("stop_id")))
    item = F.struct(
        F.col("id"),
        F.struct(
            F.col("current_status"), F.col("label"), _iso_local(F.col("timestamp")).alias("updated_at"), F.col("direction_id"),
        ).alias("attributes"),
        F.struct(_rel(F.col("route_id")).alias("route"), _rel(F.col("stop_id")).alias("stop"), _rel(F.col("trip_id")).alias("trip")).alias(
            "relationships"
        ),
    )
    docs = pos.groupBy("snapshot_time", idiv(F.col("v"), PAGE_VEHICLES).cast("int").alias("page")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(F.col("timestamp").alias("_t"), F.col("event_id").alias("_k"), item.alias("d")))),
            lambda x: x["d"],
        ).alias("data")
    )
    return docs.select("data", "snapshot_time", F.concat(F.lit("t"), F.col("snapshot_time").cast("string")).alias("last_modified"), "page")


def stops_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops documents (``STOPS`` schema) of the subway mode, in pages of
    ``PAGE_ROWS`` stops."""
    st = stops_dim(spark, sf_dir)
    item = F.struct(F.col("id"), F.struct("description", "name", "platform_name").alias("attributes"))
    docs = st.groupBy(idiv(F.col("id").cast("long"), PAGE_ROWS).alias("page")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("id").cast("long").alias("_k"), item.alias("s")))), lambda x: x["s"]).alias("data")
    )
    return docs.select("data", F.lit("subway").alias("mode"))


def fixture_station_names(dim: DataFrame) -> DataFrame:
    """(stop_id, station_name) for the fixture stops that the stop dimension
    knows (part keys 0..5 stand for the first six fixture stops)."""
    back = None
    for i, sid in enumerate(STOP[:6]):
        back = F.when(F.col("id") == str(i), F.lit(sid)) if back is None else back.when(F.col("id") == str(i), F.lit(sid))
    return dim.filter(F.col("id").isin([str(i) for i in range(6)])).select(
        back.alias("stop_id"), F.col("display_name").alias("station_name")
    )
