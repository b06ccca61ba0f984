"""Spark session and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import threading

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None, app: str = "headway",
              extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session.  On a cluster the master, memory and the
    shared ``spark.checkpoint.dir`` come from the submit configuration."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder: ``spark.checkpoint.dir`` as the
    cluster configures it, else the context's checkpoint dir.  Only when
    neither is set and the master is local (tests) is a private folder created
    and registered with ``SparkContext.setCheckpointDir``; on a cluster a
    folder of one machine would not be shared, so a missing setting is an error."""
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="headway-ckpt-")
        sc.setCheckpointDir(d)
        d = sc.getCheckpointDir() or d
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    return os.path.join(ensure_checkpoint_dir(spark), *parts)


_MATERIALIZED: dict[tuple, object] = {}
_LOCK = threading.RLock()


def materialize(spark: SparkSession, build, name: str, key: tuple = (), partition_by: list[str] | None = None,
                fmt: str = "parquet", schema=None, compression: str | None = None):
    """Write ``build()`` once as a Parquet table under the shared checkpoint folder
    and return a DataFrame reading it back.

    This cuts the lineage like a stored table does (downstream plans start from
    a scan with column pruning and filter pushdown; a lost executor re-reads
    files instead of recomputing the upstream jobs).  Tables are memoised per
    application and ``key`` so a session builds (and even analyses) each one
    once."""
    app = spark.sparkContext.applicationId
    k = (app, name, *key)
    with _LOCK:
        return _materialize_locked(spark, build, k, name, partition_by, fmt, schema, compression)


def _materialize_locked(spark, build, k, name, partition_by, fmt, schema, compression):
    app = k[0]
    df = _MATERIALIZED.get(k)
    if df is None:
        import hashlib

        tag = hashlib.sha1(repr(k).encode()).hexdigest()[:12]
        path = shared_path(spark, "headway-tables", app, f"{name}-{tag}")
        w = build().write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        if compression:
            w = w.option("compression", compression)
        w.format(fmt).save(path)
        # keep the DataFrame: its file index (partition listing) is reused
        r = spark.read.format(fmt)
        df = (r.schema(schema) if schema is not None else r).load(path)
        _MATERIALIZED[k] = df
    return df
