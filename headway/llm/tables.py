"""Reading inputs and writing intermediate tables."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.session import shared_path


def lean(run):
    """``run`` for ``mapInArrow``, giving free memory back to the system when a task ends.

    Spark's Python workers serve the tasks of later stages too, and would keep
    what the largest of all tasks needed."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
        if trim is not None:
            trim(0)

    return task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_ROWS = 512
BATCH_BYTES = 4 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows and bytes: texts are long, and Spark's default of 10,000 rows can take a gigabyte in a task.

    A setting that is not the default is left alone."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))
        spark.conf.set(_BYTES, str(BATCH_BYTES))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id long, text string)`` of ``docs``, whatever its other columns."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back.

    This cuts the lineage as a stored table does: a lost executor rereads
    files instead of recomputing earlier shuffles.  Afterwards the driver's
    garbage is collected, since Spark deletes the shuffle files of finished
    plans only when their handles are found unreachable."""
    spark = df.sparkSession
    small_batches(spark)
    path = shared_path(spark, "headway-llm", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    spark.sparkContext._jvm.System.gc()
    return out


def discard(*tables: DataFrame) -> None:
    """Delete ``stored`` tables that nothing reads any more: what was made of them is a stored table itself."""
    for t in tables:
        path = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


BITS = 1 << 23


def _bit(col: str):
    return F.pmod(F.xxhash64(col), F.lit(BITS)).cast("int")


def marked(rows: DataFrame, id_col: str, wanted: DataFrame, wanted_col: str, inverse: bool = False) -> DataFrame:
    """The rows of ``rows`` whose id may be one of ``wanted``: all that are and, by hash, a few others.

    With ``inverse`` the rest: rows whose id is certainly not one of them.  A filter before a join on the id, so that a join with few ids does not
    shuffle every text.  What is broadcast is a bit table of fixed size (at most
    131,072 rows of 64 bits), whatever the number of ids; a full table lets
    every row pass."""
    bit = wanted.select(_bit(wanted_col).alias("b"))
    words = bit.groupBy(F.expr("b div 64").alias("__word")).agg(F.expr("bit_or(shiftleft(1L, b % 64))").alias("__bits"))
    words = stored(words, "bit-table")
    out = rows.withColumn("__bit", _bit(id_col)).withColumn("__word", F.expr("__bit div 64")).join(F.broadcast(words), "__word", "left")
    hit = F.coalesce(F.expr("bit_get(__bits, __bit % 64) = 1"), F.lit(False))
    return out.where(~hit if inverse else hit).drop("__word", "__bit", "__bits")
