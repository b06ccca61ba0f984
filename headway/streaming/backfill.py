"""The windowed copy of the accuracy history, with its cursor.

Rows and cursor are published in one version of the destination, so a run that
dies between the two leaves neither, and of two runs at once one fails on the
version number: no week is copied twice or skipped.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession

from headway.operators import maintenance as MT
from headway.streaming.published import Published

TABLE, WRITER = "accuracy", "backfill"


def cursor(spark: SparkSession, root: str) -> _dt.date | None:
    """The first date that no run has copied yet; none before the first run."""
    at = Published(spark, root).latest().notes.get(WRITER, {}).get("cursor")
    return _dt.date.fromisoformat(at) if at else None


def run_backfill(spark: SparkSession, source: DataFrame, root: str, today: _dt.date, days: int = 7, min_days_in_past: int = 3) -> dict:
    """Copy the next window of ``source`` into the published table at ``root``, or leave it while it is too recent; the report of the run."""
    p = Published(spark, root)
    base = p.latest()
    notes = base.notes.get(WRITER, {})
    at = notes.get("cursor")
    first_date = _dt.date.fromisoformat(at) if at else MT.earliest_service_date(source).first()[0]
    if first_date is None:
        return {"first": None, "last": None, "status": "empty", "next_cursor": None, "rows_copied": 0}
    first, last, status, nxt = MT.backfill_window(first_date, today, days, min_days_in_past)
    report = {"first": str(first), "last": str(last), "status": status, "next_cursor": str(nxt), "rows_copied": 0}
    if status == "copied":
        rows = MT.with_week_partition(MT.backfill_copy(source, first, last)).drop("week_label")
        written = p.write(rows.hint("rebalance", "service_date"), TABLE, ["week_start", "service_date"])
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("week_start", "service_date"))
        new = p.read(TABLE, f"{schema}, week_start date, service_date date", base._replace(tables={TABLE: written}))
        report["rows_copied"] = new.count()  # from the files' footers
        p.commit(base, replace={TABLE: written}, writer=WRITER, batch=base.writers.get(WRITER, 0) + 1,
                 notes={"cursor": str(nxt), "schema": schema, "copied": notes.get("copied", 0) + report["rows_copied"]})
    return report


def copied(spark: SparkSession, root: str) -> DataFrame:
    """What the runs so far have copied."""
    p = Published(spark, root)
    v = p.latest()
    return p.read(TABLE, v.notes[WRITER]["schema"] + ", week_start date, service_date date", v)
