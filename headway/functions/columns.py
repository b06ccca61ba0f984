"""Reusable Column expressions (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from headway.functions.constants import (
    BINS,
    GENERIC_STOP_IDS,
    GENERIC_STOP_PREFIXES,
    GENERIC_STOP_RENAMES,
    KINDS,
    ROUTE_RANK,
    STATUS_STOPPED,
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def floor_div(c: Column | str, n: int) -> Column:
    """Exact integer floor division by a positive literal (no doubles)."""
    x = _col(c)
    return ((x - F.pmod(x, F.lit(n))) / n).cast("long")


def pick(values: list, idx: Column) -> Column:
    """``values[idx]`` for a 0-based integer column (a literal array lookup)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def pooled_mean_error(mean_error: str = "mean_error", n: str = "num_predictions") -> Column:
    """sum(me * n) / sum(n): a null mean drops out of the numerator only."""
    return F.try_divide(F.sum(F.col(mean_error) * F.col(n)), F.sum(F.col(n)))


def pooled_rmse(rmse: str = "root_mean_squared_error", n: str = "num_predictions") -> Column:
    """sqrt(sum(rmse^2 * n) / sum(n))."""
    return F.sqrt(F.try_divide(F.sum(F.pow(F.col(rmse), 2) * F.col(n)), F.sum(F.col(n))))


def accuracy_percentage(accurate: Column | str, total: Column | str) -> Column:
    """round(100 * a / n, 2); 0 when n is 0 or either side is null."""
    a, n = _col(accurate), _col(total)
    return F.when(
        a.isNotNull() & n.isNotNull() & (n != 0), F.round(F.lit(100.0) * a / n, 2)
    ).otherwise(F.lit(0.0))


def accuracy_ratio(accurate: Column | str, total: Column | str) -> Column:
    """a / n, 0 when n is 0 or null."""
    a, n = _col(accurate), _col(total)
    return F.when(n.isNotNull() & (n != 0), a.cast("double") / n).otherwise(F.lit(0.0))


def pct_of(part: Column | str, whole: Column | str) -> Column:
    """part * 100.0 / whole, null when whole is 0 (SQL division semantics)."""
    return F.try_divide(_col(part) * F.lit(100.0), _col(whole))


def resolution_bucket(minute: Column | str, resolution: int) -> Column:
    """Integer bucket (minute div r) * r."""
    r = int(resolution)
    m = _col(minute).cast("long")
    return ((m - F.pmod(m, F.lit(r))) if r > 0 else m).cast("int")


def round_or_zero(x: Column | str, digits: int) -> Column:
    return F.round(F.coalesce(_col(x).cast("double"), F.lit(0.0)), digits)


def hh_mm(hour: Column | str, minute: Column | str) -> Column:
    return F.format_string("%02d:%02d", _col(hour), _col(minute))


def generic_stop_id(stop: Column | str) -> Column:
    """Platform ids of terminals -> generic stop id; other ids unchanged."""
    s = _col(stop)
    out = None
    for k, v in {**GENERIC_STOP_IDS, **GENERIC_STOP_RENAMES}.items():
        out = (F.when(s == k, F.lit(v)) if out is None else out.when(s == k, F.lit(v)))
    for prefix, v in GENERIC_STOP_PREFIXES.items():
        out = out.when(s.startswith(prefix), F.lit(v))
    return out.otherwise(s)


def kind_from_uncertainty(arrival_unc: Column | str, departure_unc: Column | str) -> Column:
    """coalesce(arrival.uncertainty, departure.uncertainty) mapped to a kind; else null."""
    u = F.coalesce(_col(arrival_unc), _col(departure_unc))
    out = None
    for unc, kind in KINDS.items():
        out = F.when(u == unc, F.lit(kind)) if out is None else out.when(u == unc, F.lit(kind))
    return out


def bin_of_lead(lead: Column | str) -> Column:
    """Name of the bin whose [lead_min, lead_max) holds ``lead``; null outside."""
    c = _col(lead)
    out = None
    for name, (lo, hi, _, _) in BINS.items():
        cond = (c >= lo) & (c < hi)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out


def bin_error_bounds(bin_name: Column | str) -> tuple[Column, Column]:
    b = _col(bin_name)
    lo = hi = None
    for name, (_, _, emin, emax) in BINS.items():
        lo = F.when(b == name, F.lit(emin)) if lo is None else lo.when(b == name, F.lit(emin))
        hi = F.when(b == name, F.lit(emax)) if hi is None else hi.when(b == name, F.lit(emax))
    return lo, hi


def route_rank(route: Column | str) -> Column:
    """Subway display order; unknown routes rank 0 (beside Red)."""
    r = _col(route)
    out = None
    for name, i in ROUTE_RANK.items():
        out = F.when(r == name, F.lit(i)) if out is None else out.when(r == name, F.lit(i))
    return out.otherwise(F.lit(0))


def is_stopped(status: Column | str) -> Column:
    return F.coalesce(_col(status) == STATUS_STOPPED, F.lit(False))


def blank_to_null(c: Column | str) -> Column:
    x = _col(c)
    return F.when(F.trim(x) == "", F.lit(None).cast("string")).otherwise(x)
