"""Status bands and derived percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Reconciliation bands on |variance %| (upper bounds, inclusive).
VARIANCE_BANDS = [(1.0, "EXCELLENT"), (5.0, "GOOD"), (15.0, "WARNING")]
VARIANCE_WORST = "CRITICAL"

# Budget light thresholds in percent of the limit.
LIGHT_YELLOW_AT = 80.0
LIGHT_RED_AT = 100.0


def variance_status(variance_pct) -> Column:
    a = F.abs(_c(variance_pct))
    expr = None
    for bound, label in VARIANCE_BANDS:
        expr = (F.when(a <= bound, F.lit(label)) if expr is None
                else expr.when(a <= bound, F.lit(label)))
    return expr.otherwise(F.lit(VARIANCE_WORST))


def budget_pct(used, limit, enabled) -> Column:
    """used/limit*100 when enabled and limit > 0, else 0."""
    lim = _c(limit)
    return F.when(_c(enabled) & (lim > 0), _c(used) / lim * F.lit(100.0)).otherwise(F.lit(0.0))


def budget_light(pct) -> Column:
    p = _c(pct)
    return (F.when(p < LIGHT_YELLOW_AT, F.lit("green"))
             .when(p < LIGHT_RED_AT, F.lit("yellow"))
             .otherwise(F.lit("red")))


def savings_pct(low, high) -> Column:
    """(high - low) / high * 100, 0 when high <= 0."""
    h = _c(high)
    return F.when(h > 0, (h - _c(low)) / h * F.lit(100.0)).otherwise(F.lit(0.0))
