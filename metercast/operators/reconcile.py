"""Three-tier reconciliation of billed credits against per-service records
(C10, S13, S14, U1, A11, A23, E12, E13)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bands, money
from ..sources.catalog import local_frame
from ..sources.readers import check_access, is_missing  # noqa: F401  (S13, re-exported)
from .common import credit_e8, since

STATUS_OK = "OK"
STATUS_NO_ACCESS = "No Access"


@dataclass
class SourceSpec:
    """One granular source: a loader returning the facts (with a
    ``start_time`` column unless ``time_col`` says otherwise), the name of
    its credit column and an optional extra predicate."""
    service: str
    load: Callable[[], DataFrame]
    credits_col: str
    time_col: str = "start_time"
    where: Callable[[DataFrame], object] | None = None
    notes: dict = field(default_factory=dict)


def _source_facts(spec: SourceSpec, as_of, days: int) -> DataFrame | None:
    """``(service, e8)`` rows of one source in the look-back window, or None
    when the source's table or path is missing (S14). Nothing else is
    tolerated: a misspelt column is an error, not 0 credits."""
    try:
        df = spec.load()
        df = df.where(since(df, spec.time_col, as_of, days))
        if spec.where is not None:
            df = df.where(spec.where(df))
        return df.select(F.lit(spec.service).alias("service"),
                         credit_e8(df, spec.credits_col).cast("long").alias("e8"))
    except AnalysisException as e:
        if not is_missing(e):
            raise
        return None


def _facts(sources: list[SourceSpec], as_of, days: int) -> DataFrame:
    """The rows of every resolvable source in one union, plus one zero-credit
    marker per source that carries its status, so empty and missing sources
    still get a row. All sources then share one aggregation stage."""
    markers, facts = [], []
    for spec in sources:
        f = _source_facts(spec, as_of, days)
        # a numeric flag, so the aggregate stays a hash aggregate
        markers.append((spec.service, 0, 1 if f is None else 0))
        if f is not None:
            facts.append(f.withColumn("missing", F.lit(0)))
    spark = SparkSession.getActiveSession()
    out = local_frame(spark, markers, "service string, e8 long, missing int")
    for f in facts:
        out = out.unionByName(f)
    return out


def service_totals(sources: list[SourceSpec], as_of, days: int = 30) -> DataFrame:
    """Per-service credits and status (U1): one grouped aggregate over the
    union of the sources' rows (partial sums per task, one shuffle)."""
    g = _facts(sources, as_of, days).groupBy("service").agg(
        money.exact_sum("e8").alias("credits_e8"), F.max("missing").alias("_missing"))
    return g.select("service", "credits_e8",
                    F.when(F.col("_missing") == 1, F.lit(STATUS_NO_ACCESS))
                     .otherwise(F.lit(STATUS_OK)).alias("status"))


def baseline(metering: DataFrame, as_of, days: int = 30,
             service_type: str = "AI_SERVICES") -> DataFrame:
    m = metering.where(since(metering, "start_time", as_of, days)
                       & (F.col("service_type") == service_type))
    return m.agg(F.coalesce(money.exact_sum(credit_e8(m, "credits_used")),
                            F.lit(0).cast(money.SUM_TYPE)).alias("baseline_e8"))


def reconcile_services(sources: list[SourceSpec], as_of, days: int = 30,
                       positive_only: bool = False) -> DataFrame:
    """Per-service credits and source status; ``positive_only`` keeps the
    services with credits > 0 (P10, the breakdown chart's rows)."""
    t = service_totals(sources, as_of, days)
    out = t.select("service", money.e8_to_credits("credits_e8").alias("credits"), "status")
    return out.where(F.col("credits") > 0) if positive_only else out


def reconcile(metering: DataFrame, sources: list[SourceSpec], as_of, days: int = 30,
              service_type: str = "AI_SERVICES") -> DataFrame:
    """One-row summary: baseline, granular total, variance, variance %,
    coverage % and status band. A zero baseline gives 0 % (EXCELLENT) and
    sets ``baseline_missing``.

    The baseline rows and every source's rows form one union, tagged, and a
    single aggregate splits them again: one scan per source, one stage, no
    join."""
    m = metering.where(since(metering, "start_time", as_of, days)
                       & (F.col("service_type") == service_type))
    base_rows = m.select(F.lit(True).alias("_base"), credit_e8(m, "credits_used").cast("long").alias("e8"),
                         F.lit(0).alias("missing"))
    src_rows = _facts(sources, as_of, days).select(F.lit(False).alias("_base"), "e8", "missing")
    zero = F.lit(0).cast(money.SUM_TYPE)
    j = base_rows.unionByName(src_rows).agg(
        F.coalesce(money.exact_sum(F.when(F.col("_base"), F.col("e8"))), zero).alias("baseline_e8"),
        F.coalesce(money.exact_sum(F.when(~F.col("_base"), F.col("e8"))), zero).alias("granular_e8"),
        F.sum("missing").alias("sources_missing"))
    base = money.e8_to_credits("baseline_e8")
    gran = money.e8_to_credits("granular_e8")
    var = money.e8_to_credits(F.col("granular_e8") - F.col("baseline_e8"))
    var_pct = F.when(base > 0, var / base * F.lit(100.0)).otherwise(F.lit(0.0))
    cov_pct = F.when(base > 0, gran / base * F.lit(100.0)).otherwise(F.lit(0.0))
    return j.select(base.alias("baseline_credits"), gran.alias("granular_total"),
                    var.alias("variance"), var_pct.alias("variance_pct"),
                    cov_pct.alias("coverage_pct"), bands.variance_status(var_pct).alias("status"),
                    (base <= 0).alias("baseline_missing"),
                    F.col("sources_missing").cast("long").alias("sources_missing"))
