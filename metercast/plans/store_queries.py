"""Registered queries over kept state: daily roll-ups and sketches, cached
results, and the multi-pattern text join (A1-A3, A7-A9, A16, C7, C9, C13, C16,
C17, S18, J6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import containment, rollups as RO
from ..operators import usage as U
from ..operators.common import ts_literal
from ..session import checkpoint_base
from ..sources import nested_text
from ..sources.result_cache import ResultCache, snapshot
from ..sources.testdata import AS_OF_EVENTS, AS_OF_ORDERS
from . import fixtures_sql as X
from .registry import ORACLE, register, td
from .usage_queries import MA_DAYS, USER_DAYS

_READY: set[str] = set()


def _arrivals(df, as_of: str):
    """A log as it stood ten days before ``as_of``, and the rows that came since."""
    new = F.col("start_time") >= ts_literal(df, "start_time", as_of) - F.make_dt_interval(F.lit(10))
    return df.where(~new), df.where(new)


def usage_rollups(spark, sf_dir) -> RO.UsageRollups:
    """The roll-ups of a folder's usage log, kept beside the checkpoints under the logs' snapshot: made on first use,
    from the log as it stood ten days ago and then from what came since."""
    t = td(spark, sf_dir)
    usage, history = t.usage(), t.query_history()
    path = f"{checkpoint_base(spark)}/rollups-usage-{snapshot(usage)[:16]}{snapshot(history)[:16]}"
    own = RO.UsageRollups(spark, path)
    if path not in _READY:
        before, since = _arrivals(history, AS_OF_ORDERS)
        own.apply(usage, before)
        own.apply(usage, history, new_history=since)
        _READY.add(path)
    return own


def metering_rollups(spark, sf_dir) -> RO.MeteringRollups:
    metering = td(spark, sf_dir).metering()
    path = f"{checkpoint_base(spark)}/rollups-metering-{snapshot(metering)[:32]}"
    own = RO.MeteringRollups(spark, path)
    if path not in _READY:
        before, since = _arrivals(metering, AS_OF_EVENTS)
        own.apply(before)
        own.apply(metering, since)
        _READY.add(path)
    return own


@register("rollup_model_analysis", ORACLE["model_analysis"])
def q_rollup_model_analysis(spark, sf_dir):
    """C9 from daily partial sums."""
    t = td(spark, sf_dir)
    return usage_rollups(spark, sf_dir).model_analysis(t.usage(), t.query_history(), AS_OF_ORDERS, MA_DAYS)


@register("rollup_usage_by_user", ORACLE["usage_by_user"])
def q_rollup_usage_by_user(spark, sf_dir):
    """C16 from daily partial sums."""
    t = td(spark, sf_dir)
    return usage_rollups(spark, sf_dir).usage_by_user(t.usage(), t.query_history(), AS_OF_ORDERS, USER_DAYS)


@register("rollup_usage_by_function", ORACLE["usage_by_function"])
def q_rollup_usage_by_function(spark, sf_dir):
    """C17 from daily partial sums."""
    t = td(spark, sf_dir)
    return usage_rollups(spark, sf_dir).usage_by_function(t.usage(), t.query_history(), AS_OF_ORDERS, USER_DAYS)


@register("distinct_users", X.with_(X.USAGE, X.QH) + f"""
SELECT model_name, COUNT(DISTINCT user_name) AS users
{X.joined(USER_DAYS, ', user_name')} WHERE user_name IS NOT NULL GROUP BY model_name""")
def q_distinct_users(spark, sf_dir):
    """Users of each model, exactly."""
    t = td(spark, sf_dir)
    return U.distinct_users(t.usage(), t.query_history(), AS_OF_ORDERS, USER_DAYS)


@register("rollup_distinct_users", X.with_(X.USAGE, X.QH) + f"""
SELECT model_name, COUNT(DISTINCT user_name) AS exact_users, TRUE AS within_bound
{X.joined(USER_DAYS, ', user_name')} WHERE user_name IS NOT NULL GROUP BY model_name""")
def q_rollup_distinct_users(spark, sf_dir):
    """Users of each model from merged daily sketches beside the exact count: whether the estimate is within four
    standard errors (6.5 %) of it."""
    t = td(spark, sf_dir)
    exact = U.distinct_users(t.usage(), t.query_history(), AS_OF_ORDERS, USER_DAYS).withColumnRenamed("users", "exact_users")
    sketched = usage_rollups(spark, sf_dir).distinct_users(t.usage(), t.query_history(), AS_OF_ORDERS, USER_DAYS)
    near = F.abs(F.col("users") - F.col("exact_users")) <= F.greatest(F.lit(1.0), 0.065 * F.col("exact_users"))
    return (exact.join(sketched, exact.model_name.eqNullSafe(sketched.model_name), "left")
            .select(exact.model_name, "exact_users", F.coalesce(near, F.lit(False)).alias("within_bound")))


@register("rollup_daily_usage", ORACLE["daily_usage"])
def q_rollup_daily_usage(spark, sf_dir):
    """A1 from daily partial sums."""
    return metering_rollups(spark, sf_dir).daily_usage(td(spark, sf_dir).metering(), AS_OF_EVENTS, 30)


@register("rollup_usage_overview", ORACLE["usage_overview"])
def q_rollup_usage_overview(spark, sf_dir):
    """C7 from daily partial sums."""
    return metering_rollups(spark, sf_dir).usage_overview(td(spark, sf_dir).metering(), AS_OF_EVENTS, 30, 3.0)


@register("rollup_budget_status", ORACLE["budget_status"])
def q_rollup_budget_status(spark, sf_dir):
    """C13 from daily partial sums."""
    t = td(spark, sf_dir)
    return metering_rollups(spark, sf_dir).budget_status(t.metering(), t.limits(), AS_OF_EVENTS)


# -- S18 -----------------------------------------------------------------------------

@register("cached_model_analysis", ORACLE["model_analysis"])
def q_cached_model_analysis(spark, sf_dir):
    """C9 through the result cache: stored when no result of its plan and files is younger than ten minutes, read back then."""
    t = td(spark, sf_dir)
    return ResultCache(spark, ttl=600).get(U.model_analysis(t.usage(), t.query_history(users=False), AS_OF_ORDERS, MA_DAYS))


# -- J6 / E24 --------------------------------------------------------------------------

@register("benchmark_passages", """
SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)""")
def q_benchmark_passages(spark, sf_dir):
    """Documents that hold a benchmark item's whole text (J6), by one automaton pass."""
    t = td(spark, sf_dir)
    return containment.containment_join(t.texts(), t.raw("benchmark"), "doc_id", "text", "item_id", "text")


# -- S8 / S12 --------------------------------------------------------------------------

_LINES = "SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line FROM documents"


@register("nested_texts", f"""
SELECT doc_id, 'meta.lang' AS path, lang AS text FROM documents WHERE lang IS NOT NULL
UNION ALL SELECT doc_id, 'meta.source', source FROM documents WHERE source IS NOT NULL
UNION ALL SELECT doc_id, 'lines[].line', line FROM ({_LINES})
UNION ALL SELECT doc_id, 'raw.source', source FROM documents WHERE source IS NOT NULL
UNION ALL SELECT doc_id, 'raw.lines[]', line FROM ({_LINES})""")
def q_nested_texts(spark, sf_dir):
    """Every text inside a struct, an array of structs and a VARIANT made from the documents' columns."""
    lines = F.split("text", "\n")
    docs = td(spark, sf_dir).texts().select(
        "doc_id", F.struct("lang", "source").alias("meta"),
        F.transform(lines, lambda x, i: F.struct(i.alias("no"), x.alias("line"))).alias("lines"),
        F.parse_json(F.to_json(F.struct("source", lines.alias("lines")))).alias("raw"))
    return nested_text.nested_texts(docs, "doc_id")
