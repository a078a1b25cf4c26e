"""Logical usage tables derived from the shared test parquet (FIXTURES.md).

Every table is a lazy projection of one or two parquet tables, so filters on
the derived columns push down to the scans and the work grows with the input.
Money columns carry an exact integer twin (``*_e8`` credits, ``*_e10`` USD,
``*_centi``) next to the double the logical schema names.
"""

from __future__ import annotations

import functools
import os
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money
from ..operators.common import LOG_DATE, dimension
from . import catalog as cat

# Fixed values of the fixture mapping (FIXTURES.md §3).
AS_OF_EVENTS = "2024-01-30 23:59:59"
AS_OF_ORDERS = "2001-08-01 00:00:00"

# l_linenumber -> function name
LINE_FUNCTIONS = [(1, "COMPLETE"), (2, "COMPLETE"), (3, "SENTIMENT"), (4, "SUMMARIZE"),
                  (5, "TRANSLATE"), (6, "CLASSIFY_TEXT"), (7, "AI_EXTRACT")]
# key % 8 -> model name ('' = blank model of a specialised function)
MOD8_MODELS = [(0, ""), (1, "llama3.1-70b"), (2, "claude-3-5-sonnet"), (3, "llama3.1-8b"),
               (4, "claude-4-opus"), (5, "mistral-large2"), (6, "snowflake-arctic"),
               (7, "snowflake-llama-3.1-405b")]
BLANK_RATE_CENTI = 160
SERVICE_OF_EVENT = [("view", "analyst"), ("signup", "docproc"), ("purchase", "search"),
                    ("error", "finetune")]

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _case(key: Column, mapping, default=None) -> Column:
    expr = None
    for k, v in mapping:
        expr = F.when(key == k, F.lit(v)) if expr is None else expr.when(key == k, F.lit(v))
    return expr.otherwise(F.lit(default)) if default is not None else expr


@lru_cache(maxsize=1)
def _rate_map() -> tuple:
    rates = {r[1]: r[5] for r in cat.catalog_rows()}
    return tuple((k, rates.get(m, BLANK_RATE_CENTI)) for k, m in MOD8_MODELS)


def model_of(key: Column) -> Column:
    return _case(F.pmod(key, F.lit(8)), MOD8_MODELS)


def rate_of(key: Column) -> Column:
    return _case(F.pmod(key, F.lit(8)), _rate_map()).cast("long")


def cents(x: Column) -> Column:
    return F.round(x * F.lit(100)).cast("long")


def _shared(method):
    """Build a derived table once per TestData and arguments; later calls get
    the same lazy DataFrame (its plan, not its rows)."""
    @functools.wraps(method)
    def wrapper(self, *args, **kwargs):
        key = (method.__name__, args, tuple(sorted(kwargs.items())))
        if key not in self._tables:
            self._tables[key] = method(self, *args, **kwargs)
        return self._tables[key]
    return wrapper


class TestData:
    """Logical tables over one scale-factor folder."""

    __test__ = False  # not a pytest test class

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._raw: dict[str, DataFrame] = {}
        self._tables: dict[tuple, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        """One lazy DataFrame per table: the file listing and footer schema
        are resolved once and shared by every use (each action still reads
        the files)."""
        if name not in self._raw:
            self._raw[name] = read(self.spark, self.sf_dir, name)
        return self._raw[name]

    # -- function usage and query history (from lineitem / orders) ----------
    @_shared
    def usage(self) -> DataFrame:
        """``function_query_usage``: query_id, function_name, model_name,
        tokens, token_credits (+ rate_centi, token_credits_e8)."""
        li = self.raw("lineitem")
        tokens = F.round(F.col("l_quantity") * F.lit(100)).cast("long")
        rate = rate_of(F.col("l_partkey"))
        e8 = money.token_credits_e8(tokens, rate)
        return li.select(
            F.col("l_orderkey").alias("query_id"),
            _case(F.col("l_linenumber"), LINE_FUNCTIONS).alias("function_name"),
            model_of(F.col("l_partkey")).alias("model_name"),
            tokens.alias("tokens"),
            rate.alias("rate_centi"),
            money.e8_to_credits(e8).alias("token_credits"),
            e8.alias("token_credits_e8"),
        )

    @_shared
    def query_history(self, users: bool = True) -> DataFrame:
        """``query_history``: one row per order with its customer. With
        ``users=False`` the customer join is left out (user/role NULL) for
        callers that only need query id and time."""
        o = self.raw("orders")
        if not users:
            return o.select(F.col("o_orderkey").alias("query_id"),
                            F.col("o_orderdate").alias("start_time"))
        c = self.raw("customer").select("c_custkey", "c_name", "c_mktsegment")
        return (o.join(c, o.o_custkey == c.c_custkey, "left")
                .select(F.col("o_orderkey").alias("query_id"),
                        F.concat(F.lit("order "), F.col("o_orderkey").cast("string"),
                                 F.lit(" "), F.col("o_orderpriority")).alias("query_text"),
                        F.col("o_orderdate").alias("start_time"),
                        cents(F.col("o_totalprice")).alias("execution_time"),
                        F.col("c_name").alias("user_name"),
                        F.col("o_orderpriority").alias("warehouse_name"),
                        F.col("c_mktsegment").alias("role_name")))

    # -- metering and per-service facts (from events) -----------------------
    @_shared
    def _events(self) -> DataFrame:
        """Events with the service type of their metering row (FIXTURES.md §3)."""
        return self.raw("events").withColumn(
            "service_type",
            F.when(F.pmod(F.col("event_id"), F.lit(5)) == 4, F.lit("WAREHOUSE_METERING"))
             .otherwise(F.lit("AI_SERVICES")))

    @_shared
    def metering(self) -> DataFrame:
        """Hourly metering: start_time, service_type, credits_used (+ _e8)."""
        e = self._events()
        c = cents(F.col("value"))
        e8 = c * F.lit(money.E8 // 100)
        return e.select(
            F.col("ts").alias("start_time"),
            F.col("service_type"),
            money.e8_to_credits(e8).alias("credits_used"),
            e8.alias("credits_used_e8"),
            F.col("event_type"),
        )

    @_shared
    def metering_daily(self) -> DataFrame:
        """Daily metering: usage_date, service_type, credits_used, compute,
        cloud services (compute = all but 'error' events)."""
        m = self.metering()
        is_cloud = F.col("event_type") == "error"
        zero = F.lit(0).cast("long")
        g = m.groupBy(F.to_date("start_time").alias("usage_date"), "service_type").agg(
            money.exact_sum("credits_used_e8").alias("e8"),
            money.exact_sum(F.when(~is_cloud, F.col("credits_used_e8")).otherwise(zero)).alias("c_e8"),
            money.exact_sum(F.when(is_cloud, F.col("credits_used_e8")).otherwise(zero)).alias("s_e8"))
        return g.select("usage_date", "service_type",
                        money.e8_to_credits("e8").alias("credits_used"),
                        money.e8_to_credits("c_e8").alias("credits_used_compute"),
                        money.e8_to_credits("s_e8").alias("credits_used_cloud_services"),
                        F.col("e8").alias("credits_used_e8"))

    @_shared
    def usage_hourly(self) -> DataFrame:
        """``function_usage_hourly`` from click events."""
        e = self._events().where(F.col("event_type") == "click")
        tokens = cents(F.col("value"))
        rate = rate_of(F.col("user_id"))
        e8 = money.token_credits_e8(tokens, rate)
        start = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz")
        return e.select(
            start.alias("start_time"),
            (start + F.expr("INTERVAL 1 HOUR")).alias("end_time"),
            _case(F.pmod(F.col("event_id"), F.lit(7)) + 1, LINE_FUNCTIONS).alias("function_name"),
            model_of(F.col("user_id")).alias("model_name"),
            F.col("user_id").alias("warehouse_id"),
            money.e8_to_credits(e8).alias("token_credits"),
            tokens.alias("tokens"),
            e8.alias("token_credits_e8"),
            # the day of the raw event: look-backs on the truncated start_time
            # imply a bound on it, which reaches the parquet scan
            F.to_date("ts").alias(LOG_DATE),
        )

    @_shared
    def _ai_events(self, event_type: str) -> DataFrame:
        e = self._events()
        # the per-service facts are the AI_SERVICES metering rows, by event type
        return e.where((F.col("event_type") == event_type) & (F.col("service_type") == "AI_SERVICES"))

    @_shared
    def fn_usage(self) -> DataFrame:
        """Per-call function usage of the service facts (click events)."""
        e = self._ai_events("click")
        e8 = cents(F.col("value")) * F.lit(money.E8 // 100)
        return e.select(
            F.col("event_id").alias("query_id"),
            F.when(F.pmod(F.col("event_id"), F.lit(7)) == 5, F.lit("AI_EXTRACT"))
             .otherwise(F.lit("COMPLETE")).alias("function_name"),
            money.e8_to_credits(e8).alias("token_credits"),
            e8.alias("token_credits_e8"))

    @_shared
    def fn_history(self) -> DataFrame:
        e = self._ai_events("click")
        return e.select(F.col("event_id").alias("query_id"), F.col("ts").alias("start_time"))

    @_shared
    def service(self, name: str) -> DataFrame:
        """analyst (credits), docproc (credits_used), search (credits),
        finetune (token_credits): start_time + credit column + its ``_e8``."""
        event_type = dict((s, e) for e, s in SERVICE_OF_EVENT)[name]
        col = {"analyst": "credits", "docproc": "credits_used", "search": "credits",
               "finetune": "token_credits"}[name]
        e = self._ai_events(event_type)
        e8 = cents(F.col("value")) * F.lit(money.E8 // 100)
        return e.select(F.col("ts").alias("start_time"),
                        money.e8_to_credits(e8).alias(col), e8.alias(col + "_e8"))

    @_shared
    def search_daily(self) -> DataFrame:
        s = self.service("search")
        g = s.groupBy(F.to_date("start_time").alias("usage_date")).agg(
            F.count(F.lit(1)).alias("requests"), money.exact_sum("credits_e8").alias("e8"))
        return g.select("usage_date", "requests", money.e8_to_credits("e8").alias("credits"))

    # -- text sources ------------------------------------------------------
    @_shared
    def texts(self) -> DataFrame:
        return self.raw("documents").select("doc_id", "text", "lang", "source")

    @_shared
    def conversations(self) -> DataFrame:
        return self.raw("conversations").select("conv_id", "turn", "role", "text")

    # -- logged model runs (from lineitem) ---------------------------------
    @_shared
    def results(self, price: float = cat.DEFAULT_CREDIT_PRICE) -> DataFrame:
        """Flattened test results: test, model, function, response,
        input/output tokens, latency, cost, status (+ exact twins)."""
        # rows whose model is blank (a specialised function) have no catalog
        # price; the inner join with the catalog below skips them
        li = self.raw("lineitem")
        ok = F.pmod(F.col("l_partkey"), F.lit(50)) != 0
        in_tok = F.round(F.col("l_quantity") * F.lit(100)).cast("long")
        out_tok = F.when(ok, F.col("l_linenumber").cast("long") * 50).otherwise(F.lit(0).cast("long"))
        lat = F.when(ok, F.pmod(F.col("l_suppkey"), F.lit(100)) + 1).otherwise(F.lit(0)).cast("long")
        base = li.withColumn("function", _case(F.col("l_linenumber"), LINE_FUNCTIONS)).select(
            F.col("l_orderkey").alias("session_id"),
            F.concat(F.col("l_returnflag"), F.col("l_linestatus")).alias("test"),
            model_of(F.col("l_partkey")).alias("model"),
            F.col("function"),
            F.concat(F.col("function"), F.lit(" - logged run")).alias("test_type"),
            # responses of 7 to 49 characters
            F.expr("repeat(l_linestatus, l_linenumber * 7)").alias("response"),
            in_tok.alias("input_tokens"), out_tok.alias("output_tokens"),
            lat.alias("latency_centi"),
            F.when(ok, F.lit("success")).otherwise(F.lit("error")).alias("status"))
        full = cat.load_catalog(self.spark)
        c = dimension(full.select("model", "in_centi", "out_centi"), of=full)
        e8 = F.col("input_tokens") * F.col("in_centi") + F.col("output_tokens") * F.col("out_centi")
        e10 = F.when(F.col("status") == "success", e8 * F.lit(money.price_centi(price))).otherwise(F.lit(0).cast("long"))
        return (base.join(c, "model", "inner")
                .select("test", "test_type", "model", "function", "response", "input_tokens", "output_tokens",
                        (F.col("latency_centi") / F.lit(100.0)).alias("latency"),
                        money.e10_to_usd(e10).alias("cost"),
                        "status", "latency_centi", e10.alias("cost_e10"), "session_id"))

    @_shared
    def service_units(self) -> DataFrame:
        """Metered units of the listed services: line items by number, quantities in eighths."""
        names = [n for n, _r, _u in cat.SERVICE_RATES]
        li = self.raw("lineitem").where(F.col("l_linenumber") <= len(names))
        units = F.sum(F.round(F.col("l_quantity") * F.lit(100)).cast("long")).cast("double") / F.lit(8.0)
        return li.groupBy(_case(F.col("l_linenumber"), list(enumerate(names, start=1))).alias("name")).agg(units.alias("units"))

    @_shared
    def calls(self) -> DataFrame:
        """Logged calls before any catalog: test, model (an eighth of them blank), tokens."""
        return self.raw("lineitem").select(
            F.concat(F.col("l_returnflag"), F.col("l_linestatus")).alias("test"), model_of(F.col("l_partkey")).alias("model"),
            F.round(F.col("l_quantity") * F.lit(100)).cast("long").alias("input_tokens"),
            (F.col("l_linenumber").cast("long") * 50).alias("output_tokens"))

    @_shared
    def builtin_results(self) -> DataFrame:
        """Logged runs of the built-in function beside each successful prompt,
        with responses and latencies of their own."""
        li = self.raw("lineitem").where((F.pmod(F.col("l_partkey"), F.lit(50)) != 0) & (F.pmod(F.col("l_partkey"), F.lit(8)) != 0))
        function = _case(F.col("l_linenumber"), LINE_FUNCTIONS)
        return li.select(
            F.concat(model_of(F.col("l_partkey")), F.lit(" (via "), function, F.lit(")")).alias("model"),
            function.alias("function"), F.expr("repeat('B', l_linenumber * 4)").alias("response"),
            (F.pmod(F.col("l_suppkey"), F.lit(50)) + 1).cast("long").alias("latency_centi"),
            F.lit("success").alias("status"))

    @_shared
    def sessions(self, price: float = cat.DEFAULT_CREDIT_PRICE) -> DataFrame:
        """Nested test sessions (FIXTURES.md ``sessions``): one per order,
        holding that order's results (a handful, up to 17 at sf0.1), with its name, test type,
        models and input tokens."""
        r = self.results(price)
        g = r.groupBy("session_id").agg(
            F.min("function").alias("test_type"),
            F.array_sort(F.collect_set("model")).alias("models"),
            F.sum("input_tokens").alias("input_tokens"),
            F.collect_list(F.struct("model", "function", "response", "output_tokens", "latency",
                                    "cost", "status")).alias("results"))
        return g.select(F.concat(F.lit("session "), F.col("session_id").cast("string")).alias("name"),
                        "test_type", "models", "input_tokens", "results")

    @_shared
    def runs(self, price: float = cat.DEFAULT_CREDIT_PRICE) -> DataFrame:
        """One run per model over the successful results."""
        from ..operators.runs import summarize_runs
        return summarize_runs(self.results(price), cat.load_catalog(self.spark), price)

    # -- budget limits -------------------------------------------------------
    @_shared
    def limits(self) -> DataFrame:
        """Alert limits: the dashboard defaults plus scaled variants."""
        rows = [("default", "daily", 10.0, True), ("default", "weekly", 50.0, True),
                ("default", "monthly", 200.0, True),
                ("scaled", "daily", 20000.0, True), ("scaled", "weekly", 100000.0, True),
                ("scaled", "monthly", 300000.0, True),
                ("disabled", "daily", 1.0, False), ("disabled", "weekly", 5.0, False),
                ("disabled", "monthly", 20.0, False)]
        return cat.local_frame(self.spark, rows,
                               "profile string, period string, `limit` double, enabled boolean")
