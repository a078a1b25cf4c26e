"""Registered queries: each binds operators to the test tables of one
scale-factor folder, with the equivalent SQL used as the correctness oracle.

Every query reads whole tables (no id subsets or row caps); limits appear
only where the operator is a top-k report.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.testdata import TestData

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


_TEST_DATA: dict[tuple, TestData] = {}


def td(spark: SparkSession, sf_dir: str) -> TestData:
    """The test tables of one folder for one session, shared by the queries
    (lazy DataFrames: only table resolution is reused, never results)."""
    key = (id(spark), sf_dir)
    t = _TEST_DATA.get(key)
    if t is None or t.spark is not spark:
        t = _TEST_DATA[key] = TestData(spark, sf_dir)
    return t


# The query families register themselves on import (order = bench order).
from . import usage_queries, metering_queries, costing_queries, runs_queries, store_queries  # noqa: E402,F401
