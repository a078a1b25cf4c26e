"""Every registered query runs on the smallest test tables and yields rows
with a stable, duplicate-free schema; every query has an oracle."""

from types import SimpleNamespace

from metercast.plans import registry

from .conftest import SF_SMALL

E = SimpleNamespace(queries=lambda: registry.QUERIES, oracle_sql=lambda: registry.ORACLE)

# a tokenizer's merges are no SQL: compared with the library over the whole table in test_ledger.py
ROWS_ONLY = {"exact_token_counts", "exact_token_stats"}


def test_every_query_has_an_oracle_or_is_rows_only():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(qs) - set(sql) == ROWS_ONLY
    assert set(sql) <= set(qs)


def test_every_query_runs_at_smallest_scale(spark):
    empty = []
    for name, fn in E.queries().items():
        df = fn(spark, SF_SMALL)
        cols = df.columns
        assert len(cols) == len(set(cols)), name
        n = df.count()
        assert n >= 0
        if n == 0:
            empty.append(name)
        assert fn(spark, SF_SMALL).columns == cols, name      # stable schema
    # only the strict-threshold alert list may be empty on the small tables
    assert set(empty) <= {"active_alerts"}, empty
