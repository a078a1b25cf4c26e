"""The correctness gate inside pytest: every registered query with an oracle
matches its DuckDB SQL on the smallest test tables (rows, columns and a
bit-exact value hash). ``scripts/oracle_check.py`` runs the same comparison
on any scale factor."""

import pytest

from metercast.plans import registry
from metercast.plans.oracle import compare, duckdb_views

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def con():
    c = duckdb_views(SF_SMALL)
    yield c
    c.close()


def test_all_oracles_match(spark, con):
    qs, sqls = registry.QUERIES, registry.ORACLE
    bad = []
    for name, sql in sqls.items():
        out = compare(qs[name](spark, SF_SMALL), con, sql, name)
        if not out.ok:
            bad.append(f"{name}: {out.detail}")
    assert not bad, "\n".join(bad)
