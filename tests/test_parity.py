"""Every registered query against its DuckDB twin at sf0.01 (the driver's gate)."""

import pytest

import __spark_entry__ as E
from conftest import SF001, SF01  # noqa: F401
from glyphframe.plans.catalog import QUERIES
from parity import compare, duck

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(E.queries()) and set(QUERIES) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    assert compare(spark, name, SF01, con, verbose=False)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["fold", "length", "train_rows", "valid_rows"]
    assert len(rows) > 0
    # every fold trains + validates on all labelled rows of each length
    by_len = {}
    for r in rows:
        by_len.setdefault(r.length, set()).add(r.train_rows + r.valid_rows)
    assert all(len(v) == 1 for v in by_len.values())
