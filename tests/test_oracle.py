"""Every registered query against its DuckDB oracle on the smallest tables
(the driver runs the same comparison at sf0.01)."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))
sys.path.insert(0, ROOT)

import __spark_entry__ as E  # noqa: E402
from check_oracle import compare, duck  # noqa: E402
from tidemark.plans import catalog  # noqa: E402

SF = "/root/testdata/sf0.001"
# the training-data queries have tests of their own, in tests/llm
NAMES = sorted(catalog.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["churn_risk_band", "mrr_at_risk"] and len(rows) >= 0


def test_every_query_has_an_oracle_and_is_registered():
    assert set(NAMES) == set(catalog.oracle_sql())
    assert set(NAMES) <= set(E.queries()) and set(catalog.oracle_sql()) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, catalog.queries()[name], catalog.oracle_sql()[name], SF)
    assert r["match"], r
