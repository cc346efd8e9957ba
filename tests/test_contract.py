"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from check_contract import compare, duck

QUERIES = contract.queries()
ORACLES = contract.oracle_sql()
# Full-size tree models are checked by their errors in test_models.
SLOW = {"rf_predict", "gbt_predict"}
# Queries of the corpus operators have tests of their own.
LEARNED = {name for name in QUERIES if name.startswith("op") or name == "pipeline"}


@pytest.fixture(scope="module")
def connection(sf_dir):
    return duck(sf_dir)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    row = contract.entry(spark).first()
    assert row["n_features_total"] == 4 and row["overall_severity"] == "none"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW - LEARNED))
def test_query(spark, connection, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name not in ORACLES:
        assert len(got) > 0
        return
    assert compare(got, connection.execute(ORACLES[name]).df()) is None
