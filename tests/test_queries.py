"""Every registered query: same rows as its SQL twin, or at least a stable result."""

import re

import pytest

import __spark_entry__ as entry
from tests.compare import connect, difference

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"
# Queries whose result is empty on the smallest data.
NEED_MORE = {"did_roles", "did_panel", "did_store_change", "did_effects", "worst_did"}
SQL = entry.oracle_sql()
ONLY_ROWS = sorted(set(entry.queries()) - set(SQL))
# Keys of optional operators have their own tests.
FITTED = [name for name in ONLY_ROWS if not re.match(r"op\d|pipeline", name)]
MAY_BE_NULL = {"error"}


@pytest.fixture(scope="module")
def databases():
    return {folder: connect(folder) for folder in (SMALL, MEDIUM)}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, databases, name):
    folder = MEDIUM if name in NEED_MORE else SMALL
    assert difference(entry.queries()[name](spark, folder), SQL[name], databases[folder]) is None


@pytest.mark.parametrize("name", sorted(set(FITTED)))
def test_fitted_queries_give_whole_rows(spark, name):
    rows = entry.queries()[name](spark, MEDIUM).collect()
    assert rows
    for row in rows:
        assert all(v is not None for k, v in row.asDict().items() if k not in MAY_BE_NULL), row


def test_fitted_models_beat_the_naive_rule(spark):
    for name in ("gbt_holdout", "elasticnet_holdout", "segment_forecast"):
        mae = {r.model: r.mae for r in entry.queries()[name](spark, MEDIUM).collect()}
        naive = mae.pop("seasonal_naive_7d")
        assert all(value < naive for value in mae.values())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
