"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check import compare
from codecatalog.plans import registry


# The 200 smallest documents hold no broken Python file, so both sides are empty there.
EMPTY_AT_SMALLEST = {"quarantine_syntax"}


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, sf_dir, name):
    result = compare(spark, sf_dir, name)
    assert result.startswith("ok") or (result == "EMPTY" and name in EMPTY_AT_SMALLEST), result


def test_every_query_has_a_twin():
    assert set(registry.QUERIES) == set(registry.ORACLES)
    assert set(registry.QUERIES) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["path", "module_name", "n_symbols", "n_deprecated", "n_undocumented"]
    assert rows.count() > 0
