"""Every query of the catalog: equal to its SQL, or runs and has rows where SQL cannot express it."""

from __future__ import annotations

import pytest

from quillon.plans import catalog
from tests.compare import assert_same, connection


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, sf_dir, duck, name):
    assert_same(catalog.queries()[name](spark, sf_dir), duck, catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    assert df.count() > 0


def test_entry_point(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
