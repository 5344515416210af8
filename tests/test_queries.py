"""Every query of the engine against its SQL; those without SQL must give rows."""

import pytest

from credence.plans import catalog

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, spark, sf_dir, same_as_sql):
    same_as_sql(catalog.queries()[name](spark, sf_dir), SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_gives_rows(name, spark, sf_dir):
    assert catalog.queries()[name](spark, sf_dir).count() > 0
