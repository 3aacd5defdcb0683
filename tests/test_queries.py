"""Every query of the library runs; those with SQL give its rows."""

import pytest

from tempora.plans.catalogue import ORACLE_SQL, QUERIES
from tests import oracle


@pytest.fixture(scope="module")
def duck(sf_dir):
    return oracle.connect(sf_dir)


def test_every_sql_has_its_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(name, spark, sf_dir, duck):
    oracle.check(QUERIES[name](spark, sf_dir), duck, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0
