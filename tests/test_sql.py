"""Every registered query of the library against its SQL on the smallest data."""

import pytest
from compare import same

from lociloom.plans.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, data, name):
    assert same(QUERIES[name](spark, data), duck.sql(ORACLE[name]).df())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
