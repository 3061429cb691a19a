"""Every named query against its SQL, on the smallest tables."""

import os

import pytest

from halocline.plans import catalog
from tests.compare import same

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_sql(spark, name):
    same(spark, catalog.QUERIES[name], catalog.ORACLE[name], DATA)


def test_flagship_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_every_other_query_runs(spark):
    for name in set(catalog.QUERIES) - set(catalog.ORACLE):
        assert catalog.QUERIES[name](spark, DATA).count() >= 0
