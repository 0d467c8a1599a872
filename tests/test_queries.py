import os

import pytest

from codeatlas.plans import catalogue
from oracle import compare

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_matches_sql(spark, name):
    compare(spark, name, catalogue.QUERIES[name], catalogue.SQL[name], SF)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
