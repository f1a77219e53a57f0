import pytest

from oracle import duck_rows, spark_rows
from strandline.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", QUERIES)
def test_rows_equal_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SF)) == duck_rows(SQL[name], SF)
