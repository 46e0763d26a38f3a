"""Every registered query with SQL gives the SQL's rows; the others run."""

import pytest

from oracle import connect, spark_rows, sql_rows
from weftgraph import queries as Q

SF = "/root/testdata/sf0.001"
#: Fifty rounds of a fixpoint each: checked at a larger scale by the driver.
SLOW = ("pagerank", "personalized_pagerank")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n in Q.queries() if n not in SLOW])
def test_query(spark, con, name):
    got = spark_rows(Q.queries()[name](spark, SF))
    if name in Q.oracle_sql():
        assert got == sql_rows(con, Q.oracle_sql()[name])
