import time

import pytest
from compare import connect, difference

from tallymill.catalog.oracle import ORACLE
from tallymill.catalog.queries import QUERIES

SF = "/root/testdata/sf0.01"
# Values depend on a trained model; their own tests judge them.
MODELS = {"elbow", "kmeans", "forecast_linear", "forecast_gbt", "forecast_reservoir", "price_recommendation"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql_or_is_a_model():
    assert set(QUERIES) - set(ORACLE) == MODELS
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    started = time.time()
    result = difference(QUERIES[name](spark, SF), con, ORACLE[name])
    print(f"{name} {time.time() - started:.1f}s")
    spark.catalog.clearCache()
    assert result is None, result
