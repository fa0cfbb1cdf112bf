"""All registered queries that have SQL, on the smallest tables."""

from __future__ import annotations

import os

import pytest

from quillon.plans.queries import QUERIES, SQL
from tests.compare import FOLDER, same

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    same(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", ["image_ownership", "assignment_1to1", "track_observations", "spaced_topk", "fused_text"])
def test_query_does_not_depend_on_partitions(spark, name):
    few = QUERIES[name](spark, FOLDER).toPandas()
    size = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        many = QUERIES[name](spark, FOLDER).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", size)
    order = list(few.columns)
    assert few.sort_values(order).reset_index(drop=True).equals(many.sort_values(order).reset_index(drop=True))
