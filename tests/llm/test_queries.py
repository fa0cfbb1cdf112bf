"""The training-data queries that have SQL, on the smallest tables."""

from __future__ import annotations

import os

import pytest

from quillon.llm.queries import QUERIES, SQL
from tests.compare import FOLDER, same

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    same(spark, QUERIES[name], SQL[name])


def test_all_ten_are_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 11)]
