"""Groups of near-duplicates whose doc_ids are null or repeated."""

from __future__ import annotations

import pytest

from quillon.llm import simhash
from tests.llm.helpers import documents, prose


@pytest.mark.parametrize("deduplicated", [simhash.one_of_each_class, simhash.deduplicated])
def test_unrelated_texts_with_null_or_equal_ids_stay(spark, deduplicated):
    a, b, c, d = (prose(i, 80) for i in range(4))
    rows = [(None, a), (None, b), (None, b), (5, c), (5, d), (7, d)]
    kept = sorted((str(r.doc_id), r.text) for r in deduplicated(documents(spark, rows)).collect())
    assert kept == sorted([("None", a), ("None", b), ("5", c), ("5", d)])
