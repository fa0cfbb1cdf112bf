"""Near copies of the pipeline against all pairs."""

from __future__ import annotations

import collections
import random

import pytest

import corpus_pipeline
from quillon.llm import near_copies
from tests.llm.helpers import documents, mixed_rows, prose


def slow_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def slow_groups(texts):
    held = [slow_set(t) for t in texts]
    name = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if held[i] == held[j] or 5 * len(held[i] & held[j]) >= 4 * len(held[i] | held[j]) > 0:
                old, new = name[i], name[j]
                name = [new if x == old else x for x in name]
    return name


def rows_of_families():
    r = random.Random(3)
    rows = mixed_rows()
    line = prose(1000, 40)
    for k in range(40):
        rows.append((100 + k, line + " " + prose(2000 + k, 20 + k)))  # a common passage, mostly not near copies
    for k in range(60):
        w = prose(3000, 90).split()
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            w[r.randrange(len(w))] = f"changed{k}"
        rows.append((200 + k, " ".join(w)))
    return rows


@pytest.mark.parametrize(("most", "block"), [(16, 512), (2, 512), (2, 7)])
def test_groups_against_all_pairs(spark, most, block):
    docs = documents(spark, rows_of_families()).repartition(3).cache()
    rows = docs.select("doc_id", "text").collect()
    want = collections.defaultdict(list)
    for r, g in zip(rows, slow_groups([r.text for r in rows])):
        want[g].append(r.doc_id)
    got = collections.defaultdict(list)
    for r in near_copies.grouped(docs, most, block).collect():
        got[r.component].append(r.doc_id)
    norm = lambda groups: sorted(sorted(map(str, g)) for g in groups.values())
    assert norm(got) == norm(want)
    assert near_copies.deduplicated(docs, most, block).count() == len(want)


def test_spanning_crosses_labels_only():
    import numpy as np

    a = np.arange(100)
    held = [a, a + 1, a + 2, a + 500, np.append(a[:99] + 500, 9999)]
    got = near_copies.spanning(np.array([1, 2, 3, 4, 5]), np.array([1, 1, 3, 4, 5]), held)
    assert {frozenset(p) for p in got} in ({frozenset((3, 1)), frozenset((5, 4))}, {frozenset((3, 2)), frozenset((5, 4))})


def test_the_stage_follows_the_similarity_and_not_the_digest(spark):
    """One changed word in 60 is a near copy, far apart as digests or not; texts below 0.8 stay."""
    rows = []
    for k in range(20):
        w = prose(k, 60).split()
        rows.append((2 * k, " ".join(w)))
        rows.append((2 * k + 1, " ".join(w[:30] + ["other"] + w[31:])))  # 51 of 61 runs
    apart = prose(99, 60).split()
    rows += [(100, " ".join(apart)), (101, " ".join(w + "x" if i % 20 == 10 else w for i, w in enumerate(apart)))]
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, documents(spark, rows), "").collect()}
    assert kept == set(range(0, 40, 2)) | {100, 101}


def test_equal_fingerprints_are_one_member_of_a_bucket(spark):
    """Classes with equal fingerprints don't multiply a bucket's members: their number follows the different fingerprints, 15 keys each."""
    r, near = random.Random(5), [0, 1, 2]  # three fingerprints within two bits of each other
    counts = []
    for n in (30, 60, 120):
        rows = [(k, 100, [0] * 8, [near[k % 3] + (s << 40) for s in range(8)]) for k in range(1, n + 1)]
        r.shuffle(rows)
        classes = spark.createDataFrame(rows, "cls bigint, size int, bits array<bigint>, fps array<bigint>")
        pairs, members, *rest = near_copies.buckets(classes)
        keys = members.groupBy("key").count().collect()
        counts.append(members.count())
        assert max(k["count"] for k in keys) == 3
        assert {p.b for p in pairs.collect()} == set(range(2, n + 1))
        (held,) = rest
        assert held.count() == 8 * n and {m.n for m in members.collect()} >= {n, n // 3}
    assert len(set(counts)) == 1 and counts[0] <= 8 * 3 * (15 + 1)


def test_copies_of_equal_fingerprints_are_grouped_by_similarity(spark):
    """The same words in other orders: equal fingerprints, near copies only within an order."""
    rows = []
    for order in range(6):
        w = prose(11, 120).split()
        random.Random(order).shuffle(w)
        for k in range(7):
            rows.append((100 * order + k, " ".join([*w[: 10 + k], w[11 + k], w[10 + k], *w[12 + k :]])))
    want = collections.defaultdict(set)
    for (i, _), g in zip(rows, slow_groups([t for _, t in rows])):
        want[g].add(i)
    assert len(want) == 6
    for most, block in ((16, 512), (2, 7)):
        got = collections.defaultdict(set)
        for r in near_copies.grouped(documents(spark, rows), most, block).collect():
            got[r.component].add(r.doc_id)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_empty(spark):
    assert near_copies.deduplicated(documents(spark, [(1, "a")]).filter("doc_id = 2")).count() == 0
