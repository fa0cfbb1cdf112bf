"""Clashing column names, texts of more than a piece, empty tables."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import classifier, decontaminate, language_model, mixing, preferences, repeats, rules, sharding, simhash, url_lists
from quillon.llm._common import PIECE_BYTES
from tests.llm.helpers import SCHEMA, documents, prose
from tests.llm.test_operators import slow_contamination, slow_fingerprint

CLASHING = ["__hash", "_hash", "_id", "_doc_id", "_text_hash", "__copy", "copies", "_copies", "_c", "_r", "_arc", "_cell", "_rank", "_place", "_low", "_pieces", "_piece", "spans", "items", "component", "label", "size", "part", "row"]


@pytest.mark.parametrize(
    "keep",
    [
        simhash.one_of_each_class,
        simhash.deduplicated,
        rules.kept_documents,
        lambda d: mixing.mixed_documents(d, 100, 100, 2),
        lambda d: mixing.mixed_documents(d, 100, 100, 1),
        lambda d: decontaminate.clean_documents(d, d.sparkSession.createDataFrame([(1, prose(900, 20))], "item_id bigint, text string")),
        lambda d: decontaminate.cut_documents(d, d.sparkSession.createDataFrame([(1, prose(900, 20))], "item_id bigint, text string")),
        lambda d: sharding.shard_stage(d, 3).drop("shard", "slot"),
    ],
)
def test_extra_columns_stay(spark, keep):
    rows = [(i, prose(i, 120)) for i in range(6)] + [(3, prose(3, 120))]
    df = documents(spark, rows).withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in CLASHING})
    out = keep(df)
    assert out.columns == df.columns
    got = out.collect()
    assert len(got) >= 6 and all(r[n] == f"{n}{r.doc_id}" for r in got for n in CLASHING)


def test_preferences_keep_columns(spark):
    turns = [("user", "q"), ("assistant", "a")]
    df = spark.createDataFrame([(1, turns, turns, "x", "y")], f"conv_id bigint, chosen {preferences.TURNS}, rejected {preferences.TURNS}, _c string, _r string")
    r = preferences.format_pairs(df).first()
    assert (r["_c"], r["_r"]) == ("x", "y") and r.n_prompt_turns == 2


@pytest.fixture(scope="module")
def long_rows():
    r = random.Random(7)
    words = [f"w{r.randrange(60000)}" for _ in range(190_000)]
    text = " ".join(words)
    assert len(text) > PIECE_BYTES
    passage = " ".join(words[5000:5100])
    return [(1, text), (2, prose(2, 80) + " " + passage), (3, prose(3, 90)), (4, text[-30000:] + " tail")], passage


def test_texts_of_more_than_a_piece(spark, long_rows):
    rows, passage = long_rows
    df = documents(spark, rows)
    assert {r.doc_id: r.fingerprint for r in simhash.near_duplicates(df).collect()} == {i: f"{slow_fingerprint(t):016x}" for i, t in rows}
    items = [(9, passage)]
    found = decontaminate.contamination(df, spark.createDataFrame(items, "item_id bigint, text string"))
    assert {r.doc_id: (r.n_words, r.n_hit) for r in found.collect()} == {i: slow_contamination(t, items)[:2] for i, t in rows if i != 1} | {1: (190_000, 100)}
    seen = Counter(hash(t[k : k + 400]) for _, t in rows for k in range(len(t) - 399))
    removed = {}
    for i, t in rows:
        end = removed[i] = 0
        for k in range(len(t) - 399):
            if seen[hash(t[k : k + 400])] > 1:
                removed[i] += k + 400 - max(end, k)
                end = k + 400
    assert {r.doc_id: (r.n_bytes, r.n_removed) for r in repeats.remove_repeats(df).collect()} == {i: (len(t), removed[i]) for i, t in rows}
    assert removed[1] > 30_600 and removed[4] >= 30_000 and removed[2] > 600 and removed[3] == 0
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 5)], "doc_id bigint, quality int")
    assert all(0 <= r.score <= 1 for r in classifier.score_quality(df, labels).collect())
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    tokens = {i: [*t.encode().lower().split(), None] for i, t in rows}
    count = Counter(w for i, t in rows if not held(i) for w in tokens[i])
    n, v = sum(count.values()), len(count)
    for r in language_model.score_documents(df).collect():
        assert r.n_tokens == len(tokens[r.doc_id]) and r.train_tokens == n
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens[r.doc_id]))


def test_empty_conversations_and_captures(spark):
    turns = spark.createDataFrame([], "conv_id bigint, turn int, role string, text string")
    assert preferences.digest(preferences.format_pairs(preferences.conversation_pairs(turns))).count() == 0
    entries = spark.createDataFrame([("l", ".b.com", "block")], "list string, pattern string, action string").withColumn("day", F.lit("2024-01-01").cast("date"))
    captures = spark.createDataFrame([], "page_id bigint, url string, fetched date")
    assert url_lists.judge(captures, entries).count() == 0


def test_the_pipeline_on_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"shard", "slot"} <= set(out.columns)
