"""The corpus pipeline, stage by stage."""

from __future__ import annotations

import corpus_pipeline
from quillon.llm import decontaminate, rules
from tests.llm.helpers import documents, prose


def test_stages_keep_and_reject(spark, tmp_path):
    passage = prose(500, 20)
    rows = [(i, prose(i, 100)) for i in range(40)] + [(50, prose(0, 100)), (51, prose(1, 100) + " end"), (52, "short"), (53, None), (54, passage + " " + prose(60, 60)), (55, " ".join(w + "***" for w in prose(70, 90).split()))]
    folder = str(tmp_path)
    documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "sharded":
            assert docs.columns == names
    clean = set(range(40))
    assert kept["quality_rules"] == clean | {50, 51, 54}
    assert kept["near_duplicates"] >= clean | {54} and 50 not in kept["near_duplicates"]
    assert 54 not in kept["benchmark_decontamination"] and clean <= kept["benchmark_decontamination"]
    assert kept["source_mixing"] < kept["benchmark_decontamination"]
    assert kept["sharded"] == kept["source_mixing"] and {"shard", "slot"} <= set(docs.columns)
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == kept["sharded"]


def test_stage_names_and_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "benchmark_decontamination", "source_mixing", "sharded"]
    assert corpus_pipeline.ORACLE_SQL is None and decontaminate.WINDOW == 13 and rules.MIN_WORDS == 50
