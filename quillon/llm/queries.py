"""Queries op1_ to op10_ over the tables of a folder, and their SQL."""

from __future__ import annotations

from quillon.llm import classifier, decontaminate, language_model, mixing, preferences, repeats, rules, sharding, simhash, url_lists
from quillon.llm._common import table


def op1_simhash_classes(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


def op2_preference_pairs(spark, sf_dir):
    return preferences.digest(preferences.format_pairs(preferences.conversation_pairs(table(spark, sf_dir, "conversations"))))


def op3_fm_decontamination(spark, sf_dir):
    return decontaminate.digest(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op4_dated_url_lists(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return url_lists.judge(url_lists.page_captures(pages), url_lists.page_entries(pages))


def op5_kernel_quality(spark, sf_dir):
    return classifier.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_induced_repeats(spark, sf_dir):
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op7_tree_mix(spark, sf_dir):
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op8_class_maxent(spark, sf_dir):
    return language_model.score_documents(table(spark, sf_dir, "documents"))


def op9_adaptive_rules(spark, sf_dir):
    judged = rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_ring_shards(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_classes,
        op2_preference_pairs,
        op3_fm_decontamination,
        op4_dated_url_lists,
        op5_kernel_quality,
        op6_induced_repeats,
        op7_tree_mix,
        op8_class_maxent,
        op9_adaptive_rules,
        op10_ring_shards,
    )
}
#: The others can't be expressed in SQL; their tests hold them against brute force.
SQL = {
    "op2_preference_pairs": preferences.SQL,
    "op3_fm_decontamination": decontaminate.SQL,
    "op4_dated_url_lists": url_lists.SQL,
    "op6_induced_repeats": repeats.SQL,
    "op7_tree_mix": mixing.SQL,
    "op9_adaptive_rules": rules.SQL,
}
