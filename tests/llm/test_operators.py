"""Each operator against a brute-force version, and on nulls, empty tables, ties, repeated rows and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillon.llm import classifier, decontaminate, language_model, mixing, preferences, repeats, rules, sharding, simhash, suffix_array, url_lists
from quillon.llm.components import components
from tests.llm.helpers import SCHEMA, documents, mixed_rows, prose


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, mixed_rows()).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- SimHash -----------------------------------------------------------------------------


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_classes(prints, radius=3):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if bin(prints[i] ^ prints[j]).count("1") <= radius:
            parent[find(j)] = find(i)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("pairwise", [4096, 2])
def test_simhash_against_all_pairs(spark, docs, pairwise):
    rows = docs.select("doc_id", "text").collect()
    prints = [slow_fingerprint(r.text) for r in rows]
    root = slow_classes(prints)
    lowest = {}
    for r, c in zip(rows, root):
        if r.doc_id is not None:
            lowest[c] = min(lowest.get(c, r.doc_id), r.doc_id)
    want = collections.Counter((r.doc_id, f"{p:016x}", lowest.get(c)) for r, p, c in zip(rows, prints, root))
    got = collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, pairwise=pairwise).collect())
    assert got == want


def test_covering_masks_meet_every_pair_within_the_radius():
    masks = simhash.masks(3)
    assert len(masks) == 15
    for flips in itertools.combinations(range(64), 3):
        d = sum(1 << i for i in flips)
        assert any(not m & d for m in masks)


def test_chains_and_dense_groups_of_fingerprints(spark):
    r = random.Random(5)
    base = r.getrandbits(64)
    prints = {base}
    while len(prints) < 120:
        prints.add(r.choice(sorted(prints)) ^ sum(1 << b for b in r.sample(range(64), r.choice([1, 2, 3, 4]))))
    prints = sorted(prints)
    root = slow_classes(prints)
    rows = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp bigint")
    for pairwise in (4096, 1):
        got = {r.node & (1 << 64) - 1: r.component for r in components(simhash.links(rows, pairwise=pairwise)).collect()}
        groups = collections.defaultdict(set)
        for p, c in zip(prints, root):
            groups[c].add(got.get(p, ("alone", p)))
        assert all(len(g) == 1 for g in groups.values())
        assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_long_paths(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(400) if i % 100 != 99], "a bigint, b bigint")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: i // 100 * 100 for i in range(400)}


def test_deduplication_keeps_one_of_each_group(spark, docs):
    kept = simhash.one_of_each_class(docs).select("doc_id").collect()
    ids = [r.doc_id for r in kept]
    assert 0 in ids and 20 not in ids and ids.count(3) == 1
    assert sum(i in (23, 24, 25) for i in ids) == 1


def test_empty_tables(spark, empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert repeats.remove_repeats(empty).count() == 0
    assert rules.judge(empty).count() == 0
    assert sharding.shard_documents(empty).count() == 0
    assert mixing.mix_documents(empty).count() == 0
    assert language_model.score_documents(empty).count() == 0
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contamination(empty, bench).count() == 0
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert classifier.score_quality(empty, labels).count() == 0


# ---- preferences -------------------------------------------------------------------------


def test_preference_prefix_masks_and_nulls(spark):
    a = [("system", "s"), ("user", "q"), ("assistant", "good")]
    b = [("system", "s"), ("user", "q"), ("assistant", "bad"), ("user", None)]
    rows = [(1, a, b), (2, a, a), (3, None, a), (4, [], []), (5, [(None, "x")], [(None, "x"), ("assistant", "y")])]
    df = spark.createDataFrame(rows, f"conv_id bigint, chosen {preferences.TURNS}, rejected {preferences.TURNS}").withColumn("prompt", F.lit("clash"))
    got = {r.conv_id: r for r in preferences.format_pairs(df).collect()}
    assert got[1].n_prompt_turns == 2 and got[2].n_prompt_turns == 3 and got[3].n_prompt_turns == 0 and got[5].n_prompt_turns == 1
    assert got[1].prompt == "<|system|>\ns<|end|>\n<|user|>\nq<|end|>\n"
    assert got[2].chosen_completion == "" == got[4].prompt
    for side in ("chosen", "rejected"):
        text = got[1][f"{side}_completion"]
        assert [text[s["from"] : s["to"]] for s in got[1][f"{side}_mask"]] == [("good" if side == "chosen" else "bad") + "<|end|>"]
    assert got[5].rejected_completion == "<|assistant|>\ny<|end|>\n"


def test_conversation_pairs(spark):
    turns = [(0, 0, "user", "q"), (0, 1, "assistant", "a0"), (1, 0, "user", "p"), (1, 1, "assistant", "a1"), (2, 0, "user", "alone"), (None, 0, "user", "x"), (4, 0, "assistant", None)]
    got = {r.conv_id: r for r in preferences.conversation_pairs(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert set(got) == {0, 1, 4}
    assert got[0].rejected[-1].text == "a1" and got[1].rejected[-1].text == "a0" and got[4].rejected[-1].text == ""


# ---- decontamination ---------------------------------------------------------------------


def slow_contamination(text, items):
    import regex

    def words(t):
        return regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    w, hit, found = words(text), set(), set()
    for name, t in items:
        b = words(t)
        n = min(13, len(b))
        for i in range(len(b) - n + 1) if b else ():
            for j in range(len(w) - n + 1):
                if w[j : j + n] == b[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add(str(name))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [1 << 24, 1])
def test_decontamination_against_all_windows(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    passage = prose(1, 30)
    items = [(7, passage), (10, "The stone, RIVER"), (11, prose(2, 13)), (12, ""), (13, None), (14, "é1 é2"), (15, passage.upper()), (None, "night")]
    texts = [passage, "a " + passage[: len(passage) // 2] + " b", "x the Stone river y", "thestone river", prose(2, 13) + " " + prose(2, 13), None, "", "É1 é1 é2 é1,É2", prose(3, 400), (passage + " gap ") * 40]
    got = decontaminate.contamination(documents(spark, list(enumerate(texts))).repartition(2), spark.createDataFrame(items, "item_id bigint, text string"))
    named = [i for i in items if i[0] is not None]
    for r in got.collect():
        want = slow_contamination(texts[r.doc_id], named)
        assert (r.n_words, r.n_hit, r.items) == want, (r.doc_id, want)
        raw = (texts[r.doc_id] or "").encode()
        cut = [raw[r.spans[k] : r.spans[k + 1]] for k in range(0, len(r.spans), 2)]
        assert sum(len(decontaminate.word_spans(decontaminate.LOWER[np.frombuffer(c, np.uint8)], np.array([0, len(c)]), decontaminate.ALNUM)[0]) for c in cut) == r.n_hit


def test_passages_are_cut_out(spark):
    passage = prose(1, 20)
    df = documents(spark, [(1, f"é start {passage}. And {passage} end"), (2, "clean text"), (None, passage), (4, None)]).withColumn("__x", F.lit(1))
    out = decontaminate.cut_documents(df, spark.createDataFrame([(7, passage)], "item_id bigint, text string"))
    assert out.columns == df.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "é start . And  end", 2: "clean text", None: "", 4: None}


def test_fm_index_finds_and_locates_all_occurrences():
    rng = np.random.default_rng(3)
    text = rng.integers(0, 4, 500)
    index = decontaminate.FMIndex(text, 4)
    for n in (1, 2, 5):
        phrases = np.array([p for p in itertools.product((1, 2, 3), repeat=n)])
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high):
            want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


# ---- URL lists ---------------------------------------------------------------------------


def test_url_lists_as_of_the_fetch(spark):
    day = lambda d: f"2024-01-{d:02d}"
    entries = [("l", "=a.b.com", day(5), "block"), ("l", "=a.b.com", day(9), "lift"), ("l", ".b.com", day(1), "block"), ("m", "=a.b.com", day(7), "allow"), ("l", "a.b.com/x", day(20), "allow"), ("l", None, day(1), "block"), ("l", ".b.com", None, "block"), ("l", ".b.com", day(1), "allow")]
    e = spark.createDataFrame(entries, "list string, pattern string, day string, action string").withColumn("day", F.to_date("day"))
    captures = [(1, "http://A.b.com/", day(4)), (2, "http://a.b.com:80/x/y", day(6)), (3, "https://u@a.b.com./x?q", day(8)), (4, "http://a.b.com/x", day(21)), (5, None, day(8)), (6, "http://b.com", None), (7, "mailto:x", day(8)), (8, "http://ab.com", day(8)), (8, "http://ab.com", day(8))]
    c = spark.createDataFrame(captures, "page_id bigint, url string, fetched string").withColumns({"fetched": F.to_date("fetched"), "pattern": F.lit("clash")})
    got = {r.page_id: (r.n_active, r.pattern, r.action, r.blocked) for r in url_lists.judge(c, e).collect()}
    assert got == {1: (1, ".b.com", "block", True), 2: (2, "=a.b.com", "block", True), 3: (3, "=a.b.com", "block", True), 4: (3, "a.b.com/x", "allow", False), 5: (0, None, None, False), 6: (0, None, None, False), 7: (0, None, None, False), 8: (0, None, None, False)}
    assert url_lists.judge(c, e.limit(0)).filter("blocked").count() == 0


# ---- classifier --------------------------------------------------------------------------


def test_isotonic_is_the_best_monotone_fit():
    at, value = classifier.isotonic(np.arange(6.0), np.array([0, 1, 0.4, 0.2, 0.9, 0.8]), np.ones(6))
    assert (np.diff(value) > 0).all() and value[0] == 0 and value[1] == pytest.approx(1.6 / 3) and value[-1] == pytest.approx(0.85)


def test_classifier_on_held_out_rows(spark):
    rows = [(i, prose(i, 120) if i % 3 else " ".join(f"{w}***" for w in prose(i, 60).split())) for i in range(400)] + [(1000, None), (1001, ""), (1002, "x" * 50_000)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)] + [(5, None), (None, 1)], "doc_id bigint, quality int")
    out = classifier.score_quality(documents(spark, rows), labels).toPandas()
    assert len(out) == len(rows) and out["score"].between(0, 1).all()
    held = out[out.held_out & (out.doc_id < 400)]
    assert ((held.doc_id % 3 > 0).astype(int) == held.predicted).mean() > 0.95
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]).all()


def test_classifier_without_labels(spark, docs):
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r.score for r in classifier.score_quality(docs, labels).collect()} == {0.5}


# ---- repeats -----------------------------------------------------------------------------


def slow_repeats(texts, length):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(gone[:-1].astype(int), prepend=0) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("class_bytes", [1 << 24, 500])
def test_repeats_against_all_windows(spark, class_bytes):
    passage = prose(50, 120)
    texts = [passage, "a" + passage, passage[10:] + "b", prose(1, 100) + passage[:500] + prose(2, 90), passage[:399], "é" * 900, "xy" * 700 + "z", prose(3, 900), None, "", passage[:300] + "!" + passage[301:], prose(3, 900)]
    df = documents(spark, list(enumerate(texts))).repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(df, class_bytes=class_bytes, shard_bytes=4000).collect()}
    assert got == dict(enumerate(slow_repeats([(t or "").encode() for t in texts], 400)))


def test_repeated_rows_are_copies(spark):
    t = prose(1, 200)
    rows = repeats.remove_repeats(documents(spark, [(1, t), (1, t), (None, prose(2, 200))]), keep_text=True).collect()
    assert sorted((r.doc_id is None, r.n_removed, r.kept_text == "") for r in rows) == [(False, len(t), True)] * 2 + [(True, 0, False)]


def test_suffix_arrays_and_prefixes_against_sorting(monkeypatch):
    monkeypatch.setattr(suffix_array, "SMALL", 8)
    rng = np.random.default_rng(1)
    for k in range(60):
        x = rng.integers(0, 1 + k % 5, 1 + k * 5).astype(np.uint8)
        if k % 3 == 0:
            x = np.tile(x[: max(1, len(x) // 7)], 9)
        raw = x.tobytes()
        order = suffix_array.suffix_array(x)
        assert order.tolist() == sorted(range(len(x)), key=lambda i: raw[i:])
        before, common = suffix_array.permuted_prefixes(x, order)
        for i, j in enumerate(before):
            if j >= 0:
                n = next((n for n in range(len(x)) if i + n >= len(x) or j + n >= len(x) or raw[i + n] != raw[j + n]), len(x))
                assert common[i] == n


# ---- mixing ------------------------------------------------------------------------------


def slow_budget(leaves, weights, total, epochs):
    """Sequential water filling on the tree."""

    def share(nodes, budget):
        got, live = {}, dict(nodes)
        while True:
            w = sum(x["w"] for x in live.values())
            full = [k for k, x in live.items() if budget * x["w"] >= x["limit"] * w]
            if not full:
                return got | {k: budget * x["w"] // w for k, x in live.items()}
            for k in full:
                got[k] = live.pop(k)["limit"]
                budget -= got[k]
            if not live:
                return got

    out, level = {}, {(): total}
    for d, name in enumerate(("domain", "lang", "source")):
        nxt = {}
        for parent, budget in level.items():
            kids = collections.defaultdict(lambda: {"limit": 0})
            for leaf, n in leaves.items():
                if leaf[:d] == parent:
                    kids[leaf[: d + 1]]["limit"] += n * epochs
            for k in kids:
                kids[k]["w"] = weights.get(name, {}).get(k[-1], 1)
            nxt |= share(kids, budget)
        level = nxt
    return level


def test_mix_meets_budgets(spark):
    r = random.Random(2)
    rows = [(i, prose(i, r.randrange(1, 60)), r.choice(["en", "de", None]), f"src{r.choice([0, 0, 0, 1, 2, 13])}", 0) for i in range(300)] + [(400, None, "en", "src1", 0), (401, "", "en", None, 0)]
    df = documents(spark, rows)
    out = mixing.mix_documents(df).collect()
    assert len(out) == len(rows)
    leaves, used = collections.Counter(), collections.Counter()
    for x in out:
        leaves[x.domain, x.lang, x.source] += x.n_tokens
        used[x.domain, x.lang, x.source] += x.n_tokens * x.copies
    budgets = slow_budget(leaves, mixing.WEIGHTS, sum(leaves.values()) * 60 // 100, 2)
    longest = max(x.n_tokens for x in out)
    for leaf, budget in budgets.items():
        assert budget - longest < used[leaf] <= budget, leaf
    key = lambda x, e: hashlib.md5(f"mix:{e}:{x.doc_id}".encode()).hexdigest()
    for leaf, budget in budgets.items():
        mine = [x for x in out if (x.domain, x.lang, x.source) == leaf]
        whole = min(2, budget // max(leaves[leaf], 1))
        rest, run = budget - whole * leaves[leaf], 0
        for x in sorted(mine, key=lambda x: key(x, whole)):
            run += x.n_tokens
            if leaves[leaf]:
                assert x.copies == whole + (run <= rest and budget < 2 * leaves[leaf])


def test_mixed_documents_repeat_and_keep_columns(spark, docs):
    out = mixing.mixed_documents(docs, 100, 100, max_epochs=1)
    assert out.columns == docs.columns and out.count() == docs.count()
    docs = docs.withColumns({"_copies": F.lit(0), "_hash": F.lit(0), "_id": F.lit(0)})
    assert simhash.deduplicated(docs).columns == rules.kept_documents(docs).columns == docs.columns
    half = mixing.mixed_documents(docs, 150, 100, max_epochs=2)
    assert half.columns == docs.columns
    assert docs.count() < half.count() <= 2 * docs.count()


# ---- language model ----------------------------------------------------------------------


@pytest.mark.parametrize("head", [1 << 18, 20])
def test_language_model_counts_and_beats_the_base(spark, head):
    rows = [(i, prose(i, 150).replace("stone river", "stone river cloud")) for i in range(80)] + [(200, None), (201, ""), (202, "Unseen WORDS é"), (None, prose(7, 20)), (3, prose(3, 150))]
    df = documents(spark, rows)
    out = language_model.score_documents(df, head_size=head).collect()
    assert len(out) == len(rows)
    tokens = lambda t: (t or "").encode().lower().split() + [None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    count = collections.Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    want = collections.Counter()
    for i, t in rows:
        w = tokens(t)
        want[i, held(i), len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    assert all(r.score <= 0 for r in out)
    better = [r.score > r.base_score for r in out if r.held_out and r.n_tokens > 20]
    assert np.mean(better) > 0.8


def test_probabilities_sum_to_one_over_all_words():
    rng = np.random.default_rng(0)
    words = np.sort(rng.integers(5, 1 << 63, 300).astype(np.uint64))
    head = language_model.Head(words, rng.integers(2, 4000, 300) ** 2 // 1000 + 2)
    assert head.find(np.array([words[2], 5, words[0]], np.uint64)).tolist() == [2, -1, 0]
    model = language_model.Model(head, 4096, tail_tokens=4, tail_types=4, discount=0.5, total=10**6)
    assert model.levels > 1 and model.slots <= 4096 + 3 * model.tree.classes
    model.weights = rng.normal(size=(model.slots, language_model.ARITY)).astype(np.float32)
    for before in (words[7], words[8]):
        every = np.stack([np.full(301, before), np.append(words, np.uint64(3))], axis=1).ravel()  # each word after the same one; 3 is no frequent word
        p = 10 ** model.log10(every, np.arange(0, 603, 2))[0][1::2]
        assert p.sum() == pytest.approx(1, abs=1e-5)
    tail = 4 * (1 - 0.5) / 5 + (0.5 * 4 + 1) / 5  # four words seen once, and an unknown one
    assert tail == pytest.approx(1)


def test_language_model_against_plain_counts(spark):
    """The weights and scores from sums in plain Python over the same tree, slots and coefficients."""
    rows = [(i, prose(i, 60)) for i in range(60)] + [(100, prose(3, 60)), (101, None)]
    df = documents(spark, rows)
    training = df.filter(~language_model.held_out(F.col("doc_id")))
    counts = language_model.count_words(training)
    model, _ = language_model.train(training, counts)
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0

    def paths(text):
        words, at = language_model.tokens(np.frombuffer((text or "").encode(), np.uint8), np.array([0, len((text or "").encode())]))
        hashes, leaves = language_model.contexts(words, at), model.leaf(words)
        for t in range(len(words)):
            for k in range(model.levels):
                node = int(model.tree.node[leaves[t], k])
                if node < 0:
                    break
                size, n = int(model.size[node]), int(model.first[-1])
                yield k, node, int(model.tree.part[leaves[t], k]), [i * n + int(model.first[node]) + (int(h[t]) * size >> 32) for i, h in enumerate(hashes)]

    taken = collections.Counter()
    for i, t in rows:
        if not held(i):
            taken.update((s, part) for _, _, part, slots in paths(t) for s in slots)
    in_slot = collections.Counter()
    for (s, _), n in taken.items():
        in_slot[s] += n

    def weight(i, k, node, s, part):
        share = float(model.tree.share[node, part])
        if not share:
            return 0.0
        ratio = math.log((taken[s, part] + language_model.TRUST * share) / (in_slot[s] + language_model.TRUST) / share)
        return float(model.scale[i, k, min(math.ceil(math.log2(in_slot[s] + 1)), language_model.BINS - 1)]) * ratio

    out = {r.doc_id: r.score for r in language_model.score_documents(df).collect()}
    known = {r.word: r.n for r in counts.collect()}
    for i, t in rows[:12] + rows[-2:]:
        want = 0.0
        for k, node, part, slots in paths(t):
            x = [math.log(p) + sum(weight(j, k, node, s, q) for j, s in enumerate(slots)) if (p := float(model.tree.share[node, q])) else -60.0 for q in range(language_model.ARITY)]
            want += (x[part] - math.log(sum(map(math.exp, x)))) / math.log(10)
        words, _ = language_model.tokens(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))
        for w in words[model.leaf(words) == len(model.head.words)].view(np.int64).tolist():
            inside = known[w] - model.discount if w in known else model.discount * model.tail_types + 1
            want += math.log10(inside / (model.tail_tokens + 1))
        assert out[i] == pytest.approx(want, abs=1e-3)


# ---- rules -------------------------------------------------------------------------------


def slow_measures(text):
    import regex

    text = text or ""
    w = regex.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if regex.search(r"[^\x20\x09-\x0D]", x)]
    tri = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    rep = {p for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(rep)


def test_rule_measures_against_plain_python(spark, docs):
    extra = documents(spark, [(100, "a b c a b c a b c d"), (101, "l\nl\n\nl \nm"), (102, "x#y|z é* *"), (103, "a a a a"), (104, None)])
    rows = docs.unionByName(extra)
    got = rules.judge(rows).collect()
    texts = collections.defaultdict(list)
    for r in rows.select("doc_id", "text").collect():
        texts[r.doc_id].append(r.text)
    for r in got:
        n, chars, symbols, dup, rep = slow_measures(texts[r.doc_id][0])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n) and not (r.base_failed and r.kept)


def test_rules_keep_clean_texts_and_reject_outliers(spark):
    rows = [(i, prose(i, 120), "en" if i % 2 else None, f"s{i % 3}", 0) for i in range(60)] + [(100, " ".join(w + "%%%" for w in prose(5, 100).split()), "en", "s0", 0)]
    out = {r.doc_id: r.kept for r in rules.judge(documents(spark, rows), least=5).collect()}
    assert not out.pop(100) and all(out.values())


def test_sketches_merge(spark, docs):
    measured = rules.measure(docs)
    whole = rules.sketch(measured).groupBy("measure", "bucket").agg(F.sum("n").alias("n"))
    parts = rules.sketch(measured.filter("doc_id % 2 = 0")).unionByName(rules.sketch(measured.filter("not doc_id % 2 = 0 or doc_id is null"))).groupBy("measure", "bucket").agg(F.sum("n").alias("n"))
    assert whole.exceptAll(parts).count() == 0 == parts.exceptAll(whole).count()


# ---- shards ------------------------------------------------------------------------------


def test_shards_are_even_and_gapless(spark, docs):
    out = sharding.shard_documents(docs, shards=7).collect()
    assert len(out) == docs.count()
    by = collections.defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in out:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)


def test_written_shards_follow_their_slots(spark, docs, tmp_path):
    sharding.write_shards(sharding.shard_stage(docs, 5), str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == docs.count() and back.groupBy("shard").agg((F.max("slot") + 1 == F.count("*")).alias("ok")).filter("not ok").count() == 0


def test_one_key_may_hold_most_rows(spark):
    rows = spark.createDataFrame([(5, f"t{i % 4}") for i in range(300)] + [(i, "x") for i in range(60)], "doc_id bigint, text string")
    sizes = [r["count"] for r in sharding.shard_documents(rows, shards=8).groupBy("shard").count().collect()]
    assert sum(sizes) == 360 and max(sizes) - min(sizes) <= 1


def test_walk_follows_the_ring_row_by_row():
    nodes = sharding.ring(5, 8)
    rng = random.Random(1)
    counts = {a: rng.randrange(0, 30) for a in range(len(nodes))}
    limits = sharding.bounds(sum(counts.values()), 5)
    pieces = sharding.walk(counts, nodes, limits)
    load = [0] * 5
    for a, n in counts.items():
        assert sum(b - c for c, b, _, _ in pieces[a]) == n
        for c, b, s, _ in pieces[a]:
            load[s] += b - c
    assert load == limits


def test_growing_moves_few_rows(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("x"))
    a, b = (sharding.shard_documents(rows, shards=n).select("doc_id", F.col("shard").alias(f"s{n}")) for n in (40, 41))
    moved = a.join(b, "doc_id").filter("s40 <> s41").count()
    assert moved < 0.1 * 20_000
