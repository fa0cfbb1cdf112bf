"""A hashed maximum-entropy language model with classes, trained on the cluster.

Frequent words are leaves of a tree of classes: a class has up to `ARITY` parts of
about equal mass, down to single words. P(word | before) is the product, down the
word's path, of softmaxes over the parts of a class. A softmax starts from the
parts' shares of the training tokens and adds the weights of three hashed features:
the word before, the word two before (a skip), and both together.

* Words are counted over all training texts (a shuffle of counts by word hash).
* At most `HEAD` frequent words (none that occur once) are leaves; all other words,
  unknown ones included, are one leaf, in which absolute discounting leaves room for
  unknown words. Their counts come by a join, whatever the number.
* Every class has slots for the contexts that the features hash to, as many as its
  share of the training tokens gives it. The slots grow with the training tokens, one
  for each `TOKENS_A_SLOT`, up to `SLOTS`; that bound fixes the memory of a worker.
* A feature's weight is the log-ratio of its slot's counts to the class's shares,
  times a coefficient for features that occurred about as often on that level of the
  tree. Counts are summed over all training texts. Coefficients learn by gradient
  updates: each step sums gradients and curvatures over the cluster, on every
  `PARTS`-th training text, against counts of the others.
* Scores come from sparse numpy batches; frequent words and weights are broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm._common import LOWER, NOT_SPACE, bounded_batches, fewer_tasks, mixed, pieces, prefix_hash, saved, span_hash, text_buffer, word_spans

HEAD = 1 << 18
#: Parts of a class, and features of a context.
ARITY, FEATURES = 16, 3
TOKENS_A_SLOT, SLOTS = 2, 1 << 19
#: Weight of the shares against a slot's counts, bins of counts, gradient steps and one part in so many for them.
TRUST, BINS, STEPS, PARTS = 4.0, 10, 3, 8
#: Log-ratios at most, so that sums of three, times 1.5, have finite exponentials.
FARTHEST = 18.0
#: Slots of a block of counts, and tokens worked on together.
BLOCK, TOGETHER = 1024, 1 << 16
#: Hash of the end token, and of what stands before a text.
END, START = np.uint64(1), np.uint64(2)
PIECE = 1 << 19


def held_out(doc_id: Column, folds: int = 10) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with END after each document, and the n + 1 token offsets."""
    data = LOWER[data]
    starts, ends, at = word_spans(data, offsets, NOT_SPACE)
    n = len(offsets) - 1
    out = np.empty(len(starts) + n, np.uint64)
    own = np.ones(len(out), bool)
    last = at[1:] + np.arange(n)
    own[last] = False
    out[own] = span_hash(prefix_hash(data), starts, ends)
    out[last] = END
    return out, np.concatenate([[0], last + 1])


def _count(batches):
    for b in batches:
        data, offsets = text_buffer(b.column(0))
        parts = []
        for i, j in pieces(offsets):
            parts.append(np.unique(tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[0], return_counts=True))
        if parts:
            words, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])


class Head:
    """Frequent words: sorted hashes with an index by their leading bits."""

    BITS = 18

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        top = (self.words >> np.uint64(64 - self.BITS)).astype(np.int64)
        self.first = np.searchsorted(top, np.arange((1 << self.BITS) + 1)).astype(np.int32)
        self.longest = int(np.diff(self.first).max(initial=0))
        self.padded = np.concatenate([self.words, np.zeros(self.longest + 1, np.uint64)])

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The index of each word, -1 if it isn't frequent."""
        at = self.first[(hashes >> np.uint64(64 - self.BITS)).astype(np.int64)]
        out = np.full(len(hashes), -1, np.int32)
        todo = np.arange(len(hashes))
        for k in range(self.longest):
            hit = self.padded[at[todo] + k] == hashes[todo]
            out[todo[hit]] = at[todo[hit]] + k
            todo = todo[~hit]
            todo = todo[self.padded[at[todo] + k] < hashes[todo]] if len(todo) else todo
            if not len(todo):
                break
        out[out >= len(self.words)] = -1
        return out


def before(words: np.ndarray, at: np.ndarray, back: int) -> np.ndarray:
    """The token ``back`` places before each, START beyond the document's first."""
    out = np.empty_like(words)
    out[back:] = words[:-back] if len(words) > back else words[:0]
    out[:back] = START
    for k in range(back):
        out[np.minimum(at[:-1] + k, at[1:] - 1)] = START
    return out


def contexts(words: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """32-bit hashes of each token's context: the word before, the skip, both."""
    one, two = before(words, at, 1), before(words, at, 2)
    return [mixed(x) >> np.uint64(32) for x in (one ^ np.uint64(0x1111), two ^ np.uint64(0x2222 << 20), one * np.uint64(3) + two * np.uint64(0x9E3779B97F4A7C15))]


class Tree:
    """Classes of classes: for each leaf the classes on its path (-1 below it) and the part that each step takes."""

    def __init__(self, mass: np.ndarray):
        order = np.argsort(-mass, kind="stable")
        upto = np.concatenate([[0.0], np.cumsum(mass[order])])
        levels, self.classes, todo = [], 0, [(0, len(order))] if len(order) > 1 else []
        while todo:
            node, part, after = np.full(len(order), -1, np.int32), np.zeros(len(order), np.int8), []
            for a, b in todo:
                middle = (upto[a:b] + upto[a + 1 : b + 1]) / 2 - upto[a]
                taken = np.arange(b - a) if b - a <= ARITY else np.minimum((middle / (upto[b] - upto[a]) * ARITY).astype(int), ARITY - 1)
                node[order[a:b]], part[order[a:b]] = self.classes, taken
                cut = [a, *(a + 1 + np.flatnonzero(np.diff(taken))).tolist(), b]
                after += [(x, y) for x, y in zip(cut, cut[1:]) if y - x > 1]
                self.classes += 1
            levels.append((node, part))
            todo = after
        self.node = np.stack([n for n, _ in levels], axis=1) if levels else np.zeros((len(order), 0), np.int32)
        self.part = np.stack([p for _, p in levels], axis=1) if levels else np.zeros((len(order), 0), np.int8)
        self.share = np.zeros((self.classes, ARITY))
        for k in range(len(levels)):
            on = self.node[:, k] >= 0
            np.add.at(self.share, (self.node[on, k], self.part[on, k]), mass[on])
        self.mass = self.share.sum(axis=1)
        self.share /= np.maximum(self.mass, 1e-300)[:, None]


class Model:
    """The tree, where each class's slots begin, and the slots' weights."""

    def __init__(self, head: Head, slots: int, tail_tokens: int, tail_types: int, discount: float, total: int):
        self.head, self.tail_tokens, self.tail_types, self.discount, self.total = head, tail_tokens, tail_types, discount, total
        self.tree = Tree(np.concatenate([head.counts, [tail_tokens + 1]]).astype(float))
        with np.errstate(divide="ignore"):
            self.log_share = np.maximum(np.log(self.tree.share), -60).astype(np.float32)  # parts that a class hasn't have no mass
        own = self.tree.mass / max(self.tree.mass.sum(), 1)
        self.size = np.maximum(1, np.floor(slots / FEATURES * own)).astype(np.uint64)
        self.first = np.concatenate([[0], np.cumsum(self.size.astype(np.int64))])
        self.slots = FEATURES * int(self.first[-1])
        self.levels = self.tree.node.shape[1]
        self.scale = np.full((FEATURES, max(self.levels, 1), BINS), 1 / FEATURES)
        self.weights: np.ndarray | None = None
        self.bins: np.ndarray | None = None

    def leaf(self, words: np.ndarray) -> np.ndarray:
        """Each word's leaf; the last is that of all words that aren't frequent."""
        found = self.head.find(words)
        return np.where(found >= 0, found, len(self.head.words))

    def steps(self, leaves: np.ndarray, hashes: list[np.ndarray]):
        """Level by level: the tokens that go on, their classes, the parts taken, and the slots of the features."""
        for k in range(self.levels):
            node = self.tree.node[leaves, k]
            live = np.flatnonzero(node >= 0)
            if not len(live):
                return
            node = node[live]
            size, first = self.size[node], self.first[node]
            slots = [i * self.first[-1] + first + ((h[live] * size) >> np.uint64(32)).astype(np.int64) for i, h in enumerate(hashes)]
            yield k, live, node, self.tree.part[leaves[live], k].astype(np.int64), slots

    def ratios(self, counts: np.ndarray) -> np.ndarray:
        """Log-ratios of the slots' counts to their classes' shares; 0 for parts that a class hasn't."""
        node = np.repeat(np.arange(self.tree.classes), self.size.astype(np.int64))
        out = np.zeros((self.slots, ARITY), np.float32)
        for a in range(0, self.slots, 1 << 14):
            b = min(a + (1 << 14), self.slots)
            share = self.tree.share[node[np.arange(a, b) % max(len(node), 1)]]
            n = counts[a:b].astype(np.float64)
            with np.errstate(divide="ignore", invalid="ignore"):
                out[a:b] = np.where(share > 0, np.clip(np.log((n + TRUST * share) / (n.sum(axis=1, keepdims=True) + TRUST) / share), -FARTHEST, FARTHEST), 0)
        return out

    def levels_of(self) -> np.ndarray:
        """The level of each class."""
        out = np.zeros(self.tree.classes, np.int64)
        for k in range(self.levels):
            out[self.tree.node[self.tree.node[:, k] >= 0, k]] = k
        return out

    def finish(self, counts: np.ndarray) -> None:
        """The weights of all counts: log-ratios times the coefficients."""
        level, bins, n = np.repeat(self.levels_of(), self.size.astype(np.int64)), bins_of(counts), int(self.first[-1])
        self.weights = self.ratios(counts)
        for i in range(FEATURES):
            self.weights[i * n : (i + 1) * n] *= self.scale[i, level, bins[i * n : (i + 1) * n]].astype(np.float32)[:, None]

    def log10(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of each token's leaf given what stands before it, and the leaves."""
        leaves, hashes = self.leaf(words), contexts(words, at)
        out = np.zeros(len(words))
        for lo in range(0, len(words), TOGETHER):
            own = slice(lo, lo + TOGETHER)
            for _, live, node, part, slots in self.steps(leaves[own], [h[own] for h in hashes]):
                x = self.log_share.take(node, axis=0)
                for s in slots:
                    x += self.weights.take(s, axis=0)
                taken = x[np.arange(len(part)), part]
                out[lo + live] += taken - np.log(np.einsum("ij->i", np.exp(x, out=x)))
        return out / np.log(10), leaves


def bins_of(counts: np.ndarray) -> np.ndarray:
    """Bins of slots by the logarithm of their occurrences."""
    return np.minimum(np.ceil(np.log2(counts.sum(axis=1, dtype=np.float64) + 1)), BINS - 1).astype(np.int8)


def _count(batches):
    for b in batches:
        data, offsets = text_buffer(b.column(0))
        parts = []
        for i, j in pieces(offsets):
            parts.append(np.unique(tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[0], return_counts=True))
        if parts:
            words, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])


def _chunks(model: Model, batches):
    """Leaves and context hashes of the texts' tokens, some at a time."""
    for b in batches:
        data, offsets = text_buffer(b.column(0))
        for i, j in pieces(offsets, PIECE):
            words, at = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            leaves, hashes = model.leaf(words), contexts(words, at)
            for lo in range(0, len(words), TOGETHER):
                own = slice(lo, lo + TOGETHER)
                yield leaves[own], [h[own] for h in hashes]


def _slot_counts(broadcast):
    """How often each part was taken in each slot, in blocks of slots."""

    def run(batches):
        model = broadcast.value
        total = np.zeros((model.slots, ARITY), np.float32)
        flat = total.reshape(-1)
        for leaves, hashes in _chunks(model, batches):
            for _, _, _, part, slots in model.steps(leaves, hashes):
                for s in slots:
                    np.add.at(flat, s * ARITY + part, np.float32(1))
        for k in range(0, model.slots, BLOCK):
            if total[k : k + BLOCK].any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total[k : k + BLOCK].tobytes()], pa.binary())], ["block", "sums"])

    return run


def _summed(batches):
    """One row per block, the sum of all; memory as for the blocks."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for k, v in zip(b.column(0).to_pylist(), b.column(1)):
            x = np.frombuffer(v.as_py(), np.float32).astype(np.float64)
            sums[k] = sums[k] + x if k in sums else x
    for k, x in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.astype(np.float32).tobytes()], pa.binary())], ["block", "sums"])


def slopes(model: Model, leaves: np.ndarray, hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the log-likelihood by the coefficients."""
    first, second = np.zeros(model.scale.shape), np.zeros(model.scale.shape)
    for k, _, node, part, slots in model.steps(leaves, hashes):
        x, rows = model.log_share.take(node, axis=0), []
        for i, s in enumerate(slots):
            rows.append((model.weights.take(s, axis=0), model.bins.take(s)))
            x += rows[i][0] * model.scale[i, k].astype(np.float32).take(rows[i][1])[:, None]
        np.exp(x, out=x)
        x /= np.einsum("ij->i", x)[:, None]
        for i, (r, n) in enumerate(rows):
            y = x * r
            mean = np.einsum("ij->i", y)
            first[i, k] += np.bincount(n, r[np.arange(len(part)), part] - mean, minlength=BINS)
            y *= r
            second[i, k] += np.bincount(n, np.einsum("ij->i", y) - mean * mean, minlength=BINS)
    return first, second


def _gradient(broadcast, scale: np.ndarray):
    def run(batches):
        model = broadcast.value
        model.scale = scale
        total = np.zeros((2, *scale.shape))
        for leaves, hashes in _chunks(model, batches):
            total += slopes(model, leaves, hashes)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "sums"])

    return run


def _added(batches):
    total = None
    for b in batches:
        for v in b.column(1):
            x = np.frombuffer(v.as_py(), np.float64)
            total = x if total is None else total + x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "sums"])


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n): how often each word hash occurs in the texts."""
    text = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return saved(text.mapInArrow(_count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")))


def train(docs: DataFrame, counts: DataFrame, head_size: int = HEAD, steps: int = STEPS, slots: int = SLOTS) -> tuple[Model, int]:
    """The model of the training texts, and the least count of its frequent words."""
    spark = docs.sparkSession
    context = spark.sparkContext
    bucket = F.expr("case when n < 4096 then n else shiftleft(shiftright(n, cast(length(bin(n)) - 6 as int)), cast(length(bin(n)) - 6 as int)) end")
    sizes = sorted(counts.groupBy(bucket.alias("n_from")).agg(F.count("*").alias("types"), F.sum("n").alias("tokens")).collect(), reverse=True)  # bounded: buckets
    least, types = 1 << 62, 0
    for r in sizes:
        types += r["types"]
        if r["n_from"] < 2 or types > head_size:
            break
        least = r["n_from"]
    tail = [r for r in sizes if r["n_from"] < least]
    once, twice = (sum(r["types"] for r in sizes if r["n_from"] == k) for k in (1, 2))
    discount = once / (once + 2 * twice) if once else 0.5
    total = sum(r["tokens"] for r in sizes)
    rows = counts.filter(F.col("n") >= least).toArrow()  # at most head_size rows
    head = Head(rows["word"].to_numpy().view(np.uint64), rows["n"].to_numpy())
    del rows
    model = Model(head, min(slots, max(1 << 10, total // TOKENS_A_SLOT)), sum(r["tokens"] for r in tail), sum(r["types"] for r in tail), discount, total)
    text = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("part")), F.lit(PARTS)).alias("part"))
    text = {own: fewer_tasks(text.filter((F.col("part") == 0) == own).select("text"), 8, 1 if own else 2) for own in (True, False)}
    schema = "block int, sums binary"

    def count(own: bool) -> None:
        sums = text[own].mapInArrow(_slot_counts(sent), schema)
        found = sums.repartition(max(1, min(64, model.slots // BLOCK)), "block").mapInArrow(_summed, schema).toArrow()  # at most slots / BLOCK rows
        for block, x in zip(found["block"].to_pylist(), found["sums"]):
            every[block : block + BLOCK] += np.frombuffer(x.as_buffer(), np.float32).reshape(-1, ARITY)

    sent, every = context.broadcast(model), np.zeros((model.slots, ARITY), np.float32)
    count(False)
    if steps:
        model.weights, model.bins = model.ratios(every), bins_of(every)
        learning = context.broadcast(model)
        for _ in range(steps):
            slope = text[True].mapInArrow(_gradient(learning, model.scale), schema).repartition(8).mapInArrow(_added, schema).collect()  # at most 8 rows
            first, second = sum(np.frombuffer(r["sums"], np.float64) for r in slope).reshape(2, *model.scale.shape)
            model.scale = np.clip(model.scale + 0.6 * first / (second + 20), 0, 1.5)
        learning.unpersist()
    model.weights = model.bins = None
    count(True)
    sent.unpersist()
    model.finish(every)
    return model, least


def _score(broadcast, types: int):
    def run(batches):
        model = broadcast.value
        base = np.log10((model.head.counts + 0.1) / (model.total + 0.1 * (types + 1)))
        for b in batches:
            data, offsets = text_buffer(b.column(1))
            for i, j in pieces(offsets, PIECE):
                words, at = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                score, leaves = model.log10(words, at)
                known = leaves < len(model.head.words)
                base_sum = np.zeros(len(words))
                base_sum[known] = base[leaves[known]]
                add = lambda x: np.add.reduceat(x, at[:-1])  # noqa: E731  every document has its END
                rare = words[~known].view(np.int64)
                rare_at = np.concatenate([[0], np.cumsum(add((~known).astype(np.int64)))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(np.diff(at)), pa.array(add(known.astype(np.int64))), pa.array(add(base_sum)), pa.array(add(score)), pa.ListArray.from_arrays(pa.array(rare_at), pa.array(rare))],
                    ["doc_id", "n_tokens", "n_head", "base_head", "score_head", "rare"],
                )

    return run


def score_documents(docs: DataFrame, folds: int = 10, head_size: int = HEAD, steps: int = STEPS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null text is empty (its only token is the end); a null doc_id is a training
    row; repeated rows count and are scored each. Without training texts every
    token is unknown.
    """
    with bounded_batches(docs.sparkSession):
        return _score_documents(docs, folds, head_size, steps)


def _score_documents(docs: DataFrame, folds: int, head_size: int, steps: int) -> DataFrame:
    spark = docs.sparkSession
    training = docs.filter(~held_out(F.col("doc_id"), folds))
    counts = count_words(training)
    model, least = train(training, counts, head_size, steps)
    types = counts.count()
    sent = spark.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    scored = slim.mapInArrow(_score(sent, types), f"doc_id {kind}, n_tokens bigint, n_head bigint, base_head double, score_head double, rare array<bigint>")
    scored = saved(scored.withColumn("row", F.monotonically_increasing_id()))
    rare = scored.select("row", F.explode("rare").alias("word")).join(counts.filter(F.col("n") < least), "word", "left")
    floor = model.total + 0.1 * (types + 1)
    base = F.log10((F.coalesce("n", F.lit(0)) + 0.1) / F.lit(floor))
    inside = F.log10(F.coalesce(F.col("n") - F.lit(model.discount), F.lit(model.discount * model.tail_types + 1.0)) / F.lit(model.tail_tokens + 1.0))
    sums = rare.groupBy("row").agg(F.count("n").alias("n_rare"), F.sum(base).alias("base_rare"), F.sum(inside).alias("score_rare"))
    out = scored.drop("rare").join(sums, "row", "left")
    whole = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return out.select(
        "doc_id",
        held_out(F.col("doc_id"), folds).alias("held_out"),
        "n_tokens",
        whole("n_head", "n_rare").alias("n_known"),
        F.lit(model.total).cast("bigint").alias("train_tokens"),
        whole("base_head", "base_rare").alias("base_score"),
        whole("score_head", "score_rare").alias("score"),
    )
