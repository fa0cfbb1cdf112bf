"""A quality classifier: random Fourier features, ridge by normal equations, isotonic calibration.

A text becomes a few dozen statistics of its bytes, words and lines. Their random
Fourier features approximate a Gaussian kernel. The labelled training rows are
summed up, partition by partition, to the normal equations of a ridge regression
(a matrix of the number of features squared, whatever the number of rows). Scores
of the training rows are counted in equal-width bins; pooling adjacent violators
over the bins gives the calibration, which is interpolated between the pools.

Language, source, labels and doc_id are no inputs of a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm._common import NOT_SPACE, fewer_tasks, mixed, pieces, prefix_hash, saved, saved_bounded, span_hash, text_buffer, word_spans

#: Random features, the kernel's width in standard deviations, the ridge, bins of the calibration.
COMPONENTS, WIDTH, RIDGE, BINS = 384, 4.0, 1e-3, 512
STATISTICS = 26
#: Classes of bytes whose shares are statistics.
_GROUPS = [bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), b" ", b"\n", b".", b",", b"!", b"?", b"|", b"#*$%&<>", b"-_/\\:;=+~^@", b"()[]{}\"'`", bytes(range(0x80, 0x100))]
_OF = np.zeros((256, len(_GROUPS)))
for _k, _g in enumerate(_GROUPS):
    _OF[list(_g), _k] = 1


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of statistics for each document."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    histogram = np.bincount(doc * 256 + data, minlength=256 * n).reshape(n, 256)
    chars = np.maximum(size, 1)
    share = histogram @ _OF / chars[:, None]
    p = histogram / chars[:, None]
    entropy = -(p * np.log2(np.maximum(p, 1e-12))).sum(axis=1)
    starts, ends, at = word_spans(data, offsets, NOT_SPACE)
    hashes = span_hash(prefix_hash(data), starts, ends)
    words = np.diff(at)
    owner = np.repeat(np.arange(n), words)
    some = np.maximum(words, 1)
    length = ends - starts
    mean = np.bincount(owner, length, minlength=n) / some
    spread = np.sqrt(np.maximum(np.bincount(owner, length.astype(float) ** 2, minlength=n) / some - mean**2, 0))

    def distinct(keys: np.ndarray, owners: np.ndarray) -> np.ndarray:
        order = np.lexsort((keys, owners))
        k, o = keys[order], owners[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
        return np.bincount(o[new], minlength=n)

    types = distinct(hashes, owner) / some
    three = mixed(hashes[:-2] + hashes[1:-1] * np.uint64(3) + hashes[2:] * np.uint64(7)) if len(hashes) > 2 else hashes[:0]
    inside = owner[:-2] == owner[2:] if len(hashes) > 2 else np.zeros(0, bool)
    grams = np.maximum(words - 2, 1)
    fresh = distinct(three[inside], owner[:-2][inside] if len(hashes) > 2 else owner[:0]) / grams
    same = np.bincount(owner[1:][(hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])], minlength=n) / some if len(hashes) > 1 else np.zeros(n)
    line_spans = word_spans(data, offsets, np.arange(256) != 10)
    lines = np.diff(line_spans[2])
    line_owner = np.repeat(np.arange(n), lines)
    line_types = distinct(span_hash(prefix_hash(data), line_spans[0], line_spans[1]), line_owner) / np.maximum(lines, 1)
    last = data[ends - 1] if len(ends) else data[:0]
    ended = np.bincount(owner, np.isin(last, np.frombuffer(b".,!?%*&$#", np.uint8)), minlength=n) / some
    first = data[starts] if len(starts) else data[:0]
    capital = np.bincount(owner, (first >= 65) & (first <= 90), minlength=n) / some
    out = [np.sqrt(share[:, k]) for k in range(len(_GROUPS))]
    out += [np.log1p(size), np.log1p(words), np.log1p(lines), entropy, mean, np.log1p(spread), types, fresh, np.sqrt(same), line_types, ended, capital]
    return np.stack(out, axis=1)


def _vectors(batches):
    for b in batches:
        data, offsets = text_buffer(b.column(1))
        for i, j in pieces(offsets):
            x = statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]).astype(np.float32)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), flat], ["doc_id", "x"])


class Features:
    """Standardised statistics and their random cosines."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, 1 / np.maximum(deviation, 1e-3)
        self.w = rng.normal(0, 1 / WIDTH, (len(mean), COMPONENTS))
        self.b = rng.uniform(0, 2 * np.pi, COMPONENTS)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) * self.scale, -8, 8)
        return np.concatenate([np.sqrt(2 / COMPONENTS) * np.cos(z @ self.w + self.b), z / 8, np.ones((len(x), 1))], axis=1)


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _normal_sums(features: Features):
    """Of a partition: the sums of z z', z y and 1, as one row."""

    def run(batches):
        n = COMPONENTS + STATISTICS + 1
        total, count = np.zeros((n, n + 1)), 0
        for b in batches:
            if b.num_rows:
                z = features(_matrix(b.column(0)))
                total += z.T @ np.concatenate([z, b.column(1).to_numpy(zero_copy_only=False).astype(float)[:, None]], axis=1)
                count += b.num_rows
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["n", "sums"])

    return run


def _add(batches):
    total, count = 0, 0
    for b in batches:
        for n, s in zip(b.column(0).to_pylist(), b.column(1)):
            total, count = total + np.frombuffer(s.as_py()), count + n
    if count:
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["n", "sums"])


def isotonic(at: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools adjacent violators; the pools' places and values."""
    pools: list[list[float]] = []
    for x, y, w in zip(at, mean, weight):
        pools.append([x * w, y * w, w])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def _scored(features: Features, weights: np.ndarray, calibration):
    def run(batches):
        for b in batches:
            if b.num_rows:
                raw = np.clip(features(_matrix(b.column(1))) @ weights, -0.5, 1.5)
                score = raw if calibration is None else np.clip(np.interp(raw, *calibration), 0, 1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], ["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, target: str = "quality", threshold: float = 0.3, folds: int = 5) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1) and predicted (1 from ``threshold``).

    All labelled rows outside fold 0 are learnt from, whatever their number; a
    row labelled twice counts twice, null labels are left out. Null texts are
    empty and scored like any others. With no usable labels, every score is 0.5.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    vectors = saved_bounded(text.mapInArrow(_vectors, f"doc_id {kind}, x array<float>"))
    given = labels.filter(F.col(target).isNotNull() & ~held_out(F.col("doc_id"), folds)).select("doc_id", F.col(target).cast("double").alias("y"))
    training = saved(vectors.join(given, "doc_id").select("x", "y"))
    moments = training.select(*[F.col("x")[k].cast("double").alias(f"x{k}") for k in range(STATISTICS)])
    row = moments.agg(F.count("*"), *[f(f"x{k}") for f in (F.avg, F.stddev_pop) for k in range(STATISTICS)]).first()
    model, weights, calibration = Features(np.zeros(STATISTICS), np.ones(STATISTICS)), np.zeros(COMPONENTS + STATISTICS + 1), None
    if row[0]:
        model = Features(np.array(row[1 : STATISTICS + 1], float), np.array(row[STATISTICS + 1 :], float))
        sums = fewer_tasks(training).mapInArrow(_normal_sums(model), "n bigint, sums binary")
        parts = sums.repartition(8).mapInArrow(_add, "n bigint, sums binary").collect()  # at most 8 rows of about a megabyte
        total = sum(np.frombuffer(r["sums"]) for r in parts).reshape(len(weights), -1)
        count = sum(r["n"] for r in parts)
        weights = np.linalg.solve(total[:, :-1] / count + RIDGE * np.eye(len(weights)), total[:, -1] / count)
        raw = training.select("y", "x").mapInArrow(_scored(model, weights, None), "doc_id double, score double")
        bins = raw.groupBy(F.floor((F.col("score") + 0.5) / 2 * BINS).alias("bin")).agg(F.count("*").alias("n"), F.avg("doc_id").alias("y"), F.avg("score").alias("at"))
        got = sorted((r["at"], r["y"], r["n"]) for r in bins.collect())  # at most BINS + 1 rows
        at, value = isotonic(*(np.array(c, float) for c in zip(*got)))
        # the ends reach on, so that scores beyond the outermost pools stay ordered
        calibration = (np.concatenate([[-0.51], at, [1.51]]), np.concatenate([[max(0.0, value[0] - 0.01)], value, [min(1.0, value[-1] + 0.01)]]))
    else:
        weights[-1] = 0.5
    out = vectors.mapInArrow(_scored(model, weights, calibration), f"doc_id {kind}, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
