"""SimHash near-duplicates, found by covering locality-sensitive hashing.

A table for each covering mask (see covering) has a bucket for each value of the
fingerprint's masked bits, so every pair within the radius shares a bucket.

Equal fingerprints are one class before any table is built. A bucket of two is its
smallest and largest member, so most buckets need only partial aggregates. Larger
buckets are compared in one task up to `PAIRWISE` members; past that members meet
through variants instead: fingerprints that reach one variant, one of them by half
the radius (rounded down) and the others by the rest, lie within the radius and form a star.
No bucket is capped, and none emits its pairs: links are spanning stars.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import near_copies
from quillon.llm._common import saved_bounded, sized, small, text_buffer, text_hash
from quillon.llm.components import components
from quillon.llm.covering import RADIUS, masks, signed

SHINGLE = 3
#: Members of a bucket that one task compares with each other.
PAIRWISE = 4096


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """A bit is set if it is set in over half of the shingles' XXH64; no words: 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size).tolist()
    ends = ends.tolist()
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, 42)]
    else:
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :])]
    counts = np.zeros(64, np.int64)
    h = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    for i in range(0, len(h), 1 << 14):
        counts += np.unpackbits(h[i : i + (1 << 14)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed bigint. A null text has no words."""

    def batch(batches):
        for b in batches:
            data, at = text_buffer(b.column(1))
            raw = data.tobytes()
            got = np.array([fingerprint(raw[at[i] : at[i + 1]], shingle) for i in range(b.num_rows)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(got.view(np.int64))], ["doc_id", "text_hash", "fp"])

    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"), text_hash(F.col("text")).alias("text_hash"))
    return slim.mapInArrow(batch, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, text_hash bigint, fp bigint")


def _stars(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``members``: rounds of a seed and all that it reaches."""
    out, free = [], np.ones(len(members), bool)
    unsigned = members.view(np.uint64)
    for i in range(len(members)):
        if free[i]:
            free[i] = False
            queue = [i]
            while queue:
                j = queue.pop()
                rest = np.flatnonzero(free)
                near = rest[np.bitwise_count(unsigned[rest] ^ unsigned[j]) <= radius]
                free[near] = False
                out += [(int(members[k]), int(members[j])) for k in near]
                queue += near.tolist()
    return out


def _bucket_links(radius: int):
    def run(batches):
        for b in batches:
            pairs = []
            for fps in b.column(0):
                pairs += _stars(np.array(fps.as_py(), np.int64), radius)
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

    return run


def _variants(radius: int, kept: list[int]):
    """(table, key, fp) -> variants of fp that differ in bits the table's key leaves free, with `near`: by few bits."""
    half = radius // 2

    def run(batches):
        for b in batches:
            for t in set(b.column(0).to_pylist()):
                rows = b.filter(pa.compute.equal(b.column(0), t))
                free = [i for i in range(64) if not kept[t] >> i & 1]
                flips = [sum(1 << i for i in c) for n in range(radius - half + 1) for c in itertools.combinations(free, n)]
                few = sum(1 for f in flips if bin(f).count("1") <= half)
                fps = rows.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
                for j in range(0, len(fps), 256):
                    part = fps[j : j + 256]
                    made = (part[:, None] ^ np.array(flips, np.uint64)[None, :]).ravel()
                    near = np.tile(np.arange(len(flips)) < few, len(part))
                    yield pa.RecordBatch.from_arrays([pa.array(made.view(np.int64)), pa.array(np.repeat(part, len(flips)).view(np.int64)), pa.array(near)], ["v", "fp", "near"])

    return run


def links(fps: DataFrame, radius: int = RADIUS, pairwise: int = PAIRWISE) -> DataFrame:
    """(a, b): links that connect all distinct ``fp`` within ``radius`` bits of each other, directly or through others."""
    kept = masks(radius)
    rows = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in kept])).alias("t", "k"))
    buckets = sized(rows.groupBy("t", "k").agg(F.count("*").alias("n"), F.min("fp").alias("x"), F.max("fp").alias("y")).filter("n > 1"))
    two = buckets.filter((F.col("n") == 2) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= radius)).select(F.col("x").alias("a"), F.col("y").alias("b"))
    many = rows.join(small(buckets.filter("n > 2").select("t", "k", "n")), ["t", "k"])
    few = many.filter(F.col("n") <= pairwise).groupBy("t", "k").agg(F.collect_set("fp").alias("fps"))  # at most `pairwise` members
    few = few.select("fps").mapInArrow(_bucket_links(radius), "a bigint, b bigint")
    out = two.unionByName(few)
    if buckets.filter(F.col("n") > pairwise).limit(1).count():
        large = many.filter(F.col("n") > pairwise).select("t", "k", "fp").mapInArrow(_variants(radius, kept), "v bigint, fp bigint, near boolean")
        hub = large.filter("near").groupBy("v").agg(F.min("fp").alias("a"))
        out = out.unionByName(large.join(hub, "v").select("a", F.col("fp").alias("b")).filter("a != b"))
    return out


def _grouped(docs: DataFrame, shingle: int, radius: int, pairwise: int) -> DataFrame:
    """As near_duplicates, with component: the smallest fingerprint of the document's component, its own name."""
    prints = saved_bounded(fingerprints(docs, shingle))
    classes = sized(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    named = components(links(classes, radius, pairwise))
    named = classes.join(small(named.withColumnRenamed("node", "fp")), "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    lowest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.join(lowest, "component").select("fp", "component", "component_id")
    out = prints.join(small(named), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_hash", "component")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, pairwise: int = PAIRWISE) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id (the smallest doc_id it is linked to, itself included).

    Null and empty texts have fingerprint zero and are linked to each other like
    any others. A null doc_id is its component's name only if no other member has
    one. Repeated rows stay repeated. An empty table gives an empty result.
    """
    return _grouped(docs, shingle, radius, pairwise).drop("component")


def one_of_each_class(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The documents of which each component of fingerprints keeps one: that with the smallest doc_id, all columns.

    Of rows that repeat this doc_id one stays: that with the smallest text hash,
    and of rows equal in that too, one. Groups with equal or null doc_ids stay apart.
    """
    return near_copies.one_of_each(docs, _grouped(docs, shingle, radius, PAIRWISE))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents of which each group of near copies keeps one: SimHash candidates, then exact five-word similarity (see near_copies)."""
    return near_copies.deduplicated(docs)
