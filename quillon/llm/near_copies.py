"""Near copies for the pipeline: SimHash candidates by covering masks, then exact similarity.

Two texts are near copies if the sets of their five-word shingles have a Jaccard
similarity of 4/5 or more. Candidates come from SimHash: a text has `PRINTS`
independent fingerprints of its single words, in which a word that occurs c times
weighs 1 + ln c, and two texts are candidates if one of their fingerprints differs
in `RADIUS` bits or fewer. Every such pair shares a bucket of the covering masks
(see simhash), so no candidate is missed; single words change little between near
copies, and several fingerprints make up for the noise of one.

Equal sets are one class before any bucket is built, and equal fingerprints of one
kind are one member of it, however many classes have them. Candidates are checked
in three steps, each of which leaves out what earlier steps have joined:

* each class with the smallest of its fingerprints' and buckets' smallest classes;
* all other classes with the smallest of theirs;
* in buckets that still hold several components, classes of different components:
  up to `PAIRS` members as pairs, more by blocks of members, each two of which
  meet in one task unless both are of one component.

No bucket is capped, no group is collected into one task, and none emits its pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._common import LOWER, NOT_SPACE, bounded_batches, free_name, mixed, pieces, prefix_hash, same_text, saved, saved_bounded, sized, small, span_hash, text_buffer, text_hash, word_spans
from quillon.llm.components import components
from quillon.llm.covering import RADIUS, masks, signed

WORDS = 5
#: Fingerprints of a text.
PRINTS = 8
#: Members of a bucket whose pairs are formed, and members of a block beyond that.
PAIRS, BLOCK = 16, 512
#: Bits of a set's parity bitmap.
BITS = 512
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def hashed_words(data: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words, of the runs of ``size`` words that they begin, and the n + 1 word offsets of the texts."""
    data = LOWER[data]
    starts, ends, at = word_spans(data, offsets, NOT_SPACE)
    words = span_hash(prefix_hash(data), starts, ends)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    runs = np.zeros(len(words), np.uint64)
    for k in range(size):
        runs = runs * _FACTOR + padded[k : k + len(words)]
    return words, mixed(runs), at


def shingle_set(words: np.ndarray, runs: np.ndarray, size: int = WORDS) -> np.ndarray:
    """The sorted set of a text's runs of ``size`` words; all words of a shorter text are one."""
    if len(words) >= size:
        return np.unique(runs[: len(words) - size + 1])
    whole = np.uint64(len(words))
    for w in words:
        whole = whole * _FACTOR + w
    return mixed(np.array([whole], np.uint64)) if len(words) else words


def bitmap(x: np.ndarray) -> np.ndarray:
    """`BITS` parities of the numbers of elements that fall on each bit: sets differ in as many elements at least as their bitmaps in bits."""
    odd = np.bincount((x & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.uint64)


def word_prints(words: np.ndarray, number: int = PRINTS) -> np.ndarray:
    """``number`` fingerprints: a bit is 1 if it is set in words of over half of the weight. No words: zeros."""
    distinct, counts = np.unique(words, return_counts=True)
    weights = np.rint(16 + 16 * np.log(counts)).astype(np.float32)
    sums = np.zeros(64 * number)
    for i in range(0, len(distinct), 4096):  # sums of whole numbers below 2**24 are exact
        part = distinct[i : i + 4096]
        bits = np.empty((len(part), number), np.uint64)
        for k in range(number):
            bits[:, k] = mixed(part * _FACTOR + np.uint64(k + 1))
        sums += weights[i : i + 4096] @ np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little").astype(np.float32)
    return np.packbits(2 * sums > weights.sum(dtype=np.float64), bitorder="little").view(np.uint64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64)))


def _each(b: pa.RecordBatch, column: int, size: int):
    """Row, word hashes and shingle set of every text of a batch, by pieces."""
    data, at = text_buffer(b.column(column))
    for i, j in pieces(at):
        with np.errstate(over="ignore"):
            words, runs, first = hashed_words(data[at[i] : at[j]], at[i : j + 1] - at[i], size)
            for row, x, y in zip(range(i, j), first[:-1].tolist(), first[1:].tolist()):
                yield row, words[x:y], shingle_set(words[x:y], runs[x:y], size)


def described(docs: DataFrame, size: int = WORDS, prints: int = PRINTS) -> DataFrame:
    """doc_id, text_hash, cls (a hash of the shingle set), size (of the set), its bitmap and the fingerprints. A null text has no words."""

    def batch(batches):
        for b in batches:
            cls, sizes, bits, fps = [], [], [], []
            for _, words, held in _each(b, 2, size):
                cls.append(hashlib.blake2b(held.tobytes(), digest_size=8).digest())
                sizes.append(len(held)), bits.append(bitmap(held)), fps.append(word_prints(words, prints))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.frombuffer(b"".join(cls), np.int64)), pa.array(sizes, pa.int32()), _lists(bits), _lists(fps)], ["doc_id", "text_hash", "cls", "size", "bits", "fps"])

    slim = docs.select("doc_id", text_hash(F.col("text")).alias("text_hash"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(batch, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, text_hash bigint, cls bigint, size int, bits array<bigint>, fps array<bigint>")


def shingles(docs: DataFrame, made: DataFrame, wanted: DataFrame, size: int = WORDS) -> DataFrame:
    """(cls, shingles) of the ``wanted`` classes, each from one of its documents."""

    def batch(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _lists([held for _, _, held in _each(b, 1, size)])], ["cls", "shingles"])

    one = made.join(small(wanted.select("cls").distinct()), "cls", "left_semi").groupBy("cls").agg(F.min(F.struct("doc_id", "text_hash")).alias("x")).select("cls", "x.*")
    plain = docs.select("doc_id", "text")
    texts = same_text(plain, small(one), "inner", "cls").select("cls", F.col("text").cast("string").alias("text"))
    with bounded_batches(docs.sparkSession):
        return sized(texts.mapInArrow(batch, "cls bigint, shingles array<bigint>").dropDuplicates(["cls"]), 1 << 13)


def _ends(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """``pairs`` with the ``columns`` of both classes, named _a and _b."""
    pairs = small(pairs)
    a, b = (table.select(F.col("cls").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in columns)).join(pairs, end) for end in ("a", "b"))
    return a.join(b, ["a", "b"])


def possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of the ``pairs`` (a, b) that their sets' sizes and bitmaps allow to be near copies."""
    differ = F.expr("aggregate(zip_with(bits_a, bits_b, (x, y) -> bit_count(x ^ y)), 0, (s, n) -> s + n)")
    alike = 5 * F.least("size_a", "size_b") >= 4 * F.greatest("size_a", "size_b")
    return sized(_ends(pairs, classes, "size", "bits").filter(alike & (9 * differ <= F.col("size_a") + F.col("size_b"))).select("a", "b"))


def checked(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """Those of the ``pairs`` whose sets have a Jaccard similarity of 4/5 or more."""
    both = _ends(pairs, held, "shingles")
    return sized(both.filter(9 * F.size(F.array_intersect("shingles_a", "shingles_b")) >= 4 * (F.size("shingles_a") + F.size("shingles_b"))).select("a", "b"))


def buckets(classes: DataFrame, radius: int = RADIUS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs (a, b), members (key, n, s, fp) of buckets of three classes or more, and their classes (s, fp, cls).

    Equal fingerprints of one kind (s) are one member, which stands for all of its
    classes and is named after the smallest; those of three classes or more are a
    bucket too. Pairs are each fingerprint's smallest class with its others, and each
    bucket's smallest name with its other names.
    """
    kept = masks(radius)
    each = classes.select("cls", F.posexplode("fps").alias("s", "fp"))
    prints = sized(each.groupBy("s", "fp").agg(F.count("*").alias("c"), F.min("cls").alias("name")))
    keys = F.array(*[F.xxhash64(F.col("s") * len(kept) + t, F.col("fp").bitwiseAND(F.lit(signed(m)))) for t, m in enumerate(kept)])
    rows = prints.select("s", "fp", "c", "name", F.explode(keys).alias("key"))
    found = sized(rows.groupBy("key").agg(F.sum("c").alias("n"), F.min("name").alias("lo"), F.max("name").alias("hi"), F.bit_xor("fp").alias("differ")).filter("lo != hi"))
    two = found.filter((F.col("n") == 2) & (F.bit_count("differ") <= radius)).select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    many = sized(rows.join(small(found.filter("n > 2").select("key", "n", "lo")), "key"))
    hubs = small(many.filter("name = lo").select("key", F.col("fp").alias("hub")))
    stars = many.filter("name != lo").join(hubs, "key").filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("hub"))) <= radius).select(F.col("lo").alias("a"), F.col("name").alias("b"))
    equal = each.join(small(prints.filter("c > 1").select("s", "fp", "name")), ["s", "fp"]).filter("cls != name").select(F.col("name").alias("a"), F.col("cls").alias("b"))
    own = prints.filter("c > 2").select(F.xxhash64(F.lit("equal"), "s", "fp").alias("key"), F.col("c").alias("n"), "s", "fp")
    many = many.select("key", "n", "s", "fp").union(own)
    held = each.join(small(many.select("s", "fp").distinct()), ["s", "fp"], "left_semi").select("s", "fp", "cls")
    return two.union(stars).union(equal).distinct(), many, held


def spanning(names: np.ndarray, labels: np.ndarray, held: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect what the labels leave apart: each set is compared with all that its component doesn't hold yet."""
    size = np.array([len(x) for x in held], np.int64)
    bits = np.stack([bitmap(x.astype(np.uint64)) for x in held])
    label = np.unique(labels, return_inverse=True)[1]
    inside, seen = np.zeros(len(held), bool), np.zeros(len(held), bool)  # inside: by label
    rest, left, out = np.arange(len(held)), bits, []  # what no component holds yet

    def take(found: np.ndarray) -> list[int]:
        nonlocal rest, left
        inside[label[found]] = True
        stay = ~inside[label[rest]]
        new = rest[~stay]
        rest, left = rest[stay], left[stay]
        return new[~seen[new]].tolist()

    while len(rest):
        queue = take(rest[:1])
        while queue and len(rest):
            j = queue.pop()
            seen[j] = True
            differ = np.bitwise_count(left ^ bits[j]).sum(axis=1, dtype=np.int64)
            maybe = rest[9 * differ <= size[rest] + size[j]]
            near = np.array([k for k in maybe if 9 * len(np.intersect1d(held[k], held[j], assume_unique=True)) >= 4 * (size[k] + size[j])], np.int64)
            if len(near):
                out += [(int(names[k]), int(names[j])) for k in near]
                queue += take(near)
    return out


def _compare(table: pa.Table) -> pa.Table:
    names, labels = (table.column(c).to_numpy() for c in ("cls", "label"))
    found = spanning(names, labels, [x.values.to_numpy(zero_copy_only=False) for x in table.column("shingles")])
    return pa.table({"a": pa.array([p[0] for p in found], pa.int64()), "b": pa.array([p[1] for p in found], pa.int64())})


def blocks(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """(meet, i, j, cls, label): ``members`` (meet, cls, label) of every two blocks of a group that could hold a new link.

    A component of ``block`` members or more has blocks of its own; the others
    share blocks. Two blocks of one component are left out.
    """
    count = members.groupBy("meet", "label").agg(F.count("*").alias("c"))
    own = F.col("c") >= block
    shared = count.groupBy("meet").agg(F.coalesce(F.sum(F.when(~own, F.col("c"))), F.lit(0)).alias("rest"))
    count = count.join(shared, "meet").select("meet", "label", F.when(own, F.col("label")).alias("one"), F.ceil(F.when(own, F.col("c")).otherwise(F.col("rest")) / block).alias("parts"))
    dealt = F.pmod(F.xxhash64(F.when(F.col("one").isNull(), F.col("label")).otherwise(F.col("cls"))), F.col("parts"))
    rows = saved(members.join(small(count), ["meet", "label"]).select("meet", "cls", "label", F.xxhash64(F.coalesce("one", F.lit(0)), F.col("one").isNull(), dealt).alias("i"), "one"))
    heads = rows.select("meet", "i", "one").distinct()
    pairs = heads.join(heads.select("meet", F.col("i").alias("j"), F.col("one").alias("other")), "meet").filter("i <= j and not (one <=> other and one is not null)")
    pairs = pairs.select("meet", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("at"))
    return rows.withColumnRenamed("i", "at").select("meet", "at", "cls", "label").join(small(pairs), ["meet", "at"]).drop("at")


def classes_found(docs: DataFrame, made: DataFrame, most: int = PAIRS, block: int = BLOCK) -> DataFrame:
    """(node, component) of the classes that have a near copy; ``made`` is what `described` gave, saved."""
    classes = sized(made.select("cls", "size", "bits", "fps").dropDuplicates(["cls"]))
    stars, many, of_prints = buckets(classes)
    stars = possible(stars, classes)
    held = shingles(docs, made, stars.select(F.explode(F.array("a", "b")).alias("cls")))
    links = checked(stars.groupBy("b").agg(F.min("a").alias("a")), held)
    label = lambda df, end, found: df.join(found.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")), end, "left").withColumn(f"of_{end}", F.coalesce(f"of_{end}", end))
    apart = lambda df, found: label(label(df, "a", found), "b", found).filter("of_a != of_b").select("a", "b")
    links = links.union(checked(apart(stars, small(components(links))), held))
    found = small(components(links))
    tagged = sized(label(of_prints, "cls", found).withColumnRenamed("of_cls", "label"))
    ends = tagged.groupBy("s", "fp").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    open_ = sized(many.join(small(ends), ["s", "fp"]).groupBy("key").agg(F.max("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo != hi"))
    left = many.filter(F.col("n") <= most).join(small(open_.filter(F.col("n") <= most).select("key")), "key", "left_semi").join(tagged, ["s", "fp"])
    few = left.groupBy("key").agg(F.collect_list(F.struct("cls", "label", "fp")).alias("m")).select("m", F.explode("m").alias("x"))  # at most `most` members
    near = f"filter(m, y -> y.cls > x.cls and y.label != x.label and bit_count(y.fp ^ x.fp) <= {RADIUS})"
    pairs = few.select("x", F.explode(F.expr(near)).alias("y")).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct()
    pairs = possible(pairs, classes)
    if pairs.limit(1).count():
        more = checked(pairs, shingles(docs, made, pairs.select(F.explode(F.array("a", "b")).alias("cls"))))
        links = links.union(more)
    large = open_.filter(F.col("n") > most)
    if large.limit(1).count():
        shared = many.join(small(large.select("key", "lo")), "key").select("s", "fp", "lo").distinct()
        meet = components(shared.join(tagged.select("s", "fp", "label").distinct(), ["s", "fp"]).select(F.col("lo").alias("a"), F.col("label").alias("b")))  # components that share a bucket
        members = tagged.select("cls", "label").distinct().join(small(meet.withColumnRenamed("component", "meet")), F.col("label") == F.col("node")).select("meet", "cls", "label")
        dealt = blocks(saved(members), block).join(shingles(docs, made, members), "cls")
        links = links.union(saved(dealt.groupBy("meet", "i", "j").applyInArrow(_compare, "a bigint, b bigint")))
    return components(links)


def one_of_each(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """The rows of ``docs`` of which each group keeps one: that with the smallest doc_id, then text hash; of rows equal in both, one.

    ``grouped`` has doc_id, text_hash and component, the group's own name: groups
    with equal or null doc_ids stay apart.
    """
    best = grouped.groupBy("component", "doc_id", "text_hash").count().groupBy("component").agg(F.min(F.struct("doc_id", "text_hash", "count")).alias("best"))
    best = saved(best.select("best.*"))
    once = same_text(docs, small(best.filter("count = 1")), "left_semi")
    again = best.filter("count > 1")
    if not again.limit(1).count():
        return once
    name = free_name(docs, "_hash")
    repeated = same_text(docs, small(again), "left_semi").withColumn(name, text_hash(F.col("text")))
    return once.unionByName(repeated.dropDuplicates(["doc_id", name]).drop(name))


def grouped(docs: DataFrame, most: int = PAIRS, block: int = BLOCK) -> DataFrame:
    """doc_id, text_hash and component (the smallest class of its group) of each document."""
    made = saved_bounded(described(docs))
    found = small(classes_found(docs, made, most, block))
    return made.select("doc_id", "text_hash", "cls").join(found, F.col("cls") == F.col("node"), "left").select("doc_id", "text_hash", F.coalesce("component", "cls").alias("component"))


def deduplicated(docs: DataFrame, most: int = PAIRS, block: int = BLOCK) -> DataFrame:
    """The documents, all columns, of which each group of near copies keeps one: that with the smallest doc_id.

    Null and empty texts are one group; repeated rows are copies. An empty table
    gives an empty result.
    """
    return one_of_each(docs, grouped(docs, most, block))
