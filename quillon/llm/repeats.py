"""Removal of long repeated byte strings, by suffix arrays of shards of the corpus.

A window is a string of `length` bytes that starts somewhere in a text. Its class
is the smallest hash among its `GRAM`-byte strings, so equal windows are in one
class, and neighbouring windows of one class form a stretch: a piece of text that
holds all of them. Only stretches whose class has a second stretch, or that hold
their smallest hash twice, can hold a repeat; of these

* equal stretches (by hash) need no sorting: all their windows repeat;
* different stretches of a class go, one of each, to one shard; the shard's suffix
  array and its permuted common prefixes tell which windows repeat;
* a class with more than `CLASS_BYTES` of different stretches is no shard's: its
  windows' 128-bit hashes are counted instead, with partial aggregates.

So no window is missed and none is sent twice. Matches never cross documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm._common import _BASE, _INVERSE, bounded_batches, mixed, pieces, powers, prefix_hash, saved, saved_bounded, small, text_buffer, text_hash
from quillon.llm.suffix_array import permuted_prefixes, suffix_array

LENGTH, GRAM = 400, 64
#: Windows of a stretch at most; a longer run of one class is split.
STRETCH = 1024
SHARD_BYTES = 2 << 20
CLASS_BYTES = 4 << 20
#: Never occurs in UTF-8.
SEPARATOR = 0xFF


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all stretches of ``width`` values."""
    m, have = x, 1
    while 2 * have <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return m if have == width else np.minimum(m[: len(x) - width + 1], m[width - have :])


def stretches(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Document, start, windows and class of all stretches of a piece, and whether one holds its class's hash twice."""
    size = np.diff(offsets)
    docs = np.flatnonzero(size >= length)
    if not len(docs):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, bool))
    prefix = prefix_hash(data)
    n = len(data) - gram + 1
    grams = mixed((prefix[gram:] - prefix[:-gram]) * powers(_INVERSE, n)[:n])
    width = length - gram + 1
    low = _sliding_min(grams, width)
    new = np.ones(len(low), bool)
    new[1:] = low[1:] != low[:-1]
    mark = np.zeros(len(low) + 1, np.int8)
    mark[offsets[docs]] += 1
    mark[offsets[docs + 1] - length + 1] -= 1
    inside = np.cumsum(mark[:-1]).astype(bool)
    new[offsets[docs]] = True
    starts = np.flatnonzero(new & inside)
    owner = np.searchsorted(offsets, starts, "right") - 1
    ends = np.minimum(np.concatenate([starts[1:], [len(low)]]), offsets[owner + 1] - length + 1)
    parts = -(-(ends - starts) // STRETCH)
    if parts.max(initial=1) > 1:
        index = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, ends, owner = np.repeat(starts, parts) + index * STRETCH, np.repeat(ends, parts), np.repeat(owner, parts)
        ends = np.minimum(ends, starts + STRETCH)
    # The places that are the smallest of some window: those whose hash is the largest minimum of the windows over them.
    edge = np.zeros(width - 1, np.uint64)
    least = np.flatnonzero(~_sliding_min(~np.concatenate([edge, low, edge]), width) == grams)
    first, last = np.searchsorted(least, starts), np.searchsorted(least, ends + width - 1)
    times = last - first
    each = np.repeat(np.arange(len(starts)), times)
    at = np.arange(int(times.sum())) + np.repeat(first - (np.cumsum(times) - times), times)
    held = np.bincount(each[grams[least[at]] == low[starts][each]], minlength=len(starts))
    return owner, starts - offsets[owner], ends - starts, low[starts], held > 1


def _start(place: Column) -> Column:
    return F.shiftright(place, 12)


def _windows(place: Column) -> Column:
    return F.shiftright(place, 1).bitwiseAND(F.lit(2047))


def _packed(batches):
    """Texts in zstd: what a join on documents shuffles, so that it is less than the input."""
    for b in batches:
        data, offsets = text_buffer(b.column(2))
        raw, press = data.tobytes(), zstandard.ZstdCompressor(level=1)
        z = [press.compress(raw[x:y]) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(z, pa.binary())], ["doc_id", "text_hash", "z"])


def _joined(docs: DataFrame, more: DataFrame, column: str, how: str) -> DataFrame:
    """(doc_id, z, ``column``): documents, packed, with what ``more`` (doc_id, text_hash, ``column``) has for them."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    z = docs.mapInArrow(_packed, f"doc_id {kind}, text_hash bigint, z binary")
    right = more.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), column)
    return z.join(right, z["doc_id"].eqNullSafe(right["_id"]) & (z["text_hash"] == right["_hash"]), how).select("doc_id", "text_hash", "z", column)


def _stretch_table(length: int, gram: int):
    def run(batches):
        for b in batches:
            data, offsets = text_buffer(b.column(2))
            for i, j in pieces(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                owner, start, windows, low, own = stretches(part, at, length, gram)
                raw = part.tobytes()
                first = (at[owner] + start).tolist()
                last = (at[owner] + start + windows + length - 1).tolist()
                made = b"".join([hashlib.blake2b(raw[x:y], digest_size=8).digest() for x, y in zip(first, last)])
                take = pa.array(owner + i)
                place = (start << 12) | (windows << 1) | own
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), pa.array(low.view(np.int64)), pa.array(np.frombuffer(made, np.int64)), pa.array(place)],
                    ["doc_id", "text_hash", "class", "print", "place"],
                )

    return run


def _cut(length: int):
    """(doc_id, text_hash, z, wanted stretches) -> a row with the bytes of each."""

    def run(batches):
        for b in batches:
            unpack = zstandard.ZstdDecompressor()
            out = {k: [] for k in ("row", "place", "class", "print", "whole", "bytes")}
            for i, (z, wanted) in enumerate(zip(b.column(2), b.column(3))):
                text = unpack.decompress(z.as_py())
                for w in wanted.as_py():
                    at = w["place"] >> 12
                    out["row"].append(i)
                    out["bytes"].append(text[at : at + (w["place"] >> 1 & 2047) + length - 1])
                    for k in ("place", "class", "print", "whole"):
                        out[k].append(w[k])
            take = pa.array(out["row"], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), pa.array([p >> 12 for p in out["place"]], pa.int32()), pa.array(out["class"], pa.int64()), pa.array(out["print"], pa.int64()), pa.array(out["whole"], pa.bool_()), pa.array(out["bytes"], pa.binary())],
                ["doc_id", "text_hash", "start", "class", "print", "whole", "bytes"],
            )

    return run


def repeated(texts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each text the ranges [from, to) of starts whose next ``length`` bytes occur once more, in any of the texts."""
    data = np.frombuffer(bytes([SEPARATOR]).join([*texts, b""]), np.uint8)
    order = suffix_array(data)
    before, common = permuted_prefixes(data, order)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(size + 1) - 1
    begin = ends - size
    far = np.flatnonzero(common >= length)
    twice = np.zeros(len(data) + 1, np.int8)
    twice[far] = 1
    twice[before[far]] = 1
    fits = np.zeros(len(data) + 1, np.int8)
    ok = size >= length
    fits[begin[ok]] += 1
    fits[ends[ok] - length + 1] -= 1
    twice &= np.cumsum(fits).astype(np.int8)
    edge = np.diff(twice, prepend=0)
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    for k, x, y in zip((np.searchsorted(ends, a)).tolist(), a.tolist(), b.tolist()):
        out[k].append((x - int(begin[k]), y - int(begin[k])))
    return out


_RANGES = "doc_id {kind}, text_hash bigint, a int, b int"


def _sort_shard(length: int):
    def run(shard: pa.Table) -> pa.Table:
        keys = list(zip(shard["class"].to_pylist(), shard["print"].to_pylist()))
        one = list({k: i for i, k in enumerate(keys)}.values())  # repeated rows bring a stretch more than once
        shard = shard.take(pa.array(one, pa.int64()))
        texts, whole, start = shard["bytes"].to_pylist(), shard["whole"].to_pylist(), shard["start"].to_pylist()
        row, a, b = [], [], []
        for i, ranges in enumerate(repeated(texts, length)):
            if not whole[i]:
                for x, y in ranges:
                    row.append(i), a.append(start[i] + x), b.append(start[i] + y)
        take = pa.array(row, pa.int64())
        return pa.table([shard["doc_id"].take(take), shard["text_hash"].take(take), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["doc_id", "text_hash", "a", "b"])

    return run


def _window_hashes(length: int):
    """(doc_id, text_hash, start, whole, bytes) -> a row with the hash of each window."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                text, start = b.column(4)[i].as_py(), b.column(2)[i].as_py()
                n = len(text) - length + 1
                data = np.frombuffer(text, np.uint8)
                x = prefix_hash(data)
                h1 = mixed((x[length:] - x[:-length]) * powers(_INVERSE, n)[:n]).view(np.int64)
                other = pow(_BASE, 3, 1 << 64)
                y = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(7)) * powers(other, len(data))[: len(data)])])
                h2 = mixed((y[length:] - y[:-length]) * powers(pow(other, -1, 1 << 64), n)[:n]).view(np.int64)
                same = pa.array(np.zeros(n, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, 1).take(same), b.column(1).slice(i, 1).take(same), pa.array(np.arange(start, start + n, dtype=np.int32)), b.column(3).slice(i, 1).take(same), pa.array(h1), pa.array(h2)],
                    ["doc_id", "text_hash", "a", "whole", "h1", "h2"],
                )

    return run


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, class_bytes: int = CLASS_BYTES) -> DataFrame:
    """(doc_id, text_hash, a, b): ranges of starts of repeated windows, which may touch or repeat."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select("doc_id", text_hash(F.col("text")).alias("text_hash"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    table = saved_bounded(slim.mapInArrow(_stretch_table(length, gram), f"doc_id {kind}, text_hash bigint, class bigint, print bigint, place bigint"))
    several = (F.count("*") == 1) | (F.min("print") != F.max("print"))
    own = F.max(F.col("place").bitwiseAND(F.lit(1))) == 1
    classes = table.groupBy("class").agg(F.count("*").alias("n"), several.alias("mixed"), own.alias("own")).filter("n > 1 or own").select("class", "mixed")
    shared = table.join(classes, "class")
    where = F.min(F.struct("doc_id", "text_hash", "place")).alias("w")
    prints = saved(shared.groupBy("class", "print").agg(F.count("*").alias("n"), F.first("mixed").alias("mixed"), where))
    equal = prints.filter("n > 1").select("class", "print")
    start = _start(F.col("place")).cast("int")
    whole = table.join(equal, ["class", "print"]).select("doc_id", "text_hash", start.alias("a"), (start + _windows(F.col("place")).cast("int")).alias("b"))
    one = prints.filter("mixed").select("class", "print", (F.col("n") > 1).alias("whole"), "w.*")
    sizes = one.groupBy("class").agg(F.sum(_windows(F.col("place")) + length).alias("size"))
    total = sizes.agg(F.sum("size"), F.max("size")).first()
    if total[0] is None:
        return whole
    wanted = one.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("place", "class", "print", "whole")).alias("wanted"))  # at most the document's
    cut = _joined(slim, wanted, "wanted", "inner").mapInArrow(_cut(length), f"doc_id {kind}, text_hash bigint, start int, class bigint, print bigint, whole boolean, bytes binary")
    # a class of half a shard or more is a shard of its own, so that few of them never meet in one task
    hot = total[1] > class_bytes
    cut = cut.join(small(sizes.filter(F.col("size") > shard_bytes // 2)), "class", "left")
    if hot:
        cut = saved(cut)
    normal = cut.filter(F.coalesce(F.col("size") <= class_bytes, F.lit(True))) if hot else cut
    shard = F.pmod(F.xxhash64("class"), F.lit(max(1, -(-int(total[0]) // shard_bytes))))
    normal = normal.select(F.when(F.col("size").isNotNull(), F.col("class")).alias("own"), F.when(F.col("size").isNull(), shard).alias("shard"), "doc_id", "text_hash", "start", "class", "print", "whole", "bytes")
    out = whole.unionByName(normal.groupBy("own", "shard").applyInArrow(_sort_shard(length), _RANGES.format(kind=kind)))
    if hot:
        rows = cut.filter(F.col("size") > class_bytes).dropDuplicates(["class", "print"]).select("doc_id", "text_hash", "start", "whole", "bytes")
        hashed = rows.mapInArrow(_window_hashes(length), f"doc_id {kind}, text_hash bigint, a int, whole boolean, h1 bigint, h2 bigint")
        twice = hashed.groupBy("h1", "h2").count().filter("count > 1").drop("count")
        hashed = hashed.join(twice, ["h1", "h2"]).filter("not whole").select("doc_id", "text_hash", "a", F.expr("a + 1").alias("b"))
        out = out.unionByName(hashed)
    return out


def _digest(length: int, keep_text: bool):
    def run(batches):
        for b in batches:
            unpack = zstandard.ZstdDecompressor()
            size, removed, count, kept, texts = [], [], [], [], []
            for z, ranges in zip(b.column(2), b.column(3)):
                text, ranges, at = unpack.decompress(z.as_py()), ranges.as_py(), 0
                runs, gone, left = 0, 0, []
                if ranges:
                    end = -1
                    for r in sorted((r["a"], r["b"]) for r in ranges):
                        x, y = r[0], r[1] - 1 + length
                        if x > end:
                            runs += 1
                            left.append(text[at:x])
                            gone += y - x
                            at = end = y
                        elif y > end:
                            gone += y - end
                            at = end = y
                left.append(text[at:])
                rest = b"".join(left)
                size.append(len(text)), removed.append(gone), count.append(runs), kept.append(hashlib.sha256(rest).hexdigest())
                if keep_text:
                    texts.append(rest.decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.string()), *([pa.array(texts, pa.string())] if keep_text else [])],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_text"] if keep_text else [])],
            )

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_text: bool = False, **sizes) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept_text.

    Every byte is removed that a ``length``-byte string covers which also starts
    anywhere else. A null text is empty; texts below ``length`` bytes stay whole;
    repeated rows are copies of each other. kept_text leaves out the rests of
    characters that a removed run cuts.
    """
    with bounded_batches(docs.sparkSession):
        return _remove_repeats(docs, length, keep_text, sizes)


def _remove_repeats(docs: DataFrame, length: int, keep_text: bool, sizes: dict) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    ranges = spans(docs, length, **sizes).distinct().groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))  # at most the document's
    slim = docs.select("doc_id", text_hash(F.col("text")).alias("text_hash"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    both = _joined(slim, ranges, "ranges", "left")
    return saved(both.mapInArrow(_digest(length, keep_text), f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept_text string" * keep_text))


SQL = f"""with d as (select doc_id, row_number() over () as r, encode(coalesce(text, '')) as b from documents),
  w as (select r, i, md5(b[i + 1:i + {LENGTH}]) as h from (select r, b, unnest(range(0, octet_length(b) - {LENGTH - 1})) as i from d)),
  twice as (select r, i from (select r, i, count(*) over (partition by h) as n from w) where n > 1),
  run as (select r, i, sum(new) over (partition by r order by i) as k from (select r, i, case when i > lag(i) over (partition by r order by i) + {LENGTH} then 1 else 0 end as new from twice)),
  gone as (select r, min(i) as a, max(i) + {LENGTH} as z from run group by r, k),
  cut as (select r, z as a from gone union all select r, 0 from d),
  kept as (select cut.r, cut.a, coalesce(min(gone.a), octet_length(any_value(b))) as z, any_value(b) as b from cut join d using (r) left join gone on gone.r = cut.r and gone.a >= cut.a group by cut.r, cut.a),
  rest as (select r, sha256(unhex(string_agg(hex(b[a + 1:z]), '' order by a))) as kept_sha256 from kept group by r)
  select doc_id, octet_length(b) as n_bytes, coalesce((select sum(z - a) from gone where gone.r = d.r), 0)::bigint as n_removed, (select count(*) from gone where gone.r = d.r) as n_spans, kept_sha256 from d join rest using (r)"""
