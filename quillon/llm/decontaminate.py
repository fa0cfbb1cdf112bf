"""Benchmark decontamination with an FM-index of each training shard.

A shard is about a megabyte of documents. Its words become symbols: a number for
each word of the benchmark, none for the others. A phrase of the benchmark can only
stand in a run of numbered words that is long enough, so the shard's text is those
runs, parted by zeros. The FM-index has the suffix order (by doubling), the
last column in a wavelet tree, and every eighth suffix position. All phrases are
searched backward together, step by step, through the tree's ranks; occurrences
are located by walking to a sampled position. A word's spans merge in a difference
array. Words are numbered by a 64-bit hash; an occurrence counts only if its bytes
are the phrase's.

Nothing is shuffled. The benchmark passes the driver as a stream and goes to the
executors in blocks of about `BLOCK_BYTES` of text, each a broadcast of a few flat
arrays. A worker holds one block at a time: it goes through the blocks to and fro,
piece of documents after piece, and drops each block for the next. An index is
built for each block, since symbols are numbered in a block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._common import ALNUM, LOWER, free_name, pieces, prefix_hash, same_text, saved_bounded, small, span_hash, text_buffer, text_hash, word_spans

WINDOW = 13
BLOCK_BYTES = 1 << 20
#: Windows searched together.
TOGETHER = 1 << 15
SAMPLE = 8


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The order of all suffixes of ``symbols`` (a shorter one first), by doubling."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    s = symbols[order]
    rank = np.zeros(n, np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]])) if n else 0
    step = 1
    while n and step < n and int(rank[order[-1]]) < n - 1:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        k = key[order]
        rank[order] = np.cumsum(np.concatenate([[0], k[1:] != k[:-1]]))
        step *= 2
    return order


class WaveletTree:
    """Ranks of the symbols of a sequence, by a bit of the symbol a level, as a matrix of levels."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.bits = bits
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(bits - 1, -1, -1):
            bit = (sequence >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        low = np.zeros_like(at)
        for i, level in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros = self.ones[i], self.zeros[i]
            bit = ((symbol >> level) & 1).astype(bool)
            a, b = ones[low].astype(np.int64), ones[at].astype(np.int64)
            low, at = np.where(bit, zeros + a, low - a), np.where(bit, zeros + b, at - b)
        return at - low


class FMIndex:
    """Backward search over a symbol sequence; symbol 0 parts the runs and is in no phrase."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        order = suffix_order(symbols)
        self.n = len(symbols)
        # the row of the end of the text comes first; its last column is the last symbol
        order = np.concatenate([[self.n], order])
        self.last = np.where(order == 0, 0, symbols[order - 1]) if self.n else np.zeros(1, np.int64)
        self.end_row = int(np.flatnonzero(order == 0)[0])
        self.tree = WaveletTree(self.last, max(1, int(alphabet).bit_length()))
        counts = np.bincount(symbols, minlength=alphabet + 1)
        self.first = np.concatenate([[1], 1 + np.cumsum(counts)])[:-1]
        self.sampled = order % SAMPLE == 0
        self.samples = order[self.sampled]
        self.sample_rank = np.cumsum(self.sampled) - 1

    def step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """From the row of a suffix to that of the suffix one symbol longer; the text's start stands as a 0 in the last column."""
        return self.first[symbol] + self.tree.rank(symbol, row) - ((symbol == 0) & (row > self.end_row))

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row ranges of equally long phrases (one a row of the matrix)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n + 1, np.int64)
        alive = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            s = phrases[alive, j]
            a, b = self.step(s, low[alive]), self.step(s, high[alive])
            low[alive], high[alive] = a, b
            alive = alive[b > a]
            if not len(alive):
                break
        high = np.maximum(high, low)
        dead = np.ones(len(phrases), bool)
        dead[alive] = False
        high[dead] = low[dead]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text positions of rows."""
        at, steps = rows.astype(np.int64).copy(), np.zeros(len(rows), np.int64)
        todo = np.flatnonzero(~self.sampled[at])
        while len(todo):
            at[todo] = self.step(self.last[at[todo]], at[todo])
            steps[todo] += 1
            todo = todo[~self.sampled[at[todo]]]
        return self.samples[self.sample_rank[at]] + steps


class Phrases:
    """A block of benchmark items in flat arrays: their words, their distinct windows and which items hold each."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        data = LOWER[np.frombuffer(b"".join(t for _, t in items), np.uint8)]
        offsets = np.cumsum([0, *[len(t) for _, t in items]])
        starts, ends, at = word_spans(data, offsets, ALNUM)
        hashes = span_hash(prefix_hash(data), starts, ends)
        self.names = [i for i, _ in items]
        self.raw = data.tobytes()
        self.starts, self.ends = starts.astype(np.int32), ends.astype(np.int32)
        self.words = np.unique(hashes)
        self.symbols = (np.searchsorted(self.words, hashes) + 1).astype(np.int32)
        n = np.diff(at)
        size = np.minimum(n, window)
        many = np.where(n > 0, n - size + 1, 0)
        owner = np.repeat(np.arange(len(items)), many)
        first = np.arange(int(many.sum())) + np.repeat(at[:-1] - (np.cumsum(many) - many), many)
        size = size[owner]
        text = lambda i, k: b" ".join(self.raw[x:y] for x, y in zip(starts[i : i + k].tolist(), ends[i : i + k].tolist()))
        digests = np.frombuffer(b"".join(hashlib.blake2b(text(i, k), digest_size=16).digest() for i, k in zip(first.tolist(), size.tolist())), "V16")
        _, one, which = np.unique(digests, return_index=True, return_inverse=True)
        self.first, self.size = first[one].astype(np.int32), size[one].astype(np.int32)
        held = np.unique(which.astype(np.int64) * max(len(items), 1) + owner)
        self.owners = (held % max(len(items), 1)).astype(np.int32)
        self.owned = np.searchsorted(held // max(len(items), 1), np.arange(len(one) + 1)).astype(np.int32)
        self.shortest = int(self.size.min(initial=window + 1)) if len(self.size) else 0

    def equal(self, phrase: int, raw: bytes, starts: np.ndarray, ends: np.ndarray, word: int) -> bool:
        """Whether the document's words from ``word`` on are the phrase's, byte by byte."""
        a, n = int(self.first[phrase]), int(self.size[phrase])
        if raw[starts[word] : ends[word + n - 1]] == self.raw[self.starts[a] : self.ends[a + n - 1]]:
            return True
        return all(raw[starts[word + k] : ends[word + k]] == self.raw[self.starts[a + k] : self.ends[a + k]] for k in range(n))


class Blocks:
    """The broadcast blocks in a worker, of which one is loaded at a time."""

    def __init__(self, sent: list):
        self.sent, self.at, self.loaded = sent, -1, None

    def each(self):
        """All blocks, from the end that was reached last."""
        n = len(self.sent)
        for i in range(n) if self.at < n - 1 or n == 1 else range(n - 1, -1, -1):
            if i != self.at:
                self.loaded = None
                block = self.sent[i]
                self.loaded = block.load_from_path(block._path) if getattr(block, "_path", None) else block.value  # value would be kept
                self.at = i
            yield self.loaded


def _hits(raw: bytes, starts, ends, hashes, at, phrases: Phrases, diff: np.ndarray, pairs: set) -> None:
    """Adds the spans of all occurrences to ``diff`` (over words) and (document, item name) to ``pairs``."""
    if not phrases.shortest or not len(hashes):
        return
    place = np.searchsorted(phrases.words, hashes)
    place[place == len(phrases.words)] = 0
    symbol = np.where(phrases.words[place] == hashes, place + 1, 0)
    doc_start = np.zeros(len(hashes) + 1, bool)
    doc_start[at] = True
    known = symbol > 0
    run_start = known & (doc_start[:-1] | ~np.concatenate([[False], known[:-1]]))
    begins = np.flatnonzero(run_start)
    stops = np.flatnonzero(known & (doc_start[1:] | ~np.concatenate([known[1:], [False]]))) + 1
    long = stops - begins >= phrases.shortest
    begins, stops = begins[long], stops[long]
    if not len(begins):
        return
    size = stops - begins
    out_end = np.cumsum(size + 1)
    text = np.zeros(int(out_end[-1]), np.int64)
    where = np.zeros(int(out_end[-1]), np.int64)
    inside = np.ones(len(text), bool)
    inside[out_end - 1] = False
    where[inside] = np.arange(int(size.sum())) + np.repeat(begins - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    text[inside] = symbol[where[inside]]
    index = FMIndex(text, len(phrases.words))
    for length in np.unique(phrases.size).tolist():
        own = np.flatnonzero(phrases.size == length)
        for k in range(0, len(own), TOGETHER):
            part = own[k : k + TOGETHER]
            low, high = index.search(phrases.symbols[phrases.first[part][:, None] + np.arange(length)].astype(np.int64))
            which = np.flatnonzero(high > low)
            if not len(which):
                continue
            times = (high - low)[which]
            rows = np.arange(int(times.sum())) + np.repeat(low[which] - np.concatenate([[0], np.cumsum(times)[:-1]]), times)
            first = where[index.locate(rows)]
            phrase = np.repeat(part[which], times)
            docs = np.searchsorted(at, first, "right") - 1
            for w, p, d in zip(first.tolist(), phrase.tolist(), docs.tolist()):
                if phrases.equal(p, raw, starts, ends, w):
                    diff[w] += 1
                    diff[w + length] -= 1
                    pairs.update((d, phrases.names[i]) for i in phrases.owners[phrases.owned[p] : phrases.owned[p + 1]].tolist())


def _scan(data: np.ndarray, offsets: np.ndarray, blocks: Blocks) -> list[tuple[int, int, list[str], list[int]]]:
    """n_words, n_hit, item names and [first word, end word, ...] spans of each document."""
    data = LOWER[data]
    starts, ends, at = word_spans(data, offsets, ALNUM)
    hashes = span_hash(prefix_hash(data), starts, ends)
    diff, pairs, raw = np.zeros(len(hashes) + 1, np.int64), set(), data.tobytes()
    for block in blocks.each():
        _hits(raw, starts, ends, hashes, at, block, diff, pairs)
    hit = np.cumsum(diff[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(hit)])
    items: dict[int, list[str]] = {}
    for d, name in pairs:
        items.setdefault(d, []).append(name)
    out = []
    for d in range(len(offsets) - 1):
        a, b = int(at[d]), int(at[d + 1])
        spans = []
        if d in items:
            edge = np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]]))
            for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
                spans += [int(starts[a + s] - offsets[d]), int(ends[a + e - 1] - offsets[d])]
        out.append((b - a, int(total[b] - total[a]), sorted(items.get(d, [])), spans))
    return out


def _blocks(benchmark: DataFrame, window: int) -> list:
    """Broadcasts of the benchmark, each of about BLOCK_BYTES of text or one longer item."""
    context = benchmark.sparkSession.sparkContext
    out, block, size = [], [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        if row[0] is None or row[1] is None:
            continue
        block.append((row[0], row[1].encode()))
        size += len(block[-1][1])
        if size >= BLOCK_BYTES:
            out.append(context.broadcast(Phrases(block, window)))
            block, size = [], 0
    if block:
        out.append(context.broadcast(Phrases(block, window)))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, text_hash, n_words, n_hit, items, spans, contaminated.

    items: the names of the benchmark items of which a window occurs, sorted as
    strings. spans: byte ranges [from, to) of hit words in the text, one array of
    alternating ends. Null texts have no words; null items or item names are left
    out; repeated rows are judged alike; an empty benchmark hits nothing.
    """
    sent = _blocks(benchmark, window)
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"), text_hash(F.col("text")).alias("text_hash"))

    def run(batches):
        blocks = Blocks(sent)
        for b in batches:
            data, offsets = text_buffer(b.column(1))
            for i, j in pieces(offsets):
                got = _scan(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], blocks)
                n, hit = pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), n, hit, pa.array([g[2] for g in got], pa.list_(pa.string())), pa.array([g[3] for g in got], pa.list_(pa.int64()))],
                    ["doc_id", "text_hash", "n_words", "n_hit", "items", "spans"],
                )

    kind = slim.schema["doc_id"].dataType.simpleString()
    out = saved_bounded(slim.mapInArrow(run, f"doc_id {kind}, text_hash bigint, n_words bigint, n_hit bigint, items array<string>, spans array<bigint>"))
    for block in sent:
        block.destroy()
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def digest(found: DataFrame) -> DataFrame:
    listed = F.array_join("items", ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), "contaminated")


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, all columns."""
    return same_text(docs, small(contamination(docs, benchmark, window).filter("contaminated").select("doc_id", "text_hash")), "left_anti")


def cut_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, all columns, without the passages that hit: each span of hit words is taken out of the text."""
    found = contamination(docs, benchmark, window).filter("n_hit > 0").groupBy("doc_id", "text_hash").agg(F.first("spans").alias("spans"))
    both, spans = same_text(docs, found, "left", "spans"), free_name(docs, "spans")
    raw = F.col("text").cast("binary")
    # what lies between spans: from each end to the next start, and the rest
    starts = F.concat(F.array(F.lit(0).cast("bigint")), F.filter(spans, lambda _, i: i % 2 == 1))
    ends = F.concat(F.filter(spans, lambda _, i: i % 2 == 0), F.array(F.octet_length(raw).cast("bigint")))
    pieces_left = F.zip_with(starts, ends, lambda a, b: F.substr(raw, (a + 1).cast("int"), (b - a).cast("int")).cast("string"))
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(F.array_join(pieces_left, ""))
    return both.withColumn("text", text).select(*docs.columns)


SQL = r"""with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
  b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
  bw as (select distinct item_id, size, array_to_string(w[i + 1:i + size], ' ') as t from
    (select item_id, w, least(len(w), 13) as size, unnest(range(0, len(w) - least(len(w), 13) + 1)) as i from b where len(w) > 0)),
  dw as (select doc_id, size, i, array_to_string(w[i + 1:i + size], ' ') as t from
    (select doc_id, w, size, unnest(range(0, len(w) - size + 1)) as i from d cross join (select distinct size from bw) where len(w) >= size)),
  m as (select doc_id, i, size, item_id from dw join bw using (size, t)),
  h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + size)) as p from m) group by doc_id),
  it as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from m) group by doc_id)
  select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
    coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated from d left join h using (doc_id) left join it using (doc_id)"""
