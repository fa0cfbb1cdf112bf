"""Shared pieces of the training-data operators: checkpoints, Arrow text buffers, word hashes."""

from __future__ import annotations

import contextlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task works on at a time; a longer document is a piece of its own.
PIECE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir. Only a local master, as in tests, may leave it unset; it gets a temporary one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quillon-"))
    return context._jsc.sc().getCheckpointDir().get()


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Removes a folder in whatever store its path names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def saved(df: DataFrame) -> DataFrame:
    """``df``, computed once into the shared folder; its lineage ends there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def bounded_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what runs inside, unless the session set fewer.

    Texts are long, and the JVM and the Python worker each hold a batch more than
    once. The session's own value is back afterwards, so what runs inside must be
    saved there.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def saved_bounded(df: DataFrame) -> DataFrame:
    """``df``, saved, computed in bounded Arrow batches."""
    with bounded_batches(df.sparkSession):
        return saved(df)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def same_text(docs: DataFrame, listed: DataFrame, kind: str, *more: str) -> DataFrame:
    """``docs`` joined (``kind``) with the rows of ``listed`` (doc_id, text_hash, ``more``) of the same doc_id and text.

    The names of ``listed`` get a prefix that no column of ``docs`` has; a column of
    ``more`` is found under ``free_name(docs, name)``.
    """
    names = {c: free_name(docs, f"_{c}") for c in ("doc_id", "text_hash")}
    right = listed.select(*(F.col(c).alias(n) for c, n in names.items()), *(F.col(c).alias(free_name(docs, c)) for c in more))
    on = docs["doc_id"].eqNullSafe(right[names["doc_id"]]) & (text_hash(docs["text"]) == right[names["text_hash"]])
    out = docs.join(right, on, kind)
    return out if kind in ("left_semi", "left_anti") else out.drop(*names.values())


def text_hash(text: Column) -> Column:
    """64 bits that tell texts with one doc_id apart; null and empty texts are alike."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``df``, saved, and to be broadcast if it has at most ``rows`` rows; beyond that joins shuffle it."""
    df = saved(df)
    return F.broadcast(df) if df.count() <= rows else df


def sized(df: DataFrame, rows: int = 1 << 16) -> DataFrame:
    """``df``, saved, in one task for every ``rows`` of it (two a core at least), so that small tables aren't many tasks."""
    df = saved(df)
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)))


def fewer_tasks(df: DataFrame, share: int = 8, least: int = 2) -> DataFrame:
    """``df`` in one task for every ``share`` of its partitions (``least`` a core at least): for tasks whose results have a fixed size."""
    context = df.sparkSession.sparkContext
    return df.coalesce(max(least * context.defaultParallelism, df.rdd.getNumPartitions() // share))


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column and its n + 1 offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES):
    """Ranges (first row, end row) of about ``limit`` bytes that together cover every row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


#: Odd multiplier of the polynomial hash modulo 2**64, and its inverse.
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64; kept, and grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.ones(1, np.uint64)
        while len(out) < max(n, 1 << 16):
            out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
        if len(out) > 1 << 23:  # one very long text; not worth keeping
            return out
        _powers[base] = have = out
    return have


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer, so that all bits of a polynomial hash look random."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """n + 1 prefix sums of byte i times base**i."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data))[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mixed((prefix[ends] - prefix[starts]) * powers(_INVERSE, len(prefix))[starts])


def lookup(chars: bytes, complement: bool = False) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return ~out if complement else out


#: Bytes of the words that white space (0x20, 0x09 to 0x0D) parts.
NOT_SPACE = lookup(b"\x20\x09\x0a\x0b\x0c\x0d", complement=True)
#: Bytes of the words made of digits, small letters (A-Z are lower-cased before) and non-ASCII characters.
ALNUM = lookup(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))
#: Lower-cases A to Z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data``, and the n + 1 word offsets of its documents; no word crosses documents."""
    n = len(data)
    w = np.zeros(n + 1, bool)
    w[:n] = inside[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(w[:n] & (cut[:n] | ~np.concatenate([[False], w[: n - 1]]) if n else w[:n]))
    ends = np.flatnonzero(w[:n] & (cut[1:] | ~w[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)
