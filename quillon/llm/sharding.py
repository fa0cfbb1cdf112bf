"""Shards from a consistent-hash ring with virtual nodes and bounded loads.

Every row has a place on the ring (a hash of its doc_id); it belongs to the next
virtual node clockwise. A shard takes as many rows as its bound allows; rows that
meet a full shard go on clockwise. The bound is exact: with n rows and k shards,
n mod k shards hold one row more than the others.

Rows on one arc (between neighbouring virtual nodes) meet the same shards in the
same order, so the walk needs only the rows of each arc: shards x virtual nodes
counts, whatever the input's size. Rows are then ranked inside their arc and cut
into the pieces that the walk gave.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm._common import free_name, text_hash

RING = 1 << 31
VIRTUAL = 64
#: Ranges of each arc that are ranked apart.
CELLS = 16


def ring(shards: int, virtual: int = VIRTUAL) -> list[tuple[int, int]]:
    """(place, shard) of every virtual node, clockwise. More shards only add nodes."""
    nodes = {}
    for shard in range(shards):
        for v in range(virtual):
            place = int.from_bytes(hashlib.blake2b(f"{shard}/{v}".encode(), digest_size=4).digest(), "big") % RING
            nodes.setdefault(place, shard)
    return sorted(nodes.items())


def bounds(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def walk(counts: dict[int, int], nodes: list[tuple[int, int]], limits: list[int]) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each arc the pieces (first rank, end rank, shard, first slot) of its rows.

    Each shard first takes its own arcs' rows, in the ring's order; what is left
    over then moves clockwise, arc after arc, to the next shard with room.
    """
    used = [0] * len(limits)
    out: dict[int, list[tuple[int, int, int, int]]] = {a: [] for a in range(len(nodes))}
    rest = {}

    def take(arc: int, at: int, shard: int) -> int:
        n = min(counts.get(arc, 0) - at, limits[shard] - used[shard])
        if n > 0:
            out[arc].append((at, at + n, shard, used[shard]))
            used[shard] += n
        return at + max(n, 0)

    for arc, (_, shard) in enumerate(nodes):
        rest[arc] = take(arc, 0, shard)
    for arc in range(len(nodes)):
        step = 1
        while rest[arc] < counts.get(arc, 0):
            rest[arc] = take(arc, rest[arc], nodes[(arc + step) % len(nodes)][1])
            step += 1
    return out


def ring_place(key: Column) -> Column:
    """A place from 0 to RING - 1. Null keys share one place."""
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit("\x00"))), F.lit(RING))


def assign(rows: DataFrame, key: str, shards: int, virtual: int = VIRTUAL, tie: list[Column] | None = None) -> DataFrame:
    """``rows`` with columns shard and slot (gapless from 0 in each shard).

    ``tie``: columns that order rows with the same key; rows equal in them too
    are interchangeable. An empty table gives an empty result. Columns shard and
    slot of the input, if any, are replaced; all others stay.
    """
    spark = rows.sparkSession
    nodes = ring(shards, virtual)
    places = [p for p, _ in nodes]
    rows = rows.drop("shard", "slot")
    place, low, arc, cell, rank, held, piece = (free_name(rows, c) for c in ("_place", "_low", "_arc", "_cell", "_rank", "_pieces", "_piece"))
    # The arc of a place: binary search in the ring, as one lookup of its high bits and a short scan.
    step = RING >> 12
    first = F.array(*[F.lit(bisect.bisect_left(places, i * step)) for i in range(4096)])
    nearby = max(bisect.bisect_left(places, (i + 1) * step) - bisect.bisect_left(places, i * step) for i in range(4096))
    ends = F.array(*[F.lit(p) for p in places + [RING] * (nearby + 1)])
    placed = rows.withColumn(place, ring_place(F.col(key)))
    placed = placed.withColumn(low, F.element_at(first, (F.col(place) / step).cast("int") + 1))
    past = sum((F.when(F.element_at(ends, F.col(low) + 1 + i) < F.col(place), 1).otherwise(0) for i in range(nearby)), F.lit(0))
    placed = placed.withColumn(arc, F.pmod(F.col(low) + past, F.lit(len(nodes))).cast("int")).drop(low)
    placed = placed.withColumn(cell, F.pmod(F.xxhash64(F.lit("cell"), place, *(tie or [])), F.lit(CELLS)).cast("int"))
    cells = placed.groupBy(F.col(arc).alias("arc"), F.col(cell).alias("cell")).count()
    cells = cells.groupBy("arc").agg(F.array_sort(F.collect_list(F.struct("cell", "count"))).alias("cells")).collect()  # bounded: nodes x CELLS
    counts = {r["arc"]: sum(c["count"] for c in r["cells"]) for r in cells}
    cut = walk(counts, nodes, bounds(sum(counts.values()), shards))
    table = []
    for r in cells:
        before = 0
        for c in r["cells"]:
            end = before + c["count"]
            mine = [(max(a, before) - before, min(b, end) - before, s, slot + max(a, before) - a) for a, b, s, slot in cut[r["arc"]] if a < end and b > before]
            table.append((r["arc"], c["cell"], mine))
            before = end
    pieces = spark.createDataFrame(table, f"{arc} int, {cell} int, {held} array<struct<a:bigint,b:bigint,shard:int,slot:bigint>>")
    order = Window.partitionBy(arc, cell).orderBy(place, F.col(key), *(tie or []))
    ranked = placed.withColumn(rank, F.row_number().over(order) - 1)
    joined = ranked.join(F.broadcast(pieces), [arc, cell])  # at most nodes x CELLS rows
    joined = joined.withColumn(piece, F.filter(held, lambda p: (p["a"] <= F.col(rank)) & (F.col(rank) < p["b"]))[0])
    joined = joined.withColumn("shard", F.col(f"{piece}.shard")).withColumn("slot", (F.col(f"{piece}.slot") + F.col(rank) - F.col(f"{piece}.a")).cast("bigint"))
    return joined.drop(place, arc, cell, rank, held, piece)


def shard_documents(docs: DataFrame, shards: int = 40, virtual: int = VIRTUAL) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A null text has size 16 and checksum 0. Repeated rows each take a slot. The
    law is `rows`: the counts of any two shards differ by one at most, also when
    one text or doc_id makes up much of the table.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id"), (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    out = assign(slim, "doc_id", shards, virtual, tie=[F.col("text_crc32"), F.col("size")])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard_stage(docs: DataFrame, shards: int = 40) -> DataFrame:
    """The documents with their shard and slot."""
    return assign(docs, "doc_id", shards, tie=[text_hash(F.col("text"))])


def write_shards(sharded: DataFrame, folder: str) -> None:
    """The rows of each shard below ``folder``/shard=n, in files whose rows follow their slots; a large shard has several."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
