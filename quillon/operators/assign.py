"""One-to-one assignment within groups (JN7, JN8, FI15): a numpy solver, run for each group of an Arrow batch.

The solver is for the small matrices of a frame. A group's rows fit a task, since a
frame's boxes are few; the frames spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillon.functions import geometry as g


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by the keys to twice as many tasks as shuffles have (two a core at least).

    For groups that are few bytes but much work, which adaptive planning would put
    together; a number that differs from that of other shuffles keeps this one.
    """
    spark = df.sparkSession
    return df.repartition(2 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def in_order(df: DataFrame, source: str, frame: str, within: str, start: Callable, schema: str) -> DataFrame:
    """The frames of each source in order, through a state of the source's own: for what is sequential within a source.

    ``start()`` makes a state with .frames(part), which takes the rows of some whole
    frames and returns a list of rows (dicts), and .end(), which returns the rows
    that end the source. Sources spread over the cluster and stream through a task
    in batches, so that neither many small nor one large source is held at once.
    """
    names = [f.name for f in StructType.fromDDL(schema).fields]
    kinds = {f.name: {"int": "Int32", "bigint": "Int64", "boolean": "boolean", "double": "float64"}.get(f.dataType.simpleString()) for f in StructType.fromDDL(schema).fields}

    def made(rows: list[dict]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names)
        for name, kind in kinds.items():
            out[name] = out[name].astype(kind) if kind else out[name].astype(object).where(out[name].notna(), None)
        return out

    def run(batches):
        at, state, held = None, None, None

        def through(pdf: pd.DataFrame) -> list[dict]:
            nonlocal at, state
            rows = []
            codes = pd.factorize(pdf[source], use_na_sentinel=False)[0]
            cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(pdf)] if len(pdf) else []
            for a, b in zip(cuts, cuts[1:]):
                own = pdf[source].iloc[a]
                own = None if pd.isna(own) else own
                if state is None or own != at:
                    rows += finished()
                    at, state = own, start()
                rows += [{source: at, **r} for r in state.frames(pdf.iloc[a:b])]
            return rows

        def finished() -> list[dict]:
            return [] if state is None else [{source: at, **r} for r in state.end()]

        for pdf in batches:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            # the last frame may go on in the next batch
            last = (pdf[frame] == pdf[frame].iloc[-1]) & ((pdf[source] == pdf[source].iloc[-1]) | (pdf[source].isna() & pd.isna(pdf[source].iloc[-1])))
            held, rows = pdf[last], through(pdf[~last])
            if rows:
                yield made(rows)
        if held is not None:
            rows = through(held)
            yield made(rows + finished())

    return spread(df, source).sortWithinPartitions(source, frame, within).mapInPandas(run, schema)


#: More than any real cost.
FORBIDDEN = 1e6


def solve(costs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """JN8: rows and columns of a cheapest assignment of min(rows, columns) pairs."""
    costs = np.asarray(costs, float)
    if costs.ndim != 2:
        raise ValueError("costs must be a matrix")
    if not np.isfinite(costs).all():
        raise ValueError("costs must be finite")
    if costs.shape[0] > costs.shape[1]:
        columns, rows = solve(costs.T)
        order = np.argsort(rows)
        return rows[order], columns[order]
    n, m = costs.shape
    price, owner = np.zeros(m), np.full(m, -1)
    value, column = np.zeros(n), np.full(n, -1)
    for start in range(n):
        # Dijkstra over reduced costs from a free row to the nearest free column
        distance, via = np.full(m, np.inf), np.full(m, -1)
        open_ = np.ones(m, bool)
        row, reached, sink = start, 0.0, -1
        while sink < 0:
            step = reached + costs[row] - value[row] - price
            better = open_ & (step < distance)
            distance[better], via[better] = step[better], row
            near = int(np.argmin(np.where(open_, distance, np.inf)))
            reached = distance[near]
            open_[near] = False
            if owner[near] < 0:
                sink = near
            else:
                row = owner[near]
        closed = ~open_
        closed[sink] = False
        value[start] += reached
        value[owner[closed]] += reached - distance[closed]
        price[closed] -= reached - distance[closed]
        row = -1
        while row != start:  # back along the path, each row changes its column
            row = via[sink]
            owner[sink] = row
            column[row], sink = sink, column[row]
    columns = np.flatnonzero(owner >= 0)
    order = np.argsort(owner[columns])
    return owner[columns][order], columns[order]


def match(costs: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """JN7: the cheapest pairs of at most ``limit``, where leaving a row or a column alone costs half of it, and a little more."""
    if not np.isfinite(limit) or limit < 0:
        raise ValueError("the limit must be finite and not negative")
    n, m = costs.shape
    if not n or not m:
        return []
    ok = np.isfinite(costs) & (costs <= limit)
    if not (ok.sum(axis=0) > 1).any() and not (ok.sum(axis=1) > 1).any():  # no rivals: a pair within the limit beats leaving both alone
        return [(int(r), int(c)) for r, c in np.argwhere(ok)]
    wide = np.zeros((n + m, n + m))
    wide[:n, :m] = np.where(ok, costs, FORBIDDEN)
    alone = (limit + 1e-6) / 2
    wide[:n, m:] = np.where(np.eye(n, dtype=bool), alone, FORBIDDEN)
    wide[n:, :m] = np.where(np.eye(m, dtype=bool), alone, FORBIDDEN)
    return [(int(r), int(c)) for r, c in zip(*solve(wide)) if r < n and c < m and ok[r, c]]


#: Columns up to which `cheapest` keeps the best way for every set of taken columns; larger groups go to the solver.
COLUMNS = 10


def cheapest(rows: list, columns: list, values: list[float]) -> tuple[list[int], float, bool] | None:
    """The edges of one group whose values (costs less what leaving both alone costs) have the least sum, added in order of the rows; the sum; whether another way may have it too.

    For every set of taken columns the least sum so far is kept; adding one value to
    two sums never turns their order, so the result has the least of all sums as
    doubles add up. None for groups of more than `COLUMNS` columns.
    """
    bit = {c: 1 << k for k, c in enumerate(sorted(set(columns)))}
    if len(bit) > COLUMNS:
        return None
    options: dict = {}
    for k, r in enumerate(rows):
        options.setdefault(r, []).append(k)
    best, tied = {0: (0.0, ())}, False
    for r in sorted(options):
        grown: dict = {}
        for used, (total, taken) in best.items():
            for k in options[r]:
                own = bit[columns[k]]
                if not used & own:
                    made, old = total + values[k], grown.get(used | own)
                    tied |= old is not None and made == old[0]
                    if old is None or made < old[0]:
                        grown[used | own] = (made, (*taken, k))
            old = grown.get(used)
            tied |= old is not None and total == old[0]
            if old is None or total < old[0]:
                grown[used] = (total, taken)
        best = grown
    total, taken = min(best.values(), key=lambda x: x[0])
    return list(taken), total, tied or sum(x[0] == total for x in best.values()) > 1


def matched(group: np.ndarray, rows: np.ndarray, columns: np.ndarray, prices: np.ndarray, values: np.ndarray, limit: float) -> np.ndarray:
    """JN7 for many groups: the positions of the matched edges, in order. Edges are those within ``limit``; ``group`` is sorted.

    An edge whose row and column have no other matches. Groups with rivals are
    settled by `cheapest`, or by the solver where they are large; of several ways
    with the least sum the solver's stays, if it is one of them.
    """
    order = np.lexsort((np.arange(len(group)), prices, columns, rows, group))
    g_, r_, c_ = group[order], rows[order], columns[order]
    same = np.zeros(len(order), bool)
    same[1:] = (g_[1:] == g_[:-1]) & (r_[1:] == r_[:-1]) & (c_[1:] == c_[:-1])
    order = order[~same]  # of equal pairs the cheapest stays
    g_, r_, c_ = group[order], rows[order], columns[order]

    def rivals(x: np.ndarray) -> np.ndarray:
        by = np.lexsort((x, g_))
        new = np.ones(len(by), bool)
        new[1:] = (g_[by][1:] != g_[by][:-1]) | (x[by][1:] != x[by][:-1])
        name = np.cumsum(new) - 1
        out = np.empty(len(by), bool)
        out[by] = np.bincount(name)[name] > 1 if len(by) else False
        return out

    open_ = np.unique(g_[rivals(r_) | rivals(c_)])
    hard = np.isin(g_, open_)
    out = [order[~hard]]
    rest = order[hard]
    cuts = np.flatnonzero(np.diff(group[rest], prepend=-1)).tolist() + [len(rest)] if len(rest) else []
    row_list, column_list, value_list = rows[rest].tolist(), columns[rest].tolist(), values[rest].tolist()
    for i, j in zip(cuts, cuts[1:]):
        found = cheapest(row_list[i:j], column_list[i:j], value_list[i:j])
        if found is None or found[2]:
            r, row = np.unique(rows[rest[i:j]], return_inverse=True)
            c, column = np.unique(columns[rest[i:j]], return_inverse=True)
            costs, edge = np.full((len(r), len(c)), np.inf), np.zeros((len(r), len(c)), int)
            costs[row, column], edge[row, column] = prices[rest[i:j]], np.arange(j - i)
            solved = sorted(int(edge[p]) for p in match(costs, limit))
            if found is None or reduce(add, (value_list[i + k] for k in solved), 0.0) == found[1]:  # sum() would compensate
                found = (solved,)
        out.append(rest[i + np.array(found[0], np.int64)])
    return np.sort(np.concatenate(out))


def pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """JN1 to JN4: IoU, distance, class gate and fused cost of all pairs of a group (both have i, class_id, conf and x1..y2)."""
    a = left.select(*keys, F.col("i").alias("a"), F.col("class_id").alias("_ca"), g.box().alias("_a"))
    b = right.select(*keys, F.col("i").alias("b"), F.col("class_id").alias("_cb"), F.col("conf").alias("_p"), g.box().alias("_b"))
    both = a.join(b, keys).withColumn("iou", g.iou(F.col("_a"), F.col("_b")))
    gated = F.when(F.col("_ca") != F.col("_cb"), FORBIDDEN).otherwise(1.0 - F.col("iou"))
    return both.select(*keys, "a", "b", "iou", (1.0 - F.col("iou")).alias("distance"), gated.alias("gated"), (1.0 - F.col("iou") * F.col("_p")).alias("fused"))


def assigned(edges: DataFrame, keys: list[str], limit: float, a: str = "a", b: str = "b", cost: str = "cost") -> DataFrame:
    """JN7 for each group of an edge table (keys, a, b, cost): the matched edges. Pairs that are not listed cannot match.

    Groups come as arrays, many to an Arrow batch. Sums are of cost - limit - 1e-6,
    in order of ``a``; of equal sums see `cheapest`.
    """
    slim = edges.select(*keys, a, b, F.col(cost).cast("double").alias(cost)).filter(F.col(cost) <= limit)
    groups = slim.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(a, b, cost))).alias("_e"))

    def run(batches):
        for batch in batches:
            listed = batch.column(len(keys))
            flat = listed.flatten()
            rows, columns, prices = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(listed.offsets.to_numpy()))
            picked = matched(owner, rows, columns, prices, prices - limit - 1e-6, limit)
            take, edge = pa.array(owner[picked], pa.int64()), pa.array(picked, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(take) for k in range(len(keys))], *[flat.field(k).take(edge) for k in range(3)]], [*keys, a, b, cost])

    return groups.mapInArrow(run, slim.schema)


def unmatched(rows: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """JN17, SO3."""
    return rows.join(matches, keys, "left_anti")


def marked(rows: DataFrame, matches: DataFrame, keys: list[str], eligible: Column) -> DataFrame:
    """FI6: eligible rows without a match are marked, not dropped."""
    hit = matches.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return rows.join(hit, keys, "left").withColumn("status", F.when(F.col("_hit"), "matched").when(eligible, "unmatched_low_confidence").otherwise("not_eligible")).drop("_hit")
