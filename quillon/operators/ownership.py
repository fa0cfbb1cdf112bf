"""Which vehicle owns a plate (JN5, JN6, JN9, JN20, AG5 to AG9, AG24, AG25, AG29, DT7, SS6, FI7, FI8, FI10).

Plates of one frame that overlap form conflict groups. In video the best owner
takes a group, and a track keeps one plate a frame. In images, vehicles and groups
are assigned one to one, with a score that may use each vehicle's history.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillon.config import ImageOwnership, VideoOwnership
from quillon.functions import geometry as g
from quillon.functions import scores
from quillon.operators.assign import matched, spread


def conflict_edges(df: DataFrame, keys: list[str], index: str, conflict_iou: float, overlap_smaller: float, differ: str | None = None, plate: str = "plate") -> DataFrame:
    """JN5 (any pair) or JN6 (pairs that differ in ``differ``): (keys, a, b) with a < b."""
    side = lambda n: df.select(*keys, F.col(index).alias(n), F.col(plate).alias(f"_{n}"), *([F.col(differ).alias(f"_d{n}")] if differ else []))
    touch = (g.iou(F.col("_a"), F.col("_b")) >= conflict_iou) | (g.over_smaller(F.col("_a"), F.col("_b")) >= overlap_smaller)
    both = side("a").join(side("b"), keys).filter((F.col("a") < F.col("b")) & touch)
    if differ:
        both = both.filter(F.col("_da") != F.col("_db"))
    return both.select(*keys, "a", "b")


def components(nodes: DataFrame, edges: DataFrame, keys: list[str], index: str) -> DataFrame:
    """AG5: ``nodes`` with `component`, the smallest index that edges reach within the keys.

    A frame's edges are folded over a map from member to label; frames are small.
    """
    listed = edges.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("_edges"))
    members = F.array_sort(F.array_distinct(F.flatten(F.transform("_edges", lambda e: F.array(e["a"], e["b"])))))
    start = F.transform(members, lambda m: F.struct(m.alias("m"), m.alias("l")))

    def relabel(labels: Column, e: Column) -> Column:
        of = lambda m: F.filter(labels, lambda x: x["m"] == m)[0]["l"]
        return F.transform(labels, lambda x: F.struct(x["m"].alias("m"), F.when(x["l"] == F.greatest(of(e["a"]), of(e["b"])), F.least(of(e["a"]), of(e["b"]))).otherwise(x["l"]).alias("l")))

    labels = listed.select(*keys, F.explode(F.aggregate("_edges", start, relabel)).alias("_l")).select(*keys, F.col("_l.m").alias(index), F.col("_l.l").alias("component"))
    return nodes.join(labels, [*keys, index], "left").withColumn("component", F.coalesce("component", index))


def video_ownership(df: DataFrame, keys: list[str], c: VideoOwnership = VideoOwnership()) -> DataFrame:
    """DT7: every candidate with ownership_status, ownership_score and conflict_group (its smallest member; null without conflict).

    Rows have candidate_index, track_id, plate and vehicle boxes, their confidences
    and coordinate_clamped.
    """
    rows = df.withColumn("ownership_score", scores.video_owner(F.col("plate"), F.col("vehicle"), F.col("plate_confidence"), F.col("vehicle_confidence")))
    ok = ~F.coalesce("coordinate_clamped", F.lit(False)) & g.valid(F.col("plate")) & g.inside(F.col("plate"), F.col("vehicle"))
    rows = rows.withColumn("_ok", ok)
    edges = conflict_edges(rows.filter("_ok"), keys, "candidate_index", c.conflict_iou, c.overlap_smaller, "track_id")
    rows = components(rows, edges, keys, "candidate_index")
    group = Window.partitionBy(*keys, "component")
    owner = F.max_by("track_id", F.struct("ownership_score", "plate_confidence", "vehicle_confidence", -F.col("track_id"))).over(group)
    several = F.min("track_id").over(group) != F.max("track_id").over(group)
    rows = rows.withColumn("conflict_group", F.when(F.col("_ok") & several, F.col("component"))).withColumn("_owner", owner)
    first = F.when(~F.col("_ok"), "rejected_outside_vehicle").when(F.col("track_id") == F.col("_owner"), "selected").otherwise("rejected_conflict")
    rows = rows.withColumn("_first", first)
    own = Window.partitionBy(*keys, "track_id", "_first").orderBy(F.desc("ownership_score"), F.desc("plate_confidence"), "candidate_index")
    status = F.when((F.col("_first") == "selected") & (F.row_number().over(own) > 1), "rejected_same_track").otherwise(F.col("_first"))
    return rows.withColumn("ownership_status", status).drop("_ok", "_owner", "_first", "component")


def image_scores(df: DataFrame, keys: list[str], c: ImageOwnership = ImageOwnership()) -> DataFrame:
    """FI7, PR14, AG24, MA6: valid candidates with geometry, conflict component and the owner score of a first frame.

    Without history every temporal score is the cold start's, which is what single images have.
    """
    rows = df.filter(g.valid(F.col("plate")) & g.valid(F.col("vehicle")) & g.centre_inside(F.col("plate"), F.col("vehicle")))
    rows = rows.withColumn("geometry", g.relative(F.col("plate"), F.col("vehicle"))).withColumn("containment", g.over_first(F.col("plate"), F.col("vehicle")))
    rows = components(rows, conflict_edges(rows, keys, "candidate_index", c.conflict_iou, c.overlap_smaller), keys, "candidate_index")
    group = Window.partitionBy(*keys, "component")
    largest = F.max("geometry.area").over(group)
    tight = F.when(F.count("*").over(group) == 1, 1.0).otherwise(g.clamp(F.col("geometry.area") / largest, 0.0, 1.0))
    rows = rows.withColumn("tight_parent", tight).withColumn("group_size", F.count("*").over(group))
    score = scores.image_owner(F.lit(c.cold_start), F.col("tight_parent"), F.col("containment"), F.col("plate_confidence"), F.col("vehicle_confidence"), c)
    legacy = F.max_by("vehicle_index", F.struct("containment", "plate_confidence", "vehicle_confidence", -F.col("vehicle_index"))).over(group)
    return rows.withColumn("owner_score", score).withColumn("legacy_owner", legacy)


def definite_groups(df: DataFrame, keys: list[str], c: ImageOwnership = ImageOwnership()) -> DataFrame:
    """AG6: (keys, component, definite) of groups of two or more: does any pair overlap by the definite threshold?"""
    side = lambda n: df.select(*keys, "component", F.col("candidate_index").alias(n), F.col("plate").alias(f"_{n}"))
    both = side("a").join(side("b"), [*keys, "component"]).filter("a < b")
    return both.groupBy(*keys, "component").agg(F.bool_or(g.iou(F.col("_a"), F.col("_b")) >= c.definite_iou).alias("definite"))


def same_track_conflicts(df: DataFrame, keys: list[str]) -> DataFrame:
    """AG25: vehicles that more than one group is offered to."""
    return df.groupBy(*keys, "vehicle_index").agg(F.countDistinct("component").alias("n_groups")).filter("n_groups > 1")


class History:
    """SS6, SS7: per vehicle the last accepted geometries; scores new ones by their distance from the median."""

    def __init__(self, c: ImageOwnership):
        self.c, self.of = c, {}

    def score(self, vehicle: int, geometry: np.ndarray) -> tuple[float, int, bool]:
        """(temporal score, samples, rejected as an outlier); AG22."""
        past = self.of.get(vehicle, [])
        if len(past) < self.c.min_samples:
            return self.c.cold_start, len(past), False
        values = np.array(past)
        middle = np.median(values, axis=0)
        scale = np.maximum(1.4826 * np.median(np.abs(values - middle), axis=0), np.maximum(self.c.least_scale, self.c.tolerance))
        score = float(np.exp(-np.mean(np.abs(geometry - middle) / scale)))
        last = values[-1]
        small, large = np.minimum(geometry[2:], last[2:]), np.maximum(geometry[2:], last[2:])
        grown = np.where(small > 0, large / np.where(small > 0, small, 1), np.inf).max()
        jump = float(np.hypot(*(geometry[:2] - last[:2])))
        return score, len(past), score < self.c.min_temporal or jump > self.c.max_jump or grown > self.c.max_size_ratio

    def add(self, vehicle: int, geometry: np.ndarray) -> None:
        self.of[vehicle] = [*self.of.get(vehicle, []), geometry][-self.c.history_size :]

    def keep(self, vehicles) -> None:
        self.of = {v: x for v, x in self.of.items() if v in set(vehicles)}


def _overlaps_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """IoU of boxes, and their common part over the smaller one."""
    area = lambda x: np.maximum(x[..., 2] - x[..., 0], 0) * np.maximum(x[..., 3] - x[..., 1], 0)
    cut = np.maximum(np.minimum(a[..., 2:], b[..., 2:]) - np.maximum(a[..., :2], b[..., :2]), 0)
    both = cut[..., 0] * cut[..., 1]
    union, small = area(a) + area(b) - both, np.minimum(area(a), area(b))
    return np.where(union > 0, both / np.where(union > 0, union, 1), 0), np.where(small > 0, both / np.where(small > 0, small, 1), 0)


def _overlaps(boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _overlaps_of(boxes[:, None], boxes[None])


def _measured(plate: np.ndarray, vehicle: np.ndarray) -> tuple[np.ndarray, ...]:
    """Validity, geometry and area relative to the vehicle, and containment of each row."""
    size = vehicle[:, 2:] - vehicle[:, :2]
    middle = (plate[:, :2] + plate[:, 2:]) / 2
    ok = (plate[:, 2:] > plate[:, :2]).all(axis=1) & (size > 0).all(axis=1) & ((middle >= vehicle[:, :2]) & (middle <= vehicle[:, 2:])).all(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        geometry = np.hstack([(middle - vehicle[:, :2]) / size, (plate[:, 2:] - plate[:, :2]) / size])
        area = np.prod(plate[:, 2:] - plate[:, :2], axis=1) / np.prod(size, axis=1)  # a ratio of areas, as `relative` has it
    contained = np.zeros(len(plate))
    cut = np.maximum(np.minimum(plate[:, 2:], vehicle[:, 2:]) - np.maximum(plate[:, :2], vehicle[:, :2]), 0)
    contained[ok] = ((cut[:, 0] * cut[:, 1])[ok]) / np.prod(plate[ok, 2:] - plate[ok, :2], axis=1)
    return ok, geometry, area, contained


def _score(temporal, tight, contained, confidence, vehicle_confidence, c: ImageOwnership):
    return c.temporal_weight * temporal + c.tight_weight * tight + c.containment_weight * contained + c.plate_weight * np.clip(confidence, 0, 1) + c.vehicle_weight * np.clip(vehicle_confidence, 0, 1)


def _chosen(frame: np.ndarray, owner: np.ndarray, group: np.ndarray, rank: list[np.ndarray], live: np.ndarray, score: np.ndarray, c: ImageOwnership) -> np.ndarray:
    """The live rows that the assignment of vehicles to groups picks; an edge is the best row of a vehicle and group. ``rank``: further ranks after the score."""
    order = live[np.lexsort([live, *[-x[live] for x in reversed(rank)], -score[live], group[live], owner[live], frame[live]])]
    new = np.ones(len(order), bool)
    new[1:] = (frame[order][1:] != frame[order][:-1]) | (owner[order][1:] != owner[order][:-1]) | (group[order][1:] != group[order][:-1])
    cost = 1 - score[order]
    edge = order[new & np.isfinite(cost) & (cost <= c.cost_limit)]
    return edge[matched(frame[edge], owner[edge], group[edge], 1 - score[edge], 1 - c.cost_limit - score[edge] - 1e-6, c.cost_limit)]


def resolve_first(start: np.ndarray, plate: np.ndarray, vehicle: np.ndarray, owner: np.ndarray, confidence: np.ndarray, vehicle_confidence: np.ndarray, c: ImageOwnership) -> tuple[np.ndarray, ...]:
    """As `resolve_frame`, for the first frames of many sources at once; frame k has the rows from start[k] to start[k + 1], all numbers finite."""
    n, ok, _, area, contained = len(plate), *_measured(plate, vehicle)
    frame = np.repeat(np.arange(len(start) - 1), np.diff(start))
    live = np.flatnonzero(ok)
    # all pairs of live rows of a frame
    last = np.cumsum(np.bincount(frame[live], minlength=len(start) - 1))[frame[live]]
    later = last - np.arange(len(live)) - 1
    first = np.repeat(np.arange(len(live)), later)
    second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(later) - later, later)
    first, second = live[first], live[second]
    iou, part = _overlaps_of(plate[first], plate[second])
    touch = (iou >= c.conflict_iou) | (part >= c.overlap_smaller)
    first, second = first[touch], second[touch]
    group = np.arange(n)
    while True:  # the smallest member of each component
        low, now = np.minimum(group[first], group[second]), group.copy()
        np.minimum.at(now, first, low), np.minimum.at(now, second, low)
        now = now[now]
        if (now == group).all():
            break
        group = now
    sizes = np.bincount(group[live], minlength=n)
    temporal = np.where(ok, c.cold_start, 0.0)
    largest = np.zeros(n)
    np.maximum.at(largest, group[live], area[live])
    tight, score = np.zeros(n), np.zeros(n)
    tight[live] = np.where(sizes[group[live]] == 1, 1.0, np.clip(area[live] / largest[group[live]], 0, 1))
    score[live] = _score(temporal[live], tight[live], contained[live], confidence[live], vehicle_confidence[live], c)
    picked = _chosen(frame, owner, group, [temporal, tight, confidence, vehicle_confidence], live, score, c)
    chosen, rest = np.zeros(n, bool), ok.copy()
    chosen[picked], rest[picked] = True, False
    by = np.lexsort((owner, frame))
    new = np.ones(n, bool)
    new[1:] = (frame[by][1:] != frame[by][:-1]) | (owner[by][1:] != owner[by][:-1])
    own = np.empty(n, np.int64)
    own[by] = np.cumsum(new) - 1
    by_group, by_owner = np.full(n, -np.inf), np.full(n, -np.inf)
    np.maximum.at(by_group, group[rest], score[rest]), np.maximum.at(by_owner, own[rest], score[rest])
    updated = chosen & (score - np.maximum(by_group[group], by_owner[own]) >= c.update_margin)
    conflict = np.where(ok & (sizes[group] > 1), group - start[frame], -1)
    return ok, temporal, np.zeros(n, int), np.zeros(n, bool), tight, contained, score, conflict, chosen, updated


def resolve_frame(plate: np.ndarray, vehicle: np.ndarray, owner: np.ndarray, confidence: np.ndarray, vehicle_confidence: np.ndarray, history: History) -> tuple[np.ndarray, ...]:
    """One frame's candidates, in order: the columns that RESOLVED names (a conflict group is -1 without conflict)."""
    c = history.c
    ok, geometry, area, contained = _measured(plate, vehicle)
    n = len(plate)
    temporal, samples, outlier = np.zeros(n), np.zeros(n, int), np.zeros(n, bool)
    for i in np.flatnonzero(ok):
        temporal[i], samples[i], outlier[i] = history.score(int(owner[i]), geometry[i])
    live = np.flatnonzero(ok & ~outlier)
    iou, part = _overlaps(plate)
    group = np.arange(n)
    for i in live:
        for j in live:
            if i < j and (iou[i, j] >= c.conflict_iou or part[i, j] >= c.overlap_smaller):
                a, b = sorted((group[i], group[j]))
                group[group == b] = a
    tight, score = np.zeros(n), np.zeros(n)
    for i in live:
        own = live[group[live] == group[i]]
        tight[i] = 1.0 if len(own) == 1 else np.clip(area[i] / area[own].max(), 0, 1)
        score[i] = _score(temporal[i], tight[i], contained[i], confidence[i], vehicle_confidence[i], c)
    chosen = _chosen(np.zeros(n, int), owner, group, [temporal, tight, confidence, vehicle_confidence], live, score, c).tolist()
    updated, margin = np.zeros(n, bool), np.full(n, np.inf)
    for i in chosen:
        rivals = [j for j in live if j not in chosen and (owner[j] == owner[i] or group[j] == group[i])]
        margin[i] = score[i] - max(score[rivals]) if rivals else np.inf
        if margin[i] >= c.update_margin:
            history.add(int(owner[i]), geometry[i])
            updated[i] = True
    sizes = np.bincount(group[live], minlength=n)
    conflict = np.where(np.isin(np.arange(n), live) & (sizes[group] > 1), group, -1)
    return ok, temporal, samples, outlier, tight, contained, score, conflict, np.isin(np.arange(n), chosen), updated


RESOLVED = "valid boolean, temporal_score double, history_samples int, rejected_by_history boolean, tight_parent double, containment double, owner_score double, conflict_group int, selected boolean, history_updated boolean"


#: Rows of a source's only frame up to which it is resolved together with those of other sources.
FEW = 64


def image_ownership(df: DataFrame, source: str = "source_id", frame: str = "frame_index", c: ImageOwnership = ImageOwnership()) -> DataFrame:
    """SS6, JN9, JN20: all frames of a source in order, with its vehicles' histories.

    Rows have candidate_index, vehicle_index, plate and vehicle boxes and their
    confidences. Sources spread over the cluster and stream through a task in
    batches; a source is sequential by nature. Sources of a single frame need no
    history and are resolved together.
    """
    fields = StructType.fromDDL(RESOLVED).fields
    kinds = {"boolean": pa.bool_(), "double": pa.float64(), "int": pa.int32()}
    made = [(f.name, kinds[f.dataType.simpleString()]) for f in fields]

    def codes(column: pa.ChunkedArray) -> np.ndarray:
        return column.combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)

    def number(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
        return np.asarray(column.cast(pa.float64()).to_pandas(), float)

    def sides(column: pa.ChunkedArray) -> np.ndarray:
        box = column.combine_chunks()
        parts = dict(zip((f.name for f in box.type), box.flatten()))
        return np.column_stack([number(parts[s]) for s in g.SIDES])

    def run(batches):
        at, history, held = None, None, None

        def through(table: pa.Table, after) -> pa.Table:
            """The rows of ``table`` (whole frames) resolved; ``after``: the source of the row that follows, if any."""
            nonlocal at, history
            own, times = codes(table.column(source)), codes(table.column(frame))
            n = table.num_rows
            new_source = np.flatnonzero(np.diff(own, prepend=-1))
            cuts = np.flatnonzero((np.diff(own, prepend=-1) != 0) | (np.diff(times, prepend=-1) != 0))
            ends = np.append(cuts[1:], n)
            first, last = np.isin(cuts, new_source), np.isin(ends, np.append(new_source, n))
            # the first source may have begun before, the last one may go on
            if history is not None and table.column(source)[0].as_py() == at:
                first[0] = False
            if after is not None and table.column(source)[n - 1].as_py() == after[0]:
                last[-1] = False
            plate, vehicle = sides(table.column("plate")), sides(table.column("vehicle"))
            owner = table.column("vehicle_index").to_numpy()
            confidence, other = number(table.column("plate_confidence")), number(table.column("vehicle_confidence"))
            plain = np.isfinite(plate).all(axis=1) & np.isfinite(vehicle).all(axis=1) & np.isfinite(confidence) & np.isfinite(other)
            plain &= np.full(n, table.column("vehicle_index").null_count == 0)
            alone = first & last & (ends - cuts <= FEW) & np.logical_and.reduceat(plain, cuts) & (c.min_samples > 0)
            out = [np.zeros(n, bool if t == pa.bool_() else float if t == pa.float64() else int) for _, t in made]
            rows = np.repeat(alone, ends - cuts)
            if alone.any():
                start = np.concatenate([[0], np.cumsum((ends - cuts)[alone])])
                for x, y in zip(out, resolve_first(start, plate[rows], vehicle[rows], owner[rows], confidence[rows], other[rows], c)):
                    x[rows] = y
            for k in np.flatnonzero(~alone):
                i, j = cuts[k], ends[k]
                if first[k]:
                    history = History(c)
                for x, y in zip(out, resolve_frame(plate[i:j], vehicle[i:j], owner[i:j], confidence[i:j], other[i:j], history)):
                    x[i:j] = y
            if alone[-1]:
                history = History(c)
            at = table.column(source)[n - 1].as_py()
            for (name, kind), x in zip(made, out):
                table = table.append_column(name, pa.array(x, kind, mask=x < 0 if name == "conflict_group" else None))
            return table

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            # the last frame may go on in the next batch
            own, times = codes(table.column(source)), codes(table.column(frame))
            cut = table.num_rows - int(np.argmin(np.append(((own == own[-1]) & (times == times[-1]))[::-1], False)))
            held = table.slice(cut)
            if cut:
                yield from through(table.slice(0, cut), (held.column(source)[0].as_py(),)).combine_chunks().to_batches()
        if held is not None:
            yield from through(held, None).combine_chunks().to_batches()

    return spread(df, source).sortWithinPartitions(source, frame, "candidate_index").mapInArrow(run, StructType([*df.schema.fields, *fields]))


def resolution_stats(resolved: DataFrame, keys: list[str]) -> DataFrame:
    """AG29: counts per frame."""
    n = lambda e: F.count_if(F.expr(e))
    return resolved.groupBy(*keys).agg(
        F.count("*").alias("raw_candidates"),
        n("not valid").alias("invalid_candidates"),
        F.countDistinct("conflict_group").alias("conflict_groups"),
        n("valid and not rejected_by_history and not selected").alias("removed_conflict_candidates"),
        n("selected").alias("final_results"),
        n("history_updated").alias("history_updates"),
        n("rejected_by_history").alias("temporal_outliers_rejected"),
    )


def rolling_history(df: DataFrame, keys: list[str], frame: str, value: str, c: ImageOwnership = ImageOwnership()) -> DataFrame:
    """AG22, WI5, WI9: for a history that takes every row: samples, median and scaled deviation of the last rows, and the one before."""
    past = Window.partitionBy(*keys).orderBy(frame).rowsBetween(-c.history_size, -1)
    rows = df.withColumn("_past", F.array_sort(F.collect_list(value).over(past)))
    middle = lambda a: (F.element_at(a, F.floor((F.size(a) + 1) / 2).cast("int")) + F.element_at(a, F.floor(F.size(a) / 2).cast("int") + 1)) / 2
    rows = rows.withColumn("samples", F.size("_past")).withColumn("median", F.when(F.col("samples") >= c.min_samples, middle(F.col("_past"))))
    rows = rows.withColumn("mad", middle(F.array_sort(F.transform("_past", lambda v: F.abs(v - F.col("median"))))))
    rows = rows.withColumn("mad", F.when(F.col("samples") >= c.min_samples, F.col("mad")))
    return rows.withColumn("previous", F.lag(value).over(Window.partitionBy(*keys).orderBy(frame))).drop("_past")
