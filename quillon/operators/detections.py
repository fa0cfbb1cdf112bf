"""Detections of a frame: filters, suppression, validation, reading order (FI1 to FI6, AG1 to AG4, AG18, WI2, WI3).

Everything here groups by a frame (or crop), of which there are many, each with
few boxes; one shuffle on the frame's keys, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.config import VEHICLE_CLASSES, Validation
from quillon.functions import geometry as g


def confident(df: DataFrame, least: float, confidence: str = "conf", classes: tuple[int, ...] | None = None, class_id: str = "class_id") -> DataFrame:
    """FI1 and FI2: inclusive threshold, class membership."""
    keep = F.col(confidence) >= least
    if classes is not None:
        keep &= F.col(class_id).isin(*classes)
    return df.filter(keep)


def suppressed(df: DataFrame, keys: list[str], threshold: float, order: list[Column], inclusive: bool = False) -> DataFrame:
    """AG1 to AG3: greedy suppression within ``keys``: in ``order`` a row stays unless it overlaps one that stayed by more than ``threshold``.

    Rows have x1, y1, x2, y2. ``order`` must decide between all rows of a group.
    """
    row = F.struct(*[F.struct(*order).alias("_order")], F.struct(*[F.col(c) for c in df.columns if c not in keys]).alias("_row"))
    grouped = df.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    overlap = lambda a, b: g.iou(a["_row"], b["_row"])
    over = (lambda a, b: overlap(a, b) >= threshold) if inclusive else (lambda a, b: overlap(a, b) > threshold)
    kept = F.aggregate("_rows", F.slice("_rows", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda y: over(x, y)), acc).otherwise(F.concat(acc, F.array(x))))
    return grouped.select(*keys, F.explode(kept).alias("_kept")).select(*keys, "_kept._row.*").select(*df.columns)


def reasons(b: Column, class_name: Column, confidence: Column, frame_w: Column, frame_h: Column, c: Validation = Validation()) -> Column:
    """FI4: why a detection is rejected, in the rules' order, each reason once."""
    w, h = g.width(b), g.height(b)
    solid = (w > 0) & (h > 0)
    edge = (w / frame_w >= c.wide_ratio) & (b["x1"] <= frame_w * c.wide_margin) & (frame_w - b["x2"] <= frame_w * c.wide_margin)
    rules = [
        (~F.coalesce(class_name.isin(*VEHICLE_CLASSES.values()), F.lit(False)), "unknown_vehicle_class"),
        (confidence < c.min_confidence, "low_confidence"),
        ((b["x1"] < 0) | (b["y1"] < 0) | (b["x2"] > frame_w) | (b["y2"] > frame_h), "bbox_out_of_frame"),
        ((w < c.min_width) | (h < c.min_height), "too_small"),
        (edge & (confidence < c.wide_confidence), "wide_edge_bbox_low_confidence"),
        (solid & (w * h / (frame_w * frame_h) < c.min_area_ratio), "too_small"),
        (solid & ~(w / h).between(c.min_aspect, c.max_aspect), "abnormal_aspect_ratio"),
        (~solid, "invalid_bbox"),
    ]
    return F.array_distinct(F.filter(F.array(*[F.when(rule, F.lit(name)) for rule, name in rules]), lambda x: x.isNotNull()))


def validated(df: DataFrame, keys: list[str], index: str = "i", confidence: str = "conf", c: Validation = Validation()) -> DataFrame:
    """FI4, FI5, AG4: every row with `accepted` and `reasons`; of accepted boxes that overlap, the surest stays.

    Rows have x1..y2, class_name, frame_w and frame_h.
    """
    found = reasons(g.box(), F.col("class_name"), F.col(confidence), F.col("frame_w"), F.col("frame_h"), c)
    rows = df.withColumn("reasons", found)
    row = F.struct((-F.col(confidence)).alias("_less"), F.col(index).alias("_i"), F.struct("x1", "y1", "x2", "y2").alias("_box"))
    good = F.array_sort(F.collect_list(F.when(F.size("reasons") == 0, row)).over(Window.partitionBy(*keys)))
    rows = rows.withColumn("_good", good)
    kept = F.aggregate("_good", F.slice("_good", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda y: g.iou(x["_box"], y["_box"]) >= c.duplicate_iou), acc).otherwise(F.concat(acc, F.array(x))))
    stays = F.exists(kept, lambda x: x["_i"] == F.col(index))
    rows = rows.withColumn("reasons", F.when((F.size("reasons") == 0) & ~stays, F.array(F.lit("duplicate_vehicle_box"))).otherwise(F.col("reasons")))
    return rows.drop("_good").withColumn("accepted", F.size("reasons") == 0)


def reason_counts(df: DataFrame) -> DataFrame:
    """AG18."""
    return df.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def _median(values: Column) -> Column:
    """Of an array: the mean of its two middle values."""
    s, n = F.array_sort(values), F.size(values)
    return (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2).cast("int") + 1)) / 2


def _distances(values: Column, middle: Column) -> Column:
    return F.transform(values, lambda v: F.abs(v - middle))


def split_rows(centres: Column, median_height: Column) -> Column:
    """WI2: how many of the sorted centres form the upper row; null for one row.

    A split needs two characters on either side, a gap between the rows' medians
    that their spread cannot explain, and a gap at the boundary.
    """

    def tried(k: Column) -> Column:
        parts = F.slice(centres, 1, k), F.slice(centres, k + 1, F.size(centres))
        middles = [_median(p) for p in parts]
        spreads = [_median(_distances(p, m)) for p, m in zip(parts, middles)]
        spread, gap = F.greatest(F.lit(1.0), *spreads), middles[1] - middles[0]
        edge = F.element_at(centres, k + 1) - F.element_at(centres, k)
        good = (gap >= F.greatest(0.35 * median_height, 2.0 * spread)) & (edge >= 0.25 * median_height)
        return F.when(good, F.struct((-gap / spread).alias("less"), k.alias("k")))

    found = F.filter(F.transform(F.sequence(F.lit(2), F.greatest(F.size(centres) - 2, F.lit(2))), tried), lambda x: x.isNotNull())
    return F.when(F.size(centres) >= 4, F.array_min(found)["k"])


def reading(df: DataFrame, keys: list[str]) -> DataFrame:
    """WI3, ST13, AG21: per crop its characters' text in reading order, rows, mean confidence.

    Rows have char, confidence and x1..y2. Characters are read row by row, from the left.
    """
    y = ((F.col("y1") + F.col("y2")) / 2).cast("double")
    item = F.struct(y.alias("y"), F.col("x1").alias("x1"), (F.col("x1") + F.col("x2")).alias("x"), F.col("char").alias("char"), F.col("confidence").cast("double").alias("p"), F.greatest(F.lit(1), F.col("y2") - F.col("y1")).cast("double").alias("h"))
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("c"))
    rows = rows.withColumn("_h", F.greatest(F.lit(1.0), _median(F.transform("c", lambda x: x["h"]))))
    rows = rows.withColumn("_k", split_rows(F.transform("c", lambda x: x["y"]), F.col("_h")))
    line = lambda a: F.array_sort(F.transform(a, lambda x: F.struct(x["x"], x["x1"], x["char"].alias("char"), x["p"].alias("p"))))
    lines = F.when(F.col("_k").isNull(), F.array(line(F.col("c")))).otherwise(F.array(line(F.slice("c", F.lit(1), F.col("_k"))), line(F.slice("c", F.col("_k") + 1, F.size("c")))))
    flat = F.flatten(lines)
    mean = F.aggregate(flat, F.lit(0.0), lambda a, x: a + x["p"]) / F.size(flat)
    return rows.select(*keys, F.array_join(F.transform(flat, lambda x: x["char"]), "").alias("text"), F.size(lines).alias("n_rows"), mean.alias("confidence"), F.transform(flat, lambda x: x["p"]).alias("char_confidences"))


def traced(df: DataFrame, least: float, keys: list[str], threshold: float, order: list[Column], confidence: str = "conf") -> DataFrame:
    """UD3: every raw row with its fate: below_confidence, invalid_box, suppressed_nms or final."""
    fate = F.when(~F.coalesce(F.col(confidence) >= least, F.lit(False)), "below_confidence").when(~g.valid(g.box()), "invalid_box")
    rows = df.withColumn("fate", fate)
    kept = suppressed(rows.filter("fate is null"), keys, threshold, order)
    lost = rows.filter("fate is null").select(*keys, *[c for c in df.columns if c not in keys]).exceptAll(kept.select(*keys, *[c for c in df.columns if c not in keys]))
    return (
        rows.filter("fate is not null")
        .unionByName(kept.withColumn("fate", F.lit("final")))
        .unionByName(lost.withColumn("fate", F.lit("suppressed_nms")))
    )
