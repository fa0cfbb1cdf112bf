"""Box geometry as Column expressions. A box is a struct (x1, y1, x2, y2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x1", "y1", "x2", "y2")


def box(x1="x1", y1="y1", x2="x2", y2="y2") -> Column:
    cols = [c if isinstance(c, Column) else F.col(c) for c in (x1, y1, x2, y2)]
    return F.struct(*[c.alias(n) for c, n in zip(cols, SIDES)])


def width(b: Column) -> Column:
    return b["x2"] - b["x1"]


def height(b: Column) -> Column:
    return b["y2"] - b["y1"]


def area(b: Column) -> Column:
    """Zero if a side is not positive."""
    return F.greatest(width(b), F.lit(0)).cast("double") * F.greatest(height(b), F.lit(0))


def valid(b: Column) -> Column:
    """FI3: finite, of positive area. A null side is not valid."""
    finite = F.lit(True)
    for s in SIDES:
        v = b[s].cast("double")
        finite &= ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.coalesce(finite & (b["x2"] > b["x1"]) & (b["y2"] > b["y1"]), F.lit(False))


def centre(b: Column) -> tuple[Column, Column]:
    """MA2."""
    return (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2


def centre_inside(inner: Column, outer: Column) -> Column:
    x, y = centre(inner)
    return x.between(outer["x1"], outer["x2"]) & y.between(outer["y1"], outer["y2"])


def inside(inner: Column, outer: Column) -> Column:
    return (inner["x1"] >= outer["x1"]) & (inner["y1"] >= outer["y1"]) & (inner["x2"] <= outer["x2"]) & (inner["y2"] <= outer["y2"])


def intersection(a: Column, b: Column) -> Column:
    """MA1."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(w, F.lit(0)).cast("double") * F.greatest(h, F.lit(0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; zero if there is no union."""
    i = intersection(a, b)
    union = area(a) + area(b) - i
    return F.when(union > 0, i / union).otherwise(0.0)


def over_first(a: Column, b: Column) -> Column:
    """The share of ``a`` that lies in ``b``."""
    return F.when(area(a) > 0, intersection(a, b) / area(a)).otherwise(0.0)


def over_smaller(a: Column, b: Column) -> Column:
    small = F.least(area(a), area(b))
    return F.when(small > 0, intersection(a, b) / small).otherwise(0.0)


def clamp(x: Column, low, high) -> Column:
    """MA3; null stays null."""
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def clip(b: Column, w: Column, h: Column) -> Column:
    """PR7: towards zero to whole pixels, then into the frame."""
    part = lambda s, top: clamp(b[s].cast("int"), 0, top)
    return box(part("x1", w), part("y1", h), part("x2", w), part("y2", h))


def crop_box(b: Column, w: Column, h: Column) -> Column:
    """PR8: the clipped box, null if nothing is left."""
    c = clip(b, w, h)
    return F.when(valid(c), c)


def exact_crop(b: Column, w: Column, h: Column) -> Column:
    """PR12: the box, null if any side lies outside the frame."""
    return F.when(valid(b) & (b["x1"] >= 0) & (b["y1"] >= 0) & (b["x2"] <= w) & (b["y2"] <= h), b)


def to_global(local: Column, parent: Column, w: Column, h: Column, in_parent: bool) -> Column:
    """PR9 (image: into the frame) or PR10 (video: first into the parent's region)."""
    moved = box(*[local[s] + parent["x1" if s[0] == "x" else "y1"] for s in SIDES])
    if in_parent:
        moved = box(*[clamp(moved[s], parent[f"{s[0]}1"], parent[f"{s[0]}2"]) for s in SIDES])
    return clip(moved, w, h)


def letterbox(w: Column, h: Column, to_w: int, to_h: int) -> Column:
    """PR2: (scale, new_w, new_h, pad_x, pad_y); sizes round halves to even, the smaller pad comes first."""
    scale = F.least(F.lit(to_w) / w, F.lit(to_h) / h)
    new_w, new_h = (F.least(F.lit(t), F.rint(side * scale)).cast("int") for t, side in ((to_w, w), (to_h, h)))
    half = lambda total, used: F.floor((F.lit(total) - used) / 2).cast("int")
    return F.struct(scale.alias("scale"), new_w.alias("new_w"), new_h.alias("new_h"), half(to_w, new_w).alias("pad_x"), half(to_h, new_h).alias("pad_y"))


def character_letterbox(w: Column, h: Column, to_w: int, to_h: int, direct: bool = False) -> Column:
    """PR3: (scale_x, scale_y, new_w, new_h, left, top); ``direct`` stretches both sides."""
    both = F.least(F.lit(to_w) / w, F.lit(to_h) / h)
    sx, sy = (F.lit(to_w) / w, F.lit(to_h) / h) if direct else (both, both)
    new_w, new_h = F.greatest(F.lit(1), F.rint(w * sx).cast("int")), F.greatest(F.lit(1), F.rint(h * sy).cast("int"))
    pad = lambda total, used: F.rint((F.lit(total) - used) / 2 - 0.1).cast("int")
    return F.struct(sx.alias("scale_x"), sy.alias("scale_y"), new_w.alias("new_w"), new_h.alias("new_h"), pad(to_w, new_w).alias("left"), pad(to_h, new_h).alias("top"))


def from_letterbox(cx: Column, cy: Column, bw: Column, bh: Column, lb: Column, w: Column, h: Column) -> Column:
    """PR4: centre and size in the letterbox to a box in the picture."""
    x = lambda v: clamp((v - lb["pad_x"]) / lb["scale"], 0.0, w.cast("double"))
    y = lambda v: clamp((v - lb["pad_y"]) / lb["scale"], 0.0, h.cast("double"))
    return box(x(cx - bw / 2), y(cy - bh / 2), x(cx + bw / 2), y(cy + bh / 2))


def whole_pixels(b: Column, w: Column, h: Column) -> Column:
    """PR5: nearest pixels, halves to even; the first corner stays off the far edge."""
    near = lambda s, low, top: clamp(F.rint(b[s]).cast("int"), low, top)
    return box(near("x1", 0, w - 1), near("y1", 0, h - 1), near("x2", 0, w), near("y2", 0, h))


def character_pixels(b: Column, w: Column, h: Column) -> Column:
    """PR6: as whole_pixels, the second corner at least 1; null if empty."""
    near = lambda s, low, top: clamp(F.rint(b[s]).cast("int"), low, top)
    c = box(near("x1", 0, w - 1), near("y1", 0, h - 1), near("x2", 1, w), near("y2", 1, h))
    return F.when(valid(c), c)


def xyah(b: Column) -> Column:
    """PR13: centre, aspect and height."""
    x, y = centre(b)
    return F.struct(x.alias("x"), y.alias("y"), (width(b) / height(b)).alias("aspect"), height(b).cast("double").alias("height"))


def from_xyah(v: Column) -> Column:
    """Sides are at least 1."""
    w, h = F.greatest(F.lit(1.0), v["aspect"] * v["height"]), F.greatest(F.lit(1.0), v["height"])
    return box(v["x"] - w / 2, v["y"] - h / 2, v["x"] + w / 2, v["y"] + h / 2)


def relative(plate: Column, vehicle: Column) -> Column:
    """PR14: the plate's place and size in its vehicle; null if either box is not valid."""
    x, y = centre(plate)
    w, h = width(vehicle), height(vehicle)
    out = F.struct(
        ((x - vehicle["x1"]) / w).alias("centre_x"),
        ((y - vehicle["y1"]) / h).alias("centre_y"),
        (width(plate) / w).alias("width"),
        (height(plate) / h).alias("height"),
        (area(plate) / area(vehicle)).alias("area"),
    )
    return F.when(valid(plate) & valid(vehicle), out)


def argmax(scores: Column) -> Column:
    """PR1: (class_id, confidence) of the first largest score."""
    best = F.array_max(scores)
    return F.struct((F.array_position(scores, best) - 1).cast("int").alias("class_id"), best.cast("double").alias("confidence"))
