"""Queries over the driver's tables, one for each operator, and the same in SQL.

Names in brackets are the operators of the inventory. Doubles are rounded where a
sum's order could differ. Queries without SQL have golden or brute-force tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.config import VEHICLE_CLASSES, Buffer, Detection, ImageOwnership
from quillon.functions import geometry as g
from quillon.functions import plate_text as t
from quillon.functions import scores
from quillon.operators import assign, detections, evidence, fusion, ownership, results, tracking
from quillon.plans import fixtures as fx

QUERIES, SQL = {}, {}


def query(sql: str | None = None, tables: str = ""):
    """Registers a query under its function's name, and its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = fx.sql(tables, sql) if tables else sql
        return f

    return add


r6 = lambda c, name=None: F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)
# SQL macros, as text: geometry of two boxes with prefixes a and b.
INTER = "(greatest(least(a.x2,b.x2)-greatest(a.x1,b.x1),0)*greatest(least(a.y2,b.y2)-greatest(a.y1,b.y1),0))"
AREA = lambda p: f"(greatest({p}.x2-{p}.x1,0)*greatest({p}.y2-{p}.y1,0))"
UNION = f"({AREA('a')}+{AREA('b')}-{INTER})"
IOU = f"(case when {UNION} > 0 then {INTER}/{UNION} else 0e0 end)"
CLASS_NAME = "case class_id " + " ".join(f"when {k} then '{v}'" for k, v in VEHICLE_CLASSES.items()) + " end"
D = Detection()


def _named(df: DataFrame) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in VEHICLE_CLASSES.items() for x in kv])
    return df.withColumn("class_name", names[F.col("class_id")])


# ---- filters and projections -------------------------------------------------------------


@query(f"select frame_id, i, class_id, {CLASS_NAME} as class_name, conf from boxes where conf >= 0.25e0 and class_id in (2, 5, 7) and x2 > x1 and y2 > y1", "boxes")
def conf_class_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[FI1, FI2, FI3, PR15]"""
    rows = detections.confident(fx.boxes(spark, sf_dir), D.image_confidence, classes=(2, 5, 7)).filter(g.valid(g.box()))
    return _named(rows).select("frame_id", "i", "class_id", "class_name", "conf")


@query("""with l as (select *, least(640e0/200, 640e0/120) as scale from boxes),
  p as (select *, least(640, cast(round_even(200*scale, 0) as int)) as nw, least(640, cast(round_even(120*scale, 0) as int)) as nh from l),
  q as (select *, (640-nw)//2 as px, (640-nh)//2 as py from p),
  u as (select frame_id, i, nw, nh, px, py, least(greatest((x1*3-px)/scale,0),200) as a, least(greatest((y1*4-py)/scale,0),120) as b, least(greatest((x2*3-px)/scale,0),200) as c, least(greatest((y2*4-py)/scale,0),120) as d from q)
  select frame_id, i, cast(px as int) as pad_x, cast(py as int) as pad_y, cast(least(greatest(round_even(a,0),0),199) as int) as x1, cast(least(greatest(round_even(b,0),0),119) as int) as y1,
    cast(least(greatest(round_even(c,0),0),200) as int) as x2, cast(least(greatest(round_even(d,0),0),120) as int) as y2 from u""", "boxes")
def box_unletterbox(spark, sf_dir):
    """[PR2, PR4, PR5] Boxes of a 640 letterbox to pixels of a 200 x 120 picture."""
    w, h = F.lit(200), F.lit(120)
    rows = fx.boxes(spark, sf_dir).withColumn("lb", g.letterbox(w, h, 640, 640))
    b = g.box(F.col("x1") * 3, F.col("y1") * 4, F.col("x2") * 3, F.col("y2") * 4)
    rows = rows.withColumn("b", g.from_letterbox(*[(b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2, b["x2"] - b["x1"], b["y2"] - b["y1"]], F.col("lb"), w, h))
    return rows.withColumn("p", g.whole_pixels(F.col("b"), w, h)).select("frame_id", "i", "lb.pad_x", "lb.pad_y", "p.*")


@query("""with s as (select frame_id, i, cast(x2 - x1 as int) as w, cast(y2 - y1 as int) as h from boxes), c as (select *, least(96e0/w, 48e0/h) as s from s),
  n as (select *, greatest(1, cast(round_even(w*s, 0) as int)) as nw, greatest(1, cast(round_even(h*s, 0) as int)) as nh from c)
  select frame_id, i, nw as new_w, nh as new_h, cast(round_even((96-nw)/2e0 - 0.1e0, 0) as int) as left_pad, cast(round_even((48-nh)/2e0 - 0.1e0, 0) as int) as top_pad from n""", "boxes")
def character_letterbox(spark, sf_dir):
    """[PR3]"""
    rows = fx.boxes(spark, sf_dir).withColumn("lb", g.character_letterbox((F.col("x2") - F.col("x1")).cast("int"), (F.col("y2") - F.col("y1")).cast("int"), 96, 48))
    return rows.select("frame_id", "i", "lb.new_w", "lb.new_h", F.col("lb.left").alias("left_pad"), F.col("lb.top").alias("top_pad"))


@query("""with l as (select frame_id, i, x1-30 as a, y1-10 as b, x2*0.7e0 as c, y2*0.9e0 as d, 10 as ox, 20 as oy from boxes),
  m as (select *, a+ox as ga, b+oy as gb, c+ox as gc, d+oy as gd from l),
  v as (select *, least(greatest(ga,10),50) as va, least(greatest(gb,20),60) as vb, least(greatest(gc,10),50) as vc, least(greatest(gd,20),60) as vd from m)
  select frame_id, i, least(greatest(cast(trunc(ga) as int),0),100) as ix1, least(greatest(cast(trunc(gb) as int),0),80) as iy1, least(greatest(cast(trunc(gc) as int),0),100) as ix2, least(greatest(cast(trunc(gd) as int),0),80) as iy2,
    least(greatest(cast(trunc(va) as int),0),100) as vx1, least(greatest(cast(trunc(vb) as int),0),80) as vy1, least(greatest(cast(trunc(vc) as int),0),100) as vx2, least(greatest(cast(trunc(vd) as int),0),80) as vy2,
    (ga<>va or gb<>vb or gc<>vc or gd<>vd) as clamped from v""", "boxes")
def local_to_global(spark, sf_dir):
    """[PR7, PR9, PR10, PR11] A region's boxes to the frame's, by the image's and the video's rule."""
    parent, w, h = g.box(F.lit(10), F.lit(20), F.lit(50), F.lit(60)), F.lit(100), F.lit(80)
    local = g.box(F.col("x1") - 30, F.col("y1") - 10, F.col("x2") * 0.7, F.col("y2") * 0.9)
    rows = fx.boxes(spark, sf_dir).withColumns({"im": g.to_global(local, parent, w, h, False), "vi": g.to_global(local, parent, w, h, True)})
    off = lambda s: local[s] + parent["x1" if s[0] == "x" else "y1"]
    out = lambda s: (off(s) < parent[f"{s[0]}1"]) | (off(s) > parent[f"{s[0]}2"])
    clamped = out("x1") | out("y1") | out("x2") | out("y2")
    return rows.select("frame_id", "i", *[F.col(f"im.{s}").alias(f"i{s}") for s in g.SIDES], *[F.col(f"vi.{s}").alias(f"v{s}") for s in g.SIDES], clamped.alias("clamped"))


@query("""with p as (select frame_id, i, x1-25 as a, y1-15 as b, x2 as c, y2 as d from boxes),
  k as (select *, least(greatest(cast(trunc(a) as int),0),90) as e, least(greatest(cast(trunc(b) as int),0),70) as f, least(greatest(cast(trunc(c) as int),0),90) as g, least(greatest(cast(trunc(d) as int),0),70) as h,
    least(greatest(cast(round_even(a,0) as int),0),89) as q1, least(greatest(cast(round_even(b,0) as int),0),69) as q2, least(greatest(cast(round_even(c,0) as int),1),90) as q3, least(greatest(cast(round_even(d,0) as int),1),70) as q4 from p)
  select frame_id, i, g > e and h > f as has_roi, a >= 0 and b >= 0 and c <= 90 and d <= 70 and c > a and d > b as has_crop, q3 > q1 and q4 > q2 as has_character from k""", "boxes")
def crops_in_frame(spark, sf_dir):
    """[PR6, PR8, PR12]"""
    b, w, h = g.box(F.col("x1") - 25, F.col("y1") - 15, F.col("x2"), F.col("y2")), F.lit(90), F.lit(70)
    return fx.boxes(spark, sf_dir).select("frame_id", "i", g.crop_box(b, w, h).isNotNull().alias("has_roi"), g.exact_crop(b, w, h).isNotNull().alias("has_crop"), g.character_pixels(b, w, h).isNotNull().alias("has_character"))


@query("""select frame_id, i, round((x1+x2)/2, 6) as cx, round((y1+y2)/2, 6) as cy, round((x2-x1)/(y2-y1), 6) as aspect, round(y2-y1, 6) as height, round((x1+x2)/2 - (x2-x1)/2, 6) as back_x1 from boxes""", "boxes")
def box_xyah(spark, sf_dir):
    """[PR13, MA2]"""
    rows = fx.boxes(spark, sf_dir).withColumn("v", g.xyah(g.box()))
    return rows.select("frame_id", "i", r6("v.x", "cx"), r6("v.y", "cy"), r6("v.aspect", "aspect"), r6("v.height", "height"), r6(g.from_xyah(F.col("v"))["x1"], "back_x1"))


@query("""select vec_id, cast(list_position(embedding, list_max(embedding)) - 1 as int) as class_id, cast(list_max(embedding) as double) as confidence from embeddings""")
def argmax_class(spark, sf_dir):
    """[PR1]"""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", g.argmax(F.col("embedding")).alias("m"))
    return rows.select("vec_id", "m.*")


@query("""with s as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax from lineitem)
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(least(1e0, l_quantity*8/200), 6) as sharpness, round(least(1e0, (l_partkey % 60 + 20)/48e0), 6) as size, round(1 - least(1e0, l_discount*3 + l_tax*2), 6) as exposure,
    round(least(1e0, 0.3e0*(l_suppkey % 100)/100e0 + 0.4e0*least(1e0, l_quantity*8/200) + 0.2e0*least(1e0, (l_partkey % 60 + 20)/48e0) + 0.1e0*(1 - least(1e0, l_discount*3 + l_tax*2))), 6) as total from s""")
def crop_quality(spark, sf_dir):
    """[MA8, AG26 given its statistics]"""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    q = scores.crop_quality((F.col("l_suppkey") % 100) / 100, F.lit(90), F.col("l_partkey") % 60 + 20, F.col("l_quantity") * 8, F.col("l_discount") * 3, F.col("l_tax") * 2)
    return rows.withColumn("q", q).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6("q.sharpness_score", "sharpness"), r6("q.size_score", "size"), r6("q.exposure_score", "exposure"), r6("q.total_score", "total"))


@query("""select source_id, count(*) as frames, cast(max(frame_index) as int) as last_frame, round(max(frame_index)/25e0, 6) as last_timestamp, round((max(frame_index)+1)/25e0, 6) as duration, cast(greatest(1, round_even(25*0.5e0, 0)) as int) as lost_frames,
  round_even(count(*)*0.0123e0*1000/(max(frame_index)+1), 6) as ms from obs where frame_index < 40 group by source_id""", "obs")
def source_times(spark, sf_dir):
    """[DA1, DA2, DA3, PR24, SC4: the first 40 frames of each source are the limit's feature]"""
    rows = fx.observations(spark, sf_dir).filter(F.col("frame_index") < 40).groupBy("source_id").agg(F.count("*").alias("frames"), F.max("frame_index").alias("last_frame"))
    fps = F.lit(25.0)
    return rows.select("source_id", "frames", "last_frame", r6(scores.timestamp(F.col("last_frame"), fps), "last_timestamp"), r6(scores.duration(F.col("last_frame") + 1, fps), "duration"), scores.lost_frames(fps).alias("lost_frames"), scores.milliseconds(F.col("frames") * 0.0123, F.col("last_frame") + 1).alias("ms"))


# ---- suppression and validation ----------------------------------------------------------

_NMS = """with b as (select *, row_number() over (partition by {keys} order by conf desc, i) as r from boxes where conf >= 0.25e0),
  k as (select {keys}, cast(0 as bigint) as r, cast([] as struct(i int, x1 double, y1 double, x2 double, y2 double)[]) as kept from (select distinct {keys} from b)
    union all select {bkeys}, b.r, case when len(list_filter(k.kept, lambda a: {iou} > {thr})) > 0 then k.kept
      else list_append(k.kept, struct_pack(i := b.i, x1 := b.x1, y1 := b.y1, x2 := b.x2, y2 := b.y2)) end from k join b on {on} and b.r = k.r + 1),
  f as (select {keys}, kept, row_number() over (partition by {keys} order by r desc) as z from k),
  u as (select {keys}, unnest(kept) as x from f where z = 1) select {keys}, x.i as i from u"""


def _nms_sql(keys: list[str], threshold: float) -> str:
    return _NMS.format(keys=", ".join(keys), bkeys=", ".join(f"b.{k}" for k in keys), on=" and ".join(f"b.{k} = k.{k}" for k in keys), iou=IOU, thr=f"{threshold}e0")


def _nms(spark, sf_dir, keys, threshold):
    rows = detections.confident(fx.boxes(spark, sf_dir), D.image_confidence)
    return detections.suppressed(rows, keys, threshold, [-F.col("conf"), F.col("i")]).select(*keys, "i")


@query(_nms_sql(["frame_id", "class_id"], 0.45), "boxes")
def nms_per_class(spark, sf_dir):
    """[AG1, TK2]"""
    return _nms(spark, sf_dir, ["frame_id", "class_id"], D.vehicle_iou)


@query(_nms_sql(["frame_id"], 0.45), "boxes")
def nms_agnostic(spark, sf_dir):
    """[AG2]"""
    return _nms(spark, sf_dir, ["frame_id"], D.plate_iou)


@query(_nms_sql(["frame_id"], 0.7), "boxes")
def nms_characters(spark, sf_dir):
    """[AG3]"""
    return _nms(spark, sf_dir, ["frame_id"], D.character_iou)


_REASONS = f"""select *, list_distinct_ordered from (select frame_id, i, class_id, conf, x1, y1, x2, y2, list_filter([
    case when class_id = 7 then 'unknown_vehicle_class' end, case when conf < 0.5e0 then 'low_confidence' end, case when x1-8 < 0 or y1-4 < 0 or x2-8 > 90 or y2-4 > 66 then 'bbox_out_of_frame' end,
    case when x2-x1 < 8 or y2-y1 < 8 then 'too_small' end, case when (x2-x1)/90 >= 0.98e0 and x1-8 <= 90*0.02e0 and 90-(x2-8) <= 90*0.02e0 and conf < 0.5e0 then 'wide_edge_bbox_low_confidence' end,
    case when (x2-x1)/(y2-y1) < 0.03e0 or (x2-x1)/(y2-y1) > 12 then 'abnormal_aspect_ratio' end], lambda x: x is not null) as list_distinct_ordered from boxes)"""
_DUPLICATES = f"""with v as ({_REASONS}), b as (select *, row_number() over (partition by frame_id order by conf desc, i) as r from v where len(list_distinct_ordered) = 0),
  k as (select frame_id, cast(0 as bigint) as r, cast([] as struct(i int, x1 double, y1 double, x2 double, y2 double)[]) as kept from (select distinct frame_id from b)
    union all select b.frame_id, b.r, case when len(list_filter(k.kept, lambda a: {IOU} >= 0.75e0)) > 0 then k.kept
      else list_append(k.kept, struct_pack(i := b.i, x1 := b.x1, y1 := b.y1, x2 := b.x2, y2 := b.y2)) end from k join b on b.frame_id = k.frame_id and b.r = k.r + 1),
  f as (select frame_id, kept, row_number() over (partition by frame_id order by r desc) as z from k), u as (select frame_id, unnest(kept) as x from f where z = 1), s as (select frame_id, x.i as i from u),
  o as (select v.frame_id, v.i, case when len(list_distinct_ordered) = 0 and s.i is null then 'duplicate_vehicle_box' else array_to_string(list_distinct_ordered, ',') end as reasons from v left join s on v.frame_id = s.frame_id and v.i = s.i)"""


def _validated(spark, sf_dir):
    rows = fx.boxes(spark, sf_dir).withColumns({"x1": F.col("x1") - 8, "x2": F.col("x2") - 8, "y1": F.col("y1") - 4, "y2": F.col("y2") - 4})
    rows = _named(rows).withColumns({"class_name": F.when(F.col("class_id") == 7, "van").otherwise(F.col("class_name")), "frame_w": F.lit(90), "frame_h": F.lit(66)})
    return detections.validated(rows, ["frame_id"])


@query(_DUPLICATES + " select frame_id, i, reasons, reasons = '' as accepted from o", "boxes")
def validate_reasons(spark, sf_dir):
    """[FI4, FI5, AG4, SO6]"""
    return _validated(spark, sf_dir).select("frame_id", "i", F.array_join("reasons", ",").alias("reasons"), "accepted")


@query(_DUPLICATES + " select unnest(string_split(reasons, ',')) as reason, count(*) as n from o where reasons <> '' group by reason", "boxes")
def reason_histogram(spark, sf_dir):
    """[AG18]"""
    return detections.reason_counts(_validated(spark, sf_dir))


@query(_nms_sql(["frame_id"], 0.7).rpartition(" select ")[0] + """, stay as (select frame_id, x.i as i from u)
  select fate, count(*) as n from (select case when conf < 0.25e0 then 'below_confidence' when x2 <= x1 or y2 <= y1 then 'invalid_box' when stay.i is null then 'suppressed_nms' else 'final' end as fate
    from boxes left join stay using (frame_id, i)) group by fate""", "boxes")
def character_trace(spark, sf_dir):
    """[UD3] Fates of all raw rows."""
    rows = fx.boxes(spark, sf_dir)
    return detections.traced(rows, D.image_confidence, ["frame_id"], D.character_iou, [-F.col("conf"), F.col("i")]).groupBy("fate").agg(F.count("*").alias("n"))


@query(f"""with c as (select frame_id, list(struct_pack(y := y1 + 6, x1 := x1, x := x1 + x1 + 8, ch := substr('{t.DIGITS + t.LETTERS}', i + class_id, 1), p := conf) order by y1, x1, substr('{t.DIGITS + t.LETTERS}', i + class_id, 1), conf) as c from boxes group by frame_id),
  y as (select *, list_transform(c, lambda s: s.y) as ys, len(c) as n from c),
  k as (select *, ys[:k] as a, ys[k + 1:] as b from (select *, unnest(range(2, n - 1)) as k from y where n >= 4)),
  m as (select *, list_median(a) as ma, list_median(b) as mb from k),
  d as (select *, mb - ma as gap, greatest(1, list_median(list_transform(a, lambda v: abs(v - ma))), list_median(list_transform(b, lambda v: abs(v - mb)))) as spread from m),
  best as (select frame_id, arg_min(k, (-gap / spread, k)) as k from d where gap >= greatest(0.35e0 * 12, 2 * spread) and ys[k + 1] - ys[k] >= 0.25e0 * 12 group by frame_id),
  g as (select frame_id, k, unnest(c) as s, unnest(range(1, n + 1)) as place from y left join best using (frame_id))
  select frame_id, string_agg(s.ch, '' order by coalesce(place > k, false), s.x, s.x1, s.ch, s.p) as text, cast(case when any_value(k) is null then 1 else 2 end as int) as n_rows, round(avg(s.p), 6) as confidence from g group by frame_id""", "boxes")
def reading_order(spark, sf_dir):
    """[WI2, WI3, ST13, AG21] Each order's lines as glyphs of a crop."""
    rows = fx.boxes(spark, sf_dir).withColumn("char", F.substr(F.lit(t.DIGITS + t.LETTERS), (F.col("i") + F.col("class_id")).cast("int"), F.lit(1)))
    rows = rows.select("frame_id", "char", F.col("conf").alias("confidence"), F.col("x1"), F.col("y1"), (F.col("x1") + 8).alias("x2"), (F.col("y1") + 12).alias("y2"))
    return detections.reading(rows, ["frame_id"]).select("frame_id", "text", "n_rows", r6("confidence"))


# ---- joins within frames -----------------------------------------------------------------


@query(f"""select a.frame_id, a.i as a, b.i as b, round({IOU}, 6) as iou, round(1-{IOU}, 6) as distance, round(case when a.class_id <> b.class_id then 1e6 else 1-{IOU} end, 6) as gated, round(1-{IOU}*b.conf, 9) as fused
  from boxes a join boxes b on a.frame_id = b.frame_id where a.conf < 0.5e0 and b.conf >= 0.5e0""", "boxes")
def iou_pairs(spark, sf_dir):
    """[JN1, JN2, JN3, JN4]"""
    rows = fx.boxes(spark, sf_dir)
    out = assign.pairs(rows.filter("conf < 0.5"), rows.filter("conf >= 0.5"), ["frame_id"])
    return out.select("frame_id", "a", "b", r6("iou"), r6("distance"), r6("gated"), F.round("fused", 9).alias("fused"))


_TOUCH = f"({IOU} >= 0.7e0 or (case when least({AREA('a')},{AREA('b')}) > 0 then {INTER}/least({AREA('a')},{AREA('b')}) else 0 end) >= 0.85e0)"


@query(f"select a.frame_id, a.i as a, b.i as b, a.class_id <> b.class_id as across from boxes a join boxes b on a.frame_id = b.frame_id and a.i < b.i where {_TOUCH}", "boxes")
def conflict_edges(spark, sf_dir):
    """[JN5, JN6]"""
    rows = fx.boxes(spark, sf_dir).withColumn("plate", g.box())
    image = ownership.conflict_edges(rows, ["frame_id"], "i", 0.70, 0.85)
    video = ownership.conflict_edges(rows, ["frame_id"], "i", 0.70, 0.85, "class_id").withColumn("across", F.lit(True))
    return image.join(video, ["frame_id", "a", "b"], "left").withColumn("across", F.coalesce("across", F.lit(False)))


_REACH = f"""e as (select a.frame_id, a.i as a, b.i as b from boxes a join boxes b on a.frame_id = b.frame_id and a.i < b.i where {_TOUCH}),
  n as (select frame_id, a, b from e union select frame_id, b, a from e), r as (select frame_id, i as a, i as b from boxes union select r.frame_id, r.a, n.b from r join n on r.frame_id = n.frame_id and r.b = n.a),
  c as (select frame_id, a as i, min(b) as component from r group by frame_id, a)"""


@query(f"with {_REACH}, d as (select frame_id, component, count(*) as n from c group by frame_id, component having count(*) > 1), p as (select ca.frame_id, ca.component, max(case when {IOU} >= 0.8e0 then 1 else 0 end) as d from c ca join c cb on ca.frame_id = cb.frame_id and ca.component = cb.component and ca.i < cb.i join boxes a on a.frame_id = ca.frame_id and a.i = ca.i join boxes b on b.frame_id = cb.frame_id and b.i = cb.i group by ca.frame_id, ca.component) select d.frame_id, d.component, d.n, p.d = 1 as definite from d join p on d.frame_id = p.frame_id and d.component = p.component", "boxes")
def conflict_components(spark, sf_dir):
    """[AG5, AG6]"""
    rows = fx.boxes(spark, sf_dir).withColumn("plate", g.box()).withColumn("candidate_index", F.col("i"))
    parts = ownership.components(rows, ownership.conflict_edges(rows, ["frame_id"], "i", 0.70, 0.85), ["frame_id"], "i")
    sizes = parts.groupBy("frame_id", "component").agg(F.count("*").alias("n")).filter("n > 1")
    return sizes.join(ownership.definite_groups(parts, ["frame_id"]), ["frame_id", "component"])


_PLATE = "select frame_id, candidate_index as i, track_id, px1 as x1, py1 as y1, px2 as x2, py2 as y2, vx1, vy1, vx2, vy2, plate_confidence as pc, vehicle_confidence as vc, coordinate_clamped as cl from candidates"
_OWNER = f"""with p as ({_PLATE}), q as (select *, not cl and x2 > x1 and y2 > y1 and x1 >= vx1 and y1 >= vy1 and x2 <= vx2 and y2 <= vy2 as ok,
    0.45e0*pc + 0.2e0*vc + 0.25e0*greatest(0, 1 - least(1, abs((x1+x2)/2 - (vx1+vx2)/2)/greatest(1, greatest(1, vx2-vx1)/2))) + 0.1e0*least(1, greatest(0,x2-x1)*greatest(0,y2-y1)/(greatest(1,vx2-vx1)*greatest(1,vy2-vy1))/0.12e0) as score from p),
  e as (select a.frame_id, a.i as a, b.i as b from q a join q b on a.frame_id = b.frame_id and a.i < b.i and a.track_id <> b.track_id and a.ok and b.ok where {_TOUCH}),
  n as (select frame_id, a, b from e union select frame_id, b, a from e), r as (select frame_id, i as a, i as b from q union select r.frame_id, r.a, n.b from r join n on r.frame_id = n.frame_id and r.b = n.a),
  c as (select frame_id, a as i, min(b) as component from r group by frame_id, a),
  o as (select q.*, component, first_value(track_id) over (partition by q.frame_id, component order by score desc, pc desc, vc desc, track_id) as owner, min(track_id) over (partition by q.frame_id, component) <> max(track_id) over (partition by q.frame_id, component) as several from q join c on q.frame_id = c.frame_id and q.i = c.i),
  s as (select *, case when not ok then 'rejected_outside_vehicle' when track_id = owner then 'selected' else 'rejected_conflict' end as st from o),
  z as (select *, row_number() over (partition by frame_id, track_id, st order by score desc, pc desc, i) as k from s)"""


@query(_OWNER + " select frame_id, i as candidate_index, case when st = 'selected' and k > 1 then 'rejected_same_track' else st end as ownership_status, case when ok and several then component else -1 end as conflict_group, round(score, 6) as ownership_score from z", "boxes candidates")
def video_ownership(spark, sf_dir):
    """[FI8, MA7, AG7, AG8, DT7, JN6]"""
    out = ownership.video_ownership(fx.candidates(spark, sf_dir), ["frame_id"])
    return out.select("frame_id", "candidate_index", "ownership_status", F.coalesce("conflict_group", F.lit(-1)).alias("conflict_group"), r6("ownership_score"))


_IMAGE = f"""with p as ({_PLATE}), q as (select *, track_id as v, (x2-x1)*(y2-y1)/((vx2-vx1)*(vy2-vy1)) as ra, greatest(least(x2,vx2)-greatest(x1,vx1),0)*greatest(least(y2,vy2)-greatest(y1,vy1),0)/((x2-x1)*(y2-y1)) as co from p
    where x2 > x1 and y2 > y1 and vx2 > vx1 and vy2 > vy1 and (x1+x2)/2 between vx1 and vx2 and (y1+y2)/2 between vy1 and vy2),
  e as (select a.frame_id, a.i as a, b.i as b from q a join q b on a.frame_id = b.frame_id and a.i < b.i where {_TOUCH}),
  n as (select frame_id, a, b from e union select frame_id, b, a from e), r as (select frame_id, i as a, i as b from q union select r.frame_id, r.a, n.b from r join n on r.frame_id = n.frame_id and r.b = n.a),
  c as (select frame_id, a as i, min(b) as component from r group by frame_id, a),
  w as (select q.*, component, count(*) over (partition by q.frame_id, component) as gs, max(ra) over (partition by q.frame_id, component) as mr, first_value(v) over (partition by q.frame_id, component order by co desc, pc desc, vc desc, v) as legacy from q join c on q.frame_id = c.frame_id and q.i = c.i)"""


@query(_IMAGE + """ select frame_id, i as candidate_index, component, legacy as legacy_owner, round(ra, 6) as area, round(co, 6) as containment,
  round(0.4e0*0.5e0 + 0.25e0*(case when gs = 1 then 1 else ra/mr end) + 0.15e0*co + 0.15e0*pc + 0.05e0*vc, 10) as owner_score from w""", "boxes candidates")
def image_owner_scores(spark, sf_dir):
    """[FI7, PR14, AG9, AG24, MA6, WI10]"""
    out = ownership.image_scores(fx.candidates(spark, sf_dir), ["frame_id"])
    return out.select("frame_id", "candidate_index", "component", "legacy_owner", r6("geometry.area", "area"), r6("containment"), (F.round(F.col("owner_score") * 1e10) / 1e10).alias("owner_score"))


@query(_IMAGE + " select frame_id, v as vehicle_index, count(distinct component) as n_groups from w group by frame_id, v having count(distinct component) > 1", "boxes candidates")
def same_track_conflicts(spark, sf_dir):
    """[AG25]"""
    return ownership.same_track_conflicts(ownership.image_scores(fx.candidates(spark, sf_dir), ["frame_id"]), ["frame_id"])


def _resolved(spark, sf_dir):
    rows = fx.candidates(spark, sf_dir).withColumns({"source_id": F.col("frame_id") % 64, "frame_index": F.floor(F.col("frame_id") / 64).cast("int")})
    return ownership.image_ownership(rows.drop("frame_id", "track_id", "coordinate_clamped"))


@query(None)
def image_ownership(spark, sf_dir):
    """[SS6, JN7, JN8, JN9, JN20, FI10, TK4]"""
    out = _resolved(spark, sf_dir)
    return out.select("source_id", "frame_index", "candidate_index", "vehicle_index", r6("temporal_score"), "history_samples", "rejected_by_history", r6("owner_score"), "selected", "history_updated")


@query(None)
def ownership_stats(spark, sf_dir):
    """[AG29]"""
    return ownership.resolution_stats(_resolved(spark, sf_dir), ["source_id"])


_GEOMETRY = ("cx", "cy", "w", "h")
_MEDIAN = ", ".join(f"list_median(list_transform(past, lambda p: p.{k})) as m{k}" for k in _GEOMETRY)
_MAD = ", ".join(f"list_median(list_transform(past, lambda p: abs(p.{k} - m{k}))) as d{k}" for k in _GEOMETRY)
_FAR = " + ".join(f"abs({k} - m{k}) / greatest(1.4826e0 * d{k}, {tol}e0)" for k, tol in zip(_GEOMETRY, (0.2, 0.2, 0.5, 0.5)))
#: A vehicle's history, frame after frame: a list of the last 20 accepted geometries.
_LONE = f"""with g as (select *, ((x1 + x2)/2 - 0)/200e0 as cx, ((y1 + y2)/2 - 0)/100e0 as cy, (x2 - x1)/200e0 as w, (y2 - y1)/100e0 as h, (x1 + x2)/2 <= 200 and (y1 + y2)/2 <= 100 as ok,
    greatest(least(x2, 200) - greatest(x1, 0), 0) * greatest(least(y2, 100) - greatest(y1, 0), 0) / ((x2 - x1) * (y2 - y1)) as contained, row_number() over (partition by source_id order by frame_index) as r from lone),
  z as (select source_id, cast(0 as bigint) as r, -1 as frame_index, cast([] as struct(cx double, cy double, w double, h double)[]) as past, cast(0 as double) as temporal, cast(0 as bigint) as samples, false as rejected, cast(0 as double) as score, false as taken from (select distinct source_id from g)
    union all select source_id, r, frame_index, case when ok and not bad then list_slice(list_append(past, struct_pack(cx := cx, cy := cy, w := w, h := h)), -20, -1) else past end,
      case when not ok then 0 else t end, case when ok then len(past) else 0 end, ok and bad, case when ok and not bad then 0.4e0*t + 0.25e0 + 0.15e0*contained + 0.15e0*pc + 0.05e0*vc else 0 end, ok and not bad
    from (select *, len(past) >= 5 and (t < 0.2e0 or sqrt((cx - past[-1].cx)**2 + (cy - past[-1].cy)**2) > 0.25e0 or greatest(w, past[-1].w) / least(w, past[-1].w) > 2.5e0 or greatest(h, past[-1].h) / least(h, past[-1].h) > 2.5e0) as bad
      from (select *, case when len(past) < 5 then 0.5e0 else exp(-({_FAR}) / 4) end as t
        from (select *, {_MAD} from (select g.*, past, {_MEDIAN} from z join g on g.source_id = z.source_id and g.r = z.r + 1)))))
  select source_id, frame_index, 0 as candidate_index, 0 as vehicle_index, round(temporal, 6) as temporal_score, cast(samples as int) as history_samples, rejected as rejected_by_history, round(score, 6) as owner_score, taken as selected, taken as history_updated from z where r > 0"""


@query(_LONE, "lone")
def lone_ownership(spark, sf_dir):
    """[SS6, FI10, AG22, MA12, TK4] One vehicle with one plate a frame, so that only its history decides."""
    box = lambda *v: F.struct(*[(F.col(x) if isinstance(x, str) else F.lit(x)).cast("double").alias(n) for x, n in zip(v, g.SIDES)])
    rows = fx.lone(spark, sf_dir).select("source_id", "frame_index", F.lit(0).alias("candidate_index"), F.lit(0).alias("vehicle_index"), box("x1", "y1", "x2", "y2").alias("plate"), box(0, 0, 200, 100).alias("vehicle"), F.col("pc").alias("plate_confidence"), F.col("vc").alias("vehicle_confidence"))
    out = ownership.image_ownership(rows)
    return out.select("source_id", "frame_index", "candidate_index", "vehicle_index", r6("temporal_score"), "history_samples", "rejected_by_history", r6("owner_score"), "selected", "history_updated")


#: Frames without history: the best candidate of each vehicle and group is an edge, and all ways to match vehicles are tried.
_COLD = _IMAGE + """, sc as (select *, 0.4e0*0.5e0 + 0.25e0*(case when gs = 1 then 1 else ra/mr end) + 0.15e0*co + 0.15e0*pc + 0.05e0*vc as score, case when gs = 1 then 1 else ra/mr end as tight from w),
  ed as (select frame_id, v, component, score, i from (select *, row_number() over (partition by frame_id, v, component order by score desc, tight desc, pc desc, vc desc, i) as k from sc) where k = 1 and 1 - score <= 1),
  rs as (select frame_id, v, dense_rank() over (partition by frame_id order by v) as r from (select distinct frame_id, v from ed)),
  mt as (select frame_id, cast(0 as bigint) as r, cast([] as bigint[]) as used, cast([] as int[]) as won, cast(0 as double) as total from (select distinct frame_id from ed)
    union all select mt.frame_id, rs.r, case when o.take then list_append(used, cast(o.component as bigint)) else used end, case when o.take then list_append(won, o.i) else won end, mt.total + case when o.take then -o.score - 1e-6 else 0 end
      from mt join rs on rs.frame_id = mt.frame_id and rs.r = mt.r + 1 join (select frame_id, v, component, score, i, true as take from ed union all select frame_id, v, -1, 0, -1, false from rs) o on o.frame_id = rs.frame_id and o.v = rs.v
      where not o.take or not list_contains(used, cast(o.component as bigint))),
  ch as (select frame_id, unnest(won) as i from (select mt.*, row_number() over (partition by mt.frame_id order by total) as k from mt join (select frame_id, max(r) as last from rs group by frame_id) l on mt.frame_id = l.frame_id and mt.r = l.last) where k = 1),
  dn as (select sc.*, ch.i is not null as chosen from sc left join ch on sc.frame_id = ch.frame_id and sc.i = ch.i),
  mg as (select a.frame_id, a.i, max(b.score) as rival from dn a join dn b on a.frame_id = b.frame_id and a.chosen and not b.chosen and (a.v = b.v or a.component = b.component) group by a.frame_id, a.i),
  fin as (select p.frame_id, p.i, p.track_id as v, dn.i is not null as ok, case when gs > 1 then component end as grp, coalesce(score, 0) as score, coalesce(chosen, false) as chosen, coalesce(chosen and (rival is null or score - rival >= 0.1e0), false) as updated
    from p left join dn on p.frame_id = dn.frame_id and p.i = dn.i left join mg on p.frame_id = mg.frame_id and p.i = mg.i)"""


def _cold(spark, sf_dir):
    rows = fx.candidates(spark, sf_dir).withColumn("frame_index", F.lit(0)).withColumnRenamed("frame_id", "source_id")
    return ownership.image_ownership(rows.drop("track_id", "coordinate_clamped"))


@query(_COLD + " select frame_id as source_id, i as candidate_index, v as vehicle_index, ok as valid, round(score, 10) as owner_score, grp is not null as in_conflict, chosen as selected, updated as history_updated from fin", "boxes candidates")
def cold_ownership(spark, sf_dir):
    """[JN7, JN8, JN9, JN20, TK4] Every frame as a source of its own."""
    return _cold(spark, sf_dir).select("source_id", "candidate_index", "vehicle_index", "valid", (F.round(F.col("owner_score") * 1e10) / 1e10).alias("owner_score"), F.col("conflict_group").isNotNull().alias("in_conflict"), "selected", "history_updated")


@query(_COLD + """ select frame_id as source_id, count(*) as raw_candidates, count(*) filter (not ok) as invalid_candidates, count(distinct grp) as conflict_groups, count(*) filter (ok and not chosen) as removed_conflict_candidates,
    count(*) filter (chosen) as final_results, count(*) filter (updated) as history_updates, cast(0 as bigint) as temporal_outliers_rejected from fin group by frame_id""", "boxes candidates")
def cold_stats(spark, sf_dir):
    """[AG29]"""
    return ownership.resolution_stats(_cold(spark, sf_dir), ["source_id"])


def _edges(spark, sf_dir):
    rows = fx.boxes(spark, sf_dir)
    return assign.pairs(rows.filter("conf < 0.5"), rows.filter("conf >= 0.5"), ["frame_id"]).select("frame_id", "a", "b", F.col("distance").alias("cost"))


#: All ways to match, row after row; the cheapest wins, where leaving a row and a column alone costs the limit and a little more.
_MATCH = f"""with e as (select a.frame_id, a.i as a, b.i as b, 1-{IOU} as cost from boxes a join boxes b on a.frame_id = b.frame_id where a.conf < 0.5e0 and b.conf >= 0.5e0 and 1-{IOU} <= 0.83e0),
  rs as (select frame_id, a, dense_rank() over (partition by frame_id order by a) as r from (select distinct frame_id, a from e)),
  w as (select frame_id, cast(0 as bigint) as r, cast([] as struct(a int, b int, cost double)[]) as m, cast(0 as double) as total from (select distinct frame_id from e)
    union all select w.frame_id, rs.r, case when o.take then list_append(w.m, struct_pack(a := rs.a, b := o.b, cost := o.cost)) else w.m end, w.total + case when o.take then o.cost - 0.83e0 - 1e-6 else 0 end
      from w join rs on rs.frame_id = w.frame_id and rs.r = w.r + 1 join (select frame_id, a, b, cost, true as take from e union all select frame_id, a, -1, 0, false from rs) o on o.frame_id = rs.frame_id and o.a = rs.a
      where not o.take or len(list_filter(w.m, lambda x: x.b = o.b)) = 0),
  z as (select w.*, row_number() over (partition by w.frame_id order by total) as k from w join (select frame_id, max(r) as last from rs group by frame_id) l on w.frame_id = l.frame_id and w.r = l.last),
  hit as (select frame_id, x.a as a, x.b as b, x.cost as cost from (select frame_id, unnest(m) as x from z where k = 1))"""


@query(_MATCH + " select frame_id, a, b, round(cost, 6) as cost from hit", "boxes")
def assignment_1to1(spark, sf_dir):
    """[JN7, JN8, FI15]"""
    return assign.assigned(_edges(spark, sf_dir), ["frame_id"], 0.83).select("frame_id", "a", "b", r6("cost"))


@query(_MATCH + " select case when hit.b is not null then 'matched' when conf < 0.9e0 then 'unmatched_low_confidence' else 'not_eligible' end as status, count(*) as n from boxes left join hit on boxes.frame_id = hit.frame_id and boxes.i = hit.b where conf >= 0.5e0 group by all", "boxes")
def unmatched_detections(spark, sf_dir):
    """[JN17, SO3, FI6]"""
    rows = fx.boxes(spark, sf_dir).filter("conf >= 0.5").withColumn("b", F.col("i"))
    matches = assign.assigned(_edges(spark, sf_dir), ["frame_id"], 0.83)
    return assign.marked(rows, matches, ["frame_id", "b"], F.col("conf") < 0.9).groupBy("status").agg(F.count("*").alias("n"))


@query("""with w as (select track_id, frame_index, total_score as v, row_number() over (partition by track_id order by frame_index) as k from crops),
  h as (select a.track_id, a.frame_index, count(b.v) as samples, median(b.v) as m from w a left join w b on a.track_id = b.track_id and b.k between a.k - 20 and a.k - 1 group by a.track_id, a.frame_index, a.k),
  d as (select a.track_id, a.frame_index, median(abs(b.v - h.m)) as mad from w a join h on a.track_id = h.track_id and a.frame_index = h.frame_index join w b on a.track_id = b.track_id and b.k between a.k - 20 and a.k - 1 group by a.track_id, a.frame_index)
  select w.track_id, w.frame_index, samples, case when samples >= 5 then round(m, 6) end as median, case when samples >= 5 then round(mad, 6) end as mad, lag(v) over (partition by w.track_id order by w.frame_index) as previous
  from w join h on w.track_id = h.track_id and w.frame_index = h.frame_index left join d on w.track_id = d.track_id and w.frame_index = d.frame_index""", "crops")
def rolling_median_mad(spark, sf_dir):
    """[AG22, WI5, WI9, JN21]"""
    out = ownership.rolling_history(fx.crops(spark, sf_dir), ["track_id"], "frame_index", "total_score", ImageOwnership())
    return out.select("track_id", "frame_index", F.col("samples").cast("bigint").alias("samples"), r6("median"), r6("mad"), "previous")


# ---- crops -------------------------------------------------------------------------------

_REJECT = "case when width < 40 then 'crop_too_narrow' when height < 24 then 'crop_too_short' when sharpness_score < 0.7e0 then 'sharpness_too_low' when total_score < 0.6e0 then 'quality_score_too_low' end"


@query(f"select track_id, count(*) as n_all, count(*) filter ({_REJECT} is null) as n_eligible, count(*) filter ({_REJECT} = 'sharpness_too_low') as n_blurred from crops group by track_id", "crops")
def crop_eligibility(spark, sf_dir):
    """[FI9, SU9, AG27]"""
    rows = fx.crops(spark, sf_dir)
    blurred = rows.groupBy("track_id").agg(F.count_if(evidence.rejection() == "sharpness_too_low").alias("n_blurred"))
    return evidence.counts(rows, ["track_id"]).join(blurred, "track_id")


@query(f"select track_id, frame_index, candidate_index, cast(row_number() over (partition by track_id order by total_score desc, sharpness_score desc, plate_confidence desc, frame_index desc, candidate_index desc) as int) as rank from crops where {_REJECT} is null", "crops")
def topk_rank(spark, sf_dir):
    """[WI1, TK5]"""
    return evidence.ranked(fx.crops(spark, sf_dir).filter(evidence.rejection().isNull()), ["track_id"]).select("track_id", "frame_index", "candidate_index", "rank")


@query(f"""with e as (select track_id, frame_index as f, total_score as s from crops where {_REJECT} is null),
  s1 as (select track_id, f, s from e), s2 as (select a.track_id, b.f, a.s + b.s as s from s1 a join e b on a.track_id = b.track_id and b.f >= a.f + 5), s3 as (select a.track_id, b.f, a.s + b.s as s from s2 a join e b on a.track_id = b.track_id and b.f >= a.f + 5),
  s4 as (select a.track_id, b.f, a.s + b.s as s from s3 a join e b on a.track_id = b.track_id and b.f >= a.f + 5)
  select track_id, round(max(s), 6) as total from (select * from s1 union all select * from s2 union all select * from s3 union all select * from s4) group by track_id""", "crops")
def spaced_topk_total(spark, sf_dir):
    """[TK1, SS8] The chosen sets' totals, against all sets of up to four."""
    return evidence.spaced(fx.crops(spark, sf_dir), ["track_id"]).groupBy("track_id").agg(F.round(F.sum("total_score"), 6).alias("total"))


_CHOICE = f"""with e as (select track_id, frame_index as f, struct_pack(total_score, sharpness_score, plate_confidence, frame_index, candidate_index) as r from crops where {_REJECT} is null),
  s1 as (select track_id, f, [r] as m from e), s2 as (select a.track_id, b.f, list_append(a.m, b.r) as m from s1 a join e b on a.track_id = b.track_id and b.f >= a.f + 5), s3 as (select a.track_id, b.f, list_append(a.m, b.r) as m from s2 a join e b on a.track_id = b.track_id and b.f >= a.f + 5),
  s4 as (select a.track_id, b.f, list_append(a.m, b.r) as m from s3 a join e b on a.track_id = b.track_id and b.f >= a.f + 5),
  o as (select track_id, list_reverse_sort(m) as m from (select * from s1 union all select * from s2 union all select * from s3 union all select * from s4)),
  z as (select *, row_number() over (partition by track_id order by list_reduce(list_transform(m, lambda x: x.total_score), lambda a, b: a + b) desc, m desc) as k from o)"""


@query(_CHOICE + """,
  u as (select track_id, unnest(m) as x, unnest(range(1, len(m) + 1)) as rank from z where k = 1)
  select track_id, cast(rank as int) as rank, x.frame_index as frame_index, x.candidate_index as candidate_index, 'track_' || track_id || '/top' || rank || '_frame' || lpad(cast(x.frame_index as varchar), 6, '0') || '.jpg' as path from u""", "crops")
def spaced_topk(spark, sf_dir):
    """[TK1, SC16]"""
    out = evidence.spaced(fx.crops(spark, sf_dir), ["track_id"], Buffer())
    path = F.format_string("track_%d/top%d_frame%06d.jpg", "track_id", "rank", "frame_index")
    return out.select("track_id", "rank", "frame_index", "candidate_index", path.alias("path"))


# ---- readings ----------------------------------------------------------------------------

_W = "w as (select *, ocr_confidence * quality_score as weight from readings where raw_text <> '')"
_V = f"""with {_W}, v as (select track_id, raw_text, count(*) as n, sum(weight) as weight, min(frame_index) as first_frame from w group by track_id, raw_text),
  o as (select *, row_number() over (partition by track_id order by round(weight, 9) desc, n desc, first_frame, raw_text) as place from v)"""


@query(_V + " select track_id, raw_text, n, round(weight, 6) as weight, first_frame, cast(place as int) as place from o", "readings")
def exact_vote(spark, sf_dir):
    """[AG10, FI12, MA4]"""
    return fusion.exact_votes(fusion.candidates(fx.readings(spark, sf_dir))).select("track_id", "raw_text", "n", r6("weight"), "first_frame", "place")


@query(_V + ", t as (select track_id, count(*) as n_valid, sum(weight) as total from w group by track_id) select track_id, n_valid, raw_text as winner, round(weight / total, 6) as ratio from t join o using (track_id) where place = 1", "readings")
def consensus(spark, sf_dir):
    """[AG11]"""
    return fusion.consensus(fusion.candidates(fx.readings(spark, sf_dir))).select("track_id", "n_valid", "winner", r6("ratio"))


@query(f"""with {_W}, x as (select track_id, raw_text, max(ocr_confidence) as mo, max(quality_score) as mq, min(frame_index) as ff, sum(weight) as vote from w group by track_id, raw_text),
  c as (select x.track_id, x.raw_text, mo, mq, ff, vote, sum(w.weight * levenshtein(x.raw_text, w.raw_text) / greatest(length(x.raw_text), length(w.raw_text), 1)) as cost from x join w using (track_id) group by all),
  r as (select *, row_number() over (partition by track_id order by round(cost, 9), -round(vote, 9), -mo, -mq, ff, raw_text) as k from c) select track_id, raw_text as medoid, round(cost, 6) as cost from r where k = 1""", "readings")
def medoid(spark, sf_dir):
    """[AG12, AG28, ST1, ST2]"""
    return fusion.medoid(fusion.candidates(fx.readings(spark, sf_dir))).select("track_id", "medoid", r6("cost"))


_FUSED = _V + """, t as (select track_id, count(*) as n_valid, sum(weight) as total from w group by track_id), u as (select distinct track_id from readings),
  b as (select t.track_id, n_valid, case when n_valid = 1 then 1e0 else weight / total end as ratio, raw_text, n, case when n_valid = 1 then 'single_candidate' when weight / total >= 0.65e0 then 'weighted_exact_vote' else 'sequence_alignment' end as method from t join o using (track_id) where place = 1),
  s as (select b.track_id, avg(w.ocr_confidence) as mo, avg(w.quality_score) as mq, count(*) as sc from b join w using (track_id) where method = 'sequence_alignment' or w.raw_text = b.raw_text group by b.track_id)"""


@query(_FUSED + """ select u.track_id, coalesce(method, 'no_valid_ocr') as method, coalesce(sc, 0) as support_count, coalesce(n_valid, 0) as valid_candidate_count, round(coalesce(ratio, 0), 6) as consensus_ratio,
    round(coalesce((0.5e0*ratio + 0.25e0*mo + 0.25e0*mq) * case when n_valid = 1 then 0.5e0 + 0.5e0/3 else 1 end, 0), 6) as confidence from u left join b using (track_id) left join s using (track_id)""", "readings")
def fusion_confidence(spark, sf_dir):
    """[DT6, AG15, JN15, SO2]"""
    return fusion.fused(fx.readings(spark, sf_dir)).select("track_id", "method", "support_count", "valid_candidate_count", r6("consensus_ratio"), r6("confidence"))


@query(None)
def fused_text(spark, sf_dir):
    """[ST3, AG13, AG14, MA5] The texts; readings carry character confidences made from their place."""
    rows = fx.readings(spark, sf_dir).withColumn("char_confidences", F.transform(F.sequence(F.lit(0), F.lit(11)), lambda p: ((F.col("frame_index") * 7 + p * 3) % 50 + 50) / 100.0))
    out = fusion.fused(rows)
    return out.select("track_id", "raw_text", "method", F.size("columns").alias("n_columns"), F.array_join("supporting_frames", ",").alias("frames"))


#: A character's own confidence, made from its place.
_OWN = "((frame_index * 7 + (pos - 1) * 3) % 50 + 50) / 100e0"
_VOTED = f"with recursive readings as ({fx.VOTED}), " + _FUSED.removeprefix("with ") + """,
  mx as (select track_id, raw_text, max(ocr_confidence) as mo, max(quality_score) as mq, min(frame_index) as ff, sum(weight) as vote from w group by track_id, raw_text),
  mc as (select mx.track_id, mx.raw_text, mo, mq, ff, vote, sum(w.weight * levenshtein(mx.raw_text, w.raw_text) / greatest(length(mx.raw_text), length(w.raw_text), 1)) as cost from mx join w using (track_id) group by all),
  md as (select track_id, raw_text as ref from (select *, row_number() over (partition by track_id order by round(cost, 9), -round(vote, 9), -mo, -mq, ff, raw_text) as k from mc) where k = 1),
  ch as (select track_id, pos, substr(raw_text, pos, 1) as ch, sum(weight * """ + _OWN + """) as weight from (select *, unnest(range(1, 9)) as pos from w) group by all),
  tp as (select *, max(weight) over (partition by track_id, pos) as best from ch),
  pk as (select track_id, pos, coalesce(max(ch) filter (ch = substr(ref, pos, 1)), min(ch)) as ch from tp join md using (track_id) where abs(weight - best) <= 1e-12 group by track_id, pos),
  fu as (select track_id, string_agg(ch, '' order by pos) as fused from pk group by track_id),
  sf as (select b.track_id, string_agg(w.frame_index, ',' order by w.rank, w.frame_index) as frames from b join w using (track_id) where method = 'sequence_alignment' or w.raw_text = b.raw_text group by b.track_id)
"""


@query(_VOTED + " select track_id, case when method = 'sequence_alignment' then fused else raw_text end as raw_text, method, case when method = 'sequence_alignment' then 8 else 0 end as n_columns, frames from b join fu using (track_id) join sf using (track_id)")
def voted_text(spark, sf_dir):
    """[ST3, AG13, AG14, MA5, TK3] Readings with one wrong character each, fused place by place."""
    rows = fx.voted(spark, sf_dir).withColumn("char_confidences", F.transform(F.sequence(F.lit(0), F.lit(11)), lambda p: ((F.col("frame_index") * 7 + p * 3) % 50 + 50) / 100.0))
    return fusion.fused(rows).select("track_id", "raw_text", "method", F.coalesce(F.size("columns"), F.lit(0)).alias("n_columns"), F.array_join("supporting_frames", ",").alias("frames"))


@query(_FUSED + """, f as (select coalesce(method, 'no_valid_ocr') as method, n_valid is not null as has, coalesce((0.5e0*ratio + 0.25e0*mo + 0.25e0*mq) * case when n_valid = 1 then 0.5e0 + 0.5e0/3 else 1 end, 0) as confidence, ratio from u left join b using (track_id) left join s using (track_id))
  select count(*) as tracks, count(*) filter (has) as tracks_with_ocr, count(*) filter (method = 'no_valid_ocr') as no_valid_ocr, count(*) filter (method = 'single_candidate') as single_candidate,
    count(*) filter (method = 'weighted_exact_vote') as weighted_exact_vote, count(*) filter (method = 'sequence_alignment') as sequence_alignment,
    round(coalesce(avg(confidence) filter (has), 0), 6) as mean_confidence_with_ocr, round(coalesce(avg(confidence), 0), 6) as mean_confidence, round(coalesce(avg(ratio) filter (has), 0), 6) as mean_consensus from f""", "readings")
def fusion_report(spark, sf_dir):
    """[AG16]"""
    out = fusion.report(fusion.fused(fx.readings(spark, sf_dir)))
    return out.select(*[r6(c) if c.startswith("mean") else c for c in out.columns])


@query("""with j as (select event_id, json_extract_string(props, '$.k') as k from events)
  select event_id, case when event_id % 3 = 0 then 0 else event_id end as track_id, case when event_id % 5 = 0 then '' else 'T' || coalesce(k, '') end as raw_text, case when event_id % 2 = 0 then least(1e0, cast(k as double)/50) else 0e0 end as ocr_confidence, case when event_id % 7 = 0 then 'failed' else 'ok' end as status from j""")
def schema_on_read(spark, sf_dir):
    """[PR16] Readings as JSON objects of several shapes."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k")
    flat = F.struct(
        F.when(F.col("event_id") % 3 != 0, F.col("event_id")).alias("track_id"),
        F.when((F.col("event_id") % 5 != 0) & (F.col("event_id") % 4 != 0), F.concat(F.lit("T"), F.coalesce(k, F.lit("")))).alias("raw_text"),
        F.struct(F.when((F.col("event_id") % 5 != 0) & (F.col("event_id") % 4 == 0), F.concat(F.lit("T"), F.coalesce(k, F.lit("")))).alias("raw_text"), F.when(F.col("event_id") % 2 == 0, k.cast("double") / 50).alias("confidence"), F.when(F.col("event_id") % 7 == 0, "failed").alias("status")).alias("ocr"),
    )
    made = rows.select("event_id", F.to_json(flat).alias("value"))
    return fusion.from_json(made, "value", ("event_id",)).select("event_id", "track_id", "raw_text", "ocr_confidence", "status")


# ---- plate texts -------------------------------------------------------------------------

_LOCALITIES = "('13', '42', '44', '45', '46', '87', '91', '96')"
_EXPECT = """case kind when 'A' then case when regexp_matches(ch, '^[0-9A-Z]$') then ch end
  when 'D' then case when regexp_matches(ch, '^[0-9]$') then ch when ch in ('I','L','O','Z','S','G','B') then translate(ch, 'ILOZSGB', '1102568') end
  else case when regexp_matches(ch, '^[A-Z]$') then ch when ch in ('0','2','5','6','8') then translate(ch, '02568', 'OZSGB') end end"""
_TEXT = f"""with s as (select *, upper(translate(trim(raw_text), ' -.', '')) as norm, case when class_name = 'motorcycle' then 'motorbike_common' when class_name in ('car', 'bus', 'truck') then 'car_common' end as family from texts),
  tpl(prio, fam, pattern) as (values (0, 'car_common', 'DDLDDDD'), (1, 'car_common', 'DDLDDDDD'), (2, 'motorbike_common', 'DDLADDDD'), (3, 'motorbike_common', 'DDLADDDDD')),
  p as (select track_id, frame_index, prio, fam, pos, substr(norm, pos, 1) as ch, substr(pattern, pos, 1) as kind from (select s.*, tpl.*, unnest(range(1, length(pattern) + 1)) as pos from s join tpl on length(norm) = length(pattern))),
  x as (select *, {_EXPECT} as fixed from p),
  c as (select track_id, frame_index, prio, fam, string_agg(fixed, '' order by pos) as txt, count(*) filter (fixed <> ch) as cost from x group by all having count(*) = count(fixed)),
  v as (select *, case when not regexp_matches(txt, '^[0-9][0-9]') then 'invalid_locality_prefix' when substr(txt,1,2) < '11' or substr(txt,1,2) in {_LOCALITIES} then 'unknown_locality_code'
      when not regexp_matches(substr(txt,3,1), '^[ABCDEFGHKLMNPSTUVXYZ]$') then 'invalid_serial' when fam = 'motorbike_common' and not regexp_matches(substr(txt,4,1), '^[ABCDEFGHKLMNPSTUVXYZ0-9]$') then 'invalid_serial'
      when not regexp_matches(substr(txt, case when fam = 'car_common' then 4 else 5 end), '^[0-9]+$') then 'invalid_registration_number' end as bad from c),
  g as (select v.*, row_number() over (partition by v.track_id, v.frame_index order by cost, case when s.family is null or s.family = fam then 0 else 1 end, prio) as k from v join s on v.track_id = s.track_id and v.frame_index = s.frame_index where bad is null),
  w as (select track_id, frame_index, min(bad order by prio) as any_bad, arg_min(bad, prio) as why from v where bad is not null group by track_id, frame_index),
  r as (select s.track_id, s.frame_index, s.raw_text, s.class_name, s.confidence, s.norm, s.family, g.txt, g.fam, g.cost, w.why,
      case when norm = '' then 'no_text' when g.txt is null then 'unrecognized_format' when g.cost > 2 then 'low_format_confidence' when g.cost > 0 then 'corrected' else 'ok' end as status
    from s left join g on s.track_id = g.track_id and s.frame_index = g.frame_index and g.k = 1 left join w on s.track_id = w.track_id and s.frame_index = w.frame_index),
  o as (select *, status in ('ok', 'corrected') as good, case when status in ('ok', 'corrected') then txt else norm end as corrected,
      case when status in ('ok', 'corrected') then substr(txt, 1, case when fam = 'car_common' then 3 else 4 end) || '-' || substr(txt, case when fam = 'car_common' then 4 else 5 end, length(txt) - 2 - case when fam = 'car_common' then 3 else 4 end) || '.' || substr(txt, length(txt) - 1) end as formatted,
      case when norm = '' then 'empty_text' when status = 'unrecognized_format' then coalesce(why, 'invalid_length') when status = 'low_format_confidence' then 'too_many_position_corrections' end as reason, case when status in ('ok', 'corrected') then fam end as ffam from r)"""
_TEXT = _TEXT.replace("min(bad order by prio) as any_bad, ", "")


def _texts(spark, sf_dir):
    rows = fx.texts(spark, sf_dir)
    return results.once(rows, "post", t.postprocess(F.col("raw_text"), F.col("confidence"), t.preferred_family(F.col("class_name"))))


@query("select track_id, frame_index, upper(translate(trim(raw_text), ' -.', '')) as normalized, len(list_filter(string_split(upper(translate(trim(raw_text), ' -.', '')), ''), lambda c: c <> '' and not regexp_matches(c, '^[0-9A-Z]$'))) as n_unknown from texts", "every texts")
def plate_normalise(spark, sf_dir):
    """[ST4, ST5]"""
    norm = t.normalise(F.col("raw_text"))
    return fx.texts(spark, sf_dir).select("track_id", "frame_index", norm.alias("normalized"), F.size(t.unknown_characters(norm)).cast("bigint").alias("n_unknown"))


@query(_TEXT + " select track_id, frame_index, status, corrected, formatted, ffam as family, case when good then cost else 0 end as cost, good as format_valid, reason from o", "every texts")
def plate_format(spark, sf_dir):
    """[ST6, ST7, ST8, ST10, ST11, ST12, DT5, TK6]"""
    return _texts(spark, sf_dir).select("track_id", "frame_index", "post.status", F.col("post.corrected_text").alias("corrected"), F.col("post.formatted_text").alias("formatted"), F.col("post.format_family").alias("family"), F.col("post.correction_count").cast("bigint").alias("cost"), "post.format_valid", F.col("post.format_reason").alias("reason"))


_REPAIR = f"""with s as (select *, upper(translate(trim(substr(raw_text, 1, 4) || 'Q' || substr(raw_text, 5)), ' -.', '')) as norm, case when class_name = 'motorcycle' then 'motorbike_common' when class_name in ('car', 'bus', 'truck') then 'car_common' end as family from texts),
  tpl(prio, fam, pattern) as (values (0, 'car_common', 'DDLDDDD'), (1, 'car_common', 'DDLDDDDD'), (2, 'motorbike_common', 'DDLADDDD'), (3, 'motorbike_common', 'DDLADDDDD')),
  own as (select track_id, frame_index, 0 as src, norm as n from s union all select track_id, frame_index, 1, substr(norm, 1, 4) || substr(norm, 6) from s where length(norm) >= 5),
  p as (select track_id, frame_index, src, prio, fam, pos, substr(n, pos, 1) as ch, substr(pattern, pos, 1) as kind from (select own.*, tpl.*, unnest(range(1, length(pattern) + 1)) as pos from own join tpl on length(n) = length(pattern))),
  x as (select *, {_EXPECT} as fixed from p),
  c as (select track_id, frame_index, src, prio, fam, string_agg(fixed, '' order by pos) as txt, src + count(*) filter (fixed <> ch) as cost, arg_min(kind, pos) filter (fixed <> ch) as changed from x group by track_id, frame_index, src, prio, fam having count(*) = count(fixed)),
  v as (select *, case when not regexp_matches(txt, '^[0-9][0-9]') then 'invalid_locality_prefix' when substr(txt,1,2) < '11' or substr(txt,1,2) in {_LOCALITIES} then 'unknown_locality_code'
      when not regexp_matches(substr(txt,3,1), '^[ABCDEFGHKLMNPSTUVXYZ]$') then 'invalid_serial' when fam = 'motorbike_common' and not regexp_matches(substr(txt,4,1), '^[ABCDEFGHKLMNPSTUVXYZ0-9]$') then 'invalid_serial'
      when not regexp_matches(substr(txt, case when fam = 'car_common' then 4 else 5 end), '^[0-9]+$') then 'invalid_registration_number' end as bad from c),
  e as (select * from v where src = 0 or (track_id, frame_index) not in (select track_id, frame_index from v where src = 0 and bad is null)),
  g as (select e.*, row_number() over (partition by e.track_id, e.frame_index order by cost, case when s.family is null or s.family = fam then 0 else 1 end, prio, src) as k from e join s on e.track_id = s.track_id and e.frame_index = s.frame_index where bad is null),
  o as (select s.*, g.src, g.txt, g.cost as n_changes, g.changed, case when norm = '' then 'no_text' when g.txt is null then 'unrecognized_format' when g.cost > 2 then 'low_format_confidence' when g.cost > 0 then 'corrected' else 'ok' end as status
    from s left join g on s.track_id = g.track_id and s.frame_index = g.frame_index and g.k = 1)
  select track_id, frame_index, status, case when status in ('ok', 'corrected') then txt else norm end as corrected, case when status in ('ok', 'corrected') then n_changes else 0 end as cost,
    case when status = 'corrected' then case when src = 1 then 'low_confidence_extra_character' when changed = 'D' then 'digit_expected' else 'letter_expected' end end as first_change from o"""


@query(_REPAIR, "every texts")
def plate_repair(spark, sf_dir):
    """[ST9, AG23] Texts with one doubtful character too many."""
    rows = fx.texts(spark, sf_dir)
    longer = F.concat(F.substring("raw_text", 1, 4), F.lit("Q"), F.substr("raw_text", F.lit(5)))
    p = F.transform(F.sequence(F.lit(0), F.length(t.normalise(longer)) - 1), lambda i: F.when(i == 4, 0.2).otherwise(0.9))
    post = t.postprocess(longer, F.col("confidence"), t.preferred_family(F.col("class_name")), p)
    return results.once(rows, "p", post).select("track_id", "frame_index", "p.status", F.col("p.corrected_text").alias("corrected"), F.col("p.correction_count").cast("bigint").alias("cost"), F.get("p.corrections", F.lit(0))["reason"].alias("first_change"))


_SEEN = "(frame_index + track_id) % 5"


@query(_TEXT + f""", z as (select *, coalesce(class_name in ('car', 'bus', 'truck') and ffam = 'motorbike_common', false) as clash, {_SEEN} as seen from o)
  select track_id, frame_index, case when seen <= 0 then 'no_plate' when raw_text = '' then 'no_ocr' when clash or confidence < 0.5e0 or status = 'low_format_confidence' then 'low_confidence' when status = 'unrecognized_format' then 'unrecognized_format' else 'ok' end as status,
    case when seen <= 0 or raw_text = '' then null when clash then 'vehicle_plate_family_mismatch' when confidence < 0.5e0 then 'weak_ocr_evidence' when status = 'low_format_confidence' then 'too_many_position_corrections' when status = 'unrecognized_format' then 'no_known_format_family' end as status_reason,
    good and not clash as format_valid, case when not clash then formatted end as formatted from z""", "every texts")
def status_image(spark, sf_dir):
    """[DT1, DT2]"""
    rows = results.once(_texts(spark, sf_dir), "s", results.image_status(F.col("post"), F.col("class_name"), F.expr(_SEEN)))
    return rows.select("track_id", "frame_index", "s.status", "s.status_reason", "s.format_valid", "s.formatted")


@query(_TEXT + f""", z as (select *, trim(raw_text) = '' as blank, coalesce(ffam <> family, false) as clash, {_SEEN} as seen from o), y as (select *, not blank and not clash and good as valid from z)
  select track_id, frame_index, case when blank then 'no_ocr' when clash then 'vehicle_plate_family_mismatch' else status end as postprocess_status,
    case when seen <= 0 then 'no_plate' when blank then 'no_ocr' when status = 'low_format_confidence' or clash then 'low_confidence' when not valid then 'unrecognized_format' when confidence < 0.6e0 then 'low_confidence' else 'ok' end as status,
    case when seen <= 0 then null when blank then 'no_ocr_candidates' when clash then 'vehicle_plate_family_mismatch' when not valid then reason when confidence < 0.6e0 then 'weak_ocr_evidence' end as status_reason, case when valid then formatted end as formatted from y""", "every texts")
def status_video(spark, sf_dir):
    """[DT3, DT4]"""
    rows = results.once(_texts(spark, sf_dir), "a", results.video_post(F.col("post"), F.col("raw_text"), F.col("class_name")))
    rows = rows.withColumn("s", results.video_status(F.col("a"), F.expr(_SEEN), F.col("confidence"), 0.6))
    return rows.select("track_id", "frame_index", F.col("a.status").alias("postprocess_status"), "s.status", "s.status_reason", "a.formatted")


# ---- final rows --------------------------------------------------------------------------


def _image_rows(spark, sf_dir) -> DataFrame:
    rows = fx.texts(spark, sf_dir).withColumns({"class_id": F.lit(2), "vehicle_index": F.col("frame_index")})
    vehicles = rows.select("track_id", "vehicle_index", "frame_index", "class_id", "class_name")
    box = F.struct(*[F.lit(v).alias(s) for v, s in zip((1, 2, 30, 20), g.SIDES)])
    plates = rows.filter("frame_index % 6 <> 0").select("track_id", "vehicle_index", "raw_text", F.col("confidence").alias("ocr_confidence"), F.lit(None).cast("array<double>").alias("char_confidences"), F.lit("dai").alias("layout"), box.alias("plate"))
    return results.finalize_image(vehicles, plates, ["track_id", "vehicle_index"])


_IMAGE_ROWS = _TEXT + """, z as (select *, frame_index % 6 <> 0 as has, coalesce(class_name in ('car', 'bus', 'truck') and ffam = 'motorbike_common', false) as clash from o),
  q as (select track_id, frame_index as vehicle_index, class_name, has, case when not has then 'no_plate' when raw_text = '' then 'no_ocr' when clash or confidence < 0.5e0 or status = 'low_format_confidence' then 'low_confidence' when status = 'unrecognized_format' then 'unrecognized_format' else 'ok' end as status,
    case when not has then null when not clash then formatted end as formatted, has and good and not clash as format_valid, case when has then corrected else '' end as corrected, case when has then norm else '' end as norm, case when has then raw_text else '' end as raw, round_even(case when has then confidence else 0 end, 6) as confidence from z)"""


@query(_IMAGE_ROWS + " select track_id, vehicle_index, status, formatted, format_valid, corrected as text, confidence, coalesce(nullif(trim(formatted), ''), nullif(trim(corrected), ''), nullif(trim(norm), ''), nullif(trim(raw), ''), 'unreadable') as label from q", "every texts")
def image_rows(spark, sf_dir):
    """[JN13, PR17, PR18, PR22, MA13]"""
    rows = _image_rows(spark, sf_dir)
    return rows.select("track_id", "vehicle_index", "plate.status", "plate.formatted", "plate.format_valid", "plate.text", "plate.confidence", t.image_label(F.col("plate")).alias("label"))


@query(_IMAGE_ROWS + " select track_id, vehicle_index, class_name as vehicle_type, coalesce(nullif(formatted, ''), nullif(corrected, ''), nullif(norm, ''), raw) as license, confidence from q where status = 'ok' and format_valid and confidence >= 0.7e0", "every texts")
def customer_rows(spark, sf_dir):
    """[FI11, PR19, PR21, ST14]"""
    out = results.customer(_image_rows(spark, sf_dir).withColumn("key", F.struct("track_id", "vehicle_index")), "key", 0.7)
    return out.select("key.*", "vehicle_type", "license", "confidence")


@query(_IMAGE_ROWS + " select track_id, count(*) as vehicles, count(*) filter (has) as with_plate, count(*) filter (status = 'ok') as ok, count(*) filter (status = 'low_confidence') as low_confidence, count(*) filter (status = 'unrecognized_format') as unrecognized_format, count(*) filter (status = 'no_ocr') as no_ocr, count(*) filter (status = 'no_plate') as no_plate from q group by track_id", "every texts")
def summary_counts(spark, sf_dir):
    """[AG19]"""
    return results.summary(_image_rows(spark, sf_dir), ["track_id"])


@query(_IMAGE_ROWS + """, e as (select * from q where status = 'ok' and format_valid and confidence >= 0.5e0)
  select track_id, count(vehicle_index) as count, coalesce(string_agg(coalesce(nullif(formatted, ''), corrected), ',' order by vehicle_index), '') as texts, round(coalesce(max(confidence), 0), 6) as best from (select distinct track_id from q) left join e using (track_id) group by track_id""", "every texts")
def response_json(spark, sf_dir):
    """[PR20, SC10, SC13] Responses, read back from their JSON text."""
    rows = _image_rows(spark, sf_dir)
    requests = rows.select("track_id").distinct().withColumn("input_type", F.lit("image"))
    made = results.responses(requests, rows, "track_id", "vehicle_index").select("track_id", F.to_json("response", {"ignoreNullFields": "false"}).alias("value"))
    plate = "array<struct<plate_text:string,detection_confidence:double,ocr_confidence:double,crop_path:string>>"
    read = made.withColumn("r", F.from_json("value", f"struct<count:bigint,plates:{plate}>"))
    best = F.coalesce(F.array_max(F.transform("r.plates", lambda p: p["ocr_confidence"])), F.lit(0.0))
    return read.select("track_id", "r.count", F.array_join(F.transform("r.plates", lambda p: p["plate_text"]), ",").alias("texts"), r6(best, "best"))


def _video_rows(spark, sf_dir, observations=fx.observations, readings=fx.readings) -> DataFrame:
    """The whole video path over the observations, readings and crops: the flagship. Each track has its source's readings and crops."""
    found = observations(spark, sf_dir)
    seen = fx.kept(tracking.tracked(found))  # five uses; the tracker is Python
    pair = ["source_id", "track_id"]
    tracks = tracking.histories(seen).drop("status")
    named = _named(found).join(tracking.observations(seen).select("source_id", "frame_index", "det_index", "track_id"), ["source_id", "frame_index", "det_index"])
    votes = tracking.class_vote(named, pair)
    own = lambda df: df.withColumnRenamed("track_id", "source_id").join(tracks.select(*pair), "source_id")
    key = F.struct(*pair)
    read = own(readings(spark, sf_dir)).withColumn("key", key).drop(*pair)
    texts = fusion.fused(read, tracks.select(key.alias("key")), "key")
    texts = texts.select("key.*", *[c for c in texts.columns if c != "key"])
    crops = own(fx.crops(spark, sf_dir))
    plate = F.struct(*[(F.col("frame_index") + k).alias(s) for k, s in enumerate(g.SIDES)])
    best = evidence.spaced(crops, pair).withColumn("plate", plate)
    n = crops.groupBy(*pair).agg(F.count("*").alias("n"))
    return results.finalize_video(tracks, votes, texts, n, best, pair)


@query(None)
def fused_plates(spark, sf_dir):
    """[JN14, PR17, PR23, TK4, TK5, FI13, SO2] One explained row per track, through tracker, votes, crops, fusion and text rules."""
    rows = _video_rows(spark, sf_dir)
    return rows.select("source_id", "track_id", "vehicle.class_name", "vehicle.observations", "plate.status", "plate.status_reason", "plate.text", "plate.formatted", "plate.confidence", "plate.best_frame", "evidence.fusion_method", "evidence.topk_selected", t.video_label(F.col("plate")).alias("label"))


#: Vehicles that stand still: each detection of at least `low` meets the source's track while that lives, which is until it has been missed for more than 5 frames; a surer one begins a track.
_STILL = """with d as (select *, row_number() over (partition by source_id order by frame_index) as r from still where det_index = 0 and conf >= 0.1e0),
  w as (select source_id, cast(0 as bigint) as r, -1 as frame_index, 0 as track_id, -1 as seen, 0 as first, 0 as hits, 0 as state from (select distinct source_id from d)
    union all select d.source_id, d.r, d.frame_index, w.track_id + cast(fresh as int), case when shown then d.frame_index else w.seen end, case when fresh then d.frame_index else w.first end,
      case when fresh then 1 when alive then w.hits + 1 else w.hits end, case when fresh then 1 when not alive then 0 when d.conf < 0.5e0 then 2 else 3 end + case when alive and d.frame_index - w.seen > 1 then 10 else 0 end
    from w join (select *, true as one from d) d on d.source_id = w.source_id and d.r = w.r + 1,
      lateral (select w.track_id > 0 and d.frame_index - w.seen <= 6 as alive), lateral (select not alive and d.conf >= 0.55e0 as fresh), lateral (select alive or fresh as shown)),
  o as (select source_id, frame_index, track_id, frame_index - first + 1 as age_frames, hits, state >= 10 as reidentified, state from w where r > 0 and state > 0),
  ends as (select source_id, max(frame_index) as last from still group by source_id),
  h as (select source_id, track_id, min(frame_index) as first_frame, max(frame_index) as last_frame, max(hits) as hits, any_value(last) as last from o join ends using (source_id) group by source_id, track_id)"""

#: The whole video path where the tracks follow from _STILL, the texts from place-by-place votes.
_PLATES = f"""with recursive still as ({fx.STILL}), crops as ({fx.CROPS}),
  trk as (with recursive {_STILL.removeprefix("with ")} select source_id, track_id, hits from h),
  fus as ({_VOTED.replace(_OWN, "1")}, f as (select b.track_id, case when method = 'sequence_alignment' then fused else raw_text end as raw_text, method, (0.5e0*ratio + 0.25e0*mo + 0.25e0*mq) * case when n_valid = 1 then 0.5e0 + 0.5e0/3 else 1 end as confidence from b join fu using (track_id) join s using (track_id)) select * from f),
  texts as (select source_id as track_id, 0 as frame_index, coalesce(raw_text, '') as raw_text, 'car' as class_name, coalesce(confidence, 0) as confidence, coalesce(method, 'no_valid_ocr') as method from (select distinct source_id from trk) left join fus on source_id = track_id),
  post as ({_TEXT} select o.*, texts.method, trim(o.raw_text) = '' as blank, coalesce(ffam <> family, false) as clash from o join texts using (track_id)),
  top as ({_CHOICE} select track_id, len(m) as topk, m[1].frame_index as best_frame from z where k = 1),
  q as (select source_id, trk.track_id, 'car' as class_name, hits as observations, post.* exclude (track_id), coalesce(not blank and not clash and good, false) as valid, coalesce(topk, 0) as topk_selected, best_frame from trk join post on source_id = post.track_id left join top on source_id = top.track_id),
  fin as (select source_id, track_id, class_name, observations, case when blank then 'no_ocr' when status = 'low_format_confidence' or clash then 'low_confidence' when not valid then 'unrecognized_format' when confidence < 0.5e0 then 'low_confidence' else 'ok' end as status,
    case when blank then 'no_ocr_candidates' when clash then 'vehicle_plate_family_mismatch' when not valid then reason when confidence < 0.5e0 then 'weak_ocr_evidence' end as status_reason,
    case when not blank then corrected end as text, case when valid then formatted end as formatted, valid, round_even(confidence, 6) as confidence, best_frame, method as fusion_method, topk_selected,
    coalesce(case when valid then nullif(formatted, '') end, case when not blank then nullif(norm, '') end) as label from q)"""


@query(_PLATES + " select source_id, track_id, class_name, observations, status, status_reason, text, formatted, confidence, best_frame, fusion_method, topk_selected, label from fin")
def still_plates(spark, sf_dir):
    """[JN14, PR17, PR23, TK4, TK5, FI13, SO2] The whole video path over vehicles that stand still."""
    rows = _video_rows(spark, sf_dir, fx.still, fx.voted)
    return rows.select("source_id", "track_id", "vehicle.class_name", "vehicle.observations", "plate.status", "plate.status_reason", "plate.text", "plate.formatted", "plate.confidence", "plate.best_frame", "evidence.fusion_method", "evidence.topk_selected", t.video_label(F.col("plate")).alias("label"))


@query(_PLATES + " select source_id, track_id, class_name as vehicle_type, formatted as license, confidence, status from fin where status = 'ok' and valid and length(formatted) > 0 and confidence >= 0.5e0")
def still_customers(spark, sf_dir):
    """[FI11, PR19, SC12]"""
    rows = _video_rows(spark, sf_dir, fx.still, fx.voted).withColumn("key", F.struct("source_id", "track_id"))
    return results.customer(rows, "key", 0.5, video=True).select("key.*", "vehicle_type", "license", "confidence", "status")


@query(None)
def video_customer_rows(spark, sf_dir):
    """[FI11, PR19, SC12]"""
    rows = _video_rows(spark, sf_dir).withColumn("key", F.struct("source_id", "track_id"))
    return results.customer(rows, "key", 0.5, video=True).select("key.*", "vehicle_type", "license", "confidence", "status")


# ---- tracks ------------------------------------------------------------------------------


@query(None)
def track_observations(spark, sf_dir):
    """[SS1, SS4, JN10, JN18, MA10, MA11, FI14]"""
    return tracking.observations(tracking.tracked(fx.observations(spark, sf_dir)))


@query(None)
def track_histories(spark, sf_dir):
    """[SS2, SS3, JN19, SU8, FI13]"""
    return tracking.surviving(tracking.histories(tracking.tracked(fx.observations(spark, sf_dir))))


@query(None)
def track_counters(spark, sf_dir):
    """[AG20]"""
    return tracking.counters(tracking.tracked(fx.observations(spark, sf_dir)), ["source_id"])


@query(_STILL + " select source_id, frame_index, 0 as det_index, track_id, age_frames, hits, reidentified from o", "still")
def still_observations(spark, sf_dir):
    """[SS1, SS4, JN10, JN18, MA10, MA11, FI14] Vehicles that stand still, so that tracks follow from times and confidences alone."""
    return tracking.observations(tracking.tracked(fx.still(spark, sf_dir)))


@query(_STILL + " select source_id, track_id, first_frame, last_frame, hits, case when last - last_frame > 5 then 'removed' when last > last_frame then 'lost' else 'active' end as status, case when last - last_frame > 5 then 'timeout' end as removal_reason from h", "still")
def still_histories(spark, sf_dir):
    """[SS2, SU8, FI13]"""
    return tracking.surviving(tracking.histories(tracking.tracked(fx.still(spark, sf_dir))))


@query(_STILL + """, n as (select source_id, count(*) filter (state = 1) as created, count(*) filter (state >= 10) as back, count(*) filter (state % 10 = 2) as second_stage from o group by source_id),
  g as (select source_id, count(*) filter (last > last_frame) as open_ends, count(*) filter (last - last_frame > 5) as removed from h group by source_id), t as (select source_id, count(*) as twins from still where det_index = 1 group by source_id)
  select source_id, created as tracks_created, back as tracks_reactivated, back + open_ends as tracks_lost, removed as tracks_removed, second_stage as second_stage_matches, cast(0 as bigint) as duplicate_tracks_removed, coalesce(twins, 0) as duplicate_detections_suppressed
  from n join g using (source_id) left join t using (source_id)""", "still")
def still_counters(spark, sf_dir):
    """[AG20, JN18]"""
    return tracking.counters(tracking.tracked(fx.still(spark, sf_dir)), ["source_id"])


#: Two tracks that coincide from frame 3 on: in frame 4 the younger goes, later boxes of it are hidden by the other track's.
_MERGING = "n as (select source_id, count(*) as n from merging where det_index = 0 group by source_id)"


@query(f"""with {_MERGING} select source_id, 1 as track_id, 0 as first_frame, n - 1 as last_frame, n as hits, 'active' as status, null as removal_reason from n
  union all select source_id, 2, 0, least(n - 1, 4), least(n, 5), case when n >= 5 then 'removed' else 'active' end, case when n >= 5 then 'duplicate' end from n""", "merging")
def merging_tracks(spark, sf_dir):
    """[SS3, JN19, SU8]"""
    out = tracking.histories(tracking.tracked(fx.merging(spark, sf_dir)))
    return out.select("source_id", "track_id", "first_frame", F.col("last_frame").cast("bigint").alias("last_frame"), F.col("hits").cast("bigint").alias("hits"), "status", "removal_reason")


@query(f"""with {_MERGING} select source_id, cast(2 as bigint) as tracks_created, cast(0 as bigint) as tracks_reactivated, cast(0 as bigint) as tracks_lost, cast(case when n >= 5 then 1 else 0 end as bigint) as tracks_removed,
  cast(0 as bigint) as second_stage_matches, cast(case when n >= 5 then 1 else 0 end as bigint) as duplicate_tracks_removed, greatest(n - 5, 0) as duplicate_detections_suppressed from n""", "merging")
def merging_counters(spark, sf_dir):
    """[AG20, SS3, JN18]"""
    return tracking.counters(tracking.tracked(fx.merging(spark, sf_dir)), ["source_id"])


@query(f"""with {_MERGING} select source_id, 1 as track_id from n union all select source_id, 2 from n where n < 5""", "merging")
def surviving_tracks(spark, sf_dir):
    """[FI13]"""
    return tracking.surviving(tracking.histories(tracking.tracked(fx.merging(spark, sf_dir)))).select("source_id", "track_id")


@query(f"""with n as (select source_id, {CLASS_NAME} as class_name, count(*) as n from obs group by all), k as (select *, row_number() over (partition by source_id order by n desc, class_name) as k from n)
  select source_id, max(class_name) filter (k = 1) as class_name, string_agg(class_name || ':' || n, ',' order by class_name) as counts from k group by source_id""", "obs")
def class_vote(spark, sf_dir):
    """[AG17]"""
    out = tracking.class_vote(_named(fx.observations(spark, sf_dir)), ["source_id"])
    listed = F.transform(F.array_sort(F.map_entries("class_counts")), lambda e: F.concat_ws(":", e["key"], e["value"]))
    return out.select("source_id", "class_name", F.array_join(listed, ",").alias("counts"))


@query("select source_id, min(frame_index) as first_frame, max(frame_index) as last_frame, count(*) as hits, max(frame_index) - min(frame_index) + 1 as age_frames from obs where det_index = 0 group by source_id", "obs")
def first_last_hits(spark, sf_dir):
    """[WI7]"""
    return tracking.seen_spans(fx.observations(spark, sf_dir).filter("det_index = 0"), ["source_id"])


@query("select source_id, frame_index, coalesce(frame_index - lag(frame_index) over (partition by source_id order by frame_index) - 1, -1) as missed_frames from obs where det_index = 0", "obs")
def missed_frames(spark, sf_dir):
    """[WI8]"""
    return tracking.missed(fx.observations(spark, sf_dir).filter("det_index = 0"), ["source_id"]).select("source_id", "frame_index", F.coalesce("missed_frames", F.lit(-1)).alias("missed_frames"))


@query("""with w as (select source_id, frame_index, frame_index - row_number() over (partition by source_id order by frame_index) as island from obs where det_index = 0)
  select source_id, frame_index, cast(row_number() over (partition by source_id, island order by frame_index) as int) as streak from w""", "obs")
def frame_streaks(spark, sf_dir):
    """[WI6]"""
    return tracking.streaks(fx.observations(spark, sf_dir).filter("det_index = 0"), ["source_id"]).select("source_id", "frame_index", "streak")


@query("select source_id, det_index, frame_index, cast(row_number() over (partition by source_id, frame_index order by det_index) - 1 as int) as candidate_index, conf >= 0.5e0 as high from obs where conf >= 0.1e0", "obs")
def candidate_index(spark, sf_dir):
    """[WI4, FI14, JN12]"""
    w = Window.partitionBy("source_id", "frame_index").orderBy("det_index")
    rows = fx.observations(spark, sf_dir).filter("conf >= 0.1")
    return rows.select("source_id", "det_index", "frame_index", (F.row_number().over(w) - 1).alias("candidate_index"), (F.col("conf") >= 0.5).alias("high"))


@query("""with a as (select distinct track_id from readings where raw_text <> ''), b as (select distinct source_id as track_id from obs where frame_index >= 100), u as (select track_id from a union select track_id from b)
  select u.track_id, a.track_id is not null as has_text, b.track_id is not null as has_late from u left join a on u.track_id = a.track_id left join b on u.track_id = b.track_id""", "readings obs")
def union_tracks(spark, sf_dir):
    """[SO2, SO4, JN15]"""
    a = fx.readings(spark, sf_dir).filter("raw_text <> ''").select("track_id").distinct().withColumn("has_text", F.lit(True))
    b = fx.observations(spark, sf_dir).filter("frame_index >= 100").select(F.col("source_id").alias("track_id")).distinct().withColumn("has_late", F.lit(True))
    u = a.select("track_id").union(b.select("track_id")).distinct()
    return u.join(a, "track_id", "left").join(b, "track_id", "left").na.fill(False, ["has_text", "has_late"])


@query("""select source_id, frame_index, det_index from obs where source_id in (select track_id from crops group by track_id having count(*) > 60)""", "obs crops")
def semi_draw(spark, sf_dir):
    """[JN16, SO5, SC14 to SC15: the rows to be drawn]"""
    kept = fx.crops(spark, sf_dir).groupBy(F.col("track_id").alias("source_id")).count().filter("count > 60")
    return fx.observations(spark, sf_dir).join(kept, "source_id", "left_semi").select("source_id", "frame_index", "det_index")


@query("""select source_id, frame_index, det_index from obs where (source_id, frame_index) not in (select track_id, frame_index from crops where sharpness_score >= 0.7e0)""", "obs crops")
def anti_unmatched(spark, sf_dir):
    """[JN17, SO3]"""
    sharp = fx.crops(spark, sf_dir).filter("sharpness_score >= 0.7").select(F.col("track_id").alias("source_id"), "frame_index")
    return fx.observations(spark, sf_dir).join(sharp, ["source_id", "frame_index"], "left_anti").select("source_id", "frame_index", "det_index")


@query("""select distinct source_id, frame_index, true as aligned from obs""", "obs")
def pass_alignment(spark, sf_dir):
    """[JN11, SC15]"""
    frames = fx.observations(spark, sf_dir).select("source_id", "frame_index").distinct()
    return results.aligned_frames(frames, frames, ["source_id", "frame_index"])


@query("""with e as (select track_id, frame_index, max(frame_index) over (partition by track_id order by (frame_index*7) % 11, frame_index rows between unbounded preceding and 1 preceding) as m from crops) select track_id, frame_index, coalesce(frame_index < m, false) as late from e""", "crops")
def late_evidence(spark, sf_dir):
    """[SS5] With an order of arrival that is not the frames'."""
    rows = fx.crops(spark, sf_dir).withColumn("arrival", F.col("frame_index") * 7 % 11)
    return evidence.late(rows, ["track_id"], ["arrival", "frame_index"]).select("track_id", "frame_index", "late")


# ---- requests and sinks ------------------------------------------------------------------

_LINE = """case event_id % 8 when 0 then '{"id": "' || event_id || '", "action": "ping"}' when 1 then '{"id": "' || event_id || '", "action": "process", "type": "image", "path": "/in/a' || user_id || '.JPG"}'
  when 2 then '{"id": "' || event_id || '", "action": "process", "type": "video", "path": "/in/v.mp4"}' when 3 then '{"id": "' || event_id || '", "action": "process", "type": "video", "path": "/in/v.png"}'
  when 4 then 'not json {' when 5 then '{"id": "' || event_id || '", "action": "dance"}' when 6 then '{"id": "' || event_id || '", "action": "process", "type": "image", "path": " "}' else '{"action": "shutdown"}' end"""


@query("""select event_id, case when event_id % 8 in (4, 7) then '' else cast(event_id as varchar) end as request_id, case event_id % 8 when 0 then 'ping' when 4 then null when 5 then 'dance' when 7 then 'shutdown' else 'process' end as action,
  case event_id % 8 when 4 then 'JSONDecodeError' when 3 then 'ValueError' when 5 then 'ValueError' when 6 then 'ValueError' end as error_code,
  case event_id % 8 when 3 then 'Unsupported type or extension: video, .png' when 4 then 'not a JSON object' when 5 then 'Unsupported action: dance' when 6 then 'path must be a nonempty string' end as error_message from events""")
def request_parse(spark, sf_dir):
    """[SC2, SC5, SS9, SS10]"""
    from quillon.streaming.requests import parsed

    lines = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.expr(_LINE).alias("value"))
    return parsed(lines).select("event_id", "request_id", "action", "error_code", "error_message")


@query("""select event_id, 'clip' || user_id || '_' || strftime(ts, '%Y%m%d_%H%M%S') || '_' || substr(md5(cast(event_id as varchar)), 1, 8) as folder,
  'clip' || user_id || '.json' as file, case when event_id % 2 = 0 then 'image' else 'video' end as media_type, 'track_' || user_id || '/top' || (event_id % 4 + 1) || '_frame' || lpad(cast(event_id as varchar), 6, '0') || '.jpg' as crop from events""")
def output_paths(spark, sf_dir):
    """[SC16, SC17, DA4, SO1]"""
    from quillon.sources import media, sinks

    path = F.concat(F.lit("/in/clip"), F.col("user_id").cast("string"), F.when(F.col("event_id") % 2 == 0, ".PNG").otherwise(".mkv"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("path", path)
    folder = sinks.run_folder(F.col("path"), F.col("ts"), F.md5(F.col("event_id").cast("string")))
    file = F.substring_index(sinks.output_path(F.col("path"), folder), "/", -1)
    return rows.select("event_id", folder.alias("folder"), file.alias("file"), media.media_type(F.col("path")).alias("media_type"), sinks.crop_path(F.col("user_id"), F.col("event_id") % 4 + 1, F.col("event_id")).alias("crop"))


@query(f"select cast(i as int) as class_id, substr('{t.DIGITS + t.LETTERS}', cast(i + 1 as int), 1) as char from range(36) r(i)")
def class_map(spark, sf_dir):
    """[SC9] Characters from a model's metadata."""
    from quillon.sources import media

    return media.class_table(spark, str(dict(enumerate(t.DIGITS + t.LETTERS))))


@query(_PLATES + " select source_id, track_id, status, coalesce(formatted, '') as formatted, confidence, observations from fin")
def video_json(spark, sf_dir):
    """[SC11] Rows of the video path, read back from the lines that the sink writes."""
    from quillon.sources import sinks

    lines = sinks.as_json(_video_rows(spark, sf_dir, fx.still, fx.voted))
    r = F.from_json("value", "source_id bigint, track_id int, vehicle struct<observations:int>, plate struct<status:string,formatted:string,confidence:double>")
    return lines.select(r.alias("r")).select("r.source_id", "r.track_id", "r.plate.status", F.coalesce("r.plate.formatted", F.lit("")).alias("formatted"), "r.plate.confidence", "r.vehicle.observations")


@query(None)
def draw_labels(spark, sf_dir):
    """[SC14, SC15, PR23, JN16]"""
    from quillon.sources import sinks

    box = F.struct("x1", "y1", "x2", "y2").alias("box")
    tracks = tracking.observations(tracking.tracked(fx.observations(spark, sf_dir))).select("source_id", "frame_index", "det_index", "track_id")
    rows = _named(fx.observations(spark, sf_dir)).join(tracks, ["source_id", "frame_index", "det_index"]).withColumnRenamed("conf", "confidence")
    rows = rows.select("source_id", "track_id", "frame_index", box, "class_name", "confidence")
    made = sinks.labels(rows, rows.withColumn("candidate_index", F.lit(0)), _video_rows(spark, sf_dir), ["source_id", "track_id"], debug=True)
    return made.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("label").alias("n_labels"))
