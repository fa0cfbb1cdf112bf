"""Derived tables of boxes, observations, readings and crops, in SQL that Spark and DuckDB read alike.

The driver's tables hold no detections; these recipes make them from lineitem and
events by integer arithmetic, so both engines build the same rows. Each uses the
whole table; READINGS keeps the four best readings of a track, as fusion does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BOXES = """select l_orderkey as frame_id, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as int) as i,
  cast(case l_suppkey % 4 when 0 then 2 when 1 then 3 when 2 then 5 else 7 end as int) as class_id,
  ((l_partkey*7 + l_suppkey*11 + l_linenumber*13) % 1000) / 1000e0 as conf,
  cast(l_partkey*3 % 60 as double) as x1, cast(l_suppkey*5 % 40 as double) as y1,
  cast(l_partkey*3 % 60 + 40 + cast(l_quantity as int) % 20 as double) as x2,
  cast(l_suppkey*5 % 40 + 30 + l_linenumber*2 as double) as y2 from lineitem"""

OBSERVATIONS = """with e as (select user_id, event_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) as fi from events),
k as (select * from e where event_id % 7 <> 0 and not (user_id % 2 = 0 and fi between 20 and 27))
select user_id as source_id, fi as frame_index, 0 as det_index, cast(case when event_id % 11 = 0 then 7 else 2 end as int) as class_id,
  case event_id % 10 when 0 then 0.05e0 when 1 then 0.30e0 when 2 then 0.52e0 else (60 + event_id % 30) / 100e0 end as conf,
  cast(10 + fi*2 + event_id % 3 as int) as x1, cast(10 + event_id % 2 as int) as y1, cast(50 + fi*2 + event_id % 3 as int) as x2, cast(40 + event_id % 2 as int) as y2 from k
union all
select user_id, fi, 1, 2, (60 + event_id % 35) / 100e0, cast(190 - fi*2 as int), 12, cast(230 - fi*2 as int), 42 from k where user_id % 3 = 0"""

#: Sources with one vehicle that stands still, seen more or less surely; every third source has a second box over each sure one.
STILL = """with e as (select user_id, event_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) as fi from events),
k as (select *, case event_id % 10 when 0 then 0.05e0 when 1 then 0.30e0 when 2 then 0.52e0 else (60 + event_id % 30) / 100e0 end as conf from e where event_id % 7 <> 0 and event_id % 11 < 8 and not (user_id % 2 = 0 and fi between 20 and 27))
select user_id as source_id, fi as frame_index, 0 as det_index, cast(2 as int) as class_id, conf, cast(10 + user_id % 7 as int) as x1, 10 as y1, cast(50 + user_id % 7 as int) as x2, 40 as y2 from k
union all
select user_id, fi, 1, 2, conf, cast(12 + user_id % 7 as int), 10, cast(52 + user_id % 7 as int), 40 from k where user_id % 3 = 0 and conf >= 0.55e0"""

#: Sources with two vehicles of which the second moves up to the first and stays there.
MERGING = """with e as (select user_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) as fi from events)
select user_id as source_id, fi as frame_index, 0 as det_index, 2 as class_id, 0.9e0 as conf, cast(10 + user_id % 7 as int) as x1, 10 as y1, cast(50 + user_id % 7 as int) as x2, 40 as y2 from e
union all
select user_id, fi, 1, 2, 0.9e0, cast(10 + user_id % 7 + greatest(20 - 6*fi, 2) as int), 10, cast(50 + user_id % 7 + greatest(20 - 6*fi, 2) as int), 40 from e"""

#: One plate a frame in a vehicle's box of 200 x 100, which now and then jumps, grows or leaves the box.
LONE = """with e as (select user_id, event_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) as fi from events),
k as (select *, cast(80 + event_id % 9 + case when event_id % 13 = 0 then 70 else 0 end as double) as x1, cast(60 + event_id % 5 + case when event_id % 17 = 0 then 60 else 0 end as double) as y1, cast(event_id % 3 + case when event_id % 19 = 0 then 80 else 0 end as double) as more from e)
select user_id as source_id, fi as frame_index, x1, y1, x1 + 40 + more as x2, y1 + 15 as y2, (400 + (event_id*53) % 600) / 1000e0 as pc, (250 + (event_id*13) % 700) / 1000e0 as vc from k"""

EVERY = """with p as (select user_id, event_id, concat(cast(50 + user_id % 10 as varchar(2)), substr('ABCDEFGHKLMNPSTUVXYZ', cast(1 + user_id % 20 as int), 1), lpad(cast((user_id*7919) % 100000 as varchar(5)), 5, '0')) as plate from events),
r as (select *, cast(row_number() over (partition by user_id order by (event_id*29) % 400 desc, event_id) as int) as rk from p)
select user_id as track_id, cast(event_id as int) as frame_index, rk as rank,
  case (event_id*31 + user_id) % 8 when 4 then concat(substr(plate,1,5), 'O', substr(plate,7)) when 5 then concat(substr(plate,1,4), substr(plate,6))
    when 6 then concat(substr(plate,1,3), 'X', substr(plate,4)) when 7 then '' else plate end as raw_text,
  (500 + (event_id*17) % 500) / 1000e0 as ocr_confidence, (600 + (event_id*29) % 400) / 1000e0 as quality_score
from r"""

#: Of each track the four best readings, which is what fusion gets.
READINGS = EVERY + " where rk <= 4"

#: Four readings of a track, most of them with one wrong character, so that they align place by place.
VOTED = """with r as (select *, cast(row_number() over (partition by track_id order by rank) as int) as k from ({readings}) z where length(raw_text) = 8 and raw_text not like '%O%' and raw_text not like '%X%')
select track_id, frame_index, k as rank, case when frame_index % 4 = 0 then raw_text else concat(substr(raw_text, 1, frame_index % 8), case when frame_index % 3 = 0 then 'Q' else 'W' end, substr(raw_text, frame_index % 8 + 2)) end as raw_text, ocr_confidence, quality_score from r where k <= 4""".format(readings=EVERY)

CROPS = """with e as (select user_id, event_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) as fi from events)
select user_id as track_id, fi as frame_index, 0 as candidate_index, cast(30 + (event_id*7) % 60 as int) as width, cast(18 + (event_id*5) % 40 as int) as height,
  ((event_id*37) % 1000) / 1000e0 as sharpness_score, (400 + (event_id*53) % 600) / 1000e0 as total_score, (250 + (event_id*13) % 700) / 1000e0 as plate_confidence from e"""

#: Plate texts: a reading of every event, each with a vehicle class, some spoiled in ways that the text rules name.
TEXTS = """select track_id, frame_index, case frame_index % 9 when 0 then concat(' ', lower(raw_text), ' ') when 1 then concat(substr(raw_text,1,3), '-', substr(raw_text,4)) when 2 then replace(raw_text, '0', 'o')
    when 3 then concat(substr(raw_text,1,2), '8', substr(raw_text,4)) when 4 then concat('13', substr(raw_text,3)) when 5 then concat(substr(raw_text,1,3), '7', substr(raw_text,4))
    when 6 then replace(replace(raw_text, '1', 'I'), '5', 'S') when 7 then concat(substr(raw_text,1,6), '?', substr(raw_text,8)) else raw_text end as raw_text,
  case track_id % 4 when 0 then 'car' when 1 then 'motorcycle' when 2 then 'truck' else 'person' end as class_name, ocr_confidence as confidence from every"""

#: Plate candidates of a frame: a part of each box of lineitem, owned by its line.
CANDIDATES = """select frame_id, i as candidate_index, cast(i % 3 as int) as track_id, cast(i % 3 as int) as vehicle_index, x1 as vx1, y1 as vy1, x2 as vx2, y2 as vy2,
  20e0 + (i % 2) * 2 as px1, 25e0 as py1, 50e0 + (i % 4) as px2, 40e0 + class_id % 3 as py2, conf as plate_confidence, (cast(conf * 1000 as int) * 7 % 1000) / 1000e0 as vehicle_confidence,
  cast(conf * 1000 as int) % 17 = 0 as coordinate_clamped from boxes"""


def kept(df: DataFrame) -> DataFrame:
    """``df`` for several uses: a checkpoint where the session names a shared folder, which the cleaner removes with it; else in memory."""
    folder, context = df.sparkSession.conf.get("spark.checkpoint.dir", None), df.sparkSession.sparkContext
    if not folder:
        return df.persist()
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return df.checkpoint()


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(BOXES.replace("from lineitem", "from {lineitem}"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def _events(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("from events", "from {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, OBSERVATIONS)


def still(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, STILL)


def merging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, MERGING)


def lone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, LONE)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, READINGS)


def voted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, VOTED)


def crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, CROPS)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TEXTS.replace("from every", "from {every}"), every=_events(spark, sf_dir, EVERY))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = spark.sql(CANDIDATES.replace("from boxes", "from {boxes}"), boxes=boxes(spark, sf_dir))
    box = lambda p: f"struct({p}x1 as x1, {p}y1 as y1, {p}x2 as x2, {p}y2 as y2)"
    return flat.selectExpr("frame_id", "candidate_index", "track_id", "vehicle_index", f"{box('p')} as plate", f"{box('v')} as vehicle", "plate_confidence", "vehicle_confidence", "coordinate_clamped")


#: The same as common table expressions for SQL.
WITH = {"boxes": BOXES, "obs": OBSERVATIONS, "still": STILL, "lone": LONE, "merging": MERGING, "every": EVERY, "readings": READINGS, "crops": CROPS, "texts": TEXTS, "candidates": CANDIDATES}


def sql(names: str, body: str) -> str:
    """``body`` (a query, or common table expressions and one) over the named derived tables, in order."""
    parts = ", ".join(f"{n} as ({WITH[n]})" for n in names.split())
    head, rest = ("with recursive ", body.strip())
    if rest.startswith("with "):
        return f"{head}{parts}, {rest[5:]}"
    return f"{head}{parts} {rest}"
