"""Sources, sinks and streams, with stand-in models."""

from __future__ import annotations

import json
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import tracking
from quillon.sources import media, sinks
from quillon.streaming import requests
from quillon.streaming.tracks import tracked_stream
from tests.test_core import observations


class Detector:
    def detect(self, picture):
        return [SimpleNamespace(class_id=2, class_name="car", confidence=0.9, bbox=(1, 2, picture.shape[1], picture.shape[0]))]


class Reader:
    def recognize(self, crop):
        if crop.mean() < 1:
            raise ValueError("dark")
        return SimpleNamespace(text="72A16231", confidence=0.9, char_confidences=(0.9,) * 8)


def test_images_through_detector_and_reader(spark, tmp_path):
    (tmp_path / "a.PNG").write_bytes(media.to_netpbm(np.full((20, 30, 3), 180, np.uint8)))
    (tmp_path / "b.jpg").write_bytes(b"not a picture")
    (tmp_path / "c.txt").write_bytes(b"ignored")
    files = media.image_files(spark, str(tmp_path))
    rows = media.detected(files, media.netpbm, Detector, "test-detector").collect()
    good = [r for r in rows if r.error is None]
    assert len(rows) == 2 and [(r.x1, r.y1, r.x2, r.y2, r.width, r.height) for r in good] == [(1, 2, 30, 20, 30, 20)]
    box = F.struct(F.lit(0).alias("x1"), F.lit(0).alias("y1"), F.lit(8).alias("x2"), F.lit(6).alias("y2"))
    read = media.read_crops(files.withColumn("plate", box), media.netpbm, Reader, "test-reader").collect()
    assert sorted((r.status, r.raw_text) for r in read) == [("decode_failed", ""), ("ok", "72A16231")]
    with pytest.raises(Exception, match="Exception|Error"):
        media.read_crops(files.withColumn("plate", box), media.netpbm, Reader, "test-reader", isolate=False).collect()


def test_pixel_statistics():
    flat = media.pixel_statistics(np.full((10, 12, 3), 128, np.uint8))
    assert flat == {"width": 12, "height": 10, "sharpness_raw": 0.0, "dark_ratio": 0.0, "bright_ratio": 0.0}
    board = np.indices((8, 8)).sum(axis=0) % 2 * 255
    sharp = media.pixel_statistics(np.repeat(board[..., None], 3, axis=2).astype(np.uint8))
    assert sharp["sharpness_raw"] == (255 * 4) ** 2 and sharp["dark_ratio"] == sharp["bright_ratio"] == 0.5
    assert media.resized(np.arange(8.0).reshape(2, 4), 2, 1).tolist() == [[2.5, 4.5]]
    with pytest.raises(ValueError):
        media.pixel_statistics(np.zeros((0, 3, 3)))


def test_class_metadata(spark):
    assert media.class_names("{1: 'B', 0: 'A'}") == ["A", "B"] == media.class_names("['A', 'B']")
    assert {(r.class_id, r.char) for r in media.class_table(spark, "['A', 'B']").collect()} == {(0, "A"), (1, "B")}
    for bad in ("{1: 'B'}", "['AB']", "[]"):
        with pytest.raises(ValueError):
            media.class_names(bad)
    assert media.output_format((1, 9, 6), 36) == "end2end" and media.output_format((1, 40, 100), 36) == "raw"


def test_video_frames_source(spark, tmp_path):
    for k in range(2):
        np.savez(tmp_path / f"v{k}.npz", frames=np.full((5, 4, 6, 3), k, np.uint8), fps=10.0)
    spark.dataSource.register(media.VideoFrames)
    paths = "\n".join(str(tmp_path / f"v{k}.npz") for k in range(2))
    rows = spark.read.format("quillon_video").option("paths", paths).option("max_frames", 3).load()
    got = sorted((r.source[-6:], r.frame_index, r.timestamp_seconds, r.width, r.height) for r in rows.collect())
    assert got == [(f"v{k}.npz", i, i / 10, 6, 4) for k in range(2) for i in range(3)]
    assert rows.rdd.getNumPartitions() == 2


def test_json_sink_writes_nulls_and_rejects_nan(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 0.5)], "a int, b string, c double")
    sinks.write_json(df, str(tmp_path / "out"))
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()] == [{"a": 1, "b": None, "c": 0.5}]
    with pytest.raises(Exception, match="not finite"):
        sinks.as_json(df.withColumn("c", F.lit(float("nan")))).collect()


def test_drawings():
    out = sinks.draw(np.zeros((10, 10, 3), np.uint8), [(2, 2, 7, 7), (-3, -3, 50, 50)], (9, 9, 9), 1)
    assert (out[2, 2:8] == 9).all() and (out[4, 4] == 0).all() and (out[0] == 9).all()


LINES = ['{"id": "1", "action": "ping"}', "{broken", "[1]", '{"id": "2", "action": "process", "type": "image", "path": "/x/a.JPG"}', '{"id": "3", "action": "process", "type": "video", "path": "/x/a.jpg"}', '{"id": "4", "action": "shutdown"}', '{"id": "5", "action": "ping"}']


def test_requests_are_answered_in_order_until_shutdown(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "requests.txt").write_text("\n".join(f"{i}\t{x}" for i, x in enumerate(LINES)))
    stream = spark.readStream.text(str(tmp_path / "in")).select(F.substring_index("value", "\t", 1).cast("int").alias("ordinal"), F.expr("substr(value, instr(value, '\t') + 1)").alias("value"))
    said: list[str] = []
    query = requests.serve(stream, lambda r: {"status": "success", "path": r["path"]}, said.append, str(tmp_path / "state"))
    query.awaitTermination(60)
    out = [json.loads(x) for x in said]
    assert [o.get("event") for o in out[:2]] == ["starting", "ready"]
    assert [(o.get("request_id"), o["status"]) for o in out[2:]] == [("1", "success"), ("", "error"), ("", "error"), ("2", "success"), ("3", "error"), ("4", "success")]
    assert out[3]["error"]["code"] == "JSONDecodeError" and out[5]["path"] == "/x/a.JPG" and query.stopped_by_request()


def test_a_stream_tracks_as_a_batch_does(spark, tmp_path):
    df = observations(spark)
    for k, (lo, hi) in enumerate(((0, 7), (7, 13), (13, 99))):
        df.filter(f"frame_index >= {lo} and frame_index < {hi}").coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    query = tracked_stream(stream).writeStream.outputMode("append").foreachBatch(lambda b, _: b.write.mode("append").parquet(out)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    rows = spark.read.parquet(out)
    key = lambda r: str(tuple(r))
    assert sorted(tracking.observations(rows).collect(), key=key) == sorted(tracking.observations(tracking.tracked(df)).collect(), key=key)
    latest = {(r.source_id, r.track_id): r.hits for r in rows.filter("kind = 'track'").orderBy("hits").collect()}
    assert latest == {(r.source_id, r.track_id): r.hits for r in tracking.histories(tracking.tracked(df)).collect()}
