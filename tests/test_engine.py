"""Whole runs with stand-in models."""

from __future__ import annotations

import json
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.__main__ import main
from quillon.engine import Engine, checked
from quillon.sources import media


class Vehicles:
    def detect(self, picture):
        return [SimpleNamespace(class_id=2, class_name="car", confidence=0.9, bbox=(10, 10, 130, 110))]


class Plates:
    def detect(self, region):
        return [SimpleNamespace(class_id=1, class_name="dai", confidence=0.9, bbox=(30, 50, 90, 80))]


class Reader:
    def recognize(self, crop):
        return SimpleNamespace(text="72a16231", confidence=0.9, char_confidences=(0.9,) * 8)


def noise(seed):
    return np.random.default_rng(seed).integers(0, 256, (120, 160, 3)).astype(np.uint8)


@pytest.fixture
def engine(spark):
    return Engine(spark, Vehicles, Plates, Reader, name="test-engine")


def test_images(engine, spark, tmp_path):
    for k in range(2):
        (tmp_path / f"{k}.png").write_bytes(media.to_netpbm(noise(k)))
    rows, seen = engine.observed(engine.images(str(tmp_path)))
    engine.write(rows, str(tmp_path / "out"))
    got = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(got) == 2 and seen.get == {"rows": 2, "ok": 2}
    assert all(r["plate"]["formatted"] == "72A-162.31" and r["plate"]["best_bbox_xyxy"] == [40, 60, 100, 90] and r["plate"]["layout"] == "dai" for r in got)


def test_videos(engine, spark):
    frames = spark.createDataFrame([("v", i, bytearray(media.to_netpbm(noise(i)))) for i in range(12)], "source string, frame_index int, content binary")
    rows = engine.videos(frames.repartition(3), 10.0).collect()
    assert len(rows) == 1
    r = rows[0]
    assert r.track_id == 1 and r.vehicle.observations == 12 and r.vehicle.class_counts == {"car": 12}
    assert r.plate.status == "ok" and r.plate.formatted == "72A-162.31" and r.plate.plate_observations == 12 and r.evidence.topk_selected == 3


def test_rules_of_rows(spark):
    df = spark.createDataFrame([(1,), (-1,)], "a int")
    assert checked(df.limit(1), rank_must_not_be_negative=F.col("a") >= 0).count() == 1
    with pytest.raises(Exception, match="rank must not be negative"):
        checked(df, rank_must_not_be_negative=F.col("a") >= 0).collect()


def test_command_line_options(capsys):
    assert main(["--input", "x"]) == 2
    assert main(["--input", "x", "--output", "y", "--models", "no_such_module"]) == 1
    assert "no_such_module" in capsys.readouterr().err


def video(path, n=6):
    np.savez(path, frames=np.stack([noise(i) for i in range(n)]), fps=10.0)


class Stubs:
    """A module of models for the command line."""

    vehicles, plates, reader = (staticmethod(lambda device, f=f: f()) for f in (Vehicles, Plates, Reader))
    decode, encode = staticmethod(media.netpbm), staticmethod(media.to_netpbm)


@pytest.fixture
def stubs(monkeypatch, spark, tmp_path):
    import sys

    monkeypatch.setitem(sys.modules, "stub_models", Stubs)
    monkeypatch.chdir(tmp_path)
    return tmp_path


def test_annotated_image_and_crop(engine, spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.png").write_bytes(media.to_netpbm(noise(1)))
    run = engine.image_run(str(tmp_path / "in"))
    engine.save_annotated(run, str(tmp_path / "out"))
    engine.save_crops(run, str(tmp_path / "out"), ".ppm")
    run.close()
    made, plain = media.netpbm((tmp_path / "out/a_annotated.ppm").read_bytes()), noise(1)
    assert tuple(made[110, 70]) == (0, 200, 0) and tuple(made[60, 70]) == (0, 0, 255)  # the vehicle's lower edge, the plate's upper
    changed = (made != plain).any(axis=2)
    assert changed[40:56, 40:110].any() and not changed[65:85, 45:95].any()  # a label above the plate, nothing inside
    assert (media.netpbm((tmp_path / "out/crops/a/vehicle_0.ppm").read_bytes()) == plain[60:90, 40:100]).all()


def test_video_from_the_command_line(stubs, capsys):
    video(stubs / "clip.npz")
    assert main(["--input", "clip.npz", "--output", "out", "--models", "stub_models", "--save-topk-crops"]) == 0
    data = np.load(stubs / "out/clip_annotated.npz")
    assert len(data["frames"]) == 6 and float(data["fps"]) == 10.0
    assert all(tuple(f[110, 70]) == (0, 200, 0) for f in data["frames"])
    crops = sorted(p.relative_to(stubs / "out/crops/clip").as_posix() for p in (stubs / "out/crops/clip").rglob("*.ppm"))
    assert crops and all(c.startswith("track_1/top") for c in crops)
    assert "Plates: 1" in capsys.readouterr().out


def test_release_names_its_folder(stubs):
    (stubs / "a.png").write_bytes(media.to_netpbm(noise(1)))
    assert main(["--input", "a.png", "--models", "stub_models", "--release"]) == 0
    (folder,) = stubs.glob("a_2*")
    assert (folder / "a_annotated.ppm").exists() and list((folder / "json").glob("part-*"))
    assert main(["--input", "a.png", "--models", "stub_models", "--release", "--output", "x"]) == 1
    assert main(["--input", "a.txt", "--models", "stub_models", "--output", "x"]) == 1
    assert main(["--models", "stub_models", "--save-annotated"]) == 2


def test_requests_from_standard_input(stubs, monkeypatch, capsys):
    import io

    (stubs / "a.png").write_bytes(media.to_netpbm(noise(1)))
    lines = [{"id": "1", "action": "ping"}, {"id": "2", "action": "process", "type": "image", "path": "a.png"}, {"id": "3", "action": "process", "type": "image", "path": "none.png"}, {"id": "4", "action": "shutdown"}, {"id": "5", "action": "ping"}]
    monkeypatch.setattr("sys.stdin", io.StringIO("\n".join([json.dumps(x) for x in lines[:2]] + ["", "not json"] + [json.dumps(x) for x in lines[2:]])))
    assert main(["--models", "stub_models"]) == 0
    out = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [x.get("event") for x in out[:2]] == ["starting", "ready"]
    assert [(x.get("request_id", ""), x["status"]) for x in out[2:]] == [("1", "success"), ("2", "success"), ("", "error"), ("", "error"), ("3", "error"), ("4", "success")]
    assert out[3]["count"] == 1 and out[3]["plates"][0]["plate_text"] == "72A-162.31" and out[3]["output_image"].endswith("a_annotated.ppm")
    assert out[6]["error"]["code"] == "FileNotFoundError"
