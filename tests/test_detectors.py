"""Adapters of inference sessions, with stand-in sessions."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pytest

from quillon.sources import detectors as d

PICTURE = np.random.default_rng(1).integers(0, 256, (60, 100, 3)).astype(np.uint8)


class Session:
    def __init__(self, output):
        self.output = output

    def get_inputs(self):
        return [SimpleNamespace(name="in")]

    def get_outputs(self):
        return [SimpleNamespace(name="out")]

    def run(self, names, inputs):
        assert names == ["out"] and inputs["in"].dtype == np.float32 and inputs["in"].max() <= 1
        self.shape = inputs["in"].shape
        return [self.output]


def raw(rows, classes):
    """rows: (centre x, centre y, width, height, class, confidence)."""
    out = np.zeros((1, 4 + classes, len(rows)), np.float32)
    for i, (*box, kind, p) in enumerate(rows):
        out[0, :4, i], out[0, 4 + kind, i] = box, p
    return out


def test_letterbox_and_back():
    tensor, box = d.Letterbox.put(PICTURE, 200, 200)
    assert tensor.shape == (1, 3, 200, 200) and (box.scale, box.left, box.top) == (2.0, 0, 40)
    assert tensor[0, :, 0, 0] == pytest.approx([114 / 255] * 3)
    assert box.back(np.array([[20.0, 60, 100, 120], [-5, 0, 500, 500]])).tolist() == [[10, 10, 50, 40], [0, 0, 100, 60]]
    same, _ = d.Letterbox.put(PICTURE, 100, 60)
    assert np.rint(same[0, 0] * 255).astype(int).tolist() == PICTURE[..., 2].tolist()
    with pytest.raises(ValueError):
        d.Letterbox.put(np.zeros((0, 3, 3), np.uint8), 10, 10)


def test_vehicles_by_class():
    rows = [(50, 70, 40, 40, 2, 0.9), (52, 70, 40, 40, 2, 0.8), (52, 70, 40, 40, 7, 0.7), (50, 70, 40, 40, 0, 0.99), (150, 100, 20, 20, 2, 0.2), (150, 100, 0, 20, 2, 0.9)]
    found = d.vehicles(Session(raw(rows, 80)), (200, 200)).detect(PICTURE)
    assert [(f.class_name, round(f.confidence, 2), f.bbox) for f in found] == [("car", 0.9, (15, 5, 35, 25)), ("truck", 0.7, (16, 5, 36, 25))]


def test_plates_over_all_classes():
    rows = [(50, 70, 40, 40, 0, 0.9), (52, 70, 40, 40, 1, 0.8), (150, 100, 20, 20, 1, 0.6)]
    found = d.plates(Session(raw(rows, 2)), (200, 200)).detect(PICTURE)
    assert [(f.class_name, f.bbox) for f in found] == [("vuong", (15, 5, 35, 25)), ("dai", (70, 25, 80, 35))]


@pytest.mark.parametrize("processed", [False, True])
def test_two_rows_of_characters(processed):
    names = list("0123456789AB")
    rows = [(20 + 30 * k, 60, 16, 24, k, 0.9 - k / 100) for k in range(3)] + [(20 + 30 * k, 130, 16, 24, 9 - k, 0.8) for k in range(4)]
    rows += [(20, 61, 16, 24, 11, 0.5), (90, 60, 16, 24, 5, 0.1)]  # a second reading of the first, a doubtful one
    if processed:
        output = np.array([[[x - w / 2, y - h / 2, x + w / 2, y + h / 2, p, kind] for x, y, w, h, kind, p in rows]], np.float32)
    else:
        output = raw(rows, len(names))
    r = d.Characters(Session(output), (200, 200), names).recognize(PICTURE)
    assert r.text == "0129876" and r.lines == 2 and r.confidence == pytest.approx((0.9 + 0.89 + 0.88 + 4 * 0.8) / 7, abs=1e-6)
    assert r.fates[-2:] == ("suppressed_nms", "below_confidence") and set(r.fates[:-2]) == {"final"}


def test_nothing_found_and_bad_output():
    r = d.Characters(Session(raw([(1, 1, 1, 1, 0, 0.1)], 3)), (200, 200), list("abc")).recognize(PICTURE)
    assert (r.text, r.confidence, r.char_confidences) == ("", 0.0, ())
    with pytest.raises(ValueError):
        d.Characters(Session(np.zeros((1, 9, 5), np.float32)), (200, 200), list("abc")).recognize(PICTURE)
    with pytest.raises(ValueError):
        d.Characters(Session(np.array([[[0, 0, 9, 9, 0.9, 7]]], np.float32)), (200, 200), list("abc")).recognize(PICTURE)
