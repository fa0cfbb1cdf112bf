"""Adapters from inference sessions to the engine's models (SC6 to SC8, PR1 to PR6, AG1 to AG3, WI2, WI3, UD3, SU1, SU6).

A session has .run(outputs, inputs), .get_inputs() and .get_outputs(), as those of
ONNX Runtime have; `quillon.sources.media.onnx_model` makes one and checks its
contract. All steps work on whole arrays of a picture's raw rows, in the worker
that decoded it; the same rules as Column expressions are in quillon.functions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from quillon.config import PLATE_CLASSES, VEHICLE_CLASSES, Detection, need
from quillon.sources.media import output_format

#: Grey of the letterbox's border; a fixed value.
BORDER = 114


@dataclass(frozen=True)
class Found:
    class_id: int
    class_name: str
    confidence: float
    bbox: tuple[int, int, int, int]


@dataclass(frozen=True)
class Reading:
    text: str
    confidence: float
    char_confidences: tuple[float, ...]
    lines: int = 0
    #: Fate of each raw row.
    fates: tuple[str, ...] = field(default=(), repr=False)


def stretched(picture: np.ndarray, w: int, h: int) -> np.ndarray:
    """Linear interpolation between pixel centres."""
    out = picture.astype(np.float64)
    for axis, n in ((0, h), (1, w)):
        old = out.shape[axis]
        if n == old:
            continue
        place = np.clip((np.arange(n) + 0.5) * old / n - 0.5, 0, old - 1)
        low = np.floor(place).astype(int)
        part = (place - low).reshape([-1 if k == axis else 1 for k in range(3)])
        out = out.take(low, axis) * (1 - part) + out.take(np.minimum(low + 1, old - 1), axis) * part
    return np.rint(out).astype(np.uint8)


@dataclass(frozen=True)
class Letterbox:
    """PR2, PR3: a picture scaled into a frame of fixed size, in the middle."""

    w: int
    h: int
    scale: float
    left: int
    top: int

    @classmethod
    def put(cls, picture: np.ndarray, w: int, h: int, characters: bool = False) -> tuple[np.ndarray, Letterbox]:
        need(isinstance(picture, np.ndarray) and picture.ndim == 3 and picture.shape[2] == 3 and picture.size > 0, "a picture must be an array of height x width x 3")
        old_h, old_w = picture.shape[:2]
        scale = min(w / old_w, h / old_h)
        if characters:
            new_w, new_h = max(1, round(old_w * scale)), max(1, round(old_h * scale))
            left, top = round((w - new_w) / 2 - 0.1), round((h - new_h) / 2 - 0.1)
        else:
            new_w, new_h = min(w, round(old_w * scale)), min(h, round(old_h * scale))
            left, top = (w - new_w) // 2, (h - new_h) // 2
        frame = np.full((h, w, 3), BORDER, np.uint8)
        frame[top : top + new_h, left : left + new_w] = stretched(picture, new_w, new_h)
        tensor = np.ascontiguousarray(frame[..., ::-1].transpose(2, 0, 1)[None], np.float32) / np.float32(255)
        return tensor, cls(old_w, old_h, scale, left, top)

    def back(self, boxes: np.ndarray) -> np.ndarray:
        """PR4: boxes of the frame in the picture, clipped."""
        at = (boxes - np.array([self.left, self.top] * 2)) / self.scale
        return np.clip(at, 0, [self.w, self.h] * 2)


def rows_of(output: np.ndarray, classes: int, processed: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """SU6: boxes (x1..y2 of the frame), confidences and class ids of the raw rows; rows that a model may have ``processed`` come as they are."""
    output = np.asarray(output)
    if processed and output_format(output.shape, classes) == "end2end":
        rows = output[0].astype(np.float64)
        return rows[:, :4], rows[:, 4], rows[:, 5]
    need(output.ndim == 3 and output.shape[:2] == (1, 4 + classes), f"the output's shape {output.shape} is not that of boxes and {classes} classes")
    rows = output[0].T.astype(np.float64)
    best = rows[:, 4:].argmax(axis=1)  # PR1
    centre, half = rows[:, :2], rows[:, 2:4] / 2
    half = np.where((half > 0).all(axis=1, keepdims=True), half, np.nan)
    return np.hstack([centre - half, centre + half]), rows[np.arange(len(rows)), 4 + best], best.astype(float)


def kept_by_overlap(boxes: np.ndarray, confidence: np.ndarray, group: np.ndarray, limit: float) -> np.ndarray:
    """AG1 to AG3: of overlapping boxes of one group the surest stays; places in falling order of confidence."""
    area = np.prod(boxes[:, 2:] - boxes[:, :2], axis=1)
    left, out = np.argsort(-confidence, kind="stable"), []
    while len(left):
        i, left = left[0], left[1:]
        out.append(i)
        cut = np.maximum(np.minimum(boxes[left, 2:], boxes[i, 2:]) - np.maximum(boxes[left, :2], boxes[i, :2]), 0)
        both = cut[:, 0] * cut[:, 1]
        left = left[(both <= limit * (area[left] + area[i] - both)) | (group[left] != group[i])]
    return np.array(out, int)


class _Session:
    def __init__(self, session, size: tuple[int, int]):
        self.session, (self.w, self.h) = session, size
        self.input, self.output = session.get_inputs()[0].name, session.get_outputs()[0].name

    def rows(self, picture: np.ndarray, classes: int, characters: bool) -> tuple:
        tensor, box = Letterbox.put(picture, self.w, self.h, characters)
        return *rows_of(self.session.run([self.output], {self.input: tensor})[0], classes, characters), box


class Boxes(_Session):
    """.detect(picture): the boxes of wanted classes, suppressed within a class or (``apart`` false) over all."""

    def __init__(self, session, size: tuple[int, int], names: dict[int, str], classes: int, confidence: float, overlap: float, apart: bool):
        super().__init__(session, size)
        self.names, self.classes, self.least, self.overlap, self.apart = names, classes, confidence, overlap, apart

    def detect(self, picture: np.ndarray) -> list[Found]:
        boxes, confidence, kind, box = self.rows(picture, self.classes, False)
        boxes = box.back(boxes)
        ok = (confidence >= self.least) & np.isin(kind, list(self.names)) & np.isfinite(boxes).all(axis=1) & (boxes[:, 2:] > boxes[:, :2]).all(axis=1)
        boxes, confidence, kind = boxes[ok], confidence[ok], kind[ok].astype(int)
        out = []
        for i in kept_by_overlap(boxes, confidence, kind if self.apart else np.zeros(len(kind)), self.overlap):
            a, b, c, d = np.clip(np.rint(boxes[i]), 0, [box.w - 1, box.h - 1, box.w, box.h]).astype(int).tolist()  # PR5
            if c > a and d > b:
                out.append(Found(int(kind[i]), self.names[int(kind[i])], float(confidence[i]), (a, b, c, d)))
        return out


def vehicles(session, size: tuple[int, int], c: Detection = Detection()) -> Boxes:
    return Boxes(session, size, VEHICLE_CLASSES, 80, c.image_confidence, c.vehicle_iou, True)


def plates(session, size: tuple[int, int], c: Detection = Detection(), names: dict[int, str] = PLATE_CLASSES) -> Boxes:
    return Boxes(session, size, names, len(names), c.plate_confidence, c.plate_iou, False)


def reading_order(boxes: np.ndarray) -> list[np.ndarray]:
    """WI2, WI3: the places of characters, row by row, from the left."""
    if not len(boxes):
        return []
    middle, span = (boxes[:, 1] + boxes[:, 3]) / 2, boxes[:, 0] + boxes[:, 2]
    by_height = np.lexsort((boxes[:, 0], middle))
    y = middle[by_height]
    height = max(1.0, float(np.median(np.maximum(1, boxes[:, 3] - boxes[:, 1]))))
    found = []
    for k in range(2, len(y) - 1):
        parts = y[:k], y[k:]
        spread = max(1.0, *(float(np.median(np.abs(p - np.median(p)))) for p in parts))
        gap = float(np.median(parts[1]) - np.median(parts[0]))
        if gap >= max(0.35 * height, 2 * spread) and y[k] - y[k - 1] >= 0.25 * height:
            found.append((-gap / spread, k))
    rows = np.split(by_height, [min(found)[1]]) if found else [by_height]
    return [r[np.lexsort((boxes[r, 0], span[r]))] for r in rows]


class Characters(_Session):
    """.recognize(crop): the text of a plate, read from its characters' boxes."""

    def __init__(self, session, size: tuple[int, int], names: list[str], c: Detection = Detection()):
        super().__init__(session, size)
        self.names, self.least, self.overlap = names, c.character_confidence, c.character_iou

    def recognize(self, crop: np.ndarray) -> Reading:
        boxes, confidence, kind, box = self.rows(crop, len(self.names), True)
        fates = np.full(len(boxes), "below_confidence", object)
        sure = np.isfinite(confidence) & (confidence >= self.least)
        need((confidence[sure] <= 1).all(), "confidences must lie in 0 to 1")
        need((np.isclose(kind[sure], np.rint(kind[sure])) & (kind[sure] >= 0) & (kind[sure] < len(self.names))).all(), "a class has no character")
        good = sure & np.isfinite(boxes).all(axis=1)
        fates[sure & ~good] = "invalid_model_bbox"
        source = box.back(boxes)
        flat = good & ~(source[:, 2:] > source[:, :2]).all(axis=1)
        fates[flat] = "invalid_source_bbox"
        at = np.flatnonzero(good & ~flat)
        fates[at] = "suppressed_nms"
        at = at[kept_by_overlap(source[at], confidence[at], np.zeros(len(at)), self.overlap)]
        whole = np.clip(np.rint(source[at]), [0, 0, 1, 1], [box.w - 1, box.h - 1, box.w, box.h]).astype(int)  # PR6
        solid = (whole[:, 2:] > whole[:, :2]).all(axis=1)
        fates[at[~solid]] = "invalid_integer_bbox"
        at, whole = at[solid], whole[solid]
        fates[at] = "final"
        lines = reading_order(whole)
        order = np.concatenate([np.zeros(0, int), *lines])
        own = tuple(float(confidence[i]) for i in at[order])
        text = "".join(self.names[round(kind[i])] for i in at[order])
        return Reading(text, float(np.mean(own)) if own else 0.0, own, len(lines), tuple(fates))
