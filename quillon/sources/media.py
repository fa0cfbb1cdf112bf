"""Images and videos as tables, and models as table functions (SC1 to SC9, JN12, SU1 to SU6, UD1).

Codecs and models are callables that the caller brings; they are made once in a
worker and kept. Pixels stay in the worker that decodes them: rows that leave it
are boxes, texts and numbers. A picture is a numpy array of height x width x 3.
"""

from __future__ import annotations

import ast
import math
import traceback
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillon.config import IMAGE_EXTENSIONS, VIDEO_EXTENSIONS, need

_made: dict[str, object] = {}


def made_once(name: str, factory: Callable[[], object]) -> object:
    """What ``factory`` makes, once in each worker; other factories under the same name are kept apart."""
    key = f"{name}/{getattr(factory, '__module__', '')}.{getattr(factory, '__qualname__', repr(factory))}"
    if key not in _made:
        _made[key] = factory()
    return _made[key]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def media_type(path: Column) -> Column:
    """SC2, SO1: image, video, or null."""
    return F.when(extension(path).isin(*IMAGE_EXTENSIONS), "image").when(extension(path).isin(*VIDEO_EXTENSIONS), "video")


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """SC1: path and content of the images below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.filter(media_type(F.col("path")) == "image").select("path", "content")


def netpbm(content: bytes) -> np.ndarray:
    """Decodes binary PPM, the one picture format that needs no codec."""
    parts, at = [], 0
    while len(parts) < 4:
        end = at
        while content[end : end + 1].strip():
            end += 1
        parts.append(content[at:end])
        at = end + 1
    need(parts[0] == b"P6" and parts[3] == b"255", "not a binary PPM of 8 bits")
    w, h = int(parts[1]), int(parts[2])
    return np.frombuffer(content, np.uint8, w * h * 3, at).reshape(h, w, 3)[..., ::-1]


def to_netpbm(picture: np.ndarray) -> bytes:
    h, w = picture.shape[:2]
    return b"P6\n%d %d\n255\n" % (w, h) + np.ascontiguousarray(picture[..., ::-1], np.uint8).tobytes()


def gray(picture: np.ndarray) -> np.ndarray:
    return np.rint(picture.astype(float) @ [0.114, 0.587, 0.299])


def laplacian_variance(g: np.ndarray) -> float:
    """AG26: the population variance of the Laplacian; edges mirror without repeating the border."""
    p = np.pad(g, 1, mode="reflect") if min(g.shape) > 1 else np.pad(g, 1, mode="edge")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g).var())


def resized(g: np.ndarray, w: int, h: int) -> np.ndarray:
    """Means of the covered cells when shrinking, else between the nearest two; for sharpness at one height."""

    def along(x: np.ndarray, n: int) -> np.ndarray:
        old = len(x)
        if n < old:
            edge = np.arange(n + 1) * old / n
            total = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)])
            low = np.floor(edge).astype(int)
            at = total[low] + (edge - low).reshape(-1, *[1] * (x.ndim - 1)) * (total[np.minimum(low + 1, old)] - total[low])
            return np.diff(at, axis=0) * n / old
        place = np.clip((np.arange(n) + 0.5) * old / n - 0.5, 0, old - 1)
        low = np.floor(place).astype(int)
        part = (place - low).reshape(-1, *[1] * (x.ndim - 1))
        return x[low] * (1 - part) + x[np.minimum(low + 1, old - 1)] * part

    return along(along(g, h).T, w).T


def pixel_statistics(crop: np.ndarray, dark: int = 3, bright: int = 252, normalized_height: int | None = None) -> dict:
    """AG26, MA9: what crop_quality needs to know of the pixels."""
    need(crop.ndim == 3 and crop.shape[2] == 3 and crop.size > 0, "a crop must be a picture that is not empty")
    g = gray(crop)
    h, w = g.shape
    focus = resized(g, max(1, round(w * normalized_height / h)), normalized_height) if normalized_height else g
    return {"width": w, "height": h, "sharpness_raw": laplacian_variance(focus), "dark_ratio": float((g <= dark).mean()), "bright_ratio": float((g >= bright).mean())}


def class_names(metadata: str) -> list[str]:
    """SC9: characters by class id, from a literal of a list or a dict; ids run from 0, one character each."""
    names = ast.literal_eval(metadata)
    if isinstance(names, dict):
        need(sorted(map(int, names)) == list(range(len(names))), "class ids must run from 0 without gaps")
        names = [names[k] for k in sorted(names, key=int)]
    names = [str(n) for n in names]
    need(bool(names) and all(len(n) == 1 for n in names), "each class must be one character")
    return names


def class_table(spark: SparkSession, metadata: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(class_names(metadata))), "class_id int, char string")


def output_format(shape: tuple[int, ...], classes: int) -> str:
    """SC8, SU6: rows of six (processed) or columns of box and class scores (raw)."""
    need(len(shape) == 3 and shape[0] == 1, "the output must have three dimensions, the first 1")
    if shape[2] == 6:
        return "end2end"
    need(shape[1] == 4 + classes, f"the output's shape {shape} fits neither format")
    return "raw"


DETECTIONS = "path string, frame_index int, i int, class_id int, class_name string, conf double, x1 int, y1 int, x2 int, y2 int, width int, height int, error string"


def detected(files: DataFrame, decode: Callable[[bytes], np.ndarray | None], model: Callable[[], object], name: str) -> DataFrame:
    """SC1, SC6, UD1: one row per detection of each image.

    ``model`` makes an object with .detect(picture) -> objects with class_id,
    class_name, confidence and bbox. An image that cannot be decoded gives one
    row with its error and no box (SS10).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = made_once(name, model)
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    picture = decode(content)
                    need(picture is not None and picture.size > 0, f"Could not decode image: {path}")
                    h, w = picture.shape[:2]
                    for i, d in enumerate(detector.detect(picture)):
                        rows.append((path, 0, i, d.class_id, d.class_name, float(d.confidence), *map(int, d.bbox), w, h, None))
                except Exception as e:
                    rows.append((path, 0, -1, None, None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            out = pd.DataFrame(rows, columns=[p.split()[0] for p in DETECTIONS.split(", ")])
            whole = ("frame_index", "i", "class_id", "x1", "y1", "x2", "y2", "width", "height")
            yield out.astype({k: "Int32" for k in whole} | {"conf": "Float64"})

    return files.select("path", "content").mapInPandas(run, DETECTIONS)


CROP_READINGS = "raw_text string, ocr_confidence double, char_confidences array<double>, status string, width int, height int, sharpness_raw double, dark_ratio double, bright_ratio double"


def read_crops(regions: DataFrame, decode: Callable[[bytes], np.ndarray | None], model: Callable[[], object], name: str, isolate: bool = True) -> DataFrame:
    """SC8, SU14, SS10: the reading and pixel statistics of each region (content and a box `plate`).

    ``model`` makes an object with .recognize(crop) -> text, confidence,
    char_confidences. With ``isolate`` a failed crop is a row with status
    decode_failed (images); without it the job fails (videos).
    """
    keys = [c for c in regions.columns if c not in ("content",)]
    schema = regions.select(*keys).schema
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = made_once(name, model)
        for pdf in batches:
            rows = []
            for content, b in zip(pdf["content"], pdf["plate"]):
                try:
                    picture = decode(content)
                    crop = picture[int(b["y1"]) : int(b["y2"]), int(b["x1"]) : int(b["x2"])]
                    stats = pixel_statistics(crop)
                    r = reader.recognize(crop)
                    own = None if r.char_confidences is None else [float(x) for x in r.char_confidences]
                    rows.append((r.text, float(r.confidence), own, "ok", stats["width"], stats["height"], stats["sharpness_raw"], stats["dark_ratio"], stats["bright_ratio"]))
                except Exception:
                    if not isolate:
                        raise
                    rows.append(("", 0.0, None, "decode_failed", 0, 0, 0.0, 0.0, 0.0))
            made = pd.DataFrame(rows, columns=[p.split()[0] for p in CROP_READINGS.split(", ")], index=pdf.index)
            yield pd.concat([pdf[keys], made], axis=1)

    return regions.mapInPandas(run, f"{kinds}, {CROP_READINGS}")


class VideoFrames(DataSource):
    """SC3, SC4: frames of videos, one partition a video: source, frame_index, timestamp_seconds, width, height.

    Options: paths (separated by newlines), max_frames, and `opener`, a registered
    name of a callable path -> (fps, width, height, iterator of pictures).
    """

    @classmethod
    def name(cls) -> str:
        return "quillon_video"

    def schema(self) -> str:
        return "source string, frame_index int, timestamp_seconds double, width int, height int, content binary"

    def reader(self, schema):
        return _VideoReader(self.options)


class _VideoReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split("\n") if p]
        self.limit = int(options.get("max_frames", 0)) or None

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        fps, w, h, frames = open_video(partition.value)
        need(math.isfinite(fps) and fps > 0, "fps must be positive")
        need(w > 0 and h > 0, "a video's sides must be positive")
        for i, picture in enumerate(frames):
            if self.limit is not None and i >= self.limit:
                break
            yield partition.value, i, i / fps, w, h, to_netpbm(picture)


def open_video(path: str):
    """Frames of a numpy archive (arrays `frames` and `fps`), or of any format that an installed OpenCV reads."""
    if path.endswith(".npz"):
        data = np.load(path)
        frames = data["frames"]
        return float(data["fps"]), frames.shape[2], frames.shape[1], iter(frames)
    try:
        import cv2
    except ImportError as e:
        raise RuntimeError(f"no codec for {path} is installed") from e
    video = cv2.VideoCapture(path)
    need(video.isOpened(), f"Could not open video: {path}")

    def pictures():
        while True:
            more, picture = video.read()
            if not more:
                return video.release()
            yield picture

    return video.get(cv2.CAP_PROP_FPS), int(video.get(cv2.CAP_PROP_FRAME_WIDTH)), int(video.get(cv2.CAP_PROP_FRAME_HEIGHT)), pictures()


def onnx_model(path: str, channels: int, device: str = "auto"):
    """SU1 to SU3: a session whose contract holds: one float32 input of static NCHW shape, one output with ``channels`` in its second dimension."""
    try:
        import onnxruntime as ort
    except ImportError as e:
        raise RuntimeError("onnxruntime is not installed") from e
    have = ort.get_available_providers()
    wanted = [p for p in ("CUDAExecutionProvider", "CPUExecutionProvider") if p in have and (device != "cpu" or p.startswith("CPU"))]
    need(device != "cuda" or wanted[0].startswith("CUDA"), "no CUDA provider is available")
    session = ort.InferenceSession(path, providers=wanted)
    inputs, outputs = session.get_inputs(), session.get_outputs()
    need(len(inputs) == 1 and len(outputs) == 1, "a model must have one input and one output")
    need(inputs[0].type == "tensor(float)", "the input must be float32")
    shape = inputs[0].shape
    need(len(shape) == 4 and shape[1] == 3 and all(isinstance(n, int) and n > 0 for n in shape[1:]), "the input must be static NCHW")
    need(outputs[0].shape[1] in (channels, None) or not isinstance(outputs[0].shape[1], int), f"the output must have {channels} channels")
    return session, (shape[3], shape[2])


def failure(e: BaseException) -> str:
    return "".join(traceback.format_exception_only(type(e), e)).strip()
