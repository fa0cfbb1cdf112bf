"""Where results go: paths, JSON, drawings (SC10 to SC17, DA4, PR23)."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from quillon.config import need
from quillon.functions import plate_text
from quillon.operators.assign import spread


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*?)(?:\.[^./\\]*)?$", 1)


def run_folder(path: Column, at: Column, suffix: Column | None = None) -> Column:
    """SC17, DA4: stem_yyyyMMdd_HHmmss, with a suffix for requests that may meet in a second."""
    name = F.concat(stem(path), F.lit("_"), F.date_format(at, "yyyyMMdd_HHmmss"))
    return name if suffix is None else F.concat(name, F.lit("_"), F.substring(suffix, 1, 8))


def output_path(path: Column, folder: Column) -> Column:
    return F.concat(folder, F.lit("/"), stem(path), F.lit(".json"))


def crop_path(track: Column, rank: Column, frame: Column) -> Column:
    """SC16, video."""
    return F.format_string("track_%d/top%d_frame%06d.jpg", track, rank, frame)


def image_crop_path(vehicle: Column) -> Column:
    return F.format_string("vehicle_%d.jpg", vehicle)


def as_json(df: DataFrame, *columns: str) -> DataFrame:
    """SC10, SC11, SC13: one JSON object a row, nulls written; a NaN or infinite number raises an error."""
    made = F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "false"})
    bad = made.rlike(r':"?(NaN|-?Infinity)"?[,}\]]')
    return df.select(F.when(bad, F.raise_error(F.lit("results hold a number that is not finite"))).otherwise(made).alias("value"))


def write_json(df: DataFrame, folder: str, mode: str = "error") -> None:
    as_json(df).write.mode(mode).text(folder)


def labels(vehicles: DataFrame, plates: DataFrame, final: DataFrame, keys: list[str], debug: bool = False) -> DataFrame:
    """SC14, SC15, JN16, PR23: what to draw: frame, box, label and colour, for rows whose key has a final row.

    ``vehicles``: keys, frame_index, box, class_name, confidence; ``plates``: the
    same with candidate_index; ``final``: keys, plate.
    """
    id_text = F.concat(F.lit("ID "), F.col(keys[-1]).cast("string"))
    if debug:
        id_text = F.concat(id_text, F.format_string(" %s %.2f", "class_name", "confidence"))
    one = vehicles.join(final.select(*keys), keys, "left_semi").select(*keys, "frame_index", "box", id_text.alias("label"), F.lit("vehicle").alias("kind"))
    text = plate_text.video_label(F.col("plate"))
    if debug:
        text = plate_text.debug_label(F.col("plate"), F.col("candidate_index"), F.col("class_name"), F.col("confidence"))
    two = plates.join(final.select(*keys, "plate"), keys).select(*keys, "frame_index", "box", text.alias("label"), F.lit("plate").alias("kind"))
    return one.unionByName(two)


#: Strokes in a cell of 2 x 4 points, by name, and the characters made of them; fixed shapes of a segment display.
STROKES = {"a": (0, 0, 2, 0), "b": (2, 0, 2, 2), "c": (2, 2, 2, 4), "d": (0, 4, 2, 4), "e": (0, 2, 0, 4), "f": (0, 0, 0, 2), "g": (0, 2, 1, 2), "h": (1, 2, 2, 2), "i": (1, 0, 1, 2), "j": (1, 2, 1, 4), "k": (0, 0, 1, 2), "l": (1, 2, 2, 0), "m": (1, 2, 2, 4), "n": (0, 4, 1, 2), "o": (1, 4, 1, 4)}
SHAPES = dict(zip("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ-.", "abcdef bc abghed abghcd fghbc afghcd afghecd abc abcdefgh abcdfgh abcefgh abcdhij adef abcdij adefgh aefgh acdefh bcefgh adij bcde efglm def bcefkl bcefkm abcdef abefgh abcdefm abefghm acdfgh aij bcdef efln bcefmn klmn klj adln gh o".split()))


def written(picture: np.ndarray, text: str, x: int, y: int, colour: tuple[int, int, int], size: int = 3) -> None:
    """Writes ``text`` into the picture, its lower left corner at (x, y); unknown characters are blanks."""
    h, w = picture.shape[:2]
    for k, character in enumerate(text.upper()):
        for stroke in SHAPES.get(character, ""):
            x1, y1, x2, y2 = STROKES[stroke]
            part = np.linspace(0, 1, 4 * size + 1)
            px = np.rint(x + (k * 3 + x1 + (x2 - x1) * part) * size).astype(int)
            py = np.rint(y + (y1 + (y2 - y1) * part - 4) * size).astype(int)
            for dx, dy in ((0, 0), (1, 0), (0, 1)):
                ok = (px + dx >= 0) & (px + dx < w) & (py + dy >= 0) & (py + dy < h)
                picture[py[ok] + dy, px[ok] + dx] = colour


COLOURS = {"vehicle": (0, 200, 0), "plate": (0, 0, 255)}


def draw(picture: np.ndarray, boxes: list[tuple[int, int, int, int]], colour: tuple[int, int, int] = COLOURS["vehicle"], thick: int = 2, labels: list[str | None] | None = None) -> np.ndarray:
    """Box outlines, and labels above them, on a copy of a picture."""
    out = picture.copy()
    h, w = out.shape[:2]
    for k, (x1, y1, x2, y2) in enumerate(boxes):
        a, b, c, d = max(0, x1), max(0, y1), min(w, x2 + 1), min(h, y2 + 1)
        out[b : b + thick, a:c] = out[max(b, d - thick) : d, a:c] = colour
        out[b:d, a : a + thick] = out[b:d, max(a, c - thick) : c] = colour
        if labels and labels[k]:
            written(out, labels[k], max(0, x1), max(15, y1 - 5), colour)
    return out


def drawn(frames: DataFrame, marks: DataFrame, keys: list[str], decode: Callable, encode: Callable) -> DataFrame:
    """SC14, SC15: ``frames`` (keys, content) with ``marks`` (keys, box, label, kind) drawn into their pictures; frames without marks stay as they are."""
    listed = marks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("kind", "box", "label"))).alias("_marks"))
    kinds = ", ".join(f"`{k}` {frames.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for pdf in batches:
            made = []
            for content, found in zip(pdf["content"], pdf["_marks"]):
                picture = decode(content)
                for kind in ("vehicle", "plate"):  # plates on top
                    own = [m for m in (found if found is not None else ()) if m["kind"] == kind]
                    picture = draw(picture, [tuple(int(m["box"][s]) for s in ("x1", "y1", "x2", "y2")) for m in own], COLOURS[kind], labels=[m["label"] for m in own])
                made.append(encode(picture))
            yield pdf[keys].assign(content=made)

    return frames.select(*keys, "content").join(listed, keys, "left").mapInPandas(run, f"{kinds}, content binary")


def cut_out(regions: DataFrame, decode: Callable, encode: Callable) -> DataFrame:
    """SC16: ``regions`` (path, content, plate) as the files of their crops: path, content."""

    def run(batches):
        for pdf in batches:
            made = [encode(decode(c)[int(b["y1"]) : int(b["y2"]), int(b["x1"]) : int(b["x2"])]) for c, b in zip(pdf["content"], pdf["plate"])]
            yield pdf[["path"]].assign(content=made)

    return regions.select("path", "content", "plate").mapInPandas(run, "path string, content binary")


class FileFolder(DataSource):
    """Rows (path, content) as files below the option `path`, a folder that all executors see. A file appears whole or not at all."""

    @classmethod
    def name(cls) -> str:
        return "quillon_files"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite):
        return _FolderWriter(self.options["path"])


@dataclass
class _Written(WriterCommitMessage):
    files: int


class _FolderWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = os.path.abspath(folder)

    def write(self, iterator):
        n = 0
        for row in iterator:
            target = os.path.abspath(os.path.join(self.folder, row["path"]))
            need(target.startswith(self.folder + os.sep), "a file must lie in its folder")
            os.makedirs(os.path.dirname(target), exist_ok=True)
            part = f"{target}.{uuid.uuid4()}.part"
            with open(part, "wb") as f:
                f.write(row["content"])
            os.replace(part, target)
            n += 1
        return _Written(n)

    def commit(self, messages):
        pass

    def abort(self, messages):
        pass


def write_files(files: DataFrame, folder: str) -> None:
    files.sparkSession.dataSource.register(FileFolder)
    files.select("path", "content").write.format("quillon_files").mode("append").option("path", folder).save()


def write_videos(frames: DataFrame, names: Column, fps: float, folder: str, decode: Callable) -> DataFrame:
    """SC15: ``frames`` (source, frame_index, content) as a video for each source below ``folder``: source, path, frames.

    A source's frames go to one task, in order, and stream into its file. With no
    OpenCV installed a video is a numpy archive (arrays `frames` and `fps`).
    """
    rows = frames.select("source", "frame_index", "content", names.alias("name"))
    rows = spread(rows, "source").sortWithinPartitions("source", "frame_index")

    def run(batches):
        at, out = None, None
        for pdf in batches:
            for source, content, name in zip(pdf["source"], pdf["content"], pdf["name"]):
                if source != at:
                    if out is not None:
                        yield pd.DataFrame([(at, *out.close())], columns=["source", "path", "frames"])
                    at, out = source, VideoFile(os.path.join(folder, name), fps)
                out.add(decode(content))
        if out is not None:
            yield pd.DataFrame([(at, *out.close())], columns=["source", "path", "frames"])

    return rows.mapInPandas(run, f"source {frames.schema['source'].dataType.simpleString()}, path string, frames int")


class VideoFile:
    """A video that is being written: with OpenCV frame by frame, else as a numpy archive at the end."""

    def __init__(self, path: str, fps: float):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        self.path, self.fps, self.n, self.writer, self.frames = path, fps, 0, None, []

    def add(self, picture: np.ndarray) -> None:
        self.n += 1
        try:
            import cv2
        except ImportError:
            self.frames.append(picture)
            return
        if self.writer is None:
            self.writer = cv2.VideoWriter(self.path, cv2.VideoWriter_fourcc(*"mp4v"), self.fps, picture.shape[1::-1])
            need(self.writer.isOpened(), f"Could not create annotated video: {self.path}")
        self.writer.write(picture)

    def close(self) -> tuple[str, int]:
        if self.writer is not None:
            self.writer.release()
            return self.path, self.n
        path = os.path.splitext(self.path)[0] + ".npz"
        with open(path, "wb") as f:
            np.savez_compressed(f, frames=np.stack(self.frames), fps=self.fps)
        return path, self.n
