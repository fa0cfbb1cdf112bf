"""Whole runs: images and videos through models, ownership, tracks, readings and text rules to result rows (SU7, SU10 to SU15).

Models are brought by the caller: `vehicles` and `plates` are factories of objects
with .detect(picture), `reader` of objects with .recognize(crop). One scan decodes
each picture once and emits boxes and pixel statistics; all decisions are DataFrame
operators; only the chosen crops' pictures are read again for their texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.config import Config
from quillon.functions import geometry as g
from quillon.functions import plate_text, scores
from quillon.operators import detections, evidence, fusion, ownership, results, tracking
from quillon.sources import media, sinks

_BOX = "struct<x1:int,y1:int,x2:int,y2:int>"
_PLATE = f"struct<class_name:string,confidence:double,box:{_BOX},clamped:boolean,sharpness_raw:double,dark_ratio:double,bright_ratio:double>"
_SCAN = f"det_index int, class_id int, class_name string, conf double, x1 int, y1 int, x2 int, y2 int, frame_w int, frame_h int, plates array<{_PLATE}>"


@dataclass
class Run:
    """Result rows, and the tables that drawings and crops are made of: boxes by keys, and where each crop is. `close` lets go of what was kept."""

    rows: DataFrame
    keys: list[str]
    vehicles: DataFrame
    plates: DataFrame
    crops: DataFrame
    pictures: DataFrame
    held: list[DataFrame]

    def close(self) -> None:
        for df in self.held:
            df.unpersist()


@dataclass
class Engine:
    spark: SparkSession
    vehicles: Callable[[], object]
    plates: Callable[[], object]
    reader: Callable[[], object]
    decode: Callable[[bytes], object] = media.netpbm
    encode: Callable[[object], bytes] = media.to_netpbm
    config: Config = field(default_factory=Config)
    name: str = "engine"

    def models(self) -> dict[str, str]:
        return {"vehicle": repr(self.vehicles), "plate": repr(self.plates), "ocr": repr(self.reader)}

    def scan(self, pictures: DataFrame, keys: list[str], in_parent: bool) -> DataFrame:
        """Vehicles of each picture with the plates found in their regions (JN12, PR8 to PR11, PR12)."""
        kinds = ", ".join(f"`{k}` {pictures.schema[k].dataType.simpleString()}" for k in keys)
        decode, vehicles, plates, name = self.decode, self.vehicles, self.plates, self.name
        quality = self.config.video_quality if in_parent else self.config.image_quality

        def region(box, w, h):
            x1, y1, x2, y2 = (int(v) for v in box)
            return max(0, min(x1, w)), max(0, min(y1, h)), max(0, min(x2, w)), max(0, min(y2, h))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            find, look = media.made_once(f"{name}-vehicles", vehicles), media.made_once(f"{name}-plates", plates)
            for pdf in batches:
                rows = []
                for row in pdf.to_dict("records"):
                    picture = decode(row["content"])
                    h, w = picture.shape[:2]
                    for i, d in enumerate(find.detect(picture)):
                        a, b, c, e = region(d.bbox, w, h)
                        seen = []
                        for p in look.detect(picture[b:e, a:c]) if c > a and e > b else ():
                            x1, y1, x2, y2 = p.bbox
                            moved = (x1 + a, y1 + b, x2 + a, y2 + b)
                            kept = (max(a, min(moved[0], c)), max(b, min(moved[1], e)), max(a, min(moved[2], c)), max(b, min(moved[3], e))) if in_parent else moved
                            box = region(kept, w, h)
                            crop = picture[box[1] : box[3], box[0] : box[2]]
                            s = media.pixel_statistics(crop, quality.dark, quality.bright, quality.normalized_height) if crop.size else {"sharpness_raw": 0.0, "dark_ratio": 1.0, "bright_ratio": 0.0}
                            seen.append({"class_name": p.class_name, "confidence": float(p.confidence), "box": dict(zip(g.SIDES, box)), "clamped": tuple(map(int, moved)) != box, **{k: s[k] for k in ("sharpness_raw", "dark_ratio", "bright_ratio")}})
                        rows.append([*(row[k] for k in keys), i, d.class_id, d.class_name, float(d.confidence), *map(int, d.bbox), w, h, seen])
                yield pd.DataFrame(rows, columns=[*keys, *[p.split()[0] for p in _SCAN.split(f", plates array<{_PLATE}>")[0].split(", ")], "plates"])

        return pictures.select(*keys, "content").mapInPandas(run, f"{kinds}, {_SCAN}")

    def _candidates(self, seen: DataFrame, keys: list[str]) -> DataFrame:
        flat = seen.select(*keys, "det_index", "track_id", "conf", F.col("class_name").alias("vehicle_class"), g.box().alias("vehicle"), F.posexplode("plates").alias("_k", "_p"))
        flat = flat.filter(F.col("_p.confidence") >= self.config.detection.plate_confidence)
        b = F.col("_p.box")
        q = scores.crop_quality(F.col("_p.confidence"), g.width(b), g.height(b), F.col("_p.sharpness_raw"), F.col("_p.dark_ratio"), F.col("_p.bright_ratio"), self.config.video_quality)
        return flat.select(
            *keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("det_index", "_k")) - 1).alias("candidate_index"), "track_id", F.col("det_index").alias("vehicle_index"), b.alias("plate"), "vehicle",
            F.col("_p.confidence").alias("plate_confidence"), F.col("conf").alias("vehicle_confidence"), F.col("_p.clamped").alias("coordinate_clamped"), F.col("_p.class_name").alias("layout"), q.alias("quality"),
        )

    def images(self, folder: str) -> DataFrame:
        """One row per vehicle of the images below ``folder``: path, vehicle_index, vehicle, plate, evidence, debug."""
        return self.image_run(folder).rows

    def videos(self, frames: DataFrame, fps: float) -> DataFrame:
        """One row per track of ``frames`` (source, frame_index, content): source, track_id, vehicle, plate, evidence."""
        return self.video_run(frames, fps).rows

    def image_run(self, folder: str) -> Run:
        files = media.image_files(self.spark, folder)
        seen = self.scan(files, ["path"], in_parent=False).filter(F.col("conf") >= self.config.detection.image_confidence)
        seen = seen.withColumn("track_id", F.lit(0)).persist()  # two uses; without it the models would run twice
        vehicles = seen.select("path", F.col("det_index").alias("vehicle_index"), F.lit(0).alias("frame_index"), "class_id", "class_name")
        rows = self._candidates(seen, ["path"]).withColumn("frame_index", F.lit(0)).drop("track_id", "coordinate_clamped")
        chosen = ownership.image_ownership(rows.drop("quality"), "path", "frame_index", self.config.image_ownership).filter("selected")
        regions = chosen.select("path", "vehicle_index", "plate", "layout").join(files, "path")
        read = media.read_crops(regions, self.decode, self.reader, f"{self.name}-reader")
        rows = results.finalize_image(vehicles, read.select("path", "vehicle_index", "plate", "layout", "raw_text", "ocr_confidence", "char_confidences"), ["path", "vehicle_index"], self.config.low_confidence)
        boxes = seen.select("path", F.col("det_index").alias("vehicle_index"), g.box().alias("box"))
        one = chosen.select("path", "vehicle_index", F.col("plate").alias("box"))
        crops = chosen.select("path", "plate", sinks.image_crop_path(F.col("vehicle_index")).alias("file"))
        return Run(rows, ["path", "vehicle_index"], boxes, one, crops, files, [seen])

    def video_run(self, frames: DataFrame, fps: float) -> Run:
        c, keys = self.config, ["source", "frame_index"]
        seen = self.scan(frames, keys, in_parent=True).filter(F.col("conf") >= c.detection.vehicle_confidence).withColumn("i", F.col("det_index")).persist()
        lower = type(c.validation)(**{**c.validation.__dict__, "min_confidence": c.tracking.low})
        good = detections.validated(seen, keys, c=lower).filter("accepted")
        tracks = tracking.tracked(good, fps, "source", c.tracking).persist()
        marked = seen.join(tracking.observations(tracks, "source").select(*keys, "det_index", "track_id"), [*keys, "det_index"])
        decided = ownership.video_ownership(self._candidates(marked, keys), keys, c.video_ownership).filter("ownership_status = 'selected'")
        history = tracking.histories(tracks, "source")
        crops = decided.select("source", "track_id", "frame_index", "candidate_index", "plate", "plate_confidence", "quality.width", "quality.height", "quality.sharpness_score", "quality.total_score")
        live = tracking.surviving(history).select("source", "track_id")
        best = evidence.spaced(crops.join(live, ["source", "track_id"], "left_semi"), ["source", "track_id"], c.buffer)
        regions = best.select("source", "track_id", "frame_index", "rank", "plate", F.col("total_score").alias("quality_score")).join(frames.select(*keys, "content"), keys)
        read = media.read_crops(regions, self.decode, self.reader, f"{self.name}-reader", isolate=False).persist()  # fusion reads it more than once, the model should not
        one = F.struct("source", "track_id")
        fused = fusion.fused(read.withColumn("key", one).select("key", "frame_index", "rank", "raw_text", "ocr_confidence", "quality_score", "char_confidences"), history.select(one.alias("key")), "key", c.fusion)
        fused = fused.select("key.*", *[x for x in fused.columns if x != "key"])
        pair = ["source", "track_id"]
        counted = decided.groupBy(*pair).agg(F.count("*").alias("n"))
        rows = results.finalize_video(history.drop("status"), tracking.class_vote(marked, pair), fused, counted, best, pair, c.low_confidence)
        boxes = marked.select(*pair, "frame_index", g.box().alias("box"), "class_name", F.col("conf").alias("confidence"))
        one = decided.select(*pair, "frame_index", F.col("plate").alias("box"), F.col("layout").alias("class_name"), F.col("plate_confidence").alias("confidence"), "candidate_index")
        crops = best.select("source", "frame_index", "plate", sinks.crop_path(F.col("track_id"), F.col("rank"), F.col("frame_index")).alias("file"))
        return Run(rows, pair, boxes, one, crops, frames, [seen, tracks, read])

    def save_annotated(self, run: Run, folder: str, fps: float | None = None, release: bool = False, debug: bool = False, suffix: str = ".ppm") -> DataFrame:
        """SC14, SC15: the pictures with boxes and labels below ``folder``; returns the files (images: path; videos: source, path, frames).

        A release image shows only what a customer may see. A video's frames are
        read a second time, all of them, and keep their order.
        """
        if fps is None:
            shown = results.eligible(run.rows, self.config.low_confidence) if release else run.rows
            label = F.coalesce(plate_text.license_text(F.col("plate")), F.lit("")) if release else plate_text.image_label(F.col("plate"))
            marks = run.plates.join(shown.select(*run.keys, label.alias("label")), run.keys).select("path", "box", "label", F.lit("plate").alias("kind"))
            own = run.vehicles.join(shown.select(*run.keys), run.keys, "left_semi").select("path", "box", F.lit("").alias("label"), F.lit("vehicle").alias("kind"))
            made = sinks.drawn(run.pictures, marks.unionByName(own), ["path"], self.decode, self.encode)
            made = made.withColumn("path", F.concat(sinks.stem(F.col("path")), F.lit("_annotated"), F.lit(suffix)))
            sinks.write_files(made, folder)
            return made.select("path")
        marks = sinks.labels(run.vehicles, run.plates, run.rows, run.keys, debug).select("source", "frame_index", "box", "label", "kind")
        made = sinks.drawn(run.pictures, marks, ["source", "frame_index"], self.decode, self.encode)
        files = sinks.write_videos(made, F.concat(sinks.stem(F.col("source")), F.lit("_annotated.mp4")), fps, folder, self.decode)
        return self.spark.createDataFrame(files.collect(), files.schema)  # a row per video; the frames are written once

    def save_crops(self, run: Run, folder: str, suffix: str | None = None) -> None:
        """SC16: the chosen crops, in a folder `crops`; with ``suffix`` in place of .jpg, where the encoder makes something else."""
        keys = [k for k in ("path", "source", "frame_index") if k in run.crops.columns]
        regions = run.crops.join(run.pictures.select(*keys, "content"), keys)
        name = F.regexp_replace("file", r"\.jpg$", suffix) if suffix else F.col("file")
        own = sinks.stem(F.col(keys[0]))  # pictures and videos of one run have folders of their own
        sinks.write_files(sinks.cut_out(regions.select(F.concat_ws("/", F.lit("crops"), own, name).alias("path"), "content", "plate"), self.decode, self.encode), folder)

    def observed(self, rows: DataFrame, name: str = "rows"):
        """SU4, SU5: ``rows`` that report, when they are read, how many there are and how many are ok; and the observation."""
        from pyspark.sql import Observation

        seen = Observation(name)
        return rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("plate.status") == "ok").alias("ok")), seen

    def write(self, rows: DataFrame, folder: str, release: bool = False, video: bool = False) -> None:
        """SC10 to SC12: all rows, or what a customer may see, as JSON lines."""
        if release:
            rows = results.customer(rows, "track_id" if video else "vehicle_index", self.config.low_confidence, video)
        sinks.write_json(rows.drop("debug"), folder)


def checked(df: DataFrame, **rules) -> DataFrame:
    """SU12: ``df``, in which a row that breaks a rule (message=condition) raises an error when it is read."""
    test = F.lit(True)
    for message, rule in rules.items():
        test = F.when(~F.coalesce(rule, F.lit(False)), F.raise_error(F.lit(message.replace("_", " "))).cast("boolean")).otherwise(test)
    return df.filter(test)
