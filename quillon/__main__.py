"""python -m quillon --models MODULE [--input FILE_OR_FOLDER] [options] (SU16, SS9).

MODULE is a Python module with vehicles(device), plates(device), reader(device),
decode(content) and, for pictures that are written, encode(picture).

With --input, the images of a folder or file, or a video, are processed: results go
to --output, or with --release to a folder named after the input and the time. With
no --input, requests come as JSON lines from standard input until one asks for
shutdown. Exit status: 2 for options that don't fit together, 1 for an error.
"""

from __future__ import annotations

import argparse
import importlib
import os
import sys
import time
import uuid
from datetime import datetime
from functools import partial

from quillon.config import IMAGE_EXTENSIONS, VIDEO_EXTENSIONS, need


def run_folder(path: str, suffix: str = "") -> str:
    """A folder named after the input and the time, where the program runs."""
    name = os.path.splitext(os.path.basename(path.rstrip("/")))[0]
    return os.path.abspath(f"{name}_{datetime.now():%Y%m%d_%H%M%S}{suffix}")


def process(engine, path: str, folder: str, annotated: bool, crops: bool, release: bool, debug: bool = False) -> dict:
    """Runs one input into ``folder``; the rows that a customer may see, and the files."""
    from pyspark.sql import functions as F

    from quillon.operators import results
    from quillon.sources.media import VideoFrames, open_video

    video = path.lower().endswith((*VIDEO_EXTENSIONS, ".npz"))
    fps = None
    if video:
        engine.spark.dataSource.register(VideoFrames)
        fps = open_video(path)[0]
        run = engine.video_run(engine.spark.read.format("quillon_video").option("paths", path).load(), fps)
    else:
        run = engine.image_run(path)
    try:
        rows, seen = engine.observed(run.rows) if debug else (run.rows, None)
        engine.write(rows, f"{folder}/json", release, video)
        if seen is not None:
            print(seen.get, file=sys.stderr)
        files = [r["path"] for r in engine.save_annotated(run, folder, fps, release, debug).collect()] if annotated or video else []
        if crops:
            engine.save_crops(run, folder, ".ppm")
        shown = results.eligible(run.rows, engine.config.low_confidence, video).orderBy(run.keys[-1])
        plates = shown.select(*[F.col(f"plate.{n}") for n in ("formatted", "text", "normalized_text", "raw_text", "confidence")]).collect()  # an input's accepted plates
    finally:
        run.close()
    text = lambda r: next((r[n] for n in ("formatted", "text", "normalized_text", "raw_text") if r[n] and r[n].strip()), None)
    listed = [{"plate_text": text(r), "detection_confidence": r["confidence"], "ocr_confidence": r["confidence"], "crop_path": None} for r in plates]
    drawing = os.path.join(folder, files[0]) if files else None
    return {"output_image": None if video else drawing, "output_video": drawing if video else None, "output_json": f"{folder}/json", "count": len(listed), "plates": listed}


def answer(engine, request: dict) -> dict:
    """The response of a request to process an input."""
    path = os.path.abspath(request["path"])
    if not os.path.isfile(path):
        raise FileNotFoundError(f"Input file does not exist: {path}")
    began = time.perf_counter()
    out = process(engine, path, run_folder(path, f"_{uuid.uuid4().hex[:8]}"), True, False, False)
    return {"status": "success", "input_type": request["input_type"], **out, "processing": {"total_ms": round((time.perf_counter() - began) * 1000, 3)}}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillon")
    parser.add_argument("--input")
    parser.add_argument("--output")
    parser.add_argument("--models")
    parser.add_argument("--save-annotated", action="store_true")
    parser.add_argument("--save-topk-crops", action="store_true")
    parser.add_argument("--release", action="store_true")
    parser.add_argument("--debug", action="store_true")
    parser.add_argument("--device", choices=("auto", "cpu", "cuda"), default="auto")
    args = parser.parse_args(argv)
    if not args.models or not args.input and (args.output or args.save_annotated or args.save_topk_crops or args.release):
        print("--models is needed, and output options need --input", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from quillon.engine import Engine
    from quillon.streaming.requests import answer_lines

    try:
        own = importlib.import_module(args.models)
        if args.input:
            need(os.path.exists(args.input), f"Input does not exist: {args.input}")
            suffix = os.path.splitext(args.input)[1].lower()
            need(os.path.isdir(args.input) or suffix in (*IMAGE_EXTENSIONS, *VIDEO_EXTENSIONS, ".npz"), f"Unsupported input type: {suffix or '<none>'}")
            need(not (args.release and args.output), "--release chooses its output folder automatically; omit --output")
            need(not (args.release and args.save_topk_crops), "--save-topk-crops cannot be used with --release")
            need(args.release or args.output, "--output is needed, unless --release names the folder")
        spark = SparkSession.builder.appName("quillon").getOrCreate()
        make = {k: partial(getattr(own, k), args.device) for k in ("vehicles", "plates", "reader")}
        if hasattr(own, "encode"):
            make["encode"] = own.encode
        engine = Engine(spark, decode=own.decode, **make)
        if not args.input:
            answer_lines(spark, sys.stdin, partial(answer, engine), lambda line: print(line, flush=True))
            return 0
        folder = run_folder(args.input) if args.release else args.output
        out = process(engine, os.path.abspath(args.input), os.path.abspath(folder), args.save_annotated or args.release, args.save_topk_crops, args.release, args.debug and not args.release)
        print(f"Plates: {out['count']}; JSON: {out['output_json']}")
    except Exception as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
