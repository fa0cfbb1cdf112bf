"""Scores of owners, crops and readings as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.config import Fusion, ImageOwnership, Quality
from quillon.functions import geometry as g


def video_owner(plate: Column, vehicle: Column, plate_confidence: Column, vehicle_confidence: Column) -> Column:
    """MA7: confidence, how near the plate is to the vehicle's middle line, and how much of the vehicle it fills."""
    w, h = F.greatest(g.width(vehicle), F.lit(1)), F.greatest(g.height(vehicle), F.lit(1))
    off = F.abs(g.centre(plate)[0] - g.centre(vehicle)[0]) / F.greatest(w / 2, F.lit(1.0))
    filled = F.least(F.lit(1.0), g.area(plate) / (w * h) / 0.12)
    return 0.45 * plate_confidence + 0.20 * vehicle_confidence + 0.25 * F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(1.0), off)) + 0.10 * filled


def image_owner(temporal: Column, tight: Column, containment: Column, plate_confidence: Column, vehicle_confidence: Column, c: ImageOwnership = ImageOwnership()) -> Column:
    """MA6."""
    return (
        c.temporal_weight * temporal
        + c.tight_weight * tight
        + c.containment_weight * containment
        + c.plate_weight * g.clamp(plate_confidence, 0.0, 1.0)
        + c.vehicle_weight * g.clamp(vehicle_confidence, 0.0, 1.0)
    )


def crop_quality(confidence: Column, w: Column, h: Column, sharpness_raw: Column, dark_ratio: Column, bright_ratio: Column, c: Quality = Quality()) -> Column:
    """MA8: the crop's scores from its pixel statistics."""
    sharp = g.clamp(sharpness_raw / c.sharpness_reference, 0.0, 1.0)
    size = g.clamp(h / c.target_height, 0.0, 1.0)
    exposure = g.clamp(1.0 - g.clamp(dark_ratio + bright_ratio, 0.0, 1.0), 0.0, 1.0)
    total = g.clamp(c.confidence_weight * confidence + c.sharpness_weight * sharp + c.size_weight * size + c.exposure_weight * exposure, 0.0, 1.0)
    return F.struct(
        confidence.alias("plate_confidence"), w.cast("int").alias("width"), h.cast("int").alias("height"), sharpness_raw.alias("sharpness_raw"),
        sharp.alias("sharpness_score"), size.alias("size_score"), exposure.alias("exposure_score"), total.alias("total_score"),
    )


def evidence_weight(text: Column, ocr: Column, quality: Column, plate: Column | None = None) -> Column:
    """MA4: of a reading; an empty text weighs nothing. A null plate confidence leaves it out."""
    w = g.clamp(ocr, 0.0, 1.0) * g.clamp(quality, 0.0, 1.0)
    if plate is not None:
        w = w * F.coalesce(g.clamp(plate, 0.0, 1.0), F.lit(1.0))
    return F.when(F.coalesce(text, F.lit("")) == "", 0.0).otherwise(g.clamp(w, 0.0, 1.0))


def fusion_confidence(ratio: Column, ocr: Column, quality: Column, valid: Column, c: Fusion = Fusion()) -> Column:
    """AG15: a single reading counts for less."""
    raw = c.consensus_weight * ratio + c.ocr_weight * ocr + c.quality_weight * quality
    single = 0.5 + 0.5 * min(1 / c.single_denominator, 1.0)
    return g.clamp(F.when(valid == 1, raw * single).otherwise(raw), 0.0, 1.0)


def rounded(x: Column, digits: int = 6) -> Column:
    """MA13: halves to even."""
    return F.bround(x, digits)


def milliseconds(seconds: Column, units: Column) -> Column:
    """PR24: per unit; 0 for none."""
    return F.when(units > 0, F.bround(seconds * 1000 / units, 6)).otherwise(0.0)


def timestamp(frame: Column, fps: Column) -> Column:
    """DA1."""
    return frame / fps


def duration(frames: Column, fps: Column) -> Column:
    """DA2."""
    return F.when(fps > 0, frames / fps).otherwise(0.0)


def lost_frames(fps: Column, seconds: float = 0.5) -> Column:
    """DA3."""
    return F.greatest(F.lit(1), F.rint(fps * seconds).cast("int"))
