"""Parameters of the operators (UD2). Values are production defaults; constructors reject values out of range."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, fields


def need(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def _within(config, low: float, high: float, *names: str) -> None:
    for name in names:
        need(low <= getattr(config, name) <= high, f"{name} must be in [{low:g}, {high:g}]")


def bounded(default, bounds: str):
    """A field with bounds as mathematics writes them: "(0, 1]" is above 0 and at most 1."""
    return field(default=default, metadata={"bounds": bounds})


def _in_bounds(config) -> None:
    for f in fields(config):
        if bounds := f.metadata.get("bounds"):
            value, (low, high) = getattr(config, f.name), map(float, bounds[1:-1].split(","))
            above = value > low if bounds[0] == "(" else value >= low
            below = value < high if bounds[-1] == ")" else value <= high
            need(above and below, f"{f.name} must be in {bounds}")


# Detector classes and file extensions.
VEHICLE_CLASSES = {2: "car", 3: "motorcycle", 5: "bus", 7: "truck"}
PLATE_CLASSES = {0: "vuong", 1: "dai"}
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".webp")
VIDEO_EXTENSIONS = (".mp4", ".avi", ".mov", ".mkv")


@dataclass(frozen=True)
class Detection:
    vehicle_confidence: float = 0.10
    image_confidence: float = 0.25
    plate_confidence: float = 0.25
    character_confidence: float = 0.25
    vehicle_iou: float = 0.45
    plate_iou: float = 0.45
    character_iou: float = 0.70

    def __post_init__(self):
        _within(self, 0, 1, *self.__dataclass_fields__)


@dataclass(frozen=True)
class Validation:
    min_confidence: float = 0.50
    min_width: int = 8
    min_height: int = 8
    min_area_ratio: float = 0.00002
    min_aspect: float = 0.03
    max_aspect: float = 12.0
    duplicate_iou: float = 0.75
    wide_ratio: float = 0.98
    wide_margin: float = 0.02
    wide_confidence: float = 0.50

    def __post_init__(self):
        _within(self, 0, 1, "min_confidence", "duplicate_iou", "wide_confidence")
        need(0 < self.wide_ratio <= 1, "wide_ratio must be in (0, 1]")
        need(self.min_width >= 1 and self.min_height >= 1, "least box sizes must be positive")
        need(self.min_area_ratio >= 0, "min_area_ratio must not be negative")
        need(0 < self.min_aspect <= self.max_aspect, "aspect limits are out of order")


@dataclass(frozen=True)
class Tracking:
    low: float = bounded(0.10, "[0, 1]")
    high: float = bounded(0.50, "[0, 1]")
    new: float = bounded(0.55, "[0, 1]")
    max_lost_seconds: float = bounded(0.50, "(0, inf]")
    first_limit: float = bounded(0.83, "(0, 1]")
    second_limit: float = bounded(0.65, "(0, 1]")
    min_iou: float = bounded(0.10, "(0, 1]")
    max_centre_distance: float = bounded(0.35, "(0, inf]")
    class_penalty: float = bounded(0.10, "[0, 1)")
    suppress_iou: float = bounded(0.75, "(0, 1]")
    duplicate_iou: float = bounded(0.90, "(0, 1]")
    duplicate_frames: int = bounded(2, "[1, inf]")

    def __post_init__(self):
        _in_bounds(self)
        need(self.low <= self.high <= self.new, "confidences must rise: low, high, new")

    def lost_frames(self, fps: float) -> int:
        """DA3: frames that a track may be missed for; halves round to even."""
        need(fps > 0 and math.isfinite(fps), "fps must be positive")
        return max(1, round(fps * self.max_lost_seconds))


@dataclass(frozen=True)
class Buffer:
    top_k: int = 4
    min_gap: int = 5
    min_quality: float = 0.60
    min_sharpness: float = 0.70
    min_width: int = 40
    min_height: int = 24

    def __post_init__(self):
        need(self.top_k >= 1, "top_k must be positive")
        need(self.min_gap >= 0, "min_gap must not be negative")
        _within(self, 0, 1, "min_quality", "min_sharpness")
        need(self.min_width >= 1 and self.min_height >= 1, "least crop sizes must be positive")


@dataclass(frozen=True)
class Quality:
    """Weights and references of the crop score; the image mode scales crops to a height before it measures sharpness."""

    confidence_weight: float = 0.30
    sharpness_weight: float = 0.40
    size_weight: float = 0.20
    exposure_weight: float = 0.10
    sharpness_reference: float = 200.0
    target_height: float = 48.0
    dark: int = 3
    bright: int = 252
    normalized_height: int | None = 64

    def __post_init__(self):
        weights = (self.confidence_weight, self.sharpness_weight, self.size_weight, self.exposure_weight)
        need(min(weights) >= 0 and abs(sum(weights) - 1) < 1e-9, "quality weights must sum to 1")
        need(self.sharpness_reference > 0 and self.target_height > 0, "references must be positive")
        need(0 <= self.dark < self.bright <= 255, "clip values are out of order")


@dataclass(frozen=True)
class VideoOwnership:
    conflict_iou: float = 0.70
    overlap_smaller: float = 0.85

    def __post_init__(self):
        for name in ("conflict_iou", "overlap_smaller"):
            need(0 < getattr(self, name) <= 1, f"{name} must be in (0, 1]")


@dataclass(frozen=True)
class ImageOwnership:
    history_size: int = 20
    min_samples: int = 5
    definite_iou: float = 0.80
    conflict_iou: float = 0.70
    overlap_smaller: float = 0.85
    temporal_weight: float = 0.40
    tight_weight: float = 0.25
    containment_weight: float = 0.15
    plate_weight: float = 0.15
    vehicle_weight: float = 0.05
    cold_start: float = 0.50
    update_margin: float = 0.10
    tolerance: tuple[float, float, float, float] = (0.20, 0.20, 0.50, 0.50)
    least_scale: float = 0.05
    min_temporal: float = 0.20
    max_jump: float = 0.25
    max_size_ratio: float = 2.50
    cost_limit: float = 1.0

    def __post_init__(self):
        need(1 <= self.min_samples <= self.history_size, "min_samples must be from 1 to history_size")
        need(0 < self.conflict_iou <= self.definite_iou <= 1, "conflict_iou must not exceed definite_iou")
        need(0 < self.overlap_smaller <= 1, "overlap_smaller must be in (0, 1]")
        weights = (self.temporal_weight, self.tight_weight, self.containment_weight, self.plate_weight, self.vehicle_weight)
        need(min(weights) >= 0 and abs(sum(weights) - 1) < 1e-8, "owner weights must sum to 1")
        need(min(*self.tolerance, self.least_scale, self.cold_start, self.update_margin, self.min_temporal, self.max_jump) >= 0, "limits must not be negative")
        need(self.min_temporal <= 1 and math.isfinite(self.max_size_ratio) and self.max_size_ratio >= 1, "outlier limits are out of range")


@dataclass(frozen=True)
class Fusion:
    consensus: float = 0.65
    use_plate_confidence: bool = False
    consensus_weight: float = 0.50
    ocr_weight: float = 0.25
    quality_weight: float = 0.25
    single_denominator: float = 3.0

    def __post_init__(self):
        _within(self, 0, 1, "consensus")
        weights = (self.consensus_weight, self.ocr_weight, self.quality_weight)
        need(min(weights) >= 0 and abs(sum(weights) - 1) <= 1e-9, "fusion weights must sum to 1")
        need(self.single_denominator > 0, "single_denominator must be positive")


@dataclass(frozen=True)
class PlateText:
    separators: str = " -."
    max_corrections: int = 2
    extra_max_confidence: float = 0.50
    extra_ratio: float = 0.75

    def __post_init__(self):
        need(self.max_corrections >= 0, "max_corrections must not be negative")
        _within(self, 0, 1, "extra_max_confidence", "extra_ratio")
        need(not any(c.isalnum() for c in self.separators), "separators cannot be letters or digits")


@dataclass(frozen=True)
class Config:
    detection: Detection = field(default_factory=Detection)
    validation: Validation = field(default_factory=Validation)
    tracking: Tracking = field(default_factory=Tracking)
    buffer: Buffer = field(default_factory=Buffer)
    image_quality: Quality = field(default_factory=Quality)
    video_quality: Quality = field(default_factory=lambda: Quality(normalized_height=None))
    image_ownership: ImageOwnership = field(default_factory=ImageOwnership)
    video_ownership: VideoOwnership = field(default_factory=VideoOwnership)
    fusion: Fusion = field(default_factory=Fusion)
    text: PlateText = field(default_factory=PlateText)
    low_confidence: float = 0.50

    def __post_init__(self):
        _within(self, 0, 1, "low_confidence")
