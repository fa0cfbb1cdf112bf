"""Final rows: status tables, nesting, customer view, summaries (DT1 to DT4, PR17 to PR20, FI11, AG19, JN11 to JN16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import plate_text
from quillon.functions.scores import rounded


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that the optimizer does not substitute into later expressions: a one-element explode.

    Text results are large expressions with many fields; filters on the fields,
    pushed below them, would repeat the expression for every mention.
    """
    return df.drop(name).select("*", F.explode(F.array(value)).alias(name))


def missing_evidence(observations: Column, has_text: Column) -> Column:
    """DT1."""
    return F.when(F.coalesce(observations, F.lit(0)) <= 0, "no_plate").when(~F.coalesce(has_text, F.lit(False)), "no_ocr")


def image_status(post: Column, vehicle_class: Column, observations: Column, low: float = 0.5) -> Column:
    """DT2: (status, status_reason, format_valid, formatted, format_reason)."""
    clash = F.coalesce(vehicle_class.isin("car", "bus", "truck") & (post["format_family"] == "motorbike_common"), F.lit(False))
    weak = post["fusion_confidence"] < low
    costly = post["status"] == "low_format_confidence"
    none = missing_evidence(observations, post["raw_text"] != "")
    status = F.when(none.isNotNull(), none).when(clash | weak | costly, "low_confidence").when(post["status"] == "unrecognized_format", "unrecognized_format").otherwise("ok")
    reason = (
        F.when(none.isNotNull(), None)
        .when(clash, "vehicle_plate_family_mismatch")
        .when(weak, "weak_ocr_evidence")
        .when(costly, "too_many_position_corrections")
        .when(post["status"] == "unrecognized_format", "no_known_format_family")
    )
    return F.struct(
        status.alias("status"),
        reason.alias("status_reason"),
        (post["format_valid"] & ~clash).alias("format_valid"),
        F.when(~clash, post["formatted_text"]).alias("formatted"),
        F.when(clash, "vehicle_plate_family_mismatch").otherwise(post["format_reason"]).alias("format_reason"),
    )


def video_post(post: Column, raw_text: Column, vehicle_class: Column) -> Column:
    """DT3: (status, reason, valid, formatted): blank texts are no reading, any clash of families counts."""
    family = plate_text.preferred_family(vehicle_class)
    blank = F.length(plate_text.strip(F.coalesce(raw_text, F.lit("")))) == 0
    clash = F.coalesce(post["format_family"] != family, F.lit(False))
    valid = ~blank & ~clash & post["format_valid"]
    return F.struct(
        F.when(blank, "no_ocr").when(clash, "vehicle_plate_family_mismatch").otherwise(post["status"]).alias("status"),
        F.when(blank, "no_ocr_candidates").when(clash, "vehicle_plate_family_mismatch").when(~valid, post["format_reason"]).alias("reason"),
        valid.alias("valid"),
        F.when(valid, post["formatted_text"]).alias("formatted"),
    )


def video_status(adapted: Column, observations: Column, confidence: Column, low: float = 0.5) -> Column:
    """DT4: (status, status_reason). An unknown format comes before weak evidence, other than in images."""
    none = missing_evidence(observations, adapted["status"] != "no_ocr")
    odd = adapted["status"].isin("low_format_confidence", "vehicle_plate_family_mismatch")
    status = F.when(none.isNotNull(), none).when(odd, "low_confidence").when(~adapted["valid"], "unrecognized_format").when(confidence < low, "low_confidence").otherwise("ok")
    reason = F.when(none == "no_plate", None).when(none.isNotNull() | odd | ~adapted["valid"], adapted["reason"]).when(confidence < low, "weak_ocr_evidence")
    return F.struct(status.alias("status"), reason.alias("status_reason"))


def finalize_video(tracks: DataFrame, votes: DataFrame, fused: DataFrame, observations: DataFrame, best: DataFrame, keys: list[str], low: float = 0.5) -> DataFrame:
    """JN14, PR17, TK4: one nested row per surviving track.

    ``tracks``: first_frame, last_frame, hits, removal_reason; ``votes``: class_name,
    class_counts; ``fused``: as from fusion; ``observations``: n; ``best``: each
    track's selected crops with rank, plate and frame_index.
    """
    top = best.groupBy(*keys).agg(F.count("*").alias("topk"), F.min_by(F.struct("plate", "frame_index"), "rank").alias("best"))
    n = observations.groupBy(*keys).agg(F.sum("n").alias("plates"))
    rows = tracks.filter(~F.col("removal_reason").eqNullSafe("duplicate")).join(votes, keys).join(fused.withColumnRenamed("raw_text", "fused_raw"), keys, "left").join(n, keys, "left").join(top, keys, "left")
    raw = F.when(F.col("valid_candidate_count") > 0, F.col("fused_raw"))
    confidence = F.coalesce("confidence", F.lit(0.0))
    rows = once(rows.withColumn("raw", raw), "post", plate_text.postprocess(raw, confidence, plate_text.preferred_family(F.col("class_name"))))
    rows = once(rows, "adapted", video_post(F.col("post"), F.col("raw"), F.col("class_name")))
    rows = once(rows, "final", video_status(F.col("adapted"), F.col("plates"), confidence, low))
    read = F.col("adapted.status") != "no_ocr"
    sides = F.array(*[F.col(f"best.plate.{s}") for s in ("x1", "y1", "x2", "y2")])
    return rows.select(
        *keys,
        F.struct("class_name", "class_counts", "first_frame", "last_frame", F.col("hits").alias("observations"), "removal_reason").alias("vehicle"),
        F.struct(
            F.col("final.status").alias("status"),
            F.col("final.status_reason").alias("status_reason"),
            F.col("adapted.status").alias("postprocess_status"),
            F.col("raw").alias("raw_text"),
            F.when(read, F.col("post.normalized_text")).alias("normalized_text"),
            F.when(read, F.col("post.corrected_text")).alias("text"),
            F.col("adapted.formatted").alias("formatted"),
            F.when(read, F.col("post.format_family")).alias("format_family"),
            F.col("adapted.valid").alias("format_valid"),
            F.col("adapted.reason").alias("format_reason"),
            rounded(confidence).alias("confidence"),
            F.coalesce("plates", F.lit(0)).alias("plate_observations"),
            F.when(F.col("best").isNotNull(), sides).alias("best_bbox_xyxy"),
            F.col("best.frame_index").alias("best_frame"),
        ).alias("plate"),
        F.struct(F.coalesce("valid_candidate_count", F.lit(0)).alias("ocr_candidates"), F.coalesce("method", F.lit("no_valid_ocr")).alias("fusion_method"), F.coalesce("support_count", F.lit(0)).alias("support_count"), F.coalesce("topk", F.lit(0)).alias("topk_selected")).alias("evidence"),
    )


def finalize_image(vehicles: DataFrame, plates: DataFrame, keys: list[str], low: float = 0.5) -> DataFrame:
    """JN13, PR17, TK4: one nested row per vehicle, with its plate and reading if it has any.

    ``vehicles``: class_id, class_name, frame_index; ``plates`` (at most one each):
    plate, layout, raw_text, ocr_confidence, char_confidences.
    """
    rows = vehicles.join(plates.withColumn("_has", F.lit(1)), keys, "left").withColumn("_has", F.coalesce("_has", F.lit(0)))
    confidence = F.coalesce("ocr_confidence", F.lit(0.0))
    rows = once(rows, "post", plate_text.postprocess(F.col("raw_text"), confidence, plate_text.preferred_family(F.col("class_name")), F.col("char_confidences")))
    rows = once(rows, "final", image_status(F.col("post"), F.col("class_name"), F.col("_has"), low))
    sides = F.array(*[F.col(f"plate.{s}") for s in ("x1", "y1", "x2", "y2")])
    has_text = (F.col("post.raw_text") != "").cast("int")
    return rows.select(
        *keys,
        F.struct("class_id", "class_name", F.col("frame_index").alias("first_frame"), F.col("frame_index").alias("last_frame"), F.lit(1).alias("observations")).alias("vehicle"),
        F.struct(
            F.col("final.status").alias("status"),
            F.col("final.status_reason").alias("status_reason"),
            F.col("post.status").alias("postprocess_status"),
            F.col("post.raw_text").alias("raw_text"),
            F.col("post.normalized_text").alias("normalized_text"),
            F.col("post.corrected_text").alias("text"),
            F.col("final.formatted").alias("formatted"),
            F.col("post.format_family").alias("format_family"),
            F.col("final.format_valid").alias("format_valid"),
            F.col("final.format_reason").alias("format_reason"),
            rounded(confidence).alias("confidence"),
            F.col("_has").alias("plate_observations"),
            F.col("layout").alias("layout"),
            F.when(F.col("_has") == 1, sides).alias("best_bbox_xyxy"),
            F.when(F.col("_has") == 1, F.col("frame_index")).alias("best_frame"),
        ).alias("plate"),
        F.struct(F.col("_has").alias("ocr_candidates"), F.lit(None).cast("string").alias("fusion_method"), has_text.alias("support_count")).alias("evidence"),
        # PR18: what a debug view adds
        F.struct("post.corrections", "post.unknown_characters").alias("debug"),
    )


def eligible(rows: DataFrame, least: float | None = None, formatted: bool = False) -> DataFrame:
    """FI11: rows that a customer may see."""
    p = F.col("plate")
    shown = F.coalesce(F.length(p["formatted"]) > 0, F.lit(False)) if formatted else plate_text.license_text(p).isNotNull()
    keep = (p["status"] == "ok") & F.coalesce(p["format_valid"], F.lit(False)) & shown
    return rows.filter(keep & (p["confidence"] >= least) if least is not None else keep)


def customer(rows: DataFrame, key: str, least: float | None = None, video: bool = False) -> DataFrame:
    """PR19."""
    text = F.col("plate.formatted") if video else plate_text.license_text(F.col("plate"))
    return eligible(rows, least, video).select(key, F.col("vehicle.class_name").alias("vehicle_type"), text.alias("license"), F.col("plate.confidence").alias("confidence"), F.col("plate.status").alias("status"))


def summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """AG19."""
    n = lambda s: F.count_if(F.col("plate.status") == s).alias(s)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("vehicles"),
        F.count_if(F.col("plate.plate_observations") > 0).alias("with_plate"),
        *[n(s) for s in ("ok", "low_confidence", "unrecognized_format", "no_ocr", "no_plate")],
    )


def responses(requests: DataFrame, rows: DataFrame, id_column: str, key: str, low: float = 0.5) -> DataFrame:
    """PR20: per request its response as a struct; plates in the order of ``key``. Both confidences are the plate's; there is no crop path."""
    video = eligible(rows, low, True).withColumn("input_type", F.lit("video"))
    image = eligible(rows, low).withColumn("input_type", F.lit("image"))
    plate = F.struct(
        plate_text.license_text(F.col("plate")).alias("plate_text"),
        F.col("plate.confidence").alias("detection_confidence"),
        F.col("plate.confidence").alias("ocr_confidence"),
        F.lit(None).cast("string").alias("crop_path"),
    )
    listed = video.unionByName(image).groupBy(id_column, "input_type").agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), plate.alias("p")))).alias("_p"))
    out = requests.join(listed, [id_column, "input_type"], "left")
    plates = F.coalesce(F.transform("_p", lambda x: x["p"]), F.array().cast("array<struct<plate_text:string,detection_confidence:double,ocr_confidence:double,crop_path:string>>"))
    return out.select(id_column, F.struct(F.lit("success").alias("status"), F.col("input_type"), F.size(plates).alias("count"), plates.alias("plates")).alias("response"))


def aligned_frames(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """JN11: both passes' frames side by side; a frame that only one pass has raises an error when the row is read."""
    a, b = first.withColumn("_a", F.lit(1)), second.withColumn("_b", F.lit(1))
    both = a.join(b, keys, "full")
    check = F.when(F.col("_a").isNull(), F.raise_error(F.lit("Pass 2 has more frames than pass 1"))).when(F.col("_b").isNull(), F.raise_error(F.lit("Pass 2 has fewer frames than pass 1")))
    return both.withColumn("aligned", F.coalesce(check.cast("boolean"), F.lit(True))).drop("_a", "_b")
