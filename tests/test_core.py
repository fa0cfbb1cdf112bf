"""Operators on boxes, tracks, readings and texts: golden values, brute force, partition invariance."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon import config
from quillon.functions import geometry as g
from quillon.functions import plate_text, scores
from quillon.operators import assign, detections, evidence, fusion, ownership, results, tracking


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def lit_box(*sides):
    return g.box(*[F.lit(s) for s in sides])


# ---- geometry and scores -----------------------------------------------------------------


def test_box_values(spark):
    a, b = lit_box(0, 0, 10, 10), lit_box(5, 0, 15, 10)
    local, parent = lit_box(-5, 5, 100, 40), lit_box(10, 10, 40, 30)
    r = one(
        spark, iou=g.iou(a, b), part=g.over_first(a, lit_box(0, 0, 5, 10)), none=g.iou(a, lit_box(3, 3, 3, 9)),
        image=g.to_global(local, parent, F.lit(100), F.lit(100), False), video=g.to_global(local, parent, F.lit(100), F.lit(100), True),
        odd=g.valid(lit_box(0.0, 0.0, float("nan"), 1.0)), out=g.exact_crop(lit_box(-1, 0, 5, 5), F.lit(9), F.lit(9)),
    )
    assert r.iou == pytest.approx(1 / 3) and r.part == 0.5 and r.none == 0
    assert tuple(r.image) == (5, 15, 100, 50) and tuple(r.video) == (10, 15, 40, 30)
    assert r.odd is False and r.out is None


def test_weights_and_confidence(spark):
    r = one(
        spark, w=scores.evidence_weight(F.lit("x"), F.lit(0.9), F.lit(0.8), F.lit(None)), p=scores.evidence_weight(F.lit("x"), F.lit(0.9), F.lit(0.8), F.lit(0.1)), e=scores.evidence_weight(F.lit(""), F.lit(1.0), F.lit(1.0)),
        single=scores.fusion_confidence(F.lit(1.0), F.lit(0.9), F.lit(0.9), F.lit(1)), lost=scores.lost_frames(F.lit(5.0)), r6=scores.rounded(F.lit(0.1234565)),
    )
    assert r.w == pytest.approx(0.72) and r.p == pytest.approx(0.072) and r.e == 0
    assert r.single == pytest.approx(0.95 * (0.5 + 0.5 / 3)) and r.lost == 2 and r.r6 == 0.123456


@pytest.mark.parametrize("make", [lambda: config.Buffer(top_k=0), lambda: config.Tracking(low=0.6), lambda: config.Fusion(ocr_weight=0.5), lambda: config.ImageOwnership(min_samples=30), lambda: config.PlateText(separators="a"), lambda: config.VideoOwnership(conflict_iou=0), lambda: config.Validation(min_width=0)])
def test_configurations_reject(make):
    with pytest.raises(ValueError):
        make()


# ---- plate texts -------------------------------------------------------------------------

GOLDEN = [
    # text, class, corrected, formatted, status, reason
    ("72a16231", "car", "72A16231", "72A-162.31", "ok", None),
    ("51b77569", "car", "51B77569", "51B-775.69", "ok", None),
    ("64a20633", "car", "64A20633", "64A-206.33", "ok", None),
    ("72A162", "car", "72A162", None, "unrecognized_format", "invalid_length"),
    ("72A1623", "car", "72A1623", "72A-16.23", "ok", None),
    ("72A16O31", "car", "72A16031", "72A-160.31", "corrected", None),
    ("72816231", "car", "72B16231", "72B-162.31", "corrected", None),
    ("72016231", "car", "72016231", None, "unrecognized_format", "invalid_serial"),
    ("72A816231", "motorcycle", "72A816231", "72A8-162.31", "ok", None),
    ("7ZA16O3B", "car", "7ZA16O3B", None, "low_format_confidence", "too_many_position_corrections"),
    ("13A16231", "car", "13A16231", None, "unrecognized_format", "unknown_locality_code"),
    (" 72a-162.31\t", "car", "72A16231", "72A-162.31", "ok", None),
    ("", "car", "", None, "no_text", "empty_text"),
    (None, "car", "", None, "no_text", "empty_text"),
]


def test_plate_texts(spark):
    df = spark.createDataFrame([(i, *x[:2]) for i, x in enumerate(GOLDEN)], "i int, t string, c string").repartition(3)
    post = results.once(df, "p", plate_text.postprocess(F.col("t"), F.lit(0.9), plate_text.preferred_family(F.col("c"))))
    got = {r.i: r.p for r in post.collect()}
    for i, (_, _, corrected, formatted, status, reason) in enumerate(GOLDEN):
        assert (got[i].corrected_text, got[i].formatted_text, got[i].status, got[i].format_reason) == (corrected, formatted, status, reason), GOLDEN[i]
    assert [tuple(c) for c in got[5].corrections] == [(5, "O", "0", "digit_expected")]


def test_a_doubtful_character_is_left_out(spark):
    p = F.array(*[F.lit(x) for x in (0.9, 0.9, 0.9, 0.9, 0.3, 0.9, 0.9, 0.9, 0.9)])
    r = one(spark, r=plate_text.postprocess(F.lit("66h9a6666"), F.lit(0.8), F.lit("motorbike_common"), p)).r
    assert r.corrected_text == "66H96666" and r.formatted_text == "66H9-66.66" and [tuple(c) for c in r.corrections] == [(4, "A", "", "low_confidence_extra_character")]
    assert one(spark, r=plate_text.postprocess(F.lit("66h9a6666"), F.lit(0.8), F.lit("motorbike_common"))).r.status == "unrecognized_format"


def test_status_orders_differ(spark):
    post = plate_text.postprocess(F.lit("XYZ"), F.lit(0.2), F.lit("car_common"))
    r = one(spark, image=results.image_status(post, F.lit("car"), F.lit(1)), video=results.video_status(results.video_post(post, F.lit("XYZ"), F.lit("car")), F.lit(1), F.lit(0.2)))
    assert r.image.status == "low_confidence" and r.video.status == "unrecognized_format"
    post = plate_text.postprocess(F.lit("72A162311"), F.lit(0.9), F.lit("car_common"))
    r = one(spark, image=results.image_status(post, F.lit("car"), F.lit(1)), video=results.video_post(post, F.lit("72A162311"), F.lit("car")), none=results.image_status(post, F.lit("car"), F.lit(0)))
    assert r.image.status_reason == r.video.reason == "vehicle_plate_family_mismatch" and r.image.formatted is None and r.none.status == "no_plate"


# ---- frames ------------------------------------------------------------------------------


def slow_nms(boxes, threshold):
    kept = []
    for b in sorted(boxes, key=lambda b: (-b[1], b[0])):
        if all(slow_iou(b[2:], k[2:]) <= threshold for k in kept):
            kept.append(b)
    return {k[0] for k in kept}


def slow_iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    i = max(w, 0) * max(h, 0)
    u = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i
    return i / u if u > 0 else 0


@pytest.mark.parametrize("parts", [1, 7])
def test_suppression_against_a_loop(spark, parts):
    rng = np.random.default_rng(4)
    rows = []
    for f in range(6):
        for i in range(9):
            x, y = rng.integers(0, 20, 2)
            rows.append((f, i, float(rng.integers(0, 4)) / 4, float(x), float(y), float(x + 15), float(y + 12)))
    df = spark.createDataFrame(rows, "frame int, i int, conf double, x1 double, y1 double, x2 double, y2 double").repartition(parts)
    got = {(r.frame, r.i) for r in detections.suppressed(df, ["frame"], 0.45, [-F.col("conf"), F.col("i")]).collect()}
    assert got == {(f, i) for f in range(6) for i in slow_nms([r[1:] for r in rows if r[0] == f], 0.45)}


def test_two_rows_of_tilted_glyphs(spark):
    glyphs = [("6", 10, 10), ("6", 30, 12), ("H", 50, 14), ("9", 70, 16), ("A", 5, 40), ("6", 25, 42), ("6", 45, 44), ("6", 65, 46), ("6", 85, 48)]
    rows = [(1, c, 0.9, x, y, x + 15, y + 34) for c, x, y in glyphs] + [(2, "A", 0.5, 9, 0, 12, 9), (2, "B", 1.0, 0, 1, 5, 9)]
    got = {r.crop: r for r in detections.reading(spark.createDataFrame(rows, "crop int, char string, confidence double, x1 int, y1 int, x2 int, y2 int").repartition(4), ["crop"]).collect()}
    assert got[1].text == "66H9A6666" and got[1].n_rows == 2
    assert got[2].text == "BA" and got[2].n_rows == 1 and got[2].confidence == 0.75


def test_validation_reasons_in_order(spark):
    rows = [(1, 0, "car", 0.9, 10, 10, 50, 40), (1, 1, "car", 0.8, 11, 10, 51, 40), (1, 2, "boat", 0.1, -1, 0, 5, 3), (1, 3, "bus", 0.4, 0, 0, 100, 90), (1, 4, "car", 0.9, 20, 20, 20, 30)]
    df = spark.createDataFrame(rows, "frame int, i int, class_name string, conf double, x1 int, y1 int, x2 int, y2 int").withColumns({"frame_w": F.lit(100), "frame_h": F.lit(100)})
    got = {r.i: r.reasons for r in detections.validated(df, ["frame"]).collect()}
    assert got == {0: [], 1: ["duplicate_vehicle_box"], 2: ["unknown_vehicle_class", "low_confidence", "bbox_out_of_frame", "too_small"], 3: ["low_confidence", "wide_edge_bbox_low_confidence"], 4: ["too_small", "invalid_bbox"]}


# ---- assignment and ownership ------------------------------------------------------------


@pytest.mark.parametrize("shape", [(1, 1), (2, 3), (3, 2), (4, 4), (5, 3)])
def test_assignment_against_all_permutations(shape):
    rng = np.random.default_rng(12345)
    for _ in range(30):
        costs = rng.integers(-5, 10, shape).astype(float)
        rows, columns = assign.solve(costs)
        wide = costs if shape[0] <= shape[1] else costs.T
        best = min(sum(wide[i, p[i]] for i in range(len(wide))) for p in itertools.permutations(range(wide.shape[1]), len(wide)))
        assert costs[rows, columns].sum() == best and len(rows) == min(shape)


def test_the_limit_leaves_pairs_alone():
    assert assign.match(np.array([[0.2, 0.9], [0.9, 0.95]]), 0.83) == [(0, 0)]
    assert assign.match(np.array([[1.0]]), 1.0) == [(0, 0)] and assign.match(np.zeros((0, 2)), 1.0) == []
    with pytest.raises(ValueError):
        assign.solve(np.array([[np.inf]]))


def candidates(spark, rows):
    box = lambda p: F.struct(*[F.col(f"{p}{s}").alias(s) for s in g.SIDES])
    flat = spark.createDataFrame(rows, "frame_id int, candidate_index int, track_id int, px1 int, py1 int, px2 int, py2 int, vx1 int, vy1 int, vx2 int, vy2 int, plate_confidence double, vehicle_confidence double, coordinate_clamped boolean")
    return flat.select("frame_id", "candidate_index", "track_id", F.col("track_id").alias("vehicle_index"), box("p").alias("plate"), box("v").alias("vehicle"), "plate_confidence", "vehicle_confidence", "coordinate_clamped")


def test_the_tight_vehicle_owns_the_plate(spark):
    rows = [(0, 0, 1, 100, 100, 140, 120, 0, 0, 400, 300, 0.71, 0.9, False), (0, 1, 2, 100, 100, 140, 120, 90, 60, 150, 130, 0.60, 0.9, False), (0, 2, 2, 92, 62, 100, 70, 90, 60, 150, 130, 0.1, 0.9, False), (0, 3, 3, 0, 0, 9, 9, 5, 5, 50, 50, 0.9, 0.9, False), (0, 4, 4, 10, 10, 20, 20, 0, 0, 50, 50, 0.9, 0.9, True)]
    got = {r.candidate_index: (r.ownership_status, r.conflict_group) for r in ownership.video_ownership(candidates(spark, rows).repartition(3), ["frame_id"]).collect()}
    assert got == {0: ("rejected_conflict", 0), 1: ("selected", 0), 2: ("rejected_same_track", None), 3: ("rejected_outside_vehicle", None), 4: ("rejected_outside_vehicle", None)}


def test_components_over_a_chain(spark):
    nodes = spark.createDataFrame([(0, i) for i in range(7)], "f int, i int")
    edges = spark.createDataFrame([(0, 4, 5), (0, 1, 2), (0, 2, 4)], "f int, a int, b int")
    assert {r.i: r.component for r in ownership.components(nodes, edges, ["f"], "i").collect()} == {0: 0, 1: 1, 2: 1, 3: 3, 4: 1, 5: 1, 6: 6}


def test_history_rejects_a_jump(spark):
    rows = [(f, 0, 1, 20, 60, 50, 75, 0, 0, 100, 100, 0.9, 0.9, False) for f in range(6)] + [(6, 0, 1, 60, 10, 90, 25, 0, 0, 100, 100, 0.9, 0.9, False), (7, 0, 1, 21, 60, 51, 75, 0, 0, 100, 100, 0.9, 0.9, False)]
    df = candidates(spark, rows).withColumns({"source_id": F.lit(1), "frame_index": F.col("frame_id")})
    got = {r.frame_index: r for r in ownership.image_ownership(df).collect()}
    assert [got[f].selected for f in range(8)] == [True] * 6 + [False, True]
    assert got[4].temporal_score == 0.5 and got[5].temporal_score == pytest.approx(1.0) and got[6].rejected_by_history and got[7].history_samples == 6
    assert ownership.resolution_stats(ownership.image_ownership(df), ["source_id"]).first().final_results == 7


# ---- evidence ----------------------------------------------------------------------------


def crops(spark, rows):
    full = [(1, f, 0, 60, 30, 0.9, s, 0.9) for f, s in rows]
    return spark.createDataFrame(full, "track_id int, frame_index int, candidate_index int, width int, height int, sharpness_score double, total_score double, plate_confidence double")


def test_spaced_choice_beats_the_greedy_one(spark):
    got = evidence.spaced(crops(spark, [(0, 0.8), (1, 0.85), (2, 0.9), (6, 0.8)]), ["track_id"]).orderBy("rank").collect()
    assert [(r.rank, r.frame_index) for r in got] == [(1, 1), (2, 6)]


@pytest.mark.parametrize("gap", [0, 3, 5])
def test_spaced_choice_against_all_sets(spark, gap):
    rng = np.random.default_rng(gap)
    c = config.Buffer(top_k=3, min_gap=gap)
    for k in range(4):
        rows = [(int(f), float(s)) for f, s in zip(np.sort(rng.choice(18, 9, replace=False)), rng.choice([0.6, 0.7, 0.75, 0.9], 9))]
        got = sorted(r.frame_index for r in evidence.spaced(crops(spark, rows).repartition(2), ["track_id"], c).collect())
        sets = [s for n in (1, 2, 3) for s in itertools.combinations(rows, n) if all(b[0] - a[0] >= gap for a, b in itertools.pairwise(s))]
        rank = lambda s: (sum(x[1] for x in sorted(s, key=lambda x: (x[1], x[0]), reverse=True)), sorted(((x[1], x[0]) for x in s), reverse=True))
        best = max(sets, key=rank)
        assert got == [x[0] for x in best], (k, rows)


def test_rejections_and_late_frames(spark):
    df = spark.createDataFrame([(1, 1, 39, 10, 0.0, 0.0), (1, 2, 40, 23, 0.0, 0.0), (1, 3, 40, 24, 0.69, 0.0), (1, 4, 40, 24, 0.7, 0.59), (1, 5, 40, 24, 0.7, 0.6)], "track_id int, frame_index int, width int, height int, sharpness_score double, total_score double")
    assert [r.r for r in df.orderBy("frame_index").select(evidence.rejection().alias("r")).collect()] == ["crop_too_narrow", "crop_too_short", "sharpness_too_low", "quality_score_too_low", None]
    came = spark.createDataFrame([(1, 0, 5), (1, 1, 5), (1, 2, 4), (1, 3, 6)], "track_id int, n int, frame_index int")
    assert [r.late for r in evidence.late(came, ["track_id"], ["n"]).orderBy("n").collect()] == [False, False, True, False]


# ---- fusion ------------------------------------------------------------------------------


def readings(spark, rows):
    full = [(3, i, i, t, o, q, c) for i, (t, o, q, *rest) in enumerate(rows) for c in [rest[0] if rest else None]]
    return spark.createDataFrame(full, "track_id int, frame_index int, rank int, raw_text string, ocr_confidence double, quality_score double, char_confidences array<double>")


@pytest.mark.parametrize(
    "rows, text, method",
    [
        ([("64a20633", 0.9, 0.9), ("64a2033", 0.9, 0.9), ("64a20533", 0.9, 0.9), ("64a20633", 0.9, 0.9)], "64a20633", "sequence_alignment"),
        ([("ABCDEF", 0.95, 0.9), ("ABXCDEF", 0.8, 0.8), ("ABCDZF", 0.8, 0.8)], "ABCDEF", "sequence_alignment"),
        ([("ABC", 0.95, 1.0), ("AXC", 0.30, 0.4), ("AXC", 0.28, 0.4)], "ABC", "weighted_exact_vote"),
        ([("ABC", 0.9, 0.9)], "ABC", "single_candidate"),
        ([("", 0.9, 0.9), (None, 0.9, 0.9)], "", "no_valid_ocr"),
        ([("AB", 0.0, 0.9), ("AC", 0.0, 0.9)], "AB", "sequence_alignment"),
    ],
)
def test_fused_texts(spark, rows, text, method):
    got = fusion.fused(readings(spark, rows).repartition(2)).first()
    assert (got.raw_text, got.method) == (text, method)


def test_alignment_is_cheapest_and_settles_ties():
    assert fusion.align("64a20633", "64a2033")[5] == ("6", fusion.GAP)
    for a, b in (("", "ab"), ("kitten", "sitting"), ("abc", "abc"), ("xxa", "a")):
        pairs = fusion.align(a, b)
        assert "".join(x for x, _ in pairs if x != fusion.GAP) == a and "".join(y for _, y in pairs if y != fusion.GAP) == b
    assert sum(x != y for x, y in fusion.align("kitten", "sitting")) == 3


def test_a_gap_needs_more_weight_than_the_best_character():
    assert fusion.voted("AB", ["AB", "A"], [0.5, 0.5], [None, None])[0] == "AB"
    assert fusion.voted("AB", ["AB", "A"], [0.5, 0.6], [None, None])[0] == "A"
    assert fusion.voted("AB", ["AB", "A"], [0.5, 0.4], [[1.0, 0.5], None])[0] == "A"


def test_report_counts_tracks_without_readings(spark):
    rows = fusion.fused(readings(spark, [("ABC", 0.9, 0.9)]), spark.createDataFrame([(8,)], "track_id int"))
    r = fusion.report(rows).first()
    assert (r.tracks, r.tracks_with_ocr, r.no_valid_ocr, r.single_candidate) == (2, 1, 1, 1) and r.mean_confidence == pytest.approx(r.mean_confidence_with_ocr / 2)


def test_readings_from_json(spark):
    lines = ['{"track_id": 4, "raw_text": "A", "confidence": 2, "quality_score": "x"}', '{"ocr": {"raw_text": "B", "confidence": 0.5, "char_confidences": [0.1]}, "status": "bad"}', "nonsense"]
    got = fusion.from_json(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r.track_id, r.raw_text, r.ocr_confidence, r.quality_score, r.status) for r in got] == [(4, "A", 1.0, 0.0, "ok"), (0, "B", 0.5, 0.0, "bad"), (0, "", 0.0, 0.0, "ok")]
    assert got[1].char_confidences == [0.1]


# ---- tracks ------------------------------------------------------------------------------


def run(frames, fps=10.0):
    """frames: for each frame boxes (conf, x1, y1, x2, y2[, class])."""
    t = tracking.Tracker(fps)
    out = []
    for f, boxes in enumerate(frames):
        a = np.array([b[1:5] for b in boxes], float).reshape(-1, 4)
        out.append(t.step(f, a, np.array([b[0] for b in boxes], float), np.array([b[5] if len(b) > 5 else 2 for b in boxes], int)))
    return t, out


def test_weak_detections_keep_a_track():
    t, out = run([[(c, 10 + f, 10, 50 + f, 40)] for f, c in enumerate((0.8, 0.7, 0.3, 0.25, 0.8))])
    assert {v[0][0][1] for v in out} == {1} and sum(e[1] == "second_stage" for _, es in out for e in es) == 2
    assert t.history[1]["hits"] == 5


def test_weak_detections_start_no_track():
    assert run([[(0.54, 10, 10, 50, 40)], [(0.3, 10, 10, 50, 40)]])[0].history == {}


def test_lost_tracks_come_back_or_time_out():
    seen, none = [(0.9, 10, 10, 50, 40)], []
    c = config.Tracking(max_lost_seconds=0.3)
    t = tracking.Tracker(10, c)
    for f, boxes in enumerate([seen, none, none, none, seen, none, none, none, none]):
        a = np.array([b[1:5] for b in boxes], float).reshape(-1, 4)
        visible, events = t.step(f, a, np.array([b[0] for b in boxes]), np.full(len(boxes), 2))
        if f == 4:
            assert visible[0][1] == 1 and visible[0][4] and (1, "reactivated") in events
    assert t.history[1]["removal_reason"] == "timeout" and len(t.ids) == 0
    with pytest.raises(ValueError):
        t.step(3, np.zeros((0, 4)), np.zeros(0), np.zeros(0, int))


def test_coinciding_tracks_lose_the_younger():
    a = lambda f: (0.9, 10 + 3 * f, 10, 50 + 3 * f, 40)
    b = lambda f: (0.9, 100 - 20 * f if f < 4 else 10 + 3 * f, 10, 140 - 20 * f if f < 4 else 50 + 3 * f, 40)
    t, out = run([[a(f), b(f)] for f in range(8)])
    dead = [k for k, h in t.history.items() if h["removal_reason"] == "duplicate"]
    assert dead == [] or dead == [2]
    three = [[(0.9, 10, 10, 50, 40)] * 1] + [[(0.9, 10, 10, 50, 40), (0.9, 10, 10, 50, 40)]] * 3
    assert len(run(three)[0].history) == 1  # a second box over a visible track starts none


def test_crossing_vehicles_keep_their_ids():
    frames = [[(0.9, 10 + 4 * f, 10, 50 + 4 * f, 40), (0.9, 190 - 4 * f, 60, 230 - 4 * f, 90)] for f in range(30)]
    _, out = run(frames)
    assert all([v[1] for v in visible] == [1, 2] for visible, _ in out)


def observations(spark, sources=3, frames=20):
    rows = [(s, f, 0, 2, 0.9 if (f + s) % 5 else 0.3, 10 + 2 * f, 10, 50 + 2 * f, 40) for s in range(sources) for f in range(frames) if (f + s) % 7]
    return spark.createDataFrame(rows, "source_id bigint, frame_index int, det_index int, class_id int, conf double, x1 int, y1 int, x2 int, y2 int")


def test_batches_do_not_depend_on_partitions(spark):
    df = observations(spark)
    a, b = (sorted(map(tuple, tracking.tracked(df.repartition(n)).collect()), key=str) for n in (1, 7))
    assert a == b
    h = tracking.histories(tracking.tracked(df)).collect()
    assert len(h) == 3 and all(r.track_id == 1 for r in h)
    assert tracking.counters(tracking.tracked(df), ["source_id"]).agg(F.sum("tracks_created")).first()[0] == 3


def test_class_votes_and_streaks(spark):
    df = spark.createDataFrame([(1, 0, "truck"), (1, 1, "car"), (1, 3, "truck"), (1, 4, "car")], "t int, frame_index int, class_name string")
    r = tracking.class_vote(df, ["t"]).first()
    assert r.class_name == "car" and r.class_counts == {"car": 2, "truck": 2}
    assert [x.streak for x in tracking.streaks(df, ["t"]).orderBy("frame_index").collect()] == [1, 2, 1, 2]
    assert [x.missed_frames for x in tracking.missed(df, ["t"]).orderBy("frame_index").collect()] == [None, 0, 1, 0]


# ---- results -----------------------------------------------------------------------------


def test_customers_see_good_rows_only(spark):
    plate = "struct<status:string,format_valid:boolean,formatted:string,text:string,normalized_text:string,raw_text:string,confidence:double>"
    rows = [(1, ("ok", True, "A-1", "A1", "A1", "a1", 0.9)), (2, ("no_ocr", None, None, None, None, None, 0.0)), (3, ("ok", True, None, " ", "A2", "a2", 0.8)), (4, ("ok", True, "A-3", "A3", "A3", "a3", 0.4))]
    df = spark.createDataFrame(rows, f"track_id int, plate {plate}").withColumn("vehicle", F.struct(F.lit("car").alias("class_name")))
    assert [(r.track_id, r.license) for r in results.customer(df, "track_id", 0.5).orderBy("track_id").collect()] == [(1, "A-1"), (3, "A2")]
    assert [r.track_id for r in results.customer(df, "track_id", 0.5, video=True).collect()] == [1]


def test_passes_must_have_the_same_frames(spark):
    a = spark.createDataFrame([(1, 0), (1, 1)], "s int, f int")
    assert results.aligned_frames(a, a, ["s", "f"]).filter("aligned").count() == 2
    with pytest.raises(Exception, match="fewer frames"):
        results.aligned_frames(a, a.limit(1), ["s", "f"]).collect()


def test_marked_and_empty(spark):
    rows = spark.createDataFrame([(0, 0, 0.9), (0, 1, 0.2), (0, 2, 0.05)], "f int, b int, conf double")
    edges = spark.createDataFrame([(0, 0, 0, 0.1)], "f int, a int, b int, cost double")
    got = {r.b: r.status for r in assign.marked(rows, assign.assigned(edges, ["f"], 0.8), ["f", "b"], F.col("conf") >= 0.1).collect()}
    assert got == {0: "matched", 1: "unmatched_low_confidence", 2: "not_eligible"}
    assert assign.assigned(edges.limit(0), ["f"], 0.8).count() == 0
    assert isinstance(tracking.as_frame([], {}), pd.DataFrame)


def test_edges_that_rival_match_at_the_least_sum_of_doubles():
    """Against all ways to match, summed row after row: ways that differ by a rounding count as different, none is worse."""
    rng = np.random.default_rng(3)
    owner, rows, columns, prices, least = [], [], [], [], {}
    for group in range(150):
        n, m = rng.integers(1, 5, 2)
        cost = rng.integers(1, 9, (n, m)) / 10  # many sums that differ by rounding only
        edges = [(i, j) for i in range(n) for j in range(m) if rng.random() < 0.8]
        owner += [group] * len(edges)
        rows, columns, prices = rows + [e[0] for e in edges], columns + [e[1] for e in edges], prices + [float(cost[e]) for e in edges]
        ways = [(0.0, frozenset())]
        for i in range(n):
            ways += [(t + (cost[i, j] - 0.83 - 1e-6), used | {j}) for t, used in ways for j in range(m) if (i, j) in edges and j not in used]
        least[group] = min(t for t, _ in ways)
    owner, rows, columns, prices = np.array(owner), np.array(rows), np.array(columns), np.array(prices)
    values = prices - 0.83 - 1e-6
    got = assign.matched(owner, rows, columns, prices, values, 0.83)
    for group, total in least.items():
        own = got[owner[got] == group]
        assert len(set(rows[own])) == len(own) == len(set(columns[own]))
        assert np.cumsum(np.append(0.0, values[own][np.argsort(rows[own])]))[-1] == total


def test_only_frames_of_sources_are_resolved_as_one_at_a_time():
    """Sources of one frame, resolved together, against one frame at a time; an area is a ratio of areas."""
    rng = np.random.default_rng(5)
    size = rng.integers(1, 8, 300)
    start = np.concatenate([[0], np.cumsum(size)])
    n = start[-1]
    corner = rng.integers(0, 40, (n, 2)).astype(float)
    plate = np.hstack([corner, corner + rng.integers(0, 30, (n, 2))])
    vehicle = np.hstack([np.zeros((n, 2)), 43.0 + rng.integers(0, 30, (n, 2))])
    owner, sure, other = rng.integers(0, 3, n), rng.integers(0, 1000, n) / 1000, rng.integers(0, 1000, n) / 1000
    c = config.ImageOwnership()
    together = ownership.resolve_first(start, plate, vehicle, owner, sure, other, c)
    for i, j in zip(start[:-1], start[1:]):
        alone = ownership.resolve_frame(plate[i:j], vehicle[i:j], owner[i:j], sure[i:j], other[i:j], ownership.History(c))
        for x, y in zip(together, alone):
            assert x[i:j].tolist() == y.tolist()
    plate, vehicle = np.array([[20.0, 25, 53, 42], [20, 25, 51, 41]]), np.array([[0.0, 0, 57, 77], [0, 0, 57, 77]])
    tight = ownership.resolve_frame(plate, vehicle, np.array([0, 1]), np.array([0.5, 0.5]), np.array([0.5, 0.5]), ownership.History(c))[4]
    assert tight.tolist() == [1.0, (31 * 16 / (57 * 77)) / (33 * 17 / (57 * 77))]


def test_spaced_crops_have_the_largest_sum_of_doubles(spark):
    """Against all sets of four crops or fewer, summed from the best down; many totals differ by rounding only."""
    rng = np.random.default_rng(11)
    rows, want = [], {}
    for track in range(60):
        at = np.sort(rng.choice(30, rng.integers(6, 13), replace=False))
        own = [(float(rng.choice([0.61, 0.64, 0.67, 0.7, 0.73, 0.76])), 0.7 + int(rng.integers(3)) / 10, 0.5, int(f), 0) for f in at]
        rows += [(track, f, k, 60, 40, sharp, total, sure) for total, sharp, sure, f, k in own]
        sets = [sorted(s, reverse=True) for n in range(1, 5) for s in itertools.combinations(own, n) if all(b[3] - a[3] >= 5 for a, b in zip(s, s[1:]))]
        top = max(sets, key=lambda s: (np.cumsum([0.0, *(x[0] for x in s)])[-1], s))
        want[track] = [x[3] for x in top]
    df = spark.createDataFrame(rows, "track_id int, frame_index int, candidate_index int, width int, height int, sharpness_score double, total_score double, plate_confidence double")
    got = {}
    for r in evidence.spaced(df, ["track_id"]).orderBy("track_id", "rank").collect():
        got.setdefault(r.track_id, []).append(r.frame_index)
    assert got == want


def test_crop_paths_keep_all_digits_of_a_frame(spark):
    from quillon.sources import sinks

    row = spark.range(1).select(*[sinks.crop_path(F.lit(7), F.lit(1), F.lit(f)).alias(str(f)) for f in (42, 999999, 1004300)]).first()
    assert list(row) == ["track_7/top1_frame000042.jpg", "track_7/top1_frame999999.jpg", "track_7/top1_frame1004300.jpg"]
