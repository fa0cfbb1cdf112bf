"""One text from a track's readings: votes, medoid, alignment (AG10 to AG16, ST1 to ST3, DT6, FI12, TK3, JN15, PR16).

Votes and the medoid are DataFrame work. Readings that no text wins clearly are
aligned with the medoid and voted column by column, in a grouped numpy kernel.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quillon.config import Fusion
from quillon.functions import scores
from quillon.operators.assign import spread

GAP = "<gap>"


def candidates(df: DataFrame, c: Fusion = Fusion()) -> DataFrame:
    """FI12, MA4: readings with text and their weight. Confidences outside 0 to 1 are clamped, null or NaN ones count 0."""
    clean = lambda n: F.least(F.greatest(F.coalesce(F.nanvl(F.col(n).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    rows = df.filter(F.coalesce("raw_text", F.lit("")) != "").withColumns({"ocr_confidence": clean("ocr_confidence"), "quality_score": clean("quality_score")})
    plate = F.col("plate_confidence") if c.use_plate_confidence and "plate_confidence" in df.columns else None
    return rows.withColumn("weight", scores.evidence_weight(F.col("raw_text"), F.col("ocr_confidence"), F.col("quality_score"), plate))


def from_json(df: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """PR16: readings from JSON objects, some with a nested `ocr`; missing or unreadable numbers are 0, a missing status is ok."""
    get = lambda *paths: F.coalesce(*[F.get_json_object(column, f"$.{p}") for p in paths])
    number = lambda x: F.coalesce(F.nanvl(x.try_cast("double"), F.lit(0.0)), F.lit(0.0))
    unit = lambda x: F.least(F.greatest(F.when(F.abs(number(x)) < float("inf"), number(x)).otherwise(0.0), F.lit(0.0)), F.lit(1.0))
    plate = get("plate_confidence")
    return df.select(
        *keep,
        F.coalesce(get("track_id").try_cast("bigint"), F.lit(0)).alias("track_id"),
        F.coalesce(get("frame_index").try_cast("int"), F.lit(0)).alias("frame_index"),
        F.coalesce(get("rank").try_cast("int"), F.lit(0)).alias("rank"),
        F.coalesce(get("raw_text", "ocr.raw_text"), F.lit("")).alias("raw_text"),
        unit(get("ocr_confidence", "confidence", "ocr.confidence")).alias("ocr_confidence"),
        unit(get("quality_score")).alias("quality_score"),
        F.from_json(get("char_confidences", "ocr.char_confidences"), "array<double>").alias("char_confidences"),
        F.when(plate.isNotNull(), unit(plate)).alias("plate_confidence"),
        F.coalesce(get("status", "ocr.status"), F.lit("ok")).alias("status"),
    )


def _total(column: str, order: Column) -> Column:
    """A sum in a fixed order, so that it is the same in every partitioning."""
    return F.aggregate(F.array_sort(F.collect_list(F.struct(order, F.col(column)))), F.lit(0.0), lambda a, x: a + x[column])


def exact_votes(weighted: DataFrame, key: str = "track_id") -> DataFrame:
    """AG10: (key, raw_text, n, weight, first_frame, place), place 1 for the winner."""
    votes = weighted.groupBy(key, "raw_text").agg(F.count("*").alias("n"), _total("weight", F.struct("rank", "frame_index")).alias("weight"), F.min("frame_index").alias("first_frame"))
    return votes.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("weight"), F.desc("n"), "first_frame", "raw_text")))


def consensus(weighted: DataFrame, key: str = "track_id") -> DataFrame:
    """AG11: (key, n_valid, total_weight, winner, winner_weight, n_winner, ratio)."""
    total = weighted.groupBy(key).agg(F.count("*").alias("n_valid"), _total("weight", F.struct("rank", "frame_index")).alias("total_weight"))
    won = exact_votes(weighted, key).filter("place = 1").select(key, F.col("raw_text").alias("winner"), F.col("weight").alias("winner_weight"), F.col("n").alias("n_winner"))
    ratio = F.when(F.col("total_weight") > 0, F.col("winner_weight") / F.col("total_weight")).otherwise(0.0)
    return total.join(won, key).withColumn("ratio", ratio)


def distance(a: Column, b: Column) -> Column:
    """ST2."""
    return F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def medoid(weighted: DataFrame, key: str = "track_id") -> DataFrame:
    """AG12: (key, medoid, cost): the text nearest to all readings by weight; ties by vote, confidences, first frame and text."""
    text = weighted.groupBy(key, "raw_text").agg(F.max("ocr_confidence").alias("ocr"), F.max("quality_score").alias("quality"), F.min("frame_index").alias("first_frame"), _total("weight", F.struct("rank", "frame_index")).alias("vote"))
    other = weighted.select(key, F.col("raw_text").alias("_other"), "weight", "rank", "frame_index")
    both = text.join(other, key).withColumn("part", F.col("weight") * distance(F.col("raw_text"), F.col("_other")))
    cost = both.groupBy(key, "raw_text", "ocr", "quality", "first_frame", "vote").agg(_total("part", F.struct("rank", "frame_index", "_other")).alias("cost"))
    best = F.min_by(F.struct("raw_text", "cost"), F.struct("cost", -F.col("vote"), -F.col("ocr"), -F.col("quality"), "first_frame", "raw_text"))
    return cost.groupBy(key).agg(best.alias("b")).select(key, F.col("b.raw_text").alias("medoid"), F.col("b.cost").alias("cost"))


def align(reference: str, text: str) -> list[tuple[str, str]]:
    """ST3: a cheapest alignment; where several are, pairs come before gaps in the text, and these before gaps in the reference, seen from the end."""
    n, m = len(reference), len(text)
    cost = np.zeros((n + 1, m + 1), int)
    cost[:, 0], cost[0] = np.arange(n + 1), np.arange(m + 1)
    for i, a in enumerate(reference, 1):
        for j, b in enumerate(text, 1):
            cost[i, j] = min(cost[i - 1, j - 1] + (a != b), cost[i - 1, j] + 1, cost[i, j - 1] + 1)
    out, i, j = [], n, m
    while i or j:
        if i and j and cost[i, j] == cost[i - 1, j - 1] + (reference[i - 1] != text[j - 1]):
            i, j = i - 1, j - 1
            out.append((reference[i], text[j]))
        elif i and cost[i, j] == cost[i - 1, j] + 1:
            i -= 1
            out.append((reference[i], GAP))
        else:
            j -= 1
            out.append((GAP, text[j]))
    return out[::-1]


def columns(reference: str, texts: list[str]) -> list[tuple[str, list[tuple[str, int]]]]:
    """AG13: the alignment's columns: the reference's token, and each text's (token, index in the text or -1)."""
    slots: list[list[list[tuple[str, int]]]] = []  # text, slot (before each reference place, and after the last), insertions
    tokens = []
    for text in texts:
        inserted: list[list[tuple[str, int]]] = [[] for _ in range(len(reference) + 1)]
        own, at = [], 0
        for ref, token in align(reference, text):
            where = inserted[len(own)] if ref == GAP else own
            where.append((token, -1 if token == GAP else at))
            at += token != GAP
        slots.append(inserted)
        tokens.append(own)
    out = []
    for place in range(len(reference) + 1):
        for k in range(max(len(s[place]) for s in slots)):
            out.append((GAP, [s[place][k] if k < len(s[place]) else (GAP, -1) for s in slots]))
        if place < len(reference):
            out.append((reference[place], [t[place] for t in tokens]))
    return out


def voted(reference: str, texts: list[str], weights: list[float], confidences: list[list[float] | None]) -> tuple[str, list[dict]]:
    """AG13, AG14: the fused text and the vote of each column.

    A character weighs its reading's weight times its own confidence, if known; a
    gap weighs the reading's whole weight, but must outweigh the best character.
    """
    text, votes = [], []
    for place, (ref, column) in enumerate(columns(reference, texts)):
        by: dict[str, float] = {}
        gap = 0.0
        for (token, at), weight, own in zip(column, weights, confidences):
            if token == GAP:
                gap += weight
            else:
                known = own is not None and at < len(own)
                by[token] = by.get(token, 0.0) + min(max(weight * own[at] if known else weight, 0.0), 1.0)
        best = max(by.values(), default=0.0)
        tied = [ch for ch, w in by.items() if abs(w - best) <= 1e-12]
        chosen = GAP if gap > best or not by else ref if ref in tied else min(tied)
        votes.append({"position": place, "reference_token": ref, "selected_token": chosen, "gap_weight": gap, "character_weights": sorted(by.items())})
        if chosen != GAP:
            text.append(chosen)
    return "".join(text), votes


ALIGNED = "fused_text string, columns array<struct<position:int,reference_token:string,selected_token:string,gap_weight:double,character_weights:array<struct<char:string,weight:double>>>>, alignment array<struct<frame_index:int,raw_text:string,tokens:array<string>>>"


def aligned(weighted: DataFrame, references: DataFrame, key: str = "track_id") -> DataFrame:
    """AG13 for each key of ``references`` (key, medoid): fused_text, columns, alignment rows. A track has at most a few readings."""
    own = F.col("char_confidences") if "char_confidences" in weighted.columns else F.lit(None)
    rows = weighted.join(references.select(key, "medoid"), key).select(key, "medoid", F.col("frame_index").cast("int").alias("frame_index"), "rank", "raw_text", "weight", own.cast("array<double>").alias("own"))

    def one(reference: str, readings: list[dict]) -> dict:
        texts = [r["raw_text"] for r in readings]
        text, votes = voted(reference, texts, [r["weight"] for r in readings], [r["own"] for r in readings])
        for v in votes:
            v["character_weights"] = [{"char": k, "weight": w} for k, w in v["character_weights"]]
        grid = columns(reference, texts)
        alignment = [{"frame_index": r["frame_index"], "raw_text": r["raw_text"], "tokens": [col[i][0] for _, col in grid]} for i, r in enumerate(readings)]
        return {"fused_text": text, "columns": votes, "alignment": alignment}

    def run(batches):
        for b in batches:
            made = [one(m, r) for m, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[f.name] for x in made], f.type) for f in to_arrow_schema(schema).remove(0))], schema.names)

    schema = StructType.fromDDL(f"{key} {rows.schema[key].dataType.simpleString()}, {ALIGNED}")
    listed = F.array_sort(F.collect_list(F.struct("rank", "frame_index", "raw_text", "weight", "own")))
    return spread(rows, key).groupBy(key, "medoid").agg(listed.alias("readings")).mapInArrow(run, schema)


def fused(readings: DataFrame, tracks: DataFrame | None = None, key: str = "track_id", c: Fusion = Fusion()) -> DataFrame:
    """DT6, AG15, JN15: one row per track: text, method, confidence, support.

    ``tracks`` adds tracks without readings (no_valid_ocr); by default the tracks
    are those of ``readings``, empty texts included.
    """
    weighted = candidates(readings, c)
    won = consensus(weighted, key)
    method = F.when(F.col("n_valid") == 1, "single_candidate").when((F.col("total_weight") > 0) & (F.col("ratio") >= c.consensus), "weighted_exact_vote").otherwise("sequence_alignment")
    won = won.withColumn("method", method)
    split = won.filter("method = 'sequence_alignment'").select(key)
    open_rows = weighted.join(split, key, "left_semi")
    texts = aligned(open_rows, medoid(open_rows, key), key).select(key, "fused_text", F.col("columns"))
    support = weighted.join(won.select(key, "winner", "method"), key).filter((F.col("method") == "sequence_alignment") | (F.col("raw_text") == F.col("winner")))
    order = F.struct("rank", "frame_index")
    support = support.groupBy(key).agg(
        (_total("ocr_confidence", order) / F.count("*")).alias("mean_ocr"),
        (_total("quality_score", order) / F.count("*")).alias("mean_quality"),
        F.count("*").alias("support_count"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "frame_index"))), lambda x: x["frame_index"]).alias("supporting_frames"),
    )
    ratio = F.when(F.col("n_valid") == 1, 1.0).otherwise(F.col("ratio"))
    out = won.join(support, key).join(texts, key, "left")
    out = out.select(
        key,
        F.coalesce("fused_text", "winner").alias("raw_text"),
        "method",
        scores.fusion_confidence(ratio, F.col("mean_ocr"), F.col("mean_quality"), F.col("n_valid"), c).alias("confidence"),
        "support_count",
        F.col("n_valid").alias("valid_candidate_count"),
        "total_weight",
        "winner_weight",
        ratio.alias("consensus_ratio"),
        "supporting_frames",
        "mean_ocr",
        "mean_quality",
        "columns",
    )
    universe = (readings.select(key) if tracks is None else readings.select(key).union(tracks.select(key))).distinct()
    out = universe.join(out, key, "left")
    zero = {n: F.coalesce(n, F.lit(0)) for n in ("confidence", "support_count", "valid_candidate_count", "total_weight", "winner_weight", "consensus_ratio", "mean_ocr", "mean_quality")}
    return out.withColumns({"raw_text": F.coalesce("raw_text", F.lit("")), "method": F.coalesce("method", F.lit("no_valid_ocr")), **zero})


def report(fused_rows: DataFrame) -> DataFrame:
    """AG16: one row over all tracks."""
    has = F.col("valid_candidate_count") > 0
    n = lambda m: F.count_if(F.col("method") == m).alias(m)
    return fused_rows.agg(
        F.count("*").alias("tracks"),
        F.count_if(has).alias("tracks_with_ocr"),
        *[n(m) for m in ("no_valid_ocr", "single_candidate", "weighted_exact_vote", "sequence_alignment")],
        F.coalesce(F.avg(F.when(has, F.col("confidence"))), F.lit(0.0)).alias("mean_confidence_with_ocr"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence"),
        F.coalesce(F.avg(F.when(has, F.col("consensus_ratio"))), F.lit(0.0)).alias("mean_consensus"),
    )
