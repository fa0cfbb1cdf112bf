"""Plate crops of a track: eligibility, rank, spaced choice (FI9, WI1, TK1, TK5, SS5, SS8, AG27)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.config import Buffer


def rejection(c: Buffer = Buffer()) -> Column:
    """FI9: the first rule that a crop breaks; null if it is eligible."""
    return (
        F.when(F.col("width") < c.min_width, "crop_too_narrow")
        .when(F.col("height") < c.min_height, "crop_too_short")
        .when(F.col("sharpness_score") < c.min_sharpness, "sharpness_too_low")
        .when(F.col("total_score") < c.min_quality, "quality_score_too_low")
    )


RANK = ("total_score", "sharpness_score", "plate_confidence", "frame_index", "candidate_index")


def ranked(df: DataFrame, keys: list[str]) -> DataFrame:
    """WI1: rows with rank, 1 for a track's best."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in RANK])))


def spaced(df: DataFrame, keys: list[str], c: Buffer = Buffer()) -> DataFrame:
    """TK1: per track at most top_k eligible crops, frames min_gap apart or more, of the largest total score; with rank.

    A total is the sum of doubles from the best crop down. Of equal totals the set
    wins whose ranks, best first, are larger. A track's crops are walked in order
    with, for each number of crops, the sets so far that may still become the best:
    the state of a fold, so no Python is needed. Sums of doubles may change places
    when a crop comes between, so all sets within a rounding of the largest total
    stay; of sets with the same scores the one of the larger ranks.
    """
    eligible = df.filter(rejection(c).isNull())
    rank = F.struct(*RANK)
    row = F.struct("frame_index", "candidate_index", rank.alias("rank"))
    tracks = eligible.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    # A choice: total, scores and ranks (best first). For each row and size, the choices among the rows up to it.
    ranks = "array<struct<total_score:double,sharpness_score:double,plate_confidence:double,frame_index:int,candidate_index:int>>"
    choice = f"struct<total:double,scores:array<double>,ranks:{ranks}>"
    empty = F.array(F.struct(F.lit(0.0).alias("total"), F.array().cast("array<double>").alias("scores"), F.array().cast(ranks).alias("ranks")).cast(choice))
    nothing = F.array().cast(f"array<{choice}>")
    cell = f"struct<frame:int,best:array<array<{choice}>>>"
    start = F.array(F.struct(F.lit(None).cast("int").alias("frame"), F.array(empty, *[nothing] * c.top_k).alias("best")).cast(cell))

    def best_of(sets: Column) -> Column:
        top = F.array_max(F.transform(sets, lambda x: x["total"]))
        near = F.filter(sets, lambda x: x["total"] >= top - 1e-9 * F.greatest(F.lit(1.0), F.abs(top)))
        alone = F.filter(near, lambda x: ~F.exists(near, lambda y: (y["scores"] == x["scores"]) & _after(y["ranks"], x["ranks"])))
        return F.when(F.size(sets) < 2, sets).when(F.size(near) < 2, near).otherwise(F.array_distinct(alone))

    def add(state: Column, x: Column) -> Column:
        free = F.filter(state, lambda s: s["frame"].isNull() | (s["frame"] <= x["frame_index"] - c.min_gap))
        prior = F.element_at(free, -1)["best"]
        skip = F.element_at(state, -1)["best"]

        def grown(p: Column) -> Column:
            made = F.reverse(F.array_sort(F.concat(p["ranks"], F.array(x["rank"].cast(ranks[6:-1])))))
            total = F.aggregate(made, F.lit(0.0), lambda t, r: t + r["total_score"])
            return F.struct(total.alias("total"), F.transform(made, lambda r: r["total_score"]).alias("scores"), made.alias("ranks")).cast(choice)

        best = F.concat(F.array(empty), F.transform(F.sequence(F.lit(1), F.lit(c.top_k)), lambda k: best_of(F.concat(F.get(skip, k), F.transform(F.get(prior, k - 1), grown)))))
        return F.concat(state, F.array(F.struct(x["frame_index"].alias("frame"), best.alias("best")).cast(cell)))

    def better(a: Column, b: Column) -> Column:
        bigger = (b["total"] > a["total"]) | ((b["total"] == a["total"]) & _after(b["ranks"], a["ranks"]))
        return F.when(a.isNull() | bigger, b).otherwise(a)

    final = F.flatten(F.element_at(F.aggregate("_rows", start, add), -1)["best"])
    tracks = tracks.withColumn("_best", F.aggregate(final, F.lit(None).cast(choice), better)["ranks"])
    chosen = tracks.select(*keys, F.posexplode("_best").alias("_pos", "_rank")).select(*keys, (F.col("_pos") + 1).alias("rank"), "_rank.frame_index", "_rank.candidate_index")
    return eligible.join(chosen, [*keys, "frame_index", "candidate_index"])


def _after(a: Column, b: Column) -> Column:
    """Whether array ``a`` sorts after ``b``; a prefix sorts first."""
    n = F.least(F.size(a), F.size(b))
    at = F.filter(F.sequence(F.lit(0), n), lambda i: (i == n) | (F.get(a, i) != F.get(b, i)))[0]
    return F.when(at < n, F.get(a, at) > F.get(b, at)).otherwise(F.size(a) > F.size(b))


def late(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """SS5: rows with `late`: their frame lies before one that came earlier (in ``order``) for the track; such rows are no evidence."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("late", F.coalesce(F.col("frame_index") < F.max("frame_index").over(before), F.lit(False)))


def counts(df: DataFrame, keys: list[str], c: Buffer = Buffer()) -> DataFrame:
    """SU9, AG27: per track all crops and the eligible ones."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_all"), F.count_if(rejection(c).isNull()).alias("n_eligible"))
