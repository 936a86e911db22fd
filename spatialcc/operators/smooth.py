"""Total-preserving Gaussian smoothing (OP-T04, T05, A09)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spatialcc.functions.scalars import PLATEAU_DECIMALS
from spatialcc.operators.adjacency import distance_join, gaussian_weight


def kernel_1d(fwhm: float) -> list[float]:
    """Normalised weights for offsets -r..r, cut at 2.355 standard deviations."""
    sigma = fwhm / 2.355
    radius = int(2.355 * sigma + 0.5)
    raw = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-radius, radius + 1)]
    return [w / sum(raw) for w in raw]


def smooth_grid(expr: DataFrame, spots: DataFrame, fwhm: float = 2.5) -> DataFrame:
    """Smoothed values of every spot of every (grp, feature) on a square grid, zero outside (OP-T05).

    expr: grp, feature, array_col, array_row, value (zeros may be left out). spots: grp, spot_id, array_col,
    array_row. The kernel is separable, so values are scattered along rank-compressed columns, summed, scattered along
    rows and summed again. Sums are dealt by place, so a slide of any size is spread over all tasks. Totals are preserved
    over the whole dense grid, then real spots are kept.
    """
    weights = kernel_1d(fwhm)
    r = len(weights) // 2
    offsets = F.array(*[F.struct(F.lit(i - r).alias("o"), F.lit(w).alias("w")) for i, w in enumerate(weights)])
    cols = spots.select("grp", "array_col").distinct().withColumn("c", (F.row_number().over(W.partitionBy("grp").orderBy("array_col")) - 1).cast("int"))
    rows = spots.select("grp", "array_row").distinct().withColumn("r", (F.row_number().over(W.partitionBy("grp").orderBy("array_row")) - 1).cast("int"))
    size = cols.groupBy("grp").agg(F.max("c").alias("nc")).join(rows.groupBy("grp").agg(F.max("r").alias("nr")), "grp")
    ranked = expr.filter("value <> 0").join(cols, ["grp", "array_col"]).join(rows, ["grp", "array_row"]).join(size, "grp")
    over_cols = (
        ranked.withColumn("k", F.explode(offsets))
        .select("grp", "feature", (F.col("c") + F.col("k.o")).alias("c"), "r", "nc", "nr", (F.col("value") * F.col("k.w")).alias("s"))
        .filter("c between 0 and nc")
        .groupBy("grp", "feature", "c", "r")
        .agg(F.sum("s").alias("s"), F.first("nr").alias("nr"))
    )
    over_rows = (
        over_cols.withColumn("k", F.explode(offsets))
        .select("grp", "feature", "c", (F.col("r") + F.col("k.o")).alias("r"), "nr", (F.col("s") * F.col("k.w")).alias("s"))
        .filter("r between 0 and nr")
        .groupBy("grp", "feature", "c", "r")
        .agg(F.sum("s").alias("s"))
    )
    total = expr.groupBy("grp", "feature").agg(F.sum("value").alias("total"))
    scale = over_rows.groupBy("grp", "feature").agg(F.sum("s").alias("whole")).join(total, ["grp", "feature"])
    scaled = over_rows.join(scale, ["grp", "feature"]).withColumn("smoothed", F.round(F.col("s") / F.col("whole") * F.col("total"), PLATEAU_DECIMALS))
    places = spots.join(cols, ["grp", "array_col"]).join(rows, ["grp", "array_row"]).select("grp", "spot_id", "array_col", "array_row", "c", "r")
    return scaled.join(places, ["grp", "c", "r"]).select("grp", "feature", "spot_id", "array_col", "array_row", "smoothed")


def smooth_points(expr: DataFrame, spots: DataFrame, fwhm: float = 2.5) -> DataFrame:
    """Smoothed values of every spot within fwhm of a value, for spots at x, y (OP-T04).

    expr: grp, feature, spot_id, value. spots: grp, spot_id, x, y. Totals over a group's spots are preserved.
    """
    return smooth_over(expr, neighbour_weights(spots, fwhm))


def neighbour_weights(spots: DataFrame, fwhm: float = 2.5) -> DataFrame:
    """(grp, spot_id, dst, w): weights of the spots within fwhm of each spot at x, y."""
    return distance_join(spots, fwhm).withColumn("w", gaussian_weight(fwhm, F.col("d"))).select("grp", F.col("src").alias("spot_id"), "dst", "w")


def smooth_over(expr: DataFrame, near: DataFrame, slide: str = "grp") -> DataFrame:
    """Values spread by weights of neighbours; `slide` is the column of expr that near calls grp, totals are kept by grp."""
    # A merge join for the same reason as in distance_join: values of many spots can lie in a small file.
    spread = expr.filter("value <> 0").join(near.withColumnRenamed("grp", slide).hint("merge"), [slide, "spot_id"])
    summed = spread.groupBy("grp", "feature", "dst").agg(F.sum(F.col("w") * F.col("value")).alias("s"))
    totals = expr.groupBy("grp", "feature").agg(F.sum("value").alias("total"))
    whole = summed.groupBy("grp", "feature").agg(F.sum("s").alias("whole"))
    scale = totals.join(whole, ["grp", "feature"])
    return summed.join(scale, ["grp", "feature"]).select(
        "grp", "feature", F.col("dst").alias("spot_id"), F.round(F.col("s") / F.col("whole") * F.col("total"), PLATEAU_DECIMALS).alias("smoothed")
    )
