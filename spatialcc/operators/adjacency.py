"""Distance joins and adjacency without a cross product (OP-J10..J12, A18)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spatialcc.plans.landing import land

#: Groups (a name and a distance each) up to which the least distances are broadcast; beyond it the join shuffles.
BROADCAST_GROUPS = 100_000


def distance_join(spots: DataFrame, radius: float, keys: tuple[str, ...] = ("grp",), x: str = "x", y: str = "y", decimals: int = 4) -> DataFrame:
    """Pairs src, dst of a group with distance (rounded) within radius, each spot with itself included (OP-J10).

    Space is cut into cells of side radius. A spot meets the nine cells around its own by equi-join, so work follows
    the number of near pairs, not the square of the spots. The join is a merge join: spots in a compressed file look small
    enough to broadcast long after they are not.
    """
    cell = spots.select(*keys, F.col("spot_id"), F.col(x).alias("_x"), F.col(y).alias("_y"), F.floor(F.col(x) / radius).alias("_cx"), F.floor(F.col(y) / radius).alias("_cy"))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    left = cell.withColumn("_o", F.explode(around)).select(
        *keys, F.col("spot_id").alias("src"), F.col("_x").alias("_x1"), F.col("_y").alias("_y1"), (F.col("_cx") + F.col("_o.i")).alias("_cx"), (F.col("_cy") + F.col("_o.j")).alias("_cy")
    )
    right = cell.withColumnRenamed("spot_id", "dst")
    d = F.round(F.sqrt(F.pow(F.col("_x") - F.col("_x1"), 2) + F.pow(F.col("_y") - F.col("_y1"), 2)), decimals)
    return left.join(right.hint("merge"), [*keys, "_cx", "_cy"]).withColumn("d", d).filter(F.col("d") <= radius).select(*keys, "src", "dst", "d")


def min_distance_adjacency(pairs: DataFrame, keys: tuple[str, ...] = ("grp",)) -> DataFrame:
    """Pairs at the smallest distance above zero of their group (OP-J11, A18); groups without such a pair have none.

    Pairs are written once, so that they are not joined again for the least distances, nor dealt by group.
    """
    apart = land(pairs.filter("d > 0"), "apart")
    least = land(apart.groupBy(*keys).agg(F.min("d").alias("_least")), "least")
    least = F.broadcast(least) if least.count() <= BROADCAST_GROUPS else least
    return apart.join(least, list(keys)).filter("d <= _least").drop("_least")


#: The four neighbours on a square grid.
FOUR = ((0, 1), (0, -1), (1, 0), (-1, 0))


def grid_adjacency(spots: DataFrame, keys: tuple[str, ...] = ("grp",)) -> DataFrame:
    """Pairs src, dst of present spots that are next to each other in a row or column (OP-J12)."""
    offsets = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in FOUR]))
    left = spots.select(*keys, F.col("spot_id").alias("src"), "array_col", "array_row", offsets.alias("_o")).select(
        *keys, "src", (F.col("array_col") + F.col("_o.i")).alias("array_col"), (F.col("array_row") + F.col("_o.j")).alias("array_row")
    )
    return left.join(spots.select(*keys, F.col("spot_id").alias("dst"), "array_col", "array_row"), [*keys, "array_col", "array_row"]).select(*keys, "src", "dst")


def gaussian_weight(fwhm: float, d):
    """Unnormalised Gaussian weight of a distance column."""
    sigma = fwhm / 2.355
    return F.exp(-(d * d) / (2 * sigma * sigma)) / (2 * math.pi * sigma * sigma)
