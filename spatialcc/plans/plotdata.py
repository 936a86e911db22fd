"""Plot-ready tables (OP-V01..V05): what figures are drawn from, not the figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spatialcc.functions.scalars import overlap_category
from spatialcc.operators import jaccard


def feature_map(spots: DataFrame, values: DataFrame, feature: str, vmin: float | None = None, vmax: float | None = None) -> DataFrame:
    """Every spot with a feature's value, absent as zero, cut at vmin and vmax (OP-V03)."""
    own = values.filter(F.col("feature") == feature).select("grp", "spot_id", "value")
    v = F.coalesce("value", F.lit(0.0))
    if vmin is not None:
        v = F.greatest(F.lit(float(vmin)), v)
    if vmax is not None:
        v = F.least(F.lit(float(vmax)), v)
    return spots.join(own, ["grp", "spot_id"], "left").select("grp", "spot_id", "array_col", "array_row", v.alias("value"))


def factor_map(spots: DataFrame, categories: DataFrame) -> DataFrame:
    """Every spot with the number of its category in order (OP-V03, survey 2.11 encoding)."""
    codes = categories.select("category").distinct().withColumn("code", (F.row_number().over(W.orderBy("category")) - 1).cast("int"))
    return spots.join(categories, ["grp", "spot_id"], "left").join(codes, "category", "left")


def all_components_map(spots: DataFrame, labels: DataFrame, feat_1: str, feat_2: str, background: bool = True) -> DataFrame:
    """Every spot with 0 none, 1 first, 2 second, 3 both features' components (OP-V02, V05); background can be left out."""
    side = lambda f, name: labels.filter(F.col("feature") == f).select("grp", "spot_id", F.col("cc_label").alias(name))
    both = spots.join(side(feat_1, "x"), ["grp", "spot_id"], "left").join(side(feat_2, "y"), ["grp", "spot_id"], "left")
    out = both.select("grp", "spot_id", "array_col", "array_row", overlap_category(F.col("x"), F.col("y")).alias("category"))
    return out if background else out.filter("category > 0")


def top_regions_map(spots: DataFrame, labels: DataFrame, pairs: DataFrame, top_n: int, background: bool = True) -> DataFrame:
    """Spots by category for each of the top regions of each pair, with the local similarity (OP-V01, V04)."""
    top = jaccard.top_regions(jaccard.local_jaccard(pairs, labels), top_n)
    found = jaccard.region_categories(top, labels)
    if not background:
        return found.join(spots, ["grp", "spot_id"])
    heads = top.select("grp", "feat_1", "feat_2", "rank", "j_local")
    every = spots.join(heads, "grp")  # a map for each region: spots times regions of their slide
    return every.join(found.drop("j_local"), ["grp", "feat_1", "feat_2", "rank", "spot_id"], "left").withColumn("category", F.coalesce("category", F.lit(0)))


def crop_box(region: DataFrame, border: float) -> DataFrame:
    """Extent of the drawn spots widened by a border (OP-V01)."""
    b = F.lit(float(border))
    return region.groupBy("grp").agg((F.min("array_col") - b).alias("col_from"), (F.max("array_col") + b).alias("col_to"), (F.min("array_row") - b).alias("row_from"), (F.max("array_row") + b).alias("row_to"))
