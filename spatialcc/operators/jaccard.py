"""Overlap of components: composite and local Jaccard, set or weighted, and top regions (OP-A11, A12, J13, T17, T18, W02)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _sides(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Spots of either side of each pair: (grp, feat_1, feat_2, spot_id, x, y) with the labels, null where absent.

    Each side is an equi-join on the feature; spots of a pair meet by aggregation, so no spot list is joined twice.
    """
    x = pairs.join(labels.withColumnRenamed("feature", "feat_1"), "feat_1").select("grp", "feat_1", "feat_2", "spot_id", F.col("cc_label").alias("x"), F.lit(None).cast("int").alias("y"))
    y = pairs.join(labels.withColumnRenamed("feature", "feat_2"), "feat_2").select("grp", "feat_1", "feat_2", "spot_id", F.lit(None).cast("int").alias("x"), F.col("cc_label").alias("y"))
    return x.unionByName(y).groupBy("grp", "feat_1", "feat_2", "spot_id").agg(F.max("x").alias("x"), F.max("y").alias("y"))


def _every(pairs: DataFrame, spots: DataFrame, found: DataFrame, value: str) -> DataFrame:
    """All pairs of all groups, 0 where neither side has a component."""
    groups = spots.select("grp").distinct()
    every = pairs.select("feat_1", "feat_2").distinct().crossJoin(groups)  # the result itself: pairs times slides
    return every.join(found, ["grp", "feat_1", "feat_2"], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def jaccard_composite(pairs: DataFrame, labels: DataFrame, spots: DataFrame) -> DataFrame:
    """(grp, feat_1, feat_2, j_comp): shared over joint footprint of all components; 0 if both are empty (OP-A11)."""
    both = F.sum(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1).otherwise(0))
    found = _sides(pairs, labels).groupBy("grp", "feat_1", "feat_2").agg((both / F.count(F.lit(1))).alias("j_comp"))
    return _every(pairs, spots, found, "j_comp").select("grp", "feat_1", "feat_2", "j_comp")


def unit_span(values: DataFrame, spots: DataFrame) -> DataFrame:
    """(grp, feature, lo, width): the least value over all spots of the group and the span; spots without a value are zero, a constant feature has no width."""
    n = spots.groupBy("grp").agg(F.count(F.lit(1)).alias("n_spots"))
    span = values.groupBy("grp", "feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("n")).join(n, "grp")
    lo = F.when(F.col("n") < F.col("n_spots"), F.least("lo", F.lit(0.0))).otherwise(F.col("lo"))
    hi = F.when(F.col("n") < F.col("n_spots"), F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi"))
    return span.select("grp", "feature", lo.alias("lo"), F.when(hi > lo, hi - lo).alias("width"))


def _weights(pairs: DataFrame, labels: DataFrame, values: DataFrame, spots: DataFrame) -> DataFrame:
    """Labelled spots with their value scaled to 0..1 over all spots of the group, null for a constant feature."""
    held = labels.join(values, ["grp", "feature", "spot_id"], "left").join(unit_span(values, spots), ["grp", "feature"], "left")
    return held.withColumn("unit", (F.coalesce("value", F.lit(0.0)) - F.col("lo")) / F.col("width")).drop("value", "lo", "width")


def jaccard_weighted(pairs: DataFrame, labels: DataFrame, values: DataFrame, spots: DataFrame) -> DataFrame:
    """(grp, feat_1, feat_2, j_comp) with sums of the smaller over sums of the larger scaled value (OP-A12).

    A feature that is constant over a group has no scale: its pairs are null where it has a component.
    """
    held = _weights(pairs, labels, values, spots)
    side = lambda name, own, other: pairs.join(held.withColumnRenamed("feature", name), name).select(
        "grp", "feat_1", "feat_2", "spot_id", F.col("unit").alias(own), F.lit(None).cast("double").alias(other), F.col("unit").isNull().alias("flat")
    )
    met = side("feat_1", "x", "y").unionByName(side("feat_2", "y", "x")).groupBy("grp", "feat_1", "feat_2", "spot_id").agg(F.max("x").alias("x"), F.max("y").alias("y"), F.max("flat").alias("flat"))
    zero = F.lit(0.0)
    x, y = F.coalesce("x", zero), F.coalesce("y", zero)
    top = F.sum(F.greatest(x, y))
    found = met.groupBy("grp", "feat_1", "feat_2").agg(F.when(~F.max("flat"), F.when(top > 0, F.sum(F.least(x, y)) / top)).alias("j_comp"), F.lit(True).alias("seen"))
    groups = spots.select("grp").distinct()
    every = pairs.select("feat_1", "feat_2").distinct().crossJoin(groups)
    return every.join(found, ["grp", "feat_1", "feat_2"], "left").select("grp", "feat_1", "feat_2", F.when(F.col("seen"), F.col("j_comp")).otherwise(zero).alias("j_comp"))


def local_jaccard(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(grp, feat_1, feat_2, ccx, ccy, j_local) for every component of one side with every one of the other (OP-T17, J13).

    Shared spots are counted by an equi-join on the spot; pairs without any come from the labels alone.
    """
    sizes = labels.groupBy("grp", "feature", "cc_label").agg(F.count(F.lit(1)).alias("n"))
    x = labels.select("grp", F.col("feature").alias("feat_1"), "spot_id", F.col("cc_label").alias("ccx"))
    y = labels.select("grp", F.col("feature").alias("feat_2"), "spot_id", F.col("cc_label").alias("ccy"))
    shared = pairs.join(x, "feat_1").join(y, ["grp", "feat_2", "spot_id"]).groupBy("grp", "feat_1", "feat_2", "ccx", "ccy").agg(F.count(F.lit(1)).alias("i"))
    sx = sizes.select("grp", F.col("feature").alias("feat_1"), F.col("cc_label").alias("ccx"), F.col("n").alias("nx"))
    sy = sizes.select("grp", F.col("feature").alias("feat_2"), F.col("cc_label").alias("ccy"), F.col("n").alias("ny"))
    every = pairs.join(sx, "feat_1").join(sy, ["grp", "feat_2"])
    i = F.coalesce("i", F.lit(0))
    return every.join(shared, ["grp", "feat_1", "feat_2", "ccx", "ccy"], "left").select("grp", "feat_1", "feat_2", "ccx", "ccy", (i / (F.col("nx") + F.col("ny") - i)).alias("j_local"))


def local_jaccard_weighted(pairs: DataFrame, labels: DataFrame, values: DataFrame, spots: DataFrame) -> DataFrame:
    """As local_jaccard(), with sums of the smaller over sums of the larger scaled value."""
    held = _weights(pairs, labels, values, spots)
    sums = held.groupBy("grp", "feature", "cc_label").agg(F.sum("unit").alias("s"))
    x = held.select("grp", F.col("feature").alias("feat_1"), "spot_id", F.col("cc_label").alias("ccx"), F.col("unit").alias("ux"))
    y = held.select("grp", F.col("feature").alias("feat_2"), "spot_id", F.col("cc_label").alias("ccy"), F.col("unit").alias("uy"))
    low = pairs.join(x, "feat_1").join(y, ["grp", "feat_2", "spot_id"]).groupBy("grp", "feat_1", "feat_2", "ccx", "ccy").agg(F.sum(F.least("ux", "uy")).alias("low"))
    sx = sums.select("grp", F.col("feature").alias("feat_1"), F.col("cc_label").alias("ccx"), F.col("s").alias("sx"))
    sy = sums.select("grp", F.col("feature").alias("feat_2"), F.col("cc_label").alias("ccy"), F.col("s").alias("sy"))
    every = pairs.join(sx, "feat_1").join(sy, ["grp", "feat_2"])
    low_or_0 = F.coalesce("low", F.lit(0.0))  # max(a, b) = a + b - min(a, b), and outside the shared spots one of them is 0
    top = F.col("sx") + F.col("sy") - low_or_0
    return every.join(low, ["grp", "feat_1", "feat_2", "ccx", "ccy"], "left").select("grp", "feat_1", "feat_2", "ccx", "ccy", F.when(top > 0, low_or_0 / top).alias("j_local"))


def top_regions(local: DataFrame, top_n: int) -> DataFrame:
    """The top_n component pairs of each feature pair by local Jaccard, ties by label (OP-W02), with their rank."""
    order = W.partitionBy("grp", "feat_1", "feat_2").orderBy(F.desc("j_local"), "ccx", "ccy")
    return local.filter("j_local > 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_n)


def top_n_regions(local: DataFrame, top_n: int) -> DataFrame:
    """As top_regions(); an error if some feature pair has fewer than top_n overlapping component pairs (OP-T18)."""
    short = local.groupBy("grp", "feat_1", "feat_2").agg(F.count_if(F.col("j_local") > 0).alias("n")).filter(F.col("n") < top_n)
    if not short.isEmpty():
        raise ValueError("'top_n' is larger than the number of overlapping component pairs")
    return top_regions(local, top_n)


def region_categories(top: DataFrame, labels: DataFrame) -> DataFrame:
    """(grp, feat_1, feat_2, rank, spot_id, category) with 1 first only, 2 second only, 3 both (OP-W03)."""
    key = ["grp", "feat_1", "feat_2", "rank", "j_local"]
    x = top.join(labels.select("grp", F.col("feature").alias("feat_1"), F.col("cc_label").alias("ccx"), "spot_id"), ["grp", "feat_1", "ccx"]).select(*key, "spot_id", F.lit(1).alias("side"))
    y = top.join(labels.select("grp", F.col("feature").alias("feat_2"), F.col("cc_label").alias("ccy"), "spot_id"), ["grp", "feat_2", "ccy"]).select(*key, "spot_id", F.lit(2).alias("side"))
    return x.unionByName(y).groupBy(*key, "spot_id").agg(F.sum("side").cast("int").alias("category"))
