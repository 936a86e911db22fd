"""Cell-type-specific analyses (OP-P15, J18, J20, T22, T23)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spatialcc.functions.scalars import feature_name


def side_by_side(first: DataFrame, second: DataFrame, type_1: str, type_2: str, sep: str = ": ") -> DataFrame:
    """Two cell-type-specific matrices as one, features named by type (OP-J20)."""
    named = lambda df, ct: df.withColumn("feature", feature_name(F.lit(ct), F.col("feature"), sep))
    return named(first, type_1).unionByName(named(second, type_2))


def celltype_pairs(pairs: DataFrame, type_1: str, type_2: str, sep: str = ": ") -> DataFrame:
    """Pairs with the first side in one cell type and the second in the other (OP-P15)."""
    return pairs.select(feature_name(F.lit(type_1), F.col("feat_1"), sep).alias("feat_1"), feature_name(F.lit(type_2), F.col("feat_2"), sep).alias("feat_2"))


def constrained_jaccard(pairs: DataFrame, labels: DataFrame, type_1: str, type_2: str) -> DataFrame:
    """Composite Jaccard over only those spots where both cell types have a component (OP-J18, T23).

    labels: grp, feature, spot_id, cc_label of genes and of the cell types. Null where no such spot has either feature.
    """
    spots = lambda ct: labels.filter(F.col("feature") == ct).select("grp", "spot_id").distinct()
    allowed = spots(type_1).join(spots(type_2), ["grp", "spot_id"])
    held = labels.join(allowed, ["grp", "spot_id"], "left_semi")
    x = pairs.join(held.withColumnRenamed("feature", "feat_1"), "feat_1").select("grp", "feat_1", "feat_2", "spot_id", F.lit(1).alias("side"))
    y = pairs.join(held.withColumnRenamed("feature", "feat_2"), "feat_2").select("grp", "feat_1", "feat_2", "spot_id", F.lit(2).alias("side"))
    met = x.unionByName(y).groupBy("grp", "feat_1", "feat_2", "spot_id").agg(F.sum("side").alias("sides"))
    found = met.groupBy("grp", "feat_1", "feat_2").agg((F.count_if(F.col("sides") == 3) / F.count(F.lit(1))).alias("j_comp"))
    every = pairs.select("feat_1", "feat_2").distinct().crossJoin(labels.select("grp").distinct())
    return every.join(found, ["grp", "feat_1", "feat_2"], "left").select("grp", "feat_1", "feat_2", "j_comp")
