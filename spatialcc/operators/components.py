"""Connected components of every feature of every group (OP-T08..T15, A10, W01, K02).

The only custom kernel of the engine: one grouped-map task per (grp, feature) builds and prunes the merge tree. What
comes after it is relational.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spatialcc.operators import tree


def _neighbours(rows: pd.DataFrame, lattice: str, fwhm: float) -> Sequence[list[int]] | tree.Neighbours:
    if lattice == "grid":
        return tree.four_neighbours(rows["array_col"], rows["array_row"])
    return tree.nearest_of_spots(rows["array_col"] * 0.5, rows["array_row"] * 3**0.5 / 2, fwhm)


def _sorted(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values(["array_col", "array_row", "spot_id"], kind="stable").reset_index(drop=True)


def connected_components(smoothed: DataFrame, min_size: int = 20, lattice: str = "grid", fwhm: float = 2.5, strict_min_size: bool = False) -> DataFrame:
    """(grp, feature, spot_id, cc_label) of all spots in a component (OP-T11, T12).

    smoothed: grp, feature, spot_id, array_col, array_row, smoothed. Only positive values enter. lattice: 'grid' for
    the four neighbours, 'hex' for the nearest ones on a unit hexagonal lattice.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = _sorted(rows)
        labels = tree.component_labels(rows["smoothed"].to_numpy(), _neighbours(rows, lattice, fwhm), min_size, strict_min_size)
        out = rows[["grp", "feature", "spot_id"]].assign(cc_label=labels)
        return out[out["cc_label"] > 0]

    kinds = dict(smoothed.dtypes)
    schema = f"grp {kinds['grp']}, feature {kinds['feature']}, spot_id {kinds['spot_id']}, cc_label int"
    return smoothed.filter("smoothed > 0").groupBy("grp", "feature").applyInPandas(run, schema)


def merge_trees(smoothed: DataFrame, min_size: int = 20, lattice: str = "grid", fwhm: float = 2.5) -> DataFrame:
    """(grp, feature, node, birth, death, size, parent, children, alive, leaf) of every merge tree (OP-T08, T09)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = _sorted(rows)
        built = tree.build(rows["smoothed"].to_numpy(), _neighbours(rows, lattice, fwhm))
        pruned = tree.prune(built, min_size)
        leaves = set(pruned.leaves())
        n = len(built.birth)
        return pd.DataFrame(
            {
                "grp": rows["grp"].iloc[0], "feature": rows["feature"].iloc[0], "node": range(n), "birth": built.birth, "death": built.death,
                "size": built.sizes(), "parent": built.parent, "children": built.children, "alive": pruned.alive, "leaf": [k in leaves for k in range(n)],
            }
        )

    kinds = dict(smoothed.dtypes)
    schema = f"grp {kinds['grp']}, feature {kinds['feature']}, node int, birth double, death double, size int, parent int, children array<int>, alive boolean, leaf boolean"
    return smoothed.filter("smoothed > 0").groupBy("grp", "feature").applyInPandas(run, schema)


def dendrogram_bars(smoothed: DataFrame, min_size: int = 20, lattice: str = "grid", fwhm: float = 2.5) -> DataFrame:
    """(grp, feature, node, layer, place, birth, death) to draw pruned trees from (OP-T10)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = _sorted(rows)
        built = tree.build(rows["smoothed"].to_numpy(), _neighbours(rows, lattice, fwhm))
        out = pd.DataFrame(tree.bars(built, tree.prune(built, min_size)), columns=["node", "layer", "place", "birth", "death"])
        return out.assign(grp=rows["grp"].iloc[0], feature=rows["feature"].iloc[0])[["grp", "feature", "node", "layer", "place", "birth", "death"]]

    kinds = dict(smoothed.dtypes)
    schema = f"grp {kinds['grp']}, feature {kinds['feature']}, node int, layer int, place double, birth double, death double"
    return smoothed.filter("smoothed > 0").groupBy("grp", "feature").applyInPandas(run, schema)


def label_means(labels: DataFrame, values: DataFrame, spots: DataFrame) -> DataFrame:
    """(grp, feature, cc_label, mean, n) with the background as label 0 (OP-A10).

    values: grp, feature, spot_id, value; spots without a value count as zero, so the background's mean comes from the
    group's totals and its number of spots.
    """
    n_spots = spots.groupBy("grp").agg(F.count(F.lit(1)).alias("n_spots"))
    inside = labels.join(values.hint("merge"), ["grp", "feature", "spot_id"], "left").groupBy("grp", "feature", "cc_label").agg(F.sum(F.coalesce("value", F.lit(0.0))).alias("s"), F.count(F.lit(1)).alias("n"))
    taken = inside.groupBy("grp", "feature").agg(F.sum("s").alias("s_in"), F.sum("n").alias("n_in"))
    total = values.groupBy("grp", "feature").agg(F.sum("value").alias("s_all"))
    outside = (
        taken.join(total, ["grp", "feature"]).join(n_spots, "grp")
        .filter("n_spots > n_in")
        .select("grp", "feature", F.lit(0).alias("cc_label"), (F.col("s_all") - F.col("s_in")).alias("s"), (F.col("n_spots") - F.col("n_in")).alias("n"))
    )
    # Dealt anew: a union of equally partitioned sides claims their partitioning, which coalescing can break.
    both = inside.unionByName(outside).repartition("grp", "feature")
    return both.select("grp", "feature", "cc_label", (F.col("s") / F.col("n")).alias("mean"), "n")


def filter_components(labels: DataFrame, values: DataFrame, spots: DataFrame, thres_per: float = 30) -> DataFrame:
    """Labels of the components with the highest means; the others, and the background, go (OP-T13, W01).

    Of n labels (background included) int(n * (1 - thres_per / 100)) stay, by mean, ties by label.
    """
    by = W.partitionBy("grp", "feature")
    ranked = label_means(labels, values, spots).withColumn("rank", F.row_number().over(by.orderBy(F.desc("mean"), "cc_label"))).withColumn("n_labels", F.count(F.lit(1)).over(by))
    kept = ranked.filter((F.col("rank") <= F.floor(F.col("n_labels") * F.lit(1 - thres_per / 100))) & (F.col("cc_label") > 0))
    return labels.join(kept.select("grp", "feature", "cc_label"), ["grp", "feature", "cc_label"], "left_semi")


def split_components(labels: DataFrame) -> DataFrame:
    """Labels with their position 1..k among the labels that are left (OP-T15)."""
    return labels.withColumn("cc", F.dense_rank().over(W.partitionBy("grp", "feature").orderBy("cc_label")).cast("int"))


def wide_labels(labels: DataFrame, spots: DataFrame, features: list[str]) -> DataFrame:
    """One column Comb_CC_<feature> per feature for every spot, 0 outside (OP-J08, K02); for export only."""
    wide = labels.groupBy("grp", "spot_id").pivot("feature", features).agg(F.first("cc_label"))
    named = wide.select("grp", "spot_id", *[F.col(f"`{f}`").alias(f"Comb_CC_{f}") for f in features])
    return spots.join(named, ["grp", "spot_id"], "left").fillna(0, [f"Comb_CC_{f}" for f in features])
