"""Feature pairs: resolution, averages, pruning, and ligand-receptor clean-up (OP-P06..P08, P15..P19, A08, J05, J14, U01..U04, W08)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spatialcc.functions.scalars import log_mean_exp


def all_pairs(features: DataFrame, square: bool = False) -> DataFrame:
    """Pairs of distinct features, each once, or the whole square (OP-J14). The result is the cross itself."""
    f = features.select("feature").distinct()
    pairs = f.select(F.col("feature").alias("feat_1")).crossJoin(f.select(F.col("feature").alias("feat_2")))
    return pairs if square else pairs.filter("feat_1 < feat_2")


def resolve_pairs(pairs: DataFrame, obs_names: DataFrame, var_names: DataFrame) -> DataFrame:
    """Pairs whose members are both in the slot that wins on their side, with slot_1 and slot_2 (OP-P06).

    A side is 'obs' if more of its names are metadata columns than genes, else 'var'. Raises if a side has neither.
    """
    obs = obs_names.select("name").distinct()
    var = var_names.select("name").distinct()
    slots: dict[str, str] = {}
    for side in ("feat_1", "feat_2"):
        names = pairs.select(F.col(side).alias("name"))
        in_obs = names.join(obs, "name", "left_semi").count()
        in_var = names.join(var, "name", "left_semi").count()
        if not in_obs and not in_var:
            raise ValueError(f"no name of '{side}' is found among genes or metadata")
        slots[side] = "obs" if in_obs > in_var else "var"
    for side, slot in slots.items():
        names = (obs if slot == "obs" else var).withColumnRenamed("name", side)
        pairs = pairs.join(names, side, "left_semi")
    return pairs.withColumn("slot_1", F.lit(slots["feat_1"])).withColumn("slot_2", F.lit(slots["feat_2"]))


def check_groups(spots: DataFrame, wanted: list[str]) -> DataFrame:
    """Spots of the wanted groups; an error if one doesn't exist (OP-P07, U03)."""
    there = {r["grp"] for r in spots.select("grp").distinct().filter(F.col("grp").isin(wanted)).collect()}
    if missing := sorted(set(wanted) - there):
        raise ValueError(f"no such group: {missing}")
    return spots.filter(F.col("grp").isin(wanted))


def feature_average(expr: DataFrame, spots: DataFrame, source: str = "var") -> DataFrame:
    """(grp, feature, avg) over all spots of a group, absent values as zero (OP-A08).

    Genes: log1p of the mean of expm1; metadata: the mean.
    """
    n = spots.groupBy("grp").agg(F.count(F.lit(1)).alias("n_spots"))
    if source == "var":
        summed = expr.groupBy("grp", "feature").agg(F.sum(F.expm1("value")).alias("s"))
        return summed.join(n, "grp").select("grp", "feature", log_mean_exp(F.col("s"), F.col("n_spots")).alias("avg"))
    summed = expr.groupBy("grp", "feature").agg(F.sum("value").alias("s"))
    return summed.join(n, "grp").select("grp", "feature", (F.col("s") / F.col("n_spots")).alias("avg"))


def pairs_with_averages(pairs: DataFrame, averages: DataFrame, spots: DataFrame, on_empty: str = "raise") -> DataFrame:
    """(grp, feat_1, feat_2, avg_1, avg_2) without pairs that have a member of average zero (OP-P08).

    Raises if some group has no pair left, unless on_empty is 'keep'.
    """
    a = averages.filter("avg <> 0")
    kept = pairs.join(a.select("grp", F.col("feature").alias("feat_1"), F.col("avg").alias("avg_1")), "feat_1").join(
        a.select("grp", F.col("feature").alias("feat_2"), F.col("avg").alias("avg_2")), ["grp", "feat_2"]
    )
    kept = kept.select("grp", "feat_1", "feat_2", "avg_1", "avg_2")
    if on_empty == "raise" and not spots.select("grp").distinct().join(kept, "grp", "left_anti").isEmpty():
        raise ValueError("a group has no feature pair with averages other than zero")
    return kept


def features_in_order(pairs: DataFrame, order: str = "pair_ord") -> DataFrame:
    """Distinct features of both sides by where they are first seen, first sides before second ones (OP-W08, U04)."""
    x = pairs.select(F.col("feat_1").alias("feature"), F.lit(0).alias("side"), F.col(order).alias("ord"))
    y = pairs.select(F.col("feat_2").alias("feature"), F.lit(1).alias("side"), F.col(order).alias("ord"))
    first = x.unionByName(y).groupBy("feature").agg(F.min(F.struct("side", "ord")).alias("first"))
    return first.withColumn("pos", F.row_number().over(W.orderBy("first")) - 1).select("feature", "pos")  # a list of names


def lr_celltalk(db: DataFrame) -> DataFrame:
    """Ligands and receptors of a table that names them plainly (OP-P17)."""
    return db.select(F.col("ligand_gene_symbol").alias("feat_1"), F.col("receptor_gene_symbol").alias("feat_2"))


def lr_omnipath(db: DataFrame, dedupe: bool = True) -> DataFrame:
    """Complexes joined by '_' taken apart on both sides; repeated pairs once (OP-P18)."""
    pairs = db.select(F.explode(F.split("source_genesymbol", "_")).alias("feat_1"), "target_genesymbol").select("feat_1", F.explode(F.split("target_genesymbol", "_")).alias("feat_2"))
    return pairs.distinct() if dedupe else pairs


def lr_cellchat(db: DataFrame) -> DataFrame:
    """'L - R' and 'L - (R1+R2)' as pairs; the second receptor makes a second pair (OP-P19)."""
    parts = F.split(F.regexp_replace("interaction_name_2", " ", ""), "-")
    named = db.select(parts[0].alias("feat_1"), parts[1].alias("receptor"))
    inner = F.regexp_replace("receptor", r"[()]", "")
    return named.select("feat_1", F.explode(F.slice(F.split(inner, r"\+"), 1, 2)).alias("feat_2"))


def common_groups(a: DataFrame, b: DataFrame) -> DataFrame:
    """Groups that both tables have (OP-U02)."""
    return a.select("grp").intersect(b.select("grp"))
