"""Differential analysis between groups of slides, and gene-set tables (OP-T24..T26, A15, A16, J16, J17, W07)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spatialcc.functions.scalars import log_factorial, log_ratio


def slide_means(results: DataFrame, pairs: DataFrame, slides: DataFrame) -> DataFrame:
    """(cond, feat_1, feat_2, mean): mean over all slides of a condition, slides without a result counting 0 (OP-J16, A15)."""
    every = pairs.select("feat_1", "feat_2").distinct().crossJoin(slides.select("grp", "cond").distinct())
    full = every.join(results.select("grp", "feat_1", "feat_2", "j_comp"), ["grp", "feat_1", "feat_2"], "left")
    return full.groupBy("cond", "feat_1", "feat_2").agg(F.avg(F.coalesce("j_comp", F.lit(0.0))).alias("mean"))


def differential(means: DataFrame, comp: str, ref: str, min_logfc: float = 0.0, min_mean: float = 0.0) -> DataFrame:
    """(feat_1, feat_2, mean_comp, mean_ref, logfc) above both limits (OP-T24). A zero reference gives infinity."""
    pick = lambda c: F.max(F.when(F.col("cond") == c, F.col("mean")))
    both = means.filter(F.col("cond").isin(comp, ref)).groupBy("feat_1", "feat_2").agg(pick(comp).alias("mean_comp"), pick(ref).alias("mean_ref"))
    return both.withColumn("logfc", log_ratio(F.col("mean_comp"), F.col("mean_ref"))).filter((F.col("logfc") > min_logfc) & (F.col("mean_comp") > min_mean))


def top_by(rows: DataFrame, by: str, top_n: int, *ties: str) -> DataFrame:
    """The first top_n rows by a column, descending (OP-W07, W06)."""
    return rows.orderBy(F.desc(by), *ties).limit(top_n)


def pivot_by_group(results: DataFrame, groups: list[str]) -> DataFrame:
    """One column of j_comp per group, 0 where there is none (OP-A16, V07)."""
    return results.groupBy("feat_1", "feat_2").pivot("grp", groups).agg(F.first("j_comp")).fillna(0.0, groups)


def term_pairs(terms: DataFrame, pairs: DataFrame) -> DataFrame:
    """(term, feat_1, feat_2) where either member is among a term's '/'-joined genes (OP-J17): two equi-joins, united."""
    genes = terms.select("term", F.explode(F.split("genes", "/")).alias("gene")).distinct()
    first = pairs.join(genes, pairs["feat_1"] == genes["gene"]).select("term", "feat_1", "feat_2")
    second = pairs.join(genes, pairs["feat_2"] == genes["gene"]).select("term", "feat_1", "feat_2")
    return first.union(second).distinct()


def term_heat(terms: DataFrame, diff: DataFrame, heatmap_max: float, names: list[str]) -> DataFrame:
    """One column per term with the capped logfc of each pair, 0 where the term lacks it (OP-T26)."""
    rows = term_pairs(terms, diff.select("feat_1", "feat_2")).join(diff.select("feat_1", "feat_2", "logfc"), ["feat_1", "feat_2"])
    capped = rows.withColumn("heat", F.least(F.col("logfc"), F.lit(float(heatmap_max))))
    return capped.groupBy("feat_1", "feat_2").pivot("term", names).agg(F.first("heat")).fillna(0.0, names)


def over_representation(gene_sets: DataFrame, hits: DataFrame, universe: DataFrame) -> DataFrame:
    """Hypergeometric over-representation of gene sets (OP-T25): term, k, m, drawn, universe, p_value, p_adjust.

    gene_sets: term, gene; hits and universe: gene. k of the drawn hits are among the m genes of a term, out of the universe.
    The upper tail is summed from logarithms of factorials; p-values are adjusted by Benjamini and Hochberg.
    """
    inside = gene_sets.join(universe.select("gene").distinct(), "gene", "left_semi").distinct()
    total = universe.select("gene").distinct().agg(F.count(F.lit(1)).alias("universe"))
    drawn = hits.select("gene").distinct().join(universe.select("gene").distinct(), "gene", "left_semi")
    n = drawn.agg(F.count(F.lit(1)).alias("drawn"))
    m = inside.groupBy("term").agg(F.count(F.lit(1)).alias("m"))
    k = inside.join(drawn, "gene", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("k"))
    counts = m.join(k, "term").crossJoin(F.broadcast(n)).crossJoin(F.broadcast(total))  # a row each
    choose = lambda a, b: log_factorial(a) - log_factorial(b) - log_factorial(a - b)
    big, hit, size = F.col("universe"), F.col("drawn"), F.col("m")
    valid = lambda i: (size - i >= 0) & (hit - i >= 0) & (big - size - hit + i >= 0)
    term = lambda i: F.when(valid(i), F.exp(choose(size, i) + choose(big - size, hit - i) - F.col("_all"))).otherwise(0.0)
    tail = F.aggregate(F.sequence(F.col("k"), F.least(hit, size)), F.lit(0.0), lambda a, i: a + term(i))
    tested = counts.withColumn("_all", choose(big, hit)).withColumn("p_value", F.least(F.lit(1.0), tail)).drop("_all")
    order = W.orderBy("p_value", "term")  # as many rows as there are terms
    ranked = tested.withColumn("r", F.row_number().over(order)).withColumn("t", F.count(F.lit(1)).over(W.partitionBy()))
    adjusted = F.min(F.least(F.lit(1.0), F.col("p_value") * F.col("t") / F.col("r"))).over(order.rowsBetween(0, W.unboundedFollowing))
    return ranked.withColumn("p_adjust", adjusted).select("term", "k", "m", "drawn", "universe", "p_value", "p_adjust")
