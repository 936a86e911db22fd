"""Quality control and normalisation on long expression tables (OP-P01..P05, P11, A14, M01, M02)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def drop_controls(expr: DataFrame, marks: tuple[str, ...] = ("NegPrb", "Blank-"), target: str = "target") -> DataFrame:
    """Rows whose target has none of the control marks (OP-P01); pushed into the scan as string predicates."""
    for mark in marks:
        expr = expr.filter(~F.col(target).contains(mark))
    return expr


def drop_unassigned(tx: DataFrame, cell: str = "cell", outside: object = 0, gene_flag: str | None = None) -> DataFrame:
    """Molecules inside a cell, and of genes only where a flag says so (OP-P02)."""
    tx = tx.filter(F.col(cell).isNotNull() & (F.col(cell) != F.lit(outside)))
    return tx.filter(F.col(gene_flag)) if gene_flag else tx


def filter_cells(expr: DataFrame, min_counts: float, cell: str = "cell", n: str = "n") -> DataFrame:
    """Rows of cells whose total is at least min_counts (OP-P03)."""
    keep = expr.groupBy(cell).agg(F.sum(n).alias("_total")).filter(F.col("_total") >= min_counts).select(cell)
    return expr.join(keep, cell, "left_semi")


def filter_genes(expr: DataFrame, min_cells: int, cell: str = "cell", target: str = "target", n: str = "n") -> DataFrame:
    """Rows of targets that are expressed in at least min_cells cells (OP-P04)."""
    seen = expr.filter(F.col(n) > 0).select(target, cell).distinct().groupBy(target).agg(F.count(F.lit(1)).alias("_cells"))
    return expr.join(seen.filter(F.col("_cells") >= min_cells).select(target), target, "left_semi")


def quality_control(expr: DataFrame, min_counts: float, min_cells: int, genes_first: bool = False) -> DataFrame:
    """Both filters; cells first for transcript platforms, genes first for binned ones."""
    if genes_first:
        return filter_cells(filter_genes(expr, min_cells), min_counts)
    return filter_genes(filter_cells(expr, min_counts), min_cells)


def filter_bins(bins: DataFrame, bin_counts: float, n: str = "bin_count") -> DataFrame:
    """Bins with more than bin_counts, counts rounded half to even (OP-P05)."""
    return bins.filter(F.col(n) > bin_counts).withColumn(n, F.bround(n, 0))


def normalize_total(expr: DataFrame, target_sum: float, cell: str = "cell", n: str = "n") -> DataFrame:
    """value = n * target_sum / total of the cell (OP-A14)."""
    total = F.sum(n).over(W.partitionBy(cell))
    return expr.withColumn("value", F.when(total > 0, F.col(n) * F.lit(float(target_sum)) / total).otherwise(0.0))


def normalize_log1p(expr: DataFrame, target_sum: float, cell: str = "cell", n: str = "n") -> DataFrame:
    """log1p of normalised counts (OP-M01)."""
    return normalize_total(expr, target_sum, cell, n).withColumn("value", F.log1p("value"))


def scale_clip(expr: DataFrame, n_cells: int | None = None, cap: float = 10.0, feature: str = "target", value: str = "value") -> DataFrame:
    """(value - mean) / sd per feature, cut at cap (OP-M02); n_cells counts cells without a row as zeros."""
    stats = expr.groupBy(feature).agg(F.sum(value).alias("_s"), F.sum(F.col(value) * F.col(value)).alias("_q"), F.count(F.lit(1)).alias("_c"))
    n = F.lit(n_cells) if n_cells else F.col("_c")
    mean = F.col("_s") / n
    sd = F.sqrt((F.col("_q") - n * mean * mean) / (n - 1))
    stats = stats.select(feature, mean.alias("_mean"), sd.alias("_sd"))
    scaled = (F.col(value) - F.col("_mean")) / F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0)
    return expr.join(stats, feature).withColumn("scaled", F.least(F.lit(cap), scaled)).drop("_mean", "_sd")


#: A name that ends in a number that could have been given: what stands before it, and the number.
_NUMBERED = r"(?s)^(.*)-([1-9][0-9]{0,17})\z"


def make_unique(names: DataFrame, name: str, order: str) -> DataFrame:
    """Repeated names get -1, -2, ... in order, numbers that make a name which is there already left out (OP-P11).

    The k-th number that isn't taken is k and as many more as there are taken numbers with fewer than k free ones below
    them. These are counted in one pass over a name's rows and taken numbers together. Null names stay null.
    """
    taken = names.filter(F.col(name).rlike(_NUMBERED)).select(F.regexp_extract(name, _NUMBERED, 1).alias(name), F.regexp_extract(name, _NUMBERED, 2).cast("bigint").alias("_n")).distinct()
    free = F.col("_n") - F.row_number().over(W.partitionBy(name).orderBy("_n"))
    rows = names.withColumn("_at", (F.row_number().over(W.partitionBy(name).orderBy(order)) - 1).cast("bigint")).withColumn("_taken", F.lit(0))
    # Dealt anew: a union of equally partitioned sides claims their partitioning, which coalescing can break.
    both = rows.unionByName(taken.select(name, free.cast("bigint").alias("_at"), F.lit(1).alias("_taken")), allowMissingColumns=True).repartition(name)
    passed = F.sum("_taken").over(W.partitionBy(name).orderBy("_at", "_taken").rowsBetween(W.unboundedPreceding, W.currentRow))
    made = F.concat(F.col(name), F.lit("-"), (F.col("_at") + F.col("_passed")).cast("string"))
    counted = both.withColumn("_passed", passed).filter("_taken = 0")
    return counted.withColumn("unique_name", F.when(F.col("_at") == 0, F.col(name)).otherwise(made)).select(*names.columns, "unique_name")
