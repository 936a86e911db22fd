"""Grid binning and re-aggregation of molecules and cells (OP-T01..T03, A01..A07, A17, J01..J04, W05)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spatialcc.functions.scalars import bins_for_size, equal_width_bin, grid_spot_id


def extents(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """One row x0, x1, y0, y1 (OP-A17)."""
    return points.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))


def grid_bin(points: DataFrame, x_bins: int, y_bins: int, x: str = "x", y: str = "y") -> DataFrame:
    """Points with array_col and array_row of an equal-width grid over their extent (OP-T01).

    The extent is one row, so it is broadcast whatever the input's size.
    """
    both = points.crossJoin(F.broadcast(extents(points, x, y)))
    both = both.withColumn("array_col", equal_width_bin(F.col(x), F.col("x0"), F.col("x1"), x_bins))
    return both.withColumn("array_row", equal_width_bin(F.col(y), F.col("y0"), F.col("y1"), y_bins)).drop("x0", "x1", "y0", "y1")


def grid_bin_size(points: DataFrame, x_size: float, y_size: float, x: str = "x", y: str = "y") -> DataFrame:
    """As grid_bin(), with the number of bins from a bin's size (OP-T02)."""
    both = points.crossJoin(F.broadcast(extents(points, x, y)))
    nx, ny = bins_for_size(F.col("x0"), F.col("x1"), x_size), bins_for_size(F.col("y0"), F.col("y1"), y_size)
    both = both.withColumn("array_col", equal_width_bin(F.col(x), F.col("x0"), F.col("x1"), nx))
    return both.withColumn("array_row", equal_width_bin(F.col(y), F.col("y0"), F.col("y1"), ny)).drop("x0", "x1", "y0", "y1")


def tx_by_cell_grid(binned: DataFrame, cell: str = "cell") -> DataFrame:
    """Molecules per cell, grid spot and target, and their share of the cell's molecules (OP-A01, A02).

    The window reuses the aggregation's shuffle only in part; cells are many and small, so neither is skewed.
    """
    counted = binned.dropna(subset=[cell, "target"]).groupBy(cell, "array_col", "array_row", "target").agg(F.count(F.lit(1)).alias("count"))
    return counted.withColumn("tx_fx_by_grid", F.col("count") / F.sum("count").over(W.partitionBy(cell)))


def grid_matrix(tx_grid: DataFrame, norm_total: float = 1e3, keys: tuple[str, ...] = ()) -> DataFrame:
    """log1p(norm_total * summed shares) per grid spot and target, long (OP-A03, A04)."""
    summed = tx_grid.groupBy(*keys, "array_col", "array_row", "target").agg(F.sum("tx_fx_by_grid").alias("fx"))
    return summed.withColumn("value", F.log1p(F.lit(float(norm_total)) * F.col("fx"))).drop("fx")


def grid_matrix_cell(cells: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """log1p of the summed expm1 of cell values per grid spot and target (OP-A05)."""
    summed = cells.groupBy(*keys, "array_col", "array_row", "target").agg(F.sum(F.expm1("value")).alias("total"))
    return summed.withColumn("value", F.log1p("total")).drop("total")


def join_cells(values: DataFrame, cells: DataFrame, on: str | list[str] = "cell") -> DataFrame:
    """Values of cells with their metadata (OP-J01); cells that either side lacks are left out."""
    return values.join(cells, on)


def bins_to_cells(bins: DataFrame, label: str = "label", feature: str = "feature", value: str = "value") -> DataFrame:
    """Counts of bins summed by the cell that each bin is labelled with (OP-M12); bins without a cell (null or 0) are left out."""
    inside = bins.filter(F.col(label).isNotNull() & (F.col(label) != 0))
    return inside.groupBy(F.col(label).alias("cell"), feature).agg(F.sum(value).alias(value))


def attach_celltype(rows: DataFrame, cells: DataFrame, cell: str = "cell") -> DataFrame:
    """Rows of annotated cells with their type (OP-J02)."""
    return rows.join(cells.select(cell, "celltype"), cell)


def celltype_abundance_tx(tx_grid: DataFrame) -> DataFrame:
    """Summed shares per grid spot and cell type (OP-A06, transcripts)."""
    return tx_grid.groupBy("array_col", "array_row", "celltype").agg(F.sum("tx_fx_by_grid").alias("abundance"))


def celltype_abundance_cell(cells: DataFrame, cell: str = "cell") -> DataFrame:
    """Cells per grid spot and cell type (OP-A06, cells)."""
    return cells.select(cell, "array_col", "array_row", "celltype").distinct().groupBy("array_col", "array_row", "celltype").agg(F.count(F.lit(1)).alias("abundance"))


def with_all_spots(spots: DataFrame, rows: DataFrame, value: str, fill: float = 0.0) -> DataFrame:
    """Every spot, missing values filled (OP-J03, J04)."""
    return spots.join(rows, ["array_col", "array_row"], "left").withColumn(value, F.coalesce(value, F.lit(fill)))


def celltype_specific(tx_grid: DataFrame, spots: DataFrame, celltype: str, norm_total: float = 1e3, keys: tuple[str, ...] = ()) -> DataFrame:
    """The grid matrix of one cell type over all spots; spots without the type are zero (OP-P10, A07)."""
    own = grid_matrix(tx_grid.filter(F.col("celltype") == celltype), norm_total, keys)
    targets = own.select("target").distinct()
    every = spots.select(*keys, "array_col", "array_row").crossJoin(targets)  # the matrix itself: spots times targets
    return every.join(own, [*keys, "array_col", "array_row", "target"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def pivot_wide(grid: DataFrame, targets: list[str], value: str = "value") -> DataFrame:
    """One column per listed target; for export only."""
    wide = grid.groupBy("array_col", "array_row").pivot("target", targets).agg(F.first(value))
    return wide.fillna(0.0, targets).withColumn("spot_id", grid_spot_id())


def dense_axis_rank(spots: DataFrame, keys: tuple[str, ...] = ("grp",)) -> DataFrame:
    """Ranks of the distinct columns and rows within a group, from 0 (OP-W05)."""
    rank = lambda c: (F.dense_rank().over(W.partitionBy(*keys).orderBy(c)) - 1).cast("int")
    return spots.withColumn("col_rank", rank("array_col")).withColumn("row_rank", rank("array_row"))


def flip_rows(spots: DataFrame, keys: tuple[str, ...] = ("grp",)) -> DataFrame:
    """Rows counted from the other side, for display (OP-S13)."""
    return spots.withColumn("array_row", F.max("array_row").over(W.partitionBy(*keys)) - F.col("array_row"))


def crop(spots: DataFrame, col: tuple[float, float], row: tuple[float, float]) -> DataFrame:
    """Spots in a rectangle, edges included (OP-P09)."""
    return spots.filter(F.col("array_col").between(*col) & F.col("array_row").between(*row))
