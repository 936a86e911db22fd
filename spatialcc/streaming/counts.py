"""Molecule counts as a stream with a fixed extent, feeding the batch topology (survey 2.12, an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spatialcc.functions.scalars import equal_width_bin


def grid_counts(molecules: DataFrame, extent: tuple[float, float, float, float], x_bins: int, y_bins: int) -> DataFrame:
    """Running counts per cell, grid spot and target of a stream (or table) of molecules; extent is x0, x1, y0, y1."""
    x0, x1, y0, y1 = (F.lit(float(v)) for v in extent)
    return (
        molecules.withColumn("array_col", equal_width_bin(F.col("x"), x0, x1, x_bins))
        .withColumn("array_row", equal_width_bin(F.col("y"), y0, y1, y_bins))
        .groupBy("cell", "array_col", "array_row", "target")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def run_grid_counts(molecules: DataFrame, extent: tuple[float, float, float, float], x_bins: int, y_bins: int, checkpoint: str, table: str) -> None:
    """Drain what has arrived into an in-memory table in complete mode; the checkpoint resumes where it stopped."""
    counts = grid_counts(molecules, extent, x_bins, y_bins)
    query = counts.writeStream.outputMode("complete").format("memory").queryName(table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
