"""Column expressions that the spatial operators share (survey 2.11, OP-T01, T03, P14, W03, A04, A14)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decimals that smoothed values keep, so that the order of summation can't split a plateau.
PLATEAU_DECIMALS = 10


def equal_width_bin(value: Column, low: Column, high: Column, bins: int | Column) -> Column:
    """Index 0..bins-1 of an equal-width bin; the largest value falls in the last (OP-T01). A single value is in bin 0."""
    bins = F.lit(bins) if isinstance(bins, int) else bins
    width = (high - low) / bins
    return F.when(width > 0, F.least(bins - 1, F.greatest(F.lit(0), F.floor((value - low) / width)))).otherwise(0).cast("int")


def bins_for_size(low: Column, high: Column, size: float) -> Column:
    """How many bins of a given width fit the extent, at least one (OP-T02)."""
    return F.greatest(F.lit(1), F.floor((high - low) / size)).cast("int")


def grid_spot_id(col: str = "array_col", row: str = "array_row") -> Column:
    """'<col>_<row>' (OP-T03)."""
    return F.concat_ws("_", F.col(col), F.col(row))


def hex_x(col: str = "array_col") -> Column:
    """Horizontal place on a unit hexagonal lattice (OP-P14)."""
    return F.col(col) * 0.5


def hex_y(row: str = "array_row") -> Column:
    """Vertical place on a unit hexagonal lattice (OP-P14)."""
    return F.col(row) * (F.sqrt(F.lit(3.0)) / 2)


def log_mean_exp(total_expm1: Column, n: Column) -> Column:
    """log1p of the mean of expm1 values (OP-A08)."""
    return F.log1p(total_expm1 / n)


def overlap_category(x: Column, y: Column) -> Column:
    """0 none, 1 only the first, 2 only the second, 3 both (OP-W03)."""
    inside = lambda c: F.coalesce(c, F.lit(0)) != 0
    return (F.when(inside(x), 1).otherwise(0) + F.when(inside(y), 2).otherwise(0)).cast("int")


def log_ratio(comp: Column, ref: Column) -> Column:
    """log2(comp / ref) with a zero reference giving infinity, and 0 / 0 null (OP-T24)."""
    return (
        F.when((comp > 0) & (ref > 0), F.log2(comp / ref))
        .when(comp > 0, F.lit(float("inf")))
        .when(ref > 0, F.lit(float("-inf")))
    )


def feature_name(cell_type: Column, gene: Column, sep: str = ": ") -> Column:
    """Feature prefixed by its cell type (OP-P15)."""
    return F.concat(cell_type, F.lit(sep), gene)


# Coefficients of Lanczos' approximation of the gamma function, for g = 7.
_LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def log_factorial(x: Column) -> Column:
    """The logarithm of x!, to about 15 digits, for x of 0 or more."""
    x = x.cast("double")
    series = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        series = series + F.lit(c) / (x + F.lit(float(i)))
    t = x + F.lit(7.5)
    return F.lit(0.5 * math.log(2 * math.pi)) + (x + F.lit(0.5)) * F.log(t) - t + F.log(series)
