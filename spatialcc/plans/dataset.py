"""The handle that users work with: tables, parameters, and whole analyses as one lazy plan (OP-T14, T16, T21, T22, P12, survey 3)."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spatialcc.functions.scalars import hex_x, hex_y
from spatialcc.operators import celltype, components, grid, jaccard, pairs, permute, qc, smooth
from spatialcc.plans.landing import land
from spatialcc.sources.readers import read_lr_db


@dataclass(frozen=True)
class Params:
    """Parameters of an analysis; out-of-range values are rejected."""

    min_size: int = 20
    fwhm: float = 2.5
    thres_per: float = 30
    x_bins: int = 100
    y_bins: int = 100
    sc_norm_total: float = 1e3
    min_counts: float = 10
    min_cells: int = 5
    lattice: str = "grid"

    def __post_init__(self) -> None:
        if not (self.min_size > 0 and self.fwhm > 0 and 0 <= self.thres_per <= 100 and self.x_bins > 0 and self.y_bins > 0 and self.sc_norm_total > 0):
            raise ValueError("min_size, fwhm, bins and sc_norm_total must be above 0, thres_per within 0 and 100")
        if self.lattice not in ("grid", "hex"):
            raise ValueError("lattice must be 'grid' or 'hex'")


@dataclass(frozen=True)
class SpatialDataset:
    """spots(grp, spot_id, array_col, array_row), expr(grp, spot_id, feature, value) and optionally obs(same), all immutable."""

    spots: DataFrame
    expr: DataFrame
    params: Params = field(default_factory=Params)
    obs: DataFrame | None = None
    tx_grid: DataFrame | None = None

    def where(self, condition) -> SpatialDataset:
        """The dataset of some spots, with the same parameters (OP-P12)."""
        spots = self.spots.filter(condition)
        near = lambda df: df.join(spots.select("grp", "spot_id"), ["grp", "spot_id"], "left_semi") if df is not None else None
        return replace(self, spots=spots, expr=near(self.expr), obs=near(self.obs))

    def kept(self) -> SpatialDataset:
        """The same dataset with its tables written to the shared folder, as every analysis reads them several times."""
        keep = lambda df, name: land(df, name) if df is not None else None
        return replace(self, spots=keep(self.spots, "spots"), expr=keep(self.expr, "expr"), obs=keep(self.obs, "obs"))

    def with_params(self, **changes) -> SpatialDataset:
        return replace(self, params=replace(self.params, **changes))

    def values(self) -> DataFrame:
        """Genes and metadata features together."""
        return self.expr if self.obs is None else self.expr.unionByName(self.obs)

    def smoothed(self, features: DataFrame | None = None) -> DataFrame:
        """(grp, feature, spot_id, array_col, array_row, smoothed), of the wanted features only."""
        values = self.values() if features is None else self.values().join(features.select("feature").distinct(), "feature", "left_semi")
        places = self.spots.select("grp", "spot_id", "array_col", "array_row")
        if self.params.lattice == "grid":
            return smooth.smooth_grid(values.join(places, ["grp", "spot_id"]), places, self.params.fwhm)
        at = self.spots.select("grp", "spot_id", hex_x().alias("x"), hex_y().alias("y"))
        return smooth.smooth_points(values.select("grp", "feature", "spot_id", "value"), at, self.params.fwhm).join(places.hint("merge"), ["grp", "spot_id"])

    def components(self, smoothed: DataFrame) -> DataFrame:
        """Filtered component labels (OP-T14). Means are of smoothed values on grids, of raw ones on hexagonal lattices."""
        p = self.params
        labels = land(components.connected_components(smoothed, p.min_size, p.lattice, p.fwhm), "components")
        return components.filter_components(labels, self.weights(smoothed), self.spots, p.thres_per)

    def weights(self, smoothed: DataFrame) -> DataFrame:
        if self.params.lattice == "grid":
            return smoothed.select("grp", "feature", "spot_id", F.col("smoothed").alias("value"))
        return self.values().select("grp", "feature", "spot_id", "value")

    def averages(self) -> DataFrame:
        genes = pairs.feature_average(self.expr, self.spots)
        return genes if self.obs is None else genes.unionByName(pairs.feature_average(self.obs, self.spots, "obs")).repartition("grp", "feature")

    def similarity(self, feature_pairs: DataFrame, jaccard_type: str = "default", on_empty: str = "raise") -> DataFrame:
        """(grp, feat_1, feat_2, avg_1, avg_2, j_comp): the pairwise pipeline (OP-T16).

        Components are found once per feature of a live pair, not per pair.
        """
        if jaccard_type not in ("default", "weighted"):
            raise ValueError("jaccard_type must be 'default' or 'weighted'")
        live = land(pairs.pairs_with_averages(feature_pairs.select("feat_1", "feat_2").distinct(), self.averages(), self.spots, on_empty), "pairs")
        names = live.select(F.col("feat_1").alias("feature")).union(live.select(F.col("feat_2").alias("feature"))).distinct()
        smoothed = land(self.smoothed(names), "smoothed")
        labels = land(self.components(smoothed), "labels")
        wanted = live.select("feat_1", "feat_2").distinct()
        if jaccard_type == "default":
            found = jaccard.jaccard_composite(wanted, labels, self.spots)
        else:
            found = jaccard.jaccard_weighted(wanted, labels, self.weights(smoothed), self.spots)
        return live.join(found, ["grp", "feat_1", "feat_2"])

    def lr_similarity(self, path: str, database: str, species: str = "human", jaccard_type: str = "default") -> DataFrame:
        """The pairwise pipeline on the pairs of a ligand-receptor database that the dataset has (OP-T21): read, clean, resolve, run."""
        wanted = land(read_lr_db(self.spots.sparkSession, path, database, species).distinct(), "lr")
        names = lambda df: df.select(F.col("feature").alias("name"))
        none = self.expr.limit(0) if self.obs is None else self.obs
        live = pairs.resolve_pairs(wanted, names(none), names(self.expr))
        return self.similarity(live.select("feat_1", "feat_2"), jaccard_type, "keep")

    def significance(self, results: DataFrame, wanted: DataFrame, n_perm: int = 1000, seed: int = 0, jaccard_type: str = "default") -> DataFrame:
        """Results of the wanted pairs with permutation p-values (OP-T19, T20); jaccard_type is the one of the results.

        Square grids shuffle smoothed values; hexagonal lattices shuffle raw values, then smooth.
        """
        p = self.params
        if jaccard_type not in ("default", "weighted"):
            raise ValueError("jaccard_type must be 'default' or 'weighted'")
        names = wanted.select(F.col("feat_1").alias("feature")).union(wanted.select(F.col("feat_2").alias("feature"))).distinct()
        values = self.weights(self.smoothed(names)) if p.lattice == "grid" else self.values()
        return permute.significance(
            results, wanted, values, self.spots, n_perm, seed, min_size=p.min_size, thres_per=p.thres_per, lattice=p.lattice, fwhm=p.fwhm, jaccard_type=jaccard_type
        )

    def celltype_specific(self, celltype_name: str) -> DataFrame:
        """The long matrix of one cell type over the dataset's spots (OP-A07); needs tx_grid with celltype."""
        if self.tx_grid is None:
            raise ValueError("the dataset has no molecules by cell and grid")
        keys = ("grp",) if "grp" in self.tx_grid.columns else ()
        places = self.spots.select(*keys, "array_col", "array_row").distinct()
        own = grid.celltype_specific(self.tx_grid, places, celltype_name, self.params.sc_norm_total, keys)
        return own.join(self.spots, [*keys, "array_col", "array_row"]).select("grp", "spot_id", F.col("target").alias("feature"), "value")

    def celltype_pair_similarity(self, feature_pairs: DataFrame, type_1: str, type_2: str, **options) -> DataFrame:
        """The pairwise pipeline with the first sides in one cell type and the second in another (OP-T22)."""
        both = land(celltype.side_by_side(self.celltype_specific(type_1), self.celltype_specific(type_2), type_1, type_2), "expr")
        if type_1 == type_2:
            both = both.distinct()
        named = celltype.celltype_pairs(feature_pairs, type_1, type_2)
        return replace(self, expr=both, obs=None).similarity(named, **options)


def from_molecules(tx: DataFrame, cells: DataFrame | None = None, params: Params | None = None, group: str = "0", qc_cells: bool = True) -> SpatialDataset:
    """A dataset from molecules (cell, x, y, target): filter cells and genes, bin, share, sum, log (OP-M10, survey 3 E2).

    cells: cell, celltype; with it only annotated cells stay, and cell-type abundances become metadata features.
    """
    params = params or Params()
    if qc_cells:
        counted = tx.groupBy("cell", "target").agg(F.count(F.lit(1)).alias("n"))
        kept = qc.quality_control(counted, params.min_counts, params.min_cells).select("cell", "target")
        tx = tx.join(kept, ["cell", "target"], "left_semi")
    binned = grid.grid_bin(tx, params.x_bins, params.y_bins)
    by_cell = grid.tx_by_cell_grid(binned)
    obs = None
    spot = grid.grid_spot_id().alias("spot_id")
    name = F.lit(group).alias("grp")
    if cells is not None:
        by_cell = grid.attach_celltype(by_cell, cells)
        obs = grid.celltype_abundance_tx(by_cell).select(name, spot, F.col("celltype").alias("feature"), F.col("abundance").alias("value"))
    spots = by_cell.select(name, spot, "array_col", "array_row").distinct()
    expr = grid.grid_matrix(by_cell, params.sc_norm_total).select(name, spot, F.col("target").alias("feature"), "value")
    return SpatialDataset(spots, expr, params, obs, by_cell)


def from_cells(cells: DataFrame, params: Params | None = None, group: str = "0") -> SpatialDataset:
    """A dataset from long cell values (cell, x, y, target, value[, celltype]), summed on the grid (OP-M10, M11)."""
    params = params or Params()
    binned = grid.grid_bin(cells, params.x_bins, params.y_bins)
    spot, name = grid.grid_spot_id().alias("spot_id"), F.lit(group).alias("grp")
    expr = grid.grid_matrix_cell(binned).select(name, spot, F.col("target").alias("feature"), "value")
    spots = binned.select(name, spot, "array_col", "array_row").distinct()
    obs = None
    if "celltype" in cells.columns:
        obs = grid.celltype_abundance_cell(binned).select(name, spot, F.col("celltype").alias("feature"), F.col("abundance").cast("double").alias("value"))
    return SpatialDataset(spots, expr, params, obs)
