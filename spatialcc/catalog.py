"""The registered queries of the spatial engine and their oracle SQL.

Doubles are rounded to 6 decimals on both sides. Queries downstream of the merge tree run on masks that SQL can state
as well, so that only the tree itself is left to tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spatialcc import projections as P
from spatialcc.functions.scalars import hex_x, hex_y
from spatialcc.operators import adjacency, annotate, celltype, components, diff, grid, jaccard, permute, qc, smooth
from spatialcc.operators import pairs as pair_ops
from spatialcc.plans import plotdata
from spatialcc.plans.dataset import from_cells, from_molecules
from spatialcc.plans.landing import land, place
from spatialcc.sources import readers, sinks
from spatialcc.streaming import counts as stream_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(column: str, name: str | None = None):
    return F.round(F.col(column).cast("double"), 6).alias(name or column)


def r9(column: str, name: str | None = None):
    """Nine decimals, for means of few amounts in cents, which can end in an exact half at the sixth."""
    return F.round(F.col(column).cast("double"), 9).alias(name or column)


W_MOL = f"WITH {P.MOL}"
W_BASE = f"WITH {P.BASE}"
_COUNTS = f"WITH {P.MOL}, cnt AS (SELECT cell, target, count(*) AS n FROM mol GROUP BY ALL)"

# Quality control and normalisation


@query(f"{W_MOL} SELECT cell, x, target FROM mol WHERE target NOT LIKE '%NF%' AND target NOT LIKE '%RO%'")
def drop_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.drop_controls(P.molecules(spark, sf_dir), ("NF", "RO")).select("cell", "x", "target")


@query(f"{W_MOL} SELECT cell, target, count(*) AS n FROM mol WHERE cell IS NOT NULL AND cell <> 1 GROUP BY ALL")
def drop_unassigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.drop_unassigned(P.molecules(spark, sf_dir), outside=1).groupBy("cell", "target").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_COUNTS} SELECT * FROM cnt WHERE cell IN (SELECT cell FROM cnt GROUP BY cell HAVING sum(n) >= 5)")
def qc_filter_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.filter_cells(P.counts(spark, sf_dir), 5)


@query(f"{_COUNTS} SELECT * FROM cnt WHERE target IN (SELECT target FROM cnt GROUP BY target HAVING count(DISTINCT cell) >= 1000)")
def qc_filter_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.filter_genes(P.counts(spark, sf_dir), 1000)


@query(
    f"{_COUNTS}, c AS (SELECT * FROM cnt WHERE cell IN (SELECT cell FROM cnt GROUP BY cell HAVING sum(n) >= 4)) "
    "SELECT * FROM c WHERE target IN (SELECT target FROM c GROUP BY target HAVING count(DISTINCT cell) >= 500)"
)
def quality_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.quality_control(P.counts(spark, sf_dir), 4, 500)


@query("SELECT l_orderkey, l_linenumber, round_even(l_quantity + 0.5, 0) AS bin_count FROM lineitem WHERE l_quantity + 0.5 > 25")
def filter_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = P.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") + 0.5).alias("bin_count"))
    return qc.filter_bins(bins, 25)


@query(f"{_COUNTS} SELECT cell, target, round(ln(1 + n * 1000.0 / sum(n) OVER (PARTITION BY cell)), 6) AS value FROM cnt")
def normalize_log1p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.normalize_log1p(P.counts(spark, sf_dir), 1000).select("cell", "target", r6("value"))


@query(
    f"{_COUNTS}, v AS (SELECT cell, target, ln(1 + n * 1000.0 / sum(n) OVER (PARTITION BY cell)) AS value FROM cnt), "
    "s AS (SELECT target, avg(value) AS m, stddev_samp(value) AS sd FROM v GROUP BY target) "
    "SELECT cell, target, round(least(10, (value - m) / CASE WHEN sd > 0 THEN sd ELSE 1 END), 6) AS scaled FROM v JOIN s USING (target)"
)
def scale_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.scale_clip(qc.normalize_log1p(P.counts(spark, sf_dir), 1000)).select("cell", "target", r6("scaled"))


@query(
    "SELECT c_custkey, c_mktsegment, CASE WHEN k = 0 THEN c_mktsegment ELSE c_mktsegment || '-' || k END AS unique_name "
    "FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS k FROM customer)"
)
def make_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.make_unique(P.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey")


# Grid


@query(f"WITH {P.MOL}, {P.EXT}, {P.BINNED} SELECT array_col, array_row, count(*) AS n FROM binned GROUP BY ALL")
def grid_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.grid_bin(P.molecules(spark, sf_dir), P.BINS, P.BINS).groupBy("array_col", "array_row").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH {P.MOL}, {P.EXT}, b AS (SELECT {P.sql_bin('x', 'x0', 'x1', 'greatest(1, floor((x1 - x0) / 2500.0))')} AS array_col, "
    f"{P.sql_bin('y', 'y0', 'y1', 'greatest(1, floor((y1 - y0) / 10000000.0))')} AS array_row FROM mol, ext) SELECT array_col, array_row, count(*) AS n FROM b GROUP BY ALL"
)
def grid_bin_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.grid_bin_size(P.molecules(spark, sf_dir), 2500.0, 10_000_000.0).groupBy("array_col", "array_row").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {P.MOL} SELECT round(min(x), 6) AS x0, round(max(x), 6) AS x1, round(min(y), 6) AS y0, round(max(y), 6) AS y1 FROM mol")
def coordinate_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.extents(P.molecules(spark, sf_dir)).select(r6("x0"), r6("x1"), r6("y0"), r6("y1"))


@query(f"{W_BASE} SELECT cell, array_col, array_row, target, count, round(fx, 6) AS tx_fx_by_grid FROM txg")
def tx_by_cell_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.tx_grid(spark, sf_dir).select("cell", "array_col", "array_row", "target", "count", r6("tx_fx_by_grid"))


_GM = "gm AS (SELECT array_col, array_row, target, ln(1 + 1000 * sum(fx)) AS value FROM txg GROUP BY ALL)"


@query(f"{W_BASE}, {_GM} SELECT array_col, array_row, target, round(value, 6) AS value FROM gm")
def grid_matrix_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.grid_matrix(P.tx_grid(spark, sf_dir)).select("array_col", "array_row", "target", r6("value"))


_CELL = (
    f"{W_MOL}, cc AS (SELECT cell, avg(x) AS x, avg(y) AS y FROM mol GROUP BY cell), ce AS (SELECT min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM cc), "
    f"cb AS (SELECT cell, {P.sql_bin('x', 'x0', 'x1', '20')} AS array_col, {P.sql_bin('y', 'y0', 'y1', '20')} AS array_row FROM cc, ce), "
    "cn AS (SELECT cell, target, n * 1000.0 / sum(n) OVER (PARTITION BY cell) AS e FROM (SELECT cell, target, count(*) AS n FROM mol GROUP BY ALL))"
)


def _cell_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    centre = P.molecules(spark, sf_dir).groupBy("cell").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    values = qc.normalize_log1p(P.counts(spark, sf_dir), 1000)
    return grid.grid_bin(centre, 20, 20).join(values, "cell").join(P.cells(spark, sf_dir), "cell")


@query(f"{_CELL} SELECT array_col, array_row, target, round(ln(1 + sum(e)), 6) AS value FROM cn JOIN cb USING (cell) WHERE cell IN (SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey) GROUP BY ALL")
def grid_matrix_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.grid_matrix_cell(_cell_grid(spark, sf_dir)).select("array_col", "array_row", "target", r6("value"))


@query(f"{_CELL}, {P.CELLS} SELECT array_col, array_row, celltype, count(*) AS abundance FROM cb JOIN cells USING (cell) GROUP BY ALL")
def celltype_abundance_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.celltype_abundance_cell(_cell_grid(spark, sf_dir))


@query(f"{W_BASE} SELECT array_col, array_row, celltype, round(sum(fx), 6) AS abundance FROM txg JOIN cells USING (cell) GROUP BY ALL")
def celltype_abundance_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grid.attach_celltype(P.tx_grid(spark, sf_dir), P.cells(spark, sf_dir))
    return grid.celltype_abundance_tx(rows).select("array_col", "array_row", "celltype", r6("abundance"))


@query(
    f"{W_BASE}, t AS (SELECT * FROM txg JOIN cells USING (cell)), own AS (SELECT array_col, array_row, target, ln(1 + 1000 * sum(fx)) AS value FROM t WHERE celltype = '1-URGENT' GROUP BY ALL) "
    "SELECT s.array_col, s.array_row, g.target, round(coalesce(own.value, 0), 6) AS value FROM (SELECT DISTINCT array_col, array_row FROM t) s CROSS JOIN (SELECT DISTINCT target FROM own) g LEFT JOIN own USING (array_col, array_row, target)"
)
def celltype_specific(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grid.attach_celltype(P.tx_grid(spark, sf_dir), P.cells(spark, sf_dir))
    return grid.celltype_specific(rows, rows.select("array_col", "array_row").distinct(), "1-URGENT").select("array_col", "array_row", "target", r6("value"))


@query(
    f"{W_BASE}, {_GM} SELECT array_col || '_' || array_row AS spot_id, array_col, array_row, "
    + ", ".join(f'round(coalesce(max(value) FILTER (WHERE target = \'{t}\'), 0), 6) AS "{t}"' for t in P.TARGETS)
    + " FROM gm GROUP BY array_col, array_row"
)
def grid_pivot_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = grid.pivot_wide(grid.grid_matrix(P.tx_grid(spark, sf_dir)), P.TARGETS)
    return wide.select("spot_id", "array_col", "array_row", *[r6(t) for t in P.TARGETS])


@query(
    f"{W_BASE}, {P.GEXPR} SELECT grp, spot_id, (dense_rank() OVER (PARTITION BY grp ORDER BY array_col) - 1)::INT AS col_rank, (dense_rank() OVER (PARTITION BY grp ORDER BY array_row) - 1)::INT AS row_rank, "
    "max(array_row) OVER (PARTITION BY grp) - array_row AS flipped FROM spots WHERE array_col BETWEEN 3 AND 15 AND array_row BETWEEN 2 AND 17"
)
def dense_axis_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    spots = grid.crop(P.slides(spark, sf_dir).spots, (3, 15), (2, 17))
    flipped = grid.flip_rows(spots).select("grp", "spot_id", F.col("array_row").alias("flipped"))
    return grid.dense_axis_rank(spots).select("grp", "spot_id", "col_rank", "row_rank").join(flipped, ["grp", "spot_id"])


# Lattices, adjacency, smoothing


@query("SELECT p_partkey, round(p_size * 0.5, 6) AS x, round((p_partkey % 50) * sqrt(3.0) / 2, 6) AS y FROM part")
def hex_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = P.table(spark, sf_dir, "part").withColumn("array_row", F.col("p_partkey") % 50)
    return part.select("p_partkey", F.round(hex_x("p_size"), 6).alias("x"), F.round(hex_y(), 6).alias("y"))


@query(f"WITH {P.HEX} SELECT src, dst, d FROM near")
def hex_distance_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjacency.distance_join(P.hex_spots(spark, sf_dir), 2.5).select("src", "dst", "d")


@query(f"WITH {P.HEX} SELECT src, dst FROM near WHERE d > 0 AND d <= (SELECT min(d) FROM near WHERE d > 0)")
def hex_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjacency.min_distance_adjacency(adjacency.distance_join(P.hex_spots(spark, sf_dir), 2.5)).select("src", "dst")


@query(
    f"{W_BASE}, {P.GEXPR} SELECT a.grp AS grp, a.spot_id AS src, b.spot_id AS dst FROM spots a JOIN spots b ON a.grp = b.grp AND abs(a.array_col - b.array_col) + abs(a.array_row - b.array_row) = 1"
)
def grid_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjacency.grid_adjacency(P.slides(spark, sf_dir).spots)


@query(
    f"WITH {P.HEX}, w AS (SELECT dst, sum(value * exp(-d * d / (2 * (2.5 / 2.355) ** 2))) AS s FROM near JOIN hp ON src = spot_id GROUP BY dst) "
    "SELECT dst AS spot_id, round(s / sum(s) OVER () * (SELECT sum(value) FROM hp), 6) AS smoothed FROM w"
)
def smooth_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    spots = P.hex_spots(spark, sf_dir)
    expr = spots.select("grp", F.lit("p_size").alias("feature"), "spot_id", "value")
    return smooth.smooth_points(expr, spots.select("grp", "spot_id", "x", "y")).select("spot_id", r6("smoothed"))


@query(f"WITH {P.BASE}, {P.GEXPR}, {P.SMOOTH} SELECT grp, feature, spot_id, round(smoothed, 5) AS smoothed FROM smoothed")
def smooth_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.smoothed(spark, sf_dir).select("grp", "feature", "spot_id", F.round("smoothed", 5).alias("smoothed"))


# Pairs and ligand-receptor tables


@query(
    f"{W_BASE}, {P.GEXPR} SELECT grp, feature, round(ln(1 + sum(exp(value) - 1) / (SELECT count(*) FROM spots s WHERE s.grp = gx.grp)), 6) AS avg FROM gx GROUP BY grp, feature"
)
def feature_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = P.slides(spark, sf_dir)
    return pair_ops.feature_average(data.expr, data.spots).select("grp", "feature", r6("avg"))


@query(
    "WITH p(feat_1, feat_2) AS (VALUES ('1-URGENT', 'AF'), ('2-HIGH', 'NO'), ('AF', 'RO'), ('5-LOW', 'none')), o AS (SELECT DISTINCT o_orderpriority AS name FROM orders), "
    "v AS (SELECT DISTINCT l_returnflag || l_linestatus AS name FROM lineitem) SELECT feat_1, feat_2, 'obs' AS slot_1, 'var' AS slot_2 FROM p WHERE feat_1 IN (FROM o) AND feat_2 IN (FROM v)"
)
def resolve_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([("1-URGENT", "AF"), ("2-HIGH", "NO"), ("AF", "RO"), ("5-LOW", "none")], "feat_1 string, feat_2 string")
    obs = P.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("name"))
    var = P.molecules(spark, sf_dir).select(F.col("target").alias("name"))
    return pair_ops.resolve_pairs(asked, obs, var)


@query(
    f"{W_BASE}, {P.GEXPR}, {P.PAIRS}, a AS (SELECT grp, feature, ln(1 + sum(exp(value) - 1) / (SELECT count(*) FROM spots s WHERE s.grp = gx.grp)) AS avg FROM gx GROUP BY grp, feature) "
    "SELECT a.grp AS grp, feat_1, feat_2, round(a.avg, 6) AS avg_1, round(b.avg, 6) AS avg_2 FROM pairs JOIN a ON a.feature = feat_1 JOIN a b ON b.feature = feat_2 AND a.grp = b.grp WHERE a.avg <> 0 AND b.avg <> 0"
)
def pairs_with_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = P.slides(spark, sf_dir)
    kept = pair_ops.pairs_with_averages(P.pairs(spark), data.averages(), data.spots, "keep")
    return kept.select("grp", "feat_1", "feat_2", r6("avg_1"), r6("avg_2"))


@query("WITH t AS (SELECT DISTINCT p_brand AS f FROM part) SELECT a.f AS feat_1, b.f AS feat_2 FROM t a, t b WHERE a.f < b.f")
def all_feature_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_ops.all_pairs(P.table(spark, sf_dir, "part").select(F.col("p_brand").alias("feature")))


@query(
    "WITH p AS (SELECT p_brand AS feat_1, p_type AS feat_2, p_partkey AS o FROM part), u AS (SELECT feat_1 AS feature, 0 AS side, o FROM p UNION ALL SELECT feat_2, 1, o FROM p), "
    "f AS (SELECT feature, min((side, o)) AS first FROM u GROUP BY feature) SELECT feature, (row_number() OVER (ORDER BY first) - 1)::INT AS pos FROM f"
)
def features_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = P.table(spark, sf_dir, "part").select(F.col("p_brand").alias("feat_1"), F.col("p_type").alias("feat_2"), F.col("p_partkey").alias("pair_ord"))
    return pair_ops.features_in_order(asked)


@query("SELECT DISTINCT feat_1, unnest(string_split(t, '_')) AS feat_2 FROM (SELECT unnest(string_split(replace(p_brand, '#', '_'), '_')) AS feat_1, replace(p_type, ' ', '_') AS t FROM part)")
def lr_omnipath_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = P.table(spark, sf_dir, "part").select(F.regexp_replace("p_brand", "#", "_").alias("source_genesymbol"), F.regexp_replace("p_type", " ", "_").alias("target_genesymbol"))
    return pair_ops.lr_omnipath(db)


@query(
    "WITH n AS (SELECT CASE WHEN p_size % 2 = 0 THEN p_brand || ' - (' || p_size || '+' || p_partkey || ')' ELSE p_brand || ' - ' || p_size END AS i FROM part), "
    "s AS (SELECT string_split(replace(i, ' ', ''), '-') AS a FROM n) SELECT a[1] AS feat_1, unnest(string_split(replace(replace(a[2], '(', ''), ')', ''), '+')[1:2]) AS feat_2 FROM s"
)
def lr_cellchat_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = P.table(spark, sf_dir, "part")
    two = F.concat(F.col("p_brand"), F.lit(" - ("), F.col("p_size"), F.lit("+"), F.col("p_partkey"), F.lit(")"))
    return pair_ops.lr_cellchat(part.select(F.when(F.col("p_size") % 2 == 0, two).otherwise(F.concat(F.col("p_brand"), F.lit(" - "), F.col("p_size"))).alias("interaction_name_2")))


@query("SELECT p_brand AS feat_1, p_type AS feat_2 FROM part")
def lr_celltalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_ops.lr_celltalk(P.table(spark, sf_dir, "part").select(F.col("p_brand").alias("ligand_gene_symbol"), F.col("p_type").alias("receptor_gene_symbol")))


@query("SELECT DISTINCT c_mktsegment AS grp FROM customer WHERE c_nationkey < 5 INTERSECT SELECT DISTINCT c_mktsegment FROM customer WHERE c_nationkey >= 20")
def common_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = P.table(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "grp")
    return pair_ops.common_groups(c.filter("c_nationkey < 5"), c.filter("c_nationkey >= 20"))


# The topological core


@query(
    f"""WITH RECURSIVE {P.BASE}, {P.GEXPR}, {P.SMOOTH}, {P.LABELS},
m AS (SELECT l.grp, l.feature, l.spot_id, s.array_col * 100 + s.array_row AS id, s.array_col AS c, s.array_row AS r FROM lab l JOIN spots s USING (grp, spot_id)),
e AS (SELECT a.grp, a.feature, a.id AS a, b.id AS b FROM m a JOIN m b ON a.grp = b.grp AND a.feature = b.feature AND abs(a.c - b.c) + abs(a.r - b.r) = 1),
reach(grp, feature, id, root) AS (SELECT grp, feature, id, id FROM m UNION SELECT e.grp, e.feature, e.b, reach.root FROM reach JOIN e ON e.grp = reach.grp AND e.feature = reach.feature AND e.a = reach.id)
SELECT grp, feature, root, count(*) AS size FROM (SELECT grp, feature, id, min(root) AS root FROM reach GROUP BY ALL) GROUP BY grp, feature, root"""
)
def threshold_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of a mask at a fixed threshold: the tree's kernel on a single plateau."""
    labels, places = _masked(spark, sf_dir)
    mask = labels.join(places, ["grp", "spot_id"]).withColumn("smoothed", F.lit(1.0))
    found = components.connected_components(mask.select("grp", "feature", "spot_id", "array_col", "array_row", "smoothed"), 1).join(places, ["grp", "spot_id"])
    sized = found.groupBy("grp", "feature", "cc_label").agg(F.min(F.col("array_col") * 100 + F.col("array_row")).alias("root"), F.count(F.lit(1)).alias("size"))
    return sized.select("grp", "feature", "root", "size")


_TREE = f"WITH RECURSIVE {P.BASE}, {P.GEXPR}, {P.SMOOTH}, {P.TREE}"


@query(f"{_TREE} SELECT grp, feature, round(birth, 6) AS birth, round(death, 6) AS death, size::INT AS size, n::INT AS n_children FROM nodes")
def merge_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes before pruning."""
    nodes = components.merge_trees(P.smoothed(spark, sf_dir), P.PARAMS.min_size)
    return nodes.select("grp", "feature", r6("birth"), r6("death"), "size", F.size("children").alias("n_children"))


_NAMED = "SELECT grp, feature, spot_id, count(*) OVER (PARTITION BY grp, feature, cc) AS cc_size, min(id) OVER (PARTITION BY grp, feature, cc) AS cc_first FROM"
_PRUNED = f"{_TREE}, {P.sql_leaves(P.PARAMS.min_size)}"


def _named(labels: DataFrame, spots: DataFrame) -> DataFrame:
    """Labelled spots with the size and the first spot of their component, as labels only follow the order of nodes."""
    by = W.partitionBy("grp", "feature", "cc_label")
    at = labels.join(spots, ["grp", "spot_id"]).withColumn("id", F.col("array_col") * 100 + F.col("array_row"))
    return at.select("grp", "feature", "spot_id", F.count(F.lit(1)).over(by).alias("cc_size"), F.min("id").over(by).alias("cc_first"))


@query(f"{_TREE}, {P.sql_leaves(1)} {_NAMED} leaf")
def unpruned_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components at a least size of 1, at which nothing is pruned."""
    data = P.slides(spark, sf_dir)
    return _named(components.connected_components(P.smoothed(spark, sf_dir, data), 1), data.spots)


@query(f"{_PRUNED} {_NAMED} leaf")
def pruned_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = P.slides(spark, sf_dir)
    return _named(components.connected_components(P.smoothed(spark, sf_dir, data), P.PARAMS.min_size), data.spots)


@query(f"{_PRUNED} SELECT grp, feature, count(DISTINCT cc) AS n_leaves FROM leaf GROUP BY ALL")
def dendrogram_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars of the last layer: one for each component."""
    bars = components.dendrogram_bars(P.smoothed(spark, sf_dir), P.PARAMS.min_size)
    return bars.filter("layer = 0").groupBy("grp", "feature").agg(F.count(F.lit(1)).alias("n_leaves"))


@query()
def dendrogram_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.dendrogram_bars(P.smoothed(spark, sf_dir), P.PARAMS.min_size)


@query(f"{_PRUNED} {_NAMED} cclab")
def cc_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = P.slides(spark, sf_dir)
    return _named(data.components(P.smoothed(spark, sf_dir, data)), data.spots)


@query(f"{_PRUNED} SELECT grp, feature, count(DISTINCT cc) AS n_cc, count(*) AS n_spots FROM cclab GROUP BY ALL")
def cc_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of the labels that are left run from 1 without a gap."""
    data = P.slides(spark, sf_dir)
    found = components.split_components(data.components(P.smoothed(spark, sf_dir, data)))
    return found.groupBy("grp", "feature").agg(F.max("cc").cast("bigint").alias("n_cc"), F.count(F.lit(1)).alias("n_spots"))


_AVERAGES = "av AS (SELECT grp, feature, ln(1 + sum(exp(value) - 1) / (SELECT count(*) FROM spots s WHERE s.grp = gx.grp)) AS avg FROM gx GROUP BY grp, feature)"
_WITH_AVERAGES = (
    "SELECT a.grp AS grp, pairs.feat_1 AS feat_1, pairs.feat_2 AS feat_2, round(a.avg, 6) AS avg_1, round(b.avg, 6) AS avg_2, round(coalesce(j_comp, 0), 6) AS j_comp FROM pairs JOIN av a ON a.feature = feat_1 "
    "JOIN av b ON b.feature = feat_2 AND a.grp = b.grp LEFT JOIN j ON j.grp = a.grp AND j.feat_1 = pairs.feat_1 AND j.feat_2 = pairs.feat_2 WHERE a.avg <> 0 AND b.avg <> 0"
)
_SET = (
    "xs AS (SELECT l.grp, feat_1, feat_2, spot_id, 1 AS side FROM pairs JOIN cclab l ON feature = feat_1 UNION ALL SELECT l.grp, feat_1, feat_2, spot_id, 2 FROM pairs JOIN cclab l ON feature = feat_2), "
    "mt AS (SELECT grp, feat_1, feat_2, spot_id, sum(side) AS s FROM xs GROUP BY ALL), j AS (SELECT grp, feat_1, feat_2, count(*) FILTER (WHERE s = 3) / count(*) AS j_comp FROM mt GROUP BY ALL)"
)
_WEIGHTED = (
    "uv AS (SELECT grp, feature, spot_id, (smoothed - lo) / (hi - lo) AS u FROM smoothed JOIN (SELECT grp, feature, CASE WHEN count(*) < (SELECT count(*) FROM spots s WHERE s.grp = smoothed.grp) THEN least(min(smoothed), 0) "
    "ELSE min(smoothed) END AS lo, max(smoothed) AS hi FROM smoothed GROUP BY grp, feature) USING (grp, feature)), lu AS (SELECT * FROM cclab JOIN uv USING (grp, feature, spot_id)), "
    "xs AS (SELECT lu.grp, feat_1, feat_2, spot_id, u AS a, 0::DOUBLE AS b FROM pairs JOIN lu ON feature = feat_1 UNION ALL SELECT lu.grp, feat_1, feat_2, spot_id, 0::DOUBLE, u FROM pairs JOIN lu ON feature = feat_2), "
    "mt AS (SELECT grp, feat_1, feat_2, spot_id, sum(xs.a) AS a, sum(xs.b) AS b FROM xs GROUP BY grp, feat_1, feat_2, spot_id), j AS (SELECT grp, feat_1, feat_2, sum(least(mt.a, mt.b)) / sum(greatest(mt.a, mt.b)) AS j_comp FROM mt GROUP BY grp, feat_1, feat_2)"
)


@query(f"{_PRUNED}, {P.PAIRS}, {_AVERAGES}, {_SET} {_WITH_AVERAGES}")
def pair_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: six targets, all pairs, on every slide."""
    return P.slides(spark, sf_dir).similarity(P.pairs(spark), on_empty="keep").select("grp", "feat_1", "feat_2", r6("avg_1"), r6("avg_2"), r6("j_comp"))


@query(f"{_PRUNED}, {P.PAIRS}, {_AVERAGES}, {_WEIGHTED} {_WITH_AVERAGES}")
def pair_similarity_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.slides(spark, sf_dir).similarity(P.pairs(spark), "weighted", "keep").select("grp", "feat_1", "feat_2", r6("avg_1"), r6("avg_2"), r6("j_comp"))


@query(f"{_TREE}, {P.sql_leaves(1)}, {P.PAIRS}, {_AVERAGES}, {_SET} {_WITH_AVERAGES}")
def pair_similarity_unpruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pairwise pipeline at a least size of 1."""
    data = P.slides(spark, sf_dir).with_params(min_size=1)
    return data.similarity(P.pairs(spark), on_empty="keep").select("grp", "feat_1", "feat_2", r6("avg_1"), r6("avg_2"), r6("j_comp"))


@query()
def pair_similarity_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns of part as features on a hexagonal lattice."""
    from dataclasses import replace

    from spatialcc.plans.dataset import SpatialDataset

    spots = P.hex_spots(spark, sf_dir)
    price = P.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("spot_id"), F.col("p_retailprice").alias("value"))
    expr = spots.select("grp", "spot_id", F.lit("size").alias("feature"), "value").unionByName(spots.select("grp", "spot_id").join(price.hint("merge"), "spot_id").withColumn("feature", F.lit("price")).select("grp", "spot_id", "feature", F.log1p("value").alias("value")))
    data = SpatialDataset(spots.select("grp", "spot_id", "array_col", "array_row"), expr, replace(P.PARAMS, lattice="hex")).kept()
    return data.similarity(spark.createDataFrame([("size", "price"), ("size", "size")], "feat_1 string, feat_2 string"), on_empty="keep")


_TYPED = (
    f"WITH RECURSIVE {P.BASE}, {P.GEXPR.replace('gx AS', 'g0 AS').replace('FROM gx', 'FROM g0')}, txc AS (SELECT * FROM txg JOIN cells USING (cell)), "
    + ", ".join(f"o{k} AS (SELECT grp, array_col || '_' || array_row AS spot_id, array_col, array_row, '{t}: ' || target AS feature, ln(1 + 1000 * sum(fx)) AS value FROM txc WHERE celltype = '{t}' GROUP BY ALL)" for k, t in ((1, "1-URGENT"), (5, "5-LOW")))
    + f", gx AS (FROM o1 UNION ALL FROM o5), {P.SMOOTH}, {P.TREE}, {P.sql_leaves(P.PARAMS.min_size)}, {P.PAIRS.replace('pairs(feat_1, feat_2)', 'p0(f1, f2)')}, pairs AS (SELECT '1-URGENT: ' || f1 AS feat_1, '5-LOW: ' || f2 AS feat_2 FROM p0)"
)


@query(f"{_TYPED}, {_AVERAGES}, {_SET} {_WITH_AVERAGES}")
def celltype_pair_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.slides(spark, sf_dir).celltype_pair_similarity(P.pairs(spark), "1-URGENT", "5-LOW", on_empty="keep")
    return found.select("grp", "feat_1", "feat_2", r6("avg_1"), r6("avg_2"), r6("j_comp"))


@query()
def permutation_pvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = P.slides(spark, sf_dir)
    wanted = P.pairs(spark)
    results = land(data.similarity(wanted, on_empty="keep"), "results")
    return data.significance(results, wanted, seed=1234)


# Overlap, on masks


def _masked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Labels of the masks, and the spots, of one dataset."""
    data = P.slides(spark, sf_dir)
    return P.mask_labels(spark, sf_dir, data), data.spots


@query(
    f"{P.MASKED}, g AS (SELECT DISTINCT grp FROM spots), x AS (SELECT lab.grp, feat_1, feat_2, spot_id, 1 AS side FROM pairs JOIN lab ON feature = feat_1 UNION ALL SELECT lab.grp, feat_1, feat_2, spot_id, 2 FROM pairs JOIN lab ON feature = feat_2), "
    "m AS (SELECT grp, feat_1, feat_2, spot_id, sum(side) AS s FROM x GROUP BY ALL), j AS (SELECT grp, feat_1, feat_2, count(*) FILTER (WHERE s = 3) / count(*) AS j_comp FROM m GROUP BY ALL) "
    "SELECT grp, feat_1, feat_2, round(coalesce(j_comp, 0), 6) AS j_comp FROM pairs CROSS JOIN g LEFT JOIN j USING (grp, feat_1, feat_2)"
)
def jaccard_from_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_composite(P.pairs(spark), *_masked(spark, sf_dir)).select("grp", "feat_1", "feat_2", r6("j_comp"))


_UNIT = (
    "uv AS (SELECT grp, feature, spot_id, (smoothed - lo) / (hi - lo) AS u FROM smoothed JOIN (SELECT grp, feature, "
    "CASE WHEN count(*) < (SELECT count(*) FROM spots s WHERE s.grp = smoothed.grp) THEN least(min(smoothed), 0) ELSE min(smoothed) END AS lo, max(smoothed) AS hi FROM smoothed GROUP BY grp, feature) USING (grp, feature)), "
    "lu AS (SELECT * FROM lab JOIN uv USING (grp, feature, spot_id))"
)


@query(
    f"{P.MASKED}, {_UNIT}, x AS (SELECT grp, feat_1, feat_2, spot_id, u AS a, 0 AS b FROM pairs JOIN lu ON feature = feat_1 UNION ALL SELECT grp, feat_1, feat_2, spot_id, 0, u FROM pairs JOIN lu ON feature = feat_2), "
    "m AS (SELECT grp, feat_1, feat_2, spot_id, sum(a) AS a, sum(b) AS b FROM x GROUP BY ALL) SELECT grp, feat_1, feat_2, round(sum(least(a, b)) / sum(greatest(a, b)), 6) AS j_comp FROM m GROUP BY ALL"
)
def jaccard_weighted_from_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = P.slides(spark, sf_dir)
    s = P.smoothed(spark, sf_dir, data).select("grp", "feature", "spot_id", F.col("smoothed").alias("value"))
    return jaccard.jaccard_weighted(P.pairs(spark), P.mask_labels(spark, sf_dir, data), s, data.spots).select("grp", "feat_1", "feat_2", r6("j_comp"))


_LOCAL = (
    "sz AS (SELECT grp, feature, cc_label, count(*) AS n FROM lab GROUP BY ALL), ov AS (SELECT a.grp, feat_1, feat_2, a.cc_label AS ccx, b.cc_label AS ccy, count(*) AS i FROM pairs JOIN lab a ON a.feature = feat_1 JOIN lab b ON b.feature = feat_2 AND b.grp = a.grp AND b.spot_id = a.spot_id GROUP BY ALL), "
    "lj AS (SELECT a.grp, feat_1, feat_2, a.cc_label AS ccx, b.cc_label AS ccy, coalesce(i, 0) / (a.n + b.n - coalesce(i, 0)) AS j_local FROM pairs JOIN sz a ON a.feature = feat_1 JOIN sz b ON b.feature = feat_2 AND b.grp = a.grp "
    "LEFT JOIN ov ON ov.grp = a.grp AND ov.feat_1 = pairs.feat_1 AND ov.feat_2 = pairs.feat_2 AND ov.ccx = a.cc_label AND ov.ccy = b.cc_label)"
)
_TOP = "top AS (SELECT *, row_number() OVER (PARTITION BY grp, feat_1, feat_2 ORDER BY j_local DESC, ccx, ccy)::INT AS rank FROM lj WHERE j_local > 0 QUALIFY rank <= 2)"


@query(f"{P.MASKED}, {_LOCAL.replace('lj AS (SELECT a.grp, feat_1, feat_2', 'lj AS (SELECT a.grp, pairs.feat_1, pairs.feat_2')} SELECT grp, feat_1, feat_2, ccx, ccy, round(j_local, 6) AS j_local FROM lj")
def local_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.local_jaccard(P.pairs(spark), P.mask_labels(spark, sf_dir)).select("grp", "feat_1", "feat_2", "ccx", "ccy", r6("j_local"))


_LJ = _LOCAL.replace("lj AS (SELECT a.grp, feat_1, feat_2", "lj AS (SELECT a.grp, pairs.feat_1, pairs.feat_2")


@query(
    f"{P.MASKED}, {_UNIT}, sz AS (SELECT grp, feature, cc_label, sum(u) AS n FROM lu GROUP BY ALL), ov AS (SELECT a.grp, feat_1, feat_2, a.cc_label AS ccx, b.cc_label AS ccy, sum(least(a.u, b.u)) AS i FROM pairs JOIN lu a ON a.feature = feat_1 JOIN lu b ON b.feature = feat_2 AND b.grp = a.grp AND b.spot_id = a.spot_id GROUP BY ALL) "
    "SELECT a.grp AS grp, pairs.feat_1 AS feat_1, pairs.feat_2 AS feat_2, a.cc_label AS ccx, b.cc_label AS ccy, round(coalesce(i, 0) / (a.n + b.n - coalesce(i, 0)), 6) AS j_local FROM pairs JOIN sz a ON a.feature = feat_1 JOIN sz b ON b.feature = feat_2 AND b.grp = a.grp "
    "LEFT JOIN ov ON ov.grp = a.grp AND ov.feat_1 = pairs.feat_1 AND ov.feat_2 = pairs.feat_2 AND ov.ccx = a.cc_label AND ov.ccy = b.cc_label"
)
def local_jaccard_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = P.slides(spark, sf_dir)
    s = P.smoothed(spark, sf_dir, data).select("grp", "feature", "spot_id", F.col("smoothed").alias("value"))
    local = jaccard.local_jaccard_weighted(P.pairs(spark), P.mask_labels(spark, sf_dir, data), s, data.spots)
    return local.select("grp", "feat_1", "feat_2", "ccx", "ccy", r6("j_local"))


@query(f"{P.MASKED}, {_LJ}, {_TOP} SELECT grp, feat_1, feat_2, ccx, ccy, rank, round(j_local, 6) AS j_local FROM top")
def top_n_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = jaccard.top_regions(jaccard.local_jaccard(P.pairs(spark), P.mask_labels(spark, sf_dir)), 2)
    return top.select("grp", "feat_1", "feat_2", "ccx", "ccy", "rank", r6("j_local"))


@query(
    f"{P.MASKED}, {_LJ}, {_TOP}, s AS (SELECT top.grp, feat_1, feat_2, rank, spot_id, 1 AS side FROM top JOIN lab ON lab.grp = top.grp AND feature = feat_1 AND cc_label = ccx UNION ALL "
    "SELECT top.grp, feat_1, feat_2, rank, spot_id, 2 FROM top JOIN lab ON lab.grp = top.grp AND feature = feat_2 AND cc_label = ccy) SELECT grp, feat_1, feat_2, rank, spot_id, sum(side)::INT AS category FROM s GROUP BY ALL"
)
def plot_top_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = plotdata.top_regions_map(*_masked(spark, sf_dir)[::-1], P.pairs(spark), 2, background=False)
    return found.select("grp", "feat_1", "feat_2", "rank", "spot_id", "category")


@query(
    f"{P.MASKED} SELECT grp, spot_id, array_col, array_row, (CASE WHEN x.cc_label IS NULL THEN 0 ELSE 1 END + CASE WHEN y.cc_label IS NULL THEN 0 ELSE 2 END)::INT AS category "
    "FROM spots LEFT JOIN (SELECT * FROM lab WHERE feature = 'AF') x USING (grp, spot_id) LEFT JOIN (SELECT * FROM lab WHERE feature = 'NO') y USING (grp, spot_id)"
)
def overlap_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plotdata.all_components_map(*_masked(spark, sf_dir)[::-1], "AF", "NO")


@query(f"{W_BASE}, {P.GEXPR} SELECT s.grp AS grp, s.spot_id AS spot_id, s.array_col AS array_col, s.array_row AS array_row, round(least(7, greatest(2, coalesce(value, 0))), 6) AS value FROM spots s LEFT JOIN (SELECT * FROM gx WHERE feature = 'RF') x ON x.grp = s.grp AND x.spot_id = s.spot_id")
def plot_feature_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = P.slides(spark, sf_dir)
    return plotdata.feature_map(data.spots, data.expr, "RF", 2, 7).select("grp", "spot_id", "array_col", "array_row", r6("value"))


@query(
    f"{P.MASKED} SELECT grp, spot_id, array_col, array_row, "
    + ", ".join(f"coalesce(max(cc_label) FILTER (WHERE feature = '{t}'), 0) AS Comb_CC_{t}" for t in P.TARGETS)
    + " FROM spots LEFT JOIN lab USING (grp, spot_id) GROUP BY ALL"
)
def labels_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.wide_labels(*_masked(spark, sf_dir), P.TARGETS)


_MEANS = (
    "ins AS (SELECT grp, feature, cc_label, sum(coalesce(value, 0)) AS s, count(*) AS n FROM lab LEFT JOIN gx USING (grp, feature, spot_id) GROUP BY ALL), "
    "outs AS (SELECT grp, feature, 0 AS cc_label, (SELECT sum(value) FROM gx WHERE gx.grp = t.grp AND gx.feature = t.feature) - s AS s, (SELECT count(*) FROM spots WHERE spots.grp = t.grp) - n AS n "
    "FROM (SELECT grp, feature, sum(s) AS s, sum(n) AS n FROM ins GROUP BY ALL) t), "
    "mn AS (SELECT grp, feature, cc_label, s / n AS mean, n FROM (FROM ins UNION ALL FROM outs) WHERE n > 0)"
)


@query(f"{P.MASKED}, {_MEANS} SELECT grp, feature, cc_label, round(mean, 6) AS mean, n::BIGINT AS n FROM mn")
def label_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = P.slides(spark, sf_dir)
    return components.label_means(P.mask_labels(spark, sf_dir, data), data.expr, data.spots).select("grp", "feature", "cc_label", r6("mean"), "n")


@query(
    f"{P.MASKED}, {_MEANS}, rk AS (SELECT *, row_number() OVER (PARTITION BY grp, feature ORDER BY mean DESC, cc_label) AS k, count(*) OVER (PARTITION BY grp, feature) AS m FROM mn) "
    "SELECT grp, feature, cc_label, spot_id FROM lab WHERE (grp, feature, cc_label) IN (SELECT (grp, feature, cc_label) FROM rk WHERE k <= floor(m * 0.7) AND cc_label > 0)"
)
def percentile_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = P.slides(spark, sf_dir)
    return components.filter_components(P.mask_labels(spark, sf_dir, data), data.expr, data.spots, 30).select("grp", "feature", "cc_label", "spot_id")


# Cell types, permutations, differential analysis


@query(
    f"{P.MASKED}, ok AS (SELECT a.grp, a.spot_id FROM (SELECT DISTINCT grp, spot_id FROM lab WHERE feature = 'RF') a JOIN (SELECT DISTINCT grp, spot_id FROM lab WHERE feature = 'RO') b USING (grp, spot_id)), "
    "l AS (SELECT lab.* FROM lab JOIN ok USING (grp, spot_id)), x AS (SELECT l.grp, feat_1, feat_2, spot_id, 1 AS side FROM pairs JOIN l ON feature = feat_1 UNION ALL SELECT l.grp, feat_1, feat_2, spot_id, 2 FROM pairs JOIN l ON feature = feat_2), "
    "m AS (SELECT grp, feat_1, feat_2, spot_id, sum(side) AS s FROM x GROUP BY ALL), j AS (SELECT grp, feat_1, feat_2, count(*) FILTER (WHERE s = 3) / count(*) AS j_comp FROM m GROUP BY ALL) "
    "SELECT grp, feat_1, feat_2, round(j_comp, 6) AS j_comp FROM pairs CROSS JOIN (SELECT DISTINCT grp FROM lab) LEFT JOIN j USING (grp, feat_1, feat_2)"
)
def constrained_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return celltype.constrained_jaccard(P.pairs(spark), P.mask_labels(spark, sf_dir), "RF", "RO").select("grp", "feat_1", "feat_2", r6("j_comp"))


@query(
    "WITH o AS (SELECT event_type AS feat_1, avg(value) AS j FROM events GROUP BY 1) SELECT '0' AS grp, feat_1, 'all' AS feat_2, round(j, 6) AS j_comp, round((SELECT avg(CASE WHEN e.value >= o.j THEN 1.0 ELSE 0 END) FROM events e WHERE e.event_type = o.feat_1), 6) AS p_value FROM o"
)
def pvalue_from_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = P.table(spark, sf_dir, "events").select(F.lit("0").alias("grp"), F.col("event_type").alias("feat_1"), F.lit("all").alias("feat_2"), F.col("value").alias("j_perm"))
    observed = events.groupBy("grp", "feat_1", "feat_2").agg(F.avg("j_perm").alias("j_comp"))
    return permute.p_values(observed, events).select("grp", "feat_1", "feat_2", r6("j_comp"), r6("p_value"))


@query("SELECT c_mktsegment AS grp, 3 AS n_perm, count(*) * 3 AS n_rows, count(*) AS n_sources, count(*) AS n_spots FROM customer GROUP BY c_mktsegment")
def permutation_shuffles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that every set of permutations satisfies: each maps all spots onto all spots."""
    spots = P.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("grp"), F.col("c_custkey").alias("spot_id"), F.col("c_custkey").alias("array_col"), F.lit(0).alias("array_row"))
    moved = permute.shuffles(spots, 3, 7).groupBy("grp").agg(F.countDistinct("perm").cast("int").alias("n_perm"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct("perm", "from_spot").alias("pf"), F.countDistinct("perm", "spot_id").alias("ps"))
    return moved.select("grp", "n_perm", "n_rows", (F.col("pf") / 3).cast("bigint").alias("n_sources"), (F.col("ps") / 3).cast("bigint").alias("n_spots"))


_RES = (
    "res AS (SELECT c_mktsegment AS grp, 'N' || c_nationkey AS feat_1, 'R' || (c_custkey % 7) AS feat_2, avg(abs(c_acctbal)) / 10000 AS j_comp FROM customer GROUP BY ALL), "
    "prs AS (SELECT DISTINCT feat_1, feat_2 FROM res), sl AS (SELECT DISTINCT grp, CASE WHEN grp < 'G' THEN 'ER' ELSE 'TN' END AS cond FROM res), "
    "mean AS (SELECT cond, feat_1, feat_2, avg(coalesce(j_comp, 0)) AS mean FROM prs CROSS JOIN sl LEFT JOIN res USING (grp, feat_1, feat_2) GROUP BY ALL), "
    "df AS (SELECT feat_1, feat_2, a.mean AS mean_comp, b.mean AS mean_ref, CASE WHEN a.mean > 0 AND b.mean > 0 THEN log2(a.mean / b.mean) WHEN a.mean > 0 THEN 'inf'::DOUBLE WHEN b.mean > 0 THEN '-inf'::DOUBLE END AS logfc "
    "FROM (SELECT * FROM mean WHERE cond = 'TN') a JOIN (SELECT * FROM mean WHERE cond = 'ER') b USING (feat_1, feat_2))"
)


def _results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = P.table(spark, sf_dir, "customer")
    res = c.groupBy(F.col("c_mktsegment").alias("grp"), F.concat(F.lit("N"), F.col("c_nationkey")).alias("feat_1"), F.concat(F.lit("R"), F.col("c_custkey") % 7).alias("feat_2")).agg((F.avg(F.abs("c_acctbal")) / 10000).alias("j_comp"))
    slides = res.select("grp").distinct().withColumn("cond", F.when(F.col("grp") < "G", "ER").otherwise("TN"))
    means = diff.slide_means(res, res.select("feat_1", "feat_2"), slides)
    return res, means, diff.differential(means, "TN", "ER", 0.2, 0.1)


@query(f"WITH {_RES} SELECT cond, feat_1, feat_2, round(mean, 9) AS mean FROM mean")
def slide_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir)[1].select("cond", "feat_1", "feat_2", r9("mean"))


@query(f"WITH {_RES} SELECT feat_1, feat_2, round(mean_comp, 9) AS mean_comp, round(mean_ref, 9) AS mean_ref, CASE WHEN isinf(logfc) THEN 999 ELSE round(logfc, 9) END AS logfc FROM df WHERE logfc > 0.2 AND mean_comp > 0.1")
def diff_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _results(spark, sf_dir)[2]
    finite = F.when(F.col("logfc") == float("inf"), 999.0).otherwise(F.round("logfc", 9))
    return d.select("feat_1", "feat_2", r9("mean_comp"), r9("mean_ref"), finite.alias("logfc"))


@query(f"WITH {_RES} SELECT feat_1, feat_2, round(mean_comp, 9) AS mean_comp FROM df WHERE logfc > 0.2 AND mean_comp > 0.1 ORDER BY df.mean_comp DESC, feat_1, feat_2 LIMIT 10")
def top_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.top_by(_results(spark, sf_dir)[2], "mean_comp", 10, "feat_1", "feat_2").select("feat_1", "feat_2", r9("mean_comp"))


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(f"WITH {_RES} SELECT feat_1, feat_2, " + ", ".join(f"round(coalesce(max(j_comp) FILTER (WHERE grp = '{s}'), 0), 9) AS {s}" for s in _SEGMENTS) + " FROM res GROUP BY ALL")
def heatmap_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.pivot_by_group(_results(spark, sf_dir)[0], _SEGMENTS).select("feat_1", "feat_2", *[r9(s) for s in _SEGMENTS])


@query(
    f"WITH {_RES}, d AS (SELECT * FROM df WHERE logfc > 0.2 AND mean_comp > 0.1), t(term, gene) AS (VALUES ('T1', 'N1'), ('T1', 'R2'), ('T1', 'N7'), ('T2', 'N3'), ('T2', 'R0'), ('T3', 'R5')), "
    "h AS (SELECT DISTINCT term, feat_1, feat_2, least(logfc, 1.5) AS heat FROM d JOIN t ON gene = feat_1 OR gene = feat_2) SELECT feat_1, feat_2, "
    + ", ".join(f"round(coalesce(max(heat) FILTER (WHERE term = '{t}'), 0), 9) AS {t}" for t in ("T1", "T2", "T3"))
    + " FROM h GROUP BY feat_1, feat_2"
)
def lr_go_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = spark.createDataFrame([("T1", "N1/R2/N7"), ("T2", "N3/R0"), ("T3", "R5")], "term string, genes string")
    return diff.term_heat(terms, _results(spark, sf_dir)[2], 1.5, ["T1", "T2", "T3"]).select("feat_1", "feat_2", r9("T1"), r9("T2"), r9("T3"))


@query(
    "WITH u AS (SELECT DISTINCT p_partkey AS gene FROM part), s AS (SELECT p_brand AS term, p_partkey AS gene FROM part), h AS (SELECT p_partkey AS gene FROM part WHERE p_size > 30 AND p_partkey % 3 = 0), "
    "c AS (SELECT term, count(*) AS m, count(h.gene) AS k FROM s LEFT JOIN h USING (gene) GROUP BY term), p AS (SELECT c.*, (SELECT count(*) FROM h) AS n, (SELECT count(*) FROM u) AS big FROM c WHERE k > 0), "
    "tail AS (SELECT term, k, m, n, big, least(1.0, (SELECT sum(exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) + lgamma(big - m + 1) - lgamma(n - i + 1) - lgamma(big - m - n + i + 1) - lgamma(big + 1) + lgamma(n + 1) + lgamma(big - n + 1))) "
    "FROM (SELECT unnest(range(p.k, least(p.n, p.m) + 1)) AS i) WHERE big - m - n + i >= 0)) AS pv FROM p) "
    "SELECT term, k, m, n AS drawn, big AS universe, round(pv, 6) AS p_value, round(min(least(1.0, pv * t / r)) OVER (ORDER BY pv, term ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS p_adjust FROM (SELECT *, row_number() OVER (ORDER BY pv, term) AS r, count(*) OVER () AS t FROM tail)"
)
def over_representation(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = P.table(spark, sf_dir, "part")
    genes = part.select(F.col("p_partkey").alias("gene"))
    found = diff.over_representation(part.select(F.col("p_brand").alias("term"), F.col("p_partkey").alias("gene")), part.filter("p_size > 30 and p_partkey % 3 = 0").select(F.col("p_partkey").alias("gene")), genes)
    return found.select("term", "k", "m", "drawn", "universe", r6("p_value"), r6("p_adjust"))


# Annotation


@query(
    "WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(v) AS m FROM e GROUP BY ALL), "
    "d AS (SELECT e.vec_id AS cell, c.label AS label, sum((v - m) ** 2) AS d FROM e JOIN c USING (i) GROUP BY ALL), w AS (SELECT cell, label, exp(-(d - min(d) OVER (PARTITION BY cell))) AS w FROM d) "
    "SELECT cell, label, round(w / sum(w) OVER (PARTITION BY cell), 6) AS probability FROM w"
)
def celltype_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.table(spark, sf_dir, "embeddings")
    return annotate.annotate(e.withColumnRenamed("vec_id", "cell"), e, return_prob=True).select("cell", "label", r6("probability"))


@query(
    "WITH p AS (SELECT user_id, event_type, sum(value) AS s FROM events GROUP BY ALL), q AS (SELECT user_id AS cell, event_type AS label, s AS probability FROM p), b AS (SELECT cell, max(probability) AS probability FROM q GROUP BY cell) "
    "SELECT cell, min(label) AS label, round(any_value(probability), 6) AS probability FROM q JOIN b USING (cell, probability) GROUP BY cell"
)
def argmax_celltype(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("cell"), F.col("event_type").alias("label")).agg(F.sum(F.col("value").cast("decimal(20,6)")).cast("double").alias("probability"))
    return annotate.argmax_label(p).select("cell", "label", r6("probability"))


@query(
    "WITH p AS (SELECT a.vec_id AS cell, b.vec_id AS ref, b.label AS label, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2)) AS d FROM embeddings a CROSS JOIN embeddings b), "
    "k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY cell ORDER BY d, ref) <= 5), v AS (SELECT cell, label, count(*) AS votes FROM k GROUP BY ALL) "
    "SELECT cell, label, votes FROM v QUALIFY row_number() OVER (PARTITION BY cell ORDER BY votes DESC, label) = 1"
)
def label_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.table(spark, sf_dir, "embeddings")
    return annotate.nearest_label(e.withColumnRenamed("vec_id", "cell"), e.withColumnRenamed("vec_id", "ref"))


@query(
    "WITH x AS (SELECT l_suppkey AS feature, l_orderkey AS cell, ln(1 + sum(l_quantity)) AS value FROM lineitem GROUP BY ALL), n AS (SELECT count(*)::DOUBLE AS n FROM orders), "
    "s AS (SELECT feature, sum(exp(value) - 1) AS s, sum((exp(value) - 1) ** 2) AS q FROM x GROUP BY feature), t AS (SELECT feature, ln(1 + s / n) AS mean, ln(((q - n * (s / n) ** 2) / (n - 1)) / (s / n)) AS dispersion FROM s, n), "
    "b AS (SELECT *, least(19, floor((mean - min(mean) OVER ()) / ((max(mean) OVER () - min(mean) OVER ()) / 20))) AS bin FROM t), z AS (SELECT *, avg(dispersion) OVER (PARTITION BY bin) AS m, stddev_samp(dispersion) OVER (PARTITION BY bin) AS sd FROM b), "
    "sc AS (SELECT feature, mean, dispersion, CASE WHEN sd > 0 THEN (dispersion - m) / sd ELSE 1 END AS score FROM z) SELECT feature, round(mean, 6) AS mean, round(dispersion, 6) AS dispersion, round(score, 6) AS score FROM sc ORDER BY sc.score DESC, feature LIMIT 30"
)
def highly_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    expr = P.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("feature"), F.col("l_orderkey").alias("cell")).agg(F.log1p(F.sum("l_quantity")).alias("value"))
    n = P.table(spark, sf_dir, "orders").count()
    return annotate.highly_variable(expr, n, 30).select("feature", r6("mean"), r6("dispersion"), r6("score"))


@query()
def pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = annotate.principal_components(P.table(spark, sf_dir, "embeddings"), 5)
    return cells.select("vec_id", "label", F.transform("pcs", lambda x: F.round(x, 6)).alias("pcs"))


@query()
def cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.clusters(annotate.principal_components(P.table(spark, sf_dir, "embeddings"), 5), 10, 1).select("vec_id", "label", "cluster")


# Sources and sinks: what is written is read back through the library's readers


@query("SELECT l_orderkey AS cell, l_extendedprice AS x, l_quantity AS y, l_returnflag AS target FROM lineitem WHERE l_orderkey <> 0 AND l_returnflag NOT LIKE '%NegPrb%'")
def read_molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_molecules(spark, f"{sf_dir}/lineitem.parquet", {"cell": "l_orderkey", "x": "l_extendedprice", "y": "l_quantity", "target": "l_returnflag"}).select("cell", "x", "y", "target")


@query("SELECT c_custkey AS cell_ID, c_nationkey AS fov, target, n FROM (SELECT c_custkey, c_nationkey, unnest(['G1', 'G2', 'NegPrb1']) AS target, unnest([c_custkey % 3, c_nationkey % 4, 1])::DOUBLE AS n FROM customer) WHERE n <> 0 AND target NOT LIKE '%NegPrb%'")
def matrix_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cells-by-genes CSV, read as long rows without controls."""
    wide = P.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell_ID"), F.col("c_nationkey").alias("fov"), (F.col("c_custkey") % 3).alias("G1"), (F.col("c_nationkey") % 4).alias("G2"), F.lit(1).alias("NegPrb1"))
    path = place(spark, "csv")
    wide.write.csv(path, header=True)
    long = readers.read_matrix_csv(spark, path, ["fov", "cell_ID"])
    return qc.drop_controls(long).select("cell_ID", "fov", "target", "n")


@query("SELECT c_custkey AS cell_ID, c_acctbal AS array_col, c_nationkey::DOUBLE AS array_row FROM customer")
def cells_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark, "csv")
    P.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey").withColumnRenamed("c_custkey", "cell_ID").write.csv(path, header=True)
    return readers.read_cells_csv(spark, path, ["cell_ID"], "c_acctbal", "c_nationkey")


@query("SELECT p_brand AS feat_1, p_type AS feat_2 FROM part")
def pairs_from_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark, "pairs") + ".tsv"
    P.table(spark, sf_dir, "part").select("p_brand", "p_type", "p_size").write.csv(path, header=True, sep="\t")
    return readers.read_pairs(spark, path)


@query("SELECT DISTINCT unnest(string_split(replace(p_brand, '#', '_'), '_')) AS feat_1, p_name AS feat_2 FROM (SELECT p_brand, replace(p_name, '_', '-') AS p_name FROM part)")
def lr_database_from_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark, "lr") + ".csv"
    P.table(spark, sf_dir, "part").select(F.regexp_replace("p_brand", "#", "_").alias("source_genesymbol"), F.regexp_replace("p_name", "_", "-").alias("target_genesymbol"), "p_size").write.csv(path, header=True)
    return readers.read_lr_db(spark, path, "omnipath")


@query("SELECT c_mktsegment AS grp, c_custkey AS spot_id, c_acctbal AS value, 'fwhm=2.5' AS params FROM customer UNION ALL SELECT 'nation', n_nationkey, n_regionkey, 'fwhm=2.5' FROM nation")
def saved_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables and the parameters, written and read again."""
    a = P.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("grp"), F.col("c_custkey").cast("bigint").alias("spot_id"), F.col("c_acctbal").cast("double").alias("value"))
    b = P.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("spot_id"), F.col("n_regionkey").cast("double").alias("value"))
    path = place(spark, "dataset")
    sinks.save_dataset({"expr": a, "obs": b}, {"fwhm": "2.5"}, path)
    tables, params = sinks.load_dataset(spark, path, ["expr", "obs"])
    both = tables["expr"].select("grp", "spot_id", "value").unionByName(tables["obs"].withColumn("grp", F.lit("nation")))
    return both.withColumn("params", F.lit(",".join(f"{k}={v}" for k, v in params.items())))


@query(
    f"{P.MASKED} SELECT grp, spot_id, " + ", ".join(f"coalesce(max(cc_label) FILTER (WHERE feature = '{t}'), 0) AS Comb_CC_{t}" for t in P.TARGETS[:2]) + " FROM spots LEFT JOIN lab USING (grp, spot_id) GROUP BY ALL"
)
def labels_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = P.slides(spark, sf_dir)
    path = place(spark, "labels")
    sinks.save_labels_csv(components.wide_labels(P.mask_labels(spark, sf_dir, data), data.spots, P.TARGETS[:2]).select("grp", "spot_id", *[f"Comb_CC_{t}" for t in P.TARGETS[:2]]), path)
    return spark.read.csv(path, header=True, schema="grp string, spot_id string, Comb_CC_AF int, Comb_CC_AO int")


@query("SELECT 'J_result' AS name, 2 AS run, count(*) AS n FROM customer WHERE c_nationkey < 2 UNION ALL SELECT 'kept', 0, count(*) FROM nation")
def registry_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two names; after a reset by pattern a new run, and the other name as it was."""
    book = sinks.Registry(spark, place(spark, "runs"))
    c = P.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    book.save("J_old", c)
    book.save("kept", P.table(spark, sf_dir, "nation").select("n_nationkey"))
    book.reset("^J_")
    for k in range(3):
        run = book.save("J_result", c.filter(F.col("c_nationkey") < k))
    count = lambda name, run: book.latest(name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), F.lit(run).alias("run"), "n")
    return count("J_result", run).union(count("kept", 0))


@query("SELECT grp, j_comp FROM (SELECT c_mktsegment AS grp, round(avg(c_acctbal), 6) AS j_comp FROM customer GROUP BY 1)")
def results_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("grp")).agg(F.round(F.avg("c_acctbal"), 6).alias("j_comp"))
    path = place(spark, "results")
    sinks.save_results_csv(rows.withColumn("feat_1", F.lit("a")).withColumn("feat_2", F.lit("b")), path)
    return spark.read.csv(path, header=True, inferSchema=True).select("grp", "j_comp")


# Parts of the ingest and of the dataset handle


@query(
    f"{_COUNTS}, c AS (SELECT * FROM cnt WHERE target IN (SELECT target FROM cnt GROUP BY target HAVING count(DISTINCT cell) >= 3000)) SELECT * FROM c WHERE cell IN (SELECT cell FROM c GROUP BY cell HAVING sum(n) >= 3)"
)
def quality_control_genes_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.quality_control(P.counts(spark, sf_dir), 3, 3000, genes_first=True)


@query("SELECT c_mktsegment AS grp, 'bal' AS feature, round(sum(CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0 END) / count(*), 9) AS avg FROM customer GROUP BY 1")
def metadata_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of metadata features over all spots of a slide; spots without a row count as zero."""
    c = P.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("grp"), F.col("c_custkey").alias("spot_id"), F.lit("bal").alias("feature"), F.col("c_acctbal").alias("value"))
    return pair_ops.feature_average(c.filter("value > 0"), c, "obs").select("grp", "feature", r9("avg"))


@query("SELECT l_orderkey AS cell, l_returnflag AS target, l_quantity AS value, o_orderpriority AS celltype FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority < '3'")
def expression_with_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = P.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cell"), F.col("l_returnflag").alias("target"), F.col("l_quantity").alias("value"))
    cells = P.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cell"), F.col("o_orderpriority").alias("celltype")).filter("celltype < '3'")
    return grid.join_cells(values, cells)


@query("SELECT l_suppkey AS cell, l_returnflag AS feature, sum(l_linenumber)::BIGINT AS value FROM lineitem WHERE l_suppkey % 7 <> 0 GROUP BY ALL")
def bins_to_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins summed by the cell they are labelled with; every seventh label stands for none."""
    bins = P.table(spark, sf_dir, "lineitem").select(F.when(F.col("l_suppkey") % 7 != 0, F.col("l_suppkey")).alias("label"), F.col("l_returnflag").alias("feature"), F.col("l_linenumber").cast("bigint").alias("value"))
    return grid.bins_to_cells(bins)


@query(f"{W_BASE}, {P.GEXPR} SELECT s.array_col AS array_col, s.array_row AS array_row, round(coalesce(value, 0), 6) AS value FROM (SELECT * FROM spots WHERE grp = 'BUILDING') s LEFT JOIN (SELECT * FROM gx WHERE feature = 'AF' AND grp = 'BUILDING') g ON g.spot_id = s.spot_id")
def all_spots_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = P.slides(spark, sf_dir)
    spots = data.spots.filter("grp = 'BUILDING'").select("spot_id", "array_col", "array_row")
    own = data.expr.filter("grp = 'BUILDING' and feature = 'AF'").join(spots, "spot_id").select("array_col", "array_row", "value")
    return grid.with_all_spots(spots, own, "value").select("array_col", "array_row", r6("value"))


@query("SELECT 'a' AS side, c_nationkey AS feature, count(*) AS n FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier) GROUP BY ALL UNION ALL SELECT 'b', s_nationkey, count(*) FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer) GROUP BY ALL")
def shared_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = annotate.shared_features(P.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("feature")), P.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("feature")))
    count = lambda df, side: df.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), "feature", "n")
    return count(a, "a").union(count(b, "b"))


@query("SELECT '1-URGENT: ' || feat_1 AS feat_1, '5-LOW: ' || feat_2 AS feat_2 FROM (" + P.PAIRS.split(" AS (", 1)[1][:-1] + ") p(feat_1, feat_2)")
def celltype_pair_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return celltype.celltype_pairs(P.pairs(spark), "1-URGENT", "5-LOW")


_OWN = ", ".join(f"o{k} AS (SELECT grp, array_col || '_' || array_row AS spot_id, target, ln(1 + 1000 * sum(fx)) AS value FROM txc WHERE celltype = '{t}' GROUP BY ALL)" for k, t in ((1, "1-URGENT"), (5, "5-LOW")))


@query(
    f"{W_BASE}, {P.GEXPR}, txc AS (SELECT * FROM txg JOIN cells USING (cell)), {_OWN}, "
    + ", ".join(f"f{k} AS (SELECT s.grp, s.spot_id, '{t}: ' || g.target AS feature, coalesce(o{k}.value, 0) AS value FROM spots s CROSS JOIN (SELECT DISTINCT target FROM o{k}) g LEFT JOIN o{k} ON o{k}.grp = s.grp AND o{k}.spot_id = s.spot_id AND o{k}.target = g.target)" for k, t in ((1, "1-URGENT"), (5, "5-LOW")))
    + " SELECT grp, spot_id, feature, round(value, 6) AS value FROM (FROM f1 UNION ALL FROM f5)"
)
def celltype_side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrices of two cell types as one: what the analysis of a pair of types starts from."""
    data = P.slides(spark, sf_dir)
    both = celltype.side_by_side(data.celltype_specific("1-URGENT"), data.celltype_specific("5-LOW"), "1-URGENT", "5-LOW")
    return both.select("grp", "spot_id", "feature", r6("value"))


@query(f"{W_BASE}, {P.GEXPR} SELECT grp, feature, count(*) AS n, round(sum(value), 6) AS total FROM gx WHERE array_col < 8 AND grp IN ('BUILDING', 'MACHINERY') AND feature IN ('AF', 'NO') GROUP BY ALL")
def dataset_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spots by condition, groups by name, features by semi-join."""
    data = P.slides(spark, sf_dir).where(F.col("array_col") < 8)
    spots = pair_ops.check_groups(data.spots, ["BUILDING", "MACHINERY"])
    held = data.expr.join(spots.select("grp", "spot_id"), ["grp", "spot_id"], "left_semi").filter(F.col("feature").isin("AF", "NO"))
    return held.groupBy("grp", "feature").agg(F.count(F.lit(1)).alias("n"), r6_sum("value").alias("total"))


def r6_sum(column: str):
    return F.round(F.sum(column), 6)


@query(
    f"{W_BASE}, ok AS (SELECT * FROM txg WHERE array_col >= 0), ab AS (SELECT array_col || '_' || array_row AS spot_id, celltype AS feature, sum(fx) AS value, 'obs' AS kind FROM ok JOIN cells USING (cell) GROUP BY ALL), "
    "ge AS (SELECT array_col || '_' || array_row AS spot_id, target AS feature, ln(1 + 1000 * sum(fx)) AS value, 'expr' AS kind FROM ok JOIN cells USING (cell) GROUP BY ALL) SELECT kind, feature, spot_id, round(value, 6) AS value FROM (FROM ge UNION ALL FROM ab)"
)
def dataset_from_molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ingest of molecules as a whole: shares by cell, annotation, matrix and abundances."""
    data = from_molecules(P.molecules(spark, sf_dir), P.cells(spark, sf_dir), P.PARAMS, qc_cells=False)
    both = data.expr.withColumn("kind", F.lit("expr")).unionByName(data.obs.withColumn("kind", F.lit("obs")))
    return both.select("kind", "feature", "spot_id", r6("value"))


@query(f"{_CELL}, {P.CELLS} SELECT 'expr' AS kind, target AS feature, array_col || '_' || array_row AS spot_id, round(ln(1 + sum(e)), 6) AS value FROM cn JOIN cb USING (cell) JOIN cells USING (cell) GROUP BY ALL "
    "UNION ALL SELECT 'obs', celltype, array_col || '_' || array_row, count(DISTINCT cell)::DOUBLE FROM cn JOIN cb USING (cell) JOIN cells USING (cell) GROUP BY ALL")  # fmt: skip
def dataset_from_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ingest of cells as a whole. Bins span all cells, so cells are binned before those without a type go."""
    data = from_cells(_cell_grid(spark, sf_dir).drop("array_col", "array_row"), P.PARAMS)
    both = data.expr.withColumn("kind", F.lit("expr")).unionByName(data.obs.withColumn("kind", F.lit("obs")))
    return both.select("kind", "feature", "spot_id", r6("value"))


@query(
    f"{P.MASKED} SELECT s.grp AS grp, s.spot_id AS spot_id, array_col, array_row, ((x.spot_id IS NOT NULL)::INT + 2 * (y.spot_id IS NOT NULL)::INT) AS category FROM spots s "
    "LEFT JOIN (SELECT * FROM lab WHERE feature = 'AF') x USING (grp, spot_id) LEFT JOIN (SELECT * FROM lab WHERE feature = 'RO') y USING (grp, spot_id)"
)
def plot_components_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = P.slides(spark, sf_dir)
    return plotdata.all_components_map(data.spots, P.mask_labels(spark, sf_dir, data), "AF", "RO")


# Stream


@query(
    "WITH m AS (SELECT user_id AS cell, epoch(ts)::DOUBLE AS x, value AS y, event_type AS target FROM events) "
    f"SELECT cell, {P.sql_bin('x', '1.6e9', '1.8e9', '20')} AS array_col, {P.sql_bin('y', '0.0', '1000.0', '20')} AS array_row, target, count(*) AS count FROM m GROUP BY ALL"
)
def streaming_grid_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same expressions as the stream, on a table; a test drains a stream through them."""
    m = P.table(spark, sf_dir, "events").select(F.col("user_id").alias("cell"), P.seconds("ts").alias("x"), F.col("value").alias("y"), F.col("event_type").alias("target"))
    return stream_counts.grid_counts(m, (1.6e9, 1.8e9, 0.0, 1000.0), 20, 20)
