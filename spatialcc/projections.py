"""The driver's tables in the roles of the spatial data model, and the same projections as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spatialcc.operators import grid
from spatialcc.operators.smooth import kernel_1d, smooth_grid
from spatialcc.plans.dataset import Params, SpatialDataset
from spatialcc.plans.landing import land

#: Bins of each axis, and the parameters of the registered queries.
BINS = 20
PARAMS = Params(min_size=5, fwhm=2.5, thres_per=30, x_bins=BINS, y_bins=BINS, min_counts=3, min_cells=3)
TARGETS = ["AF", "AO", "NF", "NO", "RF", "RO"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(column: str):
    """Seconds since 1970 of a timestamp as it is written, whatever the session's zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({column} AS TIMESTAMP_NTZ))").cast("double")


def molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as molecules: cell, x, y, target."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("cell"), F.col("l_extendedprice").alias("x"), seconds("l_shipdate").alias("y"), F.concat("l_returnflag", "l_linestatus").alias("target")
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as annotated cells: cell, celltype, and the customer's segment as grp."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cell"), "o_custkey", F.col("o_orderpriority").alias("celltype"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("grp"))
    return orders.join(customers, "o_custkey").select("cell", "celltype", "grp")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Molecules per cell and target: cell, target, n."""
    return molecules(spark, sf_dir).groupBy("cell", "target").agg(F.count(F.lit(1)).alias("n"))


def tx_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.tx_by_cell_grid(grid.grid_bin(molecules(spark, sf_dir), BINS, BINS))


def slides(spark: SparkSession, sf_dir: str) -> SpatialDataset:
    """The molecules of each customer segment as a slide, on one grid, with cell-type abundances as metadata."""
    by_cell = land(tx_grid(spark, sf_dir).join(cells(spark, sf_dir), "cell"), "by_cell")
    spot = grid.grid_spot_id().alias("spot_id")
    spots = by_cell.select("grp", spot, "array_col", "array_row").distinct()
    expr = grid.grid_matrix(by_cell, keys=("grp",)).select("grp", spot, F.col("target").alias("feature"), "value")
    obs = by_cell.groupBy("grp", "array_col", "array_row", "celltype").agg(F.sum("tx_fx_by_grid").alias("value"))
    obs = obs.select("grp", spot, F.col("celltype").alias("feature"), "value")
    return SpatialDataset(spots, expr, PARAMS, obs, by_cell).kept()


def pairs(spark: SparkSession) -> DataFrame:
    """All pairs of the six targets."""
    return spark.createDataFrame([(a, b) for i, a in enumerate(TARGETS) for b in TARGETS[i + 1 :]], "feat_1 string, feat_2 string")


def smoothed(spark: SparkSession, sf_dir: str, data: SpatialDataset | None = None) -> DataFrame:
    data = data or slides(spark, sf_dir)
    places = data.spots.select("grp", "spot_id", "array_col", "array_row")
    return land(smooth_grid(data.expr.join(places, ["grp", "spot_id"]), places, PARAMS.fwhm), "smoothed")


def mask_labels(spark: SparkSession, sf_dir: str, data: SpatialDataset | None = None) -> DataFrame:
    """Components that SQL can state: spots whose smoothed value is above the mean, labelled by bands of five columns."""
    from pyspark.sql import Window as W

    s = smoothed(spark, sf_dir, data)
    above = s.withColumn("mean", F.avg("smoothed").over(W.partitionBy("grp", "feature"))).filter("smoothed > mean")
    return above.select("grp", "feature", "spot_id", (F.floor(F.col("array_col") / 5) + 1).cast("int").alias("cc_label"))


def hex_spots(spark: SparkSession, sf_dir: str, width: int = 20) -> DataFrame:
    """part as spots on a hexagonal lattice: row = k div width, column = 2 * (k mod width) + row mod 2."""
    k = F.col("p_partkey")
    row = F.floor(k / width)
    spots = table(spark, sf_dir, "part")
    spots = spots.select(F.lit("0").alias("grp"), F.col("p_partkey").cast("string").alias("spot_id"), (2 * (k % width) + row % 2).cast("int").alias("array_col"), row.cast("int").alias("array_row"), F.col("p_size").cast("double").alias("value"))
    return spots.withColumn("x", F.col("array_col") * 0.5).withColumn("y", F.col("array_row") * (F.sqrt(F.lit(3.0)) / 2))


# The same as common table expressions.


def sql_bin(v: str, lo: str, hi: str, bins: str) -> str:
    return f"(CASE WHEN {hi} > {lo} THEN least({bins} - 1, greatest(0, floor(({v} - {lo}) / (({hi} - {lo}) / {bins})))) ELSE 0 END)::INT"


MOL = "mol AS (SELECT l_orderkey AS cell, l_extendedprice AS x, epoch(l_shipdate)::DOUBLE AS y, l_returnflag || l_linestatus AS target FROM lineitem)"
EXT = "ext AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM mol)"
BINNED = f"binned AS (SELECT cell, x, y, target, {sql_bin('x', 'x0', 'x1', str(BINS))} AS array_col, {sql_bin('y', 'y0', 'y1', str(BINS))} AS array_row FROM mol, ext)"
TXG = "txg AS (SELECT cell, array_col, array_row, target, count(*) AS count, count(*) / sum(count(*)) OVER (PARTITION BY cell) AS fx FROM binned GROUP BY cell, array_col, array_row, target)"
CELLS = "cells AS (SELECT o_orderkey AS cell, o_orderpriority AS celltype, c_mktsegment AS grp FROM orders JOIN customer ON c_custkey = o_custkey)"
BASE = f"{MOL}, {EXT}, {BINNED}, {TXG}, {CELLS}"
GEXPR = (
    "gx AS (SELECT grp, array_col || '_' || array_row AS spot_id, array_col, array_row, target AS feature, ln(1 + 1000 * sum(fx)) AS value FROM txg JOIN cells USING (cell) GROUP BY ALL), "
    "spots AS (SELECT DISTINCT grp, spot_id, array_col, array_row FROM gx)"
)
_KERNEL = ", ".join(f"({i - len(kernel_1d(2.5)) // 2}, {w!r}::DOUBLE)" for i, w in enumerate(kernel_1d(2.5)))
SMOOTH = f"""
cr AS (SELECT grp, array_col, row_number() OVER (PARTITION BY grp ORDER BY array_col) - 1 AS c FROM (SELECT DISTINCT grp, array_col FROM spots)),
rr AS (SELECT grp, array_row, row_number() OVER (PARTITION BY grp ORDER BY array_row) - 1 AS r FROM (SELECT DISTINCT grp, array_row FROM spots)),
dims AS (SELECT grp, max(c) AS nc, (SELECT max(r) FROM rr WHERE rr.grp = cr.grp) AS nr FROM cr GROUP BY grp),
k(o, w) AS (VALUES {_KERNEL}),
scat AS (SELECT grp, feature, c + k1.o AS c, r + k2.o AS r, sum(value * k1.w * k2.w) AS s
  FROM gx JOIN cr USING (grp, array_col) JOIN rr USING (grp, array_row) JOIN dims USING (grp), k k1, k k2
  WHERE c + k1.o BETWEEN 0 AND nc AND r + k2.o BETWEEN 0 AND nr GROUP BY ALL),
tot AS (SELECT grp, feature, sum(value) AS total FROM gx GROUP BY ALL),
sm AS (SELECT grp, feature, spot_id, array_col, array_row, s / sum(s) OVER (PARTITION BY grp, feature) * total AS smoothed, c, r
  FROM scat JOIN tot USING (grp, feature) LEFT JOIN (SELECT * FROM spots JOIN cr USING (grp, array_col) JOIN rr USING (grp, array_row)) USING (grp, c, r)),
smoothed AS (SELECT grp, feature, spot_id, array_col, array_row, smoothed FROM sm WHERE spot_id IS NOT NULL)"""
LABELS = "lab AS (SELECT grp, feature, spot_id, (array_col // 5 + 1)::INT AS cc_label FROM (SELECT *, avg(smoothed) OVER (PARTITION BY grp, feature) AS mean FROM smoothed) WHERE smoothed > mean)"
# The merge tree of every feature, from what each spot reaches through spots that are not below it. The comp of a spot is
# what it reaches; a comp with one comp directly inside continues that one's node, any other starts a node.
TREE = """
tm AS (SELECT grp, feature, spot_id, array_col * 100 + array_row AS id, round(smoothed, 10) AS v FROM smoothed WHERE round(smoothed, 10) > 0),
te AS (SELECT a.grp, a.feature, a.id AS a, b.id AS b, b.v AS vb FROM tm a JOIN tm b ON a.grp = b.grp AND a.feature = b.feature
  AND (b.id = a.id + 1 OR b.id = a.id - 1 OR b.id = a.id + 100 OR b.id = a.id - 100)),
reach(grp, feature, src, lvl, id) AS (SELECT grp, feature, id, v, id FROM tm UNION SELECT r.grp, r.feature, r.src, r.lvl, te.b FROM reach r JOIN te ON te.grp = r.grp AND te.feature = r.feature AND te.a = r.id AND te.vb >= r.lvl),
named AS (SELECT grp, feature, src, lvl, min(id) AS nm, count(*) AS size FROM reach GROUP BY ALL),
comps AS (SELECT grp, feature, lvl, nm, size, min(src) AS rep FROM named GROUP BY ALL),
holds AS (SELECT c.grp, c.feature, c.rep, c.lvl, c.size, r.id FROM comps c JOIN reach r ON r.grp = c.grp AND r.feature = c.feature AND r.src = c.rep),
above AS (SELECT c.grp, c.feature, c.rep AS child, arg_max(h.rep, h.lvl) AS up FROM comps c JOIN holds h ON h.grp = c.grp AND h.feature = c.feature AND h.id = c.rep AND h.lvl < c.lvl GROUP BY ALL),
kids AS (SELECT c.grp, c.feature, c.rep, c.lvl, c.size, count(a.child) AS n FROM comps c LEFT JOIN above a ON a.grp = c.grp AND a.feature = c.feature AND a.up = c.rep GROUP BY ALL),
starts AS (SELECT * FROM kids WHERE n <> 1),
ends AS (SELECT s.grp, s.feature, s.rep, s.lvl AS birth, s.n, coalesce(max(h.lvl) FILTER (WHERE k.n > 1), 0) AS death FROM starts s
  LEFT JOIN holds h ON h.grp = s.grp AND h.feature = s.feature AND h.id = s.rep AND h.lvl < s.lvl LEFT JOIN kids k ON k.grp = h.grp AND k.feature = h.feature AND k.rep = h.rep GROUP BY ALL),
nodes AS (SELECT e.grp, e.feature, e.rep, e.birth, e.death, e.n, arg_max(h.rep, h.size) AS top, max(h.size) AS size FROM ends e
  JOIN holds h ON h.grp = e.grp AND h.feature = e.feature AND h.id = e.rep AND h.lvl <= e.birth AND h.lvl > e.death GROUP BY ALL)"""
# The components that pruning at a least size leaves. Node 0, the first to be born, never starts a removal: a small one
# stays where it is a root, or no other of its siblings is small, or two of them aren't. Of the nodes that stay and have no
# such child each grows down to the first node with two such children. Components are named by a spot of theirs.
def sql_leaves(least: int) -> str:
    return f"""
up AS (SELECT n.grp, n.feature, n.rep, p.rep AS up FROM nodes n JOIN nodes p ON p.grp = n.grp AND p.feature = n.feature AND p.birth = n.death AND p.n > 1
  JOIN holds h ON h.grp = n.grp AND h.feature = n.feature AND h.rep = p.rep AND h.id = n.rep),
kin AS (SELECT grp, feature, up, count(*) FILTER (WHERE size < {least}) AS small, count(*) FILTER (WHERE size >= {least}) AS big FROM up JOIN nodes USING (grp, feature, rep) GROUP BY ALL),
zero AS (SELECT grp, feature, arg_max(rep, birth) AS rep, true AS is_zero FROM nodes GROUP BY ALL),
stay AS (SELECT n.*, up.up FROM nodes n LEFT JOIN up USING (grp, feature, rep) LEFT JOIN kin ON kin.grp = n.grp AND kin.feature = n.feature AND kin.up = up.up LEFT JOIN zero USING (grp, feature, rep)
  WHERE n.size >= {least} OR (is_zero AND (up.up IS NULL OR kin.small = 1 OR kin.big >= 2))),
forks AS (SELECT s.grp, s.feature, n.rep, n.birth FROM stay s JOIN nodes n ON n.grp = s.grp AND n.feature = s.feature AND n.rep = s.up GROUP BY ALL HAVING count(*) > 1),
tips AS (SELECT s.grp, s.feature, s.rep, s.birth FROM stay s WHERE NOT EXISTS (SELECT 1 FROM stay t WHERE t.grp = s.grp AND t.feature = s.feature AND t.up = s.rep)),
stops AS (SELECT t.grp, t.feature, t.rep, t.birth, coalesce(max(f.birth), 0) AS stop FROM tips t
  LEFT JOIN (SELECT f.*, h.id FROM forks f JOIN holds h ON h.grp = f.grp AND h.feature = f.feature AND h.rep = f.rep) f ON f.grp = t.grp AND f.feature = t.feature AND f.id = t.rep GROUP BY ALL),
tops AS (SELECT t.grp, t.feature, t.rep AS cc, arg_max(h.rep, h.size) AS top FROM stops t JOIN holds h ON h.grp = t.grp AND h.feature = t.feature AND h.id = t.rep AND h.lvl > t.stop AND h.lvl <= t.birth GROUP BY ALL),
leaf AS (SELECT t.grp, t.feature, t.cc, h.id, tm.spot_id FROM tops t JOIN holds h ON h.grp = t.grp AND h.feature = t.feature AND h.rep = t.top JOIN tm ON tm.grp = t.grp AND tm.feature = t.feature AND tm.id = h.id),
lin AS (SELECT l.grp, l.feature, cc, sum(smoothed) AS s, count(*) AS k FROM leaf l JOIN smoothed USING (grp, feature, spot_id) GROUP BY ALL),
lout AS (SELECT grp, feature, -1 AS cc, (SELECT sum(smoothed) FROM smoothed x WHERE x.grp = t.grp AND x.feature = t.feature) - s AS s, (SELECT count(*) FROM spots WHERE spots.grp = t.grp) - k AS k
  FROM (SELECT grp, feature, sum(s) AS s, sum(k) AS k FROM lin GROUP BY ALL) t),
lrank AS (SELECT *, row_number() OVER (PARTITION BY grp, feature ORDER BY s / k DESC) AS pos, count(*) OVER (PARTITION BY grp, feature) AS m FROM (FROM lin UNION ALL FROM lout) WHERE k > 0),
cclab AS (SELECT leaf.* FROM leaf JOIN lrank USING (grp, feature, cc) WHERE cc >= 0 AND pos <= floor(m * 0.7))"""


PAIRS = "pairs(feat_1, feat_2) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for i, a in enumerate(TARGETS) for b in TARGETS[i + 1 :]) + ")"
MASKED = f"WITH {BASE}, {GEXPR}, {SMOOTH}, {LABELS}, {PAIRS}"
HEX = (
    "hx AS (SELECT p_partkey::VARCHAR AS spot_id, (2 * (p_partkey % 20) + (p_partkey // 20) % 2)::INT AS array_col, (p_partkey // 20)::INT AS array_row, p_size::DOUBLE AS value FROM part), "
    "hp AS (SELECT *, array_col * 0.5 AS x, array_row * (sqrt(3.0) / 2) AS y FROM hx), "
    "near AS (SELECT a.spot_id AS src, b.spot_id AS dst, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 4) AS d FROM hp a, hp b WHERE round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 4) <= 2.5)"
)
