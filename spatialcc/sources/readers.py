"""Sources (OP-S01..S13). Everything is read by Spark's own readers, so any file system it knows will do."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Platform rules for molecule tables: value of "outside any cell", flag column, control marks.
PLATFORMS = {
    "cosmx": {"outside": 0, "gene_flag": None, "controls": ("NegPrb",)},
    "xenium": {"outside": "UNASSIGNED", "gene_flag": "is_gene", "controls": ()},
    "merfish": {"outside": 0, "gene_flag": None, "controls": ("Blank-",)},
}
#: Columns that pair each ligand-receptor database's rows come in.
LR_COLUMNS = {
    "celltalk": ("lr_pair", "ligand_gene_symbol", "receptor_gene_symbol"),
    "cellchat": ("interaction_name_2",),
    "omnipath": ("source_genesymbol", "target_genesymbol"),
}


def read_matrix_csv(spark: SparkSession, path: str, ids: list[str], value: str = "n") -> DataFrame:
    """A cells-by-genes CSV as long rows (ids, target, value); zeros are left out (OP-S03)."""
    wide = spark.read.csv(path, header=True, inferSchema=True)
    genes = [c for c in wide.columns if c not in ids]
    quoted = [F.col(f"`{g}`").cast("double").alias(g) for g in genes]
    return wide.select(*ids, *quoted).unpivot(ids, [f"`{g}`" for g in genes], "target", value).filter(F.col(value) != 0)


def read_cells_csv(spark: SparkSession, path: str, ids: list[str], x: str, y: str) -> DataFrame:
    """Cell metadata with the coordinates renamed (OP-S04)."""
    return spark.read.csv(path, header=True, inferSchema=True).select(*ids, F.col(x).cast("double").alias("array_col"), F.col(y).cast("double").alias("array_row"))


def read_molecules(spark: SparkSession, path: str, columns: dict[str, str], platform: str = "cosmx") -> DataFrame:
    """Molecules (cell, x, y, target) from CSV or Parquet (OP-S06, S07), controls and unassigned ones left out.

    columns maps cell, x, y and target to the file's names. On Parquet only these columns are read.
    """
    from spatialcc.operators.qc import drop_controls, drop_unassigned

    if platform not in PLATFORMS:
        raise ValueError(f"platform must be one of {sorted(PLATFORMS)}")
    rules = PLATFORMS[platform]
    raw = spark.read.csv(path, header=True, inferSchema=True) if path.endswith((".csv", ".csv.gz")) else spark.read.parquet(path)
    raw = drop_unassigned(raw, columns["cell"], rules["outside"], rules["gene_flag"])
    picked = raw.select(*[F.col(columns[k]).alias(k) for k in ("cell", "x", "y", "target")])
    return drop_controls(picked, rules["controls"])


def read_matrix_market(spark: SparkSession, matrix: str, features: str, barcodes: str) -> DataFrame:
    """A MatrixMarket triple of files (features by barcodes) as long rows (spot_id, feature, value) (OP-S02, S05)."""
    numbered = lambda path, column: (
        spark.read.text(path).select(F.split("value", "\t").alias("v"), F.monotonically_increasing_id().alias("i"))
        .select(F.get("v", F.lit(0)).alias(column), "i")
    )
    index = lambda df, column: df.select(column, F.row_number().over(W.orderBy("i")).alias("pos"))
    f, b = index(numbered(features, "feature"), "feature"), index(numbered(barcodes, "spot_id"), "spot_id")
    entries = spark.read.text(matrix).filter(~F.col("value").startswith("%")).select(F.split(F.trim("value"), r"\s+").alias("v"))
    entries = entries.select(*[F.get("v", F.lit(i)).cast("double").alias(c) for i, c in enumerate("rcv")], F.monotonically_increasing_id().alias("line"))
    size = entries.agg(F.min("line").alias("line"))  # the first line that isn't a comment gives the sizes
    entries = entries.join(F.broadcast(size), "line", "left_anti")
    named = entries.join(f, entries["r"].cast("int") == f["pos"]).drop("pos").join(b, F.col("c").cast("int") == b["pos"])
    return named.select("spot_id", "feature", F.col("v").alias("value"))


def read_visium(spark: SparkSession, directory: str, group: str = "0") -> tuple[DataFrame, DataFrame]:
    """Spots under tissue and the long matrix of a spot-array directory (OP-S02), with MatrixMarket files."""
    places = spark.read.csv(f"{directory}/spatial/tissue_positions_list.csv", schema="spot_id string, in_tissue int, array_row int, array_col int, px_row double, px_col double")
    spots = places.filter("in_tissue = 1").select(F.lit(group).alias("grp"), "spot_id", "array_col", "array_row")
    m = f"{directory}/filtered_feature_bc_matrix"
    expr = read_matrix_market(spark, f"{m}/matrix.mtx", f"{m}/features.tsv", f"{m}/barcodes.tsv").withColumn("grp", F.lit(group))
    return spots, expr.join(spots.select("spot_id"), "spot_id", "left_semi")


def read_hd_bins(spark: SparkSession, path: str) -> DataFrame:
    """Binned high-resolution data in Parquet (OP-S08); the path must name one of the three bin sizes."""
    if not re.search(r"(002|008|016)um", path):
        raise ValueError("the path must contain one of 002um, 008um, 016um")
    return spark.read.parquet(path)


def read_lr_db(spark: SparkSession, path: str, name: str, species: str = "human") -> DataFrame:
    """Ligand-receptor pairs of a database file, cleaned (OP-S09, P17..P19)."""
    from spatialcc.operators.pairs import lr_cellchat, lr_celltalk, lr_omnipath

    if species not in ("human", "mouse", "rat"):
        raise ValueError("species must be human, mouse or rat")
    if name not in LR_COLUMNS:
        raise ValueError(f"the database must be one of {sorted(LR_COLUMNS)}")
    if species == "rat" and name != "omnipath":
        raise ValueError("rat pairs are only in omnipath")
    db = spark.read.csv(path, header=True, sep="\t" if name == "celltalk" else ",").select(*LR_COLUMNS[name])
    return {"celltalk": lr_celltalk, "cellchat": lr_cellchat, "omnipath": lr_omnipath}[name](db)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Feature pairs: the first two columns of a csv, tsv or txt file (OP-S11)."""
    raw = spark.read.csv(path, header=True, sep="," if path.endswith(".csv") else "\t")
    if len(raw.columns) < 2:
        raise ValueError("feature pairs need two columns")
    return raw.select(F.col(raw.columns[0]).alias("feat_1"), F.col(raw.columns[1]).alias("feat_2"))


def union_slides(slides: dict[str, DataFrame]) -> DataFrame:
    """Tables of several slides as one, with the slide's name as grp (OP-S12, U01)."""
    out = None
    for name, df in slides.items():
        named = df.withColumn("grp", F.lit(name))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    if out is None:
        raise ValueError("no slides")
    return out
