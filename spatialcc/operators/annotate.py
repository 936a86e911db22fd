"""Annotation of cells: variable genes, PCA, clustering, label transfer (OP-M02..M09, J05, J19, W04).

Label transfer and clustering stand in for third-party packages; their labels are not those packages' labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_features(a: DataFrame, b: DataFrame, feature: str = "feature") -> tuple[DataFrame, DataFrame]:
    """Both tables with only the features of the other, too (OP-J05)."""
    names = a.select(feature).intersect(b.select(feature))
    return a.join(names, feature, "left_semi"), b.join(names, feature, "left_semi")


def highly_variable(expr: DataFrame, n_cells: int, n_top: int, n_bins: int = 20, feature: str = "feature", value: str = "value") -> DataFrame:
    """Features by normalised dispersion within bins of mean expression (OP-M03): feature, mean, dispersion, score, rank.

    Moments are of expm1 values with absent cells as zero; dispersion is the log of variance over mean, bins are of
    equal width in log1p of the mean, and a bin with one feature scores 1.
    """
    v = F.expm1(value)
    s = expr.groupBy(feature).agg(F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    n = float(n_cells)
    mean = F.col("s") / n
    var = (F.col("q") - n * mean * mean) / (n - 1)
    stats = s.select(feature, F.log1p(mean).alias("mean"), F.when((mean > 0) & (var > 0), F.log(var / mean)).alias("dispersion")).filter("dispersion is not null")
    span = stats.agg(F.min("mean").alias("lo"), F.max("mean").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / n_bins
    binned = stats.crossJoin(F.broadcast(span)).withColumn("bin", F.when(width > 0, F.least(F.lit(n_bins - 1), F.floor((F.col("mean") - F.col("lo")) / width))).otherwise(0))
    by = binned.groupBy("bin").agg(F.avg("dispersion").alias("_m"), F.stddev_samp("dispersion").alias("_sd"))
    scored = binned.join(F.broadcast(by), "bin").withColumn("score", F.when(F.col("_sd") > 0, (F.col("dispersion") - F.col("_m")) / F.col("_sd")).otherwise(1.0))
    ranked = scored.orderBy(F.desc("score"), feature).limit(n_top)
    return ranked.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), feature))).select(feature, "mean", "dispersion", "score", "rank")


def principal_components(cells: DataFrame, k: int, vector: str = "embedding") -> DataFrame:
    """Cells with the first k principal components as an array 'pcs' (OP-M04); signs are fixed by the largest loading.

    The covariance is aggregated over the executors; only a matrix of features by features is held at once.
    """
    held = cells.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    model = PCA(k=k, inputCol="_v", outputCol="_pcs").fit(held)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, j]).argmax(), j] >= 0 else -1.0 for j in range(k)]
    out = model.transform(held).withColumn("pcs", vector_to_array("_pcs"))
    return out.withColumn("pcs", F.zip_with("pcs", F.array(*[F.lit(s) for s in signs]), lambda a, s: a * s)).drop("_v", "_pcs")


def clusters(cells: DataFrame, k: int, seed: int = 0, vector: str = "pcs") -> DataFrame:
    """Cells with a cluster number (OP-M06, by k-means)."""
    held = cells.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(held).transform(held).drop("_v")


def centroids(reference: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """(label, centroid) of a reference, by aggregation of each dimension."""
    dims = reference.select(label, F.posexplode(F.col(vector).cast("array<double>")).alias("i", "v")).groupBy(label, "i").agg(F.avg("v").alias("v"))
    return dims.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("centroid"))


def label_probabilities(cells: DataFrame, reference: DataFrame, cell: str = "cell", label: str = "label", vector: str = "embedding", sharpness: float = 1.0) -> DataFrame:
    """(cell, label, probability): softmax of minus the squared distance to each label's centroid (OP-M08).

    The join is with one row per label.
    """
    both = cells.select(cell, F.col(vector).cast("array<double>").alias("v")).crossJoin(centroids(reference, label, vector))
    d = F.aggregate(F.zip_with("v", "centroid", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    near = both.select(cell, label, d.alias("d"))
    least = F.min("d").over(W.partitionBy(cell))
    weight = near.withColumn("w", F.exp(-F.lit(sharpness) * (F.col("d") - least)))
    return weight.select(cell, label, (F.col("w") / F.sum("w").over(W.partitionBy(cell))).alias("probability"))


def argmax_label(probabilities: DataFrame, cell: str = "cell", label: str = "label") -> DataFrame:
    """The most probable label of each cell, the first one of equals (OP-W04)."""
    best = probabilities.groupBy(cell).agg(F.max(F.col("probability")).alias("probability"))
    return probabilities.join(best, [cell, "probability"]).groupBy(cell).agg(F.min(label).alias(label), F.first("probability").alias("probability"))


#: Rows of a block of cells and of a block of the reference, at most, and numbers in it.
BLOCK, NUMBERS = 8192, 2_000_000
#: Cells of a block whose distances to a block of the reference are held at once.
ROWS = 128


def _vectors(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray | None]:
    """A matrix of the vectors as doubles, and which of its numbers are there; None if all are."""
    lists = column.combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten()
    if len(lists) and not lists.null_count and not flat.null_count and (sizes == sizes[0]).all():
        return flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), sizes[0]), None
    rows = [x or [] for x in lists.to_pylist()]
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    there = np.zeros(out.shape, bool)
    for row, mask, held in zip(out, there, rows, strict=True):
        row[: len(held)] = [0.0 if x is None else x for x in held]
        mask[: len(held)] = [x is not None for x in held]
    return out, there


def nearest_of_block(a: np.ndarray, b: np.ndarray, k: int, has_a: np.ndarray | None = None, has_b: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, squared distance, whether it has none) of the k nearest rows of b for each row of a, the first ones of equals.

    A matrix product tells which rows can be among the nearest; their distances are then summed number by number, as SQL
    does. Numbers that either side lacks (has_a, has_b) are left out; NaN, and then rows that share no number, come last.
    """
    dims, k = max(a.shape[1], b.shape[1]), min(k, len(b))
    has_a, has_b = (np.ones(m.shape, bool) if has is None else has for m, has in ((a, has_a), (b, has_b)))
    a, b, has_a, has_b = (np.pad(m, ((0, 0), (0, dims - m.shape[1]))) for m in (a, b, has_a, has_b))
    whole_a, whole_b = (np.where(np.abs(m) < 1e150, m, 0.0) for m in (a, b))
    odd_a, odd_b = (~(has & (np.abs(m) < 1e150)).all(axis=1) | (dims == 0) for m, has in ((a, has_a), (b, has_b)))
    columns, has_columns, by_b = np.ascontiguousarray(b.T), np.ascontiguousarray(has_b.T), whole_b.T
    norm_a, norm_b = (whole_a**2).sum(axis=1), (whole_b**2).sum(axis=1)
    found: list[tuple[np.ndarray, ...]] = []
    for lo in range(0, len(a), ROWS):
        part = slice(lo, lo + ROWS)
        rough = norm_a[part, None] + norm_b - 2 * (whole_a[part] @ by_b)
        rough[:, odd_b] = np.inf
        # Twice the largest error that both ways of summing can have together.
        slack = 8 * (dims + 4) * np.finfo(float).eps * (norm_a[part] + norm_b.max(initial=0.0)) + 1e-300
        most = np.partition(rough, k - 1, axis=1)[:, k - 1] + 2 * slack if k else np.zeros(len(rough))
        i, j = np.nonzero((rough <= most[:, None]) | odd_a[part, None] | odd_b)
        rows, has_rows, d, none = np.ascontiguousarray(a[part].T), np.ascontiguousarray(has_a[part].T), np.zeros(len(i)), np.zeros(len(i), bool)
        odd = odd_a[part].any() or odd_b.any()
        none |= odd
        with np.errstate(over="ignore", invalid="ignore"):
            for n in range(dims):
                gap = rows[n][i] - columns[n][j]
                if odd:
                    there = has_rows[n][i] & has_columns[n][j]
                    none &= ~there
                    gap = np.where(there, gap, 0.0)
                d += gap * gap
        order = np.lexsort((j, d, none, i))  # NaN is last of the numbers
        i, j, d, none = i[order], j[order], d[order], none[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        found.append((i[first] + lo, j[first], d[first], none[first]))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def nearest_label(cells: DataFrame, reference: DataFrame, k: int = 5, cell: str = "cell", ref: str = "ref", label: str = "label", vector: str = "embedding") -> DataFrame:
    """Majority label of the k nearest reference rows (OP-M05, M07), the smallest label of equals.

    Blocks of the cells meet blocks of the reference: a cell keeps k rows of each block and then k of all, so no task
    holds more than two blocks, whatever the tables' sizes.
    """
    spark = cells.sparkSession
    held = reference.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size(vector)), F.lit(1)).alias("dims")).first()
    rows = max(1, min(BLOCK, NUMBERS // max(1, held.dims)))
    n_refs, n_cells = max(1, -(-held.n // rows)), max(1, -(-cells.count() // rows))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    part = lambda key, n: F.pmod(F.xxhash64(F.col(key), F.col(vector)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = cells.select(F.col(cell).alias("cell"), F.col(vector).alias("v"), part(cell, n_cells).alias("_a"), every(n_refs).alias("_b")).repartition(tasks, "_a", "_b")
    right = reference.select(F.col(ref).alias("ref"), F.col(label).alias("label"), F.col(vector).alias("v"), part(ref, n_refs).alias("_b"), every(n_cells).alias("_a")).repartition(tasks, "_a", "_b")

    def near(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by("ref")
        (va, has_a), (vb, has_b) = _vectors(a["v"]), _vectors(b["v"])
        i, j, d, none = nearest_of_block(va, vb, k, has_a, has_b)
        return pa.table({"cell": a["cell"].take(pa.array(i)), "d": pa.array(d, pa.float64(), none, from_pandas=False), "ref": b["ref"].take(pa.array(j)), "label": b["label"].take(pa.array(j))})

    kinds = dict(left.dtypes) | {c: t for c, t in right.dtypes if c in ("ref", "label")}
    pairs = left.groupBy("_a", "_b").cogroup(right.groupBy("_a", "_b")).applyInArrow(near, f"cell {kinds['cell']}, d double, ref {kinds['ref']}, label {kinds['label']}")
    kept = pairs.groupBy("cell").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.isnull("d").alias("none"), "d", F.isnull("ref").alias("last"), "ref", "label"))), 1, k).alias("near"))
    votes = kept.select(F.col("cell").alias(cell), F.explode("near").alias("x")).groupBy(cell, F.col("x.label").alias("_label")).agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy(cell).agg(F.min(F.struct((-F.col("votes")).alias("n"), F.isnull("_label").alias("last"), F.col("_label").alias("label"))).alias("best"))
    return best.select(cell, F.col("best.label").alias(label), (-F.col("best.n")).alias("votes"))


def annotate(cells: DataFrame, reference: DataFrame, return_prob: bool = False, **names: str) -> DataFrame:
    """Cell types of cells from a reference: probabilities, or the most probable one (OP-M09, J19)."""
    p = label_probabilities(cells, reference, **names)
    return p if return_prob else argmax_label(p, names.get("cell", "cell"), names.get("label", "label"))
