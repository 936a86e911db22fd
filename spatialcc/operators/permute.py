"""Permutation test of composite Jaccard (OP-T19, T20, A13, J06, J07, J15).

A permutation follows from seed, group and number alone, so permuted values are made where they are used and never
written or shuffled: tasks get whole features with a range of numbers, return the footprints of components as bits, and
pairs of footprints give the draws.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spatialcc.functions.scalars import PLATEAU_DECIMALS
from spatialcc.operators import tree
from spatialcc.plans.landing import land

#: Permutations of one task, at most, and bits of footprints that it returns at once, at most.
BLOCK, BITS = 50, 64_000_000


def permutation(seed: int, grp: object, number: int, n: int) -> np.ndarray:
    """From which place each of n places gets its value; the places are a group's spots by column, row and id (OP-T20).

    The generator is keyed by seed, group and number; draws differ from those of a sequential generator.
    """
    key = int.from_bytes(hashlib.blake2b(f"{seed}|{grp}".encode(), digest_size=8).digest(), "little")
    return np.random.Generator(np.random.Philox(key=np.array([key, number], np.uint64))).permutation(n)


def _ranked(spots: DataFrame) -> DataFrame:
    return spots.withColumn("pos", (F.row_number().over(W.partitionBy("grp").orderBy("array_col", "array_row", "spot_id")) - 1).cast("int"))


def _numbers(n_perm: int, n: F.Column) -> F.Column:
    """First numbers and sizes of the blocks of permutations of a group of n spots."""
    size = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BITS) / n).cast("int")))
    return F.transform(F.sequence(F.lit(0), F.floor((n_perm - 1) / size).cast("int")), lambda k: F.struct((k * size).alias("lo"), F.least(size, n_perm - k * size).alias("size")))


def _tasks(spark: SparkSession) -> int:
    """Parts for rows that are small and take long: a given number is not coalesced by size."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)


def shuffles(spots: DataFrame, n_perm: int, seed: int = 0) -> DataFrame:
    """(grp, perm, spot_id, from_spot): a permutation of each group's spots for each number, the same for all features."""
    held = _ranked(spots).groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("pos", "spot_id"))).alias("s"))
    dealt = held.select("grp", F.transform("s", lambda x: x["spot_id"]).alias("ids"), F.explode(_numbers(n_perm, F.size("s"))).alias("b")).select("grp", "ids", "b.lo", "b.size").repartition("grp", "lo")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for grp, ids, lo, size in frame.itertuples(index=False):
                for number in range(lo, lo + size):
                    yield pd.DataFrame({"grp": grp, "perm": np.int32(number), "spot_id": ids, "from_spot": ids[permutation(seed, grp, number, len(ids))]})

    kinds = dict(spots.dtypes)
    return dealt.mapInPandas(run, f"grp {kinds['grp']}, perm int, spot_id {kinds['spot_id']}, from_spot {kinds['spot_id']}")


def _spread(x: np.ndarray, y: np.ndarray, fwhm: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(spot, other, weight) for all spots within fwhm of each other, each with itself."""
    sigma, cells, found = fwhm / 2.355, {}, []
    for i, key in enumerate(zip(np.floor(x / fwhm).astype(int).tolist(), np.floor(y / fwhm).astype(int).tolist(), strict=True)):
        cells.setdefault(key, []).append(i)
    for (cx, cy), own in cells.items():
        around = np.array([k for i in (-1, 0, 1) for j in (-1, 0, 1) for k in cells.get((cx + i, cy + j), ())])
        d = np.round(np.hypot(x[own][:, None] - x[around], y[own][:, None] - y[around]), 4)
        a, b = np.nonzero(d <= fwhm)
        found.append((np.array(own)[a], around[b], np.exp(-(d[a, b] ** 2) / (2 * sigma * sigma))))
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


def footprint(smoothed: np.ndarray, weights: np.ndarray, neighbours: list[list[int]], min_size: int, thres_per: float) -> np.ndarray:
    """Which spots are in a component that the filter by mean weight leaves (OP-T14)."""
    labels = tree.component_labels(smoothed, neighbours, min_size)
    if not labels.any():
        return labels > 0
    sizes = np.bincount(labels)
    present = np.flatnonzero(sizes)
    means = np.bincount(labels, weights)[present] / sizes[present]
    best = present[np.lexsort((present, -means))][: int(np.floor(len(present) * (1 - thres_per / 100)))]
    return np.isin(labels, best[best > 0])


def _overlap(a: np.ndarray, b: np.ndarray, unit_a: np.ndarray | None, unit_b: np.ndarray | None) -> float | None:
    """Shared over joint footprint; with units, sums of the smaller over the larger unit value (None where one is flat)."""
    if not (a.any() or b.any()):
        return 0.0
    if unit_a is None or unit_b is None:
        return float((a & b).sum() / (a | b).sum())
    if (a.any() and np.isnan(unit_a).any()) or (b.any() and np.isnan(unit_b).any()):
        return None
    x, y = np.where(a, unit_a, 0.0), np.where(b, unit_b, 0.0)
    top = np.maximum(x, y).sum()
    return float(np.minimum(x, y).sum() / top) if top > 0 else None


def _unit(values: np.ndarray) -> np.ndarray:
    low, high = values.min(), values.max()
    return (values - low) / (high - low) if high > low else np.full(len(values), np.nan)


def permutation_draws(
    values: DataFrame, spots: DataFrame, pairs: DataFrame, n_perm: int, seed: int = 0, min_size: int = 20, thres_per: float = 30, lattice: str = "grid", fwhm: float = 2.5, jaccard_type: str = "default"
) -> DataFrame:
    """(grp, perm, feat_1, feat_2, j_perm) of every permutation.

    values: grp, feature, spot_id, value. On a square grid these are smoothed values, which are permuted as they are; on a
    'hex' lattice raw ones, which are permuted and then smoothed, while components are filtered and weighted by raw values.
    jaccard_type: 'default' for footprints, 'weighted' for values scaled to 0..1 within them.
    """
    ranked = land(_ranked(spots.select("grp", "spot_id", "array_col", "array_row")), "ranked")
    at = ranked.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("pos", "array_col", "array_row"))).alias("s"))
    at = at.select("grp", F.transform("s", lambda x: x["array_col"]).alias("cols"), F.transform("s", lambda x: x["array_row"]).alias("rows"))
    wanted = pairs.select(F.col("feat_1").alias("feature")).union(pairs.select(F.col("feat_2").alias("feature"))).distinct()
    held = values.join(wanted, "feature", "left_semi").filter("value <> 0").join(ranked.select("grp", "spot_id", "pos"), ["grp", "spot_id"])
    held = held.groupBy("grp", "feature").agg(F.collect_list(F.struct("pos", F.col("value").cast("double").alias("value"))).alias("v"))
    held = land(held.select("grp", "feature", F.transform("v", lambda x: x["pos"]).alias("pos"), F.transform("v", lambda x: x["value"]).alias("value")), "vectors")

    def whole(n: int, pos: np.ndarray, value: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        out[np.asarray(pos, int)] = value
        return out

    def footprints(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, neighbours, near = None, [], None
        for frame in frames:
            for grp, feature, pos, value, cols, rows, lo, size in frame.itertuples(index=False):
                n = len(cols)
                vector = whole(n, pos, value)
                if last != grp:
                    last, x, y = grp, np.asarray(cols) * 0.5, np.asarray(rows) * (3**0.5 / 2)
                    neighbours = tree.four_neighbours(cols, rows) if lattice == "grid" else tree.nearest_neighbours(x, y, fwhm)
                    near = None if lattice == "grid" else _spread(x, y, fwhm)
                masks = []
                for number in range(lo, lo + size):
                    moved = vector[permutation(seed, grp, number, n)]
                    smoothed = moved
                    if near is not None:
                        sums = np.bincount(near[0], near[2] * moved[near[1]], minlength=n)
                        whole_sum = sums.sum()
                        smoothed = np.round(sums / whole_sum * moved.sum(), PLATEAU_DECIMALS) if whole_sum else sums
                    masks.append(np.packbits(footprint(smoothed, moved, neighbours, min_size, thres_per)))
                yield pd.DataFrame({"grp": [grp], "feature": [feature], "lo": [lo], "size": [size], "n": [n], "masks": [np.concatenate(masks).tobytes()]})

    kinds = dict(values.dtypes)
    dealt = held.join(at, "grp").withColumn("b", F.explode(_numbers(n_perm, F.size("cols")))).select("grp", "feature", "pos", "value", "cols", "rows", "b.lo", "b.size")
    dealt = dealt.repartition(_tasks(spots.sparkSession), "grp", "feature", "lo")
    found = land(dealt.mapInPandas(footprints, f"grp {kinds['grp']}, feature {kinds['feature']}, lo int, size int, n int, masks binary"), "footprints")

    weighted = jaccard_type == "weighted"
    none = [F.lit(None).cast("array<int>").alias("pos"), F.lit(None).cast("array<double>").alias("value")]
    vectors = held.select("grp", "feature", *(["pos", "value"] if weighted else none))
    side = lambda k: found.join(vectors, ["grp", "feature"]).select("grp", "lo", F.col("feature").alias(f"feat_{k}"), *[F.col(c).alias(f"{c}_{k}") for c in ("masks", "pos", "value")])
    # The result itself has a row for each pair, slide and number; features without values on a slide have no footprint there.
    blocks = at.select("grp", F.size("cols").alias("n"), F.explode(_numbers(n_perm, F.size("cols"))).alias("b")).select("grp", "n", "b.lo", "b.size")
    every = pairs.select("feat_1", "feat_2").distinct().crossJoin(blocks)
    both = every.join(side(1), ["grp", "lo", "feat_1"], "left").join(side(2), ["grp", "lo", "feat_2"], "left")
    columns = ["grp", "lo", "size", "n", "feat_1", "feat_2", "masks_1", "pos_1", "value_1", "masks_2", "pos_2", "value_2"]

    def overlaps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for grp, lo, size, n, one, two, masks_1, pos_1, value_1, masks_2, pos_2, value_2 in frame[columns].itertuples(index=False):
                bits = [np.unpackbits(np.frombuffer(m, np.uint8).reshape(size, -1), axis=1, count=n).astype(bool) if m is not None else np.zeros((size, n), bool) for m in (masks_1, masks_2)]
                units = [(_unit(whole(n, p, v)) if p is not None else np.zeros(n)) if weighted else None for p, v in ((pos_1, value_1), (pos_2, value_2))]
                for k in range(size):
                    order = permutation(seed, grp, lo + k, n) if weighted else None
                    a, b = (u[order] if u is not None else None for u in units)
                    out.append((grp, lo + k, one, two, _overlap(bits[0][k], bits[1][k], a, b)))
            yield pd.DataFrame(out, columns=["grp", "perm", "feat_1", "feat_2", "j_perm"]).astype({"j_perm": float})

    sides = dict(pairs.dtypes)
    drawn = both.select(*columns).repartition(_tasks(spots.sparkSession), "grp", "lo", "feat_1", "feat_2").mapInPandas(overlaps, f"grp {kinds['grp']}, perm int, feat_1 {sides['feat_1']}, feat_2 {sides['feat_2']}, j_perm double")
    return drawn.withColumn("j_perm", F.when(~F.isnan("j_perm"), F.col("j_perm")))


def p_values(observed: DataFrame, draws: DataFrame) -> DataFrame:
    """Results with the share of draws that reach the observed value (OP-A13, J07); null without draws."""
    keys = ["grp", "feat_1", "feat_2"]
    hits = observed.select(*keys, "j_comp").join(draws, keys).groupBy(*keys).agg(F.avg((F.col("j_perm") >= F.col("j_comp")).cast("double")).alias("p_value"))
    return observed.join(hits, keys, "left")


def significance(results: DataFrame, wanted: DataFrame, values: DataFrame, spots: DataFrame, n_perm: int = 1000, seed: int = 0, **options) -> DataFrame:
    """p-values of the wanted pairs among earlier results (OP-J06, T19); see permutation_draws for `values` and options."""
    chosen = results.join(wanted.select("feat_1", "feat_2").distinct(), ["feat_1", "feat_2"])
    draws = permutation_draws(values, spots, chosen.select("feat_1", "feat_2").distinct(), n_perm, seed, **options)
    return p_values(chosen, draws)
