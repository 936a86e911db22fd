"""Relational operators of the spatial engine on small hand-made tables; guards; sources, sinks and the stream."""

import inspect
import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from spatialcc import catalog
from spatialcc.functions.scalars import log_factorial
from spatialcc.operators import adjacency, annotate, diff, grid, jaccard, pairs, permute, qc, smooth, tree
from spatialcc.plans.dataset import Params, SpatialDataset, from_molecules
from spatialcc.sources import readers, sinks
from spatialcc.streaming import counts


def square(spark, side=12, features=("a", "b")):
    rows = [("s", f"{c}_{r}", c, r, f, math.exp(-((c - 3 - 5 * k) ** 2 + (r - 4) ** 2) / 6.0) * 5) for c in range(side) for r in range(side) for k, f in enumerate(features)]
    df = spark.createDataFrame(rows, "grp string, spot_id string, array_col int, array_row int, feature string, value double")
    spots = df.select("grp", "spot_id", "array_col", "array_row").distinct()
    return spots, df.select("grp", "spot_id", "feature", "value")


def test_smoothing_keeps_totals_and_spreads_evenly(spark):
    spots, _ = square(spark)
    corner = spark.createDataFrame([("s", "0_0", "x", 0, 0, 7.0)], "grp string, spot_id string, feature string, array_col int, array_row int, value double")
    s = {(r.array_col, r.array_row): r.smoothed for r in smooth.smooth_grid(corner, spots).collect()}
    assert abs(sum(s.values()) - 7) < 1e-6 and len(s) == 16 and max(s, key=s.get) == (0, 0)
    assert s[1, 0] == pytest.approx(s[0, 1])


def test_pair_pipeline_invariants(spark):
    spots, expr = square(spark)
    data = SpatialDataset(spots, expr, Params(min_size=4, thres_per=0)).kept()
    asked = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "a")], "feat_1 string, feat_2 string")
    for kind in ("default", "weighted"):
        j = {(r.feat_1, r.feat_2): r.j_comp for r in data.similarity(asked, kind).collect()}
        assert j["a", "a"] == pytest.approx(1) and j["a", "b"] == pytest.approx(j["b", "a"]) and 0 <= j["a", "b"] <= 1
    with pytest.raises(ValueError):
        data.similarity(asked, "other")
    with pytest.raises(ValueError):
        data.similarity(spark.createDataFrame([("a", "none")], "feat_1 string, feat_2 string"))
    assert data.where(F.col("array_col") < 5).expr.count() < expr.count()
    for bad in ({"min_size": 0}, {"fwhm": 0}, {"thres_per": 101}, {"lattice": "x"}):
        with pytest.raises(ValueError):
            Params(**bad)


def test_jaccard_of_hand_made_labels(spark):
    labels = spark.createDataFrame([("s", "a", "1", 1), ("s", "a", "2", 1), ("s", "a", "3", 2), ("s", "b", "2", 1), ("s", "b", "3", 1)], "grp string, feature string, spot_id string, cc_label int")
    spots = spark.createDataFrame([("s", str(i), i, 0) for i in range(5)], "grp string, spot_id string, array_col int, array_row int")
    asked = spark.createDataFrame([("a", "b"), ("c", "d")], "feat_1 string, feat_2 string")
    j = {(r.feat_1, r.feat_2): r.j_comp for r in jaccard.jaccard_composite(asked, labels, spots).collect()}
    assert j == {("a", "b"): 2 / 3, ("c", "d"): 0}
    local = jaccard.local_jaccard(asked, labels)
    assert {(r.ccx, r.ccy): r.j_local for r in local.collect()} == {(1, 1): pytest.approx(1 / 3), (2, 1): 0.5}
    assert [r.ccx for r in jaccard.top_n_regions(local, 1).collect()] == [2]
    with pytest.raises(ValueError):
        jaccard.top_n_regions(local, 3)
    flat = spark.createDataFrame([("s", f, str(i), 1.0) for f in "ab" for i in range(5)], "grp string, feature string, spot_id string, value double")
    weighted = {(r.feat_1, r.feat_2): r.j_comp for r in jaccard.jaccard_weighted(asked, labels, flat, spots).collect()}
    assert weighted == {("a", "b"): None, ("c", "d"): 0}


def test_permutations(spark):
    spots, expr = square(spark, 8)
    moved = permute.shuffles(spots, 2, 1).collect()
    assert len(moved) == 128 and all(len({m.from_spot for m in moved if m.perm == p}) == 64 for p in (0, 1))
    observed = spark.createDataFrame([("s", "a", "b", 0.5)], "grp string, feat_1 string, feat_2 string, j_comp double")
    draws = spark.createDataFrame([("s", "a", "b", x) for x in (0.5, 0.4, 0.6, 0.1)], "grp string, feat_1 string, feat_2 string, j_perm double")
    assert permute.p_values(observed, draws).first().p_value == 0.5


@pytest.mark.parametrize("kind", ["default", "weighted"])
@pytest.mark.parametrize("lattice", ["grid", "hex"])
def test_draws_equal_datasets_of_permuted_values(spark, lattice, kind):
    """Each permutation as a dataset of its own, through the batch pipeline."""
    wide = 24 if lattice == "hex" else 12
    places = [("s", f"{c}_{r}", c, r) for r in range(12) for c in range((r % 2) * (lattice == "hex"), wide, 1 + (lattice == "hex"))]
    spots = spark.createDataFrame(places, "grp string, spot_id string, array_col int, array_row int")
    scale = 2 if lattice == "hex" else 1
    rows = [(g, i, f, v) for g, i, c, r in places for k, f in enumerate("ab") if (v := math.exp(-((c / scale - 4 - 2 * k) ** 2 + (r - 6) ** 2) / 6.0) * 5) > 1e-3]
    expr = spark.createDataFrame(rows, "grp string, spot_id string, feature string, value double")
    data = SpatialDataset(spots, expr, Params(min_size=4, lattice=lattice)).kept()
    asked = spark.createDataFrame([("a", "b"), ("b", "b"), ("a", "none")], "feat_1 string, feat_2 string")
    wanted = spark.createDataFrame([("a", "b"), ("b", "b")], "feat_1 string, feat_2 string")
    smoothed = data.smoothed()
    values = data.weights(smoothed)
    draws = permute.permutation_draws(values, data.spots, asked, 2, 1, 4, 30, lattice, 2.5, kind).collect()
    moves = permute.shuffles(data.spots, 2, 1)
    got = {(r.perm, r.feat_1, r.feat_2): r.j_perm for r in draws}
    assert len(draws) == 6
    for p in range(2):
        moved = values.withColumnRenamed("spot_id", "from_spot").join(moves.filter(F.col("perm") == p), ["grp", "from_spot"]).select("grp", "spot_id", "feature", "value")
        if lattice == "hex":
            batch = SpatialDataset(data.spots, moved, data.params).similarity(wanted, kind)
        else:
            at = moved.withColumnRenamed("value", "smoothed").join(data.spots, ["grp", "spot_id"])
            labels = data.components(at)
            batch = jaccard.jaccard_composite(wanted, labels, data.spots) if kind == "default" else jaccard.jaccard_weighted(wanted, labels, moved, data.spots)
        for r in batch.collect():
            assert got[p, r.feat_1, r.feat_2] == pytest.approx(r.j_comp)
    assert max(j for (_, one, two), j in got.items() if (one, two) == ("a", "b")) > 0.02
    observed = data.similarity(wanted, kind)
    for r in data.significance(observed, wanted, n_perm=2, seed=1, jaccard_type=kind).collect():
        assert r.p_value == pytest.approx(sum(got[p, r.feat_1, r.feat_2] >= r.j_comp for p in range(2)) / 2)


def test_permutations_do_not_depend_on_blocks(spark, monkeypatch):
    spots, expr = square(spark, 8)
    asked = spark.createDataFrame([("a", "b")], "feat_1 string, feat_2 string")
    draw = lambda: sorted((r.perm, r.j_perm) for r in permute.permutation_draws(expr, spots, asked, 7, 5, 3).collect())
    whole = draw()
    monkeypatch.setattr(permute, "BLOCK", 3)
    assert draw() == whole and [k for k, _ in whole] == list(range(7))


def test_registered_permutations_are_the_whole_test(spark, monkeypatch):
    asked = {}

    class Data:
        def similarity(self, wanted, **options):
            return wanted

        def significance(self, *args, **options):
            asked.update(inspect.signature(SpatialDataset.significance).bind(self, *args, **options).arguments)

    monkeypatch.setattr(catalog.P, "slides", lambda spark, sf_dir: Data())
    catalog.permutation_pvalue(spark, "")
    assert asked.get("n_perm", inspect.signature(SpatialDataset.significance).parameters["n_perm"].default) == 1000


def test_names_and_pairs(spark):
    cellchat = spark.createDataFrame([("A - (B+C)",), ("D - E",)], "interaction_name_2 string")
    assert sorted(tuple(r) for r in pairs.lr_cellchat(cellchat).collect()) == [("A", "B"), ("A", "C"), ("D", "E")]
    omni = spark.createDataFrame([("A_B", "C"), ("B", "C")], "source_genesymbol string, target_genesymbol string")
    assert sorted(tuple(r) for r in pairs.lr_omnipath(omni).collect()) == [("A", "C"), ("B", "C")]
    assert pairs.lr_omnipath(omni, dedupe=False).count() == 3
    names = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3), ("x", 4)], "name string, o int")
    assert [r.unique_name for r in qc.make_unique(names, "name", "o").orderBy("o").collect()] == ["x", "x-1", "y", "x-2"]
    names = spark.createDataFrame([("x", 1), ("x-1", 2), ("x", 3), ("x-1", 4), ("x", 5), ("x-3", 6)], "name string, o int")
    assert [r.unique_name for r in qc.make_unique(names, "name", "o").orderBy("o").collect()] == ["x", "x-1", "x-2", "x-1-1", "x-4", "x-3"]
    with pytest.raises(ValueError):
        pairs.check_groups(spark.createDataFrame([("s",)], "grp string"), ["t"])


def test_bins_at_the_edges(spark):
    points = spark.createDataFrame([(float(v), 0.0) for v in (0, 1, 4.999, 5, 9.999, 10)], "x double, y double")
    assert [r.array_col for r in grid.grid_bin(points, 2, 3).orderBy("x").collect()] == [0, 0, 0, 1, 1, 1]
    assert {r.array_row for r in grid.grid_bin(points, 2, 3).collect()} == {0}


def test_log_ratio_and_over_representation(spark):
    means = spark.createDataFrame([("a", "x", "y", 0.5), ("b", "x", "y", 0.0), ("a", "u", "v", 0.2), ("b", "u", "v", 0.1)], "cond string, feat_1 string, feat_2 string, mean double")
    found = {r.feat_1: r.logfc for r in diff.differential(means, "a", "b", 0.5).collect()}
    assert found == {"x": float("inf"), "u": pytest.approx(1)}
    genes = spark.createDataFrame([(i,) for i in range(10)], "gene int")
    sets = spark.createDataFrame([("t", i) for i in range(4)] + [("w", 9)], "term string, gene int")
    r = {x.term: x for x in diff.over_representation(sets, genes.filter("gene < 3"), genes).collect()}
    assert r["t"].p_value == pytest.approx(4 / 120) and set(r) == {"t"}
    logs = spark.range(0, 300).select("id", log_factorial(F.col("id")).alias("x")).collect()
    assert all(r.x == pytest.approx(math.lgamma(r.id + 1), abs=1e-11) for r in logs)


def test_sources(spark, tmp_path):
    at = f"{tmp_path}"
    (tmp_path / "m.csv").write_text("fov,cell_ID,G1,NegPrb.1,G.2\n1,1,2,1,0\n1,2,0,0,3\n")
    long = readers.read_matrix_csv(spark, f"{at}/m.csv", ["fov", "cell_ID"])
    assert sorted((r.cell_ID, r.target, r.n) for r in qc.drop_controls(long).collect()) == [(1, "G1", 2.0), (2, "G.2", 3.0)]
    (tmp_path / "tx.csv").write_text("cell_ID,x,y,t\n0,1,1,G1\n1,2,2,G1\n1,3,3,NegPrb\n")
    tx = readers.read_molecules(spark, f"{at}/tx.csv", {"cell": "cell_ID", "x": "x", "y": "y", "target": "t"})
    assert [(r.cell, r.target) for r in tx.collect()] == [(1, "G1")]
    (tmp_path / "p.tsv").write_text("l\tr\tz\nA\tB\t1\n")
    assert [tuple(r) for r in readers.read_pairs(spark, f"{at}/p.tsv").collect()] == [("A", "B")]
    (tmp_path / "lr.csv").write_text("source_genesymbol,target_genesymbol\nA_B,C\n")
    assert readers.read_lr_db(spark, f"{at}/lr.csv", "omnipath", "rat").count() == 2
    for bad in (("celltalk", "rat"), ("other", "human"), ("omnipath", "cat")):
        with pytest.raises(ValueError):
            readers.read_lr_db(spark, f"{at}/lr.csv", *bad)
    with pytest.raises(ValueError):
        readers.read_hd_bins(spark, "/data/square_004um")
    v = tmp_path / "visium"
    (v / "spatial").mkdir(parents=True)
    (v / "filtered_feature_bc_matrix").mkdir()
    (v / "spatial/tissue_positions_list.csv").write_text("b1,1,0,0,9,9\nb2,0,0,2,9,9\nb3,1,1,1,9,9\n")
    (v / "filtered_feature_bc_matrix/matrix.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n%\n2 3 3\n1 1 5\n2 3 7\n1 2 1\n")
    (v / "filtered_feature_bc_matrix/features.tsv").write_text("G1\tx\nG2\ty\n")
    (v / "filtered_feature_bc_matrix/barcodes.tsv").write_text("b1\nb2\nb3\n")
    spots, expr = readers.read_visium(spark, str(v))
    assert sorted(r.spot_id for r in spots.collect()) == ["b1", "b3"]
    assert sorted((r.spot_id, r.feature, r.value) for r in expr.collect()) == [("b1", "G1", 5.0), ("b3", "G2", 7.0)]


def test_sinks(spark, tmp_path):
    spots, expr = square(spark, 3)
    sinks.save_dataset({"spots": spots, "expr": expr}, {"fwhm": "2.5"}, f"{tmp_path}/d")
    tables, params = sinks.load_dataset(spark, f"{tmp_path}/d", ["spots", "expr"])
    assert tables["expr"].count() == expr.count() and params == {"fwhm": "2.5"}
    book = sinks.Registry(spark, f"file://{tmp_path}/runs")
    for i in range(11):
        assert book.save("J_result", spark.range(i)) == i
    book.save("tx_by_cell_grid", spark.range(3))
    assert book.latest("J_result").count() == 10
    assert book.reset() == ["J_result"]
    assert book.runs("J_result") == [] and book.latest("tx_by_cell_grid").count() == 3
    with pytest.raises(ValueError):
        book.latest("J_result")
    with pytest.raises(ValueError):
        sinks.save_labels_csv(spots, f"{tmp_path}/x")


def test_molecules_to_dataset_and_stream(spark, tmp_path):
    rows = [(c, float(c % 5), float(c % 3), t) for c in range(40) for t in ("A", "B", "B")]
    tx = spark.createDataFrame(rows, "cell int, x double, y double, target string")
    cells = spark.createDataFrame([(c, "k" if c % 2 else "l") for c in range(40)], "cell int, celltype string")
    data = from_molecules(tx, cells, Params(min_counts=2, min_cells=2, x_bins=5, y_bins=3))
    assert data.spots.count() == 15 and {r.feature for r in data.expr.collect()} == {"A", "B"}
    own = data.celltype_specific("k")
    assert own.count() == 30
    tx.write.parquet(f"{tmp_path}/tx")
    stream = spark.readStream.schema(tx.schema).parquet(f"{tmp_path}/tx")
    counts.run_grid_counts(stream, (0, 4, 0, 2), 5, 3, f"{tmp_path}/ckpt", "drained")
    assert sorted(tuple(r) for r in spark.table("drained").collect()) == sorted(tuple(r) for r in counts.grid_counts(tx, (0, 4, 0, 2), 5, 3).collect())


def test_annotation(spark):
    ref = spark.createDataFrame([(1, "x", [0.0, 0.0]), (2, "x", [0.0, 1.0]), (3, "y", [5.0, 5.0])], "ref int, label string, embedding array<double>")
    cells = spark.createDataFrame([(1, [0.0, 0.4]), (2, [5.0, 4.0])], "cell int, embedding array<double>")
    assert {r.cell: r.label for r in annotate.annotate(cells, ref).collect()} == {1: "x", 2: "y"}
    assert {r.cell: r.label for r in annotate.nearest_label(cells, ref, 1).collect()} == {1: "x", 2: "y"}


def test_principal_components_equal_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 6)) @ rng.normal(size=(6, 6))
    cells = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "cell int, embedding array<double>")
    got = np.array([r.pcs for r in annotate.principal_components(cells, 3).orderBy("cell").collect()])
    values, vectors = np.linalg.eigh(np.cov(x.T))
    vectors = vectors[:, np.argsort(-values)[:3]]
    vectors *= np.sign(vectors[np.abs(vectors).argmax(0), range(3)])
    assert np.allclose(got, x @ vectors)


def test_clusters_of_blobs(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=2) * 0.1 + 10 * np.array([i % 3, i % 2])).tolist()) for i in range(60)]
    found = annotate.clusters(spark.createDataFrame(rows, "cell int, pcs array<double>"), 6, 1).collect()
    assert len({(r.cell % 6, r.cluster) for r in found}) == 6 == len({r.cluster for r in found})


def test_neighbours_by_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 3)).round(1)
    e = spark.createDataFrame([(i, f"l{i % 3}", v.tolist()) for i, v in enumerate(x)], "ref int, label string, embedding array<double>")
    want = {}
    for i in range(40):
        near = sorted((((x[i] - x[j]) ** 2).sum(), j) for j in range(40))[:5]
        votes = Counter(f"l{j % 3}" for _, j in near)
        want[i] = min(votes, key=lambda k: (-votes[k], k))
    for block in (1000, 7):
        monkeypatch.setattr(annotate, "BLOCK", block)
        assert {r.ref: r.label for r in annotate.nearest_label(e, e, cell="ref", ref="ref").collect()} == want


def test_neighbours_of_odd_vectors_as_in_sql(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).round(1).tolist(), i % 4) for i in range(60)] + [(100 + i, [1.0, 2.0, 3.0, 4.0], i % 3) for i in range(20)]
    rows += [(200, None, 1), (201, [], 2), (202, [1.0], 3), (203, [None, 1.0, None, 2.0], 0), (204, [math.nan, 1.0, 1.0, 1.0], 1), (205, [1e200, 0.0, 0.0, 0.0], None), (206, [math.inf, 0.0, 0.0, 0.0], 2)]
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    want = sorted(con.execute(catalog.ORACLES["label_transfer"]).fetchall())
    for block in (8192, 9):
        monkeypatch.setattr(annotate, "BLOCK", block)
        found = catalog.label_transfer(spark, str(tmp_path))
        assert sorted(tuple(r) for r in found.collect()) == want
    # Vectors are never gathered into an array that a row carries.
    assert "collect_list(struct(ref" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_of_block_by_brute_force():
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(300, 8)).round(1), np.repeat(rng.normal(size=(40, 8)).round(1), 5, axis=0)
    i, j, d, none = annotate.nearest_of_block(a, b, 7)
    gaps = np.zeros((300, 200))
    for n in range(8):
        gaps += (a[:, n, None] - b[:, n]) ** 2
    for row in range(300):
        assert j[i == row].tolist() == np.argsort(gaps[row], kind="stable")[:7].tolist()
    assert not none.any() and (d == gaps[i, j]).all()


def test_hexagonal_pipeline_by_brute_force(spark):
    places = [(c, r) for r in range(10) for c in range(r % 2, 20, 2)]
    order = sorted(range(len(places)), key=lambda i: (places[i][0], places[i][1]))
    x, y = np.array([places[i][0] * 0.5 for i in order]), np.array([places[i][1] * 3**0.5 / 2 for i in order])
    raw = {f: np.array([math.exp(-((a - 3 - 2 * k) ** 2 + (b - 4) ** 2) / 3) * 4 + math.exp(-((a - 8) ** 2 + (b - 2 - k) ** 2)) for a, b in zip(x, y, strict=True)]) for k, f in enumerate("ab")}
    raw = {f: np.where(v > 0.4, v, 0) for f, v in raw.items()}
    d = np.round(np.hypot(x[:, None] - x, y[:, None] - y), 4)
    weight = np.where(d <= 2.5, np.exp(-(d**2) / (2 * (2.5 / 2.355) ** 2)), 0)
    near = [np.flatnonzero((d[i] > 0) & (d[i] <= d[d > 0].min())).tolist() for i in range(len(x))]
    held = {}
    for f, v in raw.items():
        s = weight @ v
        held[f] = permute.footprint(np.round(s / s.sum() * v.sum(), 10), v, near, 5, 30)
    rows = [("s", f"{places[i][0]}_{places[i][1]}", *places[i], f, float(v[k])) for f, v in raw.items() for k, i in enumerate(order)]
    df = spark.createDataFrame(rows, "grp string, spot_id string, array_col int, array_row int, feature string, value double")
    data = SpatialDataset(df.select("grp", "spot_id", "array_col", "array_row").distinct(), df.select("grp", "spot_id", "feature", "value"), Params(min_size=5, lattice="hex"))
    [found] = data.similarity(spark.createDataFrame([("a", "b")], "feat_1 string, feat_2 string")).collect()
    assert found.j_comp == pytest.approx((held["a"] & held["b"]).sum() / (held["a"] | held["b"]).sum()) and 0 < found.j_comp < 1


def test_bars_of_a_small_tree():
    # Peaks 5, 4 and 6 of a path; 4 and 6 meet at 3, these and 5 at 1.
    line = [[j for j in (i - 1, i + 1) if 0 <= j < 5] for i in range(5)]
    t = tree.build([5, 1, 4, 3, 6], line)
    found = {b["node"]: (b["layer"], b["place"], b["birth"], b["death"]) for b in tree.bars(t, tree.prune(t, 1))}
    assert found == {0: (0, 0.0, 6, 3), 1: (0, 1.0, 5, 1), 2: (0, 2.0, 4, 3), 3: (1, 1.0, 3, 1), 4: (2, 1.0, 1, 0)}


def test_ligand_receptor_entry(spark, tmp_path):
    spots, expr = square(spark)
    data = SpatialDataset(spots, expr, Params(min_size=4)).kept()
    (tmp_path / "db.csv").write_text("source_genesymbol,target_genesymbol\na_z,b\na,none\n")
    found = data.lr_similarity(f"{tmp_path}/db.csv", "omnipath").collect()
    assert [(r.feat_1, r.feat_2) for r in found] == [("a", "b")]
    [same] = data.similarity(spark.createDataFrame([("a", "b")], "feat_1 string, feat_2 string")).collect()
    assert found[0].j_comp == pytest.approx(same.j_comp)
    with pytest.raises(ValueError):
        data.lr_similarity(f"{tmp_path}/db.csv", "omnipath", "cat")


def joins(df):
    """The joins of a plan before it runs, each with its keys."""
    return [x.strip(" :+-*()0123456789") for x in df._jdf.queryExecution().sparkPlan().toString().split("\n") if "Join" in x]


def hex_places(spark, folder, groups=("a", "b")):
    rows = [(g, f"{c}_{r}", c * 0.5 * k, r * 3**0.5 / 2 * k) for k, g in enumerate(groups, 1) for r in range(6) for c in range(r % 2, 12, 2)]
    spark.createDataFrame(rows, "grp string, spot_id string, x double, y double").write.parquet(f"{folder}/places")
    return spark.read.parquet(f"{folder}/places")


def test_distance_join_does_not_trust_the_size_of_a_file(spark, tmp_path):
    spots = hex_places(spark, tmp_path)
    near = adjacency.distance_join(spots, 2.5)
    assert all(x.startswith("SortMergeJoin") for x in joins(near))
    rows = spots.collect()
    want = {(p.grp, p.spot_id, q.spot_id, d) for p in rows for q in rows if p.grp == q.grp and (d := round(math.hypot(p.x - q.x, p.y - q.y), 4)) <= 2.5}
    assert {tuple(r) for r in near.collect()} == want and near.count() == len(want)


def test_nearest_pairs_broadcast_distances_of_groups_only(spark, tmp_path):
    found = adjacency.min_distance_adjacency(adjacency.distance_join(hex_places(spark, tmp_path), 2.5))
    rows = [tuple(r) for r in found.collect()]
    assert {r[0]: r[3] for r in rows} == {"a": 1.0, "b": 2.0} and all(r[3] == {"a": 1.0, "b": 2.0}[r[0]] for r in rows)
    # Pairs are read back, so the join of spots isn't in the plan, and what is broadcast has a row a group.
    assert len(joins(found)) == 1 and joins(found)[0].startswith("BroadcastHashJoin [grp")


def test_smoothing_does_not_trust_the_size_of_a_file(spark, tmp_path):
    spots = hex_places(spark, tmp_path)
    expr = spots.select("grp", F.lit("f").alias("feature"), "spot_id", (F.col("x") + 1).alias("value"))
    found = smooth.smooth_points(expr, spots)
    assert all(x.startswith("SortMergeJoin") for x in joins(found) if "spot_id" in x)
    total = {r.grp: r.s for r in expr.groupBy("grp").agg(F.sum("value").alias("s")).collect()}
    assert {r.grp: pytest.approx(r.s) for r in found.groupBy("grp").agg(F.sum("smoothed").alias("s")).collect()} == total


def test_unique_names_by_brute_force(spark):
    draw = random.Random(3)
    pool = ["x", "x", "x", "x", "x-1", "x-2", "x-5", "x-1-1", "x-03", "y\nz", "y\nz", "y\nz-1", "w", "w", "w-1\n", None, None]
    said = [(i, draw.choice(pool)) for i in range(300)] + [(300 + i, f"x-{3 * i}") for i in range(1, 60)]
    found = qc.make_unique(spark.createDataFrame(said, "o int, name string"), "name", "o")
    there, given, want = {n for _, n in said}, Counter(), {}
    for i, n in said:
        if n is not None and n in given:
            given[n] += 1
            while f"{n}-{given[n]}" in there:
                given[n] += 1
            want[i] = f"{n}-{given[n]}"
        else:
            given[n], want[i] = 0, n
    assert {r.o: r.unique_name for r in found.collect()} == want and found.columns == ["o", "name", "unique_name"]
    # The work of a row doesn't grow with the number it gets.
    assert "sequence(" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_hexagonal_pipeline_does_not_trust_the_size_of_a_file(spark, tmp_path):
    spots = spark.createDataFrame([("s", f"{c}_{r}", c, r) for r in range(6) for c in range(r % 2, 12, 2)], "grp string, spot_id string, array_col int, array_row int")
    data = SpatialDataset(spots, spots.select("grp", "spot_id", F.lit("f").alias("feature"), (F.col("array_col") + 1.0).alias("value")), Params(min_size=2, lattice="hex")).kept()
    smoothed = data.smoothed()
    assert smoothed.count() == spots.count() and all(x.startswith("SortMergeJoin") for x in joins(smoothed) if "spot_id" in x)
