"""The verbs of a table and the results they give, against numpy, hand-made answers or planted structure."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.app.session import AppConfig, JobRunner, LevelTree, Session
from tessella.functions.quantiles import percentiles, running_total
from tessella.functions.scalers import ScalerRule
from tessella.operators import assignment as asg
from tessella.operators import bridge as br
from tessella.operators import consensus as cs
from tessella.operators import diagnostics as dg
from tessella.operators import gradient as gr
from tessella.operators import hierarchy as hi
from tessella.operators import knn as kn
from tessella.operators import propagation as pp
from tessella.operators import stability as st
from tessella.operators.frame import CellFrame
from tessella.operators.labels import LabelSet
from tessella.sources import interop, store


def blobs(n_types=3, per=24, d=4, sep=9.0, seed=0, first_id=0):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(99).normal(0, sep, (n_types, d))
    x = np.concatenate([rng.normal(c, 1.0, (per, d)) for c in centres])
    pdf = pd.DataFrame(x, columns=[f"m{k}" for k in range(d)])
    pdf.insert(0, "cell_id", np.arange(first_id, first_id + len(x)))
    pdf["kind"] = np.repeat([f"t{k}" for k in range(n_types)], per)
    pdf["depth"] = np.repeat(np.arange(n_types)[::-1] * 100.0, per) + rng.normal(0, 1, len(x))
    return pdf


FEATURES = ["m0", "m1", "m2", "m3"]


@pytest.fixture(scope="module")
def cells(spark):
    return blobs()


@pytest.fixture(scope="module")
def clustered(spark, cells):
    frame = CellFrame(spark.createDataFrame(cells), FEATURES, seed=7)
    frame.add_mask("deep", F.col("depth") > -1000)
    found = frame.cluster("deep", n_neighbors=[6, 10], resolution=[0.3, 1.0], n_times=2, name="c", order_by="depth")
    return frame, found


def codes_of(df, column="code"):
    return {r["cell_id"]: r[column] for r in df.collect()}


def same_partition(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


# quantiles


def test_percentiles_and_totals_beyond_the_direct_way(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate((rng.normal(size=3000), np.round(rng.normal(size=2000), 1), [np.nan, 7.0, 7.0]))
    df = spark.createDataFrame([(float(v), float(-2 * v)) for v in x], "x double, y double").repartition(3)
    ps = [0.0, 0.001, 0.25, 0.5, 0.9, 0.999, 1.0]
    wanted = {"x": (F.col("x"), ps), "y": (F.col("y"), [0.5]), "none": (F.lit(None).cast("double"), [0.5])}
    known = x[~np.isnan(x)]
    for direct in (10**6, 10):
        got = percentiles(df, wanted, direct=direct)
        assert got["x"] == pytest.approx(np.quantile(known, ps).tolist(), abs=1e-12) and got["y"] == pytest.approx([np.median(-2 * known)]) and got["none"] is None
    rows = spark.createDataFrame([(i % 3, float(i), i % 7) for i in range(500)], "g int, o double, v long").repartition(4)
    a, b = ({(r["g"], r["o"]): r["t"] for r in running_total(rows, ["g"], "o", "v", "t", descending=True, direct=d).collect()} for d in (10**6, 5))
    assert a == b and a[0, 498.0] == 498 % 7 and a[1, 1.0] == sum(i % 7 for i in range(1, 500, 3))


# hierarchy


def test_cluster_finds_the_types_and_orders_them(clustered, cells):
    frame, found = clustered
    assert frame.clustering("c") is found and found.partitions.n_runs == 8 and found.partitions.n_cells == len(cells) and found.shape == (72, 72)
    cut = found.suggest_cut()
    assert cut.threshold is not None and cut.n_clusters >= 3
    labels = frame.label("c", distance_threshold=0.95, name="type")
    got = codes_of(labels.fact)
    assert same_partition([got[i] for i in cells["cell_id"]], cells["kind"])
    assert [got[i] for i in (0, 24, 48)] == [2, 1, 0]  # the shallowest type is cluster 0
    assert found.params["n_neighbors"] == [6, 10] and found.space.startswith("pca(")
    again = frame.cluster("deep", n_neighbors=[6, 10], resolution=[0.3, 1.0], n_times=2, seed=found.params["seed"])
    assert {tuple(r) for r in again.pairs.collect()} == {tuple(r) for r in found.pairs.collect()}
    over = frame.overcluster(n_neighbors=8)
    assert len(set(codes_of(over.fact).values())) >= 3
    with pytest.raises(ValueError):
        frame.label("c", mask="all", distance_threshold=0.5)
    with pytest.raises(KeyError):
        frame.clustering("nope")


def test_tree_reads(spark, clustered):
    _, found = clustered
    merges, n = found.linkage, len(found.cell_ids)
    assert sorted(found.leaf_order.tolist()) == list(range(n))
    at, counts = found.cluster_count_curve(n_points=30)
    for h, c in zip(at, counts, strict=True):
        assert c == len(set(found.cluster_labels(h)))
    scan = found.threshold_scan(at, min_cluster_size=4)
    assert (found.cluster_count_curve(at, min_cluster_size=4)[1] == scan["n_clusters"]).all() and (scan["n_assigned"] + scan["n_unassigned"] == n).all()
    flat = found.plateaus()
    assert (flat["n_clusters"] > 1).all() and flat["width"].is_monotonic_decreasing
    table = found.merge_table()
    assert table["height"].is_monotonic_increasing and np.allclose(table["coclustering_frequency"], 1 - table["height"]) and table["n_cells"].iloc[-1] == n
    levels, heights = found.nested_codes(n_levels=5)
    assert heights == sorted(heights, reverse=True)
    for coarse, fine in itertools.pairwise(levels):
        assert all(len(set(coarse[fine == c])) == 1 for c in set(fine))
    h = found.hierarchy(n_levels=5)
    assert h.n_cells == n and h.n_levels == len(levels) == len(h.nested_levels)
    frame = h.cell_stability_frame().toPandas()
    strongest = found.similarity.copy()
    np.fill_diagonal(strongest, 0)
    assert np.allclose(frame.set_index("cell_id").loc[found.cell_ids, "stability"], strongest.max(1))
    segments = h.dendrogram_frame()
    assert len(segments) == 3 * len(merges) and segments.groupby("merge")["height"].nunique().eq(1).all()
    with pytest.raises(ValueError):
        hi.check_nesting([np.array([0, 0, 1, 1]), np.array([0, 1, 1, 0])])
    with pytest.warns(UserWarning):
        assert hi.check_nesting([np.array([0, 0, 1, 1]), np.array([0, 1, 1, 0])], 2) == 2


def test_sorted_matrix_and_soft_labels(clustered):
    _, found = clustered
    m = found.sorted_matrix(distance_threshold=0.95)
    assert m.n_cells == 72 and m.sizes.tolist() == [24, 24, 24] and m.centers.tolist() == [12, 36, 60] and m.names == ["0", "1", "2"]
    whole = found.similarity[np.ix_(m.order, m.order)]
    assert np.allclose(m.matrix, whole) and np.allclose(m.block(1), whole[24:48, 24:48])
    assert np.allclose(m.block_means(), [[whole[24 * a : 24 * a + 24, 24 * b : 24 * b + 24].mean() for b in range(3)] for a in range(3)])
    assert found.sorted_matrix(distance_threshold=0.95, subsample=30).n_cells <= 33
    with pytest.raises(ValueError):
        found.sorted_matrix(distance_threshold=0.95, max_cells=10)
    soft = {(r["cell_id"], r["code"]): r["share"] for r in found.soft_labels(distance_threshold=0.95).collect()}
    codes = found.cluster_labels(0.95)
    for i, c in ((0, 0), (5, 1), (70, 2)):
        others = [j for j in range(72) if codes[j] == c and j != i]
        assert soft.get((found.cell_ids[i], c), 0.0) == pytest.approx(found.similarity[i, others].sum() / len(others))


def test_merge_support_and_restrict(clustered):
    _, found = clustered
    support = found.merge_support(n_bands=2, max_merges=5)
    rows = found.partitions.rows.toPandas().pivot(index="cell_id", columns="run", values="label").loc[found.cell_ids].to_numpy()
    grain = found.partitions.runs.orderBy("run").toPandas()["resolution"].to_numpy()
    cuts = np.quantile(grain, [0, 0.5, 1])
    band = np.clip(np.searchsorted(cuts, grain, side="right") - 1, 0, 1)
    below = hi.members(found.linkage, 72, len(found.linkage) - 5)

    def mode(x):
        values, n = np.unique(x[x >= 0], return_counts=True)
        return values[n.argmax()] if len(n) else None

    for r in support.to_dict("records"):
        a, b = (below[int(found.linkage[r["merge"], s])] for s in (0, 1))
        agree = np.array([mode(rows[a, k]) is not None and mode(rows[a, k]) == mode(rows[b, k]) for k in range(rows.shape[1])])
        for k in range(2):
            if (band == k).any():
                assert r[f"support_band_{k}"] == pytest.approx(agree[band == k].mean())
    verdicts = found.merge_verdicts(n_bands=2, max_merges=5)
    assert verdicts["height"].is_monotonic_decreasing and set(verdicts["verdict"]) <= {"unsupported", "all-band", "fine-only"}
    assert found.support_ceiling() == pytest.approx(found.merge_verdicts().query("verdict == 'unsupported'")["height"].min())
    narrow = found.restrict(resolution_max=0.5)
    assert narrow.partitions.n_runs == 4 and narrow.cell_ids == found.cell_ids and narrow.params["restrict"] == {"resolution_max": 0.5}
    with pytest.raises(ValueError):
        found.restrict(resolution_min=50.0)
    assert found.grain_coverage(resolution_max=0.5).first()["n_runs_in_window"] == 4


def test_stability_of_blobs(spark, cells):
    rows = spark.createDataFrame([(int(r[0]), [float(v) for v in r[1:5]]) for r in cells.itertuples(index=False)], "cell_id long, features array<double>")
    got = st.subsample_stability(rows, distance_threshold=0.9, n_draws=2, n_neighbors=8, resolution=0.3, n_times=1)
    assert got.n_draws == 2 and got.min_ari == pytest.approx(1.0) and got.min_assigned == 1.0 and got.summary()["mean_ari"].iloc[0] == pytest.approx(1.0)
    values = [r["stability"] for r in got.cell_stability.collect() if r["stability"] is not None]
    assert np.allclose(values, 1.0)
    ref = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 1), (4, -1)], "cell_id long, code long")
    drawn = spark.createDataFrame([(0, 5), (1, 5), (2, 6), (3, -1), (4, 5)], "cell_id long, code long")
    assert codes_of(st.stayed(ref, drawn), "kept") == pytest.approx({0: 2 / 3, 1: 2 / 3, 2: 1 / 3, 3: 0.0, 4: None})


# ids, columns, spaces, embeddings


def test_ids_and_columns(spark, cells, tmp_path):
    df = spark.createDataFrame(cells)
    keys = spark.createDataFrame([(int(i), f"n{i}") for i in cells["cell_id"]], "cell_id long, root string")
    frame = CellFrame(df, FEATURES, id_col="root", id_map=keys)
    assert frame.id_col == "root" and frame.n_cells == 72 and frame.n_features == 4 and frame.columns[-1] == "root"
    with pytest.raises(ValueError):
        CellFrame(df, FEATURES, id_col="root", id_map=keys.limit(3))
    with pytest.raises(ValueError):
        CellFrame(df, FEATURES, id_col="root", id_map=keys.union(keys))
    frame = CellFrame(df, FEATURES, metadata=spark.createDataFrame([("m0", "a"), ("m1", "a"), ("m2", "b")], "feature_id string, family string"))
    frame.define_features("fam", family="a").define_features("pair", ["m1", "m3"])
    assert frame.resolve("fam") == ["m0", "m1"] and frame.resolve("m2") == ["m2"] and frame.collection_names == ["fam", "pair"]
    both = frame.collection("fam") | frame.collection("pair")
    assert both.columns == ("m0", "m1", "m3") and (both & frame.collection("pair")).columns == ("m1", "m3") and (both - frame.collection("pair")).columns == ("m0",)
    assert [r["family"] for r in frame.var.collect()] == ["a", "a", "b", None] and frame.collection_catalog().count() == 2
    extra = spark.createDataFrame([(int(i), float(i) / 7) for i in cells["cell_id"]], "cell_id long, z double")
    frame.add_features(extra, collection="more")
    assert frame.n_features == 5 and frame.resolve("more") == ["z"]
    frame.add_embedding(extra.withColumn("w", F.col("z") * 2), name="ext")
    frame.set_id_column("root", id_map=keys)
    assert frame.embedding(name="ext").columns == ["root", "ext0", "ext1"] and frame.embedding(name="ext").filter("root = 'n7'").first()["ext1"] == pytest.approx(2.0)
    assert frame.seed_for("cluster") == int(np.random.SeedSequence([0, *(__import__("zlib").crc32(x) for x in (b"cluster", b"all", b""))]).generate_state(1)[0])
    view = frame.embedding_view()
    assert view.xy == {"x": "ext0", "y": "ext1"} and view.n_components == 2 and view[1] == view.y and view.frame.filter("ext0 IS NULL").isEmpty()
    with pytest.raises(ValueError):
        frame.add_embedding(frame.embedding(name="ext").limit(5), name="few")
    assert "72 cells" in frame.describe() and "more (1)" in frame.describe()


def test_spaces(spark, cells):
    frame = CellFrame(spark.createDataFrame(cells), FEATURES)
    frame.add_mask("some", F.col("cell_id") < 60)
    frame.define_space("s", "some", columns=["m0", "m1", "m2"], rule=ScalerRule("robust"), weights="sqrt_k", boost={"m0": 2.0}, alpha=0.5, explained=2)
    space = frame.fitted_space("s")
    assert space.n_components == 2 and space.alpha == 0.5 and space.weights[0] == pytest.approx(2 * space.weights[1]) or space.weights is not None
    rows = cells[cells["cell_id"] < 60]
    x = rows[["m0", "m1", "m2"]].to_numpy()
    q = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    scaled = (x - q[1]) / (q[2] - q[0]) * space.weights
    u, s, vt = np.linalg.svd(scaled - scaled.mean(0), full_matrices=False)
    want = (u * s)[:, :2] * (s[:2] ** 2 / (len(x) - 1)) ** -0.25
    got = np.array([r["features"] for r in frame.coordinates("some", space="s")[0].orderBy("cell_id").collect()])
    assert np.allclose(np.abs(got), np.abs(want))
    assert frame.spaces.first()["fitted"] and space.n_total_components == 3 and space.retained.tolist() == [True, True, False] and 0 < space.cumulative_explained_variance <= 1
    assert space.covariance_condition_number == pytest.approx((s[0] / s[1]) ** 2) and space.label.startswith("pca(")
    with pytest.raises(ValueError):
        frame.drop_mask("some")
    frame.drop_space("s").drop_mask("some")
    plain = frame.space()
    found = plain.spectrum(frame.vectors(), tail_sigma=1.0)
    z = (cells[FEATURES] - cells[FEATURES].mean()) / cells[FEATURES].std(ddof=0)
    scores = np.linalg.svd(z.to_numpy(), full_matrices=False)
    scores = scores[0] * scores[1]
    assert np.allclose(found["excess_kurtosis"], ((scores**4).mean(0) / (scores**2).mean(0) ** 2) - 3)
    with frame.using_scaler_rule(ScalerRule("identity")):
        assert frame.scaler().rule.base == "identity"
        with pytest.raises(ValueError):
            frame.set_scaler_rule(ScalerRule("robust"))
    assert frame.scaler().rule.base == "standard"


@pytest.mark.parametrize("method", ["pca", "umap"])
def test_embeddings_place_new_rows(spark, cells, method):
    frame = CellFrame(spark.createDataFrame(cells), FEATURES)
    at = frame.embed(method=method, name="e", **({"epochs": 60} if method == "umap" else {})).toPandas().set_index("cell_id").loc[cells["cell_id"]].to_numpy()
    d = ((at[:, None] - at[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    near = cells["kind"].to_numpy()[d.argsort(1)[:, :5]]
    assert (near == cells["kind"].to_numpy()[:, None]).mean() > 0.95
    again = frame.project(spark.createDataFrame(cells.head(10)), embedding="e").toPandas().set_index("cell_id").loc[list(range(10))].to_numpy()
    assert np.allclose(again, at[:10])
    assert frame.embeddings == [("all", "e")] and frame.embedding_model(name="e").method == method
    assert frame.graph_provenance().first()["space"] == "scaled"


def test_rows_beyond_the_fitted_ones_are_placed(spark, cells):
    from tessella.operators import embedding as em

    rows = spark.createDataFrame([(int(r[0]), [float(v) for v in r[1:5]]) for r in cells.itertuples(index=False)], "cell_id long, features array<double>")
    at, _, placed = em.embed(rows, method="umap", most=50, epochs=30)
    assert placed.count() == 50 and at.count() == 72


# labels carried


def test_propagation(spark, cells):
    frame = CellFrame(spark.createDataFrame(cells), FEATURES)
    known = LabelSet.from_labels(spark.createDataFrame(cells[cells["cell_id"] % 3 == 0]), "kind")
    for method, folds in (("spread", 0), ("vote", 2)):
        got = frame.propagate_labels(known, method=method, n_neighbors=6, agreement_folds=folds)
        names = {r["cell_id"]: r["name"] for r in got.labels.to_names().collect()}
        wrong = [i for i, k in zip(cells["cell_id"], cells["kind"], strict=True) if names[i] != k]
        assert all(names[i] is None for i in wrong) and len(wrong) <= (0 if method == "vote" else 6)  # diffusion reaches no cell without a mutual neighbour
        assert got.n_reference() == 24 and (got.recovery is None if method == "spread" else got.recovery.misassigned == 0 and got.self_agreement() > 0.8)
        assert set(got.frame().columns) == {"cell_id", "kind_nn", "kind_nn_id", "kind_nn_confidence"}
    frame.attach(got)
    assert "kind_nn_confidence" in frame.columns and frame.label_names == ["kind_nn"]
    new = blobs(seed=5, first_id=1000)
    placed = frame.project_labels(spark.createDataFrame(new), known, n_neighbors=5)
    assert {r["cell_id"]: r["name"] for r in placed.labels.to_names().collect()} == dict(zip(new["cell_id"], new["kind"], strict=True))
    ladder = frame.propagate_labels(known, ladder=[["m0", "m1"], ["m2"]], n_neighbors=5)
    assert ladder.rung_names == ["rung0", "rung1"] and {r["rung"] for r in ladder.rungs.collect()} == {0}
    with pytest.raises(ValueError):
        frame.add_mask("few", F.col("cell_id") < 5).propagate_labels(known, to="few")


def test_vote_and_folds_by_hand(spark):
    rows = spark.createDataFrame([(i, [float(i)], c) for i, c in enumerate([0, 0, 0, -1, 1])], "cell_id long, features array<double>, code long")
    out, recovery = pp.propagate_knn(rows, k=3)
    got = {r["cell_id"]: (r["code"], r["confidence"]) for r in out.collect()}
    assert {k: v[0] for k, v in got.items()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 1} and got[3][1] == pytest.approx(2 / 3)
    assert recovery.agreement == pytest.approx(0.75) and recovery.misassigned == pytest.approx(0.25)
    folds = pp.stratified_folds(spark.createDataFrame([(i, i % 3) for i in range(31)], "cell_id long, code long"), 4).toPandas()
    assert folds.groupby("code")["fold"].value_counts().unstack().pipe(lambda t: (t.max(1) - t.min(1)).max()) <= 1 and folds["fold"].value_counts().max() <= 8
    recovery = pp.Recovery(spark.createDataFrame([(0, 0, 0), (1, 0, 1), (2, 1, -1)], "cell_id long, truth long, predicted long"), names={0: "a", 1: "b"})
    assert [tuple(r) for r in recovery.confusion().orderBy("label").collect()] == [("a", 1, 1, 0), ("b", 0, 0, 1)] and recovery.abstained == pytest.approx(1 / 3)


def test_recovery_scores(spark, cells):
    rows = spark.createDataFrame([(int(r[0]), [float(v) for v in r[1:5]], int(r[5][1]), 1.0 + r[0] % 2, "odd" if r[0] % 2 else "even") for r in cells.itertuples(index=False)], "cell_id long, features array<double>, code long, weight double, stratum string")
    got = st.loo_recovery(rows, k=5, name="raw")
    assert got.n_labeled == 72 and got.accuracy == got.accuracy_ipw == 1.0 and got.n_abstained == 0 and got.by_stratum().count() == 2


def test_assignment(spark):
    cells = blobs(per=60, seed=3)
    frame = CellFrame(spark.createDataFrame(cells), FEATURES)
    known = LabelSet.from_labels(spark.createDataFrame(cells[cells["cell_id"] % 2 == 0]), "kind")
    got = frame.assign(known, seed=1)
    assert got.class_names == ["t0", "t1", "t2"] and sum(got.calibration_counts.values()) == sum(max(1, round(30 * 0.25)) for _ in range(3))
    names = {r["cell_id"]: r["name"] for r in got.to_labelset(0.2).to_names().collect()}
    hit = np.mean([names[i] == k for i, k in zip(cells["cell_id"], cells["kind"], strict=True)])
    assert hit > 0.6 and all(names[i] in (None, k) for i, k in zip(cells["cell_id"], cells["kind"], strict=True))
    wide = got.frame(alpha=0.2)
    assert {"p_t0", "p_t1", "p_t2", "prob_t0", "plausibility", "set_size", "assigned"} <= set(wide.columns) and wide.count() == 180
    probs = wide.toPandas()[["prob_t0", "prob_t1", "prob_t2"]]
    assert np.allclose(probs.sum(axis=1), 1) and got.coverage().count() == 3
    assert got.set_sizes().agg(F.max("set_size")).first()[0] <= 3 and got.plausibility().count() == got.cell_ids.count() == 180
    shifted = frame.assign(known, shift_covariates=["depth"], seed=1)
    assert shifted.params["shift_covariates"] == ["depth"] and shifted.p_values.count() == 540
    assessed = frame.assess_labels(known, folds=3)
    assert assessed.p_values.count() == 540 and assessed.params["folds"] == 3


def test_conditional_sets_follow_the_covariate(spark):
    rng = np.random.default_rng(0)
    t = rng.uniform(0, 1, 3000)
    cal = spark.createDataFrame([(float(a * b), float(a)) for a, b in zip(t, rng.uniform(0, 1, 3000), strict=True)], "score double, t double")
    test = spark.createDataFrame([(i, 0, s, x) for i, (s, x) in enumerate([(0.15, 0.1), (0.15, 0.9), (0.85, 0.9), (0.05, 0.1)])], "cell_id long, class_id long, score double, t double")
    assert codes_of(asg.conditional_prediction_set(cal, test, ["t"]), "inside") == {0: False, 1: True, 2: False, 3: True}
    x = np.column_stack((np.ones(500), rng.normal(size=500)))
    y = x @ [1.0, 2.0] + rng.normal(size=500)
    w = asg.pinball_fit(x, y, 0.9)
    assert abs((y <= x @ w + 1e-9).mean() - 0.9) < 0.01


def test_classifier_across_datasets(spark):
    both = pd.concat([blobs(per=30, seed=1).assign(dataset="a"), blobs(per=30, seed=2, first_id=500).assign(dataset="b")])
    frame = CellFrame(spark.createDataFrame(both), FEATURES)
    score = frame.cross_dataset_classification("kind", train="a", test="b", dataset_column="dataset")
    assert score.n_cells == 90 and score.accuracy == score.accuracy_shared == 1.0 and score.shared.filter("shared").count() == 90
    assert score.by_label().count() == 3 and score.confusion().agg(F.sum("n_cells")).first()[0] == 90
    hand = asg.TransferScore(spark.createDataFrame([(0, "x", "x"), (1, "x", "y"), (2, "z", "y")], "cell_id long, truth string, predicted string"), ["x", "y"], "a", "b")
    assert hand.accuracy == pytest.approx(1 / 3) and hand.accuracy_shared == pytest.approx(0.5)
    assert {r["truth"]: (r["in_train"], r["recall"], r["top_prediction"]) for r in hand.by_label().collect()} == {"x": (True, 0.5, "x"), "z": (False, 0.0, "y")}


# datasets


def test_join_datasets_carries_everything(spark, tmp_path):
    parts = {}
    for k, name in enumerate(("one", "two")):
        pdf = blobs(per=60, seed=k, first_id=10 * k)
        pdf[FEATURES] = pdf[FEATURES] * (1 + k) + 5 * k
        frame = CellFrame(spark.createDataFrame(pdf), FEATURES, metadata=spark.createDataFrame([("m0", "a")], "feature_id string, family string"))
        frame.add_mask("big", F.col("m0") > 0).define_features("pair", ["m0", "m1"]).set_validity(["m0"], "big")
        frame.attach(LabelSet.from_labels(frame.df, "kind"), name="type", confidence=frame.df.select("cell_id", F.lit(0.5 + k / 4).alias("confidence")))
        if k == 0:
            frame.add_mask("only", F.col("m1") > 0)
        parts[name] = frame
    with pytest.warns(UserWarning, match="only"):
        joined = CellFrame.join_datasets(parts, strata="kind", min_cells=20)
    assert joined.datasets == ["one", "two"] and joined.reference_dataset == "one" and joined.dataset_column == "dataset" and joined.stratum_column == "stratum"
    pdf = joined.df.toPandas().sort_values("cell_id")
    assert pdf["cell_id"].tolist() == [1000 + i for i in range(180)] + [2000 + i for i in range(180)] and pdf["source_cell_id"].tolist()[180] == 10
    for t in ("t0", "t1", "t2"):
        a, b = (pdf[(pdf["dataset"] == d) & (pdf["stratum"] == t)]["m0"] for d in ("one", "two"))
        assert a.mean() == pytest.approx(b.mean()) and a.std() == pytest.approx(b.std())
    assert set(joined.masks) == {"big", "only", "one", "two"} and not pdf.loc[pdf["dataset"] == "two", "_mask_only"].any()
    assert joined.collections == {"pair": ["m0", "m1"]} and joined.validity == {"m0": "big"} and joined.label_names == ["type"]
    assert pdf.groupby("dataset")["type_confidence"].first().tolist() == [0.5, 0.75] and (pdf["type"] == pdf["kind"]).all()
    raw = parts["two"].df.limit(5)
    mapped = {r["cell_id"]: r["m0"] for r in joined.harmonize(raw, "two").collect()}
    own = pdf[pdf["dataset"] == "two"].set_index("source_cell_id")["m0"]
    assert all(mapped[i] == pytest.approx(own[i]) for i in mapped)
    assert joined.dataset_scaler("two", "t0").columns == FEATURES
    ids = joined.cell_ids_for("two", spark.createDataFrame([(12,), (10,)], "source_cell_id long"))
    assert sorted(r["cell_id"] for r in ids.collect()) == [2000, 2002] and joined.source_ids().count() == 360
    with pytest.raises(KeyError):
        joined.cell_ids_for("one", spark.createDataFrame([(9999,)], "source_cell_id long"))
    split = joined.labels_by_dataset("type")
    assert split["two"].fact.count() == 180 and split["two"].names == ["t0", "t1", "t2"]
    assert joined.dataset_mixing(columns=["m0", "m1"], n_neighbors=10).count() == 1 + 2 + 2
    parts["two"].define_features("pair", ["m0"])
    with pytest.raises(ValueError):
        CellFrame.join_datasets(parts, min_cells=20)


def test_bridge(spark):
    both = pd.concat([blobs(n_types=3, per=40, seed=1).assign(d="a"), blobs(n_types=3, per=40, seed=2, first_id=1000).assign(d="b")])
    frame = CellFrame(spark.createDataFrame(both), FEATURES)
    frame.add_mask("a", F.col("d") == "a").add_mask("b", F.col("d") == "b")
    bridge = frame.transfer_bridge("a", "b", columns=FEATURES, n_neighbors=8, strata="kind")
    assert bridge.bridged_fraction() == {"a": 1.0, "b": 1.0}
    labels = {m: LabelSet.from_labels(frame.view(m), "kind") for m in ("a", "b")}
    score = bridge.score_labels(labels["a"], labels["b"])
    assert score.summary["ami"] == pytest.approx(1.0) and score.summary["efficiency"] == pytest.approx(1.0) and score.summary["reproduce_share"] == 1.0
    assert {r["verdict"]: r["a->b"] for r in score.verdicts().collect()}["reproduces"] == 3 and score.anchors().filter("kind = 'one-to-one'").count() == 3
    codes = {m: x.fact for m, x in labels.items()}
    carried = bridge.carry(codes["a"], "a")
    there, truth = codes_of(carried.codes.withColumnRenamed("tgt", "cell_id")), codes_of(codes["b"])
    assert carried.clusters == [0, 1, 2] and sum(there[i] == truth[i] for i in truth) > 110 and all(there[i] in (-1, truth[i]) for i in truth)
    found = {m: frame.cluster(m, columns=FEATURES, n_neighbors=8, resolution=[0.2, 1.5], n_times=1, seed=3) for m in ("a", "b")}
    grain = bridge.score_runs(found["a"], found["b"], band_ratio=3.0, null_draws=1)
    assert len(grain.frame) >= 1 and {"ami", "efficiency", "n_reproduces", "excess", "reproduces_excess"} <= set(grain.frame)
    best = grain.frame.sort_values("ami").iloc[-1]
    runs = {m: found[m].partitions.rows.filter(F.col("run") == int(best[f"run_{m}"])).select("cell_id", F.col("label").alias("code")) for m in ("a", "b")}
    alone = bridge.score(runs["a"], runs["b"])
    assert alone.summary["ami"] == pytest.approx(best["ami"]) and alone.clusters.filter("verdict = 'reproduces'").count() == best["n_reproduces"]
    levels = bridge.score_consensus(found["a"], found["b"], n_levels=3, null=None, band_ratio=4.0)
    assert {"height_a", "height_b"} <= set(levels.frame) and (levels.frame["ami"] > 0).all()
    with pytest.raises(ValueError):
        frame.transfer_bridge("a", "all", columns=FEATURES)


def test_grain_correspondence_by_hand():
    rows = [(0, 0, 1.0, 1.0, 4, 4, 0.9, 2.0), (0, 1, 1.0, 2.0, 4, 6, 0.5, 1.0), (1, 0, 2.0, 1.0, 8, 4, 0.4, 1.0), (1, 1, 2.0, 2.0, 8, 6, 0.8, 3.0), (2, 1, 2.0, 2.0, 9, 6, 0.6, 2.0)]
    frame = pd.DataFrame(rows, columns=["run_a", "run_b", "resolution_a", "resolution_b", "k_a", "k_b", "ami", "n_reproduces"])
    g = br.GrainCorrespondence(frame, ("a", "b"), None, 3.0)
    assert g.matched().index.tolist() == [0, 3, 4]
    pooled = g.pairs(metric="ami").set_index(["resolution_a", "resolution_b"])
    assert pooled.loc[(2.0, 2.0), "ami"] == pytest.approx(0.7) and pooled.loc[(2.0, 2.0), "ami_se"] == pytest.approx(np.std([0.8, 0.6], ddof=1) / math.sqrt(2))
    assert pooled.loc[(1.0, 1.0), "ami_se"] == pytest.approx(np.std([0.8, 0.6], ddof=1))  # the only variance stands in
    assert g.ridge()["k_a"].tolist() == [4, 8, 9] and g.ridge()["k_b"].tolist() == [4, 6, 6]
    curve = g.curve(bin_ratio=1.25)
    assert curve["n_pairs"].sum() == 3 and curve["grain"].tolist() == sorted(curve["grain"])
    with pytest.warns(UserWarning):
        band = g.suggest_band(metric="n_reproduces")
    assert band["peak"] == 2.5 and band["best_pair"]["resolution_a"] == 1.0
    with pytest.warns(UserWarning):
        other = g.complement("a", resolution_min=1.5)
    assert other["resolution_b"] == (2.0, 2.0) and other["k_a"] == (8, 9)
    with pytest.raises(ValueError):
        g.complement("a", resolution_min=99)
    assert br.GrainCorrespondence(pd.DataFrame(), ("a", "b")).pairs().empty


# shape


def test_parametrize(spark):
    rng = np.random.default_rng(2)
    t = rng.uniform(0, 1, 240)
    pdf = pd.DataFrame({"cell_id": np.arange(240), "m0": np.cos(2 * t) * 10, "m1": np.sin(2 * t) * 10, "m2": rng.normal(0, 0.05, 240)})
    pdf["t"], pdf["noise"] = t, rng.normal(size=240)
    frame = CellFrame(spark.createDataFrame(pdf), ["m0", "m1", "m2"])
    found = frame.parametrize(columns=["m0", "m1"], pca=False, orient_by="t", nuisance=["noise"])
    at = found.to_frame().toPandas().set_index("cell_id").loc[np.arange(240), "gradient"]
    assert np.corrcoef(pd.Series(t).rank(), at.rank())[0, 1] > 0.98
    assert found.intrinsic_dimension < 2 and found.loadings().first()["feature"] in ("m0", "m1") and len(found.dimension_profile) >= 2
    bins = found.bin(4)
    sizes = pd.Series(codes_of(bins.fact)).value_counts()
    assert len(sizes) == 4 and bins.names[0].startswith("gradient[0.00-")
    assert [b - a for a, b in itertools.pairwise(sorted(bins.meta))] == [1, 1, 1]
    lost = found.coordinate_for(spark.createDataFrame([(0,), (9999,)], "cell_id long")).orderBy("cell_id").collect()
    assert not math.isnan(lost[0]["coord"]) and math.isnan(lost[1]["coord"])
    frame.attach(found)
    assert "gradient" in frame.columns
    with pytest.warns(UserWarning, match="nuisance"):
        frame.parametrize(columns=["m0", "m1"], pca=False, nuisance=["t"])
    frame.score_cells(columns=["m0", "m1"], seed=1)
    assert frame.df.filter("outlier_score IS NULL").isEmpty()


def test_boundary_of_a_clustering(clustered):
    frame, found = clustered
    report = frame.boundary_report("c", distance_threshold=0.95, n_neighbors=6).toPandas()
    assert len(report) == 3 and set(report["verdict"]) == {"discrete"} and report["vote_cocluster"].eq("discrete").all()


def test_feature_relevance_against_ranks(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 3))
    x[:, 2] = x[:, 0] + 0.01 * x[:, 2]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "cell_id long, a double, b double, c double")
    z = (x - x.mean(0)) / x.std(0)
    full = ((z[:, None] - z[None]) ** 2).sum(2)

    def imbalance(d1, d2):
        out = []
        for i in range(40):
            others = [j for j in range(40) if j != i]
            near = min(others, key=lambda j: (d1[i, j], j))
            out.append(1 + sum((d2[i, j], j) < (d2[i, near], near) for j in others))
        return 2 * np.mean(out) / 40

    got = dg.feature_relevance(df, ["a", "b", "c"]).set_index("feature")
    for k, name in enumerate("abc"):
        one = (z[:, None, k] - z[None, :, k]) ** 2
        assert got.loc[name, "delta_to_full"] == pytest.approx(imbalance(one, full)) and got.loc[name, "delta_from_full"] == pytest.approx(imbalance(full, one))
    assert dg.feature_relevance(df, ["a", "b", "c"], mode="drop_one").iloc[0]["feature"] == "b"


def test_profiles(spark, cells):
    df = spark.createDataFrame(cells).withColumn("code", F.substring("kind", 2, 1).cast("long"))
    heat = dg.cluster_heatmap(df, FEATURES, top=2).toPandas()
    z = (cells[FEATURES] - cells[FEATURES].mean()) / cells[FEATURES].std(ddof=0)
    assert len(heat) == 6
    for r in heat.to_dict("records"):
        assert r["mean_z"] == pytest.approx(z.loc[cells["kind"] == f"t{r['code']}", r["feature"]].mean())
    profile = dg.column_profile(df, "m0", bins=8).toPandas()
    assert profile["n"].sum() == 72 and profile.groupby("code")["q50"].first()[1] == pytest.approx(cells.loc[cells["kind"] == "t1", "m0"].median())
    assert dg.feature_scatter(df, df.select("cell_id", "code"), "m0", "depth").count() == 72


# sessions, disk


def test_session(spark, cells, tmp_path):
    frame = CellFrame(spark.createDataFrame(cells), FEATURES)
    frame.embed(name="pca")
    ledger = store.Ledger(spark, str(tmp_path / "ledger"))
    session = Session(frame, config=AppConfig(sweep={"n_neighbors": 8, "resolution": [0.3, 1.0]}), ledger=ledger)
    session.cluster("root")
    scan, flat = session.scan("root", n_points=20)
    assert session.scan("root", n_points=20)[0] is scan and len(scan) == 20 and (flat["n_clusters"] > 1).all()
    assert session.coverage("root", resolution_min=0.5)["n_inside"] == 1
    cut = session.preview_cut("root", distance_threshold=0.95)
    assert cut["n_clusters"] == 3 and cut["sizes"] == [24, 24, 24]
    nodes, edges = session.flow("root", heights=[0.95, 0.2])
    assert nodes.groupBy("level").agg(F.sum("n_cells").alias("n")).filter("n <> 72").isEmpty() and edges.agg(F.sum("n_cells")).first()[0] in (72, None)
    with pytest.raises(ValueError):
        session.commit("root")
    session.set_cut("root", distance_threshold=0.95)
    assert session.scatter("root").filter("value IS NULL").isEmpty() and session.scatter("root", color_by="stability").count() == 72
    assert session.commit("root", label_name="type", children={"low": ["0", "1"]}) == ["low"]
    assert frame.df.filter(frame.mask("low")).count() == 48 and session.tree.children("root") == ["low"] and "type" in frame.label_names
    assert "session.commit('root'" in ledger.to_script() and ledger.frame().count() == 1
    session.rewind(0)
    assert "low" not in frame.masks and "type" not in frame.columns and session.tree.children("root") == [] and ledger.frame().count() == 0
    for k in range(3):
        ledger.append("note", "root", k=k)
    ledger.truncate(1)
    ledger.keep([1])
    assert ledger.frame().first()["detail"] == '{"k": 1}'
    with pytest.raises(ValueError):
        Session(frame, config=AppConfig(linkage_warn_cells=10)).cluster("root")


def test_jobs_levels_config(tmp_path):
    jobs = JobRunner()
    first, second = jobs.submit("one", lambda: 41 + 1), jobs.submit("bad", lambda: 1 / 0)
    assert jobs.result(first, 5) == 42
    with pytest.raises(ZeroDivisionError):
        jobs.result(second, 5)
    assert [x["status"] for x in jobs.status()] == ["done", "failed"]
    jobs.close()
    tree = LevelTree(max_resident=1)
    tree.add("root", None)
    tree.add("x", "x", "root").clustering = object()
    tree["root"].clustering = object()
    tree.touch("x")
    assert tree.touch("root") == ["x"] and tree["x"].clustering is None
    path = tmp_path / "c.toml"
    path.write_text('[session]\nfolder = "f"\n[session.sweep]\nn_times = 2\n')
    assert AppConfig.from_toml(str(path)).sweep == {"n_times": 2}
    path.write_text("[session]\nnope = 1\n")
    with pytest.raises(ValueError):
        AppConfig.from_toml(str(path))


def test_saved_with_runs_and_embeddings(spark, clustered, tmp_path):
    frame, found = clustered
    frame.embed("deep", name="e")
    frame.save(str(tmp_path), "analysis")
    back, _ = CellFrame.load(spark, str(tmp_path), "analysis")
    assert back.embeddings == [("deep", "e")] and back.clustering("c").cell_ids == found.cell_ids
    assert {tuple(r) for r in back.clustering("c").pairs.collect()} == {tuple(r) for r in found.pairs.collect()}
    arrays = {"a": np.arange(6.0).reshape(2, 3), "b": np.array([1.0, 2.0]), "c": np.array(3.0)}
    again = store.frame_arrays(store.arrays_frame(spark, arrays))
    assert all(np.array_equal(again[k], v) for k, v in arrays.items())


def test_annotated_round_trip(spark, cells):
    frame = CellFrame(spark.createDataFrame(cells), FEATURES, seed=4)
    frame.add_mask("low", F.col("depth") < 100).set_validity(["m0"], "low")
    frame.embed(name="pca")
    made = frame.to_anndata()
    assert made.X.shape == (72, 4) and made.obsm["X_pca"].shape == (72, 2) and made.obs["mask_low"].sum() == (cells["depth"] < 100).sum()
    back = CellFrame.from_anndata(spark, made)
    assert back.seed == 4 and back.validity == {"m0": "low"} and list(back.masks) == ["low"] and back.embeddings == [("all", "pca")]
    assert np.allclose(back.df.orderBy("cell_id").toPandas()[FEATURES], cells[FEATURES])
    with pytest.raises(ValueError):
        interop.to_anndata(frame, most=5)


def test_label_accessors(spark, cells):
    labels = LabelSet.from_labels(spark.createDataFrame(cells), "kind", unassigned=("t2",))
    assert labels.ids == [0, 1] and labels.names == ["t0", "t1"] and labels.n_clusters == 2 and labels.assigned.filter("assigned").count() == 48
    assert labels.decode(spark.createDataFrame([(0,), (1,), (-1,)], "code long")).filter("label IS NULL").count() == 1
    other = labels.with_codes(spark.createDataFrame([(9, 1)], "cell_id long, code long"), name="x")
    assert other.to_names().first()["name"] == "t1" and other.name == "x" and labels.codes.count() == labels.cell_ids.count() == 72
    frame = CellFrame(spark.createDataFrame(cells), FEATURES)
    flat = frame.flatten_labels([labels, LabelSet.from_labels(frame.df, "kind")], name="f", source_name="from")
    assert sorted(flat.names) == ["t0", "t1", "t2"] and flat.n_unassigned() == 0 and {r["from"] for r in frame.df.select("from").distinct().collect()} == {"kind"}
    turned = frame.reorder_labels(LabelSet.from_labels(frame.df, "kind"), "depth")
    assert turned.names == ["t2", "t1", "t0"]
    assert frame.compare("kind", "kind").first()["ari"] == 1.0
    near = frame.neighborhood_self_predictions("kind", n_neighbors=4)
    assert near.filter(F.size("predictions") != 4).isEmpty()
    assert frame.neighborhood_purity("kind", n_neighbors=4, with_mutual=True).agg(F.min("purity")).first()[0] == 1.0
    assert frame.triage_labels("kind", n_neighbors=4).filter("verdict <> 'own'").isEmpty()


def test_knn_by_cells_of_pivots_is_exact(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate((rng.normal(0, 1, (120, 3)), rng.normal(30, 0.5, (80, 3)), np.repeat([[5.0, 5.0, 5.0]], 60, 0), rng.normal(0, 1, (40, 3)) + 1e5))
    ids = rng.permutation(len(x))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    rows = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x, strict=True)], "cell_id long, features array<double>").repartition(3)
    for exclude in (True, False):
        own = d.copy()
        if exclude:
            np.fill_diagonal(own, np.inf)
        want = {(int(ids[a]), k + 1): int(ids[b]) for a in range(len(x)) for k, b in enumerate(np.lexsort((ids, own[a]))[:6])}
        got = kn.knn(rows, rows, 6, exclude_self=exclude, broadcast_bytes=16 * 3 * 40).collect()
        assert {(r["src"], r["rank"]): r["dst"] for r in got} == want


@pytest.mark.parametrize("width", [1, 2, 3])
@pytest.mark.parametrize("exclude", [True, False])
def test_boxes_give_the_same_neighbours(width, exclude, monkeypatch):
    monkeypatch.setattr(kn, "LEAF", 8)
    rng = np.random.default_rng(width)
    x = np.concatenate((rng.integers(0, 4, (150, width)) / 2, rng.normal(size=(150, width)), np.ones((60, width))))  # ties, copies
    ids = rng.permutation(len(x))
    ask = pd.DataFrame({"id": np.r_[ids, [1000]], "vec": [*x.tolist(), [9.0] * width]})
    want, got = (pd.concat(list(f(ids, x, 7, exclude)(iter([ask])))).sort_values(["src", "rank"]) for f in (kn._kernel, kn._tree_kernel))
    assert want[["src", "dst", "dist", "rank"]].to_numpy().tolist() == got[["src", "dst", "dist", "rank"]].to_numpy().tolist()
    few = pd.concat(list(kn._tree_kernel(ids[:5], x[:5], 7, exclude)(iter([ask[:5]]))))
    assert len(few) == 5 * (5 - exclude)


def test_copies_are_asked_once(monkeypatch):
    """Queries and reference rows of 50 values: what is measured does not grow with the copies."""
    measured, sqrt = [0], np.sqrt
    monkeypatch.setattr(kn.np, "sqrt", lambda x: (measured.__setitem__(0, measured[0] + np.size(x)), sqrt(x))[1])
    x = (np.arange(4000) % 50).astype(float)[:, None]
    out = pd.concat(list(kn._tree_kernel(np.arange(4000), x, 10, True)(iter([pd.DataFrame({"id": np.arange(4000), "vec": x.tolist()})]))))
    assert measured[0] < 4000 * 4000 / 50 and len(out) == 40_000 and (out["dist"] == 0).all()
    assert out[out["src"] == 0]["dst"].tolist() == [50 * i for i in range(1, 11)]


def test_split_coclustering_equals_the_whole(spark):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(i, run, int(rng.integers(-1, 2))) for i in range(60) for run in range(4)], "cell_id long, run long, label long")
    whole, split = ({(r["i"], r["j"]): r["freq"] for r in cs.coclustering(rows, block=b).collect()} for b in (5000, 7))
    assert whole == split
    with pytest.raises(ValueError):
        cs.coclustering(rows, most=10)


def _ensemble(spark, ids=lambda i: i):
    """Partitions with cells that some runs leave out, one that all do, and codes with -1 and with a cell of no run."""
    rng = np.random.default_rng(3)
    rows = [(ids(i), run, int(rng.integers(-1, 3)) if i else -1) for i in range(40) for run in range(5)]
    kind = "string" if isinstance(rows[0][0], str) else "long"
    codes = [(ids(i), int(rng.integers(-1, 3))) for i in range(41)]
    return spark.createDataFrame(rows, f"cell_id {kind}, run long, label long"), spark.createDataFrame(codes, f"cell_id {kind}, code long")


@pytest.mark.parametrize("ids", [lambda i: i * 7 % 41, lambda i: f"c{i}"])
def test_coclustering_shuffles_no_pairs(spark, ids, monkeypatch):
    rows, _ = _ensemble(spark, ids)
    by = {}
    for r in rows.collect():
        by.setdefault(r["cell_id"], {})[r["run"]] = r["label"]
    want = {}
    for i in by:
        for j in by:
            both = [r for r in range(5) if by[i][r] >= 0 and by[j][r] >= 0]
            co = sum(by[i][r] == by[j][r] for r in both)
            if i < j and co:
                want[i, j] = co / len(both)
    monkeypatch.setattr(cs, "STRIP", 20)
    for block in (5000, 6):
        got = cs.coclustering(rows, block=block)
        found = [((r["i"], r["j"]), r["freq"]) for r in got.collect()]
        assert len(found) == len(want) and dict(found) == want
        assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()  # pairs leave their tasks as they are
        assert dict((tuple(r[:2]), r[2]) for r in cs.coclustering(rows, block=block, digits=2).collect()) == {k: round(v + 1e-9, 2) for k, v in want.items()}


@pytest.mark.parametrize("normalize", [True, False])
@pytest.mark.parametrize("block", [5000, 6])
def test_strength_without_pairs(spark, normalize, block):
    rows, codes = _ensemble(spark)
    want = {r["cell_id"]: r["strength"] for r in cs.strength(cs.coclustering(rows, normalize=normalize), codes).collect()}
    assert {r["cell_id"]: r["strength"] for r in cs.strength_of(rows, codes, normalize=normalize, block=block).collect()} == pytest.approx(want)
    assert want[0] == want[40] == 0.0 and max(want.values()) > 0.5


@pytest.mark.parametrize("normalize", [True, False])
def test_block_means_without_pairs(spark, normalize):
    rows, codes = _ensemble(spark)
    want = {(r["a"], r["b"]): r["mean"] for r in cs.block_means(cs.coclustering(rows, normalize=normalize), codes).collect()}
    assert {(r["a"], r["b"]): r["mean"] for r in cs.block_means_of(rows, codes, normalize=normalize).collect()} == pytest.approx(want)
    plan = cs.block_means_of(rows, codes)._jdf.queryExecution().optimizedPlan().toString()
    assert "(i#" not in plan and "< j#" not in plan  # no table of pairs


@pytest.mark.parametrize("normalize", [True, False])
def test_soft_labels_without_pairs(spark, normalize):
    rows, codes = _ensemble(spark)
    want = {(r["cell_id"], r["code"]): r["share"] for r in cs.soft_labels(cs.coclustering(rows, normalize=normalize), codes).collect()}
    assert {(r["cell_id"], r["code"]): r["share"] for r in cs.soft_labels_of(rows, codes, normalize=normalize).collect()} == pytest.approx(want)


def test_group_quantiles(spark):
    from tessella.functions.quantiles import group_quantiles

    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": rng.integers(0, 4, 700), "v": np.round(rng.normal(size=700), 2)})
    for direct in (10**6, 20):
        got = {r["g"]: r["q"] for r in group_quantiles(spark.createDataFrame(pdf), ["g"], "v", {"q": 0.37}, direct=direct).collect()}
        assert got == pytest.approx(pdf.groupby("g")["v"].quantile(0.37).to_dict())


def test_quantile_shape_and_fuzzy_weights_against_numpy(spark):
    from statistics import NormalDist

    from tessella.functions.scalers import quantile_scaled

    x = np.random.default_rng(1).exponential(size=400)
    got = np.array([r["x"] for r in quantile_scaled(spark.createDataFrame([(float(v),) for v in x], "x double"), ["x"], n_quantiles=21).collect()])
    ranks = np.linspace(0, 1, 21)
    marks = np.quantile(x, (1 + 98 * ranks) / 100)
    shape = np.array([NormalDist().inv_cdf(min(max(r, 1e-7), 1 - 1e-7)) for r in ranks])
    assert np.allclose(got, np.interp(x, marks, shape))
    y = np.random.default_rng(2).normal(size=(40, 3))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(y)], "cell_id long, features array<double>")
    d = np.sqrt(((y[:, None] - y[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    member = np.zeros((40, 40))
    for i in range(40):
        near = np.argsort(d[i])[:6]
        rho, lo, hi = d[i, near].min(), 1e-9, 1e3
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if np.exp(-(d[i, near] - rho) / mid).sum() > np.log2(6) else (mid, hi)
        member[i, near] = np.exp(-(d[i, near] - rho) / max(lo, 1e-3 * d[i, near].mean()))
    joined = member + member.T - member * member.T
    for r in kn.fuzzy_weights(kn.knn(rows, rows, 6)).collect():
        assert r["weight"] == pytest.approx(joined[r["a"], r["b"]], abs=1e-3)


def test_readings_by_hand(spark):
    from tessella.operators import transfer as tr
    from tessella.operators import validate as va

    scores = spark.createDataFrame([(0, 0, 4, 4, 0.9), (0, 1, 4, 5, 0.5), (1, 0, 8, 4, 0.4), (1, 1, 8, 5, 0.3)], "run_a int, run_b int, k_a int, k_b int, ami double")
    assert {(r["run_a"], r["run_b"]) for r in tr.best_pairs(scores).collect()} == {(0, 0), (0, 1), (1, 0)}
    curve = {r["bin"]: (r["n_pairs"], r["mean"]) for r in tr.grain_curve(scores, ratio=2.0).collect()}
    assert curve == {2: (2, pytest.approx(0.7)), 3: (1, pytest.approx(0.3))} or sum(n for n, _ in curve.values()) == 4
    ref = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 1)], "cell_id long, code long")
    drawn = spark.createDataFrame([(0, 5), (1, 5), (2, 6), (3, 7)], "cell_id long, code long")
    assert codes_of(va.retention(ref, drawn), "kept") == {0: 0.5, 1: 0.5, 2: 0.0, 3: None}
    rows = spark.createDataFrame([("s", a, b) for a, b in [(0, 0)] * 20 + [(1, 1)] * 20] + [("small", 0, 1)] * 5 + [(None, 0, 1)] * 50, "stratum string, a long, b long")
    assert br.strata_ami(rows) == pytest.approx(1.0) and br.ami(rows.filter("stratum = 's'").select("a", "b")) == pytest.approx(1.0)
    with pytest.warns(UserWarning, match="settled"):
        step = spark.createDataFrame([(k, k + 1, 0.5) for k in range(1, 9)] + [(k + 1, k, 0.5) for k in range(9)], "src long, dst long, t double")
        tr.spread(step, spark.createDataFrame([(k, 0 if k == 0 else -1) for k in range(10)], "cell_id long, code long"), most=2)


def test_knn_far_from_the_origin_and_ties_by_id(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(150, 5))
    for offset in (0.0, 1e8):
        far = x + offset
        rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(far)], "cell_id long, features array<double>")
        d = np.sqrt(((far[:, None] - far[None]) ** 2).sum(2))
        np.fill_diagonal(d, np.inf)
        got = {(r["src"], r["rank"]): r["dst"] for r in kn.knn(rows, rows, 4).collect()}
        want = {(i, k + 1): int(j) for i in range(150) for k, j in enumerate(np.lexsort((np.arange(150), d[i]))[:4])}
        assert got == want
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in np.random.default_rng(1).permutation(100).tolist()], "cell_id long, features array<double>")
    assert [r["dst"] for r in kn.knn(same, same, 3).filter("src = 50").orderBy("rank").collect()] == [0, 1, 2]
