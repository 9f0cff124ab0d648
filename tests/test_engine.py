"""Datasets, numeric functions and algorithms on small hand-made input."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cytoplane.api import Pseudobulk, SingleCell, concat_obs, load, load_de, load_pseudobulk, ls
from cytoplane.functions import linear_models as lm
from cytoplane.functions import special
from cytoplane.functions.formula import design_matrix, polynomial_contrasts, variables
from cytoplane.operators import neighbors as nn
from cytoplane.operators.embeddings import leiden, modularity
from cytoplane.operators.pseudobulk import contrast_vector
from cytoplane.streaming.incremental import streaming_pseudobulk


@pytest.fixture()
def sc(spark):
    x = spark.createDataFrame([(0, 0, 5), (0, 1, 1), (1, 0, 2), (2, 2, 7), (4, 1, 3), (4, 2, 1)], "row_id long, col_id long, value long")
    obs = spark.createDataFrame([(0, "a", "T", "s1"), (1, "b", "T", "s2"), (2, "c", "B", "s1"), (3, "d", "B", "s2"), (4, "e", None, "s1")], "row_id long, cell string, type string, sample string")
    var = spark.createDataFrame([(0, "MT-1", 1), (1, "MALAT1", 2), (2, "G", 3), (3, "none", 4)], "col_id long, gene string, size int")
    return SingleCell(x, obs, var)


def test_empty_cell_and_unseen_gene(sc):
    got = {r["row_id"]: r for r in sc.qc_metrics().obs.collect()}
    assert got[3]["num_counts"] == 0 and got[3]["mito_fraction"] is None and got[0]["mito_fraction"] == pytest.approx(5 / 6)
    assert {r["gene"]: r["value"] for r in sc.cell("a").collect()} == {"MT-1": 5, "MALAT1": 1, "G": 0, "none": 0}


def test_names_and_keys(sc):
    assert [r["cell"] for r in sc.with_columns_obs(cell=F.lit("x")).make_obs_names_unique().obs.orderBy("row_id").collect()] == ["x", "x-1", "x-2", "x-3", "x-4"]
    assert sc.with_uns(a=1).rename_uns({"a": "b"}).uns == {"b": 1}
    with pytest.raises(ValueError):
        sc.drop_obsm("pca")
    assert sc.set_obs_names("sample").name_column("obs") == "sample"


def test_join_guards(sc, spark):
    twice = spark.createDataFrame([("s1", 1), ("s1", 2)], "sample string, v int")
    with pytest.raises(ValueError):
        sc.join_obs(twice, on="sample")
    unused = spark.createDataFrame([("zz", 1), ("zz", 2), ("s1", 3)], "sample string, v int")
    assert sc.join_obs(unused, on="sample").obs.where("v = 3").count() == 3
    with pytest.raises(ValueError):
        sc.join_obs(unused, on="sample", validate="m:1")


def test_concat_needs_unique_names(sc):
    with pytest.raises(ValueError):
        concat_obs(sc, sc)
    other = sc.with_columns_obs(cell=F.concat("cell", F.lit("2")))
    assert len(concat_obs(sc, other)) == 10


def test_storage_round_trip(sc, spark, tmp_path):
    path = f"file://{tmp_path}/set"
    sc.with_uns(a={"b": 1}).save(path)
    assert load(spark, path) == sc.with_uns(a={"b": 1})
    with pytest.raises(FileExistsError):
        sc.save(path)
    assert ls(spark, path).where("slot = 'X'").count() == 3
    pb = sc.pseudobulk("sample", "type")
    pb.save(f"file://{tmp_path}/pb")
    assert load_pseudobulk(spark, f"file://{tmp_path}/pb").shape == pb.shape == {"B": (2, 4), "T": (2, 4)}


def test_matrix_market(spark, tmp_path):
    (tmp_path / "matrix.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n%\n3 2 3\n1 1 4\n3 1 1\n2 2 9\n")
    (tmp_path / "features.tsv").write_text("i1\tA\ni2\tB\ni3\tC\n")
    (tmp_path / "barcodes.tsv").write_text("x\ny\n")
    got = load(spark, f"{tmp_path}/matrix.mtx")
    assert sorted(tuple(r) for r in got.X.collect()) == [(0, 0, 4), (0, 2, 1), (1, 1, 9)] and got.shape == (2, 3)


def test_pseudobulk_verbs(sc):
    pb = sc.pseudobulk("sample", "type")
    assert pb.keys() == ["B", "T"] and "T" in pb and len(pb) == 2
    assert pb.select_cell_types("T").keys() == ["T"] and pb.rename_cell_types({"T": "U"}).keys() == ["B", "U"]
    with pytest.raises(KeyError):
        pb["T", "nobody"]
    assert pb.filter_obs(F.col("sample") == "s1", cell_types="T").shape == {"B": (2, 4), "T": (1, 4)}
    both = pb.select_cell_types("T") | pb.select_cell_types("B")
    assert both.X.count() == pb.X.count()
    with pytest.raises(ValueError):
        pb | pb


def test_special_functions():
    assert float(special.digamma(np.array(1.0))) == pytest.approx(-0.5772156649, abs=1e-9)
    assert float(special.trigamma(np.array(1.0))) == pytest.approx(np.pi**2 / 6, abs=1e-9)
    assert special.inverse_trigamma(float(special.trigamma(np.array(3.7)))) == pytest.approx(3.7, abs=1e-6)
    assert float(special.t_two_sided(2.0, 10)) == pytest.approx(0.07338803, abs=1e-7)
    assert float(special.t_quantile(0.975, np.array([5.0]))[0]) == pytest.approx(2.570581836, abs=1e-6)
    assert float(special.binomial_log_sf(np.array([3.0]), 5, 0.5)[0]) == pytest.approx(np.log(6 / 32))


def test_design_matrix():
    t = pd.DataFrame({"g": ["b", "a", "b", "a", "c"], "x": [1.0, 2, 3, 4, 5]})
    d = design_matrix("~ g + x", t)
    assert list(d.columns) == ["(Intercept)", "gb", "gc", "x"] and d["gb"].tolist() == [1, 0, 1, 0, 0]
    assert list(design_matrix("~ 0 + g", t).columns) == ["ga", "gb", "gc"]
    assert "gb:x" in design_matrix("~ g:x", t).columns and variables("~ `a b` + c:d") == ["a b", "c", "d"]
    with pytest.raises(ValueError):
        design_matrix("~ g * x", t)
    assert np.allclose(polynomial_contrasts(3)[:, 0], [-np.sqrt(0.5), 0, np.sqrt(0.5)])
    assert contrast_vector("a - 0.5*b", ["a", "b", "c"]).tolist() == [1, -0.5, 0]


def test_linear_model_finds_the_changed_gene(spark):
    rng = np.random.default_rng(1)
    rows = [("T", f"s{s}", f"g{g}", int(rng.poisson(200 * (4 if g == 0 and s % 2 else 1)))) for s in range(10) for g in range(60)]
    x = spark.createDataFrame(rows, "cell_type string, sample string, gene string, value long")
    obs = spark.createDataFrame([("T", f"s{s}", "cd"[s % 2]) for s in range(10)], "cell_type string, sample string, arm string")
    pb = Pseudobulk(x, obs, x.select("cell_type", "gene").distinct()).library_size()
    de = pb.DE("~ arm")
    top = de.get_hits(num_top_hits=1).first()
    assert top["gene"] == "g0" and top["logFC"] == pytest.approx(2, abs=0.3) and top["coefficient"] == "armd"
    assert de.groups == {"T": ["c", "d"]} and de.get_num_hits().first()["num_hits"] >= 1
    assert pb.DE("~ 0 + arm", contrasts={"d-c": "armd - armc"}, robust=True).get_hits(num_top_hits=1).first()["gene"] == "g0"
    sizes = [r["library_size"] for r in pb.obs.collect()]
    assert np.exp(np.mean(np.log(np.array(sizes)))) > 0


def test_regression_residuals():
    rng = np.random.default_rng(0)
    d = np.column_stack([np.ones(8), rng.normal(size=8)])
    left = lm.residuals(rng.normal(size=(8, 3)), d)
    assert np.allclose(d.T @ left, 0)
    with pytest.raises(ValueError):
        lm.residuals(left, np.ones((8, 2)))


def test_exact_and_partitioned_neighbours(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 8))
    t = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "row_id long, value array<float>")
    d = ((v.astype(np.float32)[:, None] - v.astype(np.float32)[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = {i: set(np.argsort(r)[:5].tolist()) for i, r in enumerate(d)}
    got = nn.nearest(t, t, 5, same=True).toPandas().groupby("i").j.apply(set).to_dict()
    assert got == want
    c, _ = nn.kmeans(t, 10, init="k-means||")
    near = nn.nearest(t, t, 5, c, probes=5, same=True).toPandas().groupby("i").j.apply(set).to_dict()
    assert np.mean([len(near[i] & want[i]) / 5 for i in want]) > 0.9


def test_communities():
    blocks = np.repeat([0, 1, 2], 12)
    i, j = np.where((blocks[:, None] == blocks[None]) & ~np.eye(36, dtype=bool))
    e = (np.append(i, [0, 12, 12, 24]), np.append(j, [12, 0, 24, 12]), np.ones(len(i) + 4))
    label = leiden(e, 36)
    assert len(set(label)) == 3 and all(len(set(label[blocks == b])) == 1 for b in range(3))
    assert modularity(e, label) > 0.6


def test_streaming_sums(spark, tmp_path):
    spark.createDataFrame([("T", "s", "g", 2), ("T", "s", "g", 3)], "cell_type string, sample string, gene string, value long").write.parquet(f"{tmp_path}/in")
    src = spark.readStream.schema("cell_type string, sample string, gene string, value long").parquet(f"{tmp_path}/in")
    q = streaming_pseudobulk(src).writeStream.outputMode("complete").format("memory").queryName("sums").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT value FROM sums").first()[0] == 5


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_de_storage(spark, tmp_path):
    from cytoplane.api import DE

    de = DE(spark.createDataFrame([("T", "c", "g", 0.1, 0.2)], "cell_type string, coefficient string, gene string, p double, FDR double"))
    de.save(f"file://{tmp_path}/de")
    assert load_de(spark, f"file://{tmp_path}/de") == de and de.groups is None


def test_doublet_pairs_of_all_genes(spark):
    import duckdb

    from cytoplane.plans import catalog

    d = "/root/testdata/sf0.01"
    want = duckdb.sql(f"WITH x AS (SELECT DISTINCT l_orderkey r, l_partkey c FROM '{d}/lineitem.parquet') SELECT a.c, b.c, count(*) FROM x a JOIN x b ON a.r = b.r AND a.c < b.c GROUP BY 1, 2").fetchall()
    got = [tuple(r) for r in catalog.QUERIES["doublet_pair_counts"](spark, d).select("a", "b", "n").collect()]
    assert sorted(got) == sorted(want) and max(r[1] for r in got) > 200


def test_neighbors_of_skewed_vectors(spark):
    """A hot cell and many tiny ones far away: every query has its k, and nearly all of them are the right ones."""
    rng = np.random.default_rng(4)
    v = np.vstack([rng.normal(size=(300, 4)), *(rng.normal(size=(2, 4)) * 0.1 + 100 * rng.normal(size=4) for _ in range(30))])
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "row_id long, value array<double>")
    c = np.vstack([v[:1], v[300::2]])
    got, want = ({(r["i"], r["j"]) for r in nn.nearest(table, table, 10, x, probes=2, same=True).collect()} for x in (c, None))
    assert len(got) == len(want) == 10 * len(v)
    assert len(got & want) >= 0.9 * len(want)


def test_formulas_with_functions():
    t = pd.DataFrame({"a": [1.0, 2, 4, 8, 16], "g": list("xyxyx"), "n": [3, 5, 7, 9, 12]})
    assert variables("~ g + log2(a) + I(n^2 + a):g") == ["g", "a", "n"]
    got = design_matrix("~ g + log2(a) + log10(n + 1)", t)
    assert list(got.columns) == ["(Intercept)", "gy", "log2(a)", "log10(n + 1)"]
    assert got["log2(a)"].tolist() == [0, 1, 2, 3, 4] and np.allclose(got["log10(n + 1)"], np.log10(t.n + 1))
    with pytest.raises(ValueError):
        design_matrix("~ log2(a)", t.assign(a=[0.0, 1, 2, 3, 4]))
    with pytest.raises(ValueError):
        design_matrix("~ log2(z)", t)


def test_de_by_type_and_with_functions(spark):
    from cytoplane.plans import catalog

    pb = catalog.bulk(spark, "/root/testdata/sf0.01").filter_obs(F.col("treatment") != "P").library_size()
    first, second = pb.keys()[:2]
    pb = pb.select_cell_types(first, second)
    whole = pb.de("~ treatment + log2(library_size) + log2(num_cells)", group=False, return_voom_info=False).table
    assert {r["cell_type"] for r in whole.select("cell_type").distinct().collect()} == {first, second}
    assert whole.where("p < 0 or p > 1 or p is null").count() == 0 and whole.select("coefficient").distinct().first()[0].startswith("treatment")
    own = pb.de({first: "~ treatment", second: "~ treatment + log2(num_cells)"}, group=False, return_voom_info=False).table
    one = pb.DE("~ treatment", group=False, return_voom_info=False).table
    values = lambda t: sorted((r["gene"], round(r["logFC"], 9)) for r in t.where(F.col("cell_type") == first).collect())
    assert values(own) == values(one)


def _dense(sc):
    x = sc.X.toPandas().pivot(index="row_id", columns="col_id", values="value").fillna(0.0)
    return x.to_numpy(float), x.index.to_numpy()


def test_components_are_those_of_a_decomposition(spark):
    """PCA of one dataset and of two together against the singular values of the scaled matrix."""
    from cytoplane.plans import catalog

    parts = catalog.coarse(spark, "/root/testdata/sf0.001").normalize().split_by_obs("treatment")
    first, second = (parts[t] for t in "FO")
    both = first.concat_obs(second)
    m, ids = _dense(both)
    cells = both.obs.count()
    m = np.vstack([m, np.zeros((cells - len(m), m.shape[1]))])  # cells without counts
    z = (m - m.mean(0)) / m.std(0, ddof=1)
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    one = both.pca(num_PCs=4, hvg_column=None).obsm["pca"].orderBy("row_id").toPandas()
    got = np.stack(one.value)
    assert np.allclose(np.sort((got**2).sum(0))[::-1], s[:4] ** 2, rtol=1e-4)
    a, b = first.pca(second, num_PCs=4, hvg_column=None)
    joint = np.vstack([np.stack(t.obsm["pca"].orderBy("row_id").toPandas().value) for t in (a, b)])
    assert len(joint) == cells and np.allclose(np.sort((joint**2).sum(0))[::-1], s[:4] ** 2, rtol=1e-4)
    assert a.obsm["pca"].join(first.obs.select("row_id"), "row_id", "left_anti").isEmpty()


def test_integration_of_two_datasets(spark):
    """Two shifted copies of the same groups lie together after the correction."""
    rng = np.random.default_rng(2)
    centre = np.array([[3.0, 0, 0, 1], [0, 3, 0, 1], [0, 0, 3, 1]])
    sets = []
    for k in range(2):
        group = np.arange(150) % 3
        v = centre[group] + 0.2 * rng.normal(size=(150, 4)) + k * np.array([0, 0, 0, 2.0])
        obs = spark.createDataFrame([(i, f"{k}-{i}", int(g)) for i, g in enumerate(group)], "row_id long, cell string, kind int")
        var = spark.createDataFrame([(0, "g")], "col_id long, gene string")
        sets.append(SingleCell(None, obs, var, obsm={"pca": spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "row_id long, value array<float>")}))
    a, b = sets[0].harmonize(sets[1], num_clusters=3, seed=1)
    means = [np.stack(t.obsm["harmony"].orderBy("row_id").toPandas().value)[np.arange(150) % 3 == 1].mean(0) for t in (a, b)]
    assert np.linalg.norm(means[0] - means[1]) < 0.8 and a.uns["harmony_objective"] == b.uns["harmony_objective"]
    with pytest.raises(ValueError):
        sets[0].harmonize()


def test_doublet_scores(spark):
    """Against the definition, gene pair by gene pair and cell by cell."""
    from cytoplane.functions.special import binomial_log_sf

    rng = np.random.default_rng(3)
    m = rng.random((60, 7)) < rng.uniform(0.2, 0.8, 7)
    x = spark.createDataFrame([(int(i), int(j), 1) for i, j in zip(*np.nonzero(m))], "row_id long, col_id long, value long")
    obs = spark.createDataFrame([(i, f"c{i}") for i in range(60)], "row_id long, cell string")
    var = spark.createDataFrame([(j, f"g{j}") for j in range(7)], "col_id long, gene string")
    got = SingleCell(x, obs, var).find_doublets(num_genes=7, doublet_fraction=0.2).obs.orderBy("row_id").toPandas()
    want, p = np.zeros(60), m.mean(0)
    for a in range(7):
        for b in range(a):
            one = int((m[:, a] ^ m[:, b]).sum())
            s = -binomial_log_sf(np.array([one - 1.0]), 60, np.array([p[a] * (1 - p[b]) + (1 - p[a]) * p[b]]))[0] if one else 0.0
            want += s * (m[:, a] & m[:, b])
    assert np.allclose(got.doublet_score, want, rtol=1e-5) and got.doublet.sum() == 12
    assert set(np.flatnonzero(got.doublet)) <= set(np.argsort(-want)[:14])


def test_kmeans_fills_empty_cells(spark):
    """Two of three starts fall on one vector's copies; the third group still gets a centroid."""
    rng = np.random.default_rng(5)
    v = np.vstack([np.zeros((200, 2)), 5 + 0.1 * rng.normal(size=(3, 2)), np.array([[0.0, 9.0]] * 2)])
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "row_id long, value array<double>")
    c, cells = nn.kmeans(table, 3)
    assert cells.select("cell").distinct().count() == 3 and len(c) == 3


def test_pseudobulk_guards(spark, tmp_path):
    x = spark.createDataFrame([("01", "a", "g", 3), ("01", "b", "g", 4), ("2", "a", "g", 1)], "cell_type string, sample string, gene string, value long")
    obs = spark.createDataFrame([("01", "a", 1), ("01", "b", 2), ("2", "a", 3)], "cell_type string, sample string, num_cells int")
    var = spark.createDataFrame([("01", "g"), ("2", "g")], "cell_type string, gene string")
    pb = Pseudobulk(x, obs, var)
    pb.save(f"file://{tmp_path}/pb")
    assert load_pseudobulk(spark, f"file://{tmp_path}/pb").keys() == ["01", "2"]
    assert pb["01", F.col("num_cells") > 1].obs_names.collect()[0]["sample"] == "b"
    with pytest.raises(ValueError):
        Pseudobulk(x, obs.union(spark.createDataFrame([("2", "z", 1)], obs.schema)), var).library_size()
