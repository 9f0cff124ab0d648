"""Packed matrices, Lanczos components, positions, levels, batches and neighbours against slow versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cytoplane.api import Pseudobulk, SingleCell, load
from cytoplane.functions.formula import design_matrix
from cytoplane.functions.special import local_regression
from cytoplane.operators import lanczos, packed, verbs
from cytoplane.operators import neighbors as nn
from cytoplane.operators.packed import Packed


def dataset(spark, m, genes=None, **obs):
    """A dataset of a dense matrix; genes without names are g0, g1, ..."""
    i, j = np.nonzero(m)
    whole = np.issubdtype(m.dtype, np.integer)
    x = spark.createDataFrame(pd.DataFrame({"row_id": i, "col_id": j, "value": m[i, j]}), f"row_id long, col_id long, value {'long' if whole else 'double'}")
    cells = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(len(m)), "cell": [f"c{k}" for k in range(len(m))]} | obs))
    var = spark.createDataFrame([(k, (genes or [f"g{j}" for j in range(m.shape[1])])[k]) for k in range(m.shape[1])], "col_id long, gene string")
    return SingleCell(x, cells, var)


def entries(x):
    return sorted(map(tuple, x.select("row_id", "col_id", "value").collect()))


# -- packed rows ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block, stretch", [(1 << 16, 500_000), (4, 3)])
def test_packed_rows(spark, block, stretch, monkeypatch):
    monkeypatch.setattr(packed, "BLOCK", block)
    monkeypatch.setattr(packed, "STRETCH", stretch)
    rng = np.random.default_rng(0)
    raw = [(int(a), int(b), int(c)) for a, b, c in zip(rng.integers(0, 9, 200), rng.integers(0, 14, 200), rng.integers(-1, 3, 200))]
    x = spark.createDataFrame(raw, "row_id long, col_id long, value long").repartition(3)
    csr = Packed.of(x)
    assert entries(csr.to_long()) == sorted(raw) and csr.nnz == 200
    assert entries(csr.tocsc().to_long()) == sorted(raw) and entries(csr.tocsc().tocsr().to_long()) == sorted(raw)
    assert csr.has_sorted_indices and not csr.has_canonical_format
    sums = {}
    for a, b, c in raw:
        sums[a, b] = sums.get((a, b), 0) + c
    folded = csr.tocsc().sum_duplicates()
    assert folded.has_canonical_format and entries(folded.to_long()) == sorted((*k, v) for k, v in sums.items())
    assert entries(folded.eliminate_zeros().tocsr().to_long()) == sorted((*k, v) for k, v in sums.items() if v)
    assert all(r["indices"][-1] // block == r["block"] == r["indices"][0] // block for r in csr.tocsc().rows.collect())
    none = Packed.of(x.where("row_id < 0"))
    assert none.tocsc().sum_duplicates().eliminate_zeros().to_long().isEmpty() and none.nnz == 0 and none.has_canonical_format


def test_sorted_flags(spark):
    rows = spark.createDataFrame([(0, 0, [3, 1], [1.0, 2.0])], "major long, block long, indices array<long>, values array<double>")
    assert not Packed(rows).has_sorted_indices and not Packed(rows).has_canonical_format


# -- Lanczos ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("cells, genes, k", [(300, 20_000, 12), (400, 60, 10)])
def test_components_equal_the_decomposition(spark, cells, genes, k):
    """Sparse counts with structure, a constant gene, a gene without counts and empty cells."""
    rng = np.random.default_rng(1)
    level = rng.gamma(0.4, 1.0, genes) * 0.15
    group = rng.integers(0, 6, cells)
    m = rng.poisson(level * np.where(rng.random((6, genes)) < 0.1, 6, 1)[group]).astype(float)
    m[:, 0], m[:, 1], m[5], m[9] = 1.0, 0.0, 0.0, 0.0
    m[[5, 9], 0] = 1.0
    m[9] = 0.0
    sd = m.std(0, ddof=1)
    z = (m - m.mean(0)) / np.maximum(sd, 1e-8)
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    sc = dataset(spark, m)
    got = np.stack(sc.pca(num_PCs=k, hvg_column=None, tolerance=1e-9).obsm["pca"].orderBy("row_id").toPandas().value)
    assert got.shape == (cells, k)
    assert np.allclose(np.linalg.norm(got, axis=0), s[:k], rtol=1e-6)
    assert np.allclose(np.abs((got / s[:k] * u[:, :k]).sum(0)), 1, atol=1e-5)
    from cytoplane.operators.embeddings import standardised

    rows, mean, dev = standardised(sc, sc.var, cells)
    for direct in (32 << 20, 0):
        lanczos.DIRECT_BYTES, before = direct, lanczos.DIRECT_BYTES
        y = rng.normal(size=(genes, 3))
        one = lanczos.normal_product(rows, y, mean, 1 / np.maximum(dev, 1e-8), cells)
        lanczos.DIRECT_BYTES = before
        assert np.allclose(one, z.T @ (z @ y), rtol=1e-9, atol=1e-6)
    value, vectors = lanczos.singular_vectors(rows, mean, 1 / np.maximum(dev, 1e-8), cells, 4, block=2, subspace=9, tolerance=1e-9)
    assert np.allclose(value, s[:4], rtol=1e-9) and np.allclose(vectors.T @ vectors, np.eye(4))
    with pytest.raises(RuntimeError):
        lanczos.singular_vectors(rows, mean, 1 / np.maximum(dev, 1e-8), cells, 4, max_passes=1, block=2)


def test_components_of_low_rank(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(40, 2)) @ rng.normal(size=(2, 15))
    got = dataset(spark, m).pca(num_PCs=10, hvg_column=None).obsm["pca"].toPandas()
    assert len(got) == 40 and len(got.value.iloc[0]) == 2


# -- positions --------------------------------------------------------------------------------------------------------


def test_numbered_rows(spark):
    rng = np.random.default_rng(3)
    t = spark.createDataFrame([(int(k), rng.choice(["a", "b", None]), int(rng.integers(5))) for k in range(500)], "id long, g string, v long").repartition(7)
    got = verbs.numbered(t, [F.desc("v"), F.asc("id")], ["g"]).toPandas()
    assert len(got) == 500
    for _, part in got.groupby("g", dropna=False):
        order = part.sort_values("position")
        assert order.position.tolist() == list(range(len(part)))
        assert order[["v", "id"]].apply(tuple, axis=1).tolist() == sorted(part[["v", "id"]].apply(tuple, axis=1), key=lambda x: (-x[0], x[1]))
    assert verbs.numbered(t.where("id < 0"), ["id"]).isEmpty()


@pytest.mark.parametrize("rows, cols", [(slice(2, 9), slice(None)), (slice(None, None, -2), [4, 0, -1, 4]), (3, slice(-3, None)), (-1, -2), ([True, False] * 6, [0]), (slice(9, 2), [1]), (slice(10, 1, -3), slice(None, None, 3)), ([], slice(None))])
def test_matrix_indexing(spark, rows, cols):
    m = np.random.default_rng(4).integers(0, 3, (12, 7))
    sc = dataset(spark, m)
    as_rows, as_cols = ([x] if isinstance(x, int) else x for x in (rows, cols))
    want = m[as_rows][:, as_cols] if len(np.arange(12)[as_rows]) else np.zeros((0, 0), int)
    assert entries(sc.X_at((rows, cols))) == sorted((int(i), int(j), int(want[i, j])) for i, j in zip(*np.nonzero(want)))


def test_matrix_indexing_errors(spark):
    sc = dataset(spark, np.ones((3, 2), int))
    for item in ((5,), (-4,), ([True, False],), (slice(None), 2)):
        with pytest.raises(IndexError):
            sc.X_at(item)
    with pytest.raises(TypeError):
        sc.X_at(([1.5],))
    with pytest.raises(ValueError):
        sc.X_at(([None, 1],))
    with pytest.raises(ValueError):
        sc[[0, 0]]
    with pytest.raises(KeyError):
        sc[:, "no such gene"]
    assert sc[-1, "g1"].shape == (1, 1) and sc[["c0", "c2"], [False, True]].obs_names.count() == 2 and len(sc[F.col("row_id") > 0]) == 2


@pytest.fixture()
def pb(spark):
    rng = np.random.default_rng(5)
    x, obs, var = [], [], []
    for t, samples, genes in (("A/1", 6, 5), ("B", 3, 4)):
        obs += [(t, f"s{k}", "x" if k % 2 else "y", k) for k in range(samples)]
        var += [(t, f"g{k}") for k in range(genes)]
        x += [(t, f"s{i}", f"g{j}", int(v)) for i in range(samples) for j in range(genes) if (v := rng.integers(1, 60))]
    return Pseudobulk(spark.createDataFrame(x, "cell_type string, sample string, gene string, value long"), spark.createDataFrame(obs, "cell_type string, sample string, kind string, n int"), spark.createDataFrame(var, "cell_type string, gene string"))


def names(t, column):
    return sorted((r["cell_type"], r[column]) for r in t.select("cell_type", column).distinct().collect())


def test_pseudobulk_indexing(pb):
    assert names(pb[:, 0].obs, "sample") == [("A/1", "s0"), ("B", "s0")]
    assert names(pb[:, -1].X, "sample") == [("A/1", "s5"), ("B", "s2")]
    assert names(pb["A/1", 1:5:2].obs, "sample") == [("A/1", "s1"), ("A/1", "s3")]
    assert names(pb[:, ::-2].obs, "sample") == [("A/1", "s1"), ("A/1", "s3"), ("A/1", "s5"), ("B", "s0"), ("B", "s2")]
    assert names(pb["A/1", "s1":"s3"].obs, "sample") == [("A/1", "s1"), ("A/1", "s2")]
    assert names(pb[["B"], [True, False, True], ["g3", "g0"]].X, "gene") == [("B", "g0"), ("B", "g3")]
    assert names(pb[:, F.col("kind") == "x", -2:].X, "gene") == [("A/1", "g3"), ("A/1", "g4"), ("B", "g2"), ("B", "g3")]
    assert pb[:, :, 1].shape == {"A/1": (6, 1), "B": (3, 1)} and pb["B", 5:].shape == {} and pb[:] == pb
    for item, kind in (((slice(None), 4), IndexError), ((slice(None), [True, False]), IndexError), (("C",), KeyError), ((slice(None), "s4"), KeyError), ((slice(None), slice("s4", None)), KeyError), ((slice(0, 1),), ValueError), ((slice(None), [0, 0]), ValueError), ((slice(None), [1.5]), TypeError)):
        with pytest.raises(kind):
            pb[item]


# -- levels -----------------------------------------------------------------------------------------------------------


def test_levels(spark, pb, tmp_path):
    sc = dataset(spark, np.ones((4, 2), int), kind=["b", "a", "b", None]).categorical_obs("kind", ["b", "unused", "a"])
    assert verbs.levels(sc.obs, "kind") == ["b", "unused", "a"]
    kept = sc.filter_obs(F.col("row_id") < 3).rename_obs({"kind": "k"}).select_obs("k")
    assert verbs.levels(kept.obs, "k") == ["b", "unused", "a"]
    sc.save(f"file://{tmp_path}/s")
    assert verbs.levels(load(spark, f"file://{tmp_path}/s").obs, "kind") == ["b", "unused", "a"]
    assert verbs.levels(sc.categorical_obs("kind").obs, "kind") == ["a", "b"]
    joined = sc.join_obs(sc.obs.select(F.col("cell"), F.col("kind").alias("theirs")), on="cell").obs
    assert verbs.levels(joined, "theirs") == ["b", "unused", "a"]
    assert verbs.levels(sc.cast_obs({"kind": "binary"}).obs, "kind") is None
    for given in (["a"], ["a", "b", "a"], ["a", "b", None]):
        with pytest.raises(ValueError):
            sc.categorical_obs("kind", given)
    other = sc.with_columns_obs(cell=F.concat("cell", F.lit("x")))
    assert verbs.levels(sc.concat_obs(other.categorical_obs("kind", ["z", "a", "b"])).obs, "kind") == ["b", "unused", "a", "z"]
    plain = other.with_columns_obs(kind=F.concat("kind", F.lit("")))
    assert verbs.levels(sc.concat_obs(plain).obs, "kind") is None
    bulk = sc.with_columns_obs(s=F.col("cell"), t=F.lit("T")).pseudobulk("s", "t")
    assert verbs.levels(bulk.obs, "kind") == ["b", "unused", "a"]
    table = pd.DataFrame({"kind": ["y", "x", "y", "x"], "n": [0, 1, 2, 3]})
    assert list(design_matrix("~ kind", table, levels={"kind": ["y", "x"]}).columns) == ["(Intercept)", "kindx"]
    assert list(design_matrix("~ n", table.assign(n=[0, 1, 1, 2], k=0), levels={"n": [1, 0, 2]}).columns) == ["(Intercept)", "n0", "n2"]


def test_reference_level_changes_the_design(pb):
    sized = pb.library_size()
    one = sized.categorical_obs("kind", ["x", "y"]).de("~ kind", group=False, strict=True, return_voom_info=False).table.toPandas()
    two = sized.categorical_obs("kind", ["y", "x"]).de("~ kind", group=False, strict=True, return_voom_info=False).table.toPandas()
    assert set(one.coefficient) == {"kindy"} and set(two.coefficient) == {"kindx"}
    both = one.merge(two, on=["cell_type", "gene"])
    assert np.allclose(both.logFC_x, -both.logFC_y) and np.allclose(both.p_x, both.p_y)


# -- batches ----------------------------------------------------------------------------------------------------------


def slow_hvg(m, batches, num_genes):
    """Ranks batch by batch in numpy."""
    ranks = []
    for b in sorted(set(batches)):
        x = m[np.array(batches) == b].astype(float)
        n, mean, var = len(x), x.mean(0), x.var(0, ddof=1)
        sd = np.zeros(len(mean))
        ok = var > 0
        sd[ok] = np.sqrt(10 ** local_regression(np.log10(mean[ok]), np.log10(var[ok]), 0.3))
        v = np.array([(np.minimum((x[:, g] - mean[g]) / sd[g], np.sqrt(n)) ** 2).sum() / (n - 1) if sd[g] > 0 else 0.0 for g in range(len(mean))])
        order = np.lexsort((np.arange(len(v)), -v))
        ranks.append(np.argsort(order) + 1)
    r = np.array(ranks, float)
    top = r <= num_genes
    median = [np.median(r[top[:, g], g]) if top[:, g].any() else np.inf for g in range(r.shape[1])]
    return sorted(range(r.shape[1]), key=lambda g: (-top[:, g].sum(), median[g], np.median(r[:, g]), g))[:num_genes]


@pytest.mark.parametrize("batched", [False, True])
def test_variable_genes(spark, batched):
    rng = np.random.default_rng(6)
    m = rng.poisson(rng.gamma(1, 2, 40), (90, 40))
    m[:, 7] = 0
    batch = rng.choice(["p", "q", "r"], 90).tolist()
    m[np.array(batch) == "q", 11] = 0  # a gene that one batch lacks
    twice = ["A"] * 3 + [f"g{k}" for k in range(37)]  # names recur
    sc = dataset(spark, m, genes=twice, batch=batch)
    got = sc.hvg(num_genes=9, batch_column="batch" if batched else None).var.toPandas()
    assert len(got) == 40
    want = slow_hvg(m, batch if batched else ["one"] * 90, 9)
    ranked = got[got.highly_variable].sort_values("highly_variable_rank")
    assert ranked.highly_variable_rank.tolist() == list(range(1, 10)) and ranked.col_id.tolist() == want
    assert got[~got.highly_variable].highly_variable_rank.isna().all()
    with pytest.raises(ValueError):
        sc.hvg(sc)
    a, b = (s.hvg(t, num_genes=5)[0] for s, t in [(sc.make_var_names_unique(),) * 2] * 2)
    assert a.var.where("highly_variable").count() == 5 and verbs.same_rows(a.var, b.var)


def test_names_that_recur_are_no_pseudobulk(spark):
    sc = dataset(spark, np.ones((4, 2), int), genes=["A", "A"]).with_columns_obs(s=F.lit("s"), t=F.lit("t"))
    with pytest.raises(ValueError):
        sc.pseudobulk("s", "t")
    assert sc.make_var_names_unique().pseudobulk("s", "t").X.count() == 2



def test_doublets_by_batch_are_those_of_each_batch(spark):
    rng = np.random.default_rng(7)
    m = (rng.random((80, 12)) < rng.uniform(0.2, 0.8, 12)).astype(int) * rng.integers(1, 3, (80, 12))
    batch = rng.choice(["p", "q"], 80).astype(object)
    batch[3] = None
    sc = dataset(spark, m, batch=batch)
    for how in ({"doublet_fraction": 0.2}, {}):
        together = sc.find_doublets("batch", num_genes=6, **how).obs.toPandas().set_index("row_id")
        assert pd.isna(together.doublet_score[3]) and pd.isna(together.doublet[3])
        for b in "pq":
            alone = sc.filter_obs(batch=b).find_doublets(num_genes=6, **how).obs.toPandas().set_index("row_id")
            assert np.allclose(alone.doublet_score, together.doublet_score[alone.index])
            assert (alone.doublet == together.doublet[alone.index].astype(bool)).all()
            if how:
                assert alone.doublet.sum() == int(0.2 * len(alone))


# -- neighbours -------------------------------------------------------------------------------------------------------


def test_closest_in_blocks(monkeypatch):
    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 3, (60, 4)).astype(float) + 1e6, rng.integers(0, 3, (90, 4)).astype(float) + 1e6  # ties, far from 0
    want = np.array([sorted(range(90), key=lambda j: (((a[i] - b[j]) ** 2).sum(), j))[:7] for i in range(60)])
    for rows, side in ((512, 4096), (7, 11), (1, 90)):
        monkeypatch.setattr(nn, "ROWS", rows)
        monkeypatch.setattr(nn, "SIDE", side)
        i, j, d = nn.closest(a, b, 7)
        assert (j.reshape(60, 7) == want).all() and (i == np.repeat(np.arange(60), 7)).all()
        assert np.array_equal(d, ((a[i] - b[j]) ** 2).sum(1))
    assert len(nn.closest(a, b[:3], 7)[0]) == 180 and len(nn.closest(a[:0], b, 7)[0]) == 0


def test_shared_neighbours_of_hubs(spark):
    """A cell that is in every neighbourhood, and one in most."""
    rng = np.random.default_rng(9)
    lists = {i: [0, 1, *rng.choice(np.arange(2, 60), 4, replace=False).tolist()] for i in range(60)}
    lists = {i: [j for j in l if j != i] for i, l in lists.items()}
    table = spark.createDataFrame([(i, l) for i, l in lists.items()], "row_id long, value array<long>")
    for least in (1, 2, 3, 4):
        want = {}
        for i in lists:
            for j in lists:
                x, y = {i, *lists[i]}, {j, *lists[j]}
                if i != j and len(x & y) >= least:
                    want[i, j] = np.float32(len(x & y) / len(x | y))
        assert {(r["i"], r["j"]): np.float32(r["weight"]) for r in nn.shared(table, least).collect()} == want


def test_neighbor_pairs_need_whole_lists(spark):
    rows = [(i, [(i + k) % 9 for k in range(1, 8)], [float(k * k) for k in range(1, 8)]) for i in range(9)]
    make = lambda rows: (spark.createDataFrame([r[:2] for r in rows], "row_id long, value array<long>"), spark.createDataFrame([(r[0], r[2]) for r in rows], "row_id long, value array<float>"))
    got = nn.neighbor_pairs(*make(rows), 5).where("i = 0").orderBy("rank").collect()
    assert [r["j"] for r in got] == [1, 2, 3, 4, 5] and got[1]["scaled"] == pytest.approx(4 / 25)
    for wrong in ([(0, rows[0][1][:5], rows[0][2][:5]), *rows[1:]], [(0, [0, *rows[0][1][1:]], rows[0][2]), *rows[1:]], rows[1:]):
        with pytest.raises(ValueError):
            nn.neighbor_pairs(*make(wrong), 5)


def test_parallel_start_of_skewed_vectors(spark):
    """One large group and many small ones far away: random starts miss most of these."""
    rng = np.random.default_rng(10)
    small = [rng.normal(c, 0.05, (4, 3)) for c in rng.uniform(20, 60, (11, 3))]
    v = np.vstack([rng.normal(0, 1, (900, 3)), *small])
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "row_id long, value array<double>")
    cost = {}
    for init in ("random", "k-means||"):
        c, cells = nn.kmeans(table, 12, init=init, max_iter=5)
        cell = cells.orderBy("row_id").toPandas().cell.to_numpy()
        cost[init] = ((v - c[cell]) ** 2).sum()
        assert len(c) == 12 and len(cell) == len(v) and (cell == nn.closest(v, c, 1)[1]).all()
    assert cost["k-means||"] <= cost["random"]
    few = spark.createDataFrame([(i, [float(i % 2)]) for i in range(10)], "row_id long, value array<double>")
    assert len(nn.kmeans(few, 5, init="k-means||")[0]) == 2


def test_fractions_take_the_ceiling(spark):
    sc = dataset(spark, np.ones((5, 3), int), kind=["a", "a", "b", "b", "b"])
    assert len(sc.subsample_obs(fraction=0.25)) == 2 and len(sc.subsample_obs(fraction=0.25, by_column="kind")) == 2
    assert len(sc.subsample_obs(n=3, by_column="kind")) == 3 and sc.subsample_var(fraction=0.5).var.count() == 2


def test_genes_without_counts_have_no_sizes(pb):
    with pytest.raises(ValueError):
        Pseudobulk(pb.X.where("not (cell_type = 'B' and gene = 'g1')"), pb.obs, pb.var).library_size()


# -- integration block by block ---------------------------------------------------------------------------------------


def slow_blocks(v, batch, block, y, sigma, theta, alpha, rounds, steps):
    """The published block-wise order in numpy, with the soft clusters stored."""
    unit = lambda m: m / np.linalg.norm(m, axis=-1, keepdims=True)
    n, names = len(v), sorted(set(batch))
    phi = np.stack([batch == b for b in names], 1).astype(float)
    share = phi.mean(0)
    z = v.copy()
    r = np.exp(2 / sigma * (unit(z) @ y.T - 1))
    r /= r.sum(1, keepdims=True)
    trail = []
    for _ in range(rounds):
        for _ in range(steps):
            y = unit(r.T @ unit(z))
            for k in sorted(set(block)):
                own = block == k
                o = r[~own].T @ phi[~own]
                e = np.outer(r[~own].sum(0), share)
                ratio = ((e + 1) / (o + e + 1)) ** theta
                new = np.exp(2 / sigma * (unit(z[own]) @ y.T - 1)) * (phi[own] @ ratio.T)
                r[own] = new / new.sum(1, keepdims=True)
            o, e = r.T @ phi, np.outer(r.sum(0), share)
            trail.append((2 * r * (1 - unit(z) @ y.T)).sum() + sigma * (r * np.log(np.maximum(r, 1e-12))).sum() + sigma * (theta * o * np.log((o + e + 1) / (e + 1))).sum())
        out = z.copy()
        o, e = r.T @ phi, np.outer(r.sum(0), share)
        design = np.hstack([np.ones((n, 1)), phi])
        for c in range(len(y)):
            ridge = np.diag([0.0, *(alpha * e[c])])
            w = np.linalg.solve(design.T @ (r[:, c, None] * design) + ridge, design.T @ (r[:, c, None] * z))
            out -= r[:, c, None] * (phi @ w[1:])
        z = out
    return z, trail


def test_integration_block_by_block(spark):
    rng = np.random.default_rng(12)
    group = np.arange(160) % 3
    batch = rng.choice(["p", "q"], 160)
    v = np.array([[3.0, 0, 0, 1], [0, 3, 0, 1], [0, 0, 3, 1]])[group] + 0.3 * rng.normal(size=(160, 4)) + (batch == "q")[:, None] * np.array([0, 0, 0, 1.5])
    v = v.astype(np.float32).astype(float)
    obs = spark.createDataFrame([(i, f"c{i}", str(b)) for i, b in enumerate(batch)], "row_id long, cell string, batch string")
    var = spark.createDataFrame([(0, "g")], "col_id long, gene string")
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "row_id long, value array<float>")
    sc = SingleCell(None, obs, var, obsm={"pca": table})
    done = sc.harmonize("batch", num_clusters=3, num_blocks=4, max_iter=2, max_cluster_iter=3, tolerance=0.0, seed=5)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    start = nn.kmeans(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(unit)], "row_id long, value array<double>"), 3, seed=5)[0]
    block = np.array([r[0] for r in obs.orderBy("row_id").select(F.pmod(F.xxhash64("row_id", F.lit(5)), F.lit(4))).collect()])
    want, trail = slow_blocks(v, batch, block, start / np.linalg.norm(start, axis=1, keepdims=True), 0.1, 2.0, 0.2, 2, 3)
    got = np.stack(done.obsm["harmony"].orderBy("row_id").toPandas().value)
    steps = done.uns["harmony_steps"]
    assert np.allclose(steps, trail, rtol=1e-4) and np.allclose(got, want, atol=1e-3)
    assert all(b <= a + 1e-9 * abs(a) for k in (0, 3) for a, b in zip(steps[k : k + 3], steps[k + 1 : k + 3]))


# -- Matrix Market ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("parts, whole", [(1, True), (9, True), (9, False)])
def test_matrix_market_round_trip(spark, tmp_path, parts, whole):
    rng = np.random.default_rng(13)
    m = rng.integers(0, 3, (40, 30))
    m[4], m[:, 7] = 0, 0  # an empty cell, a gene without counts
    m = m if whole else m * 0.25
    sc = dataset(spark, m)
    far = lambda c: (F.col(c) * 7 + 3).alias(c)  # noqa: E731  ids need not be dense
    sc = SingleCell(sc.X.select(far("row_id"), far("col_id"), "value").repartition(parts), sc.obs.withColumn("row_id", far("row_id")).repartition(parts), sc.var.withColumn("col_id", far("col_id")).repartition(parts))
    path = f"file://{tmp_path}/m"
    sc.save_mtx(path)
    text = (tmp_path / "m/matrix.mtx").read_text().split("\n")
    assert text[0] == f"%%MatrixMarket matrix coordinate {'integer' if whole else 'real'} general" and text[1] == f"30 40 {np.count_nonzero(m)}"
    cells = [int(line.split()[1]) for line in text[2:] if line]
    assert cells == sorted(cells) and len(cells) == np.count_nonzero(m)
    assert (tmp_path / "m/barcodes.tsv").read_text().split() == [f"c{k}" for k in range(40)]
    back = load(spark, f"{path}/matrix.mtx")
    assert back.shape == (40, 30) and back.X.schema["value"].dataType.typeName() == ("long" if whole else "double")
    assert entries(back.X) == sorted((int(i), int(j), m[i, j]) for i, j in zip(*np.nonzero(m)))
    assert [r["gene"] for r in back.var.orderBy("col_id").collect()] == [f"g{k}" for k in range(30)]
    with pytest.raises(FileExistsError):
        sc.save_mtx(path)
    sc.save_mtx(path, overwrite=True)
    with pytest.raises(ValueError):
        sc.with_columns_var(gene=F.lit("a\tb")).save_mtx(path, overwrite=True)


def test_matrix_market_kinds(spark, tmp_path):
    (tmp_path / "features.tsv").write_text("a\nb\n")
    (tmp_path / "barcodes.tsv").write_text("x\ny\nz\n")
    file = tmp_path / "m.mtx"
    for head, lines, want in (("integer", "2 3 2\n2 3 2\n1 1 5\n", [(0, 0, 5), (2, 1, 2)]), ("pattern", "2 3 2\n2 3\n1 1\n", [(0, 0, 1), (2, 1, 1)]), ("real", "2 3 1\n1 2 0.5\n", [(1, 0, 0.5)]), ("integer", "2 3 0\n", [])):
        file.write_text(f"%%MatrixMarket matrix coordinate {head} general\n% made by hand\n{lines}")
        assert entries(load(spark, f"file://{file}").X) == want
    file.write_text("%%MatrixMarket matrix array real general\n2 3\n")
    with pytest.raises(ValueError):
        load(spark, f"file://{file}")


# -- sizes and labels -------------------------------------------------------------------------------------------------


def slow_sizes(m, trim=0.3, sum_trim=0.05):
    """Trimmed means of M values, sample by sample, of samples x genes."""
    total = m.sum(1)
    upper = np.quantile(m, 0.75, axis=1) / total
    ref = np.argmax(np.sqrt(m).sum(1)) if np.median(upper) < 1e-20 else np.argmin(np.round(np.abs(upper - upper.mean()), 12))
    f = []
    for x, n in zip(m, total):
        both = (x > 0) & (m[ref] > 0)
        a, b = x[both] / n, m[ref][both] / total[ref]
        ratio, level = np.log2(a / b), (np.log2(a) + np.log2(b)) / 2
        if np.abs(ratio).max() < 1e-6:
            f.append(1.0)
            continue
        var = (n - x[both]) / n / x[both] + (total[ref] - m[ref][both]) / total[ref] / m[ref][both]
        k = both.sum()
        rank = lambda v: pd.Series(v).rank().to_numpy()
        keep = (rank(ratio) >= int(k * trim) + 1) & (rank(ratio) <= k - int(k * trim)) & (rank(level) >= int(k * sum_trim) + 1) & (rank(level) <= k - int(k * sum_trim))
        f.append(2 ** ((ratio[keep] / var[keep]).sum() / (1 / var[keep]).sum()))
    f = np.array(f)
    return total * f / np.exp(np.log(f).mean())


def test_library_sizes_against_a_slow_version(spark):
    rng = np.random.default_rng(14)
    types, x, obs, var = {}, [], [], []
    for t, samples, genes, low in (("A", 7, 120, 30), ("B", 5, 60, 1), ("one", 1, 9, 20)):
        level = rng.gamma(0.5, low * 4, genes) + 0.3
        m = rng.poisson(level * rng.uniform(0.4, 2.5, (samples, 1)) * np.where(rng.random((samples, genes)) < 0.1, 8, 1)).astype(float)
        m = m[:, m.sum(0) > 0]
        types[t] = m
        obs += [(t, f"s{i}") for i in range(samples)]
        var += [(t, f"g{j:03}") for j in range(m.shape[1])]
        x += [(t, f"s{i}", f"g{j:03}", int(m[i, j])) for i, j in zip(*np.nonzero(m))]
    pb = Pseudobulk(spark.createDataFrame(x, "cell_type string, sample string, gene string, value long"), spark.createDataFrame(obs, "cell_type string, sample string"), spark.createDataFrame(var, "cell_type string, gene string"))
    got = pb.library_size().obs.orderBy("cell_type", "sample").toPandas()
    for t, m in types.items():
        assert np.allclose(got[got.cell_type == t].library_size, slow_sizes(m) if len(m) > 1 else m.sum(1), rtol=1e-9)
