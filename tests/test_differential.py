"""Differential expression gene by gene against whole matrices, and robust moderation against a slow version."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cytoplane.api import DE, Pseudobulk, load_de
from cytoplane.functions import linear_models as lm
from cytoplane.functions import special
from cytoplane.functions.formula import design_matrix
from cytoplane.operators import differential


@pytest.fixture(scope="module")
def pb(spark):
    """Two types of other samples and genes, with zeros, and one that is too small to be fitted."""
    rng = np.random.default_rng(1)
    x, obs, var = [], [], []
    for t, samples, genes in (("A", 9, 700), ("B/2", 7, 90), ("few", 2, 5)):
        level = rng.gamma(1, 30, genes)
        obs += [(t, f"s{k:02}", "cd"[k % 2], float(rng.normal())) for k in range(samples)]
        var += [(t, f"g{k}") for k in range(genes)]
        x += [(t, f"s{i:02}", f"g{j}", int(v)) for i in range(samples) for j in range(genes) if (v := rng.negative_binomial(5, 5 / (5 + level[j] * (3 if j < 20 and i % 2 else 1))))]
    table = lambda rows, names: spark.createDataFrame(rows, names).repartition(3)
    x = table(x, "cell_type string, sample string, gene string, value long")
    seen = x.select("cell_type", "gene").distinct()
    var = table(var, "cell_type string, gene string").join(seen, ["cell_type", "gene"], "left_semi")
    return Pseudobulk(x, table(obs, "cell_type string, sample string, arm string, age double"), var).library_size()


def whole(pb, t):
    """counts (genes x samples), names and samples of one type."""
    x = pb.dense().where(F.col("cell_type") == t).toPandas().pivot(index="gene", columns="sample", values="value")
    obs = pb.obs.where(F.col("cell_type") == t).toPandas().set_index("sample").loc[x.columns]
    return x.to_numpy(float), list(x.index), obs


@pytest.mark.parametrize("group, robust", [(False, False), (None, False), (False, True)])
def test_tests_and_weights_are_those_of_whole_matrices(pb, group, robust, monkeypatch):
    monkeypatch.setattr(differential, "GENES", 64)
    de = pb.de("~ arm + age", coefficient=["armd", "age"], group=group, robust=robust)
    table, weights = de.table.toPandas(), de.voom_weights.toPandas()
    assert set(table.cell_type) == {"A", "B/2"}  # the small one is left out
    for t in ("A", "B/2"):
        counts, genes, obs = whole(pb, t)
        design = design_matrix("~ arm + age", obs[["arm", "age"]]).to_numpy()
        sizes = obs.library_size.to_numpy(float)
        if group is False:
            y, w, points = lm.voom(counts, design, sizes)
        else:
            y, w, panels = lm.voom_by_group(counts, obs.arm.to_numpy(), design, sizes)
            points = pd.concat(panels.values())
        got = lm.moderate(lm.fit(y, w, design), robust)
        own = weights[weights.cell_type == t].pivot(index="gene", columns="sample", values="weight")
        assert np.allclose(own.loc[genes, obs.index].to_numpy(), w, rtol=1e-8)
        for k, c in ((1, "armd"), (2, "age")):
            mine = table[(table.cell_type == t) & (table.coefficient == c)].set_index("gene").loc[genes]
            for name in ("logFC", "SE", "LCI", "UCI", "p"):
                assert np.allclose(mine[name], got[name][:, k], rtol=1e-7, atol=1e-12), (t, c, name)
            assert np.allclose(mine.AveExpr, got["AveExpr"])
        mine = de.plot_voom(t).toPandas()
        assert np.allclose(np.sort(mine.xy_x), np.sort(points.xy_x)) and np.allclose(np.sort(mine.line_y), np.sort(points.line_y))
    with pytest.raises(ValueError):
        pb.de("~ arm + age", group=group, strict=True)


def test_contrasts_and_storage(spark, pb, tmp_path):
    de = pb.de("~ 0 + arm", contrasts={"d-c": "armd - armc"}, group=False)
    one = pb.de("~ arm", group=False, return_voom_info=False)
    both = de.table.toPandas().merge(one.table.toPandas(), on=["cell_type", "gene"])
    assert np.allclose(both.logFC_x, both.logFC_y) and np.allclose(both.p_x, both.p_y) and one.voom_weights is None
    path = f"file://{tmp_path}/de"
    de.save(path)
    back = load_de(spark, path)
    assert back == de and back.groups == {"A": ["all"], "B/2": ["all"]} and de != one
    assert back != DE(de.table, de.voom_plot_data, de.voom_weights.withColumn("weight", F.col("weight") + 1))
    with pytest.raises(ValueError):
        DE(de.table, de.voom_plot_data)
    with pytest.raises(ValueError):
        pb.de("~ arm", coefficient="no such", strict=True)


def test_residuals_are_those_of_whole_matrices(pb):
    kept = pb.select_cell_types("A", "B/2").log_cpm()
    got = kept.regress_out("~ arm + age").X.toPandas()
    for t in ("A", "B/2"):
        y, genes, obs = whole(kept, t)
        want = lm.residuals(y.T, design_matrix("~ arm + age", obs[["arm", "age"]]).to_numpy()).T
        mine = got[got.cell_type == t].pivot(index="gene", columns="sample", values="value").loc[genes, obs.index]
        assert np.allclose(mine.to_numpy(), want, atol=1e-9)
    with pytest.raises(ValueError):
        kept.regress_out("~ arm + age + arm:age + log2(library_size) + sqrt(library_size) + abs(age) + I(age^2)")


def slow_robust(s2, df, low=0.05, high=0.1):
    """The published steps with sums over a fine grid instead of quadrature, and a search over a grid of priors."""
    n, z = len(s2), np.log(s2)
    grid = np.linspace(-60, 60, 600_001)

    def moments(d2):
        if math.isinf(d2):
            log = df / 2 * math.log(df / 2) - math.lgamma(df / 2) + df / 2 * grid - df / 2 * np.exp(np.minimum(grid, 50))
        else:
            log = math.lgamma((df + d2) / 2) - math.lgamma(df / 2) - math.lgamma(d2 / 2) + df / 2 * math.log(df / d2) + df / 2 * grid - (df + d2) / 2 * np.log1p(df / d2 * np.exp(np.minimum(grid, 700)))
        mass = np.exp(log) * (grid[1] - grid[0])
        below = np.cumsum(mass)
        a, b = np.interp([low, 1 - high], below, grid)
        drawn = np.clip(grid, a, b)
        mean = (mass * drawn).sum()
        return mean, (mass * (drawn - mean) ** 2).sum(), below

    cut = int(high * n)
    centre = np.mean(sorted(z)[cut : n - cut])
    q = np.quantile(z - centre, [low, 1 - high])
    drawn = np.array([min(max(v - centre, q[0]), q[1]) for v in z])
    var = drawn.var(ddof=1)
    if var <= moments(math.inf)[1]:
        prior = math.inf
    else:
        candidates = np.exp(np.linspace(np.log(0.5), np.log(200), 800))
        prior = candidates[np.argmin([abs(math.log(var / moments(d)[1])) for d in candidates])]
    mean, _, below = moments(prior)
    scale = math.exp(centre + drawn.mean() - mean)
    tail = 1 - np.interp(np.log(s2 / scale), grid, below)
    return prior, scale, tail


@pytest.mark.parametrize("outliers", [0, 40])
def test_robust_prior_against_a_slow_version(outliers):
    rng = np.random.default_rng(outliers + 2)
    s2 = 0.3 * rng.f(4, 7, 2000)
    s2[:outliers] *= 300
    each, scale = lm.robust_prior(s2, 4.0)
    prior, slow_scale, tail = slow_robust(s2, 4.0)
    assert np.median(each) == pytest.approx(prior, rel=0.1) if outliers == 0 else np.max(each) == pytest.approx(prior, rel=0.05)
    assert scale == pytest.approx(slow_scale, rel=0.02) and scale == pytest.approx(0.3, rel=0.1)
    plain, wide = lm.log_moments(s2, np.full(2000, 4.0))
    if outliers:
        assert plain < 0.75 * each.max() and np.median(each[:outliers]) < 0.3 * each.max()
        order = np.argsort(tail)
        assert (np.diff(each[order]) >= -1e-6).mean() > 0.99  # a gene further out never has more degrees of freedom
    else:
        assert plain == pytest.approx(7, rel=0.2) and (each >= 0.8 * each.max()).mean() > 0.9
    assert wide > 0


def test_robust_prior_of_one_variance():
    """Genes of one true variance, some of them far off: the prior is infinite, but for these."""
    rng = np.random.default_rng(4)
    s2 = 0.5 * rng.chisquare(6, 1500) / 6
    s2[:10] *= 400
    each, scale = lm.robust_prior(s2, 6.0)
    assert scale == pytest.approx(0.5, rel=0.05) and np.median(each) > 100 and each[:10].max() < np.median(each)


def test_distributions():
    """Against known values and sums over a grid."""
    assert special.f_tail(2.5, 4, 10.0) == pytest.approx(0.109375) and special.f_quantile(0.95, 4, 10.0) == pytest.approx(3.47805, rel=1e-5)
    assert special.upper_gamma(2.0, 3.0) == pytest.approx(math.exp(-3) * 4) and special.upper_gamma(0.5, 4.0) == pytest.approx(math.erfc(2.0))
    assert special.upper_gamma(30.0, 2.0) == pytest.approx(1.0) and special.f_quantile(0.95, 3, np.inf) == pytest.approx(7.814728 / 3, rel=1e-6)
    x = np.linspace(1e-6, 80, 800_001)
    for d2 in (9.0, np.inf):
        mass = special.f_density(x, 5.0, d2) * (x[1] - x[0])
        assert mass[x > 2].sum() == pytest.approx(float(special.f_tail(2.0, 5.0, d2)), rel=1e-3)
