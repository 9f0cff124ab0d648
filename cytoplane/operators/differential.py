"""Linear models of pseudobulk counts, gene by gene: what differential expression and regressing out have in common.

Counts are packed into a row a type and gene. A model needs, besides a gene's row, only the samples' columns: designs, sizes
and groups of a type are made on the driver (a row a sample) and ride to the tasks. So genes are fitted wherever they
are, some hundred at a time, and no task holds a type. What genes share goes through two small steps: the trend of
variances by type and group, fitted over a row a gene and kept as a line of at most some hundred points, and the
moderation of variances by type, over a row a gene."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import linear_models as lm
from ..functions.formula import design_matrix, terms
from .packed import flat_lists, lists
from .staging import staged

#: Genes that are fitted at a time.
GENES = 512
TESTS = "cell_type string, coefficient string, gene string, logFC double, SE double, LCI double, UCI double, AveExpr double, p double"


@dataclass
class Model:
    """What the fits of a type need of its samples, in the order of their names."""

    samples: list[str]
    design: np.ndarray
    columns: list[str]
    sizes: np.ndarray | None = None
    #: name of a panel -> its samples' places and the columns of the design that these can bear
    panels: dict[str, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    tested: list[str] = field(default_factory=list)
    contrasts: np.ndarray | None = None


def gene_rows(x: DataFrame, var: DataFrame) -> DataFrame:
    """cell_type, gene, samples, values: a row for each gene of each type, with its stored entries; written once."""
    pair = F.struct("sample", F.col("value").cast("double").alias("value"))
    per = x.groupBy("cell_type", "gene").agg(F.array_sort(F.collect_list(pair)).alias("e"))  # as many as there are samples at most
    rows = var.select("cell_type", "gene").join(per, ["cell_type", "gene"], "left")
    none = lambda c, t: F.coalesce(c, F.array().cast(f"array<{t}>"))
    return staged(rows.select("cell_type", "gene", none(F.col("e.sample"), "string").alias("samples"), none(F.col("e.value"), "double").alias("values")), "genes")


def mapped(rows: DataFrame, models: dict[str, Model], work: Callable[[str, Model, pa.Array, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """work(type, model, genes, genes x samples) of the rows whose type has a model, some genes at a time."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {t: pd.Index(m.samples) for t, m in models.items()}
        for b in batches:
            kinds = np.array(b.column(0).to_pylist(), object)
            for t in dict.fromkeys(kinds.tolist()):
                if t not in models:
                    continue
                own = b.filter(pa.array(kinds == t))
                for lo in range(0, own.num_rows, GENES):
                    part = own.slice(lo, GENES)
                    values, off = flat_lists(part.column(3))
                    at = index[t].get_indexer(part.column(2).flatten().to_pylist()) if len(values) else np.zeros(0, int)
                    m = np.zeros((part.num_rows, len(models[t].samples)))
                    row = np.repeat(np.arange(part.num_rows), np.diff(off))
                    m[row[at >= 0], at[at >= 0]] = values[at >= 0]
                    yield from work(t, models[t], part.column(1), m)

    return rows.select("cell_type", "gene", "samples", "values").mapInArrow(each, schema)


def residuals(rows: DataFrame, models: dict[str, Model]) -> DataFrame:
    """cell_type, sample, gene, value: what the models leave of each gene."""

    def work(t: str, model: Model, genes: pa.Array, m: np.ndarray) -> Iterator[pa.RecordBatch]:
        left = lm.residuals(m.T, model.design).T
        n = len(model.samples)
        yield pa.RecordBatch.from_arrays([pa.array([t] * m.size, pa.string()), pa.array(model.samples * len(m), pa.string()), genes.take(pa.array(np.repeat(np.arange(len(m)), n))), pa.array(left.ravel())], names=["cell_type", "sample", "gene", "value"])

    return mapped(rows, models, work, "cell_type string, sample string, gene string, value double")


def weighted_model(obs: pd.DataFrame, formula: str, coefficient, contrasts: dict | None, group, cat: tuple[str, ...], ordn: tuple[str, ...], size_column: str, levels: dict[str, list], vector: Callable[[str, list[str]], np.ndarray]) -> Model:
    """The model of a type's samples (obs, by name); ValueError if it can't be fitted."""
    design = design_matrix(formula, obs, cat, ordn, levels)
    if np.linalg.matrix_rank(design.to_numpy()) < design.shape[1]:
        raise ValueError("the design is rank-deficient")
    columns = list(design.columns)
    tested = [coefficient] if isinstance(coefficient, str) else list(coefficient or [])
    if not tested and not contrasts:
        tested = [next(c for c in columns if c != "(Intercept)")]
    if lacking := [c for c in tested if c not in columns]:
        raise ValueError(f"no coefficients {lacking}")
    groups = None
    if isinstance(group, str):
        groups = obs[group].astype(str).to_numpy()
    elif group is not False:
        asked = tested or list(contrasts.values())
        behind = [v for term in terms(formula)[1] for v in term if v in obs.columns and any(v in c for c in asked) and (v in cat or not pd.api.types.is_numeric_dtype(obs[v]))]
        if behind:
            groups = obs[list(dict.fromkeys(behind))].astype(str).agg("_".join, axis=1).to_numpy()
    if groups is not None and (pd.Series(groups).value_counts() < 2).any():
        raise ValueError("every group needs two samples")
    x = design.to_numpy()
    model = Model(list(obs.index), x, columns, obs[size_column].to_numpy(float), tested=tested)
    if groups is None or len(set(groups)) < 2:
        model.panels["all"] = np.arange(len(x)), x
    else:
        for g in dict.fromkeys(groups.tolist()):
            at = np.flatnonzero(groups == g)
            part = x[at][:, lm.independent(x[at])]
            model.panels[g] = at, part if part.shape[1] < len(at) else np.ones((len(at), 1))
    if contrasts:
        model.contrasts = np.stack([vector(c, columns) for c in contrasts.values()], 1)
        model.columns = model.tested = list(contrasts)
    return model


def scatter(rows: DataFrame, models: dict[str, Model]) -> DataFrame:
    """cell_type, panel, gene, x, y: mean log counts and roots of standard deviations of the genes that a panel has."""

    def work(t: str, model: Model, genes: pa.Array, m: np.ndarray) -> Iterator[pa.RecordBatch]:
        for name, (at, design) in model.panels.items():
            x, y, seen = lm.voom_scatter(m[:, at], design, model.sizes[at])
            keep = pa.array(seen)
            yield pa.RecordBatch.from_arrays([pa.array([t] * int(seen.sum()), pa.string()), pa.array([name] * int(seen.sum()), pa.string()), genes.filter(keep), pa.array(x[seen]), pa.array(y[seen])], names=["cell_type", "panel", "gene", "x", "y"])

    return mapped(rows, models, work, "cell_type string, panel string, gene string, x double, y double")


def trends(points: DataFrame) -> dict[tuple[str, str], tuple[np.ndarray, np.ndarray]]:
    """The line of each type's panels, by the points where it bends."""

    def fit(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(["x", "y"], kind="stable")
        x, y = lm.lowess_line(table.x.to_numpy(), table.y.to_numpy()) if len(table) > 1 else (np.zeros(0), np.zeros(0))
        return pd.DataFrame({"cell_type": [key[0]], "panel": [key[1]], "x": [x], "y": [y]})

    got = points.groupBy("cell_type", "panel").applyInPandas(fit, "cell_type string, panel string, x array<double>, y array<double>").collect()
    return {(r["cell_type"], r["panel"]): (np.array(r["x"]), np.array(r["y"])) for r in got if r["x"]}


def fits(rows: DataFrame, models: dict[str, Model], lines: dict) -> DataFrame:
    """cell_type, gene, s2, df, mean, beta, unscaled and weights of each gene; written once."""

    def work(t: str, model: Model, genes: pa.Array, m: np.ndarray) -> Iterator[pa.RecordBatch]:
        y, w = np.empty(m.shape), np.empty(m.shape)
        for name, (at, design) in model.panels.items():
            y[:, at], w[:, at] = lm.voom_weights(m[:, at], design, model.sizes[at], *lines[t, name])
        got = lm.fit(y, w, model.design)
        if model.contrasts is not None:
            got = lm.contrast(got, model.contrasts)
        width = lambda x: lists(np.ascontiguousarray(x).ravel(), np.arange(len(x) + 1) * x.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array([t] * len(m), pa.string()), genes, pa.array(got["s2"]), pa.array(got["df"]), pa.array(got["mean"]), width(got["beta"]), width(got["unscaled"]), width(w)], names=["cell_type", "gene", "s2", "df", "mean", "beta", "unscaled", "weights"])

    return staged(mapped(rows, models, work, "cell_type string, gene string, s2 double, df double, mean double, beta array<double>, unscaled array<double>, weights array<double>"), "fits")


def moderated(fitted: DataFrame, models: dict[str, Model], robust: bool) -> DataFrame:
    """TESTS of the fits: variances of a type are moderated together, over a row a gene."""
    asked = {t: ([m.columns.index(c) for c in m.tested], m.tested) for t, m in models.items()}

    def work(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        places, names = asked[key[0]]
        table = table.sort_values("gene", kind="stable")
        model = {"s2": table.s2.to_numpy(), "df": table.df.to_numpy(), "mean": table["mean"].to_numpy()} | {c: np.stack(table[c]) for c in ("beta", "unscaled")}
        got = lm.moderate(model, robust)
        return pd.concat([pd.DataFrame({"cell_type": key[0], "coefficient": c, "gene": table.gene.to_numpy(), **{n: got[n][:, k] for n in ("logFC", "SE", "LCI", "UCI")}, "AveExpr": got["AveExpr"], "p": got["p"][:, k]}) for k, c in zip(places, names)])

    return fitted.select("cell_type", "gene", "s2", "df", "mean", "beta", "unscaled").groupBy("cell_type").applyInPandas(work, TESTS)


def weight_table(fitted: DataFrame, models: dict[str, Model]) -> DataFrame:
    """cell_type, sample, gene, weight."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, t in enumerate(b.column(0).to_pylist()):
                names = models[t].samples
                yield pa.RecordBatch.from_arrays([pa.array([t] * len(names), pa.string()), pa.array(names, pa.string()), pa.array([b.column(1)[k].as_py()] * len(names), pa.string()), pa.array(b.column(2)[k].values)], names=["cell_type", "sample", "gene", "weight"])

    return fitted.select("cell_type", "gene", "weights").mapInArrow(work, "cell_type string, sample string, gene string, weight double")


def plot_points(points: DataFrame, lines: dict) -> DataFrame:
    """cell_type, panel, xy_x, xy_y, line_x, line_y: the line at each gene's mean."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(2))
            keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            line = np.empty(len(x))
            for key in dict.fromkeys(keys):
                own = np.array([k == key for k in keys])
                line[own] = np.interp(x[own], *lines[key])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), b.column(2), pa.array(line)], names=["cell_type", "panel", "xy_x", "xy_y", "line_x", "line_y"])

    return points.select("cell_type", "panel", "x", "y").mapInArrow(work, "cell_type string, panel string, xy_x double, xy_y double, line_x double, line_y double")
