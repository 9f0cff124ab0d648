"""Pseudobulk: counts summed by sample and cell type, with tables about samples and genes; and DE, tables of tests.

X is long: (cell_type, sample, gene, value). Absent rows are zeros: analyses that need them (quantiles, means) fill them
in for the samples and genes of each type. obs has (cell_type, sample, ...), var (cell_type, gene, ...)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formula import design_matrix, variables
from ..functions.testing import bonferroni, with_fdr
from . import differential, verbs
from .cell_analysis import sum_by
from .cells import SingleCell
from .differential import Model
from .staging import staged

KEYS = {"obs": ["cell_type", "sample"], "var": ["cell_type", "gene"]}


@dataclass(frozen=True)
class Pseudobulk:
    X: DataFrame
    obs: DataFrame
    var: DataFrame
    num_threads: int = -1

    def __post_init__(self) -> None:
        for table, cols in ((self.X, ["cell_type", "sample", "gene", "value"]), (self.obs, KEYS["obs"]), (self.var, KEYS["var"])):
            if any(c not in table.columns for c in cols):
                raise ValueError(f"a table lacks {cols}")

    # -- slots and keys -------------------------------------------------------------------------------------------

    @property
    def obs_names(self) -> DataFrame:
        return self.obs.select(*KEYS["obs"])

    @property
    def var_names(self) -> DataFrame:
        return self.var.select(*KEYS["var"])

    def keys(self) -> list[str]:
        return sorted(r[0] for r in self.obs.select("cell_type").distinct().collect())

    def _of(self, cell_type: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        return tuple(t.where(F.col("cell_type") == cell_type) for t in (self.X, self.obs, self.var))

    def values(self) -> list[tuple[DataFrame, DataFrame, DataFrame]]:
        return [self._of(k) for k in self.keys()]

    def items(self) -> list[tuple[str, tuple[DataFrame, DataFrame, DataFrame]]]:
        return [(k, self._of(k)) for k in self.keys()]

    def iter_X(self):
        return (x for x, _, _ in self.values())

    def iter_obs(self):
        return (o for _, o, _ in self.values())

    def iter_var(self):
        return (v for _, _, v in self.values())

    def __iter__(self):
        return iter(self.keys())

    def __contains__(self, cell_type: str) -> bool:
        return not self.obs.where(F.col("cell_type") == cell_type).limit(1).isEmpty()

    def __len__(self) -> int:
        return self.obs.select("cell_type").distinct().count()

    @property
    def shape(self) -> dict[str, tuple[int, int]]:
        n = lambda t: {r["cell_type"]: r["count"] for r in t.groupBy("cell_type").count().collect()}
        samples, genes = n(self.obs), n(self.var)
        return {k: (samples[k], genes.get(k, 0)) for k in sorted(samples)}

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Pseudobulk) and self.num_threads == other.num_threads and all(verbs.same_rows(a, b) for a, b in ((self.X, other.X), (self.obs, other.obs), (self.var, other.var)))

    __hash__ = None

    def __or__(self, other: Pseudobulk) -> Pseudobulk:
        if both := set(self.keys()) & set(other.keys()):
            raise ValueError(f"both have {sorted(both)}")
        return Pseudobulk(*(a.unionByName(b, allowMissingColumns=True) for a, b in ((self.X, other.X), (self.obs, other.obs), (self.var, other.var))))

    def __repr__(self) -> str:
        return "Pseudobulk with\n" + "\n".join(f"    {k}: {s:,} samples, {g:,} genes" for k, (s, g) in self.shape.items())

    def __getitem__(self, item) -> Pseudobulk:
        """pb[types], pb[types, samples], pb[types, samples, genes]. types: a name, a list of names, or the full slice.
        samples and genes, for each type by itself: places in the order of the names (ints, negative ones from the end;
        slices; lists of ints; lists of booleans as long as each type has rows), names, lists of names, slices of names
        (the end is left out), or conditions on obs or var. A place that is named twice raises ValueError."""
        parts = item if isinstance(item, tuple) else (item,)
        if not 1 <= len(parts) <= 3:
            raise IndexError("from one to three indices")
        out = self
        if isinstance(parts[0], slice):
            if parts[0] != slice(None):
                raise ValueError("cell types have no order: only the full slice")
        elif isinstance(parts[0], Column):
            out = out._types(parts[0])
        else:
            wanted = [parts[0]] if isinstance(parts[0], str) else list(parts[0])
            if lacking := [t for t in wanted if t not in (have := out.keys())]:
                raise KeyError(f"{lacking[0]!r} is none of {have}")
            out = out._types(F.col("cell_type").isin(wanted))
        for part, axis in zip(parts[1:], ("obs", "var")):
            if isinstance(part, Column):
                out = out._filter(axis, [part], {}, None, None)
            elif not isinstance(part, slice) or part != slice(None):
                out = out._at(axis, part)
        return out

    def _at(self, axis: str, part) -> Pseudobulk:
        """The rows of one axis that part names in each type."""
        table, (_, name) = getattr(self, axis), KEYS[axis]
        labels = [part] if isinstance(part, str) else [x for x in (part.start, part.stop) if isinstance(x, str)] if isinstance(part, slice) else [x for x in part if isinstance(x, str)] if not isinstance(part, (int, np.integer)) else []
        whole = isinstance(part, str) or not isinstance(part, (slice, int, np.integer)) and len(labels) == len(part) > 0
        if whole:
            kept = table.where(F.col(name).isin(labels))
            found: dict[str, set] = {}
            for r in kept.select("cell_type", name).collect():
                found.setdefault(r[0], set()).add(r[1])
            for t in self.keys():
                if lacking := [x for x in labels if x not in found.get(t, ())]:
                    raise KeyError(f"{t!r} has no {name} {lacking[0]!r}")
        else:
            sizes = {r[0]: r[1] for r in table.groupBy("cell_type").count().collect()}
            at = verbs.numbered(table.select("cell_type", name), [F.asc(name)], ["cell_type"], "_at")
            if isinstance(part, slice):
                ends = {(r[0], r[1]): r[2] for r in at.where(F.col(name).isin(labels)).collect()} if labels else {}
                rows = []
                for t, n in sizes.items():
                    if lacking := [x for x in labels if (t, x) not in ends]:
                        raise KeyError(f"{t!r} has no {name} {lacking[0]!r}")
                    asked = verbs.span(slice(*(ends[t, x] if isinstance(x, str) else x for x in (part.start, part.stop)), part.step), n)
                    rows.append((t, min(asked, default=0), max(asked, default=-1), asked.start, abs(asked.step)))
                spans = self.obs.sparkSession.createDataFrame(rows, "cell_type string, _lo long, _hi long, _from long, _step long")
                inside = F.col("_at").between(F.col("_lo"), F.col("_hi")) & (F.pmod(F.col("_at") - F.col("_from"), F.col("_step")) == 0)
                kept = at.join(spans, "cell_type").where(inside)
            else:
                asked = [(t, p) for t, n in sizes.items() for p in verbs.places(part, n)]
                if len(set(asked)) != len(asked):
                    raise ValueError("a place is named twice")
                kept = at.join(self.obs.sparkSession.createDataFrame(asked, "cell_type string, _at long"), ["cell_type", "_at"])
        kept = kept.select(*KEYS[axis])
        return replace(self, **{axis: table.join(kept, KEYS[axis], "left_semi").select(*table.columns), "X": self.X.join(kept, KEYS[axis], "left_semi").select("cell_type", "sample", "gene", "value")})

    def categorical_obs(self, column: str, levels: list | None = None) -> Pseudobulk:
        """column of obs with levels in order; the first is the reference of a design."""
        return replace(self, obs=verbs.with_levels(self.obs, column, levels))

    def categorical_var(self, column: str, levels: list | None = None) -> Pseudobulk:
        return replace(self, var=verbs.with_levels(self.var, column, levels))

    def sample(self, cell_type: str, sample: str) -> DataFrame:
        """(gene, value) of one sample, zeros filled in."""
        got = self.X.where((F.col("cell_type") == cell_type) & (F.col("sample") == sample)).select("gene", "value")
        return self.var.where(F.col("cell_type") == cell_type).select("gene").join(got, "gene", "left").fillna(0, "value")

    def gene(self, cell_type: str, gene: str) -> DataFrame:
        got = self.X.where((F.col("cell_type") == cell_type) & (F.col("gene") == gene)).select("sample", "value")
        return self.obs.where(F.col("cell_type") == cell_type).select("sample").join(got, "sample", "left").fillna(0, "value")

    def _peek(self, axis: str, cell_type: str | None, row: int) -> DataFrame:
        t = getattr(self, axis)
        t = t if cell_type is None else t.where(F.col("cell_type") == cell_type)
        one = t.orderBy(*KEYS[axis]).offset(row).limit(1)
        return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in t.columns))).alias("r")).select("r.*")

    def peek_obs(self, cell_type: str | None = None, row: int = 0) -> DataFrame:
        return self._peek("obs", cell_type, row)

    def peek_var(self, cell_type: str | None = None, row: int = 0) -> DataFrame:
        return self._peek("var", cell_type, row)

    def set_num_threads(self, num_threads: int) -> Pseudobulk:
        return replace(self, num_threads=num_threads)

    def copy(self, deep: bool = False) -> Pseudobulk:
        return replace(self)

    # -- types ----------------------------------------------------------------------------------------------------

    def _types(self, condition: Column) -> Pseudobulk:
        return replace(self, X=self.X.where(condition), obs=self.obs.where(condition), var=self.var.where(condition))

    def select_cell_types(self, cell_types, *more) -> Pseudobulk:
        wanted = verbs.flat(cell_types, more)
        if lacking := set(wanted) - set(self.keys()):
            raise ValueError(f"no cell types {sorted(lacking)}")
        return self._types(F.col("cell_type").isin(wanted))

    def drop_cell_types(self, cell_types, *more) -> Pseudobulk:
        gone = verbs.flat(cell_types, more)
        if lacking := set(gone) - set(self.keys()):
            raise ValueError(f"no cell types {sorted(lacking)}")
        return self._types(~F.col("cell_type").isin(gone))

    def rename_cell_types(self, mapping) -> Pseudobulk:
        old = self.keys()
        new = [mapping(k) if callable(mapping) else mapping.get(k, k) for k in old]
        if len(set(new)) != len(new) or not all(isinstance(k, str) for k in new):
            raise ValueError("cell types need names of their own")
        named = F.create_map(*(F.lit(x) for pair in zip(old, new) for x in pair))
        return replace(self, **{s: getattr(self, s).withColumn("cell_type", named[F.col("cell_type")]) for s in ("X", "obs", "var")})

    def split_by_cell_type(self, cell_types=None, excluded_cell_types=None) -> tuple[Pseudobulk, ...]:
        chosen = self._chosen(cell_types, excluded_cell_types) or self.keys()
        return tuple(self._types(F.col("cell_type") == k) for k in chosen)

    def _chosen(self, cell_types, excluded) -> list[str] | None:
        """The types that a verb is for; None for all."""
        if cell_types is None and excluded is None:
            return None
        if cell_types is not None and excluded is not None:
            raise ValueError("give cell_types or excluded_cell_types")
        given = verbs.flat(cell_types if excluded is None else excluded, ())
        have = self.keys()
        if lacking := set(given) - set(have):
            raise ValueError(f"no cell types {sorted(lacking)}")
        return [k for k in have if (k in given) == (excluded is None)]

    # -- verbs of both axes ---------------------------------------------------------------------------------------

    def _for(self, axis: str, f: Callable[[DataFrame], DataFrame], cell_types, excluded) -> DataFrame:
        """f of the rows of the chosen types; the rows of the others stay, with nulls in new columns."""
        table, chosen = getattr(self, axis), self._chosen(cell_types, excluded)
        if chosen is None:
            return f(table)
        mine = F.col("cell_type").isin(chosen)
        return f(table.where(mine)).unionByName(table.where(~mine), allowMissingColumns=True)

    def _filter(self, axis: str, predicates, constraints, cell_types, excluded) -> Pseudobulk:
        table = self._for(axis, lambda t: verbs.where(t, predicates, constraints), cell_types, excluded)
        return replace(self, **{axis: table, "X": self.X.join(table.select(*KEYS[axis]), KEYS[axis], "left_semi").select("cell_type", "sample", "gene", "value")})

    def filter_obs(self, *predicates, cell_types=None, excluded_cell_types=None, **constraints) -> Pseudobulk:
        return self._filter("obs", predicates, constraints, cell_types, excluded_cell_types)

    def filter_var(self, *predicates, cell_types=None, excluded_cell_types=None, **constraints) -> Pseudobulk:
        return self._filter("var", predicates, constraints, cell_types, excluded_cell_types)

    def cast_X(self, dtype: str, cell_types=None, excluded_cell_types=None) -> Pseudobulk:
        """The values as another type. One table holds all types, so with cell_types only what the cast does to the values
        of these is kept (whole numbers, the range of the type), in a type that holds the others' values as well."""
        chosen = self._chosen(cell_types, excluded_cell_types)
        if chosen is None:
            return replace(self, X=self.X.withColumn("value", F.col("value").cast(dtype)))
        mine = F.col("cell_type").isin(chosen)
        return replace(self, X=self.X.withColumn("value", F.when(mine, F.col("value").cast(dtype)).otherwise(F.col("value"))))

    def _subsample(self, axis: str, n, fraction, by_column, subsample_column, seed, overwrite, cell_types, excluded) -> Pseudobulk:
        keys = KEYS[axis]
        table = getattr(self, axis)
        chosen = self._chosen(cell_types, excluded) or self.keys()
        parts = [verbs.subsample(table.where(F.col("cell_type") == k), keys, n, fraction, by_column, seed) for k in chosen]
        kept = verbs.stacked(parts, False, axis).unionByName(table.where(~F.col("cell_type").isin(chosen)).select(*keys))
        if subsample_column is None:
            out = table.join(kept, keys, "left_semi").select(*table.columns)
            return replace(self, **{axis: out, "X": self.X.join(kept, keys, "left_semi").select("cell_type", "sample", "gene", "value")})
        if subsample_column in table.columns and not overwrite:
            raise ValueError(f"{subsample_column!r} is there already")
        marked = table.drop(subsample_column).join(kept.withColumn(subsample_column, F.lit(True)), keys, "left")
        return replace(self, **{axis: marked.withColumn(subsample_column, F.coalesce(subsample_column, F.lit(False)))})

    def subsample_obs(self, n=None, fraction=None, by_column=None, subsample_column=None, seed=0, overwrite=False, cell_types=None, excluded_cell_types=None) -> Pseudobulk:
        return self._subsample("obs", n, fraction, by_column, subsample_column, seed, overwrite, cell_types, excluded_cell_types)

    def subsample_var(self, n=None, fraction=None, by_column=None, subsample_column=None, seed=0, overwrite=False, cell_types=None, excluded_cell_types=None) -> Pseudobulk:
        return self._subsample("var", n, fraction, by_column, subsample_column, seed, overwrite, cell_types, excluded_cell_types)

    def set_obs_names(self, column: str) -> Pseudobulk:
        """Another column of obs names the samples from now on, in X as well."""
        named = self.obs.select("cell_type", "sample", F.col(column).alias("_n"))
        x = self.X.join(named, ["cell_type", "sample"]).select("cell_type", F.col("_n").alias("sample"), "gene", "value")
        return replace(self, X=x, obs=self.obs.withColumnsRenamed({"sample": "_s", column: "sample"}).withColumnRenamed("_s", column if column != "sample" else "sample"))

    def set_var_names(self, column: str) -> Pseudobulk:
        named = self.var.select("cell_type", "gene", F.col(column).alias("_n"))
        x = self.X.join(named, ["cell_type", "gene"]).select("cell_type", "sample", F.col("_n").alias("gene"), "value")
        return replace(self, X=x, var=self.var.withColumnsRenamed({"gene": "_s", column: "gene"}).withColumnRenamed("_s", column))

    def _concat(self, axis: str, others, dataset_column, dataset_labels, flexible) -> Pseudobulk:
        sets = [self, *others]
        labels = dataset_labels or [f"dataset_{k}" for k in range(len(sets))]
        cross = "var" if axis == "obs" else "obs"
        keys, ckeys = KEYS[axis], KEYS[cross]
        keep = getattr(self, cross)
        for s in sets[1:]:
            theirs = getattr(s, cross)
            if flexible:
                keep = keep.join(theirs.select(*ckeys), ckeys, "left_semi").select(*keep.columns)
            elif not verbs.same_rows(keep, theirs):
                raise ValueError(f"the {cross} of the datasets differ; flexible=True keeps what they share")
        tables = [getattr(s, axis).withColumn(dataset_column, F.lit(n)) if dataset_column else getattr(s, axis) for s, n in zip(sets, labels)]
        table = verbs.stacked(tables, flexible, axis)
        if table.groupBy(*keys).count().where("count > 1").limit(1).count():
            raise ValueError(f"names of {axis} are not unique after concatenation")
        x = verbs.stacked([s.X for s in sets], False, "X")
        x = x.join(keep.select(*ckeys), ckeys, "left_semi").select("cell_type", "sample", "gene", "value") if flexible else x
        return replace(self, **{"X": x, axis: table, cross: keep})

    def concat_obs(self, datasets, *more, dataset_column=None, dataset_labels=None, flexible=False) -> Pseudobulk:
        return self._concat("obs", [*([datasets] if isinstance(datasets, Pseudobulk) else datasets), *more], dataset_column, dataset_labels, flexible)

    def concat_var(self, datasets, *more, dataset_column=None, dataset_labels=None, flexible=False) -> Pseudobulk:
        return self._concat("var", [*([datasets] if isinstance(datasets, Pseudobulk) else datasets), *more], dataset_column, dataset_labels, flexible)

    def to_df(self, obs_columns: list[str] | None = None, genes: list[str] | None = None) -> DataFrame:
        """Wide: cell_type, sample, columns of obs, and a column for each gene (null where the type lacks the gene)."""
        names = genes if genes is not None else sorted(r[0] for r in self.var.select("gene").distinct().collect())
        keep = obs_columns if obs_columns is not None else [c for c in ("num_cells",) if c in self.obs.columns]
        for c in keep:
            verbs.resolve(self.obs, c)
        filled = self.dense().where(F.col("gene").isin(names))
        wide = filled.groupBy("cell_type", "sample").pivot("gene", names).agg(F.first("value"))
        return self.obs.select("cell_type", "sample", *keep).join(wide, ["cell_type", "sample"], "left")

    def pipe(self, function, *args, **kwargs):
        return function(self, *args, **kwargs)

    # -- analysis -------------------------------------------------------------------------------------------------

    def dense(self) -> DataFrame:
        """X with its zeros: each sample of a type with each of its genes."""
        grid = self.obs.select("cell_type", "sample").join(self.var.select("cell_type", "gene"), "cell_type")
        return grid.join(self.X, ["cell_type", "sample", "gene"], "left").withColumn("value", F.coalesce("value", F.lit(0)))

    def _whole(self, allow_float: bool) -> None:
        if self.X.schema["value"].dataType.typeName() in ("float", "double") and not allow_float:
            raise TypeError("X has floating-point values; allow_float=True takes them")

    def qc(self, group_column: str | None, custom_filter=None, min_samples: int = 2, min_cells: int | None = 10, max_standard_deviations: float | None = 3, min_nonzero_fraction: float | None = 0.8, cell_types=None, excluded_cell_types=None, error_if_negative_counts: bool = True, allow_float: bool = False, error_if_empty: bool = True) -> Pseudobulk:
        """Samples: with a group, of min_cells cells, and fewer genes without counts than the mean and so many standard
        deviations over it. Genes: in every group, a quantile of min_nonzero_fraction over zero. Types that are left
        with under min_samples samples, in any group, go; if all go, ValueError, or empty tables without error_if_empty."""
        self._whole(allow_float)
        if error_if_negative_counts and not self.X.where("value < 0").limit(1).isEmpty():
            raise ValueError("X has negative counts")
        chosen = self._chosen(cell_types, excluded_cell_types) or self.keys()
        mine = F.col("cell_type").isin(chosen)
        obs = self.obs.where(mine)
        group = F.lit("all") if group_column is None else F.col(group_column)
        if custom_filter is not None:
            obs = obs.where(verbs.resolve(obs, custom_filter))
        if group_column is not None:
            obs = obs.where(F.col(group_column).isNotNull())
        if min_cells is not None and "num_cells" in obs.columns:
            obs = obs.where(F.col("num_cells") >= min_cells)

        def enough(obs: DataFrame) -> DataFrame:
            n = obs.groupBy("cell_type", group.alias("g")).count().groupBy("cell_type").agg(F.min("count").alias("least"), F.count("*").alias("groups"))
            ok = (F.col("least") >= min_samples) & ((F.col("groups") > 1) if group_column is not None else F.lit(True))
            return obs.join(n.where(ok).select("cell_type"), "cell_type", "left_semi").select(*obs.columns)

        obs = enough(obs)
        if max_standard_deviations is not None:
            genes = self.var.groupBy("cell_type").agg(F.count("*").alias("g"))
            seen = self.X.where("value <> 0").groupBy("cell_type", "sample").agg(F.count("*").alias("k"))
            w = Window.partitionBy("cell_type")
            zeros = obs.join(genes, "cell_type").join(seen, ["cell_type", "sample"], "left").withColumn("z", F.col("g") - F.coalesce("k", F.lit(0)))
            obs = enough(zeros.withColumn("_top", F.avg("z").over(w) + max_standard_deviations * F.stddev_pop("z").over(w)).where("z < _top").select(*obs.columns))
        var = self.var.where(mine).join(obs.select("cell_type").distinct(), "cell_type", "left_semi").select(*self.var.columns)
        if min_nonzero_fraction is not None:
            # a quantile at 1 - f of n values is over zero when the value at its upper end is: zeros fill the low ranks
            of = obs.select("cell_type", "sample", group.alias("g"))
            sizes = of.groupBy("cell_type", "g").agg(F.count("*").alias("n"))
            positive = self.X.where("value > 0").join(of, ["cell_type", "sample"]).groupBy("cell_type", "gene", "g").agg(F.count("*").alias("k"))
            rank = F.ceil((F.col("n") - 1) * F.lit(1 - min_nonzero_fraction) - F.lit(1e-9))
            good = positive.join(sizes, ["cell_type", "g"]).where(F.col("n") - F.col("k") <= rank - F.when((F.col("n") - 1) * F.lit(1 - min_nonzero_fraction) <= 0, 0).otherwise(0))
            every = sizes.groupBy("cell_type").agg(F.count("*").alias("all"))
            passed = good.groupBy("cell_type", "gene").agg(F.count("*").alias("k")).join(every, "cell_type").where("k = all").select("cell_type", "gene")
            var = var.join(passed, ["cell_type", "gene"], "left_semi").select(*self.var.columns)
        if error_if_empty and obs.limit(1).isEmpty():
            raise ValueError("no cell type is left")
        x = self.X.join(obs.select("cell_type", "sample"), ["cell_type", "sample"], "left_semi").join(var.select("cell_type", "gene"), ["cell_type", "gene"], "left_semi").select("cell_type", "sample", "gene", "value")
        return replace(self, X=x.unionByName(self.X.where(~mine)), obs=obs.unionByName(self.obs.where(~mine)), var=var.unionByName(self.var.where(~mine)))

    def library_size(self, library_size_column: str = "library_size", logratio_trim: float = 0.3, sum_trim: float = 0.05, A_cutoff: float = -1e10, allow_float: bool = False, overwrite: bool = False) -> Pseudobulk:
        """Trimmed means of M values: sizes that a sample's genes would have without the few that differ most. Samples
        and genes without any count raise ValueError: sizes of such samples mean nothing, and such genes are left out
        first, by qc()."""
        self._whole(allow_float)
        if library_size_column in self.obs.columns and not overwrite:
            raise ValueError(f"{library_size_column!r} is there already")
        seen = self.X.where("value > 0").select("cell_type", "gene").distinct()
        if bare := self.var.select("cell_type", "gene").join(seen, ["cell_type", "gene"], "left_anti").limit(3).collect():
            raise ValueError(f"genes without counts, e.g. {[tuple(r) for r in bare]}; leave them out by qc()")
        counted = self.X.where("value > 0").select("cell_type", "sample").distinct()
        if bare := self.obs.select("cell_type", "sample").join(counted, ["cell_type", "sample"], "left_anti").limit(3).collect():
            raise ValueError(f"samples without counts, e.g. {[tuple(r) for r in bare]}; leave them out by qc()")
        sizes = tmm(self.dense(), logratio_trim, sum_trim, A_cutoff).withColumnRenamed("library_size", library_size_column)
        return replace(self, obs=self.obs.drop(library_size_column).join(sizes, ["cell_type", "sample"], "left"))

    def _sized(self, column: str) -> DataFrame:
        verbs.resolve(self.obs, column)
        return self.obs.select("cell_type", "sample", F.col(column).cast("double").alias("L"))

    def cpm(self, library_size_column: str = "library_size", allow_float: bool = False) -> Pseudobulk:
        self._whole(allow_float)
        x = self.X.join(self._sized(library_size_column), ["cell_type", "sample"]).withColumn("value", F.col("value") / F.col("L") * 1e6)
        return replace(self, X=x.select("cell_type", "sample", "gene", "value"))

    def log_cpm(self, library_size_column: str = "library_size", prior_count: float = 2, allow_float: bool = False) -> Pseudobulk:
        self._whole(allow_float)
        sized = self._sized(library_size_column).withColumn("pc", prior_count * F.col("L") / F.avg("L").over(Window.partitionBy("cell_type")))
        x = self.dense().join(sized, ["cell_type", "sample"])
        y = F.log2(F.col("value") + F.col("pc")) - F.log2(F.col("L") + 2 * F.col("pc")) + float(np.log2(1e6))
        return replace(self, X=x.select("cell_type", "sample", "gene", y.alias("value")))

    def _levels(self, names: list[str]) -> dict[str, list]:
        return {c: found for c in names if c in self.obs.columns and (found := verbs.levels(self.obs, c)) is not None}

    def regress_out(self, formula: str | dict[str, str], categorical_columns=(), ordinal_columns=(), error_if_int: bool = True) -> Pseudobulk:
        """What a linear model leaves of each gene; a dict has a formula for each type."""
        if error_if_int and self.X.schema["value"].dataType.typeName() not in ("float", "double"):
            raise TypeError("X has whole counts; error_if_int=False takes them")
        levels, cat, ordn = self._levels(_all_variables(formula)), tuple(categorical_columns), tuple(ordinal_columns)
        models = {}
        for t, obs in self._samples(_all_variables(formula)).items():
            design = design_matrix(_of_type(formula, t), obs, cat, ordn, levels).to_numpy()
            if np.linalg.matrix_rank(design) < design.shape[1]:
                raise ValueError(f"the design of {t!r} is rank-deficient")
            models[t] = Model(list(obs.index), design, [])
        return replace(self, X=differential.residuals(differential.gene_rows(self.X, self.var), models))

    def _samples(self, columns: list[str]) -> dict[str, pd.DataFrame]:
        """The samples of each type by name, with columns: a row a sample, on the driver."""
        have = [c for c in dict.fromkeys(columns) if c in self.obs.columns and c not in KEYS["obs"]]
        table = self.obs.select("cell_type", "sample", *have).toPandas().sort_values(["cell_type", "sample"], kind="stable")
        return {t: part.set_index("sample")[have] for t, part in table.groupby("cell_type", sort=True)}

    def de(self, formula: str | dict[str, str], coefficient=None, contrasts: dict | None = None, group=None, categorical_columns=(), ordinal_columns=(), library_size_column: str = "library_size", strict: bool = False, robust: bool = False, return_voom_info: bool = True) -> DE:
        """Linear models with precision weights for each type: logFC, SE, limits, mean, p, and p corrected within a type
        and coefficient. Samples of the groups behind the tested coefficients (by default the combinations of its
        categorical columns; group=False for none) have a mean-variance trend each. Formula, coefficient, contrasts and
        group may be dicts by cell type. return_voom_info: with the trends' points and the weights. A type that can't be fitted, or has no entry, is left out, or raises with
        strict."""
        levels = self._levels(_all_variables(formula))
        cat, ordn = (*categorical_columns, *(c for c in levels if c not in ordinal_columns and c not in categorical_columns)), tuple(ordinal_columns)
        groups = group.values() if isinstance(group, dict) else [group]
        models = {}
        for t, obs in self._samples([*_all_variables(formula), library_size_column, *(g for g in groups if isinstance(g, str))]).items():
            own = contrasts if contrasts is None or not any(isinstance(x, dict) for x in contrasts.values()) else contrasts.get(t)
            try:
                models[t] = differential.weighted_model(obs, _of_type(formula, t), _of_type(coefficient, t), own, _of_type(group, t), cat, ordn, library_size_column, levels, contrast_vector)
            except (ValueError, np.linalg.LinAlgError):
                if strict:
                    raise
        rows = differential.gene_rows(self.X, self.var)
        points = staged(differential.scatter(rows, models), "scatter")
        lines = differential.trends(points)
        for t in [t for t, m in models.items() if any((t, panel) not in lines for panel in m.panels)]:
            if strict:
                raise ValueError(f"{t!r} has too few genes with counts for a trend")
            del models[t]
        fitted = differential.fits(rows, models, lines)
        table = differential.moderated(fitted, models, robust).withColumn("Bonferroni", bonferroni(F.col("p"), "cell_type", "coefficient"))
        table = with_fdr(table, "p", "FDR", "cell_type", "coefficient", tie="gene")
        if not return_voom_info:
            return DE(table)
        known = points.where(F.col("cell_type").isin(list(models)))
        return DE(table, differential.plot_points(known, lines), differential.weight_table(fitted, models))

    DE = de


def _of_type(given, cell_type: str):
    """An argument that may be a dict by cell type."""
    if not isinstance(given, dict):
        return given
    if cell_type not in given:
        raise ValueError(f"nothing is given for {cell_type!r}")
    return given[cell_type]


def _all_variables(formula: str | dict[str, str]) -> list[str]:
    return list(dict.fromkeys(v for f in (formula.values() if isinstance(formula, dict) else [formula]) for v in variables(f)))


def contrast_vector(expression: str, labels: list[str]) -> np.ndarray:
    """A sum of coefficients with signs and factors, e.g. `a - b` or `0.5*a + 0.5*b`; the longest label is read first."""
    import re

    out = np.zeros(len(labels))
    rest = expression
    pattern = r"\s*([+-]?)\s*(?:([0-9.]+)\s*\*\s*)?(" + "|".join(re.escape(x) for x in sorted(labels, key=len, reverse=True)) + r")(?:\s*/\s*([0-9.]+))?"
    while rest.strip():
        m = re.match(pattern, rest)
        if not m:
            raise ValueError(f"can't read {rest!r} in a contrast")
        out[labels.index(m[3])] += (-1 if m[1] == "-" else 1) * float(m[2] or 1) / float(m[4] or 1)
        rest = rest[m.end() :]
    return out


def tmm(dense: DataFrame, logratio_trim: float = 0.3, sum_trim: float = 0.05, A_cutoff: float = -1e10) -> DataFrame:
    """cell_type, sample, library_size from counts with their zeros: raw sums times factors by trimmed means."""
    by_type = Window.partitionBy("cell_type")
    x = dense.select("cell_type", "sample", "gene", F.col("value").cast("double").alias("x"))
    per = x.groupBy("cell_type", "sample").agg(F.sum("x").alias("L"), F.percentile("x", 0.75).alias("q"), F.sum(F.sqrt("x")).alias("root"))
    per = per.withColumn("f75", F.try_divide("q", "L")).withColumn("n", F.count("*").over(by_type))
    per = per.withColumn("mid", F.median("f75").over(by_type)).withColumn("gap", F.abs(F.col("f75") - F.avg("f75").over(by_type)))
    pick = F.when(F.col("mid") < 1e-20, -F.col("root")).otherwise(F.col("gap"))
    first = per.groupBy("cell_type").agg(F.min_by(F.struct(F.col("sample").alias("ref"), F.col("L").alias("L_ref")), F.struct(F.round(pick, 12), "sample")).alias("r")).select("cell_type", "r.*")
    ref = x.join(first, ["cell_type"]).where("sample = ref").select("cell_type", "gene", F.col("x").alias("xr"), "L_ref")
    both = x.where("x > 0").join(ref.where("xr > 0"), ["cell_type", "gene"]).join(per.select("cell_type", "sample", "L"), ["cell_type", "sample"])
    m = F.log2((F.col("L_ref") / F.col("L")) * (F.col("x") / F.col("xr")))
    a = (F.log2(F.col("x") / F.col("L")) + F.log2(F.col("xr") / F.col("L_ref"))) / 2
    both = both.withColumns({"M": m, "A": a, "w": 1 / (1 / F.col("x") + 1 / F.col("xr") - 1 / F.col("L") - 1 / F.col("L_ref"))}).where(F.col("A") > A_cutoff)
    s = Window.partitionBy("cell_type", "sample")
    rank = lambda c: F.rank().over(s.orderBy(c)) + (F.count("*").over(Window.partitionBy("cell_type", "sample", c)) - 1) / 2
    both = both.withColumns({"rM": rank("M"), "rA": rank("A"), "k": F.count("*").over(s), "big": F.max(F.abs("M")).over(s)})
    inside = lambda r, t: (F.col(r) >= F.floor(F.col("k") * t) + 1) & (F.col(r) <= F.col("k") - F.floor(F.col("k") * t))
    kept = both.where((F.col("big") < 1e-6) | (inside("rM", logratio_trim) & inside("rA", sum_trim)))
    f = kept.groupBy("cell_type", "sample").agg(F.when(F.max("big") < 1e-6, F.lit(1.0)).otherwise(F.pow(F.lit(2.0), F.try_divide(F.sum(F.col("w") * F.col("M")), F.sum("w")))).alias("f"))
    out = per.select("cell_type", "sample", "L", "n").join(f, ["cell_type", "sample"], "left").withColumn("f", F.coalesce("f", F.lit(1.0)))
    out = out.withColumn("f", F.when(F.col("n") == 1, F.lit(1.0)).otherwise(F.col("f") / F.exp(F.avg(F.log("f")).over(by_type))))
    return out.select("cell_type", "sample", (F.col("L") * F.col("f")).alias("library_size"))


@dataclass(frozen=True)
class DE:
    """Tests: cell_type, coefficient, gene, logFC, SE, LCI, UCI, AveExpr, p, Bonferroni, FDR."""

    table: DataFrame
    voom_plot_data: DataFrame | None = field(default=None)
    #: cell_type, sample, gene, weight
    voom_weights: DataFrame | None = field(default=None)

    def __post_init__(self) -> None:
        if (self.voom_weights is None) != (self.voom_plot_data is None):
            raise ValueError("give voom_weights and voom_plot_data together")

    def __eq__(self, other: object) -> bool:
        if not isinstance(other, DE) or (self.voom_weights is None) != (other.voom_weights is None):
            return False
        pairs = [(self.table, other.table), (self.voom_plot_data, other.voom_plot_data), (self.voom_weights, other.voom_weights)]
        return all(verbs.same_rows(a, b) for a, b in pairs if a is not None)

    __hash__ = None

    def __repr__(self) -> str:
        n = self.table.groupBy("cell_type").count().orderBy("cell_type").collect()
        return "DE with\n" + "\n".join(f"    {r['cell_type']}: {r['count']:,} tests" for r in n)

    @property
    def groups(self) -> dict[str, list[str]] | None:
        if self.voom_plot_data is None:
            return None
        rows = self.voom_plot_data.select("cell_type", "panel").distinct().orderBy("cell_type", "panel").collect()
        return {k: [r["panel"] for r in rows if r["cell_type"] == k] for k in {r["cell_type"]: 0 for r in rows}}

    def get_hits(self, significance_column: str = "FDR", threshold: float = 0.05, num_top_hits: int | None = None) -> DataFrame:
        hits = self.table.where(F.col(significance_column) < threshold)
        if num_top_hits is not None:
            w = Window.partitionBy("cell_type").orderBy(significance_column, "gene", "coefficient")
            hits = hits.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= num_top_hits).drop("_k")
        return hits.orderBy(significance_column, "cell_type", "gene")

    def get_num_hits(self, significance_column: str = "FDR", threshold: float = 0.05) -> DataFrame:
        return self.table.where(F.col(significance_column) < threshold).groupBy("cell_type").agg(F.count("*").alias("num_hits")).orderBy("cell_type")

    def plot_volcano(self, cell_type: str, x_column: str = "logFC", y_column: str = "p", significance_column: str = "FDR", threshold: float = 0.05, genes_to_label: int = 10) -> DataFrame:
        """The points of a volcano plot: x, y = -log10, direction, and whether the gene is labelled."""
        t = self.table.where(F.col("cell_type") == cell_type)
        hit = F.col(significance_column) < threshold
        kind = F.when(hit & (F.col(x_column) > 0), "up").when(hit & (F.col(x_column) < 0), "down").otherwise("none")
        top = t.orderBy(y_column, "gene").limit(genes_to_label).select("gene", "coefficient").withColumn("label", F.lit(True))
        points = t.select("gene", "coefficient", F.col(x_column).alias("x"), (-F.log10(y_column)).alias("y"), kind.alias("direction"))
        return points.join(top, ["gene", "coefficient"], "left").fillna(False, "label")

    def plot_voom(self, cell_type: str) -> DataFrame:
        """The points and lines of the mean-variance trends."""
        if self.voom_plot_data is None:
            raise ValueError("tested with return_voom_info=False")
        return self.voom_plot_data.where(F.col("cell_type") == cell_type)


def pseudobulk(sc: SingleCell, sample: str, cell_type: str, QC_column: str | None = "passed_QC", allow_float: bool = False) -> Pseudobulk:
    """Counts summed by sample and type; all genes stay for each type. Sums and samples are written once, since quality
    control, sizes and tests read them several times, and a plan of theirs would sum the cells again each time."""
    x, obs = (staged(t, "pseudobulk") for t in sum_by(sc, sample, cell_type, QC_column, allow_float))
    name = sc.name_column("var")
    kinds = [r[0] for r in obs.select("cell_type").distinct().collect()]  # types are few
    var = sc.var.drop("col_id").withColumnRenamed(name, "gene")
    var = var.select(F.explode(F.array(*map(F.lit, kinds)).cast("array<string>")).alias("cell_type"), *var.columns)
    return Pseudobulk(x, obs, var)


SingleCell.pseudobulk = pseudobulk


def _verb(axis: str, f: Callable) -> Callable:
    def method(self, *args, cell_types=None, excluded_cell_types=None, **kwargs):
        return replace(self, **{axis: self._for(axis, lambda t: f(t, KEYS[axis], args, kwargs), cell_types, excluded_cell_types)})

    return method


_VERBS = {
    "select": lambda t, keys, a, k: verbs.select(t, keys, a, k),
    "with_columns": lambda t, keys, a, k: verbs.with_columns(t, a, k),
    "drop": lambda t, keys, a, k: t.drop(*verbs.flat(a[0], a[1:])),
    "rename": lambda t, keys, a, k: verbs.renamed(t, a[0], keys),
    "cast": lambda t, keys, a, k: verbs.cast(t, a[0], **k),
    "join": lambda t, keys, a, k: verbs.left_join(t, a[0], **k),
    "map": lambda t, keys, a, k: a[0](t, *a[1:], **k),
}
for _axis in ("obs", "var"):
    for _name, _f in _VERBS.items():
        setattr(Pseudobulk, f"{_name}_{_axis}", _verb(_axis, _f))
Pseudobulk.map_X = _verb("X", _VERBS["map"])
KEYS["X"] = ["cell_type", "sample", "gene"]
for _slot in ("X", "obs", "var"):
    setattr(Pseudobulk, f"pipe_{_slot}", lambda self, function, *args, _s=_slot, **kwargs: replace(self, **{_s: function(getattr(self, _s), *args, **kwargs)}))
