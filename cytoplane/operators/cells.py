"""SingleCell: a sparse table of counts with tables about its cells and genes.

Slots are DataFrames. X has (row_id, col_id, value) without zeros; obs has row_id, the cell's name, and more; var has
col_id, the gene's name, and more; obsm and varm have an array by key and id; obsp and varp have weighted edges (i, j,
weight) by key; uns is a nested dict of plain values. Every method returns a new dataset and is lazy unless it has to
check or count something."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import verbs
from .packed import Packed, indexed

AXES = {"obs": ("row_id", "obsm", "obsp"), "var": ("col_id", "varm", "varp")}


@dataclass(frozen=True)
class SingleCell:
    X: DataFrame | None
    obs: DataFrame
    var: DataFrame
    obsm: dict[str, DataFrame] = field(default_factory=dict)
    varm: dict[str, DataFrame] = field(default_factory=dict)
    obsp: dict[str, DataFrame] = field(default_factory=dict)
    varp: dict[str, DataFrame] = field(default_factory=dict)
    uns: dict = field(default_factory=dict)
    num_threads: int = -1

    def __post_init__(self) -> None:
        for table, cols in ((self.obs, ["row_id"]), (self.var, ["col_id"]), (self.X, ["row_id", "col_id", "value"])):
            if table is not None and any(c not in table.columns for c in cols):
                raise ValueError(f"a table lacks {cols}")

    # -- slots ----------------------------------------------------------------------------------------------------

    def name_column(self, axis: str) -> str:
        table = getattr(self, axis)
        return next(c for c in table.columns if c != AXES[axis][0])

    @property
    def obs_names(self) -> DataFrame:
        return self.obs.select("row_id", self.name_column("obs"))

    @property
    def var_names(self) -> DataFrame:
        return self.var.select("col_id", self.name_column("var"))

    @property
    def shape(self) -> tuple[int, int]:
        return self.obs.count(), self.var.count()

    def __len__(self) -> int:
        return self.obs.count()

    def __repr__(self) -> str:
        cells, genes = self.shape
        lines = [f"SingleCell with {cells:,} cells and {genes:,} genes"]
        for slot in ("obs", "var"):
            lines.append(f"    {slot}: " + ", ".join(c for c in getattr(self, slot).columns if c != AXES[slot][0]))
        lines += [f"    {slot}: " + ", ".join(got) for slot in ("obsm", "varm", "obsp", "varp", "uns") if (got := getattr(self, slot))]
        return "\n".join(lines)

    def __eq__(self, other: object) -> bool:
        if not isinstance(other, SingleCell) or self.uns != other.uns or (self.X is None) != (other.X is None):
            return False
        keyed = [(getattr(self, s), getattr(other, s)) for s in ("obsm", "varm", "obsp", "varp")]
        if any(a.keys() != b.keys() for a, b in keyed):
            return False
        pairs = [(self.obs, other.obs), (self.var, other.var), *([(self.X, other.X)] if self.X is not None else []), *((a[k], b[k]) for a, b in keyed for k in a)]
        return all(verbs.same_rows(a, b) for a, b in pairs)

    __hash__ = None

    def set_num_threads(self, num_threads: int) -> SingleCell:
        """Kept for callers that set it; Spark's own settings decide on parallelism."""
        return replace(self, num_threads=num_threads)

    def cell(self, name) -> DataFrame:
        """One cell as a dense vector: (col_id, gene, value)."""
        row = self.obs.where(F.col(self.name_column("obs")) == F.lit(name)).select("row_id")
        got = self.X.join(F.broadcast(row.limit(1)), "row_id", "left_semi").select("col_id", "value")
        return self.var_names.join(got, "col_id", "left").fillna(0, "value")

    def gene(self, name) -> DataFrame:
        """One gene as a dense vector: (row_id, cell, value)."""
        col = self.var.where(F.col(self.name_column("var")) == F.lit(name)).select("col_id")
        got = self.X.join(F.broadcast(col.limit(1)), "col_id", "left_semi").select("row_id", "value")
        return self.obs_names.join(got, "row_id", "left").fillna(0, "value")

    def peek(self, axis: str, row: int = 0) -> DataFrame:
        """One row as (column, value)."""
        table, key = getattr(self, axis), AXES[axis][0]
        one = table.orderBy(key).offset(row).limit(1)
        cols = [c for c in table.columns if c != key]
        return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols))).alias("r")).select("r.*")

    def peek_obs(self, row: int = 0) -> DataFrame:
        return self.peek("obs", row)

    def peek_var(self, row: int = 0) -> DataFrame:
        return self.peek("var", row)

    # -- keeping the slots in step --------------------------------------------------------------------------------

    def restrict(self, axis: str, table: DataFrame) -> SingleCell:
        """The dataset with only the rows of table on one axis."""
        key, m, p = AXES[axis]
        keys = table.select(key)
        ends = lambda e: e.join(keys.withColumnRenamed(key, "i"), "i", "left_semi").join(keys.withColumnRenamed(key, "j"), "j", "left_semi").select("i", "j", "weight")
        x = None if self.X is None else self.X.join(keys, key, "left_semi").select("row_id", "col_id", "value")
        return replace(self, **{"X": x, axis: table, m: {k: t.join(keys, key, "left_semi").select(*t.columns) for k, t in getattr(self, m).items()}, p: {k: ends(t) for k, t in getattr(self, p).items()}})

    def __getitem__(self, item) -> SingleCell:
        """sc[cells], sc[cells, genes]: places in the order of row_id and col_id (ints, negative ones from the end; slices;
        lists of ints; lists of booleans of full length), names, lists of names, or conditions on obs and var. Ids stay,
        and so does their order, so that a place that is named twice raises ValueError."""
        parts = item if isinstance(item, tuple) else (item,)
        if not 1 <= len(parts) <= 2:
            raise IndexError("one or two indices")
        out = self
        for axis, part in zip(("obs", "var"), parts):
            table, key, name = getattr(out, axis), AXES[axis][0], self.name_column(axis)
            if isinstance(part, Column):
                out = out._filter(axis, [part], {})
            elif isinstance(part, str) or isinstance(part, (list, tuple)) and part and all(isinstance(x, str) for x in part):
                wanted = [part] if isinstance(part, str) else list(part)
                found = {r[0] for r in table.where(F.col(name).isin(wanted)).select(name).collect()}
                if lacking := [x for x in wanted if x not in found]:
                    raise KeyError(lacking[0])
                out = out._filter(axis, [F.col(name).isin(wanted)], {})
            elif (at := verbs.chosen(table, key, part)) is not None:
                if not isinstance(part, slice) and len(set(got := verbs.places(part, table.count()))) != len(got):
                    raise ValueError("a place is named twice")
                out = out.restrict(axis, table.join(at.select(F.col("id").alias(key)), key, "left_semi").select(*table.columns))
        return out

    def X_at(self, item) -> DataFrame:
        """X[rows, columns] as (row_id, col_id, value), numbered anew from 0 in the order asked for: ints, slices, lists of
        ints with repeats, lists of booleans."""
        return indexed(self.X, self.obs, self.var, item)

    def packed(self, layout: str = "csr") -> Packed:
        """X as packed rows of cells (csr) or of genes (csc)."""
        return Packed.of(self.X, layout)

    def with_packed(self, matrix: Packed) -> SingleCell:
        return replace(self, X=matrix.to_long())

    def eliminate_zeros(self) -> SingleCell:
        """Without stored zeros; a filter does it, since X is long."""
        return replace(self, X=self.X.where(F.col("value") != 0))

    def sum_duplicates(self) -> SingleCell:
        """Entries of one place are added up."""
        kind = self.X.schema["value"].dataType
        return replace(self, X=self.X.groupBy("row_id", "col_id").agg(F.sum("value").cast(kind).alias("value")))

    def categorical_obs(self, column: str, levels: list | None = None) -> SingleCell:
        """column with levels in order; the first is the reference of a design."""
        return self._change("obs", lambda t: verbs.with_levels(t, column, levels))

    def categorical_var(self, column: str, levels: list | None = None) -> SingleCell:
        return self._change("var", lambda t: verbs.with_levels(t, column, levels))

    def passing(self, QC_column: str | None = "passed_QC") -> SingleCell:
        """Only cells that passed quality control, where that is flagged."""
        if QC_column and QC_column in self.obs.columns:
            return self.restrict("obs", self.obs.where(F.col(QC_column)))
        return self

    # -- verbs of both axes ---------------------------------------------------------------------------------------

    def _filter(self, axis: str, predicates, constraints) -> SingleCell:
        return self.restrict(axis, verbs.where(getattr(self, axis), predicates, constraints))

    def filter_obs(self, *predicates, **constraints) -> SingleCell:
        return self._filter("obs", predicates, constraints)

    def filter_var(self, *predicates, **constraints) -> SingleCell:
        return self._filter("var", predicates, constraints)

    def _change(self, axis: str, f: Callable[[DataFrame], DataFrame]) -> SingleCell:
        return replace(self, **{axis: f(getattr(self, axis))})

    def select_obs(self, *exprs, **named) -> SingleCell:
        return self._change("obs", lambda t: verbs.select(t, ["row_id", self.name_column("obs")], exprs, named))

    def select_var(self, *exprs, **named) -> SingleCell:
        return self._change("var", lambda t: verbs.select(t, ["col_id", self.name_column("var")], exprs, named))

    def with_columns_obs(self, *exprs, **named) -> SingleCell:
        return self._change("obs", lambda t: verbs.with_columns(t, exprs, named))

    def with_columns_var(self, *exprs, **named) -> SingleCell:
        return self._change("var", lambda t: verbs.with_columns(t, exprs, named))

    def drop_obs(self, columns, *more) -> SingleCell:
        return self._change("obs", lambda t: t.drop(*verbs.flat(columns, more)))

    def drop_var(self, columns, *more) -> SingleCell:
        return self._change("var", lambda t: t.drop(*verbs.flat(columns, more)))

    def rename_obs(self, mapping) -> SingleCell:
        return self._change("obs", lambda t: verbs.renamed(t, mapping, ["row_id"]))

    def rename_var(self, mapping) -> SingleCell:
        return self._change("var", lambda t: verbs.renamed(t, mapping, ["col_id"]))

    def cast_obs(self, dtypes: dict, strict: bool = True) -> SingleCell:
        return self._change("obs", lambda t: verbs.cast(t, dtypes, strict))

    def cast_var(self, dtypes: dict, strict: bool = True) -> SingleCell:
        return self._change("var", lambda t: verbs.cast(t, dtypes, strict))

    def cast_X(self, dtype: str) -> SingleCell:
        return replace(self, X=self.X.withColumn("value", F.col("value").cast(dtype)))

    def join_obs(self, other: DataFrame, **how) -> SingleCell:
        return self._change("obs", lambda t: verbs.left_join(t, other, **how))

    def join_var(self, other: DataFrame, **how) -> SingleCell:
        return self._change("var", lambda t: verbs.left_join(t, other, **how))

    def _named_first(self, axis: str, column: str) -> SingleCell:
        t, key = getattr(self, axis), AXES[axis][0]
        if column not in t.columns:
            raise ValueError(f"no column {column!r}")
        return replace(self, **{axis: t.select(key, column, *(c for c in t.columns if c not in (key, column)))})

    def set_obs_names(self, column: str) -> SingleCell:
        return self._named_first("obs", column)

    def set_var_names(self, column: str) -> SingleCell:
        return self._named_first("var", column)

    def make_obs_names_unique(self) -> SingleCell:
        return self._change("obs", lambda t: verbs.unique_names(t, self.name_column("obs"), ["row_id"]))

    def make_var_names_unique(self) -> SingleCell:
        return self._change("var", lambda t: verbs.unique_names(t, self.name_column("var"), ["col_id"]))

    def _subsample(self, axis: str, n, fraction, by_column, subsample_column, QC_column, seed, overwrite) -> SingleCell:
        table, key = getattr(self, axis), AXES[axis][0]
        pool = table.where(F.col(QC_column)) if QC_column and QC_column in table.columns else table
        keys = verbs.subsample(pool, [key], n, fraction, by_column, seed)
        if subsample_column is None:
            return self.restrict(axis, table.join(keys, key, "left_semi").select(*table.columns))
        if subsample_column in table.columns and not overwrite:
            raise ValueError(f"{subsample_column!r} is there already")
        marked = table.drop(subsample_column).join(keys.withColumn(subsample_column, F.lit(True)), key, "left")
        return replace(self, **{axis: marked.withColumn(subsample_column, F.coalesce(subsample_column, F.lit(False)))})

    def subsample_obs(self, n=None, fraction=None, by_column=None, subsample_column=None, QC_column="passed_QC", seed=0, overwrite=False) -> SingleCell:
        return self._subsample("obs", n, fraction, by_column, subsample_column, QC_column, seed, overwrite)

    def subsample_var(self, n=None, fraction=None, by_column=None, subsample_column=None, seed=0, overwrite=False) -> SingleCell:
        return self._subsample("var", n, fraction, by_column, subsample_column, None, seed, overwrite)

    def _split(self, axis: str, column, sort: bool) -> dict:
        table = getattr(self, axis)
        values = [r[0] for r in table.select(verbs.resolve(table, column)).distinct().collect()]
        values = sorted((v for v in values if v is not None), key=str) if sort else [v for v in values if v is not None]
        return {v: self.restrict(axis, table.where(verbs.resolve(table, column) == F.lit(v))) for v in values}

    def split_by_obs(self, column, sort: bool = True) -> dict:
        """Value -> dataset; rows without a value are in none."""
        return self._split("obs", column, sort)

    def split_by_var(self, column, sort: bool = True) -> dict:
        return self._split("var", column, sort)

    # -- keyed slots ----------------------------------------------------------------------------------------------

    def _keyed(self, slot: str, change: Callable[[dict], dict]) -> SingleCell:
        return replace(self, **{slot: change(dict(getattr(self, slot)))})

    # -- layout ---------------------------------------------------------------------------------------------------

    def drop_X(self) -> SingleCell:
        return replace(self, X=None)

    def tocsr(self) -> SingleCell:
        """X dealt out by cells: what is done by cell needs no further shuffle."""
        return replace(self, X=self.X.repartition("row_id").sortWithinPartitions("row_id", "col_id"))

    def tocsc(self) -> SingleCell:
        return replace(self, X=self.X.repartition("col_id").sortWithinPartitions("col_id", "row_id"))

    def copy(self, deep: bool = False) -> SingleCell:
        return replace(self, uns=json.loads(json.dumps(self.uns)) if deep else dict(self.uns))

    # -- concatenation --------------------------------------------------------------------------------------------

    def _concat(self, axis: str, others, dataset_column, dataset_labels, flexible) -> SingleCell:
        """The datasets one behind the other on one axis, matched by name on the other. Ids are numbered on; keyed slots
        of the stacked axis stay where all datasets have the key, those of the other axis come from the first."""
        sets = [self, *others]
        cross = "var" if axis == "obs" else "obs"
        key, m, p = AXES[axis]
        ckey = AXES[cross][0]
        labels = dataset_labels or [f"dataset_{k}" for k in range(len(sets))]
        if len(labels) != len(sets) or len(set(labels)) != len(labels):
            raise ValueError("give each dataset a label of its own")
        names = [s.name_column(cross) for s in sets]
        first = getattr(self, cross)
        keep = first
        for s, n in zip(sets[1:], names[1:]):
            theirs = getattr(s, cross).select(F.col(n).alias(names[0]))
            if flexible:
                keep = keep.join(theirs.distinct(), names[0], "left_semi").select(*first.columns)
            elif not verbs.same_rows(first.drop(ckey), getattr(s, cross).withColumnRenamed(n, names[0]).drop(ckey)):
                raise ValueError(f"the {cross} of the datasets differ; flexible=True keeps what they share")
        offset, tables, xs = 0, [], []
        moved: dict[str, list[DataFrame]] = {}
        edges: dict[str, list[DataFrame]] = {}
        own = self.name_column(axis)
        for s, n, label in zip(sets, names, labels):
            t = getattr(s, axis).withColumnRenamed(s.name_column(axis), own).withColumn(key, F.col(key) + offset)
            tables.append(t.withColumn(dataset_column, F.lit(label)) if dataset_column else t)
            if s.X is not None:
                ids = getattr(s, cross).select(F.col(ckey), F.col(n).alias("_n")).join(keep.select(F.col(ckey).alias("_c"), F.col(names[0]).alias("_n")), "_n").select(ckey, "_c")
                xs.append(s.X.join(ids, ckey).withColumn(ckey, F.col("_c")).withColumn(key, F.col(key) + offset).select("row_id", "col_id", "value"))
            for k, v in getattr(s, m).items():
                moved.setdefault(k, []).append(v.withColumn(key, F.col(key) + offset))
            for k, v in getattr(s, p).items():
                edges.setdefault(k, []).append(v.withColumn("i", F.col("i") + offset).withColumn("j", F.col("j") + offset))
            top = getattr(s, axis).agg(F.max(key)).first()[0]
            offset += (top if top is not None else -1) + 1
        table = verbs.stacked(tables, flexible, axis)
        if table.groupBy(own).count().where("count > 1").limit(1).count():
            raise ValueError(f"names of {axis} are not unique after concatenation")
        whole = lambda d: {k: verbs.stacked(v, False, k) for k, v in d.items() if len(v) == len(sets)}
        out = replace(self, **{"X": verbs.stacked(xs, False, "X") if len(xs) == len(sets) else None, axis: table, m: whole(moved), p: whole(edges)})
        return out.restrict(cross, keep) if flexible else out

    def concat_obs(self, datasets, *more, dataset_column=None, dataset_labels=None, flexible=False) -> SingleCell:
        return self._concat("obs", [*([datasets] if isinstance(datasets, SingleCell) else datasets), *more], dataset_column, dataset_labels, flexible)

    def concat_var(self, datasets, *more, dataset_column=None, dataset_labels=None, flexible=False) -> SingleCell:
        return self._concat("var", [*([datasets] if isinstance(datasets, SingleCell) else datasets), *more], dataset_column, dataset_labels, flexible)

    # -- functions of the caller ----------------------------------------------------------------------------------

    def pipe(self, function, *args, **kwargs):
        return function(self, *args, **kwargs)


def _keyed_methods(slot: str) -> dict[str, Callable]:
    """select_, with_, drop_, rename_, pipe_ and pipe_..._key of a slot that is a dict."""

    def chosen(self, keys, *more):
        return self._keyed(slot, lambda d: {k: d[k] for k in verbs.flat(keys, more)})

    def added(self, entries=None, **named):
        return self._keyed(slot, lambda d: d | dict(entries or {}) | named)

    def dropped(self, keys, *more):
        gone = verbs.flat(keys, more)
        if lacking := [k for k in gone if k not in getattr(self, slot)]:
            raise ValueError(f"no {slot} {lacking}")
        return self._keyed(slot, lambda d: {k: v for k, v in d.items() if k not in gone})

    def rekeyed(self, mapping):
        return self._keyed(slot, lambda d: {(mapping(k) if callable(mapping) else mapping.get(k, k)): v for k, v in d.items()})

    def piped(self, function, *args, **kwargs):
        return self._keyed(slot, lambda d: function(d, *args, **kwargs))

    def piped_key(self, key, function, *args, **kwargs):
        return self._keyed(slot, lambda d: d | {key: function(d[key], *args, **kwargs)})

    return {f"select_{slot}": chosen, f"with_{slot}": added, f"drop_{slot}": dropped, f"rename_{slot}": rekeyed, f"pipe_{slot}": piped, f"pipe_{slot}_key": piped_key}


def _slot_pipe(slot: str) -> Callable:
    def piped(self, function, *args, **kwargs):
        return replace(self, **{slot: function(getattr(self, slot), *args, **kwargs)})

    return piped


for _slot in ("obsm", "varm", "obsp", "varp", "uns"):
    for _name, _method in _keyed_methods(_slot).items():
        setattr(SingleCell, _name, _method)
for _slot in ("X", "obs", "var"):
    setattr(SingleCell, f"pipe_{_slot}", _slot_pipe(_slot))
