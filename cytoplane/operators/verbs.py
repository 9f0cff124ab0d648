"""What the verbs of all datasets share: resolving columns, guarded left joins, subsampling, concatenation."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged

Spec = "str | Column | Callable[[DataFrame], Column]"


def resolve(df: DataFrame, column) -> Column:
    """A column from its name, an expression, or a function of the table."""
    if isinstance(column, str):
        if column not in df.columns:
            raise ValueError(f"no column {column!r}")
        return F.col(column)
    return column(df) if callable(column) and not isinstance(column, Column) else column


def flat(first, more: tuple) -> list:
    return [*([first] if isinstance(first, str) else first), *more]


def where(df: DataFrame, predicates: Iterable, constraints: dict) -> DataFrame:
    """Rows that meet all predicates and have all the values given by name."""
    tests = [resolve(df, p) for p in predicates] + [F.col(k) == F.lit(v) if v is not None else F.col(k).isNull() for k, v in constraints.items()]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def select(df: DataFrame, keys: list[str], exprs: Iterable, named: dict) -> DataFrame:
    """A projection that keeps the keys and, first of all, the name column."""
    asked = [resolve(df, e) for e in exprs] + [resolve(df, e).alias(k) for k, e in named.items()]
    names = df.select(*asked).columns if asked else []
    return df.select(*(F.col(k) for k in keys if k not in names), *asked)


def with_columns(df: DataFrame, exprs: Iterable, named: dict) -> DataFrame:
    new = {df.select(e).columns[0]: e for e in (resolve(df, x) for x in exprs)}
    return df.withColumns(new | {k: resolve(df, e) if not isinstance(e, (int, float, bool, str)) or isinstance(e, str) and e in df.columns else F.lit(e) for k, e in named.items()})


def renamed(df: DataFrame, mapping, fixed: Iterable[str] = ()) -> DataFrame:
    names = {c: mapping(c) for c in df.columns if c not in set(fixed)} if callable(mapping) else mapping
    lacking = [c for c in names if c not in df.columns]
    if lacking:
        raise ValueError(f"no columns {lacking}")
    out = df.withColumnsRenamed(names)
    if len(set(out.columns)) != len(out.columns):
        raise ValueError("names are not unique after renaming")
    return out


def cast(df: DataFrame, dtypes: dict, strict: bool = True) -> DataFrame:
    """strict: a value that can't be cast raises; else it becomes null."""
    return df.withColumns({c: F.col(c).cast(t) if strict else F.col(c).try_cast(t) for c, t in dtypes.items()})


def left_join(left: DataFrame, right: DataFrame, on=None, left_on=None, right_on=None, suffix: str = "_right", validate: str = "m:m", nulls_equal: bool = False, coalesce: bool = True) -> DataFrame:
    """A left join that never grows the left side: a key of the right that some left row has must be there once."""
    if (on is None) == (left_on is None) or (left_on is None) != (right_on is None):
        raise ValueError("give on, or left_on and right_on")
    if validate not in ("m:m", "m:1", "1:m", "1:1"):
        raise ValueError("validate is one of m:m, m:1, 1:m, 1:1")
    as_list = lambda x: [x] if isinstance(x, str) else list(x)
    lk, rk = as_list(on or left_on), as_list(on or right_on)
    marked = right.select(*(F.col(c).alias(f"_r_{c}") for c in right.columns))
    equal = lambda a, b: F.col(a).eqNullSafe(F.col(b)) if nulls_equal else F.col(a) == F.col(b)
    test = reduce(lambda x, y: x & y, (equal(a, f"_r_{b}") for a, b in zip(lk, rk)))

    def repeated(df: DataFrame, keys: list[str]) -> bool:
        named = df if nulls_equal else df.dropna(subset=keys)
        return bool(named.groupBy(*keys).count().where("count > 1").limit(1).count())

    if validate in ("1:m", "1:1") and repeated(left, lk):
        raise ValueError("keys of the left side are not unique")
    used = marked.join(left.select(*lk).distinct(), test, "left_semi")
    if repeated(marked if validate in ("m:1", "1:1") else used, [f"_r_{b}" for b in rk]):
        raise ValueError("keys of the right side are not unique: the join would add rows")
    joined = left.join(marked, test, "left")
    gone = set(rk) if coalesce else set()
    kept = [c for c in right.columns if c not in gone]
    return joined.select(*left.columns, *(F.col(f"_r_{c}").alias(c + suffix if c in left.columns else c) for c in kept))


def ceiling(fraction: float, total: int) -> int:
    """Rows whose rank, from 0, is below fraction * total."""
    return math.ceil(fraction * total)


def subsample(df: DataFrame, key: list[str], n: int | None, fraction: float | None, by, seed: int) -> DataFrame:
    """key columns of a sample: rows in order of a seeded hash. With `by`, each group gives its share, corrected by one
    from the smallest groups up (or the largest down) until the total is right; null groups give none."""
    if (n is None) == (fraction is None):
        raise ValueError("give n or fraction")
    if n is not None and n < 1 or fraction is not None and not 0 < fraction < 1:
        raise ValueError("n must be positive, a fraction between 0 and 1")
    order = F.xxhash64(*key, F.lit(seed))
    if by is None:
        total = df.count()
        want = n if n is not None else ceiling(fraction, total)
        if want > total:
            raise ValueError(f"only {total} rows")
        return df.orderBy(order, *key).limit(want).select(*key)
    df = df.withColumn("_by", resolve(df, by)).where(F.col("_by").isNotNull())
    sizes = {r["_by"]: r["count"] for r in df.groupBy("_by").count().collect()}
    total = sum(sizes.values())
    if n is not None and n > total:
        raise ValueError(f"only {total} rows")
    share = {g: int(n / total * k + 0.5) if n is not None else ceiling(fraction, k) for g, k in sizes.items()}
    short = (n - sum(share.values())) if n is not None else 0
    for g in sorted(sizes, key=lambda g: (sizes[g], str(g)), reverse=short < 0):
        if not short:
            break
        step = 1 if short > 0 else -1
        if 0 <= share[g] + step <= sizes[g]:
            share[g], short = share[g] + step, short - step
    spark = df.sparkSession
    allot = spark.createDataFrame([(g, k) for g, k in share.items()], f"_by {df.schema['_by'].dataType.simpleString()}, _n long")
    w = Window.partitionBy("_by").orderBy(order, *key)
    return df.withColumn("_k", F.row_number().over(w)).join(allot, "_by").where("_k <= _n").select(*key)


def unique_names(df: DataFrame, name: str, key: list[str]) -> DataFrame:
    """The second and later rows of a name get -1, -2, ... after it."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(*key)) - 1
    return df.withColumn(name, F.when(k > 0, F.concat_ws("-", name, k.cast("string"))).otherwise(F.col(name))).select(*df.columns)


def stacked(tables: list[DataFrame], flexible: bool, what: str) -> DataFrame:
    """Tables one below the other: strictly of one schema, or of the columns that all have."""
    if flexible:
        common = [c for c in tables[0].columns if all(c in t.columns for t in tables)]
        tables = [t.select(*common) for t in tables]
    elif any([(f.name, f.dataType) for f in t.schema] != [(f.name, f.dataType) for f in tables[0].schema] for t in tables):
        raise ValueError(f"the {what} of the datasets differ; flexible=True keeps what they share")
    return reduce(lambda a, b: with_united_levels(a.unionByName(b), a, b), tables)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return a.schema.simpleString() == b.schema.simpleString() and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def constant_columns(df: DataFrame, group: list[str], columns: list[str]) -> list[str]:
    """Columns with at most one distinct value, null counted as one, in every group."""
    if not columns:
        return []
    one = lambda c: F.min(c).eqNullSafe(F.max(c)) & ((F.count(c) == 0) | (F.count(c) == F.count("*")))
    per = df.groupBy(*group).agg(*(one(c).alias(c) for c in columns))
    every = per.agg(*(F.bool_and(c).alias(c) for c in columns)).first()
    return [c for c in columns if every[c] is None or every[c]]


# -- positions --------------------------------------------------------------------------------------------------------


def numbered(df: DataFrame, order: list, by: list[str] = (), name: str = "position") -> DataFrame:
    """df with each row's place, from 0, in the order of the columns or expressions `order`, within the groups `by`. Order
    and groups must tell all rows apart.

    Rows are sorted in ranges; a row's place in its range and the number of rows before the range add up to its place, so
    that no window has all rows in one partition. The sorted rows are written once, since ranges of another run of the
    plan could have other bounds. The table of ranges is one row for each range (and group that begins there)."""
    keys = [*(F.col(c).asc_nulls_first() for c in by), *order]
    row = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = staged(ranged.withColumns({"_part": F.shiftright(row, 33), "_row": row.bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    per = ranged.groupBy("_part", *by).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = per.withColumn("_start", before - F.col("_first")).select(F.col("_part").alias("_p"), *(F.col(c).alias(f"_g{k}") for k, c in enumerate(by)), "_start")
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_g{k}")) for k, c in enumerate(by)), F.col("_part") == F.col("_p"))
    return ranged.join(starts, same).select(*df.columns, (F.col("_row") + F.col("_start")).alias(name))


def span(part: slice, total: int) -> range:
    return range(*part.indices(total))


def chosen(table: DataFrame, key: str, part) -> DataFrame | None:
    """(id, position): the ids of table's column `key` at the places that part names, in id order, and where each goes.
    None for the full slice."""
    if isinstance(part, slice) and part == slice(None):
        return None
    spark, total = table.sparkSession, table.count()
    at = numbered(table.select(F.col(key).alias("id")), ["id"], name="_at")
    if isinstance(part, slice):
        asked = span(part, total)
        inside = F.pmod(F.col("_at") - asked.start, F.lit(abs(asked.step))) == 0
        lo, hi = (min(asked), max(asked)) if len(asked) else (0, -1)
        return at.where(F.col("_at").between(lo, hi) & inside).select("id", ((F.col("_at") - asked.start) / asked.step).cast("long").alias("position"))
    asked = spark.createDataFrame([(x, k) for k, x in enumerate(places(part, total))], "_at long, position long")  # as long as the list given
    return at.join(asked, "_at").select("id", "position")


def _listed(part) -> list:
    return [part] if isinstance(part, (int, np.integer)) and not isinstance(part, bool) else list(part)


def places(part, total: int) -> list[int]:
    """The places, from 0, that an int, a list of ints or a list of booleans names."""
    asked = _listed(part)
    if any(x is None for x in asked):
        raise ValueError("the index has missing values")
    if asked and all(isinstance(x, (bool, np.bool_)) for x in asked):
        if len(asked) != total:
            raise IndexError(f"a mask of {len(asked)} for {total}")
        return [k for k, x in enumerate(asked) if x]
    if not all(isinstance(x, (int, np.integer)) and not isinstance(x, (bool, np.bool_)) for x in asked):
        raise TypeError("indices are whole numbers or booleans")
    if wrong := [x for x in asked if not -total <= x < total]:
        raise IndexError(f"{wrong[0]} is out of bounds for {total}")
    return [int(x) % total for x in asked]


# -- levels of categorical columns ------------------------------------------------------------------------------------
#
# A categorical column has its levels, in order, in its metadata. Selecting, renaming, filtering, joining and Parquet
# keep metadata; aggregates and casts drop it, and unions keep that of the first table.


def levels(df: DataFrame, column: str) -> list | None:
    return df.schema[column].metadata.get("levels")


def with_levels(df: DataFrame, column: str, given: list | None = None) -> DataFrame:
    """column as categorical, with the given levels, or its values in sorted order. A value that is no level, a level that
    is there twice, and null as a level raise ValueError."""
    resolve(df, column)
    if given is None:
        given = sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().collect())  # categories are few
    given = list(given)
    if len(set(given)) != len(given) or None in given:
        raise ValueError("levels are distinct values")
    if stray := df.where(F.col(column).isNotNull() & ~F.col(column).isin(given)).select(column).limit(1).collect():
        raise ValueError(f"{stray[0][0]!r} is no level of {column!r}")
    return df.withMetadata(column, df.schema[column].metadata | {"levels": given})


def levels_like(df: DataFrame, other: DataFrame) -> DataFrame:
    """df with the levels that columns of the same name have in the other table."""
    for c in df.columns:
        if c in other.columns and levels(other, c) is not None:
            df = df.withMetadata(c, df.schema[c].metadata | {"levels": levels(other, c)})
    return df


def with_united_levels(df: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """df, the union of a and b, with the levels of a and then those that only b has; none where one of them has none."""
    for c in df.columns:
        x, y = (levels(t, c) if c in t.columns else None for t in (a, b))
        if x is None and y is None:
            continue
        meta = {k: v for k, v in df.schema[c].metadata.items() if k != "levels"}
        df = df.withMetadata(c, meta if x is None or y is None else meta | {"levels": [*x, *(v for v in y if v not in x)]})
    return df


def level_number(df: DataFrame, column: str) -> Column:
    """The place of a row's level, from 0; null for null."""
    return F.array_position(F.lit(levels(df, column)), F.col(column)) - 1
