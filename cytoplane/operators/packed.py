"""Sparse matrices as packed rows: a row of the table is one stretch of one row (or column) of the matrix.

(major, block, indices, values): `indices` are sorted ids of the other axis, all of one block of BLOCK ids, and `values`
are beside them. A gene that every cell has is thus many rows of at most BLOCK entries each, never one array. Entries are
packed once and shuffled packed: transposing sends arrays, not single entries."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import verbs

BLOCK = 1 << 16
#: Entries that are unpacked or turned at a time.
STRETCH = 500_000
AXES = {"csr": ("row_id", "col_id"), "csc": ("col_id", "row_id")}


def flat_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, end to end, and its n + 1 offsets."""
    off = np.asarray(column.offsets).astype(np.int64)
    return np.asarray(column.values)[off[0] : off[-1]] if len(off) else np.zeros(0), off - off[0] if len(off) else np.zeros(1, np.int64)


def lists(values: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values))


def stretches(off: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with about `most` entries; a longer row is a run of its own."""
    lo = 0
    while lo < len(off) - 1:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, side="right")) - 1)
        yield lo, hi
        lo = hi


def _rows(major: np.ndarray, minor: np.ndarray, values: np.ndarray, names: list[str], size: int) -> pa.RecordBatch:
    """Packed rows of entries that are sorted by (major, minor), in blocks of size."""
    block = minor // size
    new = np.concatenate([[True], (major[1:] != major[:-1]) | (block[1:] != block[:-1])]) if len(major) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    off = np.append(first, len(major))
    return pa.RecordBatch.from_arrays([pa.array(major[first]), pa.array(block[first]), lists(minor, off), lists(values, off)], names=names)


@dataclass(frozen=True)
class Packed:
    """layout `csr`: majors are cells; `csc`: majors are genes. shape: rows and columns of the matrix, where known."""

    rows: DataFrame
    layout: str = "csr"

    @property
    def kind(self) -> str:
        return self.rows.schema["values"].dataType.elementType.simpleString()

    @property
    def _schema(self) -> str:
        return f"major long, block long, indices array<long>, values array<{self.kind}>"

    # -- to and from long tables ----------------------------------------------------------------------------------

    @classmethod
    def of(cls, x: DataFrame, layout: str = "csr") -> Packed:
        """From (row_id, col_id, value); entries of one place stay apart until sum_duplicates."""
        major, minor = AXES[layout]
        pair = F.struct(F.col(minor).cast("long").alias("i"), F.col("value").alias("v"))
        block = F.floor(F.col(minor) / BLOCK).cast("long")
        got = x.groupBy(F.col(major).cast("long").alias("major"), block.alias("block")).agg(F.array_sort(F.collect_list(pair)).alias("e"))
        return cls(got.select("major", "block", F.col("e.i").alias("indices"), F.col("e.v").alias("values")), layout)

    def to_long(self) -> DataFrame:
        major, minor = AXES[self.layout]
        each = self.rows.select(F.col("major").alias(major), F.explode(F.arrays_zip("indices", "values")).alias("e"))
        return each.select(F.col(major), F.col("e.indices").alias(minor), F.col("e.values").alias("value")).select("row_id", "col_id", "value")

    # -- layout ---------------------------------------------------------------------------------------------------

    def transpose_layout(self) -> Packed:
        """The same matrix, packed along its other axis. Each task turns its rows a few hundred thousand entries at a
        time; what goes through the shuffle are packed pieces by (major, block), which are merged there."""
        names, size, most = ["major", "block", "indices", "values"], BLOCK, STRETCH

        def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in batches:
                major = np.asarray(t.column(0))
                (minor, off), values = flat_lists(t.column(2)), flat_lists(t.column(3))[0]
                for lo, hi in stretches(off, most):
                    own = np.repeat(major[lo:hi], np.diff(off[lo : hi + 1]))
                    part = slice(off[lo], off[hi])
                    order = np.lexsort((own, minor[part]))
                    yield _rows(minor[part][order], own[order], values[part][order], names, size)

        pieces = self.rows.select(*names).mapInArrow(turn, self._schema)
        merged = pieces.groupBy("major", "block").agg(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("indices", "values")))).alias("e"))
        return Packed(merged.select("major", "block", F.col("e.indices").alias("indices"), F.col("e.values").alias("values")), "csc" if self.layout == "csr" else "csr")

    def tocsr(self) -> Packed:
        return self if self.layout == "csr" else self.transpose_layout()

    def tocsc(self) -> Packed:
        return self if self.layout == "csc" else self.transpose_layout()

    # -- canonical form -------------------------------------------------------------------------------------------

    def _mapped(self, change) -> Packed:
        """change(starts of rows, indices, values) -> which entries stay, and their values; empty rows go."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in batches:
                (minor, off), values = flat_lists(t.column(2)), flat_lists(t.column(3))[0]
                keep, new = change(off, minor, values)
                kept = np.concatenate([[0], np.cumsum(keep)])[off]
                full = np.diff(kept) > 0
                ends = np.concatenate([[0], np.cumsum(np.diff(kept)[full])])
                yield pa.RecordBatch.from_arrays([t.column(0).filter(pa.array(full)), t.column(1).filter(pa.array(full)), lists(minor[keep], ends), lists(new, ends)], names=["major", "block", "indices", "values"])

        return replace(self, rows=self.rows.select("major", "block", "indices", "values").mapInArrow(work, self._schema))

    def eliminate_zeros(self) -> Packed:
        return self._mapped(lambda off, minor, values: (values != 0, values[values != 0]))

    def sum_duplicates(self) -> Packed:
        """Entries of one place are added up; canonical from then on."""

        def fold(off, minor, values):
            first = np.ones(len(minor), bool)
            first[1:] = minor[1:] != minor[:-1]
            first[off[:-1][np.diff(off) > 0]] = True
            return first, np.add.reduceat(values, np.flatnonzero(first)).astype(values.dtype) if len(values) else values

        return self._mapped(fold)

    @property
    def has_sorted_indices(self) -> bool:
        return self.rows.where(F.col("indices") != F.array_sort("indices")).isEmpty()

    @property
    def has_canonical_format(self) -> bool:
        return self.has_sorted_indices and self.rows.where(F.size("indices") > F.size(F.array_distinct("indices"))).isEmpty()

    @property
    def nnz(self) -> int:
        return self.rows.agg(F.coalesce(F.sum(F.size("indices")), F.lit(0))).first()[0]

    # -- indexing -------------------------------------------------------------------------------------------------

    def take(self, rows: DataFrame | None, cols: DataFrame | None) -> DataFrame:
        """(row_id, col_id, value) of the places asked for. rows and cols: (id, position) tables as verbs.chosen gives
        them, in which an id may stand several times; ids in the result are their positions. None: all, ids stay."""
        x = self.to_long()
        for key, asked in (("row_id", rows), ("col_id", cols)):
            if asked is not None:
                x = x.join(asked.select(F.col("id").alias(key), F.col("position").alias("_at")), key).withColumn(key, F.col("_at")).drop("_at")
        return x.select("row_id", "col_id", "value")


def indexed(x: DataFrame, row_keys: DataFrame, col_keys: DataFrame, item) -> DataFrame:
    """x[rows, columns] as (row_id, col_id, value), numbered anew from 0. row_keys and col_keys hold all ids of the axes;
    their order is that of the ids. rows and columns are ints (negative ones count from the end), slices, lists of ints
    (kept in their order, repeats and all) or lists of booleans of full length."""
    parts = item if isinstance(item, tuple) else (item,)
    if not 1 <= len(parts) <= 2:
        raise IndexError("one or two indices")
    parts = [*parts, slice(None)][:2]
    rows, cols = (verbs.chosen(k, c, p) for k, c, p in zip((row_keys, col_keys), ("row_id", "col_id"), parts))
    return Packed.of(x).take(rows, cols)
