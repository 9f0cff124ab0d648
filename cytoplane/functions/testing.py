"""Corrections for multiple tests, as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bonferroni(p: Column, *by: str) -> Column:
    """p times the number of p that are not null, at most 1."""
    return F.least(F.lit(1.0), p * F.count(p).over(Window.partitionBy(*by)))


def with_fdr(df: DataFrame, p: str, out: str, *by: str, tie: str | None = None) -> DataFrame:
    """Benjamini and Hochberg within each group of `by`: from the largest p downwards, the least of p times count over
    rank. Nulls get null and do not count."""
    order = [F.col(p).desc_nulls_last(), *([F.col(tie)] if tie else [])]
    w = Window.partitionBy(*by).orderBy(*order)
    rank = F.count(p).over(Window.partitionBy(*by)) - F.row_number().over(w) + 1
    step = df.withColumn("_step", F.when(F.col(p).isNotNull(), F.col(p) * F.count(p).over(Window.partitionBy(*by)) / rank))
    return step.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))))).drop("_step")
