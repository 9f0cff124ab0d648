"""Quality control, normalisation, variable genes, markers and sums of cells: plans over counts, without Python code
but for the trend of variances (one row a gene) and the pairs of genes of the doublet score."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import binomial_log_sf, local_regression
from . import verbs
from .cells import SingleCell
from .packed import flat_lists
from .staging import staged


def _counts(sc: SingleCell, allow_float: bool) -> DataFrame:
    """X with whole counts; a floating X is refused unless allowed, and then cut down to whole numbers."""
    kind = sc.X.schema["value"].dataType.typeName()
    if kind in ("float", "double") and not allow_float:
        raise TypeError("X has floating-point values; allow_float=True takes their whole part")
    return sc.X.select("row_id", "col_id", F.floor("value").cast("long").alias("value"))


def metrics(sc: SingleCell, mito: Column, allow_float: bool = False) -> DataFrame:
    """row_id, num_counts, num_genes and mito_fraction (null for empty cells) of every cell. The genes' flags are two
    columns a gene and join by Spark's own choice; X is summed by cell with one shuffle."""
    flags = sc.var.select("col_id", F.coalesce(mito, F.lit(False)).alias("_mt"))
    sums = _counts(sc, allow_float).join(flags, "col_id").groupBy("row_id").agg(F.sum("value").alias("num_counts"), F.count("*").alias("num_genes"), F.sum(F.when(F.col("_mt"), F.col("value")).otherwise(0)).alias("_m"))
    all_cells = sc.obs.select("row_id").join(sums, "row_id", "left").fillna(0, ["num_counts", "num_genes", "_m"])
    return all_cells.select("row_id", "num_counts", "num_genes", F.try_divide(F.col("_m").cast("double"), F.col("num_counts").cast("double")).alias("mito_fraction"))


def is_mitochondrial(sc: SingleCell) -> Column:
    return F.upper(F.col(sc.name_column("var"))).startswith("MT-")


def qc_metrics(sc: SingleCell, mito: Column | None = None, allow_float: bool = False, overwrite: bool = False) -> SingleCell:
    new = ["num_counts", "num_genes", "mito_fraction"]
    if not overwrite and (there := [c for c in new if c in sc.obs.columns]):
        raise ValueError(f"{there} are there already")
    m = metrics(sc, is_mitochondrial(sc) if mito is None else mito, allow_float)
    return replace(sc, obs=sc.obs.drop(*new).join(m, "row_id"))


def qc(sc: SingleCell, mito: Column | None = None, malat1: Column | None = None, custom_filter=None, max_mito_fraction: float | None = 0.05, min_genes: int | None = 100, nonzero_MALAT1: bool = True, remove_doublets: bool = False, batch_column=None, subset: bool = False, QC_column: str = "passed_QC", allow_float: bool = False, overwrite: bool = False, **doublets) -> SingleCell:
    """Cells with at most max_mito_fraction of mitochondrial counts, at least min_genes genes, counts of MALAT1, and what
    custom_filter asks for; then, if asked, no doublets among these. Flags them in QC_column or keeps only them."""
    if not subset and QC_column in sc.obs.columns and not overwrite:
        raise ValueError(f"{QC_column!r} is there already")
    if sc.obs.groupBy(sc.name_column("obs")).count().where("count > 1").limit(1).count():
        raise ValueError("cell names are not unique")
    m = metrics(sc, is_mitochondrial(sc) if mito is None else mito, allow_float)
    ok = F.col("num_counts") > 0
    if max_mito_fraction is not None:
        ok &= F.coalesce(F.col("mito_fraction") <= max_mito_fraction, F.lit(False))
    if min_genes is not None:
        ok &= F.col("num_genes") >= min_genes
    good = m.where(ok).select("row_id")
    if nonzero_MALAT1:
        gene = sc.var.where(F.upper(F.col(sc.name_column("var"))) == "MALAT1" if malat1 is None else malat1).select("col_id")
        good = good.join(sc.X.join(gene, "col_id", "left_semi").select("row_id").distinct(), "row_id", "left_semi")
    if custom_filter is not None:
        good = good.join(sc.obs.where(verbs.resolve(sc.obs, custom_filter)).select("row_id"), "row_id", "left_semi")
    if remove_doublets:
        found = find_doublets(sc.restrict("obs", sc.obs.join(good, "row_id", "left_semi").select(*sc.obs.columns)), batch_column=batch_column, allow_float=allow_float, **doublets)
        good = found.obs.where(~F.col("doublet")).select("row_id")
    out = replace(sc, uns=sc.uns | {"QCed": True})
    if subset:
        return out.restrict("obs", sc.obs.join(good, "row_id", "left_semi").select(*sc.obs.columns))
    flagged = sc.obs.drop(QC_column).join(good.withColumn(QC_column, F.lit(True)), "row_id", "left")
    return replace(out, obs=flagged.withColumn(QC_column, F.coalesce(QC_column, F.lit(False))))


def skip_qc(sc: SingleCell) -> SingleCell:
    return replace(sc, uns=sc.uns | {"QCed": True})


def normalize(sc: SingleCell, method: str = "log1pPF", QC_column: str | None = "passed_QC", allow_float: bool = False) -> SingleCell:
    """logCP10k: log1p(x 10^4 / sum); log1pPF: log1p(x mean / sum), mean over cells that passed; PFlog1pPF: log1pPF
    scaled once more by the mean of its sums. Cells that failed are changed as well."""
    if method not in ("logCP10k", "log1pPF", "PFlog1pPF"):
        raise ValueError("method is logCP10k, log1pPF or PFlog1pPF")
    x = _counts(sc, allow_float)
    totals = x.groupBy("row_id").agg(F.sum("value").cast("double").alias("_s"))
    passed = sc.passing(QC_column).obs.select("row_id")

    def mean(sums: DataFrame) -> Column:
        per = passed.join(sums, "row_id", "left").agg(F.avg(F.coalesce("_s", F.lit(0.0)))).first()[0]
        return F.lit(float(per or 0.0))

    # a cell's entries, as many as there are genes at most, meet once; a join would need X twice
    x = x.withColumn("_s", F.sum("value").over(Window.partitionBy("row_id")).cast("double"))
    y = x.select("row_id", "col_id", F.log1p(F.col("value") * (F.lit(1e4) if method == "logCP10k" else mean(totals)) / F.col("_s")).alias("value"))
    if method == "PFlog1pPF":
        sums = y.groupBy("row_id").agg(F.sum("value").alias("_s"))
        y = y.join(sums, "row_id").select("row_id", "col_id", (F.col("value") * mean(sums) / F.col("_s")).alias("value"))
    return replace(sc, X=y)


def gene_moments(sc: SingleCell, QC_column: str | None = "passed_QC", allow_float: bool = False) -> DataFrame:
    """col_id, n (cells), mean and variance (n - 1) of every gene over the cells that passed, zeros counted."""
    cells = sc.passing(QC_column)
    n = cells.obs.count()
    x = _counts(cells, allow_float).groupBy("col_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    s, q = F.coalesce("s", F.lit(0)).cast("double"), F.coalesce("q", F.lit(0)).cast("double")
    var = (q - s * s / n) / max(n - 1, 1)
    return sc.var.select("col_id").join(x, "col_id", "left").select("col_id", F.lit(n).alias("n"), (s / n).alias("mean"), F.greatest(var, F.lit(0.0)).alias("variance"))


def batch_moments(x: DataFrame, sizes: DataFrame) -> DataFrame:
    """batch, col_id, n, mean, variance (n - 1) of the genes that a batch has counts of, zeros counted; x has (batch,
    row_id, col_id, value), sizes (batch, n), the number of cells. One pass over x for any number of batches."""
    sums = x.groupBy("batch", "col_id").agg(F.sum("value").cast("double").alias("s"), F.sum(F.col("value") * F.col("value")).cast("double").alias("q")).join(sizes, "batch")
    var = (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / F.greatest(F.col("n") - 1, F.lit(1))
    return sums.select("batch", "col_id", "n", (F.col("s") / F.col("n")).alias("mean"), F.greatest(var, F.lit(0.0)).alias("variance"))


def batched(sc: SingleCell, batch_column, QC_column: str | None, allow_float: bool) -> tuple[DataFrame, DataFrame]:
    """X as (batch, row_id, col_id, value) over the cells that passed and have a batch, and (batch, n) of the batches;
    without a column all cells are one batch. Batches are text."""
    cells = sc.passing(QC_column)
    batch = F.lit("") if batch_column is None else verbs.resolve(cells.obs, batch_column).cast("string")
    of = cells.obs.select("row_id", batch.alias("batch")).where("batch is not null")
    return _counts(cells, allow_float).join(of, "row_id").select("batch", "row_id", "col_id", "value"), of.groupBy("batch").agg(F.count("*").alias("n"))


def hvg(*datasets: SingleCell, num_genes: int = 2000, batch_column=None, QC_column: str | None = "passed_QC", span: float = 0.3, allow_float: bool = False, hvg_column: str = "highly_variable", rank_column: str = "highly_variable_rank"):
    """Genes by variance of their standardised counts: the variance that a local regression of log10 variance on log10
    mean expects, counts cut off at sqrt(n) standard deviations. With batches or several datasets each ranks by itself;
    genes go by how often they are among the top, then by their median rank, then by their rank over all.

    X is read twice, however many batches there are: for sums by batch and gene, and for sums of the standardised counts.
    Trends are fitted batch by batch in a grouped map, over a row a gene. Genes are told apart by col_id, so that names may
    recur; several datasets are matched by name, which must be unique in each then, or ValueError is raised."""
    named = len(datasets) > 1
    xs, sizes, genes = [], [], []
    for k, sc in enumerate(datasets):
        name = sc.name_column("var")
        if named and sc.var.groupBy(name).count().where("count > 1").limit(1).count():
            raise ValueError("gene names are not unique: datasets can't be matched by them")
        x, n = batched(sc, batch_column, QC_column, allow_float)
        mark = F.concat_ws("/", F.lit(str(k)), "batch").alias("batch")
        xs.append(x.select(mark, "row_id", "col_id", "value"))
        sizes.append(n.select(mark, "n"))
        # a batch ranks all genes of its dataset
        sizes[-1] = staged(sizes[-1], "batches")
        own = [r["batch"] for r in sizes[-1].collect()]
        genes.append(sc.var.select(F.explode(F.array(*map(F.lit, own)).cast("array<string>")).alias("batch"), "col_id", (F.col(name).cast("string") if named else F.col("col_id").cast("long")).alias("gene")))
    x, sizes, genes = (verbs.stacked(t, False, "batches") for t in (xs, sizes, genes))

    def fit(table: pa.Table) -> pa.Table:
        mean, variance = (table.column(c).to_numpy() for c in ("mean", "variance"))
        fits = variance > 0
        expected = np.zeros(len(mean))
        if fits.sum() > 3:
            expected[fits] = 10 ** local_regression(np.log10(mean[fits]), np.log10(variance[fits]), span)
        return pa.table({"batch": table.column("batch"), "col_id": table.column("col_id"), "n": table.column("n"), "m": mean, "sd": np.sqrt(expected)})

    trend = staged(batch_moments(x, sizes).groupBy("batch").applyInArrow(lambda t: fit(t.sort_by("col_id")), "batch string, col_id long, n long, m double, sd double"), "trend")
    z = F.least((F.col("value") - F.col("m")) / F.col("sd"), F.sqrt("n"))
    z0 = -F.col("m") / F.col("sd")
    scored = x.join(trend.where("sd > 0"), ["batch", "col_id"]).groupBy("batch", "col_id").agg(F.sum(z * z).alias("a"), F.count("*").alias("k"), F.first(z0 * z0).alias("zero"), F.first("n").alias("n"))
    scored = scored.select("batch", "col_id", ((F.col("a") + (F.col("n") - F.col("k")) * F.col("zero")) / F.greatest(F.col("n") - 1, F.lit(1))).alias("v"))
    w = Window.partitionBy("batch").orderBy(F.desc("v"), "col_id")
    ranks = genes.join(scored, ["batch", "col_id"], "left").fillna(0.0, "v").withColumn("rank", F.row_number().over(w))
    top = F.col("rank") <= num_genes
    per = ranks.groupBy("gene").agg(F.count("*").alias("_in"), F.sum(top.cast("int")).alias("in_top"), F.median(F.when(top, F.col("rank"))).alias("median"), F.median("rank").alias("all"))
    per = per.join(sizes.agg(F.count("*").alias("_of")), F.col("_in") == F.col("_of"))
    best = per.orderBy(F.desc("in_top"), F.asc_nulls_last("median"), "all", "gene").limit(num_genes)
    rank = F.row_number().over(Window.orderBy(F.desc("in_top"), F.asc_nulls_last("median"), "all", "gene"))  # of num_genes rows
    marks = staged(best.select("gene", rank.cast("long").alias(rank_column)), "variable")
    out = []
    for sc in datasets:
        key = sc.name_column("var") if named else "col_id"
        var = sc.var.drop(hvg_column, rank_column)
        joined = var.join(marks.withColumnRenamed("gene", "_gene"), F.col(key).cast("string" if named else "long") == F.col("_gene"), "left")
        out.append(replace(sc, var=joined.select(*var.columns, F.col(rank_column).isNotNull().alias(hvg_column), rank_column)))
    return out[0] if len(out) == 1 else tuple(out)


def sum_by(sc: SingleCell, sample: str, cell_type: str, QC_column: str | None = "passed_QC", allow_float: bool = False) -> tuple[DataFrame, DataFrame]:
    """Summed counts (cell_type, sample, gene, value) and cells (cell_type, sample, num_cells, columns that are constant
    within each sample). Sums are combined before they are shuffled, so a sample with a third of all cells is no task
    of its own. Genes are named from here on: names that are not unique raise ValueError."""
    if sc.var.groupBy(sc.name_column("var")).count().where("count > 1").limit(1).count():
        raise ValueError("gene names are not unique; make_var_names_unique() makes them so")
    cells = sc.passing(QC_column)
    obs = cells.obs.where(F.col(sample).isNotNull() & F.col(cell_type).isNotNull())
    key = obs.select("row_id", F.col(cell_type).alias("cell_type"), F.col(sample).alias("sample"))
    name = sc.name_column("var")
    x = _counts(cells, allow_float).join(key, "row_id").groupBy("cell_type", "sample", "col_id").agg(F.sum("value").alias("value"))
    x = x.join(sc.var.select("col_id", F.col(name).alias("gene")), "col_id").select("cell_type", "sample", "gene", "value")
    skip = {"row_id", sc.name_column("obs"), sample, cell_type, QC_column}
    same = verbs.constant_columns(obs, [sample], [c for c in obs.columns if c not in skip])
    per = obs.groupBy(F.col(cell_type).alias("cell_type"), F.col(sample).alias("sample")).agg(F.count("*").alias("num_cells"), *(F.first(c).alias(c) for c in same))
    return x, verbs.levels_like(per, obs)


def sample_covariates(sc: SingleCell, sample: str, QC_column: str | None = "passed_QC") -> DataFrame:
    """A row for each sample with the columns of obs that are constant within samples."""
    obs = sc.passing(QC_column).obs.where(F.col(sample).isNotNull())
    same = verbs.constant_columns(obs, [sample], [c for c in obs.columns if c not in ("row_id", sc.name_column("obs"), sample, QC_column)])
    return verbs.levels_like(obs.groupBy(sample).agg(*(F.first(c).alias(c) for c in same)), obs) if same else obs.select(sample).distinct()


def crosstab(sc: SingleCell, rows: str, columns: str, normalize_rows: bool = False) -> DataFrame:
    """Cells by two columns, in long form (row, column, count or share of the row): what a heat map shows."""
    n = sc.obs.where(F.col(rows).isNotNull() & F.col(columns).isNotNull()).groupBy(F.col(rows).alias("row"), F.col(columns).alias("column")).agg(F.count("*").alias("n"))
    if not normalize_rows:
        return n
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("row"))).drop("n")


def detection(sc: SingleCell, cell_type: str, QC_column: str | None = "passed_QC") -> DataFrame:
    """cell_type, gene, detection_rate and fold_change (null where no other cell has the gene) for genes that some cell
    of the type has. fold_change: the rate over the rate in all other cells."""
    cells = sc.passing(QC_column)
    kind = cells.obs.where(F.col(cell_type).isNotNull()).select("row_id", F.col(cell_type).alias("cell_type"))
    sizes = kind.groupBy("cell_type").agg(F.count("*").alias("n_t"))
    total = kind.count()
    seen = cells.X.where("value <> 0").join(kind, "row_id").groupBy("cell_type", "col_id").agg(F.count("*").alias("n_tg"))
    per = seen.withColumn("n_g", F.sum("n_tg").over(Window.partitionBy("col_id"))).join(sizes, "cell_type")
    rate = F.col("n_tg") / F.col("n_t")
    fold = F.try_divide(rate * (total - F.col("n_t")), (F.col("n_g") - F.col("n_tg")).cast("double"))
    return per.select("cell_type", "col_id", rate.alias("detection_rate"), fold.alias("fold_change"))


def find_markers(sc: SingleCell, cell_type: str, min_detection_rate: float = 0.25, min_fold_change: float = 2.0, pareto: bool = True, all_genes: bool = False, QC_column: str | None = "passed_QC") -> DataFrame:
    """Genes over both thresholds for each type and, with pareto, no other of these better in both; among equals the last
    gene stays. A gene that only the type has counts as of infinite fold change, given as null."""
    d = detection(sc, cell_type, QC_column).withColumn("_f", F.coalesce("fold_change", F.lit(float("inf"))))
    ok = (F.col("detection_rate") >= min_detection_rate) & (F.col("_f") >= min_fold_change)
    d = d.withColumn("_ok", ok)
    if pareto:
        w = Window.partitionBy("cell_type", "_ok").orderBy(F.desc("detection_rate"), F.desc("_f"), F.desc("col_id")).rowsBetween(Window.unboundedPreceding, -1)
        d = d.withColumn("_best", F.max("_f").over(w)).withColumn("marker", F.col("_ok") & (F.col("_best").isNull() | (F.col("_f") > F.col("_best"))))
    else:
        d = d.withColumn("marker", F.col("_ok"))
    named = d.join(sc.var.select("col_id", F.col(sc.name_column("var")).alias("gene")), "col_id")
    cols = ["cell_type", "gene", "col_id", "detection_rate", "fold_change"]
    return named.select(*cols, "marker") if all_genes else named.where("marker").select(*cols)


def dot_plot(sc: SingleCell, genes: list[str], cell_type: str, QC_column: str | None = "passed_QC") -> DataFrame:
    """cell_type, gene, detection_rate and mean_expression of the named genes: what a marker plot shows."""
    cells = sc.passing(QC_column)
    name = sc.name_column("var")
    kind = cells.obs.where(F.col(cell_type).isNotNull()).select("row_id", F.col(cell_type).alias("cell_type"))
    sizes = kind.groupBy("cell_type").agg(F.count("*").alias("n"))
    chosen = sc.var.where(F.col(name).isin(genes)).select("col_id", F.col(name).alias("gene"))
    got = cells.X.join(chosen, "col_id").join(kind, "row_id").groupBy("cell_type", "gene").agg(F.count("*").alias("k"), F.sum("value").cast("double").alias("s"))
    return got.join(sizes, "cell_type").select("cell_type", "gene", (F.col("k") / F.col("n")).alias("detection_rate"), (F.col("s") / F.col("n")).alias("mean_expression"))


# -- doublets ---------------------------------------------------------------------------------------------------------


def presence(places: pa.Array, size: int) -> np.ndarray:
    """Cells by genes: 1 where the list of a cell's genes has it."""
    at, off = flat_lists(places)
    m = np.zeros((len(places), size), np.float32)
    m[np.repeat(np.arange(len(places)), np.diff(off)), at] = 1
    return m


def cells_with_both(lists: DataFrame, size: int) -> DataFrame:
    """(batch, k, s): for each two of at most `size` genes of a batch, in how many of its cells they are together, a row
    for each gene k with the counts of all genes as 8-byte numbers. lists has (batch, places), a row a cell. Tasks see
    one batch after another and hold the counts of one; rows of a gene are added up in one task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros((size, size))

        def rows() -> pa.RecordBatch:
            used = np.flatnonzero(np.diag(total))
            return pa.RecordBatch.from_arrays([pa.array([now] * len(used), pa.string()), pa.array(used), pa.array([total[k].tobytes() for k in used], pa.binary())], names=["batch", "k", "s"])

        for t in batches:
            name = t.column(0).to_pylist()
            cuts = [0, *(i for i in range(1, len(name)) if name[i] != name[i - 1]), len(name)] if name else []
            for lo, hi in zip(cuts, cuts[1:]):
                if name[lo] != now:
                    if now is not None:
                        yield rows()
                    now, total = name[lo], np.zeros((size, size))
                m = presence(t.column(1)[lo:hi], size)
                total += m.T @ m
        if now is not None:
            yield rows()

    def add(table: pa.Table) -> pa.Table:
        return pa.table({"batch": [table.column("batch")[0].as_py()], "k": [table.column("k")[0].as_py()], "s": pa.array([sum(np.frombuffer(x) for x in table.column("s").to_pylist()).tobytes()], pa.binary())})

    return lists.select("batch", "places").sortWithinPartitions("batch").mapInArrow(work, "batch string, k long, s binary").groupBy("batch", "k").applyInArrow(add, "batch string, k long, s binary")


#: Pairs that one task counts.
COUNTED = 1_000_000


def pair_counts(x: DataFrame) -> DataFrame:
    """(a, b, n): in how many cells two genes a < b are together, for any number of genes. x has a row for each cell and
    gene (row_id, col_id). Pairs are made within a cell's row, a gene of it at a time, and dealt to as many tasks as their
    number needs, so that no task's memory grows with the table."""
    # a cell's genes, as many as there are genes at most
    cells = staged(x.groupBy("row_id").agg(F.sort_array(F.collect_list("col_id")).alias("g")), "genes")
    met = cells.agg(F.sum(F.size("g").cast("long") * (F.size("g") - 1) / 2)).first()[0] or 0
    tasks = max(1, int(met // COUNTED) + 1)
    rest = F.expr("slice(g, k + 2, size(g))")
    one = cells.where(F.size("g") > 1).select("g", F.posexplode("g").alias("k", "a")).select("a", F.explode(rest).alias("b"))
    return one.repartition(tasks, "a", "b").groupBy("a", "b").agg(F.count("*").alias("n"))


def unpacked_counts(counts: DataFrame) -> DataFrame:
    """(batch, k, l, n) of the rows of cells_with_both."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            rows = [np.frombuffer(x) for x in t.column(2).to_pylist()]
            if rows:
                at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
                yield pa.RecordBatch.from_arrays([t.column(0).take(pa.array(at)), t.column(1).take(pa.array(at)), pa.array(np.concatenate([np.arange(len(r)) for r in rows])), pa.array(np.concatenate(rows))], names=["batch", "k", "l", "n"])

    return counts.select("batch", "k", "s").mapInArrow(work, "batch string, k long, l long, n double")


def pair_scores(both: np.ndarray, n: int) -> np.ndarray:
    """How unlikely it is, as minus the logarithm of the chance, that so many of n cells have just one of two genes."""
    p = np.diag(both) / n
    one = np.diag(both)[:, None] + np.diag(both) - 2 * both
    a, b = np.triu_indices(len(both), 1)
    q = p[a] * (1 - p[b]) + (1 - p[a]) * p[b]
    out = np.zeros_like(both)
    out[a, b] = np.where(one[a, b] > 0, -binomial_log_sf(one[a, b] - 1, n, q), 0.0)
    return out + out.T


#: Cells of a batch that one task scores.
SCORED = 50_000


def _scores(lists: DataFrame, weights: DataFrame, parts: DataFrame, size: int) -> DataFrame:
    """(row_id, score) of the cells of lists (batch, row_id, places); weights has a matrix a batch, parts the number of
    tasks that a batch is dealt to. A matrix goes to each task of its batch, and to no other."""

    def work(cells: pa.Table, matrix: pa.Table) -> pa.Table:
        if not cells.num_rows or not matrix.num_rows:
            return pa.table({"row_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        w = np.frombuffer(matrix.column("w")[0].as_py()).reshape(size, size)
        out = []
        for t in cells.select(["places"]).combine_chunks().to_batches(max_chunksize=10_000):
            m = presence(t.column(0), size)
            out.append(((m @ w) * m).sum(1) / 2)
        return pa.table({"row_id": cells.column("row_id"), "score": np.concatenate(out)})

    dealt = lists.join(parts, "batch").withColumn("part", F.pmod(F.xxhash64("row_id"), F.col("parts")).cast("int")).select("batch", "part", "row_id", "places")
    copies = weights.join(parts, "batch").select("batch", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "w")
    return dealt.groupBy("batch", "part").cogroup(copies.groupBy("batch", "part")).applyInArrow(work, "row_id long, score double")


def find_doublets(sc: SingleCell, batch_column=None, num_genes: int = 500, doublet_fraction: float | None = None, QC_column: str | None = "passed_QC", doublet_column: str = "doublet", doublet_score_column: str = "doublet_score", seed: int = 0, allow_float: bool = False) -> SingleCell:
    """Co-expression score: a cell's sum, over the pairs of chosen genes that it has both of, of how unlikely it is that
    so many cells have just one of the two. Genes are those seen nearest to half of the cells. Doublets are the given
    fraction of highest scores or, without one, cells at or over the median score of pairs of cells put together.

    Batches have their own genes, pair counts and scores; all of them are found in one pass, keyed by batch. Cells that
    did not pass or have no batch get nulls."""
    cells = sc.passing(QC_column)
    batch = F.lit("") if batch_column is None else verbs.resolve(cells.obs, batch_column).cast("string")
    # cells and counts are written once: what follows reads them several times
    every = staged(cells.obs.select("row_id", batch.alias("batch")).where("batch is not null"), "cells")
    x = staged(_counts(cells, allow_float).join(every, "row_id").where("value > 0").select("batch", "row_id", "col_id", "value"), "counts")
    sizes = staged(every.groupBy("batch").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / SCORED).cast("int")), "batches")
    parts = sizes.select("batch", "parts")
    k = x.groupBy("batch", "col_id").agg(F.count("*").alias("k")).join(sizes, "batch")
    near = Window.partitionBy("batch").orderBy(F.abs(F.col("k") / F.col("n") - 0.5), "col_id")
    chosen = k.withColumn("place", F.row_number().over(near) - 1).where(F.col("place") < num_genes).select("batch", "col_id", "place")
    present = x.join(chosen, ["batch", "col_id"]).groupBy("batch", "row_id").agg(F.collect_list(F.struct(F.col("place").cast("long").alias("place"), "value")).alias("e"))  # at most num_genes each
    present = staged(present, "lists")
    lists = present.select("batch", "row_id", F.col("e.place").alias("places"))

    def weigh(table: pa.Table) -> pa.Table:
        both = np.zeros((num_genes, num_genes))
        for g, s in zip(table.column("k").to_pylist(), table.column("s").to_pylist()):
            both[g] = np.frombuffer(s)
        return pa.table({"batch": [table.column("batch")[0].as_py()], "w": pa.array([pair_scores(both, table.column("n")[0].as_py()).tobytes()], pa.binary())})

    counts = cells_with_both(lists, num_genes).join(sizes.select("batch", "n"), "batch")
    weights = staged(counts.groupBy("batch").applyInArrow(weigh, "batch string, w binary"), "weights")
    own = staged(every.join(_scores(lists, weights, parts, num_genes), "row_id", "left").fillna(0.0, "score"), "scores")
    if doublet_fraction is not None:
        ranked = verbs.numbered(own, [F.desc("score"), F.asc("row_id")], ["batch"], "_place").join(sizes.select("batch", "n"), "batch")
        got = ranked.select("row_id", (F.col("_place") < F.floor(F.col("n") * doublet_fraction)).alias(doublet_column), F.col("score").alias(doublet_score_column))
    else:
        # pairs of cells: each with the one next to it in a seeded order; a gene of one of the two is kept for sure if
        # its count is over one, else by the toss of a seeded coin
        rank = every.join(sizes, "batch").withColumn("_h", F.xxhash64("row_id", F.lit(seed)))
        w = Window.partitionBy("batch", F.pmod("_h", F.greatest(F.lit(1), F.floor(F.col("n") / 5000)))).orderBy("_h")
        mates = rank.withColumn("_m", F.lead("row_id").over(w)).where("_m IS NOT NULL").select("batch", "row_id", "_m")
        # cells meet as rows with their genes, and all genes of a pair are in one task before they are told apart
        none = F.array().cast(present.schema["e"].dataType)
        tasks = int(sizes.agg(F.sum("parts")).first()[0] or 1)
        dealt = lambda t, by: t.repartition(tasks, "batch", by)  # noqa: E731  so that a task has no more cells in a larger table
        other = dealt(mates, "_m").join(dealt(present.select("batch", F.col("row_id").alias("_m"), F.col("e").alias("_e")), "_m"), ["batch", "_m"], "left")
        both = dealt(other, "row_id").join(dealt(present, "row_id"), ["batch", "row_id"], "left").select("batch", "row_id", F.explode(F.concat(F.coalesce("e", none), F.coalesce("_e", none))).alias("e"))
        merged = both.groupBy("batch", "row_id", F.col("e.place").alias("place")).agg(F.count("*").alias("c"), F.max("e.value").alias("v"))
        coin = F.pmod(F.xxhash64("row_id", "place", F.lit(seed + 1)), F.lit(2)) == 0
        simulated = mates.select("batch", "row_id").join(_scores(merged.where((F.col("c") > 1) | (F.col("v") > 1) | coin).groupBy("batch", "row_id").agg(F.collect_list("place").alias("places")), weights, parts, num_genes), "row_id", "left").fillna(0.0, "score")
        cut = simulated.groupBy("batch").agg(F.median("score").alias("_cut"))
        got = own.join(cut, "batch", "left").select("row_id", F.coalesce(F.col("score") >= F.col("_cut"), F.lit(False)).alias(doublet_column), F.col("score").alias(doublet_score_column))
    return replace(sc, obs=sc.obs.drop(doublet_column, doublet_score_column).join(got, "row_id", "left"))


for _name, _f in {"qc_metrics": qc_metrics, "qc": qc, "skip_qc": skip_qc, "normalize": normalize, "hvg": hvg, "find_doublets": find_doublets, "get_sample_covariates": sample_covariates, "find_markers": find_markers, "plot_heatmap": crosstab, "plot_markers": dot_plot}.items():
    setattr(SingleCell, _name, _f)
