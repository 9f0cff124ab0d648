"""The queries of the engine over the driver's tables, and their DuckDB SQL.

Orders are cells, parts are genes (by brand for the coarse grid), quantities are counts, order priority is the cell
type, customer nation the donor and order status the treatment; embeddings are components."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import Pseudobulk, SingleCell, concat_obs
from ..functions.testing import bonferroni, with_fdr
from ..operators import cell_analysis as ca
from ..operators import neighbors as nn
from ..operators import verbs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__.removeprefix("q_")] = f
        if sql:
            ORACLE_SQL[f.__name__.removeprefix("q_")] = sql
        return f

    return add


def fine(spark: SparkSession, d: str) -> SingleCell:
    """Orders by parts."""
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    x = t("lineitem").groupBy(F.col("l_orderkey").alias("row_id"), F.col("l_partkey").alias("col_id")).agg(F.sum("l_quantity").cast("long").alias("value"))
    # customers and parts grow with the tables: a broadcast would bring them whole to the driver
    obs = t("orders").join(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey").hint("merge"), "o_custkey").select(
        F.col("o_orderkey").alias("row_id"), F.concat(F.lit("cell"), F.col("o_orderkey").cast("string")).alias("cell"), F.col("o_orderpriority").alias("cell_type"), F.col("c_nationkey").alias("donor"), F.col("o_orderstatus").alias("treatment"), F.concat_ws("_", F.col("c_nationkey").cast("string"), "o_orderstatus").alias("sample"))
    var = t("part").select(F.col("p_partkey").alias("col_id"), F.concat(F.lit("gene"), F.col("p_partkey").cast("string")).alias("gene"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").alias("size"))
    return SingleCell(x, obs, var)


def coarse(spark: SparkSession, d: str) -> SingleCell:
    """Orders by brands."""
    sc = fine(spark, d)
    brands = sc.var.select("brand").distinct().select(F.regexp_extract("brand", r"(\d+)", 1).cast("long").alias("col_id"), F.col("brand").alias("gene"))
    x = sc.X.join(sc.var.select("col_id", F.regexp_extract("brand", r"(\d+)", 1).cast("long").alias("b")).hint("merge"), "col_id").groupBy("row_id", F.col("b").alias("col_id")).agg(F.sum("value").alias("value"))
    return SingleCell(x, sc.obs, brands)


def components(spark: SparkSession, d: str) -> SingleCell:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    obs = e.select(F.col("vec_id").alias("row_id"), F.col("vec_id").cast("string").alias("cell"), F.concat(F.lit("l"), F.col("label").cast("string")).alias("label"), (F.col("vec_id") % 4).cast("string").alias("batch"))
    var = spark.range(1).select(F.col("id").alias("col_id"), F.lit("none").alias("gene"))
    return SingleCell(None, obs, var, obsm={"pca": e.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("value"))})


def bulk(spark: SparkSession, d: str) -> Pseudobulk:
    return coarse(spark, d).pseudobulk("sample", "cell_type")


def counted(pb: Pseudobulk) -> Pseudobulk:
    """Without samples and genes of a type that have no counts at all; such have no library sizes."""
    seen = pb.X.where("value > 0")
    keep = lambda t, keys: t.join(seen.select(*keys).distinct(), keys, "left_semi").select(*t.columns)
    return replace(pb, obs=keep(pb.obs, ["cell_type", "sample"]), var=keep(pb.var, ["cell_type", "gene"]))


def promo():
    return F.col("type") == "PROMO"

# The views that the SQL starts from.
_V = """
X AS (SELECT l_orderkey row_id, l_partkey col_id, CAST(sum(l_quantity) AS BIGINT) AS "value" FROM lineitem GROUP BY 1, 2),
obs AS (SELECT o_orderkey row_id, 'cell' || o_orderkey cell, o_orderpriority cell_type, c_nationkey donor, o_orderstatus treatment, c_nationkey || '_' || o_orderstatus "sample" FROM orders JOIN customer ON o_custkey = c_custkey),
var AS (SELECT p_partkey col_id, 'gene' || p_partkey gene, p_brand brand, p_type "type", p_size size FROM part)"""
_C = _V + """,
CX AS (SELECT row_id, brand gene, sum("value") AS "value" FROM X JOIN var USING (col_id) GROUP BY 1, 2),
PX AS (SELECT cell_type, "sample", gene, CAST(sum("value") AS BIGINT) AS "value" FROM CX JOIN obs USING (row_id) GROUP BY 1, 2, 3),
PO AS (SELECT cell_type, "sample", min(donor) donor, min(treatment) treatment, count(*) num_cells FROM obs GROUP BY 1, 2),
PV AS (SELECT DISTINCT cell_type, brand gene FROM PO, var),
PD AS (SELECT PO.cell_type, PO."sample", PV.gene, coalesce(PX."value", 0) AS "value" FROM PO JOIN PV ON PO.cell_type = PV.cell_type LEFT JOIN PX ON PX.cell_type = PO.cell_type AND PX."sample" = PO."sample" AND PX.gene = PV.gene)"""
_M = _V + """,
M AS (SELECT obs.row_id, coalesce(sum("value"), 0)::BIGINT num_counts, count("value") num_genes, coalesce(sum(CASE WHEN "type" = 'PROMO' THEN "value" END), 0)::BIGINT mt FROM obs LEFT JOIN X ON X.row_id = obs.row_id LEFT JOIN var ON var.col_id = X.col_id GROUP BY 1)"""


def w(sql: str, views: str = _V) -> str:
    return f"WITH {views.strip()} {sql}"


# -- cells ------------------------------------------------------------------------------------------------------------


@query(w("SELECT row_id, num_counts, num_genes, CASE WHEN num_counts > 0 THEN round(mt * 1.0::DOUBLE / num_counts, 9) END mito_fraction FROM M", _M))
def q_qc_metrics(spark, d):
    return fine(spark, d).qc_metrics(mito=promo()).obs.select("row_id", "num_counts", "num_genes", F.round("mito_fraction", 9).alias("mito_fraction"))


_PASS = "num_counts > 0 AND mt * 1.0::DOUBLE / num_counts <= 0.4 AND num_genes >= 2"


@query(w(f"SELECT row_id FROM M WHERE {_PASS}", _M))
def q_qc_filter(spark, d):
    return fine(spark, d).qc(mito=promo(), max_mito_fraction=0.4, min_genes=2, nonzero_MALAT1=False, subset=True).obs.select("row_id")


@query(w(f"SELECT row_id, ({_PASS} AND row_id IN (SELECT row_id FROM X JOIN var USING (col_id) WHERE brand = 'Brand#4')) \"passed_QC\" FROM M", _M))
def q_qc_flag(spark, d):
    return fine(spark, d).qc(mito=promo(), malat1=F.col("brand") == "Brand#4", max_mito_fraction=0.4, min_genes=2).obs.select("row_id", "passed_QC")


@query(w('SELECT cell_type, "sample", gene, "value" FROM PX', _C))
def q_pseudobulk_sum(spark, d):
    return bulk(spark, d).X


@query(w('SELECT cell_type, "sample", num_cells, donor, treatment FROM PO', _C))
def q_pseudobulk_num_cells(spark, d):
    return bulk(spark, d).obs.select("cell_type", "sample", "num_cells", "donor", "treatment")


@query(w('SELECT "sample", min(donor) donor, min(treatment) treatment FROM obs GROUP BY 1'))
def q_sample_covariates(spark, d):
    return fine(spark, d).get_sample_covariates("sample").select("sample", "donor", "treatment")


@query(w("SELECT cell_type, count(*) n FROM obs GROUP BY 1"))
def q_value_counts(spark, d):
    return fine(spark, d).obs.groupBy("cell_type").agg(F.count("*").alias("n"))


@query(w('SELECT cell_type "row", treatment "column", round(count(*) * 1.0::DOUBLE / sum(count(*)) OVER (PARTITION BY cell_type), 9) AS "share" FROM obs GROUP BY 1, 2'))
def q_crosstab(spark, d):
    return fine(spark, d).plot_heatmap("cell_type", "treatment", normalize_rows=True).select("row", "column", F.round("share", 9).alias("share"))


_D = """,
T AS (SELECT cell_type, col_id, count(*) n_tg FROM X JOIN obs USING (row_id) GROUP BY 1, 2),
N AS (SELECT cell_type, count(*) n_t FROM obs GROUP BY 1),
D AS (SELECT cell_type, col_id, n_tg * 1.0::DOUBLE / n_t detection_rate, CASE WHEN sum(n_tg) OVER (PARTITION BY col_id) > n_tg THEN (n_tg * 1.0::DOUBLE / n_t) * ((SELECT count(*) FROM obs) - n_t) / (sum(n_tg) OVER (PARTITION BY col_id) - n_tg) END fold_change FROM T JOIN N USING (cell_type))"""
_E = "E AS (SELECT *, coalesce(fold_change, 1e300) f, detection_rate >= 0.001 AND coalesce(fold_change, 1e300) >= 1.5 ok FROM D)"


@query(w("SELECT cell_type, col_id, round(detection_rate, 9) detection_rate, round(fold_change, 9) fold_change FROM D", _V + _D))
def q_detection_rate(spark, d):
    return ca.detection(fine(spark, d), "cell_type").select("cell_type", "col_id", F.round("detection_rate", 9).alias("detection_rate"), F.round("fold_change", 9).alias("fold_change"))


@query(w("SELECT cell_type, gene, round(detection_rate, 9) detection_rate, round(fold_change, 9) fold_change FROM E a JOIN var USING (col_id) WHERE ok AND NOT EXISTS (SELECT 1 FROM E b WHERE b.ok AND b.cell_type = a.cell_type AND b.col_id <> a.col_id AND ((b.detection_rate > a.detection_rate AND b.f >= a.f) OR (b.detection_rate = a.detection_rate AND b.f > a.f) OR (b.detection_rate = a.detection_rate AND b.f = a.f AND b.col_id > a.col_id)))", _V + _D + ", " + _E))
def q_markers_pareto(spark, d):
    m = fine(spark, d).find_markers("cell_type", min_detection_rate=0.001, min_fold_change=1.5)
    return m.select("cell_type", "gene", F.round("detection_rate", 9).alias("detection_rate"), F.round("fold_change", 9).alias("fold_change"))


@query(w("SELECT cell_type, gene, ok marker FROM E JOIN var USING (col_id)", _V + _D + ", " + _E))
def q_markers_all(spark, d):
    return fine(spark, d).find_markers("cell_type", min_detection_rate=0.001, min_fold_change=1.5, pareto=False, all_genes=True).select("cell_type", "gene", "marker")


_S = _V + ', S AS (SELECT row_id, sum("value") s FROM X GROUP BY 1), A AS (SELECT avg(coalesce(s, 0)) m FROM obs LEFT JOIN S USING (row_id)), L AS (SELECT row_id, col_id, ln(1 + "value" * m / s) v FROM X JOIN S USING (row_id), A)'


def _rounded(x: DataFrame) -> DataFrame:
    return x.select("row_id", "col_id", F.round("value", 7).alias("value"))


@query(w('SELECT row_id, col_id, round(ln(1 + "value" * 10000.0::DOUBLE / s), 7) AS "value" FROM X JOIN S USING (row_id)', _S))
def q_normalize_logcp10k(spark, d):
    return _rounded(fine(spark, d).normalize("logCP10k").X)


@query(w('SELECT row_id, col_id, round(v, 7) AS "value" FROM L', _S))
def q_normalize_log1ppf(spark, d):
    return _rounded(fine(spark, d).normalize("log1pPF").X)


@query(w('SELECT row_id, col_id, round(v * (SELECT sum(v) / (SELECT count(*) FROM obs) FROM L) / sum(v) OVER (PARTITION BY row_id), 7) AS "value" FROM L', _S))
def q_normalize_pflog1ppf(spark, d):
    return _rounded(fine(spark, d).normalize("PFlog1pPF").X)


@query(w('SELECT var.col_id, round(coalesce(sum("value"), 0)::DOUBLE / n, 9) AS "mean", round((coalesce(sum("value" * "value"), 0) - coalesce(sum("value"), 0)::DOUBLE * coalesce(sum("value"), 0)::DOUBLE / n) / (n - 1), 7) AS variance FROM var LEFT JOIN X ON X.col_id = var.col_id, (SELECT count(*)::DOUBLE n FROM obs) GROUP BY var.col_id, n'))
def q_gene_mean_var(spark, d):
    return ca.gene_moments(fine(spark, d)).select("col_id", F.round("mean", 9).alias("mean"), F.round("variance", 7).alias("variance"))


@query(w('SELECT a.col_id a, b.col_id b, count(*) n FROM X a JOIN X b ON a.row_id = b.row_id AND a.col_id < b.col_id GROUP BY 1, 2'))
def q_doublet_pair_counts(spark, d):
    """Over all genes; cells_with_both counts the same for a bounded number of genes."""
    return ca.pair_counts(fine(spark, d).X)


@query()
def q_cxds_doublets(spark, d):
    return coarse(spark, d).find_doublets(num_genes=25).obs.select("row_id", "doublet", "doublet_score")


@query()
def q_hvg_loess(spark, d):
    return fine(spark, d).hvg(num_genes=200).var.select("col_id", "highly_variable", "highly_variable_rank")


# -- verbs ------------------------------------------------------------------------------------------------------------


@query(w("SELECT row_id, col_id, \"value\" FROM X WHERE row_id IN (SELECT row_id FROM obs WHERE treatment = 'F' AND donor > 10)"))
def q_filter_obs(spark, d):
    return fine(spark, d).filter_obs(F.col("donor") > 10, treatment="F").X


@query(w("SELECT row_id, col_id, \"value\" FROM X WHERE col_id IN (SELECT col_id FROM var WHERE size < 5)"))
def q_filter_var(spark, d):
    return fine(spark, d).filter_var(F.col("size") < 5).X


@query(w("SELECT row_id, cell, donor, donor * 2 twice FROM obs"))
def q_select_obs(spark, d):
    return fine(spark, d).select_obs("donor", twice=F.col("donor") * 2).obs


@query(w("SELECT col_id, gene, brand, \"type\", size, size > 25 big FROM var"))
def q_with_columns(spark, d):
    return fine(spark, d).with_columns_var(big=F.col("size") > 25).var


@query(w("SELECT row_id, cell, cell_type, donor \"batch\", treatment, \"sample\" FROM obs"))
def q_rename(spark, d):
    return fine(spark, d).rename_obs({"donor": "batch"}).obs


@query(w("SELECT row_id, cell, cell_type FROM obs"))
def q_drop(spark, d):
    return fine(spark, d).drop_obs("donor", "treatment", "sample").obs


@query(w("SELECT row_id, TRY_CAST(\"sample\" AS INTEGER) \"sample\", donor::BIGINT donor FROM obs"))
def q_cast_try(spark, d):
    return fine(spark, d).cast_obs({"sample": "int", "donor": "long"}, strict=False).obs.select("row_id", "sample", "donor")


@query(w("SELECT row_id, donor, n_name FROM obs LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON donor = n_nationkey"))
def q_join_obs_left(spark, d):
    nation = spark.read.parquet(f"{d}/nation.parquet").where("n_nationkey < 20").select("n_nationkey", "n_name")
    return fine(spark, d).join_obs(nation, left_on="donor", right_on="n_nationkey", validate="m:1").obs.select("row_id", "donor", "n_name")


@query(w("SELECT row_id, k, label FROM (SELECT row_id, CASE WHEN donor > 20 THEN NULL ELSE donor END k FROM obs) LEFT JOIN (SELECT NULL::INTEGER kk, 'none' label UNION ALL SELECT 1, 'one') ON k IS NOT DISTINCT FROM kk"))
def q_join_nulls_equal(spark, d):
    other = spark.sql("SELECT CAST(NULL AS INT) AS k, 'none' AS label UNION ALL SELECT 1, 'one'")
    sc = fine(spark, d).with_columns_obs(k=F.when(F.col("donor") <= 20, F.col("donor")))
    return sc.join_obs(other, on="k", nulls_equal=True).obs.select("row_id", "k", "label")


@query(w("SELECT cell, treatment, 'a' \"dataset\" FROM obs WHERE treatment = 'F' UNION ALL SELECT cell, treatment, 'b' FROM obs WHERE treatment = 'O'"))
def q_concat_obs_strict(spark, d):
    sc = fine(spark, d)
    return concat_obs(sc.filter_obs(treatment="F"), sc.filter_obs(treatment="O"), dataset_column="dataset", dataset_labels=["a", "b"]).obs.select("cell", "treatment", "dataset")


@query(w("SELECT cell, col_id, \"value\" FROM X JOIN obs USING (row_id) JOIN var USING (col_id) WHERE treatment IN ('F', 'O') AND size BETWEEN 10 AND 30"))
def q_concat_obs_flexible(spark, d):
    sc = fine(spark, d)
    both = concat_obs(sc.filter_obs(treatment="F").filter_var(F.col("size") <= 30), sc.filter_obs(treatment="O").filter_var(F.col("size") >= 10).drop_obs("donor"), flexible=True)
    return both.X.join(both.obs_names, "row_id").select("cell", "col_id", "value")


@query(w("SELECT treatment, count(*) n FROM obs GROUP BY 1"))
def q_split_by(spark, d):
    parts = fine(spark, d).split_by_obs("treatment")
    return verbs.stacked([p.obs.groupBy(F.lit(k).alias("treatment")).agg(F.count("*").alias("n")) for k, p in parts.items()], False, "parts")


@query(w("SELECT count(*) n, count(DISTINCT row_id) distinct_rows FROM (SELECT row_id FROM obs LIMIT 100)"))
def q_subsample_obs(spark, d):
    return fine(spark, d).subsample_obs(n=100, by_column="cell_type").obs.agg(F.count("*").alias("n"), F.count_distinct("row_id").alias("distinct_rows"))


# -- pseudobulk -------------------------------------------------------------------------------------------------------


@query(w("SELECT cell_type, \"sample\", num_cells, max(CASE WHEN gene = 'Brand#1' THEN \"value\" END) \"Brand#1\", max(CASE WHEN gene = 'Brand#2' THEN \"value\" END) \"Brand#2\" FROM PD JOIN PO USING (cell_type, \"sample\") GROUP BY 1, 2, 3", _C))
def q_to_df_wide(spark, d):
    return bulk(spark, d).to_df(obs_columns=["num_cells"], genes=["Brand#1", "Brand#2"])


_Q = _C + """,
Q0 AS (SELECT * FROM PO WHERE num_cells >= 10),
QC0 AS (SELECT cell_type FROM (SELECT cell_type, treatment, count(*) n FROM Q0 GROUP BY 1, 2) GROUP BY 1 HAVING min(n) >= 2 AND count(*) > 1),
QZ AS (SELECT cell_type, "sample", treatment, count(*) FILTER (WHERE "value" = 0) z FROM Q0 JOIN PD USING (cell_type, "sample") WHERE cell_type IN (FROM QC0) GROUP BY 1, 2, 3),
QS AS (SELECT * FROM (SELECT *, avg(z) OVER (PARTITION BY cell_type) + 1 * stddev_pop(z) OVER (PARTITION BY cell_type) top FROM QZ) WHERE z < top),
QC1 AS (SELECT cell_type FROM (SELECT cell_type, treatment, count(*) n FROM QS GROUP BY 1, 2) GROUP BY 1 HAVING min(n) >= 2 AND count(*) > 1)"""


@query(w('SELECT cell_type, "sample" FROM QS WHERE cell_type IN (FROM QC1)', _Q))
def q_pb_qc_samples(spark, d):
    return bulk(spark, d).qc("treatment", max_standard_deviations=1, error_if_empty=False).obs.select("cell_type", "sample")


@query(w("SELECT cell_type, gene FROM (SELECT cell_type, gene, treatment, quantile_cont(\"value\"::DOUBLE, 0.2) q FROM PD JOIN QS USING (cell_type, \"sample\") WHERE cell_type IN (FROM QC1) GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING min(q) > 0", _Q))
def q_pb_qc_genes(spark, d):
    return bulk(spark, d).qc("treatment", max_standard_deviations=1, error_if_empty=False).var.select("cell_type", "gene")


def _plain_sizes(pb: Pseudobulk) -> Pseudobulk:
    sums = pb.X.groupBy("cell_type", "sample").agg(F.sum("value").cast("double").alias("library_size"))
    return replace(pb, obs=pb.obs.join(sums, ["cell_type", "sample"]))


@query(w('SELECT cell_type, "sample", gene, round("value" * 1e6::DOUBLE / sum("value") OVER (PARTITION BY cell_type, "sample"), 5) AS "value" FROM PX', _C))
def q_cpm(spark, d):
    return _plain_sizes(bulk(spark, d)).cpm().X.select("cell_type", "sample", "gene", F.round("value", 5).alias("value"))


@query(w('SELECT cell_type, "sample", gene, round(log2("value" + pc) - log2(l + 2 * pc) + log2(1e6::DOUBLE), 7) AS "value" FROM PD JOIN (SELECT *, 2 * l / avg(l) OVER (PARTITION BY cell_type) pc FROM (SELECT cell_type, "sample", sum("value")::DOUBLE l FROM PX GROUP BY 1, 2)) USING (cell_type, "sample")', _C))
def q_log_cpm(spark, d):
    return _plain_sizes(bulk(spark, d)).log_cpm().X.select("cell_type", "sample", "gene", F.round("value", 7).alias("value"))


_TMM = _C + """,
PE AS (SELECT * FROM PD WHERE (cell_type, "sample") IN (SELECT (cell_type, "sample") FROM PX) AND (cell_type, gene) IN (SELECT (cell_type, gene) FROM PX)),
T0 AS (SELECT cell_type, "sample", sum("value")::DOUBLE l, quantile_cont("value"::DOUBLE, 0.75) q, sum(sqrt("value"::DOUBLE)) root FROM PE GROUP BY 1, 2),
T1 AS (SELECT *, q / l f75, count(*) OVER (PARTITION BY cell_type) n, median(q / l) OVER (PARTITION BY cell_type) mid, avg(q / l) OVER (PARTITION BY cell_type) av FROM T0),
T2 AS (SELECT cell_type, arg_min("sample", (round(CASE WHEN mid < 1e-20 THEN -root ELSE abs(f75 - av) END, 12), "sample")) ref FROM T1 GROUP BY 1),
T3 AS (SELECT PE.cell_type, gene, "value"::DOUBLE xr, l lr FROM PE JOIN T2 ON T2.cell_type = PE.cell_type AND ref = PE."sample" JOIN T0 ON T0.cell_type = PE.cell_type AND T0."sample" = ref WHERE "value" > 0),
T4 AS (SELECT PE.cell_type, PE."sample", log2((lr / l) * ("value"::DOUBLE / xr)) m, (log2("value"::DOUBLE / l) + log2(xr / lr)) / 2 a, 1 / (1 / "value"::DOUBLE + 1 / xr - 1 / l - 1 / lr) wt FROM PE JOIN T3 ON T3.cell_type = PE.cell_type AND T3.gene = PE.gene JOIN T0 ON T0.cell_type = PE.cell_type AND T0."sample" = PE."sample" WHERE "value" > 0),
T5 AS (SELECT *, rank() OVER (PARTITION BY cell_type, "sample" ORDER BY m) + (count(*) OVER (PARTITION BY cell_type, "sample", m) - 1) / 2.0 rm, rank() OVER (PARTITION BY cell_type, "sample" ORDER BY a) + (count(*) OVER (PARTITION BY cell_type, "sample", a) - 1) / 2.0 ra, count(*) OVER (PARTITION BY cell_type, "sample") k, max(abs(m)) OVER (PARTITION BY cell_type, "sample") big FROM T4),
T6 AS (SELECT cell_type, "sample", CASE WHEN max(big) < 1e-6 THEN 1.0 ELSE pow(2.0, sum(wt * m) / sum(wt)) END f FROM T5 WHERE big < 1e-6 OR (rm BETWEEN floor(k * 0.3) + 1 AND k - floor(k * 0.3) AND ra BETWEEN floor(k * 0.05) + 1 AND k - floor(k * 0.05)) GROUP BY 1, 2),
T7 AS (SELECT cell_type, "sample", l, n, coalesce(f, 1.0) f FROM T1 LEFT JOIN T6 USING (cell_type, "sample"))"""


@query(w('SELECT cell_type, "sample", round(l * CASE WHEN n = 1 THEN 1.0 ELSE f / exp(avg(ln(f)) OVER (PARTITION BY cell_type)) END, 4) library_size FROM T7', _TMM))
def q_library_size_tmm(spark, d):
    return counted(bulk(spark, d)).library_size().obs.select("cell_type", "sample", F.round("library_size", 4).alias("library_size"))


def _tests(spark, d) -> DataFrame:
    """p-values of a kind: parts' prices turned into (0, 1), some null."""
    p = spark.read.parquet(f"{d}/part.parquet")
    x = F.round((F.col("p_retailprice") * 7919) % 1000 / 1000, 3)
    return p.select(F.col("p_brand").alias("cell_type"), F.lit("c").alias("coefficient"), F.col("p_partkey").alias("gene"), F.when(F.col("p_size") > 2, x * x).alias("p"))


_P = "P AS (SELECT p_brand cell_type, p_partkey gene, CASE WHEN p_size > 2 THEN pow(round((p_retailprice * 7919) % 1000 / 1000, 3), 2) END p FROM part)"
_F = _P + ", R AS (SELECT *, count(p) OVER (PARTITION BY cell_type) n, row_number() OVER (PARTITION BY cell_type ORDER BY p NULLS LAST, gene) k FROM P), F AS (SELECT cell_type, gene, p, CASE WHEN p IS NOT NULL THEN least(1.0, min(p * n / k) OVER (PARTITION BY cell_type ORDER BY p DESC NULLS LAST, gene DESC ROWS UNBOUNDED PRECEDING)) END fdr FROM (SELECT * FROM R WHERE p IS NOT NULL) UNION ALL SELECT cell_type, gene, p, NULL FROM R WHERE p IS NULL)"


@query(w("SELECT gene, round(fdr, 9) fdr FROM F", _F))
def q_fdr_bh(spark, d):
    return with_fdr(_tests(spark, d), "p", "fdr", "cell_type", tie="gene").select("gene", F.round("fdr", 9).alias("fdr"))


@query(w("SELECT gene, round(least(1.0, p * count(p) OVER (PARTITION BY cell_type)), 9) bonferroni FROM P", _P))
def q_bonferroni(spark, d):
    return _tests(spark, d).select("gene", F.round(bonferroni(F.col("p"), "cell_type"), 9).alias("bonferroni"))


def _hits(spark, d):
    from ..api import DE

    return DE(with_fdr(_tests(spark, d), "p", "FDR", "cell_type", tie="gene"))


@query(w("SELECT cell_type, gene FROM F WHERE fdr < 0.5 QUALIFY row_number() OVER (PARTITION BY cell_type ORDER BY fdr, gene) <= 3", _F))
def q_top_hits(spark, d):
    return _hits(spark, d).get_hits(threshold=0.5, num_top_hits=3).select("cell_type", "gene")


@query(w("SELECT cell_type, count(*) num_hits FROM F WHERE fdr < 0.5 GROUP BY 1", _F))
def q_num_hits(spark, d):
    return _hits(spark, d).get_num_hits(threshold=0.5)


@query()
def q_voom_de(spark, d):
    pb = counted(bulk(spark, d)).library_size()
    return pb.DE("~ treatment", group="treatment", return_voom_info=False).table


@query()
def q_regress_out(spark, d):
    pb = _plain_sizes(bulk(spark, d)).log_cpm()
    return pb.regress_out("~ treatment").X.withColumn("value", F.round("value", 6))


# -- vectors ----------------------------------------------------------------------------------------------------------

_E2 = "V AS (SELECT vec_id i, embedding::DOUBLE[] v, label FROM embeddings)"
_DIST = "round(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9)"
_KNN = _E2 + f", K AS (SELECT * FROM (SELECT a.i, b.i j, {_DIST} d, row_number() OVER (PARTITION BY a.i ORDER BY {_DIST}, b.i) AS \"rank\" FROM V a, V b WHERE a.i <> b.i) WHERE \"rank\" <= 10)"
_CROSS = _E2 + f", K AS (SELECT * FROM (SELECT a.i, b.i j, row_number() OVER (PARTITION BY a.i ORDER BY {_DIST}, b.i) AS \"rank\" FROM V a, V b WHERE a.i % 5 = 0 AND b.i % 5 <> 0) WHERE \"rank\" <= 10)"


def _exact(spark, d, same):
    v = components(spark, d).obsm["pca"]
    return nn.nearest(v, v, 10, same=True) if same else nn.nearest(v.where("row_id % 5 = 0"), v.where("row_id % 5 <> 0"), 10)


@query(w('SELECT i, j, "rank", round(d, 6) d FROM K', _KNN))
def q_knn_exact(spark, d):
    return _exact(spark, d, True).select("i", "j", "rank", F.round("d", 6).alias("d"))


@query(w('SELECT i, j, "rank" FROM K', _CROSS))
def q_knn_cross_exact(spark, d):
    return _exact(spark, d, False).select("i", "j", "rank")


@query(w('SELECT a.i, b.i j, round(count(*)::DOUBLE / (22 - count(*)), 6) weight FROM (SELECT i, j m FROM K UNION ALL SELECT i, i FROM V) a JOIN (SELECT i, j m FROM K UNION ALL SELECT i, i FROM V) b ON a.m = b.m AND a.i <> b.i GROUP BY 1, 2 HAVING count(*) >= 3', _KNN))
def q_snn_jaccard(spark, d):
    lists = _exact(spark, d, True).groupBy("i").agg(F.collect_list("j").alias("value")).withColumnRenamed("i", "row_id")
    return nn.shared(lists, 3).select("i", "j", F.round(F.col("weight").cast("double"), 6).alias("weight"))


_VOTE = _CROSS + ", C AS (SELECT label, count(*) total FROM V WHERE i % 5 <> 0 GROUP BY 1), W AS (SELECT K.i, V.label, count(*) n FROM K JOIN V ON V.i = K.j GROUP BY 1, 2), RK AS (SELECT i, label, n / 10.0::DOUBLE c, row_number() OVER (PARTITION BY i ORDER BY n DESC, total DESC, label) k FROM W JOIN C USING (label))"


def _votes(spark, d):
    labels = components(spark, d).obs.where("row_id % 5 <> 0").select("row_id", F.regexp_replace("label", "l", "").cast("int").alias("label"))
    return nn.votes(_exact(spark, d, False), labels)


@query(w("SELECT i row_id, label, round(c, 6) confidence FROM RK WHERE k = 1", _VOTE))
def q_label_transfer(spark, d):
    return _votes(spark, d).select("row_id", "label", F.round("confidence", 6).alias("confidence"))


@query(w("SELECT a.i row_id, b.label next_best, round(b.c, 6) next_best_confidence FROM RK a LEFT JOIN RK b ON a.i = b.i AND b.k = 2 WHERE a.k = 1", _VOTE))
def q_label_transfer_next_best(spark, d):
    return _votes(spark, d).select("row_id", "next_best", F.round("next_best_confidence", 6).alias("next_best_confidence"))


@query(w("SELECT i row_id, arg_min(c, (d, c)) AS \"cell\" FROM (SELECT a.i, b.i c, " + _DIST + " d FROM V a, V b WHERE b.i < 10) GROUP BY 1", _E2))
def q_kmeans_assign(spark, d):
    v = components(spark, d).obsm["pca"]
    c = nn._matrix([r["value"] for r in v.where("row_id < 10").orderBy("row_id").collect()])
    return nn.assign(v.select(F.col("row_id").alias("id"), F.col("value").alias("v")), c, 1).select(F.col("id").alias("row_id"), F.col("cell").cast("long").alias("cell"))


@query()
def q_kmeans(spark, d):
    return nn.kmeans(components(spark, d).obsm["pca"], 10)[1]


@query()
def q_pca(spark, d):
    return coarse(spark, d).normalize().pca(num_PCs=5, hvg_column=None).obsm["pca"]


def _near(spark, d) -> SingleCell:
    return components(spark, d).neighbors(num_neighbors=15)


@query()
def q_neighbors_ivf(spark, d):
    return _near(spark, d).obsm["neighbors"]


@query()
def q_harmony(spark, d):
    return components(spark, d).harmonize("batch", num_clusters=10).obsm["harmony"]


@query()
def q_leiden(spark, d):
    return _near(spark, d).shared_neighbors().cluster().obs.select("row_id", "cluster")


@query()
def q_umap(spark, d):
    return _near(spark, d).umap().obsm["umap"]


@query()
def q_pacmap(spark, d):
    return _near(spark, d).pacmap().obsm["pacmap"]


@query()
def q_localmap(spark, d):
    return _near(spark, d).localmap().obsm["localmap"]
