"""Queries of packed matrices, positions, levels, batches, neighbour pairs and Lanczos components, with their DuckDB SQL;
they join those of catalog."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import cell_analysis as ca
from ..operators import neighbors as nn
from ..operators import verbs
from ..operators.packed import Packed
from ..operators.staging import shared_dir
from ..sources.storage import read_mtx
from .catalog import _C, _KNN, _V, _VOTE, _exact, bulk, coarse, components, counted, fine, query, w

# -- packed rows ------------------------------------------------------------------------------------------------------


@query(w('SELECT row_id, col_id, "value" FROM X'))
def q_packed_round_trip(spark, d):
    """csr to csc to csr."""
    return fine(spark, d).packed("csr").tocsc().tocsr().to_long()


@query(w('SELECT col_id, count(*) n, min(row_id) first_row, max(row_id) last_row, sum("value")::BIGINT total FROM X GROUP BY 1'))
def q_packed_columns(spark, d):
    """Columns of the transposed layout: ids within a stretch are sorted, so that its ends are its first and last entry."""
    rows = fine(spark, d).packed("csr").tocsc().rows
    ends = rows.select("major", F.size("indices").alias("n"), F.element_at("indices", 1).alias("a"), F.element_at("indices", -1).alias("b"), F.aggregate("values", F.lit(0).cast("long"), lambda s, x: s + x).alias("t"))
    return ends.groupBy(F.col("major").alias("col_id")).agg(F.sum("n").alias("n"), F.min("a").alias("first_row"), F.max("b").alias("last_row"), F.sum("t").alias("total"))


def _raw(spark, d):
    """Line items one by one: orders have several lines of a part, and some lines count as zero."""
    value = F.when(F.col("l_returnflag") == "N", 0).otherwise(F.col("l_quantity")).cast("long")
    return spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("row_id"), F.col("l_partkey").alias("col_id"), value.alias("value"))


_RAW = "R AS (SELECT l_orderkey row_id, l_partkey col_id, CAST(CASE WHEN l_returnflag = 'N' THEN 0 ELSE l_quantity END AS BIGINT) \"value\" FROM lineitem)"


@query(w('SELECT row_id, col_id, sum("value")::BIGINT "value" FROM R GROUP BY 1, 2 HAVING sum("value") <> 0', _RAW))
def q_packed_canonical(spark, d):
    """Repeated entries folded and zeros dropped, after a turn and back."""
    return Packed.of(_raw(spark, d)).tocsc().sum_duplicates().tocsr().eliminate_zeros().to_long()


@query(w('SELECT row_id, col_id, "value" FROM R WHERE "value" <> 0', _RAW))
def q_packed_eliminate_zeros(spark, d):
    return Packed.of(_raw(spark, d), "csc").eliminate_zeros().to_long()


@query(w('SELECT row_id, col_id, sum("value")::BIGINT "value" FROM R GROUP BY 1, 2', _RAW))
def q_sc_sum_duplicates(spark, d):
    return fine(spark, d).pipe_X(lambda x: _raw(spark, d)).sum_duplicates().X


# -- positions --------------------------------------------------------------------------------------------------------

_POS = _V + ", O AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 i, count(*) OVER () n FROM obs), G AS (SELECT col_id, row_number() OVER (ORDER BY col_id) - 1 j, count(*) OVER () m FROM var)"


@query(w('SELECT X.row_id, X.col_id, "value" FROM X JOIN O USING (row_id) JOIN G USING (col_id) WHERE i >= 5 AND (i - 5) % 3 = 0 AND j < m - 7', _POS))
def q_sc_getitem_slices(spark, d):
    return fine(spark, d)[5::3, :-7].X.select("row_id", "col_id", "value")


@query(w('SELECT row_id, col_id, "value" FROM X JOIN O USING (row_id) WHERE i % 4 = 1', _POS))
def q_sc_getitem_mask(spark, d):
    sc = fine(spark, d)
    return sc[[k % 4 == 1 for k in range(len(sc))]].X.select("row_id", "col_id", "value")


@query(w('SELECT n - 1 - i row_id, j // 2 col_id, "value" FROM X JOIN O USING (row_id) JOIN G USING (col_id) WHERE j % 2 = 0', _POS))
def q_sc_take_reversed(spark, d):
    """Rows from the last to the first, every other column, numbered anew."""
    return fine(spark, d).X_at((slice(None, None, -1), slice(None, None, 2)))


@query(w('SELECT row_id, k col_id, "value" FROM (SELECT i row_id, j, "value", m FROM X JOIN O USING (row_id) JOIN G USING (col_id)) JOIN (VALUES (0, 3), (1, -1), (2, 3), (3, 0)) t(k, p) ON j = (p + m) % m', _POS))
def q_sc_take_list(spark, d):
    """A list of columns in its own order, one of them twice."""
    return fine(spark, d).X_at((slice(None), [3, -1, 3, 0])).select("row_id", F.col("col_id").cast("int").alias("col_id"), "value")


_PPOS = _C + ', PS AS (SELECT cell_type, "sample", row_number() OVER (PARTITION BY cell_type ORDER BY "sample") - 1 i, count(*) OVER (PARTITION BY cell_type) n FROM PO), PG AS (SELECT cell_type, gene, row_number() OVER (PARTITION BY cell_type ORDER BY gene) - 1 j, count(*) OVER (PARTITION BY cell_type) m FROM PV), PXX AS (SELECT PX.cell_type, PX."sample", PX.gene, "value", i, n, j, m FROM PX JOIN PS ON PS.cell_type = PX.cell_type AND PS."sample" = PX."sample" JOIN PG ON PG.cell_type = PX.cell_type AND PG.gene = PX.gene)'


@query(w('SELECT cell_type, "sample", gene, "value" FROM PXX WHERE i >= n - 3 AND j IN (0, 2, m - 1)', _PPOS))
def q_pb_getitem_places(spark, d):
    return bulk(spark, d)[:, -3:, [0, 2, -1]].X


@query(w('SELECT cell_type, "sample", gene, "value" FROM PXX WHERE i = n - 1 AND gene >= \'Brand#11\' AND gene < \'Brand#3\'', _PPOS))
def q_pb_getitem_names(spark, d):
    """One place of the samples, a slice of names of the genes."""
    return bulk(spark, d)[:, -1, "Brand#11":"Brand#3"].X


@query(w('SELECT cell_type, "sample", gene, "value" FROM PXX WHERE j % 2 = 1 AND cell_type IN (\'1-URGENT\', \'5-LOW\')', _PPOS))
def q_pb_getitem_mask(spark, d):
    pb = bulk(spark, d)[["1-URGENT", "5-LOW"]]
    genes = pb.shape["5-LOW"][1]
    return pb[:, :, [k % 2 == 1 for k in range(genes)]].X


# -- levels -----------------------------------------------------------------------------------------------------------

_LEVELS = "CASE treatment WHEN 'P' THEN 0 WHEN 'F' THEN 1 WHEN 'O' THEN 2 END"


@query(w(f"SELECT row_id, treatment, ({_LEVELS})::BIGINT \"level\" FROM obs WHERE donor < 20"))
def q_levels_kept(spark, d):
    """Levels outlast a filter, a new name and back, and a join."""
    nation = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("donor"), "n_name")
    sc = fine(spark, d).categorical_obs("treatment", ["P", "F", "O"]).filter_obs(F.col("donor") < 20).rename_obs({"treatment": "t"}).join_obs(nation, on="donor").rename_obs({"t": "treatment"})
    return sc.obs.select("row_id", "treatment", verbs.level_number(sc.obs, "treatment").alias("level"))


@query(w(f"SELECT cell, treatment, ({_LEVELS})::BIGINT \"level\" FROM obs"))
def q_levels_united(spark, d):
    """Two datasets with levels of their own: those of the first, then what the second adds."""
    sc = fine(spark, d)
    a = sc.filter_obs(F.col("treatment").isin("P", "F")).categorical_obs("treatment", ["P", "F"])
    b = sc.filter_obs(treatment="O").categorical_obs("treatment", ["F", "O"])
    both = a.concat_obs(b, flexible=True).obs
    return both.select("cell", "treatment", verbs.level_number(both, "treatment").alias("level"))


@query(w('SELECT DISTINCT cell_type, coefficient FROM PO, (VALUES (\'treatmentF\'), (\'treatmentO\')) t(coefficient)', _C))
def q_levels_of_design(spark, d):
    """The first level, here the one that sorts last, is what the others are compared with."""
    pb = counted(bulk(spark, d)).categorical_obs("treatment", ["P", "F", "O"]).library_size()
    return pb.de("~ treatment", coefficient=["treatmentF", "treatmentO"], group=False, strict=True, return_voom_info=False).table.select("cell_type", "coefficient").distinct()


# -- batches ----------------------------------------------------------------------------------------------------------


@query(w('SELECT treatment "batch", col_id, round(sum("value")::DOUBLE / n, 9) "mean", round((sum("value" * "value")::DOUBLE - sum("value")::DOUBLE * sum("value")::DOUBLE / n) / greatest(n - 1, 1), 7) variance FROM X JOIN obs USING (row_id) JOIN (SELECT treatment, count(*)::DOUBLE n FROM obs GROUP BY 1) USING (treatment) GROUP BY 1, 2, n'))
def q_batch_moments(spark, d):
    moments = ca.batch_moments(*ca.batched(fine(spark, d), "treatment", None, False))
    return moments.select("batch", "col_id", F.round("mean", 9).alias("mean"), F.round("variance", 7).alias("variance"))


@query()
def q_hvg_batches(spark, d):
    return fine(spark, d).hvg(num_genes=200, batch_column="treatment").var.select("col_id", "highly_variable", "highly_variable_rank")


@query(w('SELECT treatment "batch", a.gene a, b.gene b, count(*) n FROM CX a JOIN CX b ON a.row_id = b.row_id AND a.gene < b.gene JOIN obs ON obs.row_id = a.row_id GROUP BY 1, 2, 3', _C))
def q_doublet_pairs_by_batch(spark, d):
    """In how many cells of a batch two genes are together, as the doublet score counts them: by products of matrices."""
    sc = coarse(spark, d)
    genes = sorted(r["gene"] for r in sc.var.collect())
    place = sc.var.select("col_id", (F.array_position(F.lit(genes), F.col("gene")) - 1).alias("place"))
    x = ca.batched(sc, "treatment", None, False)[0].where("value > 0").join(place, "col_id")
    lists = x.groupBy("batch", "row_id").agg(F.collect_list("place").alias("places"))
    counts = ca.cells_with_both(lists, len(genes))
    name = F.lit(genes)
    pairs = ca.unpacked_counts(counts).where("k < l and n > 0")
    return pairs.select("batch", F.element_at(name, F.col("k").cast("int") + 1).alias("a"), F.element_at(name, F.col("l").cast("int") + 1).alias("b"), F.col("n").cast("long").alias("n"))


@query()
def q_cxds_doublets_by_batch(spark, d):
    return coarse(spark, d).find_doublets(batch_column="treatment", num_genes=25).obs.select("row_id", "doublet", "doublet_score")


# -- vectors ----------------------------------------------------------------------------------------------------------


@query(w('SELECT i, j, "rank", round(d / (si * sj), 6) scaled FROM (SELECT K.i, K.j, d, a.s si, b.s sj, row_number() OVER (PARTITION BY K.i ORDER BY d / b.s, K.j)::INTEGER "rank" FROM K JOIN S a ON a.i = K.i JOIN S b ON b.i = K.j) WHERE "rank" <= 6', _KNN + ', S AS (SELECT i, greatest(avg(sqrt(d)), 1e-10) s FROM K WHERE "rank" BETWEEN 4 AND 6 GROUP BY 1)'))
def q_neighbor_pairs(spark, d):
    found = _exact(spark, d, True).groupBy(F.col("i").alias("row_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "j", "d"))).alias("r"))
    pairs = nn.neighbor_pairs(found.select("row_id", F.col("r.j").alias("value")), found.select("row_id", F.col("r.d").alias("value")), 6)
    return pairs.withColumn("scaled", F.round("scaled", 6))


@query(w("SELECT i row_id, 'l' || label kind, round(c, 6) confidence FROM RK WHERE k = 1", _VOTE))
def q_label_transfer_from(spark, d):
    """The whole method, with exact neighbours: every fifth cell takes the label of the others."""
    sc = components(spark, d)
    done = sc.filter_obs(F.col("row_id") % 5 == 0).drop_obs("label").label_transfer_from(sc.filter_obs(F.col("row_id") % 5 != 0), "label", "kind", num_neighbors=10, Harmony_key="pca", num_clusters=0)
    return done.obs.select("row_id", "kind", F.round("kind_confidence", 6).alias("confidence"))


@query()
def q_kmeans_barbar(spark, d):
    return nn.kmeans(components(spark, d).obsm["pca"], 10, init="k-means||")[1]


@query()
def q_pca_lanczos(spark, d):
    """Components of all parts as genes, without a table of genes by genes."""
    return fine(spark, d).normalize().pca(num_PCs=5, hvg_column=None).obsm["pca"]


# -- Matrix Market ----------------------------------------------------------------------------------------------------


@query(w('SELECT cell, gene, "value" FROM X JOIN obs USING (row_id) JOIN var USING (col_id)'))
def q_mtx_round_trip(spark, d):
    """Written as Matrix Market text and read again, by name."""
    folder = f"{shared_dir(spark)}/mtx-{uuid.uuid4().hex[:12]}"
    fine(spark, d).save_mtx(folder)
    back = read_mtx(spark, f"{folder}/matrix.mtx")
    return back.X.join(back.obs.hint("merge"), "row_id").join(back.var.hint("merge"), "col_id").select(F.col("barcode").alias("cell"), "gene", "value")
