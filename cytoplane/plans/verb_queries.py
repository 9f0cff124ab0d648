"""Queries of the verbs, slots and keys of both kinds of dataset, with their DuckDB SQL; they join those of catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import verbs
from .catalog import _C, _plain_sizes, bulk, components, fine, query, w

_SUM = 'SELECT cell_type, "sample", gene, "value" FROM PX '
_URGENT, _LOW = "1-URGENT", "5-LOW"


def _parts(d, spark):
    return spark.read.parquet(f"{d}/part.parquet").groupBy(F.col("p_brand").alias("gene")).agg(F.count("*").alias("parts"))


# -- pseudobulk: slots and keys ---------------------------------------------------------------------------------------


@query(w('SELECT cell_type, "sample", donor, treatment, num_cells FROM PO', _C))
def q_pb_obs(spark, d):
    return bulk(spark, d).obs.select("cell_type", "sample", "donor", "treatment", "num_cells")


@query(w("SELECT cell_type, gene FROM PV", _C))
def q_pb_var_names(spark, d):
    return bulk(spark, d).var_names


@query(w('SELECT cell_type, "sample" FROM PO', _C))
def q_pb_obs_names(spark, d):
    return bulk(spark, d).obs_names


@query(w(f"SELECT gene, coalesce(\"value\", 0)::BIGINT \"value\" FROM PV LEFT JOIN (FROM PX WHERE \"sample\" = '5_O') USING (cell_type, gene) WHERE cell_type = '{_URGENT}'", _C))
def q_pb_sample(spark, d):
    return bulk(spark, d).sample(_URGENT, "5_O")


@query(w(f"SELECT \"sample\", coalesce(\"value\", 0)::BIGINT \"value\" FROM PO LEFT JOIN (FROM PX WHERE gene = 'Brand#1') USING (cell_type, \"sample\") WHERE cell_type = '{_LOW}'", _C))
def q_pb_gene(spark, d):
    return bulk(spark, d).gene(_LOW, "Brand#1")


@query(w(f"{_SUM} WHERE cell_type IN ('{_URGENT}', '{_LOW}')", _C))
def q_pb_select_cell_types(spark, d):
    return bulk(spark, d).select_cell_types(_URGENT, _LOW).X.select("cell_type", "sample", "gene", "value")


@query(w(f"SELECT cell_type, \"sample\" FROM PO WHERE cell_type <> '{_URGENT}'", _C))
def q_pb_drop_cell_types(spark, d):
    return bulk(spark, d).drop_cell_types(_URGENT).obs_names


@query(w(f"SELECT CASE WHEN cell_type = '{_URGENT}' THEN 'urgent' ELSE cell_type END cell_type, gene FROM PV", _C))
def q_pb_rename_cell_types(spark, d):
    return bulk(spark, d).rename_cell_types({_URGENT: "urgent"}).var_names


@query(w(f"{_SUM} WHERE cell_type = '{_LOW}' AND gene IN ('Brand#1', 'Brand#2')", _C))
def q_pb_getitem(spark, d):
    return bulk(spark, d)[_LOW, :, ["Brand#1", "Brand#2"]].X.select("cell_type", "sample", "gene", "value")


@query(w(f"{_SUM} WHERE cell_type IN ('{_URGENT}', '{_LOW}')", _C))
def q_pb_or(spark, d):
    pb = bulk(spark, d)
    return (pb[_URGENT] | pb[_LOW]).X.select("cell_type", "sample", "gene", "value")


@query(w(_SUM, _C))
def q_pb_iter_X(spark, d):
    return verbs.stacked(list(bulk(spark, d).iter_X()), False, "X").select("cell_type", "sample", "gene", "value")


@query(w('SELECT cell_type, "sample", num_cells FROM PO', _C))
def q_pb_split_by_cell_type(spark, d):
    return verbs.stacked([p.obs for p in bulk(spark, d).split_by_cell_type()], False, "obs").select("cell_type", "sample", "num_cells")


@query(w(f"SELECT 'sample' \"column\", min(\"sample\") \"value\" FROM PO WHERE cell_type = '{_LOW}'", _C))
def q_pb_peek_obs(spark, d):
    return bulk(spark, d).peek_obs(_LOW).where(F.col("column") == "sample")


# -- pseudobulk: verbs ------------------------------------------------------------------------------------------------


@query(w(f"{_SUM} JOIN PO USING (cell_type, \"sample\") WHERE cell_type <> '{_URGENT}' OR donor > 12", _C))
def q_pb_filter_obs(spark, d):
    return bulk(spark, d).filter_obs(F.col("donor") > 12, cell_types=_URGENT).X


@query(w(f"{_SUM} WHERE gene <> 'Brand#1'", _C))
def q_pb_filter_var(spark, d):
    return bulk(spark, d).filter_var(F.col("gene") != "Brand#1").X


@query(w('SELECT cell_type, "sample", donor, num_cells * 2 twice FROM PO', _C))
def q_pb_select_obs(spark, d):
    return bulk(spark, d).select_obs("donor", twice=F.col("num_cells") * 2).obs


@query(w("SELECT cell_type, gene, substring(gene, 7, 2) short FROM PV", _C))
def q_pb_select_var(spark, d):
    return bulk(spark, d).select_var(short=F.substring("gene", 7, 2)).var


@query(w(f"SELECT cell_type, \"sample\", CASE WHEN cell_type = '{_LOW}' THEN num_cells > 3 END big FROM PO", _C))
def q_pb_with_columns_obs(spark, d):
    return bulk(spark, d).with_columns_obs(big=F.col("num_cells") > 3, cell_types=_LOW).obs.select("cell_type", "sample", "big")


@query(w("SELECT cell_type, gene, upper(gene) loud FROM PV", _C))
def q_pb_with_columns_var(spark, d):
    return bulk(spark, d).with_columns_var(loud=F.upper("gene")).var.select("cell_type", "gene", "loud")


@query(w('SELECT cell_type, "sample", num_cells FROM PO', _C))
def q_pb_drop_obs(spark, d):
    return bulk(spark, d).select_obs("donor", "treatment", "num_cells").drop_obs("donor", "treatment").obs


@query(w("SELECT cell_type, gene FROM PV", _C))
def q_pb_drop_var(spark, d):
    return bulk(spark, d).select_var(loud=F.upper("gene")).drop_var("loud").var


@query(w('SELECT cell_type, "sample", donor "batch" FROM PO', _C))
def q_pb_rename_obs(spark, d):
    return bulk(spark, d).select_obs("donor").rename_obs({"donor": "batch"}).obs


@query(w("SELECT cell_type, gene, upper(gene) \"LOUD\" FROM PV", _C))
def q_pb_rename_var(spark, d):
    return bulk(spark, d).select_var(loud=F.upper("gene")).rename_var(str.upper).var.withColumnsRenamed({"CELL_TYPE": "cell_type", "GENE": "gene"})


@query(w('SELECT cell_type, "sample", donor::VARCHAR donor FROM PO', _C))
def q_pb_cast_obs(spark, d):
    return bulk(spark, d).select_obs("donor").cast_obs({"donor": "string"}).obs


@query(w("SELECT cell_type, gene, length(gene)::VARCHAR n FROM PV", _C))
def q_pb_cast_var(spark, d):
    return bulk(spark, d).select_var(n=F.length("gene")).cast_var({"n": "string"}).var


@query(w('SELECT cell_type, "sample", gene, "value"::DOUBLE "value" FROM PX', _C))
def q_pb_cast_X(spark, d):
    return bulk(spark, d).cast_X("double").X.select("cell_type", "sample", "gene", "value")


@query(w('SELECT cell_type, "sample", n_name FROM PO LEFT JOIN (FROM nation WHERE n_nationkey < 10) ON donor = n_nationkey', _C))
def q_pb_join_obs(spark, d):
    nation = spark.read.parquet(f"{d}/nation.parquet").where("n_nationkey < 10").select("n_nationkey", "n_name")
    return bulk(spark, d).join_obs(nation, left_on="donor", right_on="n_nationkey", validate="m:1").obs.select("cell_type", "sample", "n_name")


@query(w("SELECT cell_type, gene, parts FROM PV JOIN (SELECT p_brand gene, count(*) parts FROM part GROUP BY 1) USING (gene)", _C))
def q_pb_join_var(spark, d):
    return bulk(spark, d).join_var(_parts(d, spark), on="gene", validate="m:1").var.select("cell_type", "gene", "parts")


@query(w(f"SELECT cell_type, \"sample\", CASE WHEN cell_type = '{_LOW}' THEN num_cells ELSE num_cells + 1 END num_cells FROM PO", _C))
def q_pb_map_obs(spark, d):
    return bulk(spark, d).map_obs(lambda t: t.withColumn("num_cells", F.col("num_cells") + 1), excluded_cell_types=_LOW).obs.select("cell_type", "sample", "num_cells")


@query(w("SELECT cell_type, gene FROM PV WHERE gene > 'Brand#2'", _C))
def q_pb_map_var(spark, d):
    return bulk(spark, d).map_var(lambda t: t.where("gene > 'Brand#2'")).var_names


@query(w('SELECT cell_type, "sample", gene, "value" * 2 "value" FROM PX', _C))
def q_pb_map_X(spark, d):
    return bulk(spark, d).map_X(lambda t: t.withColumn("value", F.col("value") * 2)).X.select("cell_type", "sample", "gene", "value")


@query(w(f'{_SUM} WHERE "value" > 100', _C))
def q_pb_pipe_X(spark, d):
    return bulk(spark, d).pipe_X(lambda x, n: x.where(F.col("value") > n), 100).X.select("cell_type", "sample", "gene", "value")


@query(w('SELECT cell_type, "sample" FROM PO WHERE num_cells > 2', _C))
def q_pb_pipe_obs(spark, d):
    return bulk(spark, d).pipe_obs(lambda t: t.where("num_cells > 2")).obs_names


@query(w("SELECT cell_type, gene FROM PV WHERE gene <> 'Brand#1'", _C))
def q_pb_pipe_var(spark, d):
    return bulk(spark, d).pipe(lambda pb: pb.pipe_var(lambda t: t.where("gene <> 'Brand#1'"))).var_names


@query(w("SELECT cell_type, \"sample\", treatment part FROM PO WHERE treatment IN ('F', 'O')", _C))
def q_pb_concat_obs(spark, d):
    pb = bulk(spark, d).select_obs("treatment")
    parts = [pb.filter_obs(treatment=t) for t in "FO"]
    return parts[0].concat_obs(parts[1], dataset_column="part", dataset_labels=["F", "O"], flexible=True).obs.select("cell_type", "sample", "part")


@query(w(f"{_SUM} WHERE gene IN ('Brand#1', 'Brand#2')", _C))
def q_pb_concat_var(spark, d):
    pb = bulk(spark, d)
    return pb.filter_var(gene="Brand#1").concat_var(pb.filter_var(gene="Brand#2")).X.select("cell_type", "sample", "gene", "value")


@query(w('SELECT cell_type, \'s\' || "sample" "sample", gene, "value" FROM PX', _C))
def q_pb_set_obs_names(spark, d):
    return bulk(spark, d).with_columns_obs(name=F.concat(F.lit("s"), "sample")).set_obs_names("name").X


@query(w('SELECT cell_type, "sample", upper(gene) gene, "value" FROM PX', _C))
def q_pb_set_var_names(spark, d):
    return bulk(spark, d).with_columns_var(name=F.upper("gene")).set_var_names("name").X


@query(w('SELECT cell_type, ceil(0.5 * count(*))::BIGINT n, 0::BIGINT strays FROM PO GROUP BY 1 HAVING count(*) > 1', _C))
def q_pb_subsample_obs(spark, d):
    """Half of each type's samples, and no value of another sample."""
    pb = bulk(spark, d)
    many = [r[0] for r in pb.obs.groupBy("cell_type").count().where("count > 1").select("cell_type").collect()]
    half = pb.select_cell_types(many).subsample_obs(fraction=0.5)
    strays = half.X.join(half.obs_names, ["cell_type", "sample"], "left_anti").groupBy("cell_type").agg(F.count("*").alias("strays"))
    return half.obs.groupBy("cell_type").agg(F.count("*").alias("n")).join(strays, "cell_type", "left").fillna(0, "strays")


@query(w('SELECT cell_type, "sample", gene, round(x - avg(x) OVER (PARTITION BY cell_type, treatment, gene), 6) + 0.0 "value" FROM (SELECT cell_type, "sample", gene, log2("value" + pc) - log2(l + 2 * pc) + log2(1e6::DOUBLE) x FROM PD JOIN (SELECT *, 2 * l / avg(l) OVER (PARTITION BY cell_type) pc FROM (SELECT cell_type, "sample", sum("value")::DOUBLE l FROM PX GROUP BY 1, 2)) USING (cell_type, "sample")) JOIN PO USING (cell_type, "sample")', _C))
def q_regress_out_groups(spark, d):
    """Without an intercept or with one, a model of one factor leaves the distance to the mean of the group."""
    pb = _plain_sizes(bulk(spark, d)).log_cpm()
    return pb.regress_out("~ treatment").X.withColumn("value", F.round("value", 6) + 0.0)


# -- single cells -----------------------------------------------------------------------------------------------------


@query(w('SELECT gene, coalesce("value", 0)::BIGINT "value" FROM var LEFT JOIN (FROM X WHERE row_id = 5) USING (col_id)'))
def q_sc_cell(spark, d):
    return fine(spark, d).cell("cell5").select("gene", "value")


@query(w('SELECT cell, coalesce("value", 0)::BIGINT "value" FROM obs LEFT JOIN (FROM X WHERE col_id = 7) USING (row_id)'))
def q_sc_gene(spark, d):
    return fine(spark, d).gene("gene7").select("cell", "value")


@query(w('SELECT row_id, "sample" FROM obs'))
def q_sc_set_obs_names(spark, d):
    return fine(spark, d).set_obs_names("sample").obs_names


@query(w("SELECT col_id, brand FROM var"))
def q_sc_set_var_names(spark, d):
    return fine(spark, d).set_var_names("brand").var_names


_UNIQUE = "SELECT {key}, CASE WHEN k > 0 THEN n || '-' || k ELSE n END {name} FROM (SELECT {key}, {n} n, row_number() OVER (PARTITION BY {n} ORDER BY {key}) - 1 k FROM {t})"


@query(w(_UNIQUE.format(key="row_id", name="cell", n="donor::VARCHAR", t="obs")))
def q_sc_make_obs_names_unique(spark, d):
    return fine(spark, d).with_columns_obs(cell=F.col("donor").cast("string")).make_obs_names_unique().obs_names


@query(w(_UNIQUE.format(key="col_id", name="gene", n="brand", t="var")))
def q_sc_make_var_names_unique(spark, d):
    return fine(spark, d).with_columns_var(gene=F.col("brand")).make_var_names_unique().var_names


@query(w("SELECT col_id, gene, size, size * 2 twice FROM var"))
def q_sc_select_var(spark, d):
    return fine(spark, d).select_var("size", twice=F.col("size") * 2).var


@query(w("SELECT row_id, donor > 12 high FROM obs"))
def q_sc_with_columns_obs(spark, d):
    return fine(spark, d).with_columns_obs(high=F.col("donor") > 12).obs.select("row_id", "high")


@query(w("SELECT col_id, gene FROM var"))
def q_sc_drop_var(spark, d):
    return fine(spark, d).drop_var("brand", "type", "size").var


@query(w("SELECT col_id, gene, size width FROM var"))
def q_sc_rename_var(spark, d):
    return fine(spark, d).rename_var({"size": "width"}).var.select("col_id", "gene", "width")


@query(w("SELECT col_id, size::VARCHAR size FROM var"))
def q_sc_cast_var(spark, d):
    return fine(spark, d).cast_var({"size": "string"}).var.select("col_id", "size")


@query(w('SELECT row_id, col_id, "value"::DOUBLE / 2 "value" FROM X'))
def q_sc_cast_X(spark, d):
    return fine(spark, d).cast_X("double").pipe_X(lambda x: x.withColumn("value", F.col("value") / 2)).X.select("row_id", "col_id", "value")


@query(w("SELECT col_id, parts FROM var JOIN (SELECT p_brand brand, count(*) parts FROM part GROUP BY 1) USING (brand)"))
def q_sc_join_var(spark, d):
    return fine(spark, d).join_var(_parts(d, spark).withColumnRenamed("gene", "brand"), on="brand", validate="m:1").var.select("col_id", "parts")


@query(w('SELECT row_id, col_id, "value" FROM X'))
def q_sc_tocsr_tocsc(spark, d):
    return fine(spark, d).tocsc().tocsr().copy().X.select("row_id", "col_id", "value")


@query(w('SELECT row_id, gene, "value" FROM X JOIN var USING (col_id)'))
def q_sc_concat_var(spark, d):
    sc = fine(spark, d)
    both = sc.filter_var(F.col("size") <= 25).concat_var(sc.filter_var(F.col("size") > 25))
    return both.X.join(both.var_names, "col_id").select("row_id", "gene", "value")


@query(w('SELECT row_id, col_id, "value", treatment FROM X JOIN obs USING (row_id)'))
def q_sc_split_by_obs(spark, d):
    """Every value of X is in the dataset of its cell's treatment."""
    return verbs.stacked([p.X.withColumn("treatment", F.lit(k)) for k, p in fine(spark, d).split_by_obs("treatment").items()], False, "X").select("row_id", "col_id", "value", "treatment")


@query(w('SELECT col_id, brand, count(*) n FROM X JOIN var USING (col_id) GROUP BY 1, 2'))
def q_sc_split_by_var(spark, d):
    return verbs.stacked([p.X.groupBy("col_id").agg(F.lit(k).alias("brand"), F.count("*").alias("n")) for k, p in fine(spark, d).split_by_var("brand").items()], False, "X").select("col_id", "brand", "n")


@query(w("SELECT cell_type, ceil(0.25 * count(*))::BIGINT n, 0::BIGINT strays FROM obs GROUP BY 1"))
def q_sc_subsample_obs(spark, d):
    """A quarter of each type's cells, each once, and no value of another cell."""
    sc = fine(spark, d)
    part = sc.subsample_obs(fraction=0.25, by_column="cell_type")
    strays = part.X.join(part.obs.select("row_id"), "row_id", "left_anti").join(sc.obs.select("row_id", "cell_type"), "row_id").groupBy("cell_type").agg(F.count("*").alias("strays"))
    return part.obs.groupBy("cell_type").agg(F.count_distinct("row_id").alias("n")).join(strays, "cell_type", "left").fillna(0, "strays")


@query(w("SELECT ceil(0.5 * count(*))::BIGINT n, 0::BIGINT strays FROM var"))
def q_sc_subsample_var(spark, d):
    """Half of the genes, each once, and no value of another gene."""
    part = fine(spark, d).subsample_var(fraction=0.5)
    strays = part.X.join(part.var.select("col_id"), "col_id", "left_anti").count()
    return part.var.agg(F.count_distinct("col_id").alias("n"), F.lit(strays).alias("strays"))


@query(w("SELECT row_id, donor FROM obs WHERE donor < 5"))
def q_sc_pipe_obs(spark, d):
    return fine(spark, d).pipe(lambda s: s.pipe_obs(lambda t, n: t.where(F.col("donor") < n), 5)).obs.select("row_id", "donor")


@query(w("SELECT col_id, size FROM var WHERE size > 40"))
def q_sc_pipe_var(spark, d):
    return fine(spark, d).pipe_var(lambda t: t.where("size > 40")).var.select("col_id", "size")


# -- keyed slots: added, renamed, changed, chosen, dropped ------------------------------------------------------------


def _keyed(sc, slot: str, table, change):
    call = lambda name, *args, **named: getattr(sc, f"{name}_{slot}")(*args, **named)
    sc = call("with", {"a": table, "b": table})
    sc = call("with", gone=table)
    sc = call("rename", {"a": "c"})
    sc = getattr(sc, f"pipe_{slot}_key")("c", change)
    sc = call("pipe", lambda entries: {k: v for k, v in entries.items() if k != "b"})
    sc = call("select", "c", "gone")
    return call("drop", "gone")


@query(w('SELECT vec_id row_id, round(embedding[1]::DOUBLE * 2, 9) "value" FROM embeddings', "Z AS (SELECT 1)"))
def q_sc_obsm(spark, d):
    sc = components(spark, d)
    done = _keyed(sc, "obsm", sc.obsm["pca"], lambda t: t.select("row_id", F.round(F.col("value")[0].cast("double") * 2, 9).alias("value")))
    assert list(done.obsm) == ["c"]
    return done.obsm["c"]


@query(w('SELECT col_id, size + 1 "value" FROM var'))
def q_sc_varm(spark, d):
    sc = fine(spark, d)
    return _keyed(sc, "varm", sc.var.select("col_id", F.col("size").alias("value")), lambda t: t.withColumn("value", F.col("value") + 1)).varm["c"]


@query(w("SELECT vec_id i, vec_id + 1 j, vec_id * 2.0::DOUBLE weight FROM embeddings", "Z AS (SELECT 1)"))
def q_sc_obsp(spark, d):
    sc = components(spark, d)
    edges = sc.obs.select(F.col("row_id").alias("i"), (F.col("row_id") + 1).alias("j"), F.col("row_id").cast("double").alias("weight"))
    return _keyed(sc, "obsp", edges, lambda t: t.withColumn("weight", F.col("weight") * 2)).obsp["c"]


@query(w("SELECT col_id i, size j, 3.0::DOUBLE weight FROM var"))
def q_sc_varp(spark, d):
    sc = fine(spark, d)
    edges = sc.var.select(F.col("col_id").alias("i"), F.col("size").alias("j"), F.lit(1.5).alias("weight"))
    return _keyed(sc, "varp", edges, lambda t: t.withColumn("weight", F.col("weight") * 2)).varp["c"]


@query(w("SELECT 'c' \"key\", 2 * count(*) \"value\" FROM obs"))
def q_sc_uns(spark, d):
    """A plain value of the table, doubled."""
    sc = fine(spark, d)
    done = _keyed(sc, "uns", len(sc), lambda v: v * 2)
    return spark.createDataFrame(list(done.uns.items()), "key string, value long")


# -- several datasets at once -----------------------------------------------------------------------------------------


@query()
def q_pca_joint(spark, d):
    """A dataset for each treatment."""
    from .catalog import coarse

    parts = coarse(spark, d).split_by_obs("treatment")
    first, *others = (p.normalize() for p in parts.values())
    done = first.pca(*others, num_PCs=5, hvg_column=None)
    return verbs.stacked([p.obsm["pca"].withColumn("dataset", F.lit(k)) for k, p in zip(parts, done)], False, "pca")


@query()
def q_harmony_joint(spark, d):
    """A dataset for each batch."""
    first, *others = components(spark, d).split_by_obs("batch").values()
    return verbs.stacked([p.obsm["harmony"] for p in first.harmonize(*others, num_clusters=10)], False, "harmony")
