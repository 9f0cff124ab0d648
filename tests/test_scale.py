"""Faults that showed on larger tables, on small ones made to have them."""

import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cytoplane.api import SingleCell
from cytoplane.operators import cell_analysis, embeddings, lanczos
from cytoplane.operators import neighbors as nn
from cytoplane.plans import catalog, matrix_queries, verb_queries  # noqa: F401  the others add their queries to the first


@pytest.fixture(scope="module")
def full(spark, tmp_path_factory):
    """Tables in which each sample of each type has counts of every gene, and a connection that sees them."""
    d = str(tmp_path_factory.mktemp("full"))
    con = duckdb.connect()
    con.execute("CREATE TABLE customer AS SELECT k::BIGINT c_custkey, (k % 2)::INTEGER c_nationkey FROM range(4) t(k)")
    con.execute("CREATE TABLE part AS SELECT k::BIGINT p_partkey, 'Brand#' || (k % 3 + 1) p_brand, 'PROMO' p_type, 1::INTEGER p_size FROM range(6) t(k)")
    con.execute("CREATE TABLE orders AS SELECT k::BIGINT o_orderkey, (k % 4)::BIGINT o_custkey, CASE WHEN k % 8 < 4 THEN 'O' ELSE 'F' END o_orderstatus, CASE WHEN k % 16 < 8 THEN '1-URGENT' ELSE '2-HIGH' END o_orderpriority FROM range(640) t(k)")
    con.execute("CREATE TABLE lineitem AS SELECT o_orderkey l_orderkey, p_partkey l_partkey, (1 + (o_orderkey * 7 + p_partkey) % 5)::DOUBLE l_quantity FROM orders, part")
    for t in ("customer", "part", "orders", "lineitem"):
        con.execute(f"COPY {t} TO '{d}/{t}.parquet' (FORMAT parquet)")
    return d, con


def same_as_sql(spark, full, name):
    d, con = full
    got = catalog.QUERIES[name](spark, d)
    want = con.execute(catalog.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(c[0] for c in want.description)
    assert sorted(map(tuple, got.select(*(c[0] for c in want.description)).collect())) == sorted(want.fetchall())


def test_no_sample_left_is_an_empty_table(spark, full):
    same_as_sql(spark, full, "pb_qc_samples")
    with pytest.raises(ValueError):
        catalog.bulk(spark, full[0]).qc("treatment", max_standard_deviations=1)


def test_no_sample_left_is_an_empty_table_of_genes(spark, full):
    same_as_sql(spark, full, "pb_qc_genes")


def test_sums_of_samples_are_computed_once(spark, full):
    pb = catalog.bulk(spark, full[0])
    for t in (pb.X, pb.obs):
        assert t.inputFiles() and all("/pseudobulk-" in f for f in t.inputFiles())


def test_exact_neighbours_are_found_in_many_tasks_and_once(spark):
    n = 4_500
    v = spark.range(n).select(F.col("id").alias("row_id"), F.array(*(F.rand(k).cast("float") for k in range(3))).alias("value"))
    v = spark.createDataFrame(v.toPandas(), "row_id long, value array<float>")
    found = nn.nearest(v, v, 3, same=True)
    assert all("/nearest-" in f for f in found.inputFiles())
    got = found.orderBy("i", "rank").toPandas()
    m = np.stack(v.orderBy("row_id").toPandas().value.map(np.asarray)).astype(float)
    d = ((m[::100, None] - m[None]) ** 2).sum(2)
    d[np.arange(len(d)), np.arange(0, n, 100)] = np.inf
    assert (got[got.i % 100 == 0].j.to_numpy().reshape(-1, 3) == np.argsort(d, 1, kind="stable")[:, :3]).all()
    assert [nn.blocks(k) for k in (0, 1, 2_000, 4_500, 24_000, 240_000, 1_200_000)] == [1, 1, 1, 3, 12, 12, 60]


def test_close_singular_values_part(monkeypatch):
    """A matrix of noise: its largest values lie close together, so that a small subspace never parts them."""
    a = np.random.default_rng(5).normal(size=(2_500, 2_000))
    monkeypatch.setattr(lanczos, "normal_product", lambda rows, y, mean, scale, cells: a.T @ (a @ y))
    value, _ = lanczos.singular_vectors(None, np.zeros(2_000), np.ones(2_000), 2_500, 5, tolerance=1e-6, max_passes=60)
    assert np.allclose(value, np.linalg.svd(a, compute_uv=False)[:5], rtol=1e-9)


def test_vectors_stay_in_files(monkeypatch):
    """The driver holds some blocks of vectors, not a subspace of them, and finds the same values."""
    g, block = 100_000, 2 * 8 * 100_000
    size = np.concatenate([[1.0, 0.97], np.linspace(0.93, 0.1, g - 2)])
    monkeypatch.setattr(lanczos, "normal_product", lambda rows, y, mean, scale, cells: size[:, None] ** 2 * y)
    monkeypatch.setattr(lanczos, "KEPT_BYTES", 0, raising=False)
    monkeypatch.setattr(lanczos, "READ_BYTES", 1 << 18, raising=False)
    mean, scale = np.zeros(g), np.ones(g)
    tracemalloc.start()
    value, vectors = lanczos.singular_vectors(None, mean, scale, g, 2, subspace=40, tolerance=1e-6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(value, size[:2]) and np.allclose(np.abs(np.diag(vectors[:2])), 1)
    assert peak < 8 * block


def test_components_read_the_counts_once(spark, full):
    _, mean, dev = embeddings.standardised(catalog.coarse(spark, full[0]), catalog.coarse(spark, full[0]).var, 640)
    want = full[1].execute("SELECT avg(v), stddev_samp(v) FROM (SELECT sum(l_quantity) v, p_brand b FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, 2) GROUP BY b ORDER BY b").fetchall()
    assert np.allclose(np.stack([mean, dev], 1), want)


def test_names_read_back_stay_off_the_driver(spark, full):
    got = catalog.QUERIES["mtx_round_trip"](spark, full[0])
    assert got._jdf.queryExecution().optimizedPlan().toString().count("strategy=merge") == 2


def test_pairs_of_genes_are_dealt_to_as_many_tasks_as_they_need(spark, full, monkeypatch):
    """No task counts more than a fixed number of pairs, whatever their number."""
    monkeypatch.setattr(cell_analysis, "COUNTED", 500)
    got = catalog.QUERIES["doublet_pair_counts"](spark, full[0])
    assert "RepartitionByExpression [a" in got._jdf.queryExecution().optimizedPlan().toString() and got._jdf.queryExecution().optimizedPlan().toString().count(", 20") >= 1
    same_as_sql(spark, full, "doublet_pair_counts")


def test_doublets_compute_the_counts_once(spark, full, monkeypatch):
    """The counts are read from tables that are written once, by cell."""
    written = []
    keep = cell_analysis.staged
    monkeypatch.setattr(cell_analysis, "staged", lambda t, label: written.append((label, t.inputFiles())) or keep(t, label))
    catalog.QUERIES["cxds_doublets"](spark, full[0]).collect()
    assert [label for label, files in written if any("lineitem" in f for f in files)] == ["counts"]


def test_customers_and_parts_stay_off_the_driver(spark, full):
    """They grow with the tables, so that their joins are no broadcasts, however small they are."""
    sc = catalog.coarse(spark, full[0])
    for t in (sc.obs, sc.X):
        plan = t._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_vectors_are_read_without_python_lists():
    """Also of a part of a column."""
    rows = np.random.default_rng(3).normal(size=(9, 4)).astype(np.float32)
    column = pa.array(list(rows), pa.list_(pa.float32()))
    assert (nn.vectors_of(column) == rows).all() and (nn.vectors_of(column[2:7]) == rows[2:7]).all()
    assert nn.vectors_of(column[:0]).shape == (0, 0)


def counted_rows(spark, table):
    """table, and an accumulator of the rows of it that are computed."""
    seen = spark.sparkContext.accumulator(0)

    def work(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return table.mapInArrow(work, table.schema), seen


def test_vectors_are_read_once_for_neighbours(spark):
    rng = np.random.default_rng(7)
    rows, seen = counted_rows(spark, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(400, 4)))], "row_id long, value array<float>"))
    obs = spark.range(400).select(F.col("id").alias("row_id"), F.lit("a").alias("arm"))
    sc = SingleCell(None, obs, spark.range(1).select(F.col("id").alias("col_id"), F.lit("none").alias("gene")), obsm={"pca": rows, "harmony": rows})
    assert sc.neighbors(num_neighbors=5).obsm["neighbors"].count() == 400 and seen.value == 400
    assert sc.label_transfer_from(sc, "arm", "to").obs.where("to = 'a'").count() == 400
    assert seen.value <= 400 * 5  # once as the base; as queries for the lists, the count of them and the short ones


def test_graph_is_made_once_for_communities(spark):
    both = [(12 * b + i, 12 * b + j, 1.0) for b in range(3) for i in range(12) for j in range(12) if i != j] + [(0, 12, 0.1), (12, 0, 0.1), (12, 24, 0.1), (24, 12, 0.1)]
    graph, seen = counted_rows(spark, spark.createDataFrame(both, "i long, j long, weight float"))
    obs = spark.range(36).select(F.col("id").alias("row_id"))
    got = SingleCell(None, obs, spark.range(1).select(F.col("id").alias("col_id")), obsp={"shared_neighbors": graph}).cluster().obs.collect()
    assert len({r["cluster"] for r in got}) == 3 == len({(r["row_id"] // 12, r["cluster"]) for r in got})
    assert seen.value == len(both)


def test_shared_neighbours_with_hubs_are_dealt_once(spark):
    """Lists of all sizes with a few hubs: the pairs of brute force, each way once, by a single join of lists."""
    rng = np.random.default_rng(8)
    near = {i: [int(x) for x in dict.fromkeys([*rng.choice(5, rng.integers(0, 4), replace=False), *rng.choice(150, rng.integers(0, 9), replace=False)]) if x != i] for i in range(150)}
    lists = spark.createDataFrame([(i, x) for i, x in near.items()], "row_id long, value array<long>")
    whole = {i: {i, *x} for i, x in near.items()}
    for least in (1, 2, 3, 5):
        want = sorted((i, j, np.float32(n / (len(a) + len(b) - n))) for i, a in whole.items() for j, b in whole.items() if i != j and (n := len(a & b)) >= least)
        got = nn.shared(lists, least)
        assert want and sorted((r["i"], r["j"], np.float32(r["weight"])) for r in got.collect()) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 3 and "Union" not in plan  # members and their numbers on both sides, and the pairs
