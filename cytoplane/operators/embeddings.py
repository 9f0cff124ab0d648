"""Principal components, batch integration, communities and two-dimensional maps.

Components and integration are rounds of sums over tasks; what meets on the driver has the size of genes times a few
hundred vectors, or of clusters times batches. Communities and maps are sequential by nature: they run on the
driver over the neighbour graph, and refuse more than MAX_CELLS cells."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import SingleCell
from .lanczos import project, singular_vectors
from .neighbors import kmeans, neighbor_pairs, vectors_of
from .packed import flat_lists, lists
from .staging import drop_staged, staged

MAX_CELLS = 2_000_000
#: Genes that vary less count as varying so much.
MIN_SD = 1e-8
#: Genes that Spark may broadcast.
FEW_GENES = 20_000
#: Cells whose pairs are looked at at a time.
ROWS = 4096
#: Sums of a round of integration that go to the driver from each task; more are added up on the executors first.
DIRECT_BYTES = 32 << 20


def _vectors(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    if df.count() > MAX_CELLS:
        raise ValueError(f"at most {MAX_CELLS:,} cells")
    got = df.orderBy("row_id").select("row_id", "value").toArrow()
    return got.column("row_id").to_numpy(), vectors_of(got.column("value").combine_chunks()) if got.num_rows else np.zeros((0, 0))


def _table(like: DataFrame, ids: np.ndarray, values: np.ndarray) -> DataFrame:
    value = lists(values.astype(np.float32).ravel(), np.arange(len(values) + 1) * values.shape[1])
    return like.sparkSession.createDataFrame(pa.table({"row_id": ids.astype(np.int64), "value": value}), "row_id long, value array<float>")


def _stacked(row_id, k: int, sets: int):
    """Ids of the k-th of several datasets, distinct from those of the others."""
    return F.col(row_id) * sets + k


def _joint(sets: tuple[SingleCell, ...], QC_column: str | None, hvg_column: str | None) -> SingleCell:
    """Several datasets as one with the genes, matched by name, that all have (and that all flag, where flags are)."""
    flagged = lambda s: s.var.where(F.col(hvg_column)) if hvg_column and hvg_column in s.var.columns else s.var
    named = [flagged(s).select(F.col("col_id").alias(f"c{k}"), F.col(s.name_column("var")).alias("gene")) for k, s in enumerate(sets)]
    genes = named[0]
    for other in named[1:]:
        genes = genes.join(other, "gene")
    x, obs = [], []
    for k, s in enumerate(sets):
        cells, ids = s.passing(QC_column), genes.select(F.col("c0").alias("_to"), F.col(f"c{k}").alias("col_id"))
        x.append(cells.X.join(ids, "col_id").select(_stacked("row_id", k, len(sets)).alias("row_id"), F.col("_to").alias("col_id"), F.col("value").cast("double").alias("value")))
        obs.append(cells.obs.select(_stacked("row_id", k, len(sets)).alias("row_id"), F.lit(k).alias("_set")))
    return SingleCell(reduce(DataFrame.unionByName, x), reduce(DataFrame.unionByName, obs), genes.select(F.col("c0").alias("col_id"), "gene"))


def _parted(sets: tuple[SingleCell, ...], joint: SingleCell, key: str, **more) -> tuple[SingleCell, ...]:
    """The vectors of joint datasets, given back to each."""
    got = joint.obsm[key]
    own = lambda k: got.where(F.pmod("row_id", F.lit(len(sets))) == k).select(((F.col("row_id") - k) / len(sets)).cast("long").alias("row_id"), "value")
    return tuple(replace(s, obsm=s.obsm | {key: own(k)}, uns=s.uns | more) for k, s in enumerate(sets))


def pca(sc: SingleCell, *others: SingleCell, num_PCs: int = 50, hvg_column: str | None = "highly_variable", QC_column: str | None = "passed_QC", PC_key: str = "pca", tolerance: float = 1e-6, max_passes: int = 500, seed: int = 0, overwrite: bool = False):
    """Components of the genes scaled to unit variance and centred, by Lanczos bidiagonalisation over packed rows: each
    pass multiplies by a block of vectors, and a last one projects. Standard deviations under MIN_SD count as that. A
    component's largest loading is positive. Several datasets get components of all their cells together, and are
    returned as a tuple."""
    if others:
        sets = (sc, *others)
        if any(PC_key in s.obsm for s in sets) and not overwrite:
            raise ValueError(f"{PC_key!r} is there already")
        return _parted(sets, pca(_joint(sets, QC_column, hvg_column), num_PCs=num_PCs, hvg_column=None, QC_column=None, PC_key=PC_key, tolerance=tolerance, max_passes=max_passes, seed=seed), PC_key)
    if PC_key in sc.obsm and not overwrite:
        raise ValueError(f"{PC_key!r} is there already")
    cells = sc.passing(QC_column)
    genes = sc.var.where(F.col(hvg_column)) if hvg_column and hvg_column in sc.var.columns else sc.var
    n = cells.obs.count()
    rows, mean, sd = standardised(cells, genes, n)
    scale = 1 / np.maximum(sd, MIN_SD)
    v = singular_vectors(rows, mean, scale, n, min(num_PCs, len(mean)), tolerance=tolerance, max_passes=max_passes, seed=seed)[1]
    for j in range(v.shape[1] if len(v) else 0):
        v[:, j] *= np.sign(v[np.abs(v[:, j]).argmax(), j])
    known = project(rows, v, mean, scale)
    empty = F.array(*(F.lit(float(-x)).cast("float") for x in (mean * scale) @ v)) if v.shape[1] else F.array().cast("array<float>")
    return replace(sc, obsm=sc.obsm | {PC_key: cells.obs.select("row_id").join(known, "row_id", "left").withColumn("value", F.coalesce("value", empty))})


def standardised(cells: SingleCell, genes: DataFrame, n: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Packed rows (major, indices, values) of the genes, written once, with genes as places in the order of col_id; and
    the genes' means and standard deviations over n cells."""
    ids = np.sort(genes.select(F.col("col_id").cast("long")).toArrow().column(0).to_numpy())
    wanted = genes.select("col_id") if len(ids) <= FEW_GENES else genes.select("col_id").hint("merge")  # no broadcast of many
    x = cells.X.join(wanted, "col_id", "left_semi").select("row_id", "col_id", F.col("value").cast("double").alias("value"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            at, off = flat_lists(t.column(1))
            yield pa.RecordBatch.from_arrays([t.column(0), lists(np.searchsorted(ids, at), off), lists(flat_lists(t.column(2))[0], off)], names=["major", "indices", "values"])

    packed = x.groupBy(F.col("row_id").alias("major")).agg(F.array_sort(F.collect_list(F.struct(F.col("col_id").alias("i"), F.col("value").alias("v")))).alias("e"))  # as many as there are genes at most
    rows = packed.select("major", F.col("e.i").alias("indices"), F.col("e.v").alias("values")).mapInArrow(place, "major long, indices array<long>, values array<double>")
    rows = staged(rows, "packed")
    # of what is written, so that X is computed once
    each = rows.select(F.explode(F.arrays_zip("indices", "values")).alias("e")).select(F.col("e.indices").alias("i"), F.col("e.values").alias("v"))
    total, square = np.zeros(len(ids)), np.zeros(len(ids))
    for t in each.groupBy("i").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q")).toArrow().to_batches():
        at = t.column(0).to_numpy()
        total[at], square[at] = t.column(1).to_numpy(), t.column(2).to_numpy()
    mean = total / max(n, 1)
    return rows, mean, np.sqrt(np.maximum(square - n * mean**2, 0) / max(n - 1, 1))


def harmonize(sc: SingleCell, *others, batch_column: str | None = None, PC_key: str = "pca", Harmony_key: str = "harmony", num_clusters: int | None = None, theta: float = 2.0, tau: float = 0.0, sigma: float = 0.1, alpha: float = 0.2, max_iter: int = 10, max_cluster_iter: int = 20, tolerance: float = 1e-4, num_blocks: int = 1, QC_column: str | None = "passed_QC", seed: int = 0, overwrite: bool = False):
    """Soft clusters of normalised components that are penalised for uneven batches, and a linear correction of each
    batch within each cluster (Korsunsky et al. 2019). All cells move at once in a round or, with num_blocks, one block
    after another in a seeded order: a block's sums are taken out before its cells move, and put back after it, as in the
    original algorithm (which has 20 blocks). What a round needs of the cells are sums by cluster and batch; centroids and
    these sums ride to the tasks. Soft clusters are never stored: what a block last moved by tells them. With several datasets (whose
    components must come from one call of pca) each is a batch, or each of its batches is, and a tuple is returned."""
    if others and isinstance(others[0], str):
        batch_column, others = others[0], others[1:]
    if others:
        sets = (sc, *others)
        if any(Harmony_key in s.obsm for s in sets) and not overwrite:
            raise ValueError(f"{Harmony_key!r} is there already")
        ids = lambda t, k, *more: t.select(_stacked("row_id", k, len(sets)).alias("row_id"), *more)
        batch = lambda k: F.concat_ws("/", F.lit(str(k)), *([F.col(batch_column).cast("string")] if batch_column else []))
        obs = reduce(DataFrame.unionByName, (ids(s.passing(QC_column).obs, k, batch(k).alias("batch")) for k, s in enumerate(sets)))
        vectors = reduce(DataFrame.unionByName, (ids(s.obsm[PC_key], k, "value") for k, s in enumerate(sets)))
        joint = SingleCell(None, obs, sc.var, obsm={PC_key: vectors})
        done = harmonize(joint, batch_column="batch", PC_key=PC_key, Harmony_key=Harmony_key, num_clusters=num_clusters, theta=theta, tau=tau, sigma=sigma, alpha=alpha, max_iter=max_iter, max_cluster_iter=max_cluster_iter, tolerance=tolerance, num_blocks=num_blocks, QC_column=None, seed=seed)
        return _parted(sets, done, Harmony_key, **{k: v for k, v in done.uns.items() if k.startswith("harmony_")})
    if batch_column is None:
        raise ValueError("one dataset needs a batch_column")
    if Harmony_key in sc.obsm and not overwrite:
        raise ValueError(f"{Harmony_key!r} is there already")
    cells = sc.passing(QC_column)
    names = [r[0] for r in cells.obs.select(batch_column).distinct().orderBy(batch_column).collect()]
    index = F.create_map(*(F.lit(x) for k, b in enumerate(names) for x in (b, k)))
    block = F.pmod(F.xxhash64("row_id", F.lit(seed)), F.lit(num_blocks)).cast("int")
    first = sc.obsm[PC_key].join(cells.obs.select("row_id", index[F.col(batch_column)].alias("b")), "row_id").select("row_id", "b", block.alias("block"), F.col("value").cast("array<double>").alias("value")).withColumn("prior", F.col("value"))
    cur = staged(first, "components")
    n_b = np.zeros(len(names))
    for r in cur.groupBy("b").count().collect():
        n_b[r["b"]] = r["count"]
    n, share = n_b.sum(), n_b / n_b.sum()
    k = num_clusters or int(min(100, max(2, n // 30)))
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-12)
    normal = cur.select("row_id", F.transform("value", lambda x: x / F.sqrt(F.aggregate("value", F.lit(0.0), lambda a, y: a + y * y))).alias("value"))
    y = unit(kmeans(normal, k, seed=seed)[0])
    th = theta * (1 - np.exp(-((n_b / (len(y) * tau)) ** 2))) if tau > 0 else np.full(len(names), theta)

    def soft(z: np.ndarray, b: np.ndarray, block: np.ndarray, y: np.ndarray, penalty: np.ndarray) -> np.ndarray:
        """Of cells by clusters; penalty: blocks by clusters by batches."""
        r = 2 / sigma * (unit(z) @ y.T - 1) + np.log(penalty)[block, :, b]
        r = np.exp(r - r.max(1, keepdims=True))
        return r / r.sum(1, keepdims=True)

    def sums(table: DataFrame, y: np.ndarray, penalty: np.ndarray, raw: bool, by: str = "value"):
        """By cluster and batch: sums of R, of R z (with raw: z not normalised), and the fit. R is that of the column by."""
        d = y.shape[1]

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            o, w, fit = np.zeros((len(names), len(y))), np.zeros((len(names), len(y), d)), 0.0
            for t in batches:
                if t.num_rows:
                    z, b = vectors_of(t.column(2)), np.asarray(t.column(0))
                    r = soft(z if by == "value" else vectors_of(t.column(3)), b, np.asarray(t.column(1)), y, penalty)
                    fit += float((2 * r * (1 - unit(z) @ y.T)).sum() + sigma * (r * np.log(np.maximum(r, 1e-12))).sum())
                    for j in np.unique(b).tolist():
                        o[j] += r[b == j].sum(0)
                        w[j] += r[b == j].T @ (z if raw else unit(z))[b == j]
            # a row for each batch, so that the sums of a batch meet in one task
            arrays = [pa.array(np.arange(len(names))), *(pa.array([v.tobytes() for v in x], pa.binary()) for x in (o, w)), pa.array([fit] + [0.0] * (len(names) - 1))]
            yield pa.RecordBatch.from_arrays(arrays, names=["j", "o", "w", "fit"])

        def add(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            o, w, fit = 0.0, 0.0, 0.0
            for t in parts:
                o, w = (x + sum(np.frombuffer(v) for v in t.column(c).to_pylist()) for x, c in ((o, "o"), (w, "w")))
                fit += sum(t.column("fit").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([o.tobytes()], pa.binary()), pa.array([w.tobytes()], pa.binary()), pa.array([fit])], names=["j", "o", "w", "fit"])

        kinds = "j long, o binary, w binary, fit double"
        parts = table.select("b", "block", "value", *([by] if by != "value" else [])).mapInArrow(work, kinds)
        if tasks * len(names) * len(y) * d * 8 > DIRECT_BYTES:  # then a row a batch, else a row a task and batch
            parts = parts.groupBy("j").applyInArrow(add, kinds)
        o, w, fit = np.zeros((len(y), len(names))), np.zeros((len(names), len(y), d)), 0.0
        for g in parts.collect():
            o[:, g["j"]] += np.frombuffer(g["o"])
            w[g["j"]] += np.frombuffer(g["w"]).reshape(len(y), d)
            fit += g["fit"]
        return o, w, fit

    tasks = cur.rdd.getNumPartitions()
    def parts() -> list[DataFrame]:
        return [cur] if num_blocks == 1 else [cur.where(F.col("block") == k) for k in range(num_blocks)]

    def objective(o: np.ndarray, e: np.ndarray, fit: float) -> float:
        return fit + sigma * float((th * o * np.log((o + e + 1) / (e + 1))).sum())

    tasks = cur.rdd.getNumPartitions()
    penalty, past, steps = np.ones((num_blocks, len(y), len(names))), [], []
    for _ in range(max_iter):
        trail = []
        if num_blocks > 1:
            # sums of each block, by the vectors, centroids and penalties that it last moved by
            of = [sums(t, y, penalty, False, "prior") for t in parts()]
        for _ in range(max_cluster_iter):
            if num_blocks == 1:
                o, w, fit = sums(cur, y, penalty, False)
                e = np.outer(o.sum(1), share)
                trail.append(objective(o, e, fit))
                penalty = (((e + 1) / (o + e + 1)) ** th)[None]
                y = unit(w.sum(0))
            else:
                y = unit(sum(w for _, w, _ in of).sum(0))
                o = sum(x for x, _, _ in of)
                for k, t in enumerate(parts()):
                    rest = o - of[k][0]
                    e = np.outer(rest.sum(1), share)
                    penalty = penalty.copy()
                    penalty[k] = ((e + 1) / (rest + e + 1)) ** th
                    of[k] = sums(t, y, penalty, False)
                    o = rest + of[k][0]
                trail.append(objective(o, np.outer(o.sum(1), share), sum(f for _, _, f in of)))
                steps.append(trail[-1])
            if len(trail) > 3 and abs(trail[-4] - trail[-1]) < 1e-5 * abs(trail[-4]):
                break
        o, w, _ = sums(cur, y, penalty, True)
        e = np.outer(o.sum(1), share)
        shifts = np.zeros((len(names), len(y), y.shape[1]))
        for c in range(len(y)):
            use = o[c] >= 1e-5 * n_b
            # intercept and one column a batch, ridge on the batches
            a = np.zeros((len(names) + 1,) * 2)
            a[0, 0], a[0, 1:], a[1:, 0] = o[c, use].sum(), np.where(use, o[c], 0), np.where(use, o[c], 0)
            a[1:, 1:] = np.diag(np.where(use, o[c] + alpha * e[c], 1.0))
            right = np.vstack([w[use, c].sum(0)[None], np.where(use[:, None], w[:, c], 0)])
            shifts[:, c] = np.linalg.lstsq(a, right, rcond=None)[0][1:]

        def correct(batches: Iterator[pa.RecordBatch], y=y, penalty=penalty, shifts=shifts) -> Iterator[pa.RecordBatch]:
            for t in batches:
                if t.num_rows:
                    z, b = vectors_of(t.column(3)).copy(), np.asarray(t.column(1))
                    r = soft(z, b, np.asarray(t.column(2)), y, penalty)
                    for j in np.unique(b).tolist():  # a product a batch, so that no cell has the shifts of all clusters by itself
                        z[b == j] -= r[b == j] @ shifts[j]
                    yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), t.column(2), lists(z.ravel(), np.arange(len(z) + 1) * z.shape[1]), t.column(3)], names=["row_id", "b", "block", "value", "prior"])

        before, cur = cur, staged(cur.select("row_id", "b", "block", "value").mapInArrow(correct, "row_id long, b int, block int, value array<double>, prior array<double>"), "corrected")
        drop_staged(before)
        past.append(trail[-1])
        if len(past) > 1 and abs(past[-2] - past[-1]) < tolerance * abs(past[-2]):
            break
    return replace(sc, obsm=sc.obsm | {Harmony_key: cur.select("row_id", F.col("value").cast("array<float>").alias("value"))}, uns=sc.uns | {"harmony_objective": past} | ({"harmony_steps": steps} if num_blocks > 1 else {}))


def leiden(edges: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, resolution: float = 1.0, min_cluster_size: int = 1, seed: int = 0) -> np.ndarray:
    """Communities of a weighted graph (both directions given): local moving, greedy refinement within communities,
    aggregation; then small clusters join the first neighbour whose cluster is large enough."""
    i, j, w = edges
    label = np.arange(n)
    src, dst, wt, size = i, j, w.astype(float), n
    rng = np.random.default_rng(seed)
    part = np.arange(n)
    while True:
        order = np.argsort(src, kind="stable")
        s, d, x = src[order], dst[order], wt[order]
        start = np.searchsorted(s, np.arange(size + 1))
        degree = np.bincount(s, x, size)
        total = degree.sum() or 1.0
        mass = np.bincount(part, degree, size)

        def pull(v: int, part=part) -> dict[int, float]:
            got: dict[int, float] = {}
            for e in range(start[v], start[v + 1]):
                if d[e] != v:
                    got[part[d[e]]] = got.get(part[d[e]], 0.0) + x[e]
            return got

        queue = list(rng.permutation(size))
        waiting = np.ones(size, bool)
        moved = False
        at = 0
        while at < len(queue):
            v = queue[at]
            at += 1
            waiting[v] = False
            got, own = pull(v), part[v]
            base = got.get(own, 0.0) - resolution / total * degree[v] * (mass[own] - degree[v])
            best, gain = own, base
            for c, g in got.items():
                if c != own and g - resolution / total * degree[v] * mass[c] > gain + 1e-12:
                    best, gain = c, g - resolution / total * degree[v] * mass[c]
            if best != own:
                mass[own] -= degree[v]
                mass[best] += degree[v]
                part[v] = best
                moved = True
                for e in range(start[v], start[v + 1]):
                    if part[d[e]] != best and not waiting[d[e]]:
                        waiting[d[e]] = True
                        queue.append(d[e])
        if not moved:
            break
        # refinement: single nodes join a part of their own community
        fine, fine_mass, alone = np.arange(size), degree.copy(), np.ones(size, bool)
        for v in rng.permutation(size):
            if not alone[v]:
                continue
            got = {}
            for e in range(start[v], start[v + 1]):
                if d[e] != v and part[d[e]] == part[v]:
                    got[fine[d[e]]] = got.get(fine[d[e]], 0.0) + x[e]
            best, gain = fine[v], 0.0
            for c, g in got.items():
                if c != fine[v] and g - resolution / total * degree[v] * fine_mass[c] > gain + 1e-12:
                    best, gain = c, g - resolution / total * degree[v] * fine_mass[c]
            if best != fine[v]:
                fine_mass[fine[v]] -= degree[v]
                fine_mass[best] += degree[v]
                alone[best] = False
                fine[v] = best
        names, fine = np.unique(fine, return_inverse=True)
        coarse = np.zeros(len(names), int)
        coarse[fine] = part
        part = np.unique(coarse, return_inverse=True)[1]
        label, size = fine[label], len(names)
        pairs, back = np.unique(fine[src].astype(np.int64) * size + fine[dst], return_inverse=True)
        src, dst, wt = pairs // size, pairs % size, np.bincount(back, wt)
        part = part.astype(int)
        if size == len(np.unique(part)) and not moved:
            break
    out = part[label]
    count = np.bincount(out)
    for v in np.flatnonzero(count[out] < min_cluster_size):
        for u in j[i == v]:
            if count[out[u]] >= min_cluster_size:
                out[v] = out[u]
                break
    first = {c: k for k, c in enumerate(dict.fromkeys(out.tolist()))}
    return np.array([first[c] for c in out])


def modularity(edges: tuple[np.ndarray, np.ndarray, np.ndarray], label: np.ndarray, resolution: float = 1.0) -> float:
    i, j, w = edges
    total = w.sum() or 1.0
    degree = np.bincount(i, w, len(label))
    return float(w[label[i] == label[j]].sum() / total - resolution * (np.bincount(label, degree) ** 2).sum() / total**2)


def cluster(sc: SingleCell, resolution: float | list[float] = 1.0, shared_neighbors_key: str = "shared_neighbors", cluster_column: str = "cluster", min_cluster_size: int = 1, seed: int = 0, overwrite: bool = False) -> SingleCell:
    e = staged(sc.obsp[shared_neighbors_key], "graph")  # read three times, and each time its pairs would be found again
    ids = np.array(sorted(r[0] for r in e.select("i").union(e.select("j")).distinct().limit(MAX_CELLS + 1).collect()), np.int64)
    if len(ids) > MAX_CELLS:
        raise ValueError(f"at most {MAX_CELLS:,} cells")
    got = e.toPandas().sort_values(["i", "j"])  # rows come in no order, and ties go by it
    edges = np.searchsorted(ids, got.i), np.searchsorted(ids, got.j), got.weight.to_numpy(float)
    many = resolution if isinstance(resolution, list) else [resolution]
    names = [cluster_column] if not isinstance(resolution, list) else [f"{cluster_column}_{k}" for k in range(len(many))]
    if (there := [c for c in names if c in sc.obs.columns]) and not overwrite:
        raise ValueError(f"{there} are there already")
    labels = [leiden(edges, len(ids), r, min_cluster_size, seed) for r in many]
    table = sc.obs.sparkSession.createDataFrame([(int(i), *(int(x[k]) for x in labels)) for k, i in enumerate(ids)], "row_id long, " + ", ".join(f"{c} int" for c in names))
    return replace(sc, obs=sc.obs.drop(*names).join(table, "row_id", "left"))


def _graph(sc: SingleCell, PC_key: str, neighbors_key: str, distances_key: str | None = None, num_neighbors: int = 10):
    """Ids, vectors and neighbours of the cells; with distances_key the num_neighbors by scaled distance."""
    ids, pcs = _vectors(sc.obsm[PC_key])
    lists = sc.obsm[neighbors_key]
    if distances_key is not None:
        pairs = neighbor_pairs(lists, sc.obsm[distances_key], num_neighbors)
        lists = pairs.groupBy(F.col("i").alias("row_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "j"))).alias("r")).select("row_id", F.col("r.j").alias("value"))
    got = lists.orderBy("row_id").select("row_id", "value").toArrow()
    keep = np.isin(ids, got.column("row_id").to_numpy())
    ids, pcs = ids[keep], pcs[keep]
    near = np.searchsorted(ids, vectors_of(got.column("value").combine_chunks()))
    return ids, pcs, near


def pacmap(sc: SingleCell, PC_key: str = "pca", neighbors_key: str = "neighbors", distances_key: str = "distances", num_neighbors: int = 10, embedding_key: str = "pacmap", num_mid_near: int = 5, num_further: int = 20, iterations: tuple[int, int, int] = (100, 100, 250), learning_rate: float = 1.0, local: bool = False, low_distance: float = 10.0, seed: int = 0, overwrite: bool = False) -> SingleCell:
    """Pairs of near, middling and far cells pull and push two coordinates in three phases (Wang et al. 2021); local:
    near pairs count more the closer they are in the last phase, and far pairs are drawn anew among close ones."""
    if embedding_key in sc.obsm and not overwrite:
        raise ValueError(f"{embedding_key!r} is there already")
    ids, pcs, near = _graph(sc, PC_key, neighbors_key, distances_key, num_neighbors)
    n, rng = len(ids), np.random.default_rng(seed)
    six = rng.integers(0, n, (n, num_mid_near, 6))
    d = ((pcs[:, None, None, :] - pcs[six]) ** 2).sum(3) if n * num_mid_near * 6 * pcs.shape[1] < 5e7 else np.stack([((pcs[:, None, :] - pcs[six[:, m]]) ** 2).sum(2) for m in range(num_mid_near)], 1)
    mid = np.take_along_axis(six, np.argsort(d, 2)[:, :, 1:2], 2)[:, :, 0]
    far = rng.integers(0, n, (n, num_further))
    y = 0.01 * pcs[:, :2].astype(float)
    m1, m2 = np.zeros_like(y), np.zeros_like(y)
    for t in range(sum(iterations)):
        if t < iterations[0]:
            wn, wm, wf = 2.0, 1000 + (3 - 1000) * t / iterations[0], 1.0
        elif t < iterations[0] + iterations[1]:
            wn, wm, wf = 3.0, 3.0, 1.0
        else:
            wn, wm, wf = 1.0, 0.0, 1.0
        last = local and t >= iterations[0] + iterations[1]
        if last and t % 10 == 0:
            for _ in range(5):
                trial = rng.integers(0, n, far.shape)
                ok = sum((c[:, None] - c.take(trial)) ** 2 for c in np.ascontiguousarray(y.T)) < low_distance**2
                far = np.where(ok, trial, far)
        at, grad = np.ascontiguousarray(y.T), np.zeros((2, n))  # coordinate by coordinate, which numpy gathers fastest
        for m, weight, rule in ((near, wn, "near"), (mid, wm, "mid"), (far, wf, "far")):
            if weight:
                for lo in range(0, n, ROWS):  # so many cells at a time stay in a core's own cache
                    b = m[lo : lo + ROWS]
                    diff = [c[lo : lo + ROWS, None] - c.take(b) for c in at]
                    dist = 1 + (diff[0] ** 2 + diff[1] ** 2)
                    if rule == "near":
                        f = weight * 20 / (10 + dist) ** 2 * (0.5 * low_distance / np.sqrt(dist) if last else 1.0)
                    elif rule == "mid":
                        f = weight * 20000 / (10000 + dist) ** 2
                    else:
                        f = -weight * 2 / (1 + dist) ** 2
                    for c in (0, 1):
                        g = diff[c] * f
                        grad[c, lo : lo + ROWS] += g.sum(1)
                        np.subtract.at(grad[c], b.ravel(), g.ravel())
        grad = grad.T
        m1 += 0.1 * (grad - m1)
        m2 += 0.001 * (grad**2 - m2)
        y -= learning_rate * np.sqrt(1 - 0.999 ** (t + 1)) / (1 - 0.9 ** (t + 1)) * m1 / (np.sqrt(m2) + 1e-7)
    return replace(sc, obsm=sc.obsm | {embedding_key: _table(sc.obs, ids, y)})


def localmap(sc: SingleCell, embedding_key: str = "localmap", **how) -> SingleCell:
    return pacmap(sc, embedding_key=embedding_key, local=True, **how)


def umap(sc: SingleCell, PC_key: str = "pca", neighbors_key: str = "neighbors", distances_key: str = "distances", embedding_key: str = "umap", num_epochs: int = 200, a: float = 1.577, b: float = 0.895, negatives: int = 5, seed: int = 0, overwrite: bool = False) -> SingleCell:
    """Fuzzy memberships of the neighbour graph laid out by sampled attraction and repulsion (McInnes et al. 2018), all
    edges of an epoch at once."""
    if embedding_key in sc.obsm and not overwrite:
        raise ValueError(f"{embedding_key!r} is there already")
    ids, pcs, near = _graph(sc, PC_key, neighbors_key)
    n, k = near.shape
    dist = np.sqrt(np.concatenate([((pcs[lo : lo + ROWS, None, :].astype(float) - pcs[near[lo : lo + ROWS]]) ** 2).sum(2) for lo in range(0, n, ROWS)]))
    rho = dist.min(1, keepdims=True)
    low, high = np.full((n, 1), 1e-6), np.full((n, 1), 1e4)
    for _ in range(64):
        s = np.sqrt(low * high)
        over = np.exp(-np.maximum(dist - rho, 0) / s).sum(1, keepdims=True) > np.log2(k)
        low, high = np.where(over, low, s), np.where(over, s, high)
    w = np.exp(-np.maximum(dist - rho, 0) / np.sqrt(low * high))
    key = np.repeat(np.arange(n), k) * n + near.ravel()
    back = near.ravel() * n + np.repeat(np.arange(n), k)
    both, inv = np.unique(np.concatenate([key, back]), return_inverse=True)
    p = np.bincount(inv[: len(key)], w.ravel(), len(both))
    q = np.bincount(inv[len(key) :], w.ravel(), len(both))
    p, i, j = p + q - p * q, both // n, both % n
    rng = np.random.default_rng(seed)
    y = pcs[:, :2].astype(float)
    y = 10 * y / max(np.abs(y).max(), 1e-12) + rng.normal(0, 1e-4, y.shape)
    y = 10 * (y - y.min(0)) / np.maximum(np.ptp(y, axis=0), 1e-12)
    for epoch in range(num_epochs):
        rate = 1 - epoch / num_epochs
        e = rng.random(len(p)) < p
        u, v = i[e], j[e]
        at, move = np.ascontiguousarray(y.T), np.zeros((2, n))
        here = [c.take(u) for c in at]
        diff = [c - d.take(v) for c, d in zip(here, at)]
        d2 = np.maximum(diff[0] ** 2 + diff[1] ** 2, 1e-12)
        f = -2 * a * b * d2 ** (b - 1) / (1 + a * d2**b)
        for c in (0, 1):
            move[c] += np.bincount(u, np.clip(diff[c] * f, -4, 4), n)
        for _ in range(negatives):
            o = rng.integers(0, n, len(u))
            diff = [c - d.take(o) for c, d in zip(here, at)]
            d2 = diff[0] ** 2 + diff[1] ** 2
            f = np.where(u != o, 2 * b / ((0.001 + d2) * (1 + a * d2**b)), 0)
            for c in (0, 1):
                move[c] += np.bincount(u, np.clip(diff[c] * f, -4, 4), n)
        move = move.T
        y += rate * np.clip(move, -4, 4)
    return replace(sc, obsm=sc.obsm | {embedding_key: _table(sc.obs, ids, y)})


def points(sc: SingleCell, embedding_key: str = "umap", color_column: str | None = None) -> DataFrame:
    """row_id, x, y and the colour column: what a scatter plot shows."""
    t = sc.obsm[embedding_key].select("row_id", F.col("value")[0].alias("x"), F.col("value")[1].alias("y"))
    return t.join(sc.obs.select("row_id", color_column), "row_id") if color_column else t


for _name, _f in {"pca": pca, "harmonize": harmonize, "cluster": cluster, "umap": umap, "pacmap": pacmap, "localmap": localmap, "plot_embedding": points}.items():
    setattr(SingleCell, _name, _f)
for _key in ("umap", "pacmap", "localmap"):
    setattr(SingleCell, f"plot_{_key}", lambda self, color_column=None, embedding_key=_key: points(self, embedding_key, color_column))
