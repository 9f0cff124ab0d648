"""Nearest neighbours, shared neighbours, label transfer and k-means over tables of vectors (row_id, value ARRAY<FLOAT>).

Vectors meet by the cell of a k-means partition (an inverted file): each query looks at the cells of its nearest
centroids. The centroids are the only thing that is broadcast, at most MAX_CENTROIDS of them. A cell with more than
TILE vectors is dealt out over several tasks, each of which gives its own k nearest, so that a cell with a third of all
vectors is not one task. Without centroids the search is exact: queries and vectors are dealt into blocks, and each
pair of blocks is one task."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cells import SingleCell
from .packed import flat_lists
from .staging import drop_staged, staged

TILE, LEAST = 20_000, 2_000
MAX_CENTROIDS = 65_536
#: Rows and vectors that are compared at a time, terms of differences held at a time, least scale of a cell.
ROWS, SIDE, DIFFERENCES, MIN_SCALE = 512, 4096, 4_000_000, 1e-10
FOUND = "i long, j long, d double"


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, 0))


def vectors_of(column: pa.Array) -> np.ndarray:
    """The vectors of a list column, all of one size, as rows."""
    at, _ = flat_lists(column)
    return at.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """From differences, some rows of a at a time, so that no distance depends on how many are asked for at once."""
    out = np.empty((len(a), len(b)))
    step = max(1, DIFFERENCES // max(1, b.size))
    for k in range(0, len(a), step):
        out[k : k + step] = ((a[k : k + step, None, :] - b[None, :, :]) ** 2).sum(2)
    return out


def closest(a: np.ndarray, b: np.ndarray, n: int, ids: np.ndarray | None = None, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in b, squared distance) of the n nearest of b for each row of a, sorted by row, distance (to nine
    places) and ids of b (by default places). Rows of a have the ids own, if given, and leave out b of the same id.

    b is looked at SIDE rows at a time. Expanded squares tell which could be among the nearest, with room for all their
    rounding; distances of these come from differences, so that near ties come out the same in any blocks."""
    ids = np.arange(len(b)) if ids is None else ids
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    b2 = (b**2).sum(1)
    for lo in range(0, len(a), ROWS):
        part = a[lo : lo + ROWS]
        a2 = (part**2).sum(1)
        rows, places, far = [], [], []
        for s in range(0, len(b), SIDE):
            side = b[s : s + SIDE]
            d = a2[:, None] - 2 * part @ side.T + b2[s : s + SIDE]
            if own is not None:
                d[own[lo : lo + ROWS, None] == ids[None, s : s + SIDE]] = np.inf
            cut = np.partition(d, n - 1, axis=1)[:, n - 1] if n < d.shape[1] else np.full(len(part), np.inf)
            slack = 4e-9 + 1e-12 * (a2 + b2[s : s + SIDE].max(initial=0.0))
            i, j = np.nonzero((d <= (cut + slack)[:, None]) & np.isfinite(d))
            rows.append(i)
            places.append(j + s)
            far.append(((part[i] - side[j]) ** 2).sum(1))
        i, j, d = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, places, far))
        d = np.round(d, 9)
        order = np.lexsort((ids[j], d, i))
        i, j, d = i[order], j[order], d[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        out.append((i[rank < n] + lo, j[rank < n], d[rank < n]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _nearest(k: int, same: bool):
    def work(queries: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(base):
            return pd.DataFrame({"i": [], "j": [], "d": []})
        ids, qid = base["id"].to_numpy(), queries["id"].to_numpy()
        i, j, d = closest(_matrix(queries["v"]), _matrix(base["v"]), k, ids, qid if same else None)
        return pd.DataFrame({"i": qid[i], "j": ids[j], "d": d})

    return work


def blocks(n: int) -> int:
    """Into how many blocks the exact search deals n vectors: a dozen, so that all cores have pairs of them, but none of
    less than LEAST or of more than TILE, since each vector is sent once for each block of the other side."""
    return max(1, math.ceil(n / min(TILE, max(LEAST, math.ceil(n / 12)))))


def nearest(queries: DataFrame, base: DataFrame, k: int, centroids: np.ndarray | None = None, probes: int = 10, same: bool = False) -> DataFrame:
    """(i, j, d, rank): the k nearest of base for each query, squared distances, ties by id. same: a vector is not its
    own neighbour. Queries whose cells hold fewer than k vectors are searched again in all cells, without centroids."""
    q, b = queries.select(F.col("row_id").alias("id"), F.col("value").alias("v")), base.select(F.col("row_id").alias("id"), F.col("value").alias("v"))
    if centroids is None:
        nb, nq = blocks(b.count()), blocks(q.count())
        b = b.withColumn("cell", F.pmod(F.xxhash64("id"), F.lit(nb)).cast("int")).withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
        q = q.withColumn("tile", F.pmod(F.xxhash64("id"), F.lit(nq)).cast("int")).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
    else:
        b, q = assign(b, centroids, 1), assign(q, centroids, probes)
        # at most MAX_CENTROIDS rows; by merging, vectors would be sent once more for them
        sizes = F.broadcast(b.groupBy("cell").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")))
        b = b.join(sizes, "cell").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")).drop("tiles")
        q = q.join(sizes, "cell").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).drop("tiles")
    found = q.groupBy("cell", "tile").cogroup(b.groupBy("cell", "tile")).applyInPandas(_nearest(k, same), FOUND)
    w = Window.partitionBy("i").orderBy("d", "j")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    # written once: what reads neighbours reads them several times, and each time would search again
    ranked = staged(ranked, "nearest")
    if centroids is None:
        return ranked
    full = ranked.groupBy("i").agg(F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("i").alias("row_id"))
    # ids first: vectors are looked up for the few that are short, not compared with all that are not
    lacking = staged(queries.select("row_id").join(full, "row_id", "left_anti"), "short-ids")
    if lacking.isEmpty():
        return ranked
    short = staged(queries.join(lacking.distinct(), "row_id", "left_semi"), "short")
    again = nearest(short, base, k, same=same)
    return ranked.join(short.select(F.col("row_id").alias("i")), "i", "left_anti").select(*again.columns).unionByName(again)


def assign(vectors: DataFrame, centroids: np.ndarray, n: int) -> DataFrame:
    """vectors (id, v) with the `cell`s of their n nearest centroids, a row each."""
    if len(centroids) > MAX_CENTROIDS:
        raise ValueError(f"at most {MAX_CENTROIDS} centroids")
    c = np.asarray(centroids, np.float64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if not t.num_rows:
                continue
            rows, cell, _ = closest(vectors_of(t.column(1)).astype(np.float64), c, min(n, len(c)))
            yield pa.RecordBatch.from_arrays([t.column(0).take(pa.array(rows)), t.column(1).take(pa.array(rows)), pa.array(cell.astype(np.int32))], names=["id", "v", "cell"])

    return vectors.select("id", "v").mapInArrow(work, "id long, v array<" + vectors.schema["v"].dataType.elementType.simpleString() + ">, cell int")


def kmeans(vectors: DataFrame, num_clusters: int, max_iter: int = 20, tolerance: float = 1e-3, init: str = "random", seed: int = 0) -> tuple[np.ndarray, DataFrame]:
    """Centroids and (row_id, cell). Each round sums vectors by cell inside the tasks; only sums of cells meet on the
    driver. Stops when the total distance falls by less than tolerance, from the second round on. init: random distinct
    rows by a seeded hash, or `k-means||`. Tasks compare a few thousand centroids at a time."""
    v = vectors.select(F.col("row_id").alias("id"), F.col("value").alias("v"))
    order = F.xxhash64("id", F.lit(seed))
    start = _matrix([r["v"] for r in v.orderBy(order, "id").limit(num_clusters).collect()]) if init == "random" else parallel_start(v, num_clusters, seed)
    c, last = start, None
    for k in range(max_iter):
        sums, sizes, cost = _round(v, c)
        c = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], c)
        if (empty := np.flatnonzero(sizes == 0)).size:
            # a cell without vectors moves to one of those that lie farthest from theirs
            far = assign_distance(v, c).where("d > 0").orderBy(F.desc("d"), "id").limit(len(empty)).collect()
            c[empty[: len(far)]] = _matrix([r["v"] for r in far]) if far else c[:0]
        if k and last is not None and last - cost < tolerance * last:
            break
        last = cost
    return c, assign(v, c, 1).select(F.col("id").alias("row_id"), "cell")


def parallel_start(v: DataFrame, num_clusters: int, seed: int = 0, rounds: int = 5) -> np.ndarray:
    """`k-means||` (Bahmani et al. 2012): in each round rows are drawn with a chance in proportion to their distance from
    those drawn so far, 2 num_clusters of them in the mean; each stands for the rows that it is nearest to, and these
    weights steer the choice among the drawn ones. Each row's distance is kept in a table from round to round, so that
    a round compares it with the newly drawn rows only."""
    order = F.xxhash64("id", F.lit(seed))
    new = _matrix([r["v"] for r in v.orderBy(order, "id").limit(1).collect()])
    drawn, cur = new, v.withColumn("d", F.lit(float("inf")))
    for step in range(rounds if len(new) else 0):
        nearer = assign_distance(cur, new, least="d")
        before, cur = cur, staged(nearer, "distances")
        if step:
            drop_staged(before)
        cost = cur.agg(F.sum("d")).first()[0]
        if not cost:
            break
        chance = F.pmod(F.xxhash64("id", F.lit(seed + 1 + step)), F.lit(1 << 30)) / float(1 << 30)
        more = cur.where(chance < F.least(F.lit(1.0), F.col("d") * (2 * num_clusters / cost))).orderBy("id").select("v").collect()
        new = _matrix([r["v"] for r in more])
        if len(new):
            drawn = np.vstack([drawn, new])
        else:
            new = drawn[-1:]
    weight = _round(v, drawn)[1]
    return weighted_centroids(drawn, weight, min(num_clusters, len(drawn)), seed)


def weighted_centroids(points: np.ndarray, weight: np.ndarray, k: int, seed: int = 0, rounds: int = 30) -> np.ndarray:
    """k centroids of weighted points: k-means++ and Lloyd's rounds, in numpy."""
    rng = np.random.default_rng(seed)
    points, weight = points[weight > 0], weight[weight > 0]
    c = points[[rng.choice(len(points), p=weight / weight.sum())]] if len(points) else points
    near = squared_distances(points, c).min(1) if len(points) else weight
    while len(c) < min(k, len(points)):
        chance = near * weight
        pick = rng.choice(len(points), p=chance / chance.sum()) if chance.sum() > 0 else len(c)
        c = np.vstack([c, points[pick]])
        near = np.minimum(near, squared_distances(points, c[-1:])[:, 0])
    for _ in range(rounds if len(points) else 0):
        _, cell, _ = closest(points, c, 1)
        sizes = np.bincount(cell, weight, len(c))
        sums = np.stack([np.bincount(cell, weight * x, len(c)) for x in points.T], 1)
        moved = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1e-300)[:, None], c)
        if np.allclose(moved, c, rtol=1e-9, atol=0):
            break
        c = moved
    return c


def assign_distance(v: DataFrame, c: np.ndarray, least: str | None = None) -> DataFrame:
    """(id, v, d): the squared distance to the nearest of c, or what the column `least` has if that is less."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if t.num_rows:
                d = closest(vectors_of(t.column(1)).astype(np.float64), c, 1)[2]
                yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(np.minimum(d, np.asarray(t.column(2))) if least else d)], names=["id", "v", "d"])

    return v.select("id", "v", *([least] if least else [])).mapInArrow(work, "id long, v array<" + v.schema["v"].dataType.elementType.simpleString() + ">, d double")


def _round(v: DataFrame, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Sums and numbers of vectors by nearest centroid, and the sum of distances. Tasks send a row for each batch and cell
    that has vectors there; these are added up in the tasks before they are shuffled."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if t.num_rows:
                m = vectors_of(t.column(0)).astype(np.float64)
                _, cell, d = closest(m, c, 1)
                order = np.argsort(cell, kind="stable")
                first = np.flatnonzero(np.concatenate([[True], np.diff(cell[order]) > 0]))
                n = np.diff(np.append(first, len(order)))
                yield pa.RecordBatch.from_arrays([pa.array(cell[order[first]]), pa.array(n.astype(float)), pa.array(list(np.add.reduceat(m[order], first, axis=0)), pa.list_(pa.float64())), pa.array(np.add.reduceat(d[order], first))], names=["cell", "n", "s", "cost"])

    parts = v.select("v").mapInArrow(work, "cell long, n double, s array<double>, cost double").groupBy("cell").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("s")[i]) for i in range(c.shape[1]))).alias("s"), F.sum("cost").alias("cost")).collect()
    sums, sizes = np.zeros(c.shape), np.zeros(len(c))
    for r in parts:
        sums[r["cell"]], sizes[r["cell"]] = r["s"], r["n"]
    return sums, sizes, sum(r["cost"] for r in parts)


def neighbors(sc: SingleCell, num_neighbors: int = 20, PC_key: str = "pca", num_clusters: int | None = None, num_clusters_searched: int = 10, kmeans_barbar: bool = False, QC_column: str | None = "passed_QC", neighbors_key: str = "neighbors", distances_key: str = "distances", seed: int = 0, overwrite: bool = False) -> SingleCell:
    """The nearest cells of each cell and their squared distances. num_clusters 0: exact."""
    if neighbors_key in sc.obsm and not overwrite:
        raise ValueError(f"{neighbors_key!r} is there already")
    # written once: each round of k-means reads the vectors, and each time would join them again
    v = staged(sc.obsm[PC_key].join(sc.passing(QC_column).obs.select("row_id"), "row_id", "left_semi"), "vectors")
    n = v.count()
    if n <= num_neighbors:
        raise ValueError(f"{n} cells have no {num_neighbors} neighbours")
    m = min(int(math.sqrt(n)), MAX_CENTROIDS) if num_clusters is None else num_clusters
    c = kmeans(v, m, init="k-means||" if kmeans_barbar else "random", seed=seed)[0] if m > 1 else None
    found = nearest(v, v, num_neighbors, c, num_clusters_searched, same=True)
    lists = found.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("rank", "j", "d"))).alias("r")).select(F.col("i").alias("row_id"), F.col("r.j").alias("j"), F.col("r.d").cast("array<float>").alias("d"))
    return replace(sc, obsm=sc.obsm | {neighbors_key: lists.select("row_id", F.col("j").alias("value")), distances_key: lists.select("row_id", F.col("d").alias("value"))})


def shared(lists: DataFrame, min_shared: int = 1) -> DataFrame:
    """(i, j, weight): Jaccard index of the neighbourhoods (each with its own cell) of cells that share min_shared
    members. lists: (row_id, value).

    Members have one global order, by the number of neighbourhoods they are in. Two neighbourhoods with min_shared members
    in common have one in common that is none of the min_shared - 1 most frequent of either, so that only the others are
    joined: a hub that is in most neighbourhoods makes no pairs. Whole lists ride along, so that a pair is decided where
    it meets, and only at the rarest member it shares: pairs are not dealt out again, neither to meet the lists nor to
    be told apart."""
    own = staged(lists.select(F.col("row_id").alias("i"), F.array_union(F.array("row_id"), "value").alias("l")), "neighbourhoods")  # two parts of the plan read it
    members = own.select("i", F.explode("l").alias("m"))
    often = members.groupBy("m").agg(F.count("*").alias("often"))
    ordered = members.join(often, "m").groupBy("i").agg(F.sort_array(F.collect_list(F.struct("often", "m"))).alias("r")).select("i", F.col("r.m").alias("l"))
    rare = ordered.select("i", "l", F.explode(F.slice("l", 1, F.greatest(F.size("l") - max(min_shared - 1, 0), F.lit(0)))).alias("m"))
    x, y = rare.alias("x"), rare.alias("y")
    # both lists are in the global order, and so is what they share; exists() over one array has it made once a pair
    both = F.array_intersect("x.l", "y.l")
    here = F.exists(F.array(both), lambda c: (F.size(c) >= min_shared) & (c[0] == F.col("x.m")))
    met = x.join(y, (F.col("x.m") == F.col("y.m")) & (F.col("x.i") < F.col("y.i")) & here)
    one = met.select(F.col("x.i").alias("i"), F.col("y.i").alias("j"), F.size(both).alias("s"), (F.size("x.l") + F.size("y.l")).alias("all"))
    weight = (F.col("s") / (F.col("all") - F.col("s"))).cast("float").alias("weight")
    ways = F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    return one.select(F.explode(ways).alias("way"), weight).select("way.i", "way.j", "weight")


def neighbor_pairs(lists: DataFrame, distances: DataFrame, num_neighbors: int = 10) -> DataFrame:
    """(i, j, rank, scaled): of each cell's neighbours the num_neighbors nearest by squared distance over the product of
    both cells' scales. A cell's scale is the mean distance to its fourth to sixth neighbour, at least MIN_SCALE. Ties go
    by j. lists and distances: (row_id, value), nearest first, distances squared.

    Lists with fewer than six or num_neighbors entries, a cell among its own neighbours, and a neighbour that has no list
    raise ValueError."""
    both = lists.select(F.col("row_id").alias("i"), F.col("value").alias("l")).join(distances.select(F.col("row_id").alias("i"), F.col("value").cast("array<double>").alias("d")), "i")
    if not both.where((F.size("l") < max(6, num_neighbors)) | (F.size("l") != F.size("d"))).limit(1).isEmpty():
        raise ValueError(f"each cell needs {max(6, num_neighbors)} neighbours and their distances")
    scale = F.greatest((F.sqrt(F.col("d")[3]) + F.sqrt(F.col("d")[4]) + F.sqrt(F.col("d")[5])) / 3, F.lit(MIN_SCALE))
    own = both.select(F.col("i").alias("j"), scale.alias("sj"))
    each = both.select("i", scale.alias("si"), F.explode(F.arrays_zip("l", "d")).alias("e")).select("i", "si", F.col("e.l").alias("j"), F.col("e.d").alias("d"))
    each = each.join(own, "j", "left")
    if not each.where("i = j or sj is null").limit(1).isEmpty():
        raise ValueError("a cell is its own neighbour, or a neighbour has no list")
    w = Window.partitionBy("i").orderBy(F.col("d") / F.col("sj"), "j")
    ranked = each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= num_neighbors)
    return ranked.select("i", "j", "rank", (F.col("d") / (F.col("si") * F.col("sj"))).alias("scaled"))


def shared_neighbors(sc: SingleCell, neighbors_key: str = "neighbors", shared_neighbors_key: str = "shared_neighbors", min_shared_neighbors: int = 3) -> SingleCell:
    return replace(sc, obsp=sc.obsp | {shared_neighbors_key: shared(sc.obsm[neighbors_key], min_shared_neighbors)})


def votes(found: DataFrame, labels: DataFrame) -> DataFrame:
    """row_id, label, confidence, next_best, next_best_confidence by the labels of the neighbours; ties go to the label
    that more reference cells have, then to the name."""
    common = labels.groupBy("label").agg(F.count("*").alias("total"))
    counted = found.join(labels.select(F.col("row_id").alias("j"), "label"), "j").groupBy("i", "label").agg(F.count("*").alias("n")).join(common, "label")
    w = Window.partitionBy("i").orderBy(F.desc("n"), F.desc("total"), "label")
    ranked = counted.withColumns({"k": F.row_number().over(w), "all": F.sum("n").over(Window.partitionBy("i"))})
    pick = lambda k, c: F.max(F.when(F.col("k") == k, c))
    share = F.col("n") / F.col("all")
    return ranked.groupBy(F.col("i").alias("row_id")).agg(pick(1, F.col("label")).alias("label"), pick(1, share).alias("confidence"), pick(2, F.col("label")).alias("next_best"), pick(2, share).alias("next_best_confidence"))


def label_transfer_from(sc: SingleCell, other: SingleCell, label_column: str, new_column: str | None = None, num_neighbors: int = 20, Harmony_key: str = "harmony", next_best: bool = False, num_clusters: int | None = None, num_clusters_searched: int = 10, QC_column: str | None = "passed_QC", seed: int = 0, overwrite: bool = False) -> SingleCell:
    new = new_column or label_column
    if new in sc.obs.columns and not overwrite:
        raise ValueError(f"{new!r} is there already")
    pool = other.passing(QC_column)
    labels = pool.obs.where(F.col(label_column).isNotNull()).select("row_id", F.col(label_column).alias("label"))
    base = staged(other.obsm[Harmony_key].join(labels, "row_id", "left_semi"), "vectors")  # as in neighbors()
    n = base.count()
    m = min(int(math.sqrt(n)), MAX_CENTROIDS) if num_clusters is None else num_clusters
    c = kmeans(base, m, seed=seed)[0] if m > 1 else None
    got = votes(nearest(sc.obsm[Harmony_key].join(sc.passing(QC_column).obs.select("row_id"), "row_id", "left_semi"), base, num_neighbors, c, num_clusters_searched), labels)
    names = {"label": new, "confidence": f"{new}_confidence"} | ({"next_best": f"next_best_{new}", "next_best_confidence": f"next_best_{new}_confidence"} if next_best else {})
    got = got.select("row_id", *(F.col(a).alias(b) for a, b in names.items()))
    return replace(sc, obs=sc.obs.drop(*names.values()).join(got, "row_id", "left"))


for _name, _f in {"neighbors": neighbors, "shared_neighbors": shared_neighbors, "label_transfer_from": label_transfer_from}.items():
    setattr(SingleCell, _name, _f)
