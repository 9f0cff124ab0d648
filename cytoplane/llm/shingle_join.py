"""Operator 8: exact Jaccard join of word shingles, and the groups its links form.

Two documents link when 100 * intersection >= 75 * union of their sets of five-word shingles. Sets are of 64-bit
hashes; equal sets are one node from the start, however many copies there are.

1. Candidates. Shingles have one global order, in which the most frequent (a list of bounded size, counted over all
   documents) come last, so that boilerplate is rarely looked at. A set of n shingles can only link with one that has
   one of its first n - ceil(3n/4) + 1 shingles among its own such (the first n - ceil(6n/7) + 1 for the smaller of
   the two). The packed search of _shared finds the shingles that two documents of near sizes have there.
2. Tiles. A tile is one such shingle and one band of sizes; bands are a little wider than 4/3, the widest ratio of sizes
   that can link. A set is in the tile of its own band and, where it may be the smaller one, in that of the next band, so
   each pair of near sizes has one band to meet in. In a few rounds every set is tried against one leader of its tiles;
   then, in tiles whose members are not one component yet, pairs across components are tried. Two members of one
   component need no test, so a large group of near copies costs a few tests a member. Sets that share many tiles meet
   in the first of them only (as far as the lists of first tiles that they carry can tell).
3. Each set has a bitmap of 512 parities, and where that is not enough one of 8192. Two sets differ in at least as many
   shingles as their bitmaps in bits, which bounds the overlap from above; pairs that pass are decided by exact
   intersection of the sorted arrays.

No pair within the bound is lost: no cap on tiles, candidates or partners. Null text, empty text and text without words
has an empty set (n_shingles 0) and links with nothing; with one to four words the whole sequence is the one shingle.
A row with a null doc_id links with nothing, and its component_id is null. Rows that share a doc_id, with whatever
texts, are in one component; each returns its own n_shingles. An empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import PACKED, KeyBlock, components, drop_staged, mix64, packed_batches, partitions, released, shared_rows, small_batches, staged, texts_of

WORDS = 5
#: Leaders that a set is tried against in each round, before all pairs that are left.
STARS = (1, 3)
HOT = 1 << 16
BITS, BIG = 512, 8192
#: Ratio of the sizes of a band; a little over 4/3, so that rounding cannot part two sizes within 4/3 by two bands.
BAND = 1.34
#: First tiles that a set carries: as the smaller one of a pair, as the larger one.
FIRSTS = (4, 8)
#: Prefix shingles of a bucket of the packed search.
BUCKET = 4_000_000
#: Up to so many ids, 8 bytes each, are broadcast.
FEW = 100_000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def chunks(off: np.ndarray, most: int = 400_000) -> Iterator[tuple[int, int]]:
    """Stretches of rows of about `most` bytes; a longer row is a stretch of its own."""
    lo = 0
    while lo < len(off) - 1:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, side="right")) - 1)
        yield lo, hi
        lo = hi


def shingle_sets(raw: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    docs = len(off) - 1
    raw = _LOWER[raw]
    at = np.flatnonzero(~_SPACE[raw])
    empty = [np.zeros(0, np.uint64)] * docs
    if not len(at):
        return empty
    edge = np.zeros(len(raw) + 1, bool)
    edge[off[:-1][off[:-1] < len(raw)]] = True
    begins = edge[at]
    begins[0] = True
    begins[1:] |= np.diff(at) > 1
    first = np.flatnonzero(begins)
    word = np.cumsum(begins) - 1
    inside = at - at[first][word]
    power = np.full(int(inside.max()) + 1, _BASE, np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    h = mix64(np.add.reduceat(_BYTE[raw[at]] * power[inside], first))
    edges = np.searchsorted(at[first], off)
    n = np.diff(edges)
    s = h.copy()
    if len(h) >= WORDS:
        s = h[: len(h) - WORDS + 1].copy()
        for k in range(1, WORDS):
            s = s * _STEP + h[k : len(h) - WORDS + 1 + k]
        s = mix64(s)
    out = []
    for d in range(docs):
        a, b = edges[d], edges[d + 1]
        if n[d] >= WORDS:
            x = np.sort(s[a : b - WORDS + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif n[d]:
            x = np.uint64(n[d])
            for w in h[a:b].tolist():
                x = np.uint64((int(x) * int(_STEP) + w) & (2**64 - 1))
            out.append(mix64(np.array([x], np.uint64)))
        else:
            out.append(empty[0])
    return out


def heavy_shingles(docs: DataFrame, block: int = 2_000_000, least: int = 6) -> tuple[np.ndarray, np.ndarray, int]:
    """The most frequent shingles, sorted, their place among them by frequency, and the sum of the sizes of all sets.
    The list only sets an order: which shingles it has changes what the join costs and not what it finds."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, total = [], 0, 0

        def counted() -> Iterator[pa.RecordBatch]:
            x = np.sort(np.concatenate(held))
            first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            n = np.diff(np.append(first, len(x)))
            often = n >= least
            yield pa.RecordBatch.from_arrays([pa.array(x[first[often]].view(np.int64)), pa.array(n[often].astype(np.int64))], names=["h", "n"])

        for b in batches:
            raw, off = texts_of(b)
            for lo, hi in chunks(off):
                got = shingle_sets(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                held += got
                size += (more := sum(map(len, got)))
                total += more
                if size >= block:
                    yield from counted()
                    held, size = [], 0
        if size:
            yield from counted()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total], pa.int64())], names=["h", "n"])

    # the sum of all sizes stands first: none is greater, and its h is null
    got = docs.select("text").mapInArrow(released(work), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(HOT + 1).collect()
    h = np.array([r["h"] for r in got[1:]], np.int64).view(np.uint64)
    rank = np.arange(len(h), 0, -1)
    order = np.argsort(h)
    return h[order], rank[order], got[0]["n"] if got else 0


def prefix(s: np.ndarray, hot: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles to look at, and which of them also count where this set is the smaller one."""
    n = len(s)
    if len(hot):
        place = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
        hit = hot[place] == s
        if hit.any():
            s = s[np.lexsort((s, np.where(hit, rank[place], 0)))]
    s = s[: n - (3 * n + 3) // 4 + 1]
    return s, (np.arange(len(s)) < n - (6 * n + 6) // 7 + 1).astype(np.uint8)


def bitmap(s: np.ndarray, size: int = BITS) -> np.ndarray:
    """The parities of the numbers of shingles that fall on each bit, as long values."""
    odd = np.bincount((s >> np.uint64(20)).astype(np.int64) % size, minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _packed(docs: DataFrame, hot: np.ndarray, rank: np.ndarray, total: int) -> DataFrame:
    """PACKED rows of the prefixes (kinds 0 to 2) and of every document's size and set hash (kind 3)."""
    buckets = max(4 * partitions(docs.sparkSession), total // (4 * BUCKET))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        block, seen = KeyBlock(buckets), {}
        for b in batches:
            raw, off = texts_of(b)
            ids = np.asarray(b.column(0))
            sig = np.zeros((4 + BITS // 64, b.num_rows), np.int64)
            sig[0] = ids
            for lo, hi in chunks(off):
                for k, s in enumerate(shingle_sets(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]), lo):
                    digest = xxhash.xxh3_128_digest(s.tobytes())
                    sig[1, k] = len(s)
                    sig[2:4, k] = np.frombuffer(digest, np.int64)
                    sig[4:, k] = bitmap(s)
                    if digest in seen:  # one row for a set, under its least doc_id
                        block.docs[seen[digest]] = min(block.docs[seen[digest]], int(ids[k]))
                    elif len(s):
                        seen[digest] = len(block.docs)
                        keys, index = prefix(s, hot, rank)
                        block.add(int(ids[k]), keys, len(s), index)
                if block.full():
                    yield from block.flush()
                    seen.clear()
            yield 0, 3, b"", b"", sig.tobytes(), b""
        yield from block.flush()

    return docs.mapInArrow(released(lambda it: packed_batches(rows(it))), PACKED)


_B = [f"b{k}" for k in range(BITS // 64)]


def _signatures(packed: DataFrame) -> DataFrame:
    """doc_id, n, h1, h2 (the set's hash) and b0 to b7 (its bitmap) of every document."""
    names = ["doc_id", "n", "h1", "h2", *_B]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays(list(map(pa.array, np.frombuffer(x, np.int64).reshape(len(names), -1))), names=names)

    return packed.where("kind = 3").select("docs").mapInArrow(work, ", ".join(f"{c} long" for c in names))


def _sets(docs: DataFrame) -> DataFrame:
    """(id, n, big, items) of documents: the sorted shingles and a bitmap of BIG parities."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = texts_of(b)
            for lo, hi in chunks(off):
                got = shingle_sets(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array([len(s) for s in got], pa.int64()), pa.array([bitmap(s, BIG).tobytes() for s in got], pa.binary()), pa.array([s.tobytes() for s in got], pa.binary())], names=["id", "n", "big", "items"])

    return docs.mapInArrow(released(work), "id long, n long, big binary, items binary")


def _bits_differ(x: str, y: str, bits: list[str]) -> Column:
    each = [F.bit_count(F.col(x + c).bitwiseXOR(F.col(y + c))) for c in bits]
    return sum(each[1:], each[0])


def _verified(pairs: DataFrame, bits: DataFrame, docs: DataFrame, label: str) -> DataFrame:
    """The pairs (a, b) that link: by bitmaps first; then by the arrays of the sets that are left, made anew."""
    spark = docs.sparkSession
    side = lambda x: bits.select(F.col("id").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("n", *_B)))
    small = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    near = staged(small.where((4 * F.least("a_n", "b_n") >= 3 * F.greatest("a_n", "b_n")) & (F.col("a_n") + F.col("b_n") >= 7 * _bits_differ("a_", "b_", _B))).select("a", "b"), f"{label}-near")
    ids = staged(near.select(F.col("a").alias("doc_id")).union(near.select(F.col("b").alias("doc_id"))).distinct(), f"{label}-ids")
    how = "broadcast" if ids.count() <= FEW else "merge"
    sets = staged(_sets(docs.join(ids.hint(how), "doc_id", "left_semi").select("doc_id", "text")), f"{label}-sets")

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            x, y = (np.stack([np.frombuffer(v.as_buffer(), np.uint64) for v in t.column(c)]) if t.num_rows else np.zeros((0, BIG // 64), np.uint64) for c in ("x", "y"))
            keep = pa.array(np.asarray(t.column("m")) >= 7 * np.bitwise_count(x ^ y).sum(1, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([t.column("a").filter(keep), t.column("b").filter(keep)], names=["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep = []
            for x, y in zip(t.column("x"), t.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                keep.append(100 * both >= 75 * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([t.column("a").filter(pa.array(keep, pa.bool_())), t.column("b").filter(pa.array(keep, pa.bool_()))], names=["a", "b"])

    def meet(pairs: DataFrame, sets: DataFrame, what: str) -> DataFrame:
        one = pairs.join(sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col(what).alias("y")).hint("merge"), "b")
        return one.join(sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col(what).alias("x")).hint("merge"), "a").select("a", "b", (F.col("na") + F.col("nb")).alias("m"), "x", "y")

    likely = staged(meet(near, sets, "big").mapInArrow(passes, "a long, b long"), f"{label}-likely")
    # whole sets go on only where a pair is left for them
    left = likely.select(F.col("a").alias("id")).union(likely.select(F.col("b").alias("id"))).distinct()
    both = meet(likely, sets.join(left.hint(how), "id", "left_semi"), "items")
    # a row has two whole sets: few at a time
    rows = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, "32")
    try:
        edges = staged(both.mapInArrow(work, "a long, b long"), f"{label}-edges")
    finally:
        spark.conf.set(_ROWS, rows)
    drop_staged(sets)
    drop_staged(near)
    return edges


def _sizes(docs: DataFrame) -> DataFrame:
    """n_shingles of each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = texts_of(b)
            for lo, hi in chunks(off):
                yield pa.RecordBatch.from_arrays([pa.array(list(map(len, shingle_sets(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]))), pa.int64())], names=["n_shingles"])

    return docs.select("text").mapInArrow(work, "n_shingles long")


def _tiles(rows: DataFrame) -> DataFrame:
    """Each set's rows (key, rep, n, small) by tile: (key, tile) with below for those of the band before."""
    band = F.floor(F.log("n") / math.log(BAND)).cast("int")
    return rows.withColumn("band", band).withColumn("tile", F.explode(F.when(F.col("small") == 1, F.array("band", F.col("band") + 1)).otherwise(F.array("band")))).withColumn("below", F.col("tile") > F.col("band")).drop("band")


def _mixed(left: DataFrame, leaders: list[Column]) -> DataFrame:
    """(key, tile, lead) of the tiles where sets of two components could be a pair."""
    lead = [F.min(F.when(~F.col("below"), x)) for x in leaders]
    found = left.groupBy("key", "tile").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.max("small").alias("s"), F.array(*lead).alias("lead"))
    return found.where("x < y and s = 1 and lead[0] is not null").select("key", "tile", "lead")


def _parted(left: DataFrame) -> DataFrame:
    """(key, tile, main) of the tiles where sets of two components could be a pair; main: the component of most sets."""
    each = left.groupBy("key", "tile", "component").agg(F.count("*").alias("m"), F.max("small").alias("s"), F.max(~F.col("below")).alias("own"))
    found = each.groupBy("key", "tile").agg(F.count("*").alias("c"), F.max("s").alias("s"), F.max("own").alias("own"), F.max(F.struct("m", "component")).alias("top"))
    return found.where("c > 1 and s = 1 and own").select("key", "tile", F.col("top.component").alias("main"))


def _across(left: DataFrame, bits: DataFrame, label: str) -> DataFrame:
    """Pairs (a, b) of sets of two components that a tile of left holds and that sizes and bitmaps let link. One of the two
    is not of the tile's main component, so that a large group of near copies never meets itself. A pair is made in its
    first tile, and in later ones only if the first tiles that the two carry do not show one they have in common."""
    some = lambda which, k: F.slice(F.sort_array(F.collect_set(F.when(which, F.col("key")))), 1, k)
    firsts = left.groupBy("rep", "tile").agg(some(F.col("small") == 1, FIRSTS[0]).alias("as_x"), some(~F.col("below"), FIRSTS[1]).alias("as_y"))
    told = firsts.join(bits.select(F.col("id").alias("rep"), *_B).hint("merge"), "rep")
    rows = staged(left.join(told.hint("merge"), ["rep", "tile"]), f"{label}-rows")
    may = (F.col("x.key") == F.col("y.key")) & (F.col("x.tile") == F.col("y.tile")) & (F.col("x.component") != F.col("y.component"))
    may &= (F.struct("x.n", "x.rep") < F.struct("y.n", "y.rep")) & (4 * F.col("x.n") >= 3 * F.col("y.n"))
    may &= F.col("x.n") + F.col("y.n") >= 7 * _bits_differ("x.", "y.", _B)
    may &= F.coalesce(F.array_min(F.array_intersect("as_x", "as_y")), F.col("x.key")) >= F.col("x.key")
    x, y = rows.where("small = 1").drop("as_y"), rows.where("not below").drop("as_x")
    met = [a.alias("x").join(b.alias("y").hint("merge"), may).select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")) for a, b in ((x.where("component <> main"), y), (x.where("component = main"), y.where("component <> main")))]
    return met[0].union(met[1]).distinct()


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    unnamed = _sizes(docs.where("doc_id is null")).select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id"))
    docs = docs.where("doc_id is not null")
    packed = staged(_packed(docs, *heavy_shingles(docs)), "prefixes")
    sig = staged(_signatures(packed), "signatures")
    first = sig.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"))
    named = staged(sig.select("doc_id", "n", "h1", "h2").join(first.hint("merge"), ["h1", "h2", "n"], "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")), "named")
    bits = sig.withColumnRenamed("doc_id", "id")
    found = shared_rows(packed.where("kind < 3"), within=(4, 3))
    # every set stands in some block under its least doc_id; its rows in other blocks add nothing
    rows = found.join(named.where("doc_id = rep").select("doc_id").hint("merge"), "doc_id", "left_semi")
    rows = staged(rows.select("key", F.col("doc_id").alias("rep"), F.col("aux").alias("n"), F.col("more").alias("small")), "rows")
    drop_staged(packed)

    left = _tiles(rows).withColumn("component", F.col("rep"))
    # rows that share a doc_id stay together: their sets' names are linked from the start
    one = named.groupBy("doc_id").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x < y").select("doc_id", F.col("x").alias("a"))
    bridges = named.join(one.hint("merge"), "doc_id").where("a < rep").select("a", F.col("rep").alias("b")).distinct()
    named = named.withColumnRenamed("rep", "component")
    # stars: every set is tried against a few leaders, each the one that it meets at most shingles; a tile's leaders are
    # the least by some hashes, so that all tiles of a group of near copies have the same. Then pairs across components.
    for step in range(len(STARS) + 1):
        last = step == len(STARS)
        lead = [F.struct(F.xxhash64("rep", F.lit(10 * step + k)).alias("h"), "rep", "n", "component") for k in range(0 if last else STARS[step])]
        mixed = left.join((_parted(left) if last else _mixed(left, lead)).hint("merge"), ["key", "tile"])
        if last:
            pairs = _across(staged(mixed, "mixed"), bits, "across")
        else:
            left = staged(mixed, f"mixed-{step}")
            each = left.select("rep", "n", "component", F.posexplode("lead").alias("way", "lead"))
            met = each.where("lead.component <> component and 4 * least(n, lead.n) >= 3 * greatest(n, lead.n)").groupBy("rep", "way", F.col("lead.rep").alias("leader")).agg(F.count("*").alias("k"))
            top = met.groupBy("rep", "way").agg(F.max(F.struct("k", "leader")).alias("m"))
            pairs = top.select(F.least("rep", "m.leader").alias("a"), F.greatest("rep", "m.leader").alias("b")).distinct()
            left = left.drop("lead")
        edges = _verified(staged(pairs, f"pairs-{step}"), bits, docs, f"round-{step}")
        # a link joins the components of its ends
        of = left.select("rep", "component").distinct()
        linked = edges.join(of.select(F.col("rep").alias("a"), F.col("component").alias("x")).hint("merge"), "a").join(of.select(F.col("rep").alias("b"), F.col("component").alias("y")).hint("merge"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        joined = staged(components(linked.union(bridges) if step == 0 else linked, f"cc-{step}"), f"top-{step}").select(F.col("id").alias("component"), F.col("component").alias("_top"))
        lift = lambda t, top=joined: t.join(top.hint("merge"), "component", "left").withColumn("component", F.coalesce("_top", "component")).drop("_top")
        named = staged(lift(named), f"named-{step}")
        if not last:
            before, left = left, staged(lift(left), f"left-{step}")
            drop_staged(before)
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id")).unionByName(unnamed)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
