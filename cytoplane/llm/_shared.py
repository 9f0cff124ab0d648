"""What several operators share: the shared folder, staged tables, Arrow helpers and the packed repeated-key search."""

from __future__ import annotations

import ctypes
import itertools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local runs without it, an own folder."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if sc.master.startswith("local-cluster") or not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = _OWN.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="cytoplane-"))
    return f"{found.rstrip('/')}/{sc.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage, so a lost executor costs no more
    than the tasks at hand. The shuffle files of the writing query are freed when it ends."""
    spark = df.sparkSession
    path, before = new_path(spark, label), spark.conf.get(_FREE, "false")
    spark.conf.set(_FREE, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_FREE, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Deletes the files of a staged table that no later plan reads."""
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if folder.startswith("file:") or "://" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


BATCH_BYTES = 32 << 20


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python so many rows and bytes at a time at most (a longer text alone). Plans read these settings
    when they run, so they stay; lower ones of the session are kept."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def release() -> None:
    """Gives freed memory back to the system. Python workers stay between stages, and would hold it beside the JVM's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library that Linux executors have
    if trim:
        trim(0)


def released(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work, after which freed memory goes back to the system."""

    def then(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        release()

    return then


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, end to end, and the n + 1 offsets of its rows; null counts as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    col = col.cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]] if len(col) and col.buffers()[2] is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    off = off - off[0]
    if col.null_count:
        size = np.diff(off)
        size[np.asarray(col.is_null())] = 0
        keep = np.repeat(~np.asarray(col.is_null()), np.diff(off))
        raw, off = raw[keep], np.concatenate([[0], np.cumsum(size)])
    return raw, off


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


# ---------------------------------------------------------------------------------------------------------------
# Which 64-bit keys occur in two documents or more?
#
# A key may occur in a third of all documents, so keys are combined before they are shuffled. A mapper fills a block
# with the keys of a bounded number of documents. Rows of keys that two documents of the block share need no further
# test and go on at once; of these keys one mark, and of the others their row, go as packed arrays to the bucket of
# the key. A bucket thus sees a key once a block, however frequent it is.

BLOCK_KEYS = 1_500_000
PACKED = "bucket int, kind int, keys binary, at binary, docs binary, extra binary"


class KeyBlock:
    """Gathers (key, document, small number) until flush(); rows of one document have distinct keys."""

    def __init__(self, buckets: int):
        self.buckets, self.n = buckets, 0
        self.keys: list[np.ndarray] = []
        self.docs: list[int] = []
        self.aux: list[int] = []
        self.size: list[int] = []
        self.more: list[np.ndarray] = []

    def add(self, doc: int, keys: np.ndarray, aux: int = 0, more: np.ndarray | None = None) -> None:
        self.keys.append(keys)
        self.docs.append(doc)
        self.aux.append(aux)
        self.size.append(len(keys))
        self.more.append(more if more is not None else np.zeros(len(keys), np.uint8))
        self.n += len(keys)

    def full(self) -> bool:
        return self.n >= BLOCK_KEYS or len(self.docs) >= 60_000

    def flush(self) -> Iterator[tuple[int, int, bytes, bytes, bytes, bytes]]:
        """Rows of PACKED. kind 0: rows of shared keys; kind 1: rows of keys seen once here; kind 2: marks."""
        if self.n:
            keys = np.concatenate(self.keys)
            at = np.repeat(np.arange(len(self.docs), dtype=np.uint16), self.size)
            more = np.concatenate(self.more)
            docs = np.stack([np.array(self.docs, np.int64), np.array(self.aux, np.int64)])
            order = np.argsort(keys, kind="stable")
            keys, at, more = keys[order], at[order], more[order]
            first = np.concatenate([[True], keys[1:] != keys[:-1]])
            last = np.concatenate([first[1:], [True]])
            once = first & last
            edges = np.searchsorted(keys, bucket_edges(self.buckets))
            for b in range(self.buckets):
                part = slice(edges[b], edges[b + 1])
                if edges[b] == edges[b + 1]:
                    continue
                for kind, mask in ((0, ~once[part]), (1, once[part]), (2, first[part] & ~once[part])):
                    if mask.any():
                        used, local = np.unique(at[part][mask], return_inverse=True)
                        yield b, kind, keys[part][mask].tobytes(), local.astype(np.uint16).tobytes() if kind < 2 else b"", docs[:, used].tobytes() if kind < 2 else b"", more[part][mask].tobytes() if kind < 2 else b""
        self.__init__(self.buckets)


def bucket_edges(buckets: int) -> np.ndarray:
    return np.array([(i << 64) // buckets for i in range(buckets)] + [2**64 - 1], np.uint64)


def packed_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """PACKED rows as Arrow batches of a few MB."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row[2:])
        if size > 8_000_000:
            yield _packed(held)
            held, size = [], 0
    if held:
        yield _packed(held)


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["bucket", "kind", "keys", "at", "docs", "extra"])


SHARED = "key long, doc_id long, aux long, more int"


def shared_rows(packed: DataFrame, within: tuple[int, int] | None = None) -> DataFrame:
    """From PACKED rows of kinds 0 to 2: (key, doc_id, aux, more) of every key that is in two documents or more; with
    within = (p, q), only rows whose aux is at most p / q times, and at least q / p times, that of another row of the key."""

    def work(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        got = {c: table.column(c).to_pylist() for c in ("keys", "at", "docs", "extra")}
        seen = [np.frombuffer(k, np.uint64) for k in got["keys"]]
        counted = [seen[i] for i in range(len(kind)) if kind[i] in (1, 2)]
        shared = np.zeros(0, np.uint64)
        if counted:
            alls = np.sort(np.concatenate(counted))
            shared = np.unique(alls[1:][alls[1:] == alls[:-1]])
        out: list[list[np.ndarray]] = [[], [], [], []]
        for i in range(len(kind)):
            if kind[i] > 1:
                continue
            keys, at, docs = seen[i], np.frombuffer(got["at"][i], np.uint16), np.frombuffer(got["docs"][i], np.int64).reshape(2, -1)
            more = np.frombuffer(got["extra"][i], np.uint8)
            if kind[i] == 1:
                if not len(shared):
                    continue
                place = np.minimum(np.searchsorted(shared, keys), len(shared) - 1)
                hit = shared[place] == keys
                keys, at, more = keys[hit], at[hit], more[hit]
            for x, y in zip(out, (keys.view(np.int64), docs[0][at], docs[1][at], more.astype(np.int32))):
                x.append(y)
        cols = [np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, (np.int64, np.int64, np.int64, np.int32))]
        if within and len(cols[0]):
            order = np.lexsort((cols[2], cols[0]))
            key, aux = cols[0][order], cols[2][order]
            near = (key[1:] == key[:-1]) & (within[1] * aux[1:] <= within[0] * aux[:-1])
            keep = np.sort(order[np.append(near, False) | np.insert(near, 0, False)])
            cols = [c[keep] for c in cols]
        return pa.table(dict(zip(("key", "doc_id", "aux", "more"), cols)))

    return packed.groupBy("bucket").applyInArrow(work, SHARED)


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """(id, component) of every id in the undirected edges (a, b); component: the smallest id that links reach.

    Alternates large-star and small-star steps: each step joins a node's neighbours to the smallest of them, and pairs
    are combined before each shuffle. Each round is a table in the shared folder; nothing of it reaches the driver but
    two sums that tell when it stands still."""
    cur = staged(edges.where("a <> b").select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).distinct(), f"{label}-0")
    before = None
    for k in itertools.count(1):
        both = cur.select("a", "b").union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").select("b", "m", "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        nxt = staged(small, f"{label}-{k}")
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_staged(cur)
        cur = nxt
        if now == before:
            break
        before = now
    return cur.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component").union(cur.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def bounded_sample(df: DataFrame, most: int, *by: str) -> DataFrame:
    """At most `most` rows, picked by a hash of the columns by; what is moved for it is a small multiple of the bound."""
    total = df.select(*by).count()
    h = F.xxhash64(*by, F.lit(11))
    if total > 2 * most:
        df = df.where(F.pmod(h, F.lit(1 << 40)) < int((1 << 40) * min(1.0, (most + 5 * most**0.5 + 10) / total)))
    return df.orderBy(h, *by).limit(most)


def stratified_sample(df: DataFrame, most: int, stratum: str, *by: str) -> DataFrame:
    """About `most` rows at most, as many of each value of stratum where there are so many, picked by a hash of the columns
    by, so that a rare value is there as well. Of more than `most` values the most frequent count; so many counts come to
    the driver at most."""
    totals = {r[0]: r[1] for r in df.groupBy(stratum).count().orderBy(F.desc("count"), stratum).limit(most).collect()}
    if not totals:
        return df
    each = max(1, most // len(totals))
    h = F.xxhash64(*by, F.lit(11))
    chance = F.create_map(*(F.lit(x) for k, n in totals.items() for x in (k, int((1 << 40) * min(1.0, (each + 5 * each**0.5 + 10) / n)))))
    near = df.where(F.pmod(h, F.lit(1 << 40)) < chance[F.col(stratum)])  # null, and so false, for values that are left out
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(h, *by))
    return near.withColumn("_rank", rank).where(F.col("_rank") <= each).drop("_rank")
