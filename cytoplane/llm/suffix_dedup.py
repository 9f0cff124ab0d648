"""Operator 2: removal of repeated byte strings by suffix sorting, a bucket of suffixes at a time.

Each byte that a 50-byte string covers which also starts in a document with a smaller doc_id is removed; strings are
judged on the input, and never cross documents.

1. Every 50-byte string has an anchor, the 16-byte string in it of least hash; equal strings have equal anchors. The
   packed search of _shared finds the anchors that two documents have: only strings around these can repeat.
2. The stretches of strings with such an anchor are cut out as segments. Equal segments are one row with the smallest
   and the largest of their documents, combined before they are shuffled.
3. Segments meet in the bucket of their anchor; the number of buckets follows the number of segments. A bucket's text is
   sorted block by block: a difference-cover sample of its suffixes (three residues of seven) is ranked first, by prefix
   doubling over the cover; then the suffixes of the block fall into groups by their first 8 bytes, and ties, however
   long, are decided by the ranks of the next two sample suffixes that stand at one distance. Neighbours in this order
   with 50 equal bytes are one string, and the least document of its suffixes is its first. A task holds one bucket.
4. An anchor with very many distinct segments (the ragged edges of a passage that a third of all documents share) is
   dealt to many buckets: each string has 16 more bytes in common with its equals, either before or behind the anchor,
   and is sorted in their bucket. If even there more segments meet than a task should take, they are dealt by their
   strings, combined before the shuffle.

Whole copies of a document are found by their digest and need no search: they lose all, if they have 50 bytes.

Null text counts as empty; texts under 50 bytes stay; a row with a null doc_id neither loses nor removes anything, and the
id stays null; rows that share a doc_id, with equal or other texts, do not remove from one another; an empty table gives
no rows; columns other than doc_id and text are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import PACKED, KeyBlock, drop_staged, mix64, packed_batches, partitions, released, shared_rows, small_batches, staged, texts_of
from .shingle_join import chunks

LENGTH, ANCHOR = 50, 16
WINDOWS = LENGTH - ANCHOR + 1
#: An anchor with more segments than CROWD is dealt to buckets of 16 more bytes; of those with more than LARGE, each
#: string is a bucket.
CROWD, LARGE = 2000, 20_000
MORE = 16
#: Bytes of a bucket, at most a few times this.
BUCKET_BYTES = 32 << 20
#: Suffixes sorted at a time.
BLOCK = 40_000
PERIOD, COVER = 7, (0, 1, 3)
#: Places in a text take so many bits.
NTH = 40
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def words_at(raw: np.ndarray, order: str, extra: int) -> np.ndarray:
    """The 8 bytes from every position, as numbers; zeros follow the end."""
    padded = np.concatenate([raw, np.zeros(extra + 8, np.uint8)])
    return np.ndarray((len(raw) + extra,), f"{order}u8", padded.data, strides=(1,)).astype(np.uint64)


def stretches(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of 50-byte strings with one anchor: document, first start, number of starts, anchor's hash (even), and how far
    behind the first start the anchor stands."""
    none = np.zeros(0, np.int64)
    n = len(raw)
    fits = np.diff(off) >= LENGTH
    if n < LENGTH or not fits.any():
        return none, none, none, np.zeros(0, np.uint64), none
    u = words_at(raw, "<", 16)
    h = mix64(u[:n] * np.uint64(0x9E3779B97F4A7C15) + mix64(u[8 : n + 8]))
    bits = np.uint64(max(20, int(n).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    least, width = (h & ~low) | np.arange(n, dtype=np.uint64), 1
    while 2 * width <= WINDOWS:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    if width < WINDOWS:
        least = np.minimum(least[: len(least) - (WINDOWS - width)], least[WINDOWS - width :])
    step = np.zeros(n + 1, np.int8)
    step[off[:-1][fits]] = 1
    step[off[1:][fits] - (LENGTH - 1)] -= 1
    at = np.flatnonzero(np.cumsum(step[:n], dtype=np.int8))
    anchor = (least[at] & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (np.diff(at) > 1)]))
    size = np.diff(np.append(first, len(at)))
    doc = np.searchsorted(off, at[first], side="right") - 1
    return doc, at[first], size, h[anchor[first]] & ~np.uint64(1), anchor[first] - at[first]


def _blocks(batch: pa.RecordBatch, name: str = "text"):
    raw, off = texts_of(batch, name)
    for lo, hi in chunks(off):
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]


def _buckets(spark: SparkSession, size: int) -> int:
    return max(4 * partitions(spark), size // BUCKET_BYTES)


def _anchors(docs: DataFrame, size: int) -> DataFrame:
    """PACKED rows of the distinct anchors of each document, with nth; copies in a block are one, under the least doc_id."""
    buckets = _buckets(docs.sparkSession, size // 2)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        block, seen = KeyBlock(buckets), {}
        for b in batches:
            ids, nth = np.asarray(b.column(0)), np.asarray(b.column(2))
            for lo, hi, raw, off in _blocks(b):
                doc, _, _, key, _ = stretches(raw, off)
                cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                for k in range(hi - lo):
                    if cut[k] == cut[k + 1]:
                        continue
                    digest = hashlib.blake2b(raw[off[k] : off[k + 1]].data, digest_size=16).digest()
                    if digest in seen:
                        at = seen[digest]
                        block.docs[at], block.aux[at] = min((block.docs[at], block.aux[at]), (int(ids[lo + k]), int(nth[lo + k])))
                        continue
                    seen[digest] = len(block.docs)
                    block.add(int(ids[lo + k]), np.unique(key[cut[k] : cut[k + 1]]), int(nth[lo + k]))
                if block.full():
                    yield from block.flush()
                    seen.clear()
        yield from block.flush()

    return docs.mapInArrow(released(lambda it: packed_batches(rows(it))), PACKED)


def _segments(docs: DataFrame) -> DataFrame:
    """Of documents with the list of their shared anchors: key, h (of the segment), doc_id, at, rel (how far into the
    segment its anchor stands), segment. at has nth in its upper bits."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, nth, lists = np.asarray(b.column(0)), np.asarray(b.column(3)), b.column(2)
            flat, cuts = np.asarray(lists.flatten()).view(np.uint64), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            for lo, hi, raw, off in _blocks(b):
                doc, first, size, key, rel = stretches(raw, off)
                keep = np.zeros(len(doc), bool)
                edges = np.searchsorted(doc, np.arange(hi - lo + 1))
                for k in range(hi - lo):
                    have, part = flat[cuts[lo + k] : cuts[lo + k + 1]], slice(edges[k], edges[k + 1])
                    if len(have) and edges[k] < edges[k + 1]:
                        have = np.sort(have)
                        keep[part] = have[np.minimum(np.searchsorted(have, key[part]), len(have) - 1)] == key[part]
                doc, first, size, key, rel = doc[keep], first[keep], size[keep], key[keep], rel[keep]
                if not len(doc):
                    continue
                length = size + LENGTH - 1
                ends = np.cumsum(length)
                body = raw[np.repeat(first - (ends - length), length) + np.arange(ends[-1])]
                inside = np.arange(ends[-1]) - np.repeat(ends - length, length)
                # a polynomial of the bytes, scattered; with the anchor's hash 127 bits name a segment
                power = np.full(int(length.max()), 0xD6E8FEB86659FD93, np.uint64)
                power[0] = 1
                power = np.cumprod(power, dtype=np.uint64)
                h = mix64(np.add.reduceat(mix64(body.astype(np.uint64) + np.uint64(1)) * power[inside], ends - length) + size.astype(np.uint64))
                text = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(np.append(0, ends).astype(np.int32).tobytes()), pa.py_buffer(body.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(h.view(np.int64)), pa.array(ids[lo + doc]), pa.array((first - off[doc]) | nth[lo + doc] << NTH), pa.array(rel.astype(np.int32)), text], names=["key", "h", "doc_id", "at", "rel", "segment"])

    return docs.mapInArrow(released(work), "key long, h long, doc_id long, at long, rel int, segment binary")


# ---------------------------------------------------------------------------------------------------------------
# Suffix sorting with a difference cover

_DELTA = np.array([[next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)])


def cover_ranks(raw: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """For positions of the cover, the rank of their suffix by its first `depth` bytes or more; elsewhere 0."""
    n = len(raw)
    sample = np.flatnonzero(np.isin(np.arange(n) % PERIOD, COVER))
    rank = np.zeros(len(words) + 8 * PERIOD, np.int64)
    values, order = np.unique(words[sample] >> np.uint64(8), return_inverse=True)
    rank[sample] = order + 1
    known = PERIOD
    while known < depth and len(values) < len(sample):
        values, order = np.unique(rank[sample] * (len(values) + 2) + rank[sample + known], return_inverse=True)
        rank[sample] = order + 1
        known *= 2
    return rank


def sorted_suffixes(raw: np.ndarray, starts: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """starts in the order of their suffixes, and for each whether its first `depth` bytes equal those before it.
    Suffixes with equal first `depth` bytes may stand in any order."""
    words = words_at(raw, ">", 72)
    rank = cover_ranks(raw, words, depth)
    most = int(rank.max()) + 2
    values, bucket, count = np.unique(words[starts], return_inverse=True, return_counts=True)
    place = (np.cumsum(count) - count)[bucket]
    tied = np.flatnonzero(count[bucket] > 1)
    residue = starts[tied] % PERIOD
    # the buckets of tied suffixes anew, so that a bucket and a rank fit one number
    group = np.unique(bucket[tied], return_inverse=True)[1].astype(np.int64) * most
    own = []
    for a in range(PERIOD):
        e = tied_a = np.flatnonzero(residue == a)
        if len(e):
            e = tied_a[np.argsort(group[tied_a] + rank[starts[tied[tied_a]] + _DELTA[a, a]], kind="stable")]
        own.append(e)
    less = np.zeros(len(tied), np.int64)
    begin = np.zeros(len(tied), np.int64)
    for a in range(PERIOD):
        if not len(own[a]):
            continue
        for b in range(PERIOD):
            if len(own[b]):
                d = _DELTA[a, b]
                theirs = group[own[b]] + rank[starts[tied[own[b]]] + d]
                mine = group[own[a]] + rank[starts[tied[own[a]]] + d]
                less[own[a]] += np.searchsorted(theirs, mine)
                begin[own[a]] += np.searchsorted(theirs, group[own[a]])
    place[tied] += less - begin
    order = np.argsort(place, kind="stable")
    out = starts[order]
    same = np.zeros(len(out), bool)
    same[1:] = True
    for k in (*range(0, depth - 7, 8), depth - 8):
        w = words[out + k]
        same[1:] &= w[1:] == w[:-1]
    return out, same


def first_documents(segments: pa.Array, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each start of each segment, end to end, the least document that has its 50-byte string in one of these
    segments; and the number of the start's segment."""
    off = np.asarray(segments.offsets).astype(np.int64) if hasattr(segments, "offsets") else np.frombuffer(segments.buffers()[1], np.int32)[segments.offset : segments.offset + len(segments) + 1].astype(np.int64)
    raw = np.frombuffer(segments.buffers()[2], np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    size = np.diff(off) - LENGTH + 1
    of = np.repeat(np.arange(len(segments)), size)
    total = np.cumsum(size)
    starts = np.arange(total[-1]) + np.repeat(off[:-1] - (total - size), size)
    order, same = sorted_suffixes(raw, starts)
    slot = np.empty(len(raw), np.int64)
    slot[starts] = np.arange(len(starts))
    i = slot[order]
    edge = np.flatnonzero(~same)
    out = np.empty(len(starts), np.int64)
    out[i] = np.repeat(np.minimum.reduceat(low[of[i]], edge), np.diff(np.append(edge, len(i))))
    return out, of


MARKS = "key long, h long, skip int, many int, first long"


def _marks(segments: DataFrame, buckets: int) -> DataFrame:
    """Stretches of starts of each segment and the first document of their strings, where that is before the segment's
    last document."""

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("key").combine_chunks()
        key, h, low, high = (np.asarray(table.column(c)) for c in ("key", "h", "low", "high"))
        texts = table.column("segment").combine_chunks() if len(key) else pa.array([], pa.binary())
        texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        begins = np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key)) if len(key) else np.zeros(1, np.int64)
        lo = 0
        while lo < len(key):
            # whole anchors up to the block's size
            hi = int(begins[min(max(np.searchsorted(begins, lo + BLOCK // WINDOWS, side="right") - 1, np.searchsorted(begins, lo, side="right")), len(begins) - 1)])
            first, of = first_documents(texts[lo:hi], low[lo:hi])
            edge = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (of[1:] != of[:-1])]))
            many = np.diff(np.append(edge, len(first)))
            begin = np.searchsorted(of, np.arange(hi - lo))
            skip = edge - begin[of[edge]]
            wanted = first[edge] < high[lo + of[edge]]
            for x, y in zip(out, (key[lo + of[edge]], h[lo + of[edge]], skip, many, first[edge])):
                x.append(y[wanted])
            lo = hi
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
        return pa.table([pa.array(np.concatenate(x) if x else [], t) for x, t in zip(out, kinds)], names=["key", "h", "skip", "many", "first"])

    segments = segments.select("key", "h", "low", "high", "segment")
    return segments.withColumn("bucket", F.pmod(F.shiftright("key", 5), F.lit(buckets)).cast("int")).groupBy("bucket").applyInArrow(work, MARKS)


def _string_marks(segments: DataFrame) -> DataFrame:
    """MARKS of segments, each string by itself."""
    each = segments.select("key", "h", "low", "high", F.explode(F.sequence(F.lit(0), F.length("segment") - LENGTH)).alias("skip"), "segment").withColumn("string", F.expr(f"substring(segment, skip + 1, {LENGTH})")).drop("segment")
    least = each.groupBy("string").agg(F.min("low").alias("first"))
    return each.join(least.hint("merge"), "string").where("first < high").select("key", "h", F.col("skip").cast("int").alias("skip"), F.lit(1).alias("many"), "first")


def _parted(segments: DataFrame) -> DataFrame:
    """Segments of crowded anchors in two parts: the strings with MORE bytes or a little over before the anchor, and the
    others, which have as many behind it. key2 names the anchor with those bytes; skip0 is where the part begins."""
    half = MORE + 2
    size, rel = F.length("segment") - LENGTH + 1, F.col("rel")
    begin = F.greatest(rel - half + 1, F.lit(0))
    before = F.struct(F.lit(0).alias("side"), F.lit(0).alias("skip0"), F.least(size, begin).alias("many"), (rel - MORE).alias("near"))
    behind = F.struct(F.lit(1).alias("side"), begin.alias("skip0"), (size - begin).alias("many"), (rel + ANCHOR).alias("near"))
    each = segments.withColumn("part", F.explode(F.array(before, behind))).where("part.many > 0").select("key", "h", "low", "high", "part.skip0", F.expr(f"substring(segment, part.near + 1, {MORE})").alias("near"), "part.side", F.expr(f"substring(segment, part.skip0 + 1, part.many + {LENGTH - 1})").alias("segment"))
    return each.withColumn("key2", F.xxhash64("key", "side", "near")).withColumn("h2", F.xxhash64(F.lit(5), "segment")).drop("near", "side")


def _crowded_marks(segments: DataFrame, buckets: int) -> DataFrame:
    """MARKS of segments of crowded anchors, sorted in the buckets of their parts."""
    parts = staged(_parted(segments), "parts")
    distinct = parts.groupBy(F.col("key2").alias("key"), F.col("h2").alias("h")).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.first("segment").alias("segment"))
    distinct = staged(distinct, "distinct-parts")
    plain, large = _by_number(distinct, LARGE, "large")
    marks = staged(_marks(plain, buckets).unionByName(_string_marks(large)), "part-marks")
    marks = marks.select(F.col("key").alias("key2"), F.col("h").alias("h2"), "skip", "many", "first")
    return parts.select("key", "h", "key2", "h2", "skip0").join(marks.hint("merge"), ["key2", "h2"]).select("key", "h", (F.col("skip") + F.col("skip0")).cast("int").alias("skip"), "many", "first")


def _by_number(segments: DataFrame, most: int, label: str) -> tuple[DataFrame, DataFrame]:
    """Segments of the anchors with at most so many, and of the others."""
    crowded = staged(segments.groupBy("key").count().where(F.col("count") > most).select("key"), label)
    # numbers only, one for each `most` segments at most: broadcast where they are few, joined by sorting beyond that
    how = "broadcast" if crowded.count() <= 100_000 else "merge"
    return segments.join(crowded.hint(how), "key", "left_anti"), segments.join(crowded.hint(how), "key", "left_semi")


def deduplicate(docs: DataFrame, keep: str | None = "bytes", carry: tuple[str, ...] = ()) -> DataFrame:
    """RESULT of every document; kept has the bytes that stay, or with keep = "text" the whole characters
    among them, or null without keep. Columns to carry along stand in the struct `row`."""
    spark = docs.sparkSession
    small_batches(spark)
    row = F.struct(F.lit(True).alias("_row"), *carry).alias("row")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), row)
    docs = rows.where("doc_id is not null").select("doc_id", "text")
    digest = F.sha2(F.col("text").cast("binary"), 256)
    named = staged(docs.select("doc_id", F.octet_length("text").cast("long").alias("n"), digest.alias("digest")), "digests")
    size = named.agg(F.sum("n")).first()[0] or 0
    # where a doc_id has several texts, nth numbers them; elsewhere it is 0
    several = named.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x < y").select("doc_id")
    rank = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("digest"))
    several = staged(named.join(several.hint("merge"), "doc_id", "left_semi").select("doc_id", "digest").distinct().withColumn("nth", rank.cast("long")), "several")
    few = several.count()

    def numbered(t: DataFrame, digest=digest) -> DataFrame:
        if not few:
            return t.withColumn("nth", F.lit(0).cast("long"))
        with_digest = t.withColumn("_digest", digest)
        return with_digest.join(several.withColumnRenamed("digest", "_digest").hint("broadcast" if few <= 100_000 else "merge"), ["doc_id", "_digest"], "left").drop("_digest").withColumn("nth", F.coalesce("nth", F.lit(0)))

    docs = numbered(docs)
    first = named.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    copies = numbered(named.where(f"n >= {LENGTH}").join(first.hint("merge"), "digest").where("rep < doc_id"), F.col("digest")).select("doc_id", "nth").distinct()
    copies = staged(copies, "copies")

    shared = shared_rows(_anchors(docs.select("doc_id", "text", "nth"), size)).groupBy("doc_id", F.col("aux").alias("nth")).agg(F.collect_list("key").alias("keys"))
    wanted = staged(shared.join(copies.hint("merge"), ["doc_id", "nth"], "left_anti"), "wanted")
    found = staged(_segments(docs.join(wanted.hint("merge"), ["doc_id", "nth"]).select("doc_id", "text", "keys", "nth")), "segments")
    distinct = staged(found.groupBy("key", "h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.first("rel").alias("rel"), F.first("segment").alias("segment")), "distinct")
    drop_staged(wanted)
    buckets = _buckets(spark, 2 * LENGTH * distinct.count())
    few_segments, crowd = _by_number(distinct, CROWD, "crowded")
    marks = staged(_marks(few_segments, buckets), "plain-marks").unionByName(_crowded_marks(crowd, buckets))
    cover = found.select("key", "h", "doc_id", "at").join(marks.hint("merge"), ["key", "h"]).where("first < doc_id").select("doc_id", F.shiftright("at", NTH).alias("nth"), F.struct((F.col("at").bitwiseAND((1 << NTH) - 1) + F.col("skip")).alias("at"), F.col("many")).alias("s"))
    cover = staged(cover.groupBy("doc_id", "nth").agg(F.collect_list("s.at").alias("at"), F.collect_list("s.many").alias("many")), "cover")
    drop_staged(found)
    drop_staged(distinct)
    joined = numbered(rows).join(cover.hint("merge"), ["doc_id", "nth"], "left").join(copies.withColumn("copy", F.lit(True)).hint("merge"), ["doc_id", "nth"], "left").select("doc_id", "text", "at", "many", F.coalesce("copy", F.lit(False)).alias("copy"), "row")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, many, copy = b.column(2), b.column(3), np.asarray(b.column(4))
            for lo, hi, raw, off in _blocks(b):
                rows = []
                for k in range(lo, hi):
                    body = raw[off[k - lo] : off[k - lo + 1]]
                    gone = np.zeros(len(body), bool)
                    if copy[k]:
                        gone[:] = True
                    elif at[k].is_valid:
                        a = np.asarray(at[k].values)
                        step = np.zeros(len(body) + 1, np.int64)
                        np.add.at(step, a, 1)
                        np.add.at(step, a + np.asarray(many[k].values) + LENGTH - 1, -1)
                        gone = np.cumsum(step[:-1]) > 0
                    kept = body[~gone].tobytes()
                    rows.append((len(body), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if keep == "text" else kept if keep else None))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string() if keep == "text" else pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], *(pa.array(c, t) for c, t in zip(zip(*rows), kinds)), b.column(5)[lo:hi]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "row"])

    kinds = T.StructType([*T._parse_datatype_string(RESULT.replace("kept binary", "kept string") if keep == "text" else RESULT).fields, *joined.select("row").schema.fields])
    return joined.mapInArrow(released(work), kinds)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=None).drop("kept", "row")
