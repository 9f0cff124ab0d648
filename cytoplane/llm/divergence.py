"""Operator 12: how far the sources of a language are apart in their words, by two-dimensional tiles of group blocks.

Terms are runs of letters and of characters beyond ASCII, A-Z lower-cased. A language keeps the V terms that at least
MIN_DOCS of its documents have. Each group (a language's source) and each language gives each kept term
p = 1 + floor(10^9 (count + 5) / (N + 5 V)), N being its count of all kept terms. Two groups are as far apart as the sum
of |p - q| over all kept terms. All arithmetic is in whole numbers.

1. Counting. Tasks count terms by group a few MB of text at a time; what they send is combined before it is shuffled by
   (language, source, term). A window by (language, term) counts documents, and terms that too few have go.
2. Vocabulary. A language's terms are dealt to chunks by hash, about CHUNK to each, and numbered within their chunk.
3. Packed vectors. A group has one row a chunk: places and counts of the terms it has there. Groups are dealt to blocks of
   about BLOCK.
4. Tiles. Each vector goes to every tile of its block with a block of the language, and to the tile's slab of SLAB chunks.
   A tile's task reads the chunks of its slab one after another: it unpacks the two blocks' vectors of the chunk, takes
   all distances between them, adds these to its submatrix, and forgets the chunk. What it holds is two blocks times one
   chunk, whatever the numbers of groups and terms are. Slabs of a pair are added up at the end.
5. Ranks. Other sources by distance, all of them; and by p - q the TOP terms that the group has and uses more than its
   language does. The second window is cut to TOP rows in each task before it is shuffled.

Null text, lang and source count as ''. A group without terms is there all the same. A language without kept terms has
distances of 0. Repeated rows are documents of their own; doc_id and other columns are ignored. An empty table gives no
rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import released, small_batches, staged
from .words import blocks, coded, runs, tallied

MIN_DOCS, TOP, SCALE, PRIOR = 30, 50, 1_000_000_000, 5
CHUNK, BLOCK, SLAB = 4096, 64, 8
_TERM = np.zeros(256, np.uint8)
_TERM[128:] = np.arange(128, 256)
_TERM[97:123] = np.arange(97, 123)
_TERM[65:91] = np.arange(97, 123)
KEY = ["lang", "source"]


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), d (documents), added up a few MB of text at a time: rows of one key recur."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for raw, off, (lang, source) in blocks(batches, *KEY):
            pairs = pa.StructArray.from_arrays([lang, source], names=KEY)
            names = list({(x["lang"], x["source"]): None for x in pairs.to_pylist()})
            number = {x: k for k, x in enumerate(names)}
            group = np.array([number[x["lang"], x["source"]] for x in pairs.to_pylist()], np.int64)
            letters, at, row = runs(_TERM[raw], off)
            terms, code = coded(letters, at, pa.large_string())
            if not len(terms):
                continue
            each, n = tallied(row * len(terms) + code)  # one for each document and term
            keys = group[each // len(terms)] * len(terms) + each % len(terms)
            found, total = tallied(keys, n)
            d = tallied(keys)[1]
            g = found // len(terms)
            cols = [pa.array([x[k] for x in names], pa.string()).take(pa.array(g)) for k in (0, 1)]
            table = pa.RecordBatch.from_arrays([*cols, terms.take(pa.array(found % len(terms))).cast(pa.string()), pa.array(total.astype(np.int64)), pa.array(d.astype(np.int64))], names=[*KEY, "term", "n", "d"])
            for k in range(0, table.num_rows, 50_000):
                yield table.slice(k, 50_000)

    return docs.mapInArrow(released(work), "lang string, source string, term string, n long, d long")


def share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE (count + PRIOR) / total) in whole numbers, three digits at a time, so that no step overflows."""
    part, rest = F.lit(0).cast("long"), count + PRIOR
    for _ in range(3):
        rest = rest * 1000
        part, rest = part * 1000 + F.call_function("div", rest, total), rest % total
    return part + 1


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The same of arrays."""
    part, rest = np.zeros(np.broadcast(count, total).shape, np.int64), count + PRIOR
    for _ in range(3):
        q, rest = np.divmod(rest * 1000, total)
        part = part * 1000 + q
    return part + 1


def _tile_sums(vectors: DataFrame) -> DataFrame:
    """lang, a, b, value: distances of the groups of two blocks over the chunks of a slab. vectors is sorted by tile and
    chunk within its partitions; each group of the tile has a row a chunk."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, chunk, held = None, None, []
        names: tuple[list[str], list[str]] = ([], [])
        total = np.zeros((0, 0), np.int64)

        def add() -> None:
            nonlocal names, total
            sides = []
            for side in (0, 1):
                # in a tile of a block with itself a vector is on both sides
                rows = sorted((r for r in held if side in r[1]), key=lambda r: r[0])
                p = np.repeat(shares(np.zeros(1, np.int64), np.array([r[2] for r in rows], np.int64))[:, None], held[0][3], axis=1) if held[0][3] else np.zeros((len(rows), 0), np.int64)
                for k, (_, _, size, _, at, n) in enumerate(rows):
                    p[k, at] = shares(n, np.int64(size))
                sides.append((p, [r[0] for r in rows]))
            (x, i), (y, j) = sides
            if not names[0]:
                names, total = (i, j), np.zeros((len(i), len(j)), np.int64)
            for k in range(len(x)):
                total[k] += np.abs(y - x[k]).sum(1)

        def result() -> Iterator[pa.RecordBatch]:
            i, j = np.nonzero(np.array(names[0])[:, None] < np.array(names[1])[None, :] if tile[1] == tile[2] else np.ones(total.shape, bool))
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array([tile[0]] * len(i), pa.string()), pa.array(names[0], pa.string()).take(pa.array(i)), pa.array(names[1], pa.string()).take(pa.array(j)), pa.array(total[i, j])], names=["lang", "a", "b", "value"])

        for t in batches:
            cols = {c: t.column(c) for c in t.schema.names}
            heads = list(zip(*(cols[c].to_pylist() for c in ("lang", "bi", "bj", "slab", "chunk", "source", "sides", "size", "terms"))))
            for k, (lang, bi, bj, slab, c, source, sides, size, terms) in enumerate(heads):
                if (lang, bi, bj, slab, c) != (*(tile or ()), chunk) and held:
                    add()
                    held.clear()
                if (lang, bi, bj, slab) != tile:
                    if tile is not None:
                        yield from result()
                    tile, names = (lang, bi, bj, slab), ([], [])
                chunk = c
                held.append((source, sides, size, terms, np.asarray(cols["at"][k].values), np.asarray(cols["n"][k].values)))
        if held:
            add()
        if tile is not None:
            yield from result()

    return vectors.mapInArrow(work, "lang string, a string, b string, value long")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank."""
    small_batches(docs.sparkSession)
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("text", *KEY)))
    by_term = Window.partitionBy("lang", "term")
    counts = counted(docs).groupBy(*KEY, "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    kept = counts.withColumns({"_d": F.sum("d").over(by_term), "all": F.sum("n").over(by_term)}).where(F.col("_d") >= min_docs)
    kept = staged(kept.select(*KEY, "term", "n", "all"), "terms")

    words = kept.groupBy("lang", "term").agg(F.first("all").alias("all"))
    langs = words.groupBy("lang").agg(F.count("*").alias("V"), F.sum("all").alias("lang_N"))
    groups = docs.select(*KEY).distinct()
    langs = groups.groupBy("lang").agg(F.count("*").alias("S")).join(langs, "lang", "left").fillna(0, ["V", "lang_N"])
    langs = langs.withColumns({"chunks": F.greatest(F.lit(1), F.ceil(F.col("V") / chunk)), "blocks": F.ceil(F.col("S") / block), "lang_size": F.col("lang_N") + PRIOR * F.col("V")})
    langs = staged(langs.select("lang", "V", "chunks", "blocks", "lang_size"), "langs")
    sums = kept.groupBy(*KEY).agg(F.sum("n").alias("N"))
    groups = groups.join(sums, KEY, "left").join(langs, "lang")
    groups = groups.withColumn("size", F.coalesce("N", F.lit(0)) + PRIOR * F.col("V")).withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    groups = staged(groups.select(*KEY, "size", "lang_size", "chunks", "blocks", "block"), "groups")

    in_chunk = words.join(langs.select("lang", "chunks"), "lang").select("lang", "term", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int").alias("chunk"))
    number = F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1
    vocabulary = staged(in_chunk.withColumn("at", number.cast("int")), "vocabulary")
    lengths = vocabulary.groupBy("lang", "chunk").agg(F.count("*").cast("int").alias("terms"))
    entries = kept.select(*KEY, "term", "n").join(vocabulary, ["lang", "term"]).groupBy(*KEY, "chunk").agg(F.collect_list(F.struct("at", "n")).alias("v"))
    rows = groups.select(*KEY, "size", "block", "blocks", F.explode(F.sequence(F.lit(0), (F.col("chunks") - 1).cast("int"))).alias("chunk"))
    rows = rows.join(entries, [*KEY, "chunk"], "left").join(lengths, ["lang", "chunk"], "left")
    other = F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")))
    rows = rows.select(*KEY, "size", "block", "chunk", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("v.at", F.array().cast("array<int>")).alias("at"), F.coalesce("v.n", F.array().cast("array<long>")).alias("n"), other.alias("other"))
    side = F.when(F.col("block") == F.col("other"), F.array(F.lit(0), F.lit(1))).when(F.col("block") < F.col("other"), F.array(F.lit(0))).otherwise(F.array(F.lit(1)))
    tile = ["lang", "bi", "bj", "slab"]
    tiles = rows.select(*KEY, F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), F.floor(F.col("chunk") / SLAB).cast("int").alias("slab"), "chunk", "size", "terms", "at", "n", side.alias("sides"))
    half = _tile_sums(tiles.repartition(*tile).sortWithinPartitions(*tile, "chunk")).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("g")
    ranked = Window.partitionBy(*KEY).orderBy(F.desc("value"), "item")
    rank = F.row_number().over(ranked).cast("int")
    pairs = half.select("lang", "value", both).select("lang", "g.source", F.lit("pair").alias("part"), "g.item", "value").withColumn("rank", rank)

    own = kept.join(groups.select(*KEY, "size", "lang_size"), KEY)
    own = own.select(*KEY, F.lit("term").alias("part"), F.col("term").alias("item"), (share(F.col("n"), F.col("size")) - share(F.col("all"), F.col("lang_size"))).alias("value")).where("value > 0")
    return pairs.unionByName(own.withColumn("rank", rank).where(F.col("rank") <= top))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle_sql() -> str:
    return rf"""
WITH d AS (SELECT row_number() OVER () k, coalesce(lang, '') lang, coalesce(source, '') "source", translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t FROM documents),
tok AS (SELECT k, lang, "source", unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term FROM d),
kept AS (SELECT lang, term, count(*) "all" FROM tok GROUP BY 1, 2 HAVING count(DISTINCT k) >= {MIN_DOCS}),
g AS (SELECT DISTINCT lang, "source" FROM d),
c AS (SELECT lang, "source", term, count(*) n FROM tok JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
v AS (SELECT lang, count(*) V, sum("all") N FROM kept GROUP BY 1),
gn AS (SELECT lang, "source", sum(n) N FROM c GROUP BY 1, 2),
p AS (SELECT g.lang, g."source", kept.term, coalesce(c.n, 0) n, 1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + {PRIOR})) // (coalesce(gn.N, 0) + {PRIOR} * v.V) p, 1 + ({SCALE}::HUGEINT * ("all" + {PRIOR})) // (v.N + {PRIOR} * v.V) q
  FROM g JOIN kept ON kept.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN gn ON gn.lang = g.lang AND gn."source" = g."source" LEFT JOIN c ON c.lang = g.lang AND c."source" = g."source" AND c.term = kept.term),
dist AS (SELECT a.lang, a."source", b."source" item, sum(abs(a.p - b.p)) "value" FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a."source" <> b."source" GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a."source", 'pair' part, b."source" item, coalesce("value", 0) "value" FROM g a JOIN g b ON a.lang = b.lang AND a."source" <> b."source" LEFT JOIN dist ON dist.lang = a.lang AND dist."source" = a."source" AND dist.item = b."source"),
terms AS (SELECT lang, "source", 'term' part, term item, p - q "value" FROM p WHERE n > 0 AND p > q)
SELECT lang, "source", part, item, "value"::BIGINT "value", (row_number() OVER (PARTITION BY lang, "source", part ORDER BY "value" DESC, item))::INTEGER "rank"
FROM (FROM pairs UNION ALL FROM terms) QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, "source", part ORDER BY "value" DESC, item) <= {TOP}"""
