"""Operator 11: spelling variants, from pairs of words one edit apart by errata-trie merging.

1. Counting. Words are runs of the letters A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased; in one of 199 documents and
   words (by a checksum of both) a letter is dropped. Tasks count a few MB of text at a time; counts are combined before
   they are shuffled. Words of at least MIN_LETTERS letters and MIN_COUNT occurrences stay.
2. Heavy paths. The trie of all words is a table of its branching nodes, from counts of prefixes: the child with most
   words below it is the heavy one. A word leaves heavy paths at most log2(words) times on its way down, so that it has
   few light edges, however many words there are.
3. Merging. At each light edge, from node u by letter a, the word u a v is merged into the heavy subtree (letter h) in
   three ways: with a replaced (u h v), with a skipped (u v), and with h put in before it (u h a v, and u h for a word
   that ends at u). Only the smaller sides are moved. Subtrees are merged at all nodes at once, as one join: a terminal
   of the moved side and one of the unmoved that spell the same string are one edit apart. Replaced terminals of two
   light children of one node that spell the same string are one replacement apart from each other. Each pair is found
   at the node where the two words part, once.
4. Forms. A word's form is its near word of largest count (ties: the smallest in code-point order), if that is at least
   RATIO times the word's. Roots follow forms to the end by doubling: counts grow by RATIO at each step, so that five
   rounds reach the end of any chain (5^32 is more than a count can be).

Tables hold a word or a pair a row; no trie is in one task. Nodes with very many words below them, such as the root, are
joined by broadcast: the TRUNK nodes with most words, of which there are never more. Any other node has less than a
TRUNK-th of all prefixes.

Null text has no words; a null doc_id counts as the empty string in the checksum. Repeated rows count as often as they
are there. Runs of any length are words. An empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import released, small_batches, staged
from .words import blocks, coded, runs, tallied

MIN_LETTERS, MIN_COUNT, RATIO, DROP = 6, 5, 5, 199
TRUNK = 10_000
DOUBLINGS = 5
_LETTER = np.zeros(256, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
#: Word lengths in bytes up to which checksums are put together from tables.
REACH = 255


def _crc_steps(most: int) -> np.ndarray:
    """[n, k, b]: what byte b at place k of a CRC-32 becomes after n further bytes; places add up by exclusive or."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(0xEDB88320), byte >> 1)
    out = np.zeros((most + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(most):
        out[n + 1] = byte[out[n] & 0xFF] ^ (out[n] >> np.uint32(8))
    return out


_STEPS = _crc_steps(REACH)


def checksums(before: np.ndarray, words: list[bytes], code: np.ndarray) -> np.ndarray:
    """CRC-32 of texts whose first parts have the CRC-32 `before` and that end with words[code]."""
    own = np.array([zlib.crc32(w) for w in words], np.uint32)
    size = np.array(list(map(len, words)), np.int64)
    s = size[code]
    near = np.minimum(s, REACH)
    out = own[code]
    for k in range(4):
        out = out ^ _STEPS[near, k, (before >> np.uint32(8 * k)) & np.uint32(0xFF)]
    for i in np.flatnonzero(s > REACH).tolist():
        out[i] = zlib.crc32(words[code[i]], int(before[i]))
    return out


def letters_of(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 as one byte a letter: A-Z in lower case, U+00C0 to U+00FF as their number, 0 for all else; and its offsets."""
    lead = raw == 0xC3
    values = _LETTER[raw]
    after = np.flatnonzero(lead) + 1
    values[after] = raw[after] + 0x40
    return values[~lead], off - np.concatenate([[0], np.cumsum(lead, dtype=np.int64)])[off]


def word_counts(docs: DataFrame, min_letters: int = MIN_LETTERS, drop: int = DROP) -> DataFrame:
    """word, n: counts of a few MB of text at a time, so that words recur."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for raw, off, (ids,) in blocks(batches, "doc_id"):
            values, at, row = runs(*letters_of(raw, off))
            long = np.diff(at) >= min_letters
            values, row, size = values[np.repeat(long, np.diff(at))], row[long], np.diff(at)[long]
            found, code = coded(values, np.concatenate([[0], np.cumsum(size)]), pa.large_binary())
            if not len(found):
                continue
            words = [w.decode("latin-1") for w in found.to_pylist()]
            each, n = tallied(row * len(words) + code)
            code = each % len(words)
            first = np.array([zlib.crc32(b":" if i is None else b"%d:" % i) for i in ids.to_pylist()], np.uint32)
            h = checksums(first[each // len(words)], [w.encode() for w in words], code)
            hit = np.flatnonzero(h % np.uint32(drop) == 0)
            total = np.bincount(code, n, len(words)).astype(np.int64)
            np.subtract.at(total, code[hit], n[hit])
            changed: dict[str, int] = {}
            for i in hit.tolist():
                w = words[code[i]]
                k = int(h[i]) % len(w)
                if len(w) > min_letters:
                    w = w[:k] + w[k + 1 :]
                    changed[w] = changed.get(w, 0) + int(n[i])
            left = np.flatnonzero(total)
            table = pa.RecordBatch.from_arrays([pa.array([words[k] for k in left.tolist()] + list(changed), pa.string()), pa.array([*total[left].tolist(), *changed.values()], pa.int64())], names=["word", "n"])
            for k in range(0, table.num_rows, 50_000):
                yield table.slice(k, 50_000)

    return docs.mapInArrow(released(work), "word string, n long")


def _node(word: Column, depth: Column) -> Column:
    return F.substring(word, F.lit(1), depth)


def branching(words: DataFrame) -> DataFrame:
    """node, size, heavy: the prefixes with several children, or with one where a word ends too, and the letter below
    which most words are (ties: the smallest letter)."""
    depth = F.explode(F.sequence(F.lit(0), F.length("word"))).alias("depth")
    edges = words.select("word", depth).select(_node(F.col("word"), F.col("depth")).alias("node"), F.substring("word", F.col("depth") + 1, F.lit(1)).alias("letter"))
    below = edges.groupBy("node", "letter").agg(F.count("*").alias("n"))  # the letter is empty where a word ends
    nodes = below.groupBy("node").agg(F.count("*").alias("children"), F.sum("n").alias("size"), F.min(F.when(F.col("letter") != "", F.struct((-F.col("n")).alias("less"), "letter"))).alias("top"))
    return nodes.where("children > 1").select("node", "size", F.col("top.letter").alias("heavy"))


def light_edges(words: DataFrame, nodes: DataFrame, trunk: int = TRUNK) -> DataFrame:
    """word, n, depth, heavy: the places where a word leaves a heavy path; depth letters stand before it."""
    path = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("depth"))
    path = path.select("word", "n", "depth", _node(F.col("word"), F.col("depth")).alias("node"), F.substring("word", F.col("depth") + 1, F.lit(1)).alias("letter"))
    large = nodes.orderBy(F.desc("size"), "node").limit(trunk)
    top = path.join(F.broadcast(large.select("node", "heavy")), "node", "left")
    rest = nodes.join(F.broadcast(large.select("node")), "node", "left_anti").select("node", "heavy")
    found = top.where("heavy is not null").select("word", "n", "depth", "letter", "heavy")
    deep = top.where("heavy is null").drop("heavy").join(rest.hint("merge"), "node").select("word", "n", "depth", "letter", "heavy")
    return found.unionByName(deep).where("letter <> heavy").select("word", "n", "depth", "heavy")


def near_pairs(words: DataFrame, trunk: int = TRUNK) -> DataFrame:
    """a, a_n, b, b_n: all pairs of distinct words (word, n) that are one inserted, deleted or replaced letter apart, each
    both ways."""
    light = staged(light_edges(words, staged(branching(words), "nodes"), trunk), "light")
    word, d = F.col("word"), F.col("depth")
    before, after = _node(word, d), F.substring(word, d + 2, F.length(word))
    letter, following = F.substring(word, d + 1, F.lit(1)), F.substring(word, d + 2, F.lit(1))
    ends = d == F.length(word)
    replaced = F.when(~ends, F.struct(F.concat(before, "heavy", after).alias("key"), d.alias("at")))
    # of a run of one letter the last is skipped: there the longer word parts from the shorter one
    skipped = F.when(~ends & (letter != following), F.struct(F.concat(before, after).alias("key"), F.lit(-1).alias("at")))
    put_in = F.struct(F.concat(before, "heavy", F.substring(word, d + 1, F.length(word))).alias("key"), F.lit(-1).alias("at"))
    moved = light.select("word", "n", F.explode(F.array_compact(F.array(replaced, skipped, put_in))).alias("m")).select("word", "n", "m.key", "m.at")
    moved = staged(moved, "moved")
    still = words.select(F.col("word").alias("key"), F.col("n").alias("own"))
    met = moved.join(still.hint("merge"), "key").select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("key").alias("b"), F.col("own").alias("b_n"))
    x, y = (moved.where("at >= 0").select("key", "at", F.col("word").alias(s), F.col("n").alias(f"{s}_n")) for s in "ab")
    beside = x.join(y.hint("merge"), ["key", "at"]).where("a < b").select("a", "a_n", "b", "b_n")
    one = met.unionByName(beside)
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of each of words (word, n)."""
    best = near_pairs(words).groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("word"))).alias("top"))
    got = words.join(best.hint("merge"), "word", "left")
    over = -F.col("top.less") >= ratio * F.col("n")
    got = got.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(over, F.col("top.word")).alias("form"), F.when(over, -F.col("top.less")).alias("form_n"))
    got = staged(got, "forms")
    root = got.where("form is not null").select("word", F.col("form").alias("root"))
    for k in range(DOUBLINGS):
        further = root.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        root = staged(root.join(further.hint("merge"), "root", "left").select("word", F.coalesce("_next", "root").alias("root")), f"roots-{k}")
    return got.join(root.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def vocabulary(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n of the words that are kept."""
    small_batches(docs.sparkSession)
    counts = word_counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return staged(counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count), "words")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(spark.read.parquet(f"{sf_dir}/documents.parquet")))
