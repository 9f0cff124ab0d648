"""Operator 5: token counts that follow edits.

A document's tree has a leaf for each stretch of a few dozen units (runs of white space and what follows, see tokens:
no pre-token crosses their ends) with its number of characters and of tokens; inner nodes hold the sums of both. An
edit is found by descending the sums. Only the leaves that it touches are encoded again, with the neighbour where it
touches their common end, since a unit may then begin or end elsewhere; the sums above are updated on the way up.

Trees are columns beside the text, made and used in one pass over the documents without a shuffle; only new words are
encoded, once a worker.

Edited trees and texts can be kept, so that later edits start from them.

Null text counts as empty; a document without edits keeps its tree; null edits are none; edits name characters of the
text before all edits (start, how many go, what comes instead), in any order, overlapping ones as one in order of
start, and places beyond the end mean the end; an empty table gives no rows; repeated rows and null doc_ids are counted
like others; columns other than doc_id, text and edits are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import small_batches
from .tokens import MemoEncoder, encoder

LEAF = 32
TREES = "doc_id long, text string, edits array<struct<at:long,gone:long,new:string>>, chars array<int>, tokens array<int>"
RESULT = "doc_id long, n_tokens long, n_tokens_edited long, n_leaves int, leaves_encoded int, chars_encoded long"


def counted(enc: MemoEncoder, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each unit of the texts its characters and tokens, and the n + 1 offsets of the texts' units."""
    units, size, at = enc.unit_ids(texts)
    flat = units.flatten()
    off = np.asarray(units.offsets).astype(np.int64)
    return np.asarray(pc.utf8_length(flat)).astype(np.int64), size[at], off - off[0]


def leaves(enc: MemoEncoder, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters and tokens of each leaf, and the n + 1 offsets of the texts' leaves; every text has one at least."""
    chars, tokens, off = counted(enc, texts)
    n = np.maximum(-(-np.diff(off) // LEAF), 1)
    cuts = np.concatenate([[0], np.cumsum(n)])
    nth = np.arange(cuts[-1]) - np.repeat(cuts[:-1], n)
    first = np.repeat(off[:-1], n) + nth * LEAF
    sums = lambda x: np.add.reduceat(np.append(x, 0), first)
    return sums(chars), sums(tokens), cuts


class Tree:
    """Sums of characters and tokens over leaves, as an implicit binary tree."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.n, self.size = len(chars), 1 << max(len(chars) - 1, 0).bit_length()
        fill = [0] * (self.size - self.n)
        self.sums = []
        for leaf in (chars, tokens):
            level, nodes = leaf + fill, []
            while len(level) > 1:
                nodes.append(level)
                level = [a + b for a, b in zip(level[::2], level[1::2])]
            nodes.append(level)
            self.sums.append([x for level in reversed(nodes) for x in level])  # root first; leaves last

    def total(self, what: int) -> int:
        return self.sums[what][0]

    def leaf_of(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character, and the leaf's first character; beyond the end, the last leaf."""
        node, before, sums = 0, 0, self.sums[0]
        if char >= sums[0]:
            return self.n - 1, sums[0] - self.get(self.n - 1)[0]
        while 2 * node + 2 < len(sums):
            node = 2 * node + 1
            if char - before >= sums[node]:
                before += sums[node]
                node += 1
        return node - (self.size - 1), before

    def get(self, leaf: int) -> tuple[int, int]:
        k = leaf + self.size - 1
        return self.sums[0][k], self.sums[1][k]

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        for sums, value in zip(self.sums, (chars, tokens)):
            k = leaf + self.size - 1
            change = value - sums[k]
            sums[k] += change
            while k and change:
                k = (k - 1) // 2
                sums[k] += change


def regions(tree: Tree, text: str, edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str, int]]:
    """(first leaf, last leaf, their new text, their old characters) of what edits touch, in order, apart."""
    end = len(text)
    spans: list[list] = []
    for at, gone, new in sorted(edits, key=lambda e: e[0]):
        a = min(max(at, 0), end)
        b = min(max(a + max(gone, 0), a), end)
        if spans and a < spans[-1][1]:
            spans[-1][1], spans[-1][2] = max(b, spans[-1][1]), spans[-1][2] + new
        else:
            spans.append([a, b, new])
    out: list[list] = []
    for a, b, new in spans:
        first, start = tree.leaf_of(a)
        if a == start and first:
            first, start = first - 1, start - tree.get(first - 1)[0]
        last, last_start = tree.leaf_of(b)
        stop = last_start + tree.get(last)[0]
        if out and first <= out[-1][1]:
            out[-1][1], out[-1][3] = max(last, out[-1][1]), max(stop, out[-1][3])
            out[-1][4].append((a, b, new))
        else:
            out.append([first, last, start, stop, [(a, b, new)]])
    made = []
    for first, last, start, stop, inside in out:
        parts, at = [], start
        for a, b, new in inside:
            parts += [text[at:a], new]
            at = b
        made.append((first, last, "".join(parts) + text[at:stop], stop - start))
    return made


def build_trees(docs: DataFrame, tokenizer: str, drop_space: bool = False) -> DataFrame:
    """TREES of (doc_id, text, edits)."""
    small_batches(docs.sparkSession, 2000)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, drop_space)
        for b in batches:
            texts = pc.fill_null(b.column(1), "")
            chars, tokens, cuts = leaves(enc, texts)
            lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x, pa.int32())) for x in (chars, tokens)]
            yield pa.RecordBatch.from_arrays([b.column(0), texts, b.column(2), *lists], names=["doc_id", "text", "edits", "chars", "tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "edits").mapInArrow(work, TREES)


def _regrown(text: str, chars: list[int], tokens: list[int], made: list[tuple[int, int, str, list[int], list[int]]]) -> tuple[str, list[int], list[int]]:
    """The text and the leaves after the regions (first and last leaf, new text, its leaves) took the place of old ones."""
    begin = np.concatenate([[0], np.cumsum(chars, dtype=np.int64)]).tolist()
    parts, c, t, at = [], [], [], 0
    for first, last, new, new_chars, new_tokens in sorted(made, key=lambda r: r[0]):
        parts += [text[begin[at] : begin[first]], new]
        c, t, at = c + chars[at:first] + new_chars, t + tokens[at:first] + new_tokens, last + 1
    return "".join(parts) + text[begin[min(at, len(chars))] :], (c + chars[at:]) or [0], (t + tokens[at:]) or [0]


def apply_edits(trees: DataFrame, tokenizer: str, drop_space: bool = False, keep_trees: bool = False) -> DataFrame:
    """RESULT: tokens before and after the edits, and how much was encoded again. With keep_trees also the columns of
    TREES after the edits (edits: null), for further ones; regions that were encoded again get leaves of their own."""
    schema = RESULT + ", " + TREES.removeprefix("doc_id long, ") if keep_trees else RESULT

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, drop_space)
        for b in batches:
            texts, edits = b.column(1).to_pylist(), b.column(2).to_pylist()
            chars, tokens = b.column(3).to_pylist(), b.column(4).to_pylist()
            grown = [Tree(c, t) for c, t in zip(chars, tokens)]
            todo = [(k, r) for k, e in enumerate(edits) if e for r in regions(grown[k], texts[k], [(x["at"] or 0, x["gone"] or 0, x["new"] or "") for x in e if x])]
            before = [t.total(1) for t in grown]
            again, seen = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            made: dict[int, list] = {}
            if todo and keep_trees:
                c, t, cuts = (x.tolist() for x in leaves(enc, pa.array([r[2] for _, r in todo], pa.string())))
                for (k, (first, last, text, _)), a, z in zip(todo, cuts[:-1], cuts[1:]):
                    made.setdefault(k, []).append((first, last, text, c[a:z], t[a:z]))
            if todo:
                _, new, off = counted(enc, pa.array([r[2] for _, r in todo], pa.string()))
                sums = np.concatenate([[0], np.cumsum(new)])
                for (k, (first, last, text, _)), a, z in zip(todo, off[:-1], off[1:]):
                    for leaf in range(first + 1, last + 1):
                        grown[k].put(leaf, 0, 0)
                    grown[k].put(first, len(text), int(sums[z] - sums[a]))
                    again[k] += last - first + 1
                    seen[k] += len(text)
            arrays = [b.column(0), pa.array(before, pa.int64()), pa.array([t.total(1) for t in grown], pa.int64()), pa.array([t.n for t in grown], pa.int32()), pa.array(again, pa.int32()), pa.array(seen, pa.int64())]
            names = ["doc_id", "n_tokens", "n_tokens_edited", "n_leaves", "leaves_encoded", "chars_encoded"]
            if keep_trees:
                new = [_regrown(texts[k], chars[k], tokens[k], made.get(k, [])) for k in range(len(texts))]
                lists = [pa.array([x[i] for x in new], pa.list_(pa.int32())) for i in (1, 2)]
                arrays += [pa.array([x[0] for x in new], pa.string()), pa.nulls(len(new), b.column(2).type), *lists]
                names += ["text", "edits", "chars", "tokens"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return trees.mapInArrow(work, schema)


def sample_edits(text: Column) -> Column:
    """Three edits of any text: words struck out at a quarter, put in at the half, changed at three quarters."""
    n = F.char_length(text).cast("long")
    edit = lambda part, gone, new: F.struct(F.floor(n * part / 4).cast("long").alias("at"), F.lit(gone).cast("long").alias("gone"), F.lit(new).alias("new"))
    return F.array(edit(1, 17, ""), edit(2, 0, " a few more words, "), edit(3, 5, "other"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", sample_edits(F.coalesce("text", F.lit(""))).alias("edits"))
    return apply_edits(build_trees(docs, path), path)
