"""Operator 9: benchmark passages in documents, by an embedding of edit distance and bit-sampling LSH.

The embedding is a random walk over a string: step j writes the byte under the pointer and moves the pointer on, or
not, by a random bit of (j, byte). Strings a few edits apart fall into step again soon after each edit, so that their
walks differ in few places: edit distance becomes Hamming distance. LSH keys are hashes of a sample of places of a walk.

The item-sized window that stands opposite an item is embedded stretch by stretch, in documents and items alike: a walk
of `STEPS` steps (about `STEPS` / 2 bytes) begins at each content-defined start, a pair of neighbouring bytes whose hash
falls into one of `DENSITY` classes. A start depends on two bytes only, so edits elsewhere do not move it, and wherever in
the window they are, the stretches between them keep their keys. Each of `REPEATS` repeats has a walk and a sample of
places of its own. A stretch of an item with an edit rate of e is met with a chance of about (1 - e) ** (STEPS / 2); an item
of m starts is missed if all m times REPEATS fail, and the number of repeats is the one that leaves 1 - `RECALL` of
copies at the rate `RATE` with FEW starts. One walk over a whole window would have to begin at each place of a document, and
its steps would not meet again after a tenth of the characters had changed. Measured recall (tests/llm hold it at 0.9):
README.

Items with few starts (short ones, and text of few different bytes) are looked for at every byte as well: by words of 8
bytes, one each 8 bytes of the item (shorter items: of their size), so that edited copies are met as long as one such
word is whole; items under `LEAST` bytes are found by their first word and as exact copies.

A candidate is first tested by the item's first words of 64 bytes, whose own least edits add up to no more than those of the
whole (see least_edits). A hit is then decided by the edit distance of the whole item to the text around
(bit-parallel, free ends): a document has an item when at most `rate` of the item's bytes are edited, case and kind of
white space aside. What is found in a document depends on that document alone, not on its neighbours in a batch.

Items ride to the executors in blocks bounded in number and bytes, whatever the benchmark's size; an executor builds a
block's index once. Documents are scanned once a block, without a shuffle. Items of white space alone are none. Null and
empty texts have no items; a null doc_id or item_id stays null; repeated rows give repeated rows; empty tables give no
rows; other columns are ignored."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import mix64, small_batches, texts_of
from .shingle_join import _LOWER, _SPACE, chunks

STEPS, SAMPLED, DENSITY = 30, 18, 4
#: Items with fewer starts than this are looked for at every byte as well.
FEW = 10
LEAST = 40
#: The share of edited copies that is to be found, at the edit bound and with no more starts than FEW.
RECALL, RATE = 0.9, 0.2
REPEATS = math.ceil(math.log(1 - RECALL) / math.log1p(-((1 - RATE) ** (STEPS / 2))) / FEW)
#: Walks that are taken side by side.
WALKS = 8192
#: Items and bytes of a block.
BLOCK, BLOCK_BYTES = 50_000, 32 << 20
RESULT = "doc_id long, item_id long, edits int, item_bytes int, at long"

_FOLD = np.where(_SPACE, 32, _LOWER).astype(np.uint8)


def fold(raw: np.ndarray) -> np.ndarray:
    """Lower case, Latin letters with accents as well, and every kind of white space as a space; sizes stay."""
    out = _FOLD[raw]
    if len(raw) > 1:
        out[1:][(raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)] += 32
    return out


_rng = np.random.default_rng(20)
_MOVES = _rng.integers(0, 2, (REPEATS, STEPS, 256)).astype(np.int64)
_PLACES = [np.unique(np.concatenate([_rng.choice(STEPS - 1, SAMPLED - 1, replace=False), [STEPS - 1]])) for _ in range(REPEATS)]
_BEGINS = mix64(np.arange(1 << 16, dtype=np.uint64) + np.uint64(77)) % np.uint64(DENSITY) == 0


def starts(raw: np.ndarray) -> np.ndarray:
    """Content-defined starts in folded text."""
    return np.flatnonzero(_BEGINS[raw[:-1].astype(np.uint16) * np.uint16(256) + raw[1:]])


#: After so many steps, a multiple of WITHIN, a walk goes on only if some item's walk has come the same way.
EARLY = (16, 24)
#: Steps are taken two at once, by the two bytes from the pointer on; so many of them stay within eight bytes.
WITHIN = 8
_TWO, _LOW, _TO_BYTES = np.uint64(0xFFFF), np.uint64(0xFF), np.uint64(3)


@cache
def _two_steps(repeat: int) -> list[np.ndarray]:
    """For steps 0 and 1, 2 and 3 and so on: what the two steps add to the key, by the two bytes from the pointer on: a hash
    of what is sampled of them and of the step, and in the lowest eight bits by how many bits they move on. None follows
    the last step."""
    here, there = np.meshgrid(np.arange(256), np.arange(256))  # the byte at the pointer, which is the lower one, and the next
    sampled, out = set(_PLACES[repeat].tolist()), []
    for j in range(0, STEPS, 2):
        go = _MOVES[repeat, j][here]
        second = np.where(go == 1, there, here)
        seen = sum((x + 1) << 10 * n for n, x in enumerate((here, second)) if j + n in sampled) + np.full(here.shape, (repeat * STEPS + j) << 20)
        move = go + (_MOVES[repeat, j + 1][second] if j + 2 < STEPS else 0)
        out.append(((mix64(seen.astype(np.uint64)) & ~_LOW) | (8 * move).astype(np.uint64)).ravel())
    return out


def keys(padded: np.ndarray, begin: np.ndarray, repeat: int, early: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """The LSH key of the walk from each start, the last byte that it saw, the start, and the keys at the steps EARLY.
    padded: folded text and STEPS zeros. With early, the sieves of the items' keys at these steps, walks that none of
    them lets through are left out: their whole keys are none of the items' either."""
    out = []
    tables = _two_steps(repeat)
    eight = np.ndarray((len(padded) - 7,), "<u8", padded.data, strides=(1,))
    for lo in range(0, len(begin), WALKS):  # so many at a time stay in a core's own cache
        first = begin[lo : lo + WALKS]
        k, passed = np.zeros(len(first), np.uint64), []
        for j in range(0, STEPS, 2):
            if j in EARLY:
                now = k >> np.uint64(40)
                if early is None:
                    passed.append(now)
                else:
                    go = in_sieve(early[EARLY.index(j)], now)
                    k, first = k[go], first[go]
            if j % WITHIN == 0:
                text = eight[first + ((k & _LOW) >> _TO_BYTES).view(np.int64)]
            step = tables[j // 2].take((text & _TWO).view(np.int64), mode="wrap")  # no place is outside; this way take need not look
            k += step
            step &= _LOW
            text >>= step
        out.append((mix64(k & ~_LOW), first + ((k & _LOW) >> _TO_BYTES).view(np.int64), first, *passed))
    if not out:
        return np.zeros(0, np.uint64), begin, begin, [np.zeros(0, np.uint64)] * len(EARLY)
    key, last, first, *passed = (np.concatenate(x) for x in zip(*out))
    return key, last, first, passed


def sieve_of(hashes: np.ndarray) -> np.ndarray:
    """A table of flags, at least 32 times as many as there are hashes (up to 4 million)."""
    sieve = np.zeros(1 << min(22, max(10, int(32 * len(hashes)).bit_length())), bool)
    sieve[(hashes & np.uint64(len(sieve) - 1)).astype(np.int64)] = True
    return sieve


def in_sieve(sieve: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes that may be among those of the sieve."""
    return np.flatnonzero(sieve.take((hashes & np.uint64(len(sieve) - 1)).view(np.int64)))


def edit_distance(item: bytes, text: bytes) -> tuple[int, int]:
    """The least number of edits that turn item into a part of text, and where that part ends."""
    where: dict[int, int] = {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    plus, minus, now = full, 0, len(item)
    best, end = now, 0
    for k, c in enumerate(text, 1):
        eq = where.get(c, 0)
        x = eq | minus
        d = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | (full & ~(d | plus))
        down = plus & d
        if up & top:
            now += 1
        elif down & top:
            now -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(x | up)), up & x
        if now < best:
            best, end = now, k
    return best, end


#: Pairs of an item and a stretch of text that are compared side by side.
SIDE = 2048
#: Fewer are compared one after another.
FEW_PAIRS = 24
_ONE = np.uint64(1)


def _bits(item: bytes) -> np.ndarray:
    """[byte, word]: at which places of the item, 64 to a word, the byte stands."""
    out = np.zeros((256, -(-len(item) // 64)), np.uint64)
    at = np.arange(len(item), dtype=np.uint64)
    np.bitwise_or.at(out, (np.frombuffer(item, np.uint8), (at // np.uint64(64)).astype(np.int64)), _ONE << (at % np.uint64(64)))
    return out


def edit_distances(items: list[bytes], which: np.ndarray, text: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """edit_distance of items[which] and text[lo:hi], pair by pair, for many pairs side by side: the same bits in words of 64,
    with what a step carries from word to word (Hyyro 2003)."""
    best, end = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
    size = np.array([len(t) for t in items], np.int64)
    words = -(-size // 64)
    order = np.lexsort((hi - lo, words[which]))
    cuts = np.flatnonzero(np.diff(words[which][order])) + 1
    for group in np.split(order, cuts):
        for at in np.split(group, np.arange(SIDE, len(group), SIDE)):
            if not len(at):
                continue
            if len(at) < FEW_PAIRS:
                for k in at.tolist():
                    best[k], end[k] = edit_distance(items[which[k]], text[lo[k] : hi[k]].tobytes())
                continue
            used, item = np.unique(which[at], return_inverse=True)
            tables = np.stack([_bits(items[k]) for k in used.tolist()])
            w, n, length = tables.shape[2], size[which[at]], (hi - lo)[at]
            tables, row = np.ascontiguousarray(tables.reshape(-1, w).T), item * 256
            top = ((n - 1) % 64).astype(np.uint64)
            plus, minus = np.full((w, len(at)), ~np.uint64(0)), np.zeros((w, len(at)), np.uint64)
            now, low, where = n.copy(), n.copy(), np.zeros(len(at), np.int64)
            for k in range(int(length.max())):
                first = int(np.searchsorted(length, k, side="right"))  # shorter ones are through
                place = row[first:] + text[lo[at[first:]] + k]
                up = down = np.zeros(len(at) - first, np.uint64)  # what the word before hands on
                for j in range(w):
                    p, m = plus[j, first:], minus[j, first:]
                    eq = tables[j].take(place)
                    x = eq | m
                    eq = eq | down
                    d = (((eq & p) + p) ^ p) | eq
                    above, below = m | ~(d | p), p & d
                    last = top[first:] if j == w - 1 else np.uint64(63)
                    out_up, out_down = (above >> last) & _ONE, (below >> last) & _ONE
                    above, below = (above << _ONE) | up, (below << _ONE) | down
                    plus[j, first:], minus[j, first:] = below | ~(x | above), above & x
                    up, down = out_up, out_down
                now[first:] += up.astype(np.int64) - down.astype(np.int64)
                less = now[first:] < low[first:]
                low[first:][less] = now[first:][less]
                where[first:][less] = k + 1
            best[at], end[at] = low, where
    return best, end


#: Least edits that a word of 64 bytes may be taken to cost in text that has nothing to do with it.
STRANGE = 28


def least_edits(items: list[bytes], which: np.ndarray, text: np.ndarray, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """A number that is at most the edit distance of items[which] and text[lo:hi] where that is within the bound: the sum,
    over the item's first words of 64 bytes, of the least edits that turn a word into a part of the text where it may
    stand. Each word is aligned by itself, so that no alignment of the whole costs less. There are as many words as
    usually go over the bound in text that has nothing to do with the item."""
    size = np.array([len(t) for t in items], np.int64)
    n = np.minimum(-(-size[which] // 64), bound // STRANGE + 1)
    pair = np.repeat(np.arange(len(which)), n)
    at = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
    # within the bound an item begins after lo and ends before hi, and no place is off by more edits than the bound
    low = np.maximum(lo[pair], lo[pair] + 64 * at - bound[pair])
    high = np.maximum(low, np.minimum(hi[pair], (hi - size[which] + 2 * bound)[pair] + 64 * (at + 1)))
    sum_of = np.zeros(len(which), np.int64)
    order = np.lexsort((which[pair], high - low))
    for part in np.split(order, np.arange(SIDE, len(order), SIDE)):
        if len(part):
            np.add.at(sum_of, pair[part], _word_edits(items, which[pair[part]], at[part], text, low[part], high[part]))
    return sum_of


@lru_cache(maxsize=4096)
def _word_bits(word: bytes) -> np.ndarray:
    """[byte]: at which places of a word of up to 64 bytes the byte stands, the last at the highest bit; a shorter one has
    rows before it that cost nothing. Words of the same items come batch after batch."""
    gap = np.uint64(64 - len(word))
    free = (_ONE << np.minimum(gap, np.uint64(63))) - _ONE if gap else np.uint64(0)
    return (_bits(word)[:, 0] << gap) | free


def _word_edits(items: list[bytes], which: np.ndarray, at: np.ndarray, text: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least edits of the at-th words of items[which], in the order of hi - lo. A word ends at the highest bit; a
    shorter one has rows before it that cost nothing."""
    name, row = np.unique(which * 65536 + at, return_inverse=True)
    words = [items[k][64 * s : 64 * s + 64] for k, s in zip((name // 65536).tolist(), (name % 65536).tolist())]
    gap = np.array([64 - len(t) for t in words], np.uint64)
    free = np.where(gap > 0, (_ONE << np.minimum(gap, np.uint64(63))) - _ONE, np.uint64(0))
    table = np.concatenate([_word_bits(t) for t in words])
    row, length = row * 256, hi - lo
    plus, minus = ~free[row // 256], np.zeros(len(which), np.uint64)
    now = (64 - gap.astype(np.int64))[row // 256]
    least, top = now.copy(), np.uint64(63)
    cuts, begin = np.searchsorted(length, np.arange(int(length.max())), side="right"), lo.copy()
    for k, first in enumerate(cuts.tolist()):  # those before are through
        p, m, score = plus[first:], minus[first:], now[first:]
        eq = table.take(text.take(begin[first:] + k, mode="wrap") + row[first:], mode="wrap")
        x = eq | m
        d = eq & p
        d += p
        d ^= p
        d |= eq
        above = d | p
        np.invert(above, out=above)
        above |= m
        d &= p  # below
        score += (above >> top).view(np.int64)
        score -= (d >> top).view(np.int64)
        np.minimum(least[first:], score, out=least[first:])
        above <<= _ONE
        d <<= _ONE
        np.bitwise_and(above, x, out=m)
        x |= above
        np.invert(x, out=x)
        np.bitwise_or(d, x, out=p)
    return least


class Index:
    """Items, end to end, with the sorted keys of their stretches."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.items = items
        self.size = np.array([len(t) for _, t in items], np.int64)
        raw = np.frombuffer(b"".join(t for _, t in items), np.uint8)
        off = np.concatenate([[0], np.cumsum(self.size)])
        padded, begin = np.concatenate([raw, np.zeros(STEPS, np.uint8)]), starts(raw)
        of = np.searchsorted(off, begin, side="right") - 1
        self.table, most = [], np.zeros(len(items), np.int64)
        for r in range(REPEATS):
            key, last, _, passed = keys(padded, begin, r)
            ok = last < off[of + 1]
            most = np.maximum(most, np.bincount(of[ok], minlength=len(items)))
            order = np.argsort(key[ok], kind="stable")
            key = key[ok][order]
            self.table.append((key, of[ok][order], (begin[ok] - off[of[ok]])[order], sieve_of(key), [sieve_of(p[ok]) for p in passed]))
        words: dict[int, list[tuple[int, int, int]]] = {}
        for n in np.flatnonzero((most < FEW) | (self.size < LEAST)).tolist():
            text = items[n][1]
            size = min(8, len(text))
            for k in range(0, len(text) - size + 1, 8) if len(text) >= LEAST else [0]:
                words.setdefault(size, []).append((int.from_bytes(text[k : k + size], "little"), n, k))
        #: by size: the sorted words, their items and places there, and a sieve of the words' hashes
        self.words = {}
        for size, rows in words.items():
            w, who, where = (np.array(c, np.uint64) for c in zip(*sorted(rows)))
            self.words[size] = w, who.astype(np.int64), where.astype(np.int64), sieve_of(mix64(w))

    def candidates(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Distinct rows (document, item, where the item would begin) of folded texts."""
        out = []

        def meet(at: np.ndarray, end: np.ndarray, lo: np.ndarray, hi: np.ndarray, who: np.ndarray, where: np.ndarray) -> None:
            n = hi - lo
            at, end = np.repeat(at, n), np.repeat(end, n)
            j = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            d = np.searchsorted(off, at, side="right") - 1
            ok = end <= off[d + 1]
            out.append(np.stack([d[ok], who[j][ok], (at - where[j])[ok]]))

        if len(raw) > 1:
            begin, padded = starts(raw), np.concatenate([raw, np.zeros(STEPS, np.uint8)])
            for r in range(REPEATS):
                table, who, where, sieve, early = self.table[r]
                key, last, first, _ = keys(padded, begin, r, early)
                maybe = in_sieve(sieve, key)
                meet(first[maybe], last[maybe] + 1, np.searchsorted(table, key[maybe]), np.searchsorted(table, key[maybe], side="right"), who, where)
        if self.words and len(raw):
            padded = np.concatenate([raw, np.zeros(8, np.uint8)])
            every = np.ndarray((len(raw),), "<u8", padded.data, strides=(1,)).astype(np.uint64)
            for size, (w, who, where, sieve) in self.words.items():
                here = every & np.uint64((1 << 8 * size) - 1)
                maybe = in_sieve(sieve, mix64(here))
                meet(maybe, maybe + size, np.searchsorted(w, here[maybe]), np.searchsorted(w, here[maybe], side="right"), who, where)
        return np.unique(np.concatenate(out, 1), axis=1) if out else np.zeros((3, 0), np.int64)


def hits(index: Index, b: pa.RecordBatch, rate: float) -> list[tuple[int, int, int, int]]:
    """(row, number of the item, edits, begin) of the items in the texts of a batch."""
    raw, off = texts_of(b)
    raw, size = fold(raw), index.size
    slack = (size * rate).astype(np.int64) + 8
    bound = np.where(size >= LEAST, (rate * size).astype(np.int64), 0)
    tried: list[np.ndarray] = []
    for lo, hi in chunks(off):
        part, at = raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        d, n, begin = index.candidates(part, at)
        if not len(d):
            continue
        # places of one item in one document that lie close together are tried as one stretch of text
        near = (d[1:] == d[:-1]) & (n[1:] == n[:-1]) & (np.diff(begin) <= slack[n[1:]])
        first = np.flatnonzero(np.concatenate([[True], ~near]))
        last = np.append(first[1:], len(d)) - 1
        doc, item = d[first], n[first]
        a, z = np.maximum(begin[first] - slack[item], at[doc]), np.minimum(begin[last] + size[item] + slack[item], at[doc + 1])
        may = np.flatnonzero(z - a >= size[item] - bound[item])
        tried.append(np.stack([doc[may] + lo, item[may], a[may] + off[lo], z[may] + off[lo]]))
    if not tried:
        return []
    doc, item, a, z = np.concatenate(tried, 1)
    texts = [t for _, t in index.items]
    may = np.flatnonzero(least_edits(texts, item, raw, a, z, bound[item]) <= bound[item])
    doc, item, a, z = doc[may], item[may], a[may], z[may]
    edits, end = edit_distances(texts, item, raw, a, z)
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for k in np.flatnonzero(edits <= bound[item]).tolist():
        key = int(doc[k]), int(item[k])
        if key not in best or edits[k] < best[key][0]:
            best[key] = int(edits[k]), max(int(a[k] + end[k] - size[item[k]] - off[doc[k]]), 0)
    return [(*key, *x) for key, x in sorted(best.items())]


_built: dict[bytes, Index] = {}


def _index(items: list[tuple[int, bytes]], name: bytes) -> Index:
    """The index of a block, built once in each Python worker; the last one is kept."""
    if name not in _built:
        _built.clear()
        _built[name] = Index(items)
    return _built[name]


def item_blocks(benchmark: DataFrame) -> Iterator[tuple[list[tuple[int, bytes]], bytes]]:
    """The items (item_id, folded text), at most about BLOCK and BLOCK_BYTES at a time, and a name of the block."""
    items = benchmark.where(F.octet_length("text") > 0).select(F.col("item_id").cast("long").alias("item_id"), "text")
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK), -(-size // BLOCK_BYTES))
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        folded = ((r["item_id"], fold(np.frombuffer(r["text"].encode(), np.uint8)).tobytes()) for r in part.collect())
        block = sorted((x for x in folded if x[1].strip(b" ")), key=lambda x: (x[0] is not None, x[0], x[1]))
        yield block, xxhash.xxh3_128_digest(repr(block))


def find(docs: DataFrame, items: list[tuple[int, bytes]], name: bytes, rate: float) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(items)  # bounded by BLOCK_BYTES

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(held.value, name)
        for b in batches:
            ids = b.column(0).to_pylist()
            rows = [(ids[d], index.items[n][0], e, len(index.items[n][1]), at) for d, n, e, at in hits(index, b, rate)]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, kinds)], names=["doc_id", "item_id", "edits", "item_bytes", "at"])

    return docs.mapInArrow(work, RESULT)


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """A row for each document and item of benchmark (item_id, text) that it holds."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = [find(docs, items, name, rate) for items, name in item_blocks(benchmark)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def without_matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of docs, all columns, that hold no item of benchmark."""
    small_batches(docs.sparkSession)
    schema = docs.schema
    for items, name in item_blocks(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(items)

        def work(batches: Iterator[pa.RecordBatch], held=held, name: bytes = name) -> Iterator[pa.RecordBatch]:
            index = _index(held.value, name)
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[h[0] for h in hits(index, b, rate)]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(work, schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
