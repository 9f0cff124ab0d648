"""Operator 7: packing token sequences by a configuration linear program over the histogram of lengths.

Documents are encoded, given an end id and, where longer than a sequence, cut into full pieces with the odd piece
first. What remains to solve is small at any input size: a histogram of at most `capacity` lengths. Its configuration
program (how often to use each multiset of lengths that fits, so that all pieces are covered) is solved by multiplicative
weights: each round prices the lengths by how little of them is covered, a knapsack dynamic program finds the dearest
configuration for each length, and those near the dearest of all are used a little. By the prices of any round no packing
has fewer sequences than the price of all pieces over that of the dearest configuration; the best such bound is kept.

The solution is rounded: configurations are used whole times, most used first, as long as their pieces are there; what is
left is solved and rounded again, until what places the rest, by best fit or by filling up sequences exactly, is within
`NEAR` of the bound, or nothing dear fits. Where long pieces leave no choice, as with many over half a sequence, these two
may do better for all pieces than rounding does; the least is kept. Bounds by sizes (Martello and Toth 1990) stand beside
those of the prices.

Pieces get their places by their rank among the pieces of equal length. A third of all pieces may have one length, so
the rank is not a window over a length: it is the rank within the task that made the piece plus the number of such
pieces in earlier tasks.

Null text counts as empty (one end id); repeated rows are each packed; a null doc_id stays null; an empty table
gives no rows; columns other than doc_id and text are ignored."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import released, small_batches, staged
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
#: Rounds of the first solution, and of those of what rounding has left.
ROUNDS = (40, 10)
#: Over the bound by so much at most, a packing is good enough.
NEAR = 0.0005
RESULT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, drop_space: bool = False) -> DataFrame:
    """The pieces of all documents; part, nth: the task and the rank there among pieces of equal length."""
    small_batches(docs.sparkSession, 2000)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc = TaskContext.get().partitionId(), encoder(tokenizer, drop_space)
        width = enc.dtype.itemsize
        end = end_id.to_bytes(width, "little")
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            ids = [np.frombuffer(x + end, enc.dtype).astype("<u4") for x in enc.encode_many(b.column(1))]
            n = np.array([len(i) for i in ids], np.int64)
            count = -(-n // capacity)
            doc = np.repeat(np.arange(len(ids)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            odd = n - (count - 1) * capacity
            start = np.where(piece == 0, 0, odd[doc] + (piece - 1) * capacity)
            length = np.where(piece == 0, odd[doc], capacity)
            crc = [zlib.crc32(ids[d][s : s + k]) for d, s, k in zip(doc.tolist(), start.tolist(), length.tolist())]
            order = np.argsort(length, kind="stable")
            run = length[order]
            within = np.arange(len(run)) - np.searchsorted(run, run)
            nth = np.empty(len(run), np.int64)
            nth[order] = within + seen[run]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part, np.int32)), pa.array(nth)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(work), PIECES)


def knapsack(lengths: np.ndarray, price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room, the highest price of lengths that fit (unbounded, by dynamic programming) and the length to take
    first (-1: none)."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(int(lengths[0]), capacity + 1):
        total = (price[: upto[c]] + best[c - lengths[: upto[c]]])[::-1]
        j = int(total.argmax())  # of equals the longest: short pieces are kept for the gaps
        best[c] = best[c - 1]
        if total[j] > best[c] * (1 + 1e-12):
            best[c], took[c] = total[j], len(total) - 1 - j
    return best, took


def configurations(lengths: np.ndarray, price: np.ndarray, capacity: int, share: float) -> tuple[list[list[tuple[int, int]]], float]:
    """The dearest configuration with each length, of those that reach a share of the dearest of all, dearest first: pairs
    of a place in lengths and a number; and the dearest price."""
    best, took = knapsack(lengths, price, capacity)
    value = price + best[capacity - lengths]
    first = np.flatnonzero(value >= share * best[capacity])
    first = first[np.argsort(-value[first], kind="stable")]
    # down to the nearest room at which a length is taken
    down = np.maximum.accumulate(np.where(took >= 0, np.arange(capacity + 1), 0))
    of, item = [np.arange(len(first))], [first]
    room = down[capacity - lengths[first]]
    while len(at := np.flatnonzero(room)):
        j = took[room[at]]
        of.append(at)
        item.append(j)
        room[at] = down[room[at] - lengths[j]]
    pair, many = np.unique(np.concatenate(of) * len(lengths) + np.concatenate(item), return_counts=True)
    rows = np.split(np.stack([pair % len(lengths), many], 1), np.searchsorted(pair, np.arange(1, len(first)) * len(lengths)))
    return [list(map(tuple, x)) for x in dict.fromkeys(tuple(map(tuple, r.tolist())) for r in rows)], float(best[capacity])


def fractional(lengths: np.ndarray, count: np.ndarray, capacity: int, price: np.ndarray, rounds: int, gain: float = 0.2, share: float = 0.98) -> tuple[dict[tuple, float], float, np.ndarray]:
    """Multiplicative weights for: as few configurations as cover the counts. Each round uses the dearest configurations
    as far as the counts go, and the price of a length falls by the share of its pieces that they cover; gains fall from
    round to round. Returns the mean use of each configuration (pairs of a place in lengths and a number), a lower bound
    on the number of sequences, and the last prices."""
    used, bound = {}, 0.0
    for r in range(rounds):
        configs, top = configurations(lengths, price, capacity, share)
        bound = max(bound, float((price * count).sum()) / top)
        free = count.astype(float).tolist()
        for c in configs:
            x = min(free[i] / m for i, m in c)
            if x > 0:
                used[key] = used.get(key := tuple(c), 0.0) + x / rounds
                for i, m in c:
                    free[i] -= m * x
        covered = 1.0 - np.array(free) / count
        price = price * np.exp(-gain / (1 + r / 10) * (covered - covered.mean()))
    return used, bound, price


def plan(hist: dict[int, int], capacity: int = 2048) -> tuple[list[tuple[dict[int, int], int]], float]:
    """(configuration, how often), which cover the histogram exactly, and a lower bound on the number of sequences."""
    left = {n: k for n, k in hist.items() if k}
    full = left.pop(capacity, 0)
    out: list[tuple[dict[int, int], int]] = [({capacity: 1}, full)] if full else []
    least = size_bound(left, capacity)
    bound, small, rounds = 0.0, min(left, default=0), ROUNDS[0]
    price = {n: float(n) for n in left}
    while left:
        lengths = np.array(sorted(left), np.int64)
        count = np.array([left[int(n)] for n in lengths])
        used, priced, last = fractional(lengths, count, capacity, np.array([price[int(n)] for n in lengths]), rounds)
        bound, rounds, price = bound or priced, ROUNDS[1], dict(zip(lengths.tolist(), last))  # the first bound is that of all pieces
        placed = 0
        for config, x in sorted(used.items(), key=lambda c: (-c[1], c[0])):
            # whole times; a sequence with room for the smallest piece waits for the next round
            if sum(int(lengths[i]) * m for i, m in config) + small <= capacity:
                continue
            times = min(max(int(x), 1), *(int(count[i]) // m for i, m in config))
            if times > 0:
                out.append(({int(lengths[i]): m for i, m in config}, times))
                placed += times
                for i, m in config:
                    count[i] -= m * times
        left = {int(n): int(k) for n, k in zip(lengths, count) if k}
        rest = best_fit(left, capacity)
        near = lambda rest, bound: number(out + rest) - full <= bound * (1 + NEAR) + 1
        if near(rest, bound):
            return out + rest, full + bound
        bound = max(bound, least)
        if not placed or near(rest, bound) or near(fill(left, capacity), bound):
            break
    else:
        return out, full + bound
    alone = {n: k for n, k in hist.items() if k and n < capacity}
    begun = out[:1] if full else []
    found = [out + rest, out + fill(left, capacity), begun + best_fit(alone, capacity), begun + fill(alone, capacity)]
    return min(found, key=number), full + bound


def number(configs: list[tuple[dict[int, int], int]]) -> int:
    return sum(k for _, k in configs)


def size_bound(hist: dict[int, int], capacity: int) -> float:
    """Least number of sequences for the pieces shorter than one. For any k, pieces over capacity - k stand alone or with
    ones shorter than k; those over a half each take one more; and what is from k to a half fills what these leave."""
    lengths = np.array(sorted(n for n, k in hist.items() if k and n < capacity), np.int64)
    count = np.array([hist[int(n)] for n in lengths], np.int64)
    most = 0
    for k in (0, *lengths[2 * lengths <= capacity].tolist()):
        large, middle, small = lengths > capacity - k, (lengths <= capacity - k) & (2 * lengths > capacity), (lengths >= k) & (2 * lengths <= capacity)
        free = int(((capacity - lengths) * count)[middle].sum())
        most = max(most, int(count[large | middle].sum()) + max(0, -((free - int((lengths * count)[small].sum())) // capacity)))
    return float(most)


def fill(hist: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """The longest piece, then what fills the rest of its sequence best, as often as the pieces are there, and so on. Sums
    that some pieces reach are the bits of a number; adding a piece shifts it."""
    left = {n: k for n, k in hist.items() if k}
    order, out = sorted(left), []
    while order:
        longest = order[-1]
        left[longest] -= 1
        room = capacity - longest
        reach, steps = 1, []
        for n in order:
            if n > room or reach >> room & 1:
                break
            before = reach
            for _ in range(min(left[n], room // n)):
                reach |= (reach << n) & ((1 << room + 1) - 1)
            steps.append((n, before))
        total, config = reach.bit_length() - 1, {longest: 1}
        for n, before in reversed(steps):
            # as many of the longer ones as leave a sum that the shorter ones reach
            m = next(m for m in range(min(left[n], total // n), -1, -1) if before >> (total - m * n) & 1)
            if m:
                config[n] = config.get(n, 0) + m
                total -= m * n
        left[longest] += 1
        times = min(left[n] // m for n, m in config.items())
        out.append((config, times))
        for n, m in config.items():
            left[n] -= m * times
            if not left[n]:
                order.remove(n)
    return out


def best_fit(hist: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit, longest first, for whole groups of equal lengths and equal sequences at once."""
    room: dict[int, list[tuple[dict[int, int], int]]] = {}
    full: list[tuple[dict[int, int], int]] = []
    for n in sorted((n for n, k in hist.items() if k), reverse=True):
        k = hist[n]
        while k:
            at = min((r for r in room if r >= n), default=None)
            if at is None:
                each = capacity // n
                for config, times in (({n: each}, k // each), ({n: k % each}, 1)):
                    if times and config[n]:
                        room.setdefault(capacity - n * config[n], []).append((config, times))
                k = 0
                continue
            config, times = room[at].pop()
            if not room[at]:
                del room[at]
            # as many of this length as fit into each, in as many of the sequences as it takes
            each = min(at // n, k)
            now = min(times, k // each)
            if now < times:
                room.setdefault(at, []).append((config, times - now))
            grown = config | {n: config.get(n, 0) + each}
            k -= each * now
            (full.append((grown, now)) if at == each * n else room.setdefault(at - each * n, []).append((grown, now)))
    return full + [g for groups in room.values() for g in groups]


def places(configs: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, pieces of this length in a sequence, their first offset)."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    rank: dict[int, int] = {}
    base = 0
    for config, times in configs:
        at = 0
        for n in sorted(config, reverse=True):
            out.setdefault(n, []).append((rank.get(n, 0), base, config[n], at))
            rank[n] = rank.get(n, 0) + times * config[n]
            at += n * config[n]
        base += times
    return {n: np.array(rows, np.int64).T for n, rows in out.items()}


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, drop_space: bool = False) -> DataFrame:
    """A row for each piece with its sequence and its offset there."""
    cut = staged(pieces(docs, tokenizer, capacity, end_id, drop_space), "pieces")
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = staged(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "counts")
    hist = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    where = places(plan(hist, capacity)[0])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = np.asarray(b.column("length"))
            rank = np.asarray(b.column("nth")) + np.asarray(b.column("base"))
            seq, off = np.empty_like(rank), np.empty_like(rank)
            order = np.argsort(length, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(at):
                    n = int(length[at[0]])
                    first, base, each, offset = where[n]
                    k = np.searchsorted(first, rank[at], side="right") - 1
                    j = rank[at] - first[k]
                    seq[at], off[at] = base[k] + j // each[k], offset[k] + j % each[k] * n
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    # the counts grow with the tasks: never broadcast
    return cut.join(counts.select("part", "length", "base").hint("merge"), ["part", "length"]).mapInArrow(work, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
