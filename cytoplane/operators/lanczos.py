"""Singular vectors of a large sparse matrix by block Lanczos bidiagonalisation with thick restarts.

The matrix A is cells by genes, centred and scaled by gene without ever being filled in. One pass over the packed rows
gives A'A Y for a block of some vectors over the genes: tasks multiply their rows, and send sums of genes times block.
Left vectors are as long as there are cells; they are never made. Each is A y for a known combination y of genes, and the
scalar products that the bidiagonalisation needs follow from the pass. Right vectors are kept orthogonal to all before
them, twice over. When the subspace is full, it is cut down to the leading vectors and goes on from there.

In the driver's memory are the vectors of two or three blocks, whatever the number of cells and of vectors; the others are in
files of its own where they are large (see Columns). No table of genes by genes is anywhere."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .packed import flat_lists, stretches

#: Genes of a row of sums that tasks send.
PIECE = 512
#: Sums of a pass that go to the driver from each task; more are added up on the executors first.
DIRECT_BYTES = 32 << 20
MULTIPLIED = 100_000
#: The subspace has up to so many vectors where they stay within so many bytes of files: values that lie close together
#: take a multiple of the passes, or never part, in a small one.
SUBSPACE, SUBSPACE_BYTES = 200, 2 << 30
#: Vectors that stay in memory, and what is read of the others at a time.
KEPT_BYTES, READ_BYTES = 16 << 20, 8 << 20


class Columns:
    """Vectors over the genes, block after block. Those beyond KEPT_BYTES are in files without a name, which end with the
    object, and are read a stretch of genes at a time."""

    def __init__(self, genes: int) -> None:
        self.genes, self.width, self.blocks = genes, 0, []

    def extend(self, width: int, parts: Iterable[np.ndarray]) -> Columns:
        """Adds a block of vectors, given as stretches of genes one after another."""
        if (self.width + width) * self.genes * 8 > KEPT_BYTES:
            block = tempfile.TemporaryFile()
            for x in parts:
                block.write(np.ascontiguousarray(x).data)
            block.flush()
        else:
            block = np.vstack(list(parts))
        self.blocks.append((width, block))
        self.width += width
        return self

    def _stretches(self) -> Iterator[tuple[slice, np.ndarray]]:
        step = max(1, READ_BYTES // (8 * max(self.width, 1)))
        for lo in range(0, self.genes, step):
            at = slice(lo, min(lo + step, self.genes))
            parts = []
            for width, block in self.blocks:
                if not isinstance(block, np.ndarray):
                    block.seek(lo * width * 8)
                    parts.append(np.fromfile(block, np.float64, (at.stop - lo) * width).reshape(-1, width))
                else:
                    parts.append(block[at])
            yield at, np.hstack(parts)

    def dots(self, w: np.ndarray) -> np.ndarray:
        return sum((x.T @ w[at] for at, x in self._stretches()), np.zeros((self.width, w.shape[1])))

    def times(self, c: np.ndarray) -> np.ndarray:
        out = np.empty((self.genes, c.shape[1]))
        for at, x in self._stretches():
            out[at] = x @ c
        return out

    def subtract(self, w: np.ndarray, c: np.ndarray) -> None:
        """w -= self c, in place."""
        for at, x in self._stretches():
            w[at] -= x @ c

    def turned(self, c: np.ndarray, plus: np.ndarray | None = None) -> Columns:
        """self c, and what is to be added."""
        return Columns(self.genes).extend(c.shape[1], (x @ c if plus is None else plus[at] + x @ c for at, x in self._stretches()))

    def last(self) -> Columns:
        """The last block."""
        out = Columns(self.genes)
        out.width, out.blocks = self.blocks[-1][0], self.blocks[-1:]
        return out


def _dot(t: pa.RecordBatch, y: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches of rows: their products with y, their entries' places and values."""
    (at, off), values = flat_lists(t.column("indices")), flat_lists(t.column("values"))[0].astype(np.float64)
    for lo, hi in stretches(off, MULTIPLIED):
        part = slice(off[lo], off[hi])
        out = np.zeros((hi - lo, y.shape[1]))
        full = np.flatnonzero(np.diff(off[lo : hi + 1]))
        if len(full):
            out[full] = np.add.reduceat(y[at[part]] * values[part, None], off[lo:hi][full] - off[lo], axis=0)
        yield lo, hi, out, at[part], values[part]


def normal_product(rows: DataFrame, y: np.ndarray, mean: np.ndarray, scale: np.ndarray, cells: int) -> np.ndarray:
    """A'A y for A = (X - mean) scale. rows: (indices, values), a row for each cell that has entries; indices are places
    of genes. Cells without a row are all zeros."""
    g, b = y.shape
    y = y * scale[:, None]
    shift = mean @ y
    sent = rows.sparkSession.sparkContext.broadcast(y)
    del y  # tasks have it from a file

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((g + 1, b)), 0
        for t in batches:
            for lo, hi, s, at, values in _dot(t, sent.value):
                s -= shift
                n += hi - lo
                total[g] += s.sum(0)
                if len(at):
                    size = np.diff(np.asarray(t.column("indices").offsets)[lo : hi + 1])
                    order = np.argsort(at, kind="stable")
                    first = np.flatnonzero(np.concatenate([[True], np.diff(at[order]) > 0]))
                    total[at[order[first]]] += np.add.reduceat(s[np.repeat(np.arange(hi - lo), size)[order]] * values[order, None], first, axis=0)
        pieces = range(0, g + 1, PIECE)
        yield pa.RecordBatch.from_arrays([pa.array(list(pieces)), pa.array([n] + [0] * (len(pieces) - 1)), pa.array([total[k : k + PIECE].tobytes() for k in pieces], pa.binary())], names=["k", "n", "s"])

    def add(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, 0.0
        for t in parts:
            n += sum(t.column("n").to_pylist())
            s = s + sum(np.frombuffer(x) for x in t.column("s").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([n]), pa.array([s.tobytes()], pa.binary())], names=["k", "n", "s"])

    kinds = "k long, n long, s binary"
    sums = rows.select("indices", "values").mapInArrow(work, kinds)
    if rows.rdd.getNumPartitions() * (g + 1) * b * 8 > DIRECT_BYTES:
        sums = sums.groupBy("k").applyInArrow(add, kinds)
    total, n = np.zeros((g + 1, b)), 0
    for t in sums.toArrow().to_batches():
        n += sum(t.column("n").to_pylist())
        for k, s in zip(t.column("k").to_pylist(), t.column("s")):
            piece = np.frombuffer(s.as_buffer()).reshape(-1, b)
            total[k : k + len(piece)] += piece
    sent.destroy()
    pa.default_memory_pool().release_unused()
    ones = total[g] - (cells - n) * shift  # an empty cell's row of A y is -shift
    for j in range(b):
        total[:g, j] = (total[:g, j] - mean * ones[j]) * scale
    return total[:g]


def _triangle(w: np.ndarray) -> np.ndarray:
    """r of w = q r with q orthonormal, without q: of stretches, and of their triangles."""
    step = max(w.shape[1], READ_BYTES // (8 * max(w.shape[1], 1)))
    return np.linalg.qr(np.vstack([np.linalg.qr(w[k : k + step], mode="r") for k in range(0, len(w), step)]), mode="r")


def _orthogonal(w: np.ndarray, v: Columns, least: float) -> tuple[np.ndarray, np.ndarray]:
    """w = q s with q orthonormal and orthogonal to v; directions of w that are shorter than least are left out. w is
    written over."""
    for _ in range(2):
        v.subtract(w, v.dots(w))
    _, d, t = np.linalg.svd(_triangle(w), full_matrices=False)
    s = d[d > least, None] * t[d > least]
    w = w @ (t[d > least].T / d[d > least])
    # the shorter a direction was, the more of the others and of v it still has
    for _ in range(2 if len(s) else 0):
        v.subtract(w, v.dots(w))
        r = _triangle(w)
        w, s = w @ np.linalg.inv(r), r @ s
    return w, s


def singular_vectors(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, cells: int, k: int, block: int | None = None, subspace: int | None = None, tolerance: float = 1e-9, max_passes: int = 500, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The k largest singular values of A and their right vectors (genes by k), fewer if A has fewer. Stops when the
    residual of each is below tolerance times the largest value; RuntimeError if max_passes don't get there."""
    g = len(mean)
    block = block or max(2, min(24, k))
    subspace = max(subspace or max(3 * k + 2 * block, min(SUBSPACE, SUBSPACE_BYTES // (8 * max(g, 1)))), k + 2 * block)
    v = np.random.default_rng(seed).normal(size=(g, min(block, g)))
    v = v @ np.linalg.inv(_triangle(v)) if len(v) else v
    every = Columns(g).extend(v.shape[1], [v])  # all right vectors
    b = np.zeros((0, v.shape[1]))  # left by right vectors
    guess = every.last()  # the last block without what of its image the left vectors so far have
    del v
    largest = 0.0
    for _ in range(max_passes):
        z = normal_product(rows, guess.times(np.eye(guess.width)), mean, scale, cells)
        gram = guess.dots(z)
        size, turn = np.linalg.eigh((gram + gram.T) / 2)
        keep = size > max(1e-24, 1e-14 * max(largest**2, size.max(initial=0.0)))
        length = np.sqrt(size[keep])
        r, back = length[:, None] * turn[:, keep].T, turn[:, keep] / length
        left = guess.turned(back)  # its images are the new left vectors
        # the image of the last block: what of it the left vectors so far have, and r of the new ones
        b = np.vstack([b, np.hstack([np.zeros((len(r), b.shape[1] - guess.width)), r])])
        w = z @ back
        del z
        every.last().subtract(w, r.T)
        u, sizes, vt = np.linalg.svd(b, full_matrices=False)
        largest = max(largest, sizes.max(initial=0.0))
        new, s = _orthogonal(w, every, 1e-13 * max(largest, 1e-300))
        del w
        top = min(k, len(sizes))
        if not new.shape[1] and len(r) and top < k and every.width < g:
            # an invariant subspace that is too small: go on with directions of chance
            new = _orthogonal(np.random.default_rng(seed + every.width).normal(size=(g, min(block, g - every.width))), every, 1e-6)[0]
            s = np.zeros((new.shape[1], len(r)))
        done = not new.shape[1]
        far = np.linalg.norm(s @ u[len(b) - len(r) :, :top], axis=0) if len(r) and not done else np.zeros(top)
        if done or top == k and (far <= tolerance * largest).all():
            return sizes[:top], every.times(vt[:top].T)
        if every.width + new.shape[1] > subspace:
            # keep some leading vectors; what is new is linked to all of them. Left ones are images of right ones by value
            hold = min(k + block, int((sizes > 1e-7 * largest).sum()))
            link = s @ u[len(b) - len(r) :, :hold]
            every = every.turned(vt[:hold].T)
            b = np.hstack([np.diag(sizes[:hold]), link.T])
            guess = every.turned(-(link / sizes[:hold]).T, new)
        else:
            b = np.hstack([b, np.vstack([np.zeros((len(b) - len(r), new.shape[1])), s.T])])
            guess = left.turned(-s.T, new)
        every.extend(new.shape[1], [new])
        del left, new
    raise RuntimeError(f"not converged after {max_passes} passes")


def project(rows: DataFrame, vectors: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> DataFrame:
    """(row_id, value): A times the vectors, for the rows (major, indices, values) that there are."""
    ys = vectors * scale[:, None]
    shift = mean @ ys
    sent = rows.sparkSession.sparkContext.broadcast(ys)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for lo, hi, s, _, _ in _dot(t, sent.value):
                yield pa.RecordBatch.from_arrays([t.column("major")[lo:hi], pa.array(list((s - shift).astype(np.float32)), pa.list_(pa.float32()))], names=["row_id", "value"])

    return rows.select("major", "indices", "values").mapInArrow(work, "row_id long, value array<float>")
