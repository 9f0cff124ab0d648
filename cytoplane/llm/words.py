"""Runs of letters in texts, for the operators that count words: whole texts a few MB at a time, in numpy and Arrow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ._shared import texts_of

BLOCK = 6_000_000


def blocks(batches: Iterator[pa.RecordBatch], *columns: str, most: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, list[pa.Array]]]:
    """The texts of some batches at a time: their bytes, their n + 1 offsets, and the other columns. A block ends at about
    `most` bytes; a longer text is in a block whole."""
    held: list[tuple[np.ndarray, np.ndarray, list[pa.Array]]] = []
    size = 0

    def joined() -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
        ends = np.cumsum([len(r) for r, _, _ in held])
        off = np.concatenate([[0], *(o[1:] + e - len(r) for (r, o, _), e in zip(held, ends))]).astype(np.int64)
        return np.concatenate([r for r, _, _ in held]), off, [pa.concat_arrays([c[k] for _, _, c in held]) for k in range(len(columns))]

    for b in batches:
        raw, off = texts_of(b)
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most - size, side="right")) - 1)
            held.append((raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], [b.column(b.schema.get_field_index(c))[lo:hi] for c in columns]))
            size += int(off[hi] - off[lo])
            lo = hi
            if size >= most:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def runs(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """values has 0 between runs, and a run never crosses an offset. The values of all runs end to end, the n + 1 places
    where the runs begin among these, and the row of each run."""
    inside = values != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = off[:-1][off[:-1] < len(values)]
    begins[first] |= inside[first]
    before = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])[off]
    at = np.flatnonzero(begins[inside])
    return values[inside], np.append(at, before[-1]), np.searchsorted(before, at, side="right") - 1


def coded(letters: np.ndarray, at: np.ndarray, kind: pa.DataType) -> tuple[pa.Array, np.ndarray]:
    """The distinct runs, of type large_string or large_binary, and the number of each run among them."""
    got = pa.Array.from_buffers(kind, len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(letters))]).dictionary_encode()
    return got.dictionary, np.asarray(got.indices).astype(np.int64)


def tallied(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how many there are of each, or the sum of their weights."""
    order = np.argsort(keys, kind="stable") if weights is not None else None
    keys = np.sort(keys) if order is None else keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    if weights is None:
        return keys[first], np.diff(np.append(first, len(keys)))
    return keys[first], np.add.reduceat(weights[order], first) if len(keys) else weights[:0]
