"""Operator 6: binary media columns. PNG files in a column are read through their chunks, checksums and row filters into
samples, and described by a hash of their low cosine frequencies.

encode() writes an 8-bit greyscale PNG, choosing for each row the filter (none, sub or up) of least absolute sum;
decode() reads greyscale, grey with alpha, RGB and RGBA of 8 bits with all five filters, and raises ValueError on a bad
signature, checksum, chunk order, size or filter. feature() is a 64-bit hash: the picture is averaged onto a 32 x 32
grid, and each of the 8 x 8 lowest cosine frequencies gives one bit, whether it exceeds their median.

No row needs another, so the operator is one pass without a shuffle. Null text counts as empty and its payload is 192
spaces; repeated rows give equal values; an empty table gives no rows; a null doc_id stays null; columns other than
doc_id and text are ignored."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import small_batches

# Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}

RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
WIDTH = 192


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(payload: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    """payload, a positive multiple of width, as the samples of a greyscale picture of that width."""
    if not payload or len(payload) % width:
        raise ValueError("the payload must be a positive multiple of the width")
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    tried = np.empty((3, *rows.shape), np.uint8)
    tried[0] = rows
    tried[1, :, 0], tried[1, :, 1:] = rows[:, 0], rows[:, 1:] - rows[:, :-1]
    tried[2, 0], tried[2, 1:] = rows[0], rows[1:] - rows[:-1]
    cost = np.abs(tried.view(np.int8).astype(np.int16)).sum(2)
    pick = cost.argmin(0)
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0] = pick
    lines[:, 1:] = tried[pick, np.arange(len(rows))]
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + chunk(b"IEND", b"")


def decode(png: bytes) -> np.ndarray:
    """The samples: height x width x channels."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, parts, ended = 8, None, [], False
    while at < len(png) and not ended:
        if at + 12 > len(png):
            raise ValueError("a chunk is cut off")
        n, kind = struct.unpack_from(">I4s", png, at)
        body = png[at + 8 : at + 8 + n]
        if len(body) != n or png[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError("a chunk is damaged")
        if (head is None) != (kind == b"IHDR"):
            raise ValueError("IHDR must come first, and once")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        ended, at = kind == b"IEND", at + 12 + n
    if not ended or head is None:
        raise ValueError("no IEND")
    width, height, depth, colour, packing, filtering, interlace = head
    if depth != 8 or colour not in CHANNELS or packing or filtering or interlace:
        raise ValueError("unsupported kind of PNG")
    bpp = CHANNELS[colour]
    raw = zlib.decompress(b"".join(parts))
    if len(raw) != height * (1 + width * bpp):
        raise ValueError("wrong number of samples")
    lines = np.frombuffer(raw, np.uint8).reshape(height, -1)
    return unfilter(lines[:, 0], lines[:, 1:], bpp).reshape(height, width, bpp)


def unfilter(kinds: np.ndarray, lines: np.ndarray, bpp: int) -> np.ndarray:
    """Undoes the row filters: sub by running sums along rows, up by running sums down a stretch of such rows."""
    if kinds.size and kinds.max() > 4:
        raise ValueError("unknown filter")
    out = lines.copy()
    sub = kinds == 1
    if sub.any():
        part = out[sub].reshape(int(sub.sum()), -1, bpp)
        out[sub] = np.cumsum(part, axis=1, dtype=np.uint8).reshape(len(part), -1)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (kinds == 2).view(np.int8), [0]])))
    runs = dict(zip(edges[::2].tolist(), edges[1::2].tolist()))
    for r in sorted([*runs, *np.flatnonzero(kinds > 2).tolist()]):
        up = out[r - 1] if r else np.zeros(out.shape[1], np.uint8)
        if r in runs:
            out[r : runs[r]] = np.cumsum(np.vstack([up[None], out[r : runs[r]]]), axis=0, dtype=np.uint8)[1:]
            continue
        line = out[r].tolist()
        above = up.tolist()
        for i in range(len(line)):
            a, b, c = line[i - bpp] if i >= bpp else 0, above[i], above[i - bpp] if i >= bpp else 0
            if kinds[r] == 3:
                guess = (a + b) // 2
            else:
                p = a + b - c
                guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line[i] = (line[i] + guess) & 255
        out[r] = line
    return out


def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi * np.outer(np.arange(k), np.arange(n) + 0.5) / n)


_BASIS = _cosines(32, 8)


def _averages(x: np.ndarray, n: int) -> np.ndarray:
    """Means of n near-equal stretches along the first axis; with fewer rows than n, rows repeat."""
    edges = np.arange(n + 1) * len(x) // n
    low, high = np.minimum(edges[:-1], len(x) - 1), np.maximum(edges[1:], np.minimum(edges[:-1], len(x) - 1) + 1)
    sums = np.vstack([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0, dtype=np.float64)])
    return (sums[high] - sums[low]) / (high - low)[:, None]


def feature(samples: np.ndarray) -> str:
    grey = samples[..., 0] if samples.shape[2] < 3 else samples[..., :3].mean(2)
    small = _averages(_averages(grey, 32).T, 32).T
    low = _BASIS @ small @ _BASIS.T
    # rounded, so that the bits do not hang on the last place of a float
    low = np.round(low, 6).ravel()
    return f"{int(''.join('1' if b else '0' for b in low > np.median(low[1:])), 2):016x}"


def payload_of(raw: bytes, unit: int = WIDTH) -> bytes:
    return raw + b" " * (max(unit, -(-len(raw) // unit) * unit) - len(raw))


def with_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): the texts' bytes as a binary column of PNG files."""
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [(t or "").encode() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array([encode(payload_of(r)) for r in raw], pa.binary())], names=[key, "n_bytes", "media"])

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(work, f"{key} long, n_bytes long, media binary")


def describe_media(media: DataFrame) -> DataFrame:
    """RESULT of (doc_id, n_bytes, media): each file decoded, its samples hashed and described. A file that is null or
    damaged has nulls for what can't be known of it, and says why in `error`, which is null for the others."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, n, png in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                stored = (None, None) if png is None else (len(png), hashlib.sha256(png).hexdigest())
                try:
                    if png is None:
                        raise ValueError("no file")
                    samples = decode(png)
                except (ValueError, struct.error, zlib.error, IndexError) as e:
                    rows.append((doc_id, n, None, None, None, *stored, None, str(e) or type(e).__name__))
                    continue
                back = samples.tobytes()
                rows.append((doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), *stored, feature(samples), None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 9, kinds)], names=names)

    return media.mapInArrow(work, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe_media(with_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
