"""Operator 3: a quality score by a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): all pairwise interactions in
time linear in the features of a text. Words weigh 1 + log(count), each text's words are scaled to length one; the
structure statistics and the metadata (numeric columns, named by the caller) fall into hashed bands, so that they meet
the words and one another in the interactions.

The model is fitted on the driver on at most `max_train` labelled rows (picked by a hash of their doc_id; features of
whole texts are collected, one for each distinct word), and rides to the executors as arrays of fixed
size. Scoring is one pass without a shuffle over whole texts.

Null and empty texts have only structure features and get a score; labels outside 0 and 1 and null labels are not
learned; repeated rows and null doc_ids are scored like others; an empty table gives no rows; without labels of both
kinds every score is the
share of label 1 (0.5 without any)."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import bounded_sample, small_batches

WORD_BUCKETS = 1 << 14
BANDS = 1 << 10
SIZE = WORD_BUCKETS + BANDS
RANK = 8
RESULT = "doc_id long, held_out boolean, score double, predicted int"

_memo: dict[str, int] = {}


def _bucket(word: str) -> int:
    if len(_memo) > 300_000:
        _memo.clear()
    got = _memo.get(word)
    if got is None:
        got = _memo[word] = zlib.crc32(word.encode()) % WORD_BUCKETS
    return got


def structure(text: str, words: list[str], counts: Counter) -> dict[str, float]:
    """Statistics of the whole text, each in 0 to 1."""
    n, k = len(text), len(words)
    raw = text.encode()
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = text.split("\n")
    letters = int(byte[65:91].sum() + byte[97:123].sum() + byte[194:].sum())
    m = max(n, 1)
    share = byte[byte > 0] / max(len(raw), 1)
    return {
        "length": min(np.log1p(n) / 14, 1.0), "words": min(np.log1p(k) / 12, 1.0), "distinct": len(counts) / max(k, 1), "top": counts.most_common(1)[0][1] / k if k else 0.0,
        "letters": min(letters / m, 1.0), "digits": min(byte[48:58].sum() / m, 1.0), "upper": min(byte[65:91].sum() / m, 1.0), "spaces": min(byte[32] / m, 1.0),
        "stops": min(10 * byte[46] / m, 1.0), "commas": min(10 * byte[44] / m, 1.0), "bars": min(5 * byte[124] / m, 1.0), "symbols": min(3 * (byte[33] + byte[35:39].sum() + byte[42] + byte[64] + byte[94]) / m, 1.0),
        "lines": min(10 * len(lines) / m, 1.0), "repeated": 1 - len(set(lines)) / len(lines), "word_size": min(n / max(k, 1) / 20, 1.0), "entropy": float(-(share * np.log2(share)).sum() / 8) if n else 0.0,
    }


def features(text: str | None, meta: dict[str, float | None]) -> tuple[np.ndarray, np.ndarray]:
    text = text or ""
    words = text.split()
    counts = Counter(words)
    idx = [_bucket(w) for w in counts]
    val = 1 + np.log(np.fromiter(counts.values(), float, len(counts)))
    if len(val):
        val /= np.sqrt((val**2).sum())
    stats = structure(text, words, counts) | {f"meta {k}": min(abs(v) ** 0.25 / 32, 1.0) if v is not None else -1.0 for k, v in meta.items()}
    for name, v in stats.items():
        # the two bands that a value lies between, each in proportion, so that small steps change little
        x = max(v, -1.0) * 16
        low = int(np.floor(x))
        for band, weight in ((low, 1 - (x - low)), (low + 1, x - low)):
            if weight > 0:
                idx.append(WORD_BUCKETS + zlib.crc32(f"{name} {band}".encode()) % BANDS)
                val = np.append(val, 0.5 * weight)
    return np.array(idx, np.int32), val.astype(np.float32)


def scores(model: dict, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    if "constant" in model:
        return np.full(len(rows), model["constant"])
    idx, val = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    at = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])])[:-1]
    vx = model["v"][idx] * val[:, None]
    linear = np.add.reduceat(model["w"][idx] * val, at)
    pairs = 0.5 * (np.add.reduceat(vx, at) ** 2 - np.add.reduceat(vx**2, at)).sum(1)
    return 1 / (1 + np.exp(-np.clip(model["w0"] + linear + pairs, -30, 30).astype(float)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.05, decay: float = 1e-5, seed: int = 7) -> dict:
    """Adaptive gradient steps on the log loss; rows of the rarer label weigh more, up to threefold."""
    labels = labels.astype(np.float32)
    if len(set(labels.tolist())) < 2:
        return {"constant": float(labels.mean()) if len(labels) else 0.5}
    rng = np.random.default_rng(seed)
    w, v, w0 = np.zeros(SIZE, np.float32), rng.normal(0, 0.03, (SIZE, RANK)).astype(np.float32), 0.0
    gw, gv, g0 = np.full(SIZE, 1e-6, np.float32), np.full((SIZE, RANK), 1e-6, np.float32), 1e-6
    rare = min(labels.mean(), 1 - labels.mean())
    boost = min(3.0, (1 - rare) / rare)
    rarer = float(labels.mean() < 0.5)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), batch):
            part = order[k : k + batch]
            idx, val = np.concatenate([rows[i][0] for i in part]), np.concatenate([rows[i][1] for i in part])
            size = np.array([len(rows[i][0]) for i in part])
            at, of = np.cumsum(size) - size, np.repeat(np.arange(len(part)), size)
            vx = v[idx] * val[:, None]
            s = np.add.reduceat(vx, at)
            z = w0 + np.add.reduceat(w[idx] * val, at) + 0.5 * (s**2 - np.add.reduceat(vx**2, at)).sum(1)
            y = labels[part]
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * np.where(y == rarer, boost, 1.0) / len(part)
            used, inv = np.unique(idx, return_inverse=True)
            step_w = np.bincount(inv, d[of] * val, len(used)).astype(np.float32) + decay * w[used]
            each = (d[of] * val)[:, None] * (s[of] - vx)
            step_v = np.stack([np.bincount(inv, each[:, f], len(used)) for f in range(RANK)], 1).astype(np.float32) + decay * v[used]
            gw[used] += step_w**2
            gv[used] += step_v**2
            w[used] -= rate * step_w / np.sqrt(gw[used])
            v[used] -= rate * step_v / np.sqrt(gv[used])
            g0 += float(d.sum()) ** 2
            w0 -= rate * float(d.sum()) / np.sqrt(g0)
    return {"w0": w0, "w": w, "v": v}


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", metadata: tuple[str, ...] = ("n_chars",), max_train: int = 6000) -> dict:
    """A model from the rows of docs that labels (doc_id, label) marks. The labelled ids are picked first, so that only
    a bounded table is joined to the documents; it is broadcast, at most max_train rows of two numbers."""
    small_batches(docs.sparkSession)
    cols = [text, label, *metadata]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [b.column(i).to_pylist() for i in range(len(cols))]
            rows = []
            for k in range(b.num_rows):
                idx, val = features(got[0][k], {m: got[2 + i][k] for i, m in enumerate(metadata)})
                rows.append((int(got[1][k]), idx.tobytes(), val.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["label", "idx", "val"])

    known = bounded_sample(labels.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias(label)), max_train, "doc_id")
    seen = docs.select("doc_id", text, *(F.col(m).cast("double").alias(m) for m in metadata)).join(F.broadcast(known), "doc_id").select(text, label, *metadata)
    got = seen.mapInArrow(work, "label int, idx binary, val binary").collect()
    got.sort(key=lambda r: (bytes(r["idx"]), bytes(r["val"]), r["label"]))  # the same model whatever the order of tasks
    return fit([(np.frombuffer(r["idx"], np.int32), np.frombuffer(r["val"], np.float32)) for r in got], np.array([r["label"] for r in got]))


def score(docs: DataFrame, model: dict, text: str = "text", metadata: tuple[str, ...] = ("n_chars",), held: Column | None = None) -> DataFrame:
    """doc_id, held_out (held, a flag of docs' columns; false by default), score and predicted."""
    small_batches(docs.sparkSession)
    held = F.lit(False) if held is None else F.coalesce(held, F.lit(False))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            got = [b.column(i).to_pylist() for i in range(2, 3 + len(metadata))]
            rows = [features(got[0][k], {m: got[1 + i][k] for i, m in enumerate(metadata)}) for k in range(b.num_rows)]
            s = scores(model, rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), text, *(F.col(m).cast("double").alias(m) for m in metadata)).mapInArrow(work, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held))
    return score(docs, model, held=held)
