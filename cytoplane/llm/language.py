"""Operator 1: language of a text by a bidirectional gated recurrent network over its bytes.

Two gated recurrent units read each window of bytes, one from either end; at every position their states give
probabilities of the languages. A document's probabilities are the means over all its positions. Whole texts are read,
as windows of `WINDOW` bytes that each start from a zero state, thousands side by side.

The network is trained here, in numpy, by backpropagation through time, on windows that cover the whole texts of at most
`max_train` labelled rows, of each language alike; these rows' windows come to the driver. It is a few thousand numbers and
rides to the executors in the task; a document needs no other, so prediction is one pass without a shuffle.

Columns of the table other than the text, such as one named held_out, are never read. Null text and text without a letter give `und` with score 0; rows without a language are not learned; repeated rows
and null doc_ids are predicted like others; an empty table gives no rows; without any labelled row all is `und`."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import released, small_batches, stratified_sample, texts_of

WINDOW, SIDE = 128, 2048
HIDDEN = 8
RESULT = "doc_id long, held_out boolean, lang_pred string, score double"


def gates(x: np.ndarray, h: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step: x has the byte's input to the three gates (update, reset, candidate), h the state before."""
    n = h.shape[1]
    hu = h @ u
    zr = x[:, : 2 * n] + hu[:, : 2 * n]
    zr *= 0.5
    np.tanh(zr, out=zr)
    zr *= 0.5
    zr += 0.5
    z, r = zr[:, :n], zr[:, n:]
    c = np.tanh(x[:, 2 * n :] + r * hu[:, 2 * n :])
    return h + z * (c - h), z, r, c, hu


def train(windows: np.ndarray, labels: np.ndarray, classes: int, hidden: int = HIDDEN, steps: int = 260, batch: int = 128, rate: float = 0.02, seed: int = 3) -> dict:
    """windows: n x T bytes. Cross-entropy at every position, Adam, gradients by backpropagation through time."""
    rng = np.random.default_rng(seed)
    p = {}
    for d in "fb":
        p[f"e{d}"] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
        p[f"u{d}"] = rng.normal(0, 0.3, (hidden, 3 * hidden)).astype(np.float32)
        p[f"o{d}"] = rng.normal(0, 0.3, (hidden, classes)).astype(np.float32)
    p["bias"] = np.zeros(classes, np.float32)
    m, s = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    groups = [np.flatnonzero(labels == c) for c in range(classes)]
    T, n = windows.shape[1], hidden
    for step in range(1, steps + 1):
        # each language alike often
        pick = np.concatenate([rng.choice(g, -(-batch // classes)) for g in groups if len(g)])
        x, y = windows[pick].T, labels[pick]
        trace, states = {}, {}
        for d, seq in (("f", range(T)), ("b", range(T - 1, -1, -1))):
            h, trace[d], states[d] = np.zeros((len(pick), n), np.float32), [], np.empty((T, len(pick), n), np.float32)
            for t in seq:
                before = h
                h, *rest = gates(p[f"e{d}"][x[t]], h, p[f"u{d}"])
                trace[d].append((t, before, *rest))
                states[d][t] = h
        logits = states["f"] @ p["of"] + states["b"] @ p["ob"] + p["bias"]
        q = np.exp(logits - logits.max(2, keepdims=True))
        q /= q.sum(2, keepdims=True)
        q[:, np.arange(len(pick)), y] -= 1
        q /= T * len(pick)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["bias"] = q.sum((0, 1))
        for d in "fb":
            g[f"o{d}"] = np.einsum("tbn,tbc->nc", states[d], q)
            back = q @ p[f"o{d}"].T
            dh = np.zeros((len(pick), n), np.float32)
            for t, h, z, r, c, hu in reversed(trace[d]):
                dh = dh + back[t]
                da_c = dh * z * (1 - c * c)
                da_z = dh * (c - h) * z * (1 - z)
                da_r = da_c * hu[:, 2 * n :] * r * (1 - r)
                d_hu = np.concatenate([da_z, da_r, da_c * r], 1)
                np.add.at(g[f"e{d}"], x[t], np.concatenate([da_z, da_r, da_c], 1))
                g[f"u{d}"] += h.T @ d_hu
                dh = dh * (1 - z) + d_hu @ p[f"u{d}"].T
        norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
        for k, v in g.items():
            v *= min(1.0, 1.0 / (norm + 1e-9))
            m[k] += 0.1 * (v - m[k])
            s[k] += 0.01 * (v * v - s[k])
            p[k] -= rate * (1 - 0.7 * step / steps) * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)
    return p


def probabilities(p: dict, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of the position probabilities of each document: documents x languages."""
    size = np.diff(off)
    count = -(-size // WINDOW)
    doc = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = off[:-1][doc] + nth * WINDOW
    length = np.minimum(WINDOW, off[1:][doc] - start)
    order = np.argsort(-length, kind="stable")
    classes, n = len(p["bias"]), p["uf"].shape[0]
    total = np.zeros((len(size), classes))
    for k in range(0, len(order), SIDE):
        at = order[k : k + SIDE]
        st, ln = start[at], length[at]
        most, whole = int(ln[0]), int((ln == WINDOW).sum())
        active = np.searchsorted(-ln, -np.arange(most), side="left")  # windows longer than t
        states = np.zeros((2, most, len(at), n), np.float32)
        for d in (0, 1):
            e, u = p["ef" if d == 0 else "eb"], p["uf" if d == 0 else "ub"]
            h = np.zeros((len(at), n), np.float32)
            for t in range(most):
                a = int(active[t])
                place = st[:a] + t if d == 0 else st[:a] + ln[:a] - 1 - t
                h[:a] = gates(e[raw[place]], h[:a], u)[0]
                if d == 0:
                    states[0, t, :a] = h[:a]
                else:
                    states[1, most - 1 - t, : min(whole, a)] = h[: min(whole, a)]
                    if a > whole:
                        states[1, ln[whole:a] - 1 - t, np.arange(whole, a)] = h[whole:a]
        logits = states[0].reshape(-1, n) @ p["of"]
        logits += states[1].reshape(-1, n) @ p["ob"]
        logits += p["bias"]
        np.exp(logits, out=logits)
        logits /= logits.sum(1, keepdims=True)
        q = logits.reshape(most, len(at), classes)
        if whole < len(at):
            q[np.arange(most)[:, None] >= ln[None, :]] = 0
        np.add.at(total, doc[at], q.sum(0, dtype=np.float64))
    return total


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", max_train: int = 2500, length: int = 64) -> dict | None:
    """A network and its languages from at most max_train labelled rows of docs, all of their texts."""
    small_batches(docs.sparkSession)
    seen = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select("doc_id", text, lang)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = texts_of(b, text)
            out: list[tuple[str, bytes]] = []
            for k, name in enumerate(b.column(1).to_pylist()):
                n = int(off[k + 1] - off[k])
                body = raw[off[k] : off[k + 1]].tobytes()
                most = -(-n // length)
                for w in range(most):
                    at = (n - length) * w // (most - 1) if most > 1 else 0
                    out.append((name, body[at : at + length].ljust(length, b" ")))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.binary())], names=["lang", "window"])

    got = stratified_sample(seen, max_train, lang, "doc_id").select(text, lang).mapInArrow(work, "lang string, window binary").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r["lang"], bytes(r["window"])))
    names = sorted({r["lang"] for r in got})
    labels = np.array([names.index(r["lang"]) for r in got])
    return train(np.stack([np.frombuffer(r["window"], np.uint8) for r in got]), labels, len(names)) | {"names": names}


def predict(docs: DataFrame, model: dict | None, text: str = "text", held: Column | None = None) -> DataFrame:
    """doc_id, held_out (held, a flag of docs' columns; false by default), lang_pred and score."""
    small_batches(docs.sparkSession)
    held = F.lit(False) if held is None else F.coalesce(held, F.lit(False))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = texts_of(b, text)
            known = np.asarray(b.column(2).fill_null(False)) & (model is not None)
            names, score = np.full(b.num_rows, "und", object), np.zeros(b.num_rows)
            if known.any():
                p = probabilities(model, raw, off)[known]
                best = p.argmax(1)
                names[known] = np.array(model["names"], object)[best]
                score[known] = np.clip(p[np.arange(len(best)), best] / np.diff(off)[known], 0, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col(text).rlike(r"\p{L}").alias("letters"), F.col(text).alias(text)).mapInArrow(released(work), RESULT)


def keep_known(docs: DataFrame, model: dict | None, text: str = "text", least: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, whose language is not `und` and whose score is least or more."""
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(b.schema.get_field_index(text))
            known = np.asarray(pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False)) & (model is not None)
            if known.any():
                raw, off = texts_of(b, text)
                known[known] = (probabilities(model, raw, off)[known].max(1) / np.diff(off)[known]) >= least
            yield b.filter(pa.array(known))

    return docs.mapInArrow(released(work), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, learn(docs.where(~held)), held=held)
