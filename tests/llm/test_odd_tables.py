"""Odd rows and columns in the text operators and in every stage of the pipeline; slow versions of the network and of the
picture hash."""

import math

import numpy as np
import pytest

pytest.importorskip("cytoplane.llm")

from cytoplane.llm import language, licences, media, quality  # noqa: E402

D = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_foreign_flags_are_not_read(spark):
    """A text column of the name that the result has for its flag."""
    docs = spark.createDataFrame([(1, "ein text mit worten", "de", "x"), (2, "a text with some words", "en", None), (3, None, "en", "y")], "doc_id long, text string, lang string, held_out string").withColumn("n_chars", language.F.length("text"))
    got = {r["doc_id"]: r["held_out"] for r in language.predict(docs, language.learn(docs), held=language.F.col("doc_id") == 2).collect()}
    assert got == {1: False, 2: True, 3: False}
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert not any(r["held_out"] for r in quality.score(docs, quality.train(docs, labels)).collect())


def test_whole_labelled_texts_are_learned_from(spark, monkeypatch):
    """Windows cover every byte of a text, however long it is."""
    seen = []
    monkeypatch.setattr(language, "train", lambda windows, labels, classes: seen.append(windows) or {"bias": [0.0]})
    text = "".join(chr(97 + k % 26) + str(k) for k in range(4000))
    language.learn(spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string"))
    windows = {w.tobytes().decode() for w in seen[0]}
    assert all(text[at : at + 64] in windows for at in (0, len(text) - 64)) and len(windows) == -(-len(text) // 64)
    covered = np.zeros(len(text), bool)
    for w in windows:
        at = text.find(w)
        covered[at : at + 64] = True
    assert covered.all()


def slow_network(p, text):
    """Mean probabilities of a text of one window, position by position and unit by unit."""
    n = p["uf"].shape[0]
    sig = lambda x: 1 / (1 + math.exp(-x))

    def run(e, u, seq):
        h, out = [0.0] * n, []
        for b in seq:
            hu = [sum(h[i] * float(u[i, j]) for i in range(n)) for j in range(3 * n)]
            z = [sig(float(e[b, k]) + hu[k]) for k in range(n)]
            r = [sig(float(e[b, n + k]) + hu[n + k]) for k in range(n)]
            c = [math.tanh(float(e[b, 2 * n + k]) + r[k] * hu[2 * n + k]) for k in range(n)]
            h = [h[k] + z[k] * (c[k] - h[k]) for k in range(n)]
            out.append(h)
        return out

    fore, back = run(p["ef"], p["uf"], text), run(p["eb"], p["ub"], text[::-1])[::-1]
    total = np.zeros(len(p["bias"]))
    for f, b in zip(fore, back):
        logits = [sum(f[i] * float(p["of"][i, c]) + b[i] * float(p["ob"][i, c]) for i in range(n)) + float(p["bias"][c]) for c in range(len(total))]
        e = np.exp(np.array(logits) - max(logits))
        total += e / e.sum()
    return total


def test_network_against_a_slow_forward_pass():
    rng = np.random.default_rng(4)
    x = rng.integers(97, 110, (60, 16)).astype(np.uint8)
    p = language.train(x, (x[:, 0] > 103).astype(int), 2, hidden=3, steps=5)
    texts = [b"abc", b"hello there, this is a text", bytes(range(97, 123)) * 4, b"q"]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = language.probabilities(p, np.frombuffer(b"".join(texts), np.uint8), off)
    assert np.allclose(got, [slow_network(p, t) for t in texts], atol=1e-4)


def test_gradients_against_finite_differences():
    """The first step of training moves each weight against the slope that finite differences of the loss give."""

    def cross_entropy(p, x, y):
        n, total = p["uf"].shape[0], 0.0
        for row, label in zip(x, y):
            states = {}
            for d, seq in (("f", row), ("b", row[::-1])):
                h, out = np.zeros(n), []
                for b in seq:
                    h = language.gates(p[f"e{d}"][b][None].astype(float), h[None], p[f"u{d}"].astype(float))[0][0]
                    out.append(h)
                states[d] = np.array(out if d == "f" else out[::-1])
            logits = states["f"] @ p["of"] + states["b"] @ p["ob"] + p["bias"]
            total -= (logits[:, label] - np.log(np.exp(logits).sum(1))).sum()
        return total / (len(x) * len(x[0]))

    x = np.array([[97, 98, 99, 97], [99, 99, 98, 98]], np.uint8)
    y = np.array([0, 1])
    # with a rate of 0 the starting weights come back; one step of Adam moves each weight by the rate, against its slope
    start = language.train(x, y, 2, hidden=2, steps=1, batch=2, rate=0.0, seed=3)
    moved = language.train(x, y, 2, hidden=2, steps=1, batch=2, rate=1e-3, seed=3)
    for name in ("ef", "eb", "uf", "ub", "of", "ob", "bias"):
        places = [(b, k) for b in (97, 98, 99) for k in range(6)] if name[0] == "e" else list(np.ndindex(start[name].shape))
        for at in places:
            slopes = []
            for sign in (1, -1):
                p = {k: np.array(v, float) for k, v in start.items() if k != "names"}
                p[name][at] += sign * 1e-5
                slopes.append(cross_entropy(p, x, y))
            slope = (slopes[0] - slopes[1]) / 2e-5
            step = float(moved[name][at] - start[name][at])
            if abs(slope) > 1e-4:
                assert step * slope < 0 and abs(step) > 1e-5, (name, at)


def test_damaged_and_missing_pictures(spark):
    png = media.encode(b"x" * 192)
    broken = png[:45] + bytes([png[45] ^ 1]) + png[46:]
    rows = [(1, 192, png), (2, 5, None), (3, 7, broken), (4, 0, b""), (None, None, png[:30])]
    got = {r["doc_id"]: r for r in media.describe_media(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert got[1]["error"] is None and got[1]["payload_bytes"] == 192
    assert all(got[i]["error"] and got[i]["feature"] is None and got[i]["payload_sha256"] is None for i in (2, 3, 4, None))
    assert got[2]["media_bytes"] is None and got[3]["media_bytes"] == len(broken) and len(got) == 5


def test_picture_hash_against_a_slow_one():
    rng = np.random.default_rng(6)
    for shape in ((1, 192, 1), (7, 192, 1), (64, 40, 3), (33, 31, 4), (32, 32, 1)):
        samples = rng.integers(0, 256, shape).astype(np.uint8)
        grey = [[sum(int(v) for v in samples[i, j, : 3 if shape[2] >= 3 else 1]) / (3 if shape[2] >= 3 else 1) for j in range(shape[1])] for i in range(shape[0])]

        def cells(n):
            out = []
            for k in range(32):
                a, b = min(k * n // 32, n - 1), (k + 1) * n // 32
                out.append(range(a, max(b, a + 1)))
            return out

        small = [[sum(grey[i][j] for i in r for j in c) / (len(r) * len(c)) for c in cells(shape[1])] for r in cells(shape[0])]
        low = [[sum(small[i][j] * math.cos(math.pi * u * (i + 0.5) / 32) * math.cos(math.pi * v * (j + 0.5) / 32) for i in range(32) for j in range(32)) for v in range(8)] for u in range(8)]
        flat = [round(v, 6) for row in low for v in row]
        middle = sorted(flat[1:])[31]
        assert media.feature(samples) == f"{int(''.join('1' if v > middle else '0' for v in flat), 2):016x}"


def test_licences_of_null_and_shared_paths(spark):
    rows = [(1, None, "Released under the MIT License."), (2, None, "plain words here"), (3, "a/x", "Licensed under CC BY 4.0."), (4, "a/x", "other words"), (5, "a/x", None), (6, None, "Released under the MIT License.")]
    got = {r["id"]: (r["licence"], r["origin"]) for r in licences.licences(spark.createDataFrame(rows, "id int, path string, text string"), carry=("id",)).collect()}
    assert got == {1: ("MIT", "own"), 2: (None, None), 3: ("CC-BY-4.0", "own"), 4: (None, None), 5: (None, None), 6: ("MIT", "own")}


@pytest.fixture(scope="module")
def odd_documents(spark):
    """The smallest table and odd rows: null and empty texts, null ids, repeated rows and ids, ties, a very long text, a
    benchmark item, and extra columns with names that operators use."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    item = spark.read.parquet(f"{D}/benchmark.parquet").orderBy("item_id").first()["text"]
    long = " ".join(f"wort{k % 977} und{k % 31}" for k in range(30_000))
    same = "one and the same text of some words that two documents have, with the ids of both of them"
    rows = [(10_001, None, "en", "s", 0), (10_002, "", "en", "s", 0), (10_003, " \n\t", None, None, None), (None, "a text without an id, in plain English words that are long enough", "en", "s", 5), (None, None, None, None, None), (10_004, long, "de", "s", None), (10_005, same, "en", "s", 1), (10_006, same, "en", "s", 1), (10_006, same, "en", "s", 1), (10_006, "another text under the same number, which is no copy of the first one", "en", "s", 1), (10_007, f"before it. {item} after it.", "en", "s", 1)]
    extra = {"row": "string", "n": "int", "component_id": "string", "kept": "string", "held_out": "string", "value": "double"}
    from pyspark.sql import functions as F

    odd = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(rows, DOCS))
    return odd.withColumns({c: F.lit(None).cast(t) for c, t in extra.items()})


def test_every_stage_on_odd_tables(spark, odd_documents):
    import corpus_pipeline

    whole = {r["doc_id"]: r["text"] for r in odd_documents.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, odd_documents, D).collect()  # each stage by itself, on all odd rows
        ids = [r["doc_id"] for r in out]
        if k < 4:
            assert out and set(out[0].asDict()) == set(odd_documents.columns), name
        if name == "language_id":
            assert not {10_001, 10_002, 10_003} & set(ids) and 10_004 in ids and ids.count(10_006) == 3
        if name == "near_duplicates":
            assert 10_005 in ids and 10_006 not in ids and {10_001, 10_002} <= set(ids) and ids.count(None) == 2
        if name == "repeated_strings":
            kept = {r["doc_id"]: r["text"] for r in out}
            assert kept[10_005] == whole[10_005] and kept[10_004] == whole[10_004] and ids.count(10_006) <= 1
        if name == "decontamination":
            assert 10_007 not in ids and {10_001, 10_002, 10_004, 10_005} <= set(ids)
        if name == "best_fit_packing":
            assert set(ids) == {*(r["doc_id"] for r in odd_documents.select("doc_id").collect())} and sum(r["length"] for r in out if r["doc_id"] == 10_002) == 1
        assert stage(spark, odd_documents.limit(0), D).count() == 0, name
