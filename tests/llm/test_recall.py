"""Recall of edited benchmark items by size and rate of edits, against the edit distance of every copy."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("cytoplane.llm")

from cytoplane.llm import decontaminate  # noqa: E402

SIZES = [(40, 60), (60, 80), (80, 120), (120, 390)]


def fold(text):
    return decontaminate.fold(np.frombuffer(text.encode(), np.uint8)).tobytes()


@pytest.fixture(scope="module")
def texts():
    return [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE lang IN ('de', 'en', 'fr') ORDER BY doc_id LIMIT 600").fetchall()]


def passage(rnd, texts, low, high):
    """Words of a document, of about a chosen number of bytes."""
    while True:
        words = rnd.choice(texts).split()
        if len(words) >= 80:
            at, most, out = rnd.randrange(len(words) - 70), rnd.randrange(low, high), ""
            for w in words[at:]:
                out = f"{out} {w}".strip()
                if len(out.encode()) >= most:
                    return out


def edited(rnd, text, rate):
    """Each character changed, followed by another or left out, with the given chance."""
    letters = "abcdefghijklmnopqrstuvwxyz "
    return "".join(c if rnd.random() >= rate else rnd.choice([rnd.choice(letters), c + rnd.choice(letters), ""]) for c in text)


@pytest.mark.parametrize("low, high", SIZES)
def test_recall_by_size(texts, low, high):
    rnd = random.Random(low)
    items = [passage(rnd, texts, low, high) for _ in range(200)]
    folded = [(k, fold(t)) for k, t in enumerate(items)]
    index = decontaminate.Index(folded)
    for rate in (0.05, 0.1, 0.15, 0.2):
        copies = [edited(rnd, t, rate) for t in items]
        docs = [f"{rnd.choice(texts)[:200]} {c} {rnd.choice(texts)[:200]}" for c in copies]
        found = {h[:2] for h in decontaminate.hits(index, pa.RecordBatch.from_arrays([pa.array(range(len(docs))), pa.array(docs)], names=["doc_id", "text"]), decontaminate.RATE)}
        within = [k for k, c in enumerate(copies) if decontaminate.edit_distance(folded[k][1], fold(c))[0] <= int(decontaminate.RATE * len(folded[k][1]))]
        assert sum((k, k) in found for k in within) >= 0.9 * len(within), (rate, len(within))


def test_repeats_follow_from_the_target():
    chance = (1 - decontaminate.RATE) ** (decontaminate.STEPS / 2)
    tries = decontaminate.REPEATS * decontaminate.FEW
    assert 1 - (1 - chance) ** tries >= decontaminate.RECALL > 1 - (1 - chance) ** (tries - decontaminate.FEW)


def test_distances_side_by_side(monkeypatch):
    """Of items of one word and of several, against one pair at a time."""
    monkeypatch.setattr(decontaminate, "SIDE", 7)
    rnd = random.Random(9)
    items = [bytes(rnd.choice(b"abc ") for _ in range(n)) for n in (1, 2, 40, 63, 64, 65, 127, 128, 129, 300)]
    text = bytes(rnd.choice(b"abc ") for _ in range(3000)) + b"".join(items)
    which, lo, hi = [], [], []
    for _ in range(120):
        k, a = rnd.randrange(len(items)), rnd.randrange(len(text))
        which.append(k), lo.append(a), hi.append(min(len(text), a + rnd.randrange(500)))
    best, end = decontaminate.edit_distances(items, np.array(which), np.frombuffer(text, np.uint8), np.array(lo), np.array(hi))
    assert [tuple(map(int, x)) for x in zip(best, end)] == [decontaminate.edit_distance(items[k], text[a:z]) for k, a, z in zip(which, lo, hi)]


def test_bound_by_words_is_none_over_the_distance():
    """Where the item is there within the bound; elsewhere it leaves hardly any pair."""
    rnd = random.Random(11)
    items = [bytes(rnd.choice(b"abcdefgh ") for _ in range(n)) for n in (1, 2, 40, 63, 64, 65, 127, 128, 129, 300, 390)]
    text, which, lo, hi, there = b"", [], [], [], []
    for k in range(220):
        n = k % len(items)
        copy = edited(rnd, items[n].decode(), rnd.choice([0, 0.05, 0.1, 0.2])).encode() if k % 3 else bytes(rnd.choice(b"klmnop") for _ in items[n])
        which.append(n), lo.append(len(text)), there.append(k % 3 > 0)
        text += bytes(rnd.choice(b"ab ") for _ in range(rnd.randrange(90))) + copy + bytes(rnd.choice(b"ab ") for _ in range(rnd.randrange(90)))
        hi.append(len(text))
    which, lo, hi, raw = np.array(which), np.array(lo), np.array(hi), np.frombuffer(text, np.uint8)
    bound = np.array([len(t) // 5 for t in items])[which]
    edits = np.array([decontaminate.edit_distance(items[k], text[a:z])[0] for k, a, z in zip(which, lo, hi)])
    least = decontaminate.least_edits(items, which, raw, lo, hi, bound)
    assert (least <= edits)[edits <= bound].all() and (edits <= bound).sum() > 80
    assert (least > bound)[~np.array(there) & (np.array([len(t) for t in items])[which] > 2)].all()


def test_walks_that_are_left_out_meet_no_item(texts):
    """With sieves of some walks' early keys, those whose whole keys are among theirs stay."""
    raw = np.frombuffer(fold(" ".join(texts[:40])), np.uint8)
    padded, begin = np.concatenate([raw, np.zeros(decontaminate.STEPS, np.uint8)]), decontaminate.starts(raw)
    for r in range(decontaminate.REPEATS):
        key, last, first, passed = decontaminate.keys(padded, begin, r)
        assert (first == begin).all()
        some = np.arange(0, len(begin), 50)
        k, z, f, _ = decontaminate.keys(padded, begin, r, [decontaminate.sieve_of(p[some]) for p in passed])
        want, got = np.isin(key, key[some]), np.isin(k, key[some])
        assert (f[got] == begin[want]).all() and (z[got] == last[want]).all() and len(k) < len(key) / 2


def test_two_steps_at_once_are_the_walk_step_by_step():
    """Keys are equal where a walk taken byte by byte samples the same bytes, and they end where it ends; sieves leave out
    none of the items' walks."""
    rng = np.random.default_rng(12)
    text = np.concatenate([rng.integers(0, 256, 300), np.tile(rng.choice(list(b"ab \xc3"), 40), 20), rng.integers(97, 100, 600)]).astype(np.uint8)
    padded, begin = np.concatenate([text, np.zeros(decontaminate.STEPS, np.uint8)]), np.arange(len(text) - 1)
    for r in range(decontaminate.REPEATS):
        assert len(decontaminate._two_steps(r)) == decontaminate.STEPS // 2
        seen, end = [], []
        for at in begin.tolist():
            row = []
            for j in range(decontaminate.STEPS):
                if j in decontaminate._PLACES[r]:
                    row.append(int(padded[at]))
                if j < decontaminate.STEPS - 1:
                    at += int(decontaminate._MOVES[r, j, padded[at]])
            seen.append(tuple(row))
            end.append(at)
        key, last, first, passed = decontaminate.keys(padded, begin, r)
        assert last.tolist() == end and (first == begin).all()
        assert len(set(seen)) == len(set(key.tolist())) == len(set(zip(seen, key.tolist()))) < len(seen)
        some = begin[::3]
        few, _, _, ways = decontaminate.keys(padded, some, r)
        left = decontaminate.keys(padded, begin, r, [decontaminate.sieve_of(w) for w in ways])
        assert set(few.tolist()) == set(left[0].tolist()) & set(few.tolist()) and set(some.tolist()) <= set(left[2].tolist())
