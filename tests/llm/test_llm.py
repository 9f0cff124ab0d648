"""The training-text operators against brute force, round trips and held-out labels, on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

llm = pytest.importorskip("cytoplane.llm")

from cytoplane.llm import decontaminate, language, licences, media, packing, quality, shingle_join, suffix_dedup, token_counts, token_records, tokens  # noqa: E402
from cytoplane.llm._shared import components  # noqa: E402

D = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, `row` string"


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, null ids, repeated rows, very long words and texts, extra columns with clashing names."""
    rnd = random.Random(7)
    words = ["the", "of", "Word", "re.\nA", "it's", "été,", "naïve", "x1", "日本", "big"]
    long = " ".join(rnd.choice(words) + str(rnd.randrange(50)) for _ in range(3000))
    base = " ".join(rnd.choice(words) + str(rnd.randrange(90)) for _ in range(80))
    near = base.split(" ")
    near[3] = "changed"
    texts = [None, "", "   \n", "one two", "one two", base, base, " ".join(near), long, long + " tail", "z" * 5000, "a" * 49, "a" * 50, "A" * 50, "a" * 120, "12 34 !", "été " * 40, base[:200] + " other end " + base[200:], "\x1c odd \x00 bytes <|endoftext|> here"]
    rows = [(i, t, "en", "s", 1, 0.5, "x") for i, t in enumerate(texts)]
    rows += [(None, "no id here at all", None, None, None, None, None), (5, base, "en", "s", 1, 0.5, "x")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


# -- tokens -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name, drop", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_units_encode_like_whole_texts(name, drop):
    import public_tokenizers

    e = tokens.MemoEncoder(public_tokenizers.path(name), drop)
    rnd, letters = random.Random(3), "aB é.,'s \n\t\x1c\x00Σ1½|ª!?ç  ǅ<>"
    texts = ["", "a  b", "it's DON'T.", "q\x1cx !\x1c. a\x85b.", "İstanbul. ﬁne. 12,345.", "<|endoftext|> hi", "ABC. \n D", *("".join(rnd.choice(letters) for _ in range(rnd.randrange(40))) for _ in range(3000))]
    for t, got, want in zip(texts, e.encode_many(pa.array(texts)), e.tok.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(got, e.dtype).tolist() == want.ids, repr(t)


def encoded(name, rows, end):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [np.array(t.encode(x, add_special_tokens=False).ids + [end], "<u4") for _, x in rows]


def test_records_round_trip(odd, none):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    manifest = token_records.write_records(odd, path)
    rows = sorted(pairs(odd), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = sorted(token_records.read_records(manifest).collect(), key=lambda r: r["start"])
    start = 0
    for (i, _), ids, r in zip(rows, encoded("word_bpe_49k.json", rows, 1), got):
        assert tuple(r) == (i, start, len(ids), zlib.crc32(ids))
        start += len(ids)
    assert len(got) == len(rows)
    first = manifest.first()
    assert token_records.fetch(f"file://{first['path']}", [0])[0][0] is None
    assert token_records.read_records(token_records.write_records(none, path)).count() == 0


def test_checksums_are_the_known_ones():
    # the published check value of CRC-32C, masked
    crc = 0xE3069283
    assert token_records.masked_crc32c([b"123456789"])[0] == (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF
    framed = token_records.frame([b"abcdefgh" * 50])[0]
    assert token_records.unframe(framed, np.array([0])) == [b"abcdefgh" * 50]
    with pytest.raises(ValueError):
        token_records.unframe(framed[:20] + b"!" + framed[21:], np.array([0]))


def check_packing(rows, want):
    seen, by = defaultdict(list), defaultdict(list)
    for r in rows:
        seen[r["doc_id"]].append(r)
        by[r["sequence_id"]].append(r)
    for s in by.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    for i, ids in want.items():
        for r in seen[i]:
            assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"]
            assert r["piece"] == 0 or r["length"] == 2048
    return len(by)


def test_packing(odd, none):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = pairs(odd)
    ids = encoded("byte_bpe_50k.json", rows, 0)
    got = packing.pack(odd, path).collect()
    assert sum(r["length"] for r in got) == sum(map(len, ids)) and {r["doc_id"] for r in got} == {i for i, _ in rows}
    check_packing(got, dict(zip((i for i, _ in rows), ids)))
    assert packing.pack(none, path).count() == 0


@pytest.mark.parametrize("parts, spread", [(2, 200), (3, 60), (4, 100)])
def test_packing_of_full_sequences(parts, spread):
    """Pieces near a half, a third or a quarter of a sequence that fill 2000 sequences without a gap."""
    rng, pieces = np.random.default_rng(1), []
    while len(pieces) < 2000 * parts:
        x = rng.integers(2048 // parts - spread, 2048 // parts + spread, parts - 1).tolist()
        if abs(2048 - sum(x) - 2048 // parts) <= spread:
            pieces += [*x, 2048 - sum(x)]
    configs, bound = packing.plan(dict(Counter(pieces)))
    assert bound <= 2000.001 and sum(k for _, k in configs) <= 1.007 * 2000


def test_packing_is_near_the_bound():
    rng = np.random.default_rng(0)
    hist = Counter(np.minimum(rng.lognormal(6, 1, 20000).astype(int) + 1, 2048).tolist())
    configs, bound = packing.plan(dict(hist))
    used = Counter()
    for c, k in configs:
        assert sum(n * m for n, m in c.items()) <= 2048
        for n, m in c.items():
            used[n] += m * k
    assert used == hist
    assert sum(k for _, k in configs) <= 1.002 * bound + 1


def test_token_counts_follow_edits():
    import public_tokenizers

    e = tokens.MemoEncoder(public_tokenizers.path("byte_bpe_50k.json"), False)
    rnd, words = random.Random(4), ["the", "of", "Thnt", "re.\nA", "it's", "a,", "  ", "été."]
    for _ in range(200):
        t = " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 300)))
        edits = [(rnd.randrange(0, len(t) + 5), rnd.randrange(0, 30), "".join(rnd.choice("aB é., \n1!") for _ in range(rnd.randrange(0, 9)))) for _ in range(rnd.randrange(0, 5))]
        chars, counts, _ = token_counts.leaves(e, pa.array([t]))
        tree, out, at, spans = token_counts.Tree(chars.tolist(), counts.tolist()), "", 0, []
        for a, gone, new in sorted(edits, key=lambda x: x[0]):
            a, b = min(a, len(t)), min(a + gone, len(t))
            if spans and a < spans[-1][1]:
                spans[-1] = (spans[-1][0], max(b, spans[-1][1]), spans[-1][2] + new)
            else:
                spans.append((a, b, new))
        for a, b, new in spans:
            out, at = out + t[at:a] + new, b
        out += t[at:]
        for first, last, text, _ in token_counts.regions(tree, t, edits):
            for leaf in range(first + 1, last + 1):
                tree.put(leaf, 0, 0)
            tree.put(first, len(text), int(token_counts.counted(e, pa.array([text]))[1].sum()))
        assert (tree.total(0), tree.total(1)) == (len(out), len(e.tok.encode(out, add_special_tokens=False).ids))


def test_token_counts_query(spark, odd):
    import public_tokenizers
    from pyspark.sql import functions as F

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = odd.where("text IS NULL OR NOT (text LIKE '%<|%')")
    got = {r["doc_id"]: r for r in token_counts.apply_edits(token_counts.build_trees(plain.withColumn("edits", token_counts.sample_edits(F.coalesce("text", F.lit("")))), path), path).collect()}
    rows = [r for r in pairs(plain) if r[0] is not None]
    for (i, _), ids in zip(rows, encoded("byte_bpe_50k.json", rows, 0)):
        assert got[i]["n_tokens"] == len(ids) - 1
    assert got[8]["leaves_encoded"] < got[8]["n_leaves"] / 5


def edited(text, edits):
    """The text after edits, which name places of the text before all of them."""
    out, at, spans = "", 0, []
    for a, gone, new in sorted(edits, key=lambda x: x[0]):
        a, b = min(a, len(text)), min(a + gone, len(text))
        if spans and a < spans[-1][1]:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]), spans[-1][2] + new)
        else:
            spans.append((a, b, new))
    for a, b, new in spans:
        out, at = out + text[at:a] + new, b
    return out + text[at:]


def test_token_trees_are_kept(spark, odd, none):
    """Three rounds of edits, overlapping ones as well, each from the trees that the last one left; an empty table."""
    import public_tokenizers
    from pyspark.sql import functions as F

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = tokens.MemoEncoder(path, False).tok
    rnd = random.Random(11)
    now = {k: t for k, (i, t) in enumerate(pairs(odd)) if "<|" not in t}
    kind = "array<struct<at:long,gone:long,new:string>>"
    draw = lambda t: [(rnd.randrange(0, len(t) + 5), rnd.randrange(0, 40), "".join(rnd.choice("aB é., \n1!") for _ in range(rnd.randrange(0, 9)))) for _ in range(rnd.randrange(0, 5))]
    edits = {k: draw(t) for k, t in now.items()}
    trees = token_counts.build_trees(spark.createDataFrame([(k, t, edits[k]) for k, t in now.items()], f"doc_id long, text string, edits {kind}"), path)
    for _ in range(3):
        rows = token_counts.apply_edits(trees, path, keep_trees=True).collect()
        now = {k: edited(t, edits[k]) for k, t in now.items()}
        assert {r["doc_id"]: r["text"] for r in rows} == now
        for r in rows:
            assert r["n_tokens_edited"] == sum(r["tokens"]) == len(tok.encode(r["text"], add_special_tokens=False).ids) and sum(r["chars"]) == len(r["text"])
        edits = {k: draw(t) for k, t in now.items()}
        trees = spark.createDataFrame([(r["doc_id"], r["text"], edits[r["doc_id"]], r["chars"], r["tokens"]) for r in rows], token_counts.TREES)
    empty = none.select("doc_id", "text", F.lit(None).cast(kind).alias("edits"))
    assert token_counts.apply_edits(token_counts.build_trees(empty, path), path).count() == 0


# -- texts ------------------------------------------------------------------------------------------------------------


def test_language(spark, odd, none):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    model = language.learn(docs.where("NOT held_out"), max_train=400)
    got = language.predict(docs, model, held=F.col("held_out")).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.count() > 100
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count()
    strange = {r["doc_id"]: r for r in language.predict(odd, model).collect()}
    assert all(strange[i]["lang_pred"] == "und" and strange[i]["score"] == 0 for i in (0, 1, 2, 15)) and strange[8]["lang_pred"] != "und"
    assert language.predict(none, model).count() == 0 and language.learn(none) is None
    assert {r["lang_pred"] for r in language.predict(odd, None).collect()} == {"und"}
    kept = language.keep_known(odd, model)
    assert kept.columns == odd.columns and 0 not in {r["doc_id"] for r in kept.collect()}


def test_language_gradients():
    """One step along the gradient lowers the loss that the forward pass gives."""
    rng = np.random.default_rng(0)
    x = rng.integers(97, 110, (300, 20)).astype(np.uint8)
    y = (x[:, ::2].astype(int).sum(1) > np.median(x[:, ::2].astype(int).sum(1))).astype(int)
    x[y == 1] += 10
    p = language.train(x, y, 2, hidden=4, steps=60)
    sums = language.probabilities(p, x.ravel(), np.arange(301) * 20)
    assert (sums.argmax(1) == y).mean() > 0.95 and np.allclose(sums.sum(1), 20, atol=1e-3)


def test_quality(spark, odd, none):
    from pyspark.sql import functions as F

    d = "/root/testdata/sf0.01"
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    labels = spark.read.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = quality.train(docs, labels.where(~held))
    got = quality.score(docs, model).join(labels, "doc_id").where(held)
    assert got.where("predicted = quality").count() >= 0.95 * got.count()
    assert all(0 <= r["score"] <= 1 for r in quality.score(odd, model).collect()) and quality.score(none, model).count() == 0
    assert quality.train(none, labels)["constant"] == 0.5


def test_factorisation_identity():
    rng = np.random.default_rng(1)
    idx, val = rng.choice(quality.SIZE, 6, replace=False).astype(np.int32), rng.normal(size=6).astype(np.float32)
    m = {"w0": 0.1, "w": rng.normal(size=quality.SIZE), "v": rng.normal(size=(quality.SIZE, 3))}
    z = 0.1 + sum(m["w"][i] * x for i, x in zip(idx, val)) + sum(m["v"][idx[a]] @ m["v"][idx[b]] * val[a] * val[b] for a in range(6) for b in range(a))
    assert quality.scores(m, [(idx, val)])[0] == pytest.approx(1 / (1 + np.exp(-z)))


def test_media(odd, none):
    got = {r["doc_id"]: r for r in media.describe_media(media.with_media(odd)).collect()}
    for i, t in pairs(odd):
        raw = t.encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert got[i]["payload_sha256"] == hashlib.sha256(payload).hexdigest() and got[i]["tail_crc32"] == zlib.crc32(payload[-16:]) and got[i]["n_bytes"] == len(raw)
    assert got[5]["feature"] == got[6]["feature"] and media.describe_media(media.with_media(none)).count() == 0


def test_png_filters_and_damage():
    rng = np.random.default_rng(2)
    rows, bpp = rng.integers(0, 256, (10, 12)).astype(np.uint8), 3
    kinds = np.array([0, 1, 2, 3, 4, 4, 2, 2, 3, 1], np.uint8)
    lines = np.zeros_like(rows)
    for r in range(10):
        for i in range(12):
            a, b, c = (int(rows[r, i - bpp]) if i >= bpp else 0), (int(rows[r - 1, i]) if r else 0), (int(rows[r - 1, i - bpp]) if r and i >= bpp else 0)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            lines[r, i] = (int(rows[r, i]) - [0, a, b, (a + b) // 2, paeth][kinds[r]]) & 255
    assert (media.unfilter(kinds, lines, bpp) == rows).all()
    png = media.encode(b"hello wor " * 96)
    for bad in (png[:-5], png[:40] + b"x" + png[41:], b"x" + png[1:]):
        with pytest.raises((ValueError, zlib.error)):
            media.decode(bad)


def test_licences(spark, none):
    files = spark.createDataFrame(
        [("a/LICENSE", "Released under the MIT License."), ("a/b/x.py", "code"), ("a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("a/b/c/d.py", None), ("z.py", ""), ("LICENSE", "nothing"), ("a/q.py", "x\n# Licensed under CC BY-NC 4.0.\ny"), (None, "x"), ("ab/t.py", "t"), ("a/q.py", "x\n# Licensed under CC BY-NC 4.0.\ny")], "path string, text string")
    got = {r["path"]: (r["licence"], r["origin"], r["from_dir"]) for r in licences.licences(files).collect()}
    assert got["a/b/x.py"] == ("GPL-3.0", "inherited", "a/b") and got["a/b/c/d.py"] == ("GPL-3.0", "inherited", "a/b")
    assert got["a/q.py"] == ("CC-BY-NC-4.0", "own", None) and got["ab/t.py"] == (None, None, None) and got["a/LICENSE"][0] == "MIT"
    assert licences.licences(files).count() == 10 and licences.licences(files.limit(0)).count() == 0


def test_licences_of_real_texts(spark):
    """Licence files and wrapped headers as they are found: none reached a template as a single line."""
    from pathlib import Path

    texts = Path(licences.__file__).parent / "licence_texts"
    full = lambda name: (texts / f"{name}.txt").read_text()
    mit = full("MIT").replace("[year] [holder]", "2026 Michael Wainberg and Keon Arbabi")
    wrapped = lambda text, a, mark, z: a + "\n".join(f"{mark} {x}".rstrip() for x in text.splitlines()) + z
    gpl = "mytool - does things\nCopyright (C) 2021  A. Body\n\nThis program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    want = {f"{n}/LICENSE": (n, full(n)) for n in ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0")}
    want |= {"m/LICENSE.txt": ("MIT", mit), "m/x.c": ("MIT", wrapped(mit, "/*\n", " *", "\n */\nint x;")), "b.py": ("BSD-3-Clause", "#!/usr/bin/env python\n" + wrapped("Copyright (c) 2001, Me\nAll rights reserved.\n\n" + full("BSD-3-Clause"), "", "#", "\nimport os"))}
    want |= {"b.c": ("BSD-2-Clause", "/*\n" + full("BSD-2-Clause") + "*/\nint y;"), "g.py": ("GPL-3.0", wrapped(gpl, "", "#", "\n\nimport os")), "g1.txt": ("GPL-3.0", " ".join(gpl.split("\n")[3:])), "t.txt": ("MIT", "x\nMIT License\ny"), "s.c": ("MIT", "// SPDX-License-Identifier: MIT\nint z;")}
    want |= {"d.txt": (None, "er kommt mit\nmit\ndem Hund"), "e.c": (None, "/* the program\n * may be used under\n * a license */")}
    rows = [(k, t) for k, (_, t) in want.items()] + [("m/sub/y.c", "int y;"), ("GPL-3.0/src/y.c", "int y;")]
    got = {r["path"]: (r["licence"], r["origin"]) for r in licences.licences(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert {k: got[k][0] for k in want} == {k: n for k, (n, _) in want.items()}
    assert got["m/sub/y.c"] == ("MIT", "inherited") and got["GPL-3.0/src/y.c"] == ("GPL-3.0", "inherited")


def test_licence_notices_on_one_line(spark):
    """A notice that stands on one line, alone or under a line of copyright, is a block as it is when it wraps."""
    notices = [(name, x) for name, xs in sorted(licences.NOTICES.items()) for x in xs]
    rows = [(k, f"{way}{k}.c", shape(x)) for k, (_, x) in enumerate(notices) for way, shape in (("alone", lambda x: x), ("comment", lambda x: f"/* {x} */\nint f;\n"), ("held", lambda x: f"# Copyright (c) 2020 A. Writer\n# {x}\n\ng = 1\n"), ("later", lambda x: f"words of a text\n\n{x}\n\nmore of it"))]
    rows += [(-1, "other", "words of a text\n\nPermission to speak was granted, free of charge, to any person.\n"), (-1, "own", "Licensed under CC BY 4.0.")]
    got = {r["path"]: (r["licence"], r["score"]) for r in licences.licences(spark.createDataFrame(rows, "id int, path string, text string")).collect()}
    assert {p: got[p][0] for _, p, _ in rows} == {p: notices[k][0] if k >= 0 else {"own": "CC-BY-4.0", "other": None}[p] for k, p, _ in rows}
    assert all(got[p][1] > 0.999 for _, p, _ in rows if p != "other")


def test_licences_inherited_in_a_tree(spark):
    """A random tree with odd directory names against a slow version, which walks up from each file by itself. Under
    other names the licence files answer for themselves only: what is inherited comes from that step and no other."""
    rnd = random.Random(5)
    state = {None: "plain words", "MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3."}
    rows = []
    for k in range(400):
        name = rnd.choice(["LICENSE", "COPYING", "Licence.md", "x.py", "y.c", "z.txt", "license-mit", "notice.txt", "mylicense", "unlicense"])
        path = "/".join([rnd.choice(["a", "b", "ab", "..", ".", "", "a b"]) for _ in range(rnd.randrange(5))] + [name])
        rows.append((k, None if k % 40 == 0 else path, rnd.choice([None, None, None, "MIT", "Apache-2.0", "GPL-3.0"])))
    run = lambda rename: {r["id"]: tuple(r)[2:] for r in licences.licences(spark.createDataFrame([(k, p and rename(p), state[own]) for k, p, own in rows], "id int, path string, text string"), carry=("id",)).collect()}
    got, alone = run(str), run(lambda p: p + ".d/x")
    held = defaultdict(list)
    for k, p, own in rows:
        assert alone[k] == (own, alone[k][1], "own" if own else None, None)
        if p and own and re.search(licences.LICENCE_FILE, p):
            held[p.rpartition("/")[0]].append((-alone[k][1], own))
    for k, p, own in rows:
        parts = p.rpartition("/")[0].split("/") if p else []
        near = next((a for n in range(len(parts), -1, -1) if (a := "/".join(parts[:n])) in held), None) if p else None
        want = alone[k] if own or near is None else (min(held[near])[1], -min(held[near])[0], "inherited", near)
        assert got[k] == want, (p, got[k], want)
    assert sum(g[2] == "inherited" for g in got.values()) > 100


def test_licence_bound_of_texts():
    """With one term fewer than needed, whichever they are, a text stays under the threshold with a template."""
    for _, w in licences.template_weights(licences.full_texts())[2]:
        for among in (list(w), [t for t in w if t not in licences.COMMON]):
            n = licences.needed(w, among, licences.THRESHOLD)
            best = sum(sorted((w[t] ** 2 for t in among), reverse=True)[: max(n - 1, 0)]) + sum(x * x for t, x in w.items() if t not in among)
            assert n == 0 or best < licences.THRESHOLD**2
            assert n <= len(among)


def test_licence_bound():
    """Any line over the threshold has a telling term."""
    vectors = licences.template_weights(licences.TEMPLATES)[2]
    telling = licences.telling_terms(vectors, licences.THRESHOLD)
    for _, w in vectors:
        assert sum(x * x for t, x in w.items() if t not in telling) < licences.THRESHOLD**2


# -- copies and leaks -------------------------------------------------------------------------------------------------


def shingle_truth(rows):
    """Sorted (id, number of shingles, component) of rows, which may share ids and texts and have none."""
    sets = []
    for _, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if x]
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = {i: i for i, _ in rows if i is not None}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    named = [(i, s) for (i, _), s in zip(rows, sets) if i is not None]
    for k, (a, x) in enumerate(named):
        for b, y in named[:k]:
            if x and y and find(a) != find(b):
                both = len(x & y)
                if 100 * both >= 75 * (len(x) + len(y) - both):
                    m, n = find(a), find(b)
                    group[max(m, n)] = min(m, n)
    return sorted(((i, len(s), None if i is None else find(i)) for (i, _), s in zip(rows, sets)), key=str)


def grouped(df):
    return sorted((tuple(r) for r in shingle_join.groups(df).collect()), key=str)


def test_shingle_groups(spark, odd, none):
    """Null ids, repeated rows, ids with two texts, chains of near copies, copies on both sides of the threshold."""
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(400)}" for _ in range(120)]
    rows = pairs(odd)
    for k in range(40):
        base = list(base)
        base[rnd.randrange(120)] = f"v{k}"
        rows.append((100 + k, " ".join(base)))
    rows += [(200 + k, " ".join(f"c{rnd.randrange(9)}" for _ in range(rnd.randrange(1, 12)))) for k in range(60)]
    edited = [f"e{rnd.randrange(400)}" for _ in range(200)]
    for k in range(80):
        rows.append((300 + k, " ".join(f"n{k}" if rnd.random() < (0.02, 0.04, 0.08)[k % 3] else w for w in edited[rnd.randrange(9) : 200 - rnd.randrange(30)])))
    rows += [(400, rows[40][1]), (400, rows[-1][1]), (401, rows[-1][1]), (-1, "a b c d e f g"), (None, "a b c d e f g"), (None, "s t u v w x y"), (-1, "a b c d e f g"), (402, "s t u v w x y")]
    assert grouped(spark.createDataFrame(rows, "doc_id long, text string")) == shingle_truth(rows)
    assert shingle_join.groups(none).count() == 0


def test_shingle_groups_of_the_test_table(spark):
    rows = duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{D}/documents.parquet'").fetchall()
    assert grouped(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == shingle_truth(rows)


def dedup_truth(rows):
    """Sorted results of rows, which may share ids and texts and have none; a string counts where its id is smaller."""
    first = {}
    for i, t in rows:
        b = t.encode()
        for k in range(len(b) - 49 if i is not None else 0):
            first[b[k : k + 50]] = min(first.get(b[k : k + 50], i), i)
    out = []
    for i, t in rows:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49 if i is not None else 0):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("crowd, large", [(2000, 20_000), (1, 20_000), (1, 1)])
def test_repeated_strings(spark, odd, none, crowd, large, monkeypatch):
    """Null ids, repeated rows, ids with two texts, a passage in many contexts; plain anchors, parted ones, single strings."""
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    monkeypatch.setattr(suffix_dedup, "LARGE", large)
    rnd = random.Random(6)
    passage = " ".join(f"p{rnd.randrange(99)}" for _ in range(40))
    rows = pairs(odd) + duckdb.sql(f"SELECT doc_id + 1000, text FROM '{D}/documents.parquet' LIMIT 60").fetchall()
    rows += [(500 + k, " ".join(f"q{rnd.randrange(500)}" for _ in range(20)) + passage[rnd.randrange(9) : 140 - rnd.randrange(9)] + " ".join(f"r{rnd.randrange(5)}" for _ in range(20))) for k in range(40)]
    rows += [(3, rows[-1][1]), (3, rows[-2][1] + "x"), (600, rows[-1][1]), (600, rows[-3][1]), (600, rows[-3][1]), (None, rows[-1][1]), (601, rows[-1][1] + " and more"), (-1, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r)[:5] for r in suffix_dedup.deduplicate(docs).collect()), key=str)
    assert got == dedup_truth(rows)
    if crowd > 1:
        assert suffix_dedup.deduplicate(none).count() == 0
        text = suffix_dedup.deduplicate(odd, keep="text", carry=("row", "score"))
        assert text.count() == odd.count() and dict(text.dtypes)["kept"] == "string"


def test_suffix_order():
    rng = np.random.default_rng(3)
    raw = rng.integers(97, 99, 3000).astype(np.uint8)
    starts = np.sort(rng.choice(2900, 900, replace=False))
    order, same = suffix_dedup.sorted_suffixes(raw, starts, 50)
    keys = [raw[s : s + 50].tobytes() for s in order]
    assert keys == sorted(keys) and same.tolist() == [k > 0 and keys[k] == keys[k - 1] for k in range(len(keys))]


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rnd.randrange(100, 160), rnd.randrange(100, 160)) for _ in range(40)]
    group = {v: v for e in edges for v in e}
    for _ in range(200):
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: c for v, c in group.items() if any(v in e and e[0] != e[1] for e in edges)}


def test_decontamination(spark, odd, none):
    rnd = random.Random(2)
    items = [(k, " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 9))) for _ in range(rnd.randrange(14, 50)))) for k in range(20)]
    bench = spark.createDataFrame([*items, (99, None), (98, "short")], "item_id long, text string")
    docs = [(k, f"before it {t} and after") for k, t in items[:5]]
    docs.append((50, items[5][1].upper().replace(" ", "\n")))
    changed = items[6][1].split(" ")
    changed[7] = "zz"
    docs += [(51, "lead " + " ".join(changed)), (52, "nothing of the kind " * 50), (53, None)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(table, bench).collect()}
    assert got == {*((k, k) for k in range(5)), (50, 5), (51, 6)}
    assert {r["doc_id"] for r in decontaminate.without_matches(table, bench).collect()} == {52, 53}
    assert decontaminate.matches(none, bench).count() == 0 and decontaminate.matches(table, bench.limit(0)).count() == 0
    assert decontaminate.without_matches(odd, bench).columns == odd.columns


def folded(texts):
    return [(k, decontaminate.fold(np.frombuffer(t.encode(), np.uint8)).tobytes()) for k, t in enumerate(texts)]


def held(index, docs, rate=0.2):
    """(row, item) that the search finds."""
    return {(d, n) for d, n, *_ in decontaminate.hits(index, pa.RecordBatch.from_arrays([pa.array(docs)], names=["text"]), rate)}


def test_short_and_unspaced_items(spark):
    """Exact copies of items of every kind are found: words of any number, unspaced script, code, a few bytes."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 12)))
    texts = [" ".join(word() for _ in range(rnd.randrange(1, 12))) for _ in range(300)]
    texts += ["".join(chr(rnd.randrange(0x4E00, 0x9FA0)) for _ in range(rnd.randrange(1, 60))) for _ in range(60)]
    texts += ["".join(rnd.choice("xyz(){};=+") for _ in range(rnd.randrange(3, 150))) for _ in range(60)]
    docs = [a + t + z for t in texts for a, z in (("", ""), ("lead (", ") tail"), ("von", "bis"))]
    got = held(decontaminate.Index(folded(texts)), docs)
    assert [d for d in range(len(docs)) if (d, d // 3) not in got] == []
    bench = spark.createDataFrame([(1, "短い文です"), (2, " \n "), (3, "x=f(y);"), (4, "好" * 30 + "天气很" * 9)], "item_id long, text string")
    table = spark.createDataFrame([(1, "これは短い文です。"), (2, "if x=f(y); then"), (3, "clean text"), (4, "今" + "好" * 30 + "天氣很" + "天气很" * 8)], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(table, bench).collect()} == {(1, 1), (2, 3), (4, 4)}
    assert [r["doc_id"] for r in decontaminate.without_matches(table, bench).collect()] == [3]


@pytest.mark.parametrize("rate", [0.0, 0.05, 0.1, 0.15])
def test_recall_of_edited_items(rate):
    """Against the edit distance of each item to its document: characters changed, added and left out at random."""
    rnd = random.Random(5)
    texts = [t for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.1/benchmark.parquet' ORDER BY item_id").fetchall()]
    other = lambda: rnd.choice("abcdefghij klmno")
    edit = lambda c: c if rnd.random() >= rate else rnd.choice(("", other(), c + other()))
    docs = ["Some words before it " + "".join(map(edit, t)) + " and other words after it." for t in texts]
    items = folded(texts)
    near = {k for k, (_, t) in enumerate(items) if decontaminate.edit_distance(t, decontaminate.fold(np.frombuffer(docs[k].encode(), np.uint8)).tobytes())[0] <= 0.2 * len(t)}
    got = held(decontaminate.Index(items), docs)
    assert sum((k, k) in got for k in near) >= (1.0 if rate == 0 else 0.9) * len(near)


def test_items_do_not_depend_on_the_batch(spark):
    """The same finds in one partition and in many, alone and beside others; items that begin alike; ties; repeated rows;
    a text of a megabyte; null ids."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 9)))
    texts = ["Question: Which of the following statements is the right one for " + " ".join(word() for _ in range(5)) + "?" for _ in range(300)] + [" ".join(word() for _ in range(7)) for _ in range(100)]
    docs = [(k, word() + " " + t + " " + word()) for k, t in enumerate(texts)] + [(7, "x " + texts[7] + " " + word())] * 2 + [(None, texts[3])]
    docs += [(1000, " ".join(word() for _ in range(200_000)) + texts[5])] + [(1001 + k, " ".join(word() for _ in range(40))) for k in range(50)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(texts), (None, texts[350]), (350, texts[350])], "item_id long, text string")
    one, many = (sorted(map(tuple, decontaminate.matches(table.repartition(n), bench).collect()), key=str) for n in (1, 40))
    assert one == many and {(k, k) for k in range(400)} <= {r[:2] for r in one} and (1000, 5) in {r[:2] for r in one}
    assert [r[:2] for r in one].count((7, 7)) == 3 and (None, 3) in {r[:2] for r in one} and (350, None) in {r[:2] for r in one}
    alone = held(decontaminate.Index(folded(texts)), [docs[0][1]])
    assert {n for _, n in alone} == {r[1] for r in one if r[0] == 0}


def test_edit_distance():
    def slow(p, t):
        row = list(range(len(p) + 1))
        best = row[-1]
        for c in t:
            new = [0]
            for i, x in enumerate(p, 1):
                new.append(min(new[-1] + 1, row[i] + 1, row[i - 1] + (x != c)))
            row, best = new, min(best, new[-1])
        return best

    rnd = random.Random(1)
    for _ in range(200):
        p, t = (bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(a, b))) for a, b in ((1, 20), (0, 40)))
        assert decontaminate.edit_distance(p, t)[0] == slow(p, t)


def test_pipeline(spark):
    import corpus_pipeline

    pieces = corpus_pipeline.run(spark, D)
    docs = {r["doc_id"] for r in pieces.collect()}
    everything = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    assert docs < set(everything) and not any(t in everything[i] for i in docs for t in items)
    truth = shingle_truth([(i, t) for i, t in everything.items() if t and re.search("[^\\W\\d_]", t)])
    assert all(c == i for i, _, c in truth if i in docs)
