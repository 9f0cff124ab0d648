"""Spelling variants, source divergence and sharding against brute force, on small tables."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

pytest.importorskip("cytoplane.llm")

from cytoplane.llm import divergence, sharding, spelling  # noqa: E402

D = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, word string, shard string, n long"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def odd_rows():
    """Null and empty texts and keys, repeated rows and ids, very long words and texts, columns with clashing names."""
    rnd = random.Random(5)
    words = ["colour", "color", "colours", "cölour", "Colouur", "ccolour", "étéété", "ÉTÉÉTÉ", "ÿ×÷aaaa", "aaaaaaa", "aaaaaaaa", "aaaaaaab", "short", "日本colour", "a" * 300, "b" * 700]
    texts = [None, "", "  \n\x00.", "z" * 4000, "Colour " * 6, *(" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 60))) for _ in range(90))]
    langs, sources = ["en", "fr", None, "", "x"], ["s1", "s2", "ü", None, "", "s3"]
    rows = [(i, t, rnd.choice(langs[:4]), rnd.choice(sources), "w", "s", 7) for i, t in enumerate(texts)]
    rows += [rows[7]] * 3 + [(None, "colour colour nameless", "en", None, None, None, None), (None, "colour other", "en", "s1", None, None, None), (8, "another text of eight", "x", "alone", "", "", 0)]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{D}/documents.parquet")


# -- spelling ---------------------------------------------------------------------------------------------------------


def slow_counts(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= 6:
                n[run] += 1
    return n


def slow_variants(n):
    """Near words by comparing all pairs."""

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    by = defaultdict(list)
    for w in n:
        by[len(w)].append(w)
    out = {}
    for w in n:
        found = [x for k in (-1, 0, 1) for x in by[len(w) + k] if near(w, x)]
        best = min(found, key=lambda x: (-n[x], x), default=None)
        out[w] = (best if best is not None and n[best] >= 5 * n[w] else None, len(found))
    rows = []
    for w, (form, k) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.append((w, form, root, n[w], k, None if form is None else n[form]))
    return sorted(rows)


@pytest.mark.parametrize("which", ["odd", "small"])
def test_variants(request, which):
    docs = request.getfixturevalue(which)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = slow_variants({w: n for w, n in slow_counts(rows).items() if n >= 5})
    got = spelling.variants(spelling.vocabulary(docs))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == want and len(want) > 5


@pytest.mark.parametrize("trunk", [1, 10_000])
def test_pairs_of_dense_words(spark, trunk):
    """Few letters, so that words have many near ones, runs of a letter, and words that are prefixes of others."""
    rnd = random.Random(trunk)
    n = {"".join(rnd.choice("abé") for _ in range(rnd.randrange(1, 8))): rnd.choices([1, 6, 40, 250, 1500], [60, 25, 10, 4, 1])[0] for _ in range(500)}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    pairs = [(r["a"], r["b"]) for r in spelling.near_pairs(words, trunk).collect()]
    want = slow_variants(n)
    assert len(pairs) == len(set(pairs)) and Counter(a for a, _ in pairs) == {w: k for w, _, _, _, k, _ in want if k}
    assert sorted(map(tuple, spelling.variants(words).collect())) == want
    assert any(r != f for _, f, r, *_ in want if f)


def test_roots_of_long_chains(spark):
    """Each word is one letter from the next, which is five times as frequent."""
    chain = [("a" * k + "b" * (30 - k), 5**k) for k in range(26)]
    got = spelling.variants(spark.createDataFrame(chain, "word string, n long")).collect()
    assert {r["root"] for r in got} == {chain[-1][0]} and sum(r["form"] is None for r in got) == 1


def test_no_words(none):
    assert spelling.variants(spelling.vocabulary(none)).count() == 0


def test_checksums_of_parts():
    rnd = random.Random(2)
    words = [bytes(rnd.randrange(256) for _ in range(rnd.choice([0, 1, 6, 40, 255, 256, 900]))) for _ in range(200)]
    heads = [b"%d:" % rnd.randrange(10**9) for _ in words]
    got = spelling.checksums(np.array([zlib.crc32(h) for h in heads], np.uint32), words, np.arange(len(words)))
    assert got.tolist() == [zlib.crc32(h + w) for h, w in zip(heads, words)]


# -- divergence -------------------------------------------------------------------------------------------------------


def slow_audit(rows, min_docs, top=50):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
        groups.add((lang, source))
        count[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, source in groups:
        kept = [t for t, d in docs[lang].items() if d >= min_docs]

        def p(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        mine, every = p(count[lang, source]), p(sum((count[g] for g in groups if g[0] == lang), Counter()))
        pairs = [(sum(abs(mine[t] - q) for t, q in p(count[lang, o]).items()), o) for la, o in groups if la == lang and o != source]
        terms = [(mine[t] - every[t], t) for t in kept if count[lang, source][t] and mine[t] > every[t]]
        for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(out)


@pytest.mark.parametrize("chunk, block", [(4096, 64), (3, 2), (1, 1)])
def test_audit(odd, chunk, block):
    rows = [tuple(r) for r in odd.select("text", "lang", "source").collect()]
    got = divergence.audit(odd, min_docs=3, chunk=chunk, block=block)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == slow_audit(rows, 3)


def test_audit_of_languages_without_terms(odd, none):
    assert {r["value"] for r in divergence.audit(odd, min_docs=1000).collect()} == {0}
    assert divergence.audit(none).count() == 0


def test_audit_against_sql(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    want = sorted(con.execute(divergence.oracle_sql()).fetchall())
    assert sorted(map(tuple, divergence.query(spark, "/root/testdata/sf0.01").collect())) == want and any(r[2] == "term" for r in want)


def test_shares_do_not_overflow(spark):
    rnd = random.Random(4)
    rows = [(rnd.randrange(10**15), rnd.randrange(10**15)) for _ in range(200)]
    rows = [(a, a + b + 5) for a, b in rows]
    want = [1 + 10**9 * (a + 5) // t for a, t in rows]
    got = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, a long, t long")
    from pyspark.sql import functions as F

    assert [r[0] for r in got.orderBy("k").select(divergence.share(F.col("a"), F.col("t"))).collect()] == want
    assert divergence.shares(*(np.array(x, np.int64) for x in zip(*rows))).tolist() == want


# -- sharding ---------------------------------------------------------------------------------------------------------


def slow_map(sizes, shards, held=None):
    """slot -> shard by the greedy rule, in plain Python."""
    held = held or {}
    loads = [0] * shards
    fair = -(-sum(b + 1 for b in sizes.values()) // shards)
    out, free = {}, []
    by = defaultdict(list)
    for s in sizes:
        by[held.get(s)].append(s)
    for shard, slots in by.items():
        total = 0
        for s in sorted(slots, key=lambda s: (-sizes[s], s)):
            total += sizes[s] + 1
            if shard is not None and shard < shards and total <= fair:
                out[s] = shard
                loads[shard] += sizes[s] + 1
            else:
                free.append(s)
    for s in sorted(free, key=lambda s: (-sizes[s], s)):
        k = min(range(shards), key=lambda k: (loads[k], k))
        out[s] = k
        loads[k] += sizes[s] + 1
    return out


def check_sharding(docs, got, shards=16):
    texts = sorted((r["doc_id"] is not None, r["doc_id"] or 0, len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.select("doc_id", "text").collect())
    rows = got.collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in rows) == texts
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(shards))


def test_sharding(spark, odd, small, none):
    for docs in (odd, small, none):
        rows = sharding.records(docs)
        sizes = sharding.slot_sizes(rows)
        table = sharding.first_map(sizes)
        known = {r["virtual_slot"]: r["bytes"] for r in sizes.collect()}
        assert len(known) == sharding.SLOTS and {r["virtual_slot"]: r["shard"] for r in table.collect()} == slow_map(known, 16)
        check_sharding(docs, sharding.placed(rows, table))
    got = sharding.query(spark, D)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    loads = Counter()
    for r in got.collect():
        assert r["law"] == "bytes" and r["grown_shard"] is None
        loads[r["shard"]] += r["size"]
    assert len(loads) == 16 and max(loads.values()) < 1.1 * min(loads.values())


@pytest.mark.parametrize("shards", [1, 3, 17, 40])
def test_rebalancing_edits_the_map(spark, small, shards, tmp_path):
    folder = f"file://{tmp_path}/map"
    rows = sharding.records(small, 512)
    sizes = sharding.slot_sizes(rows, 512).cache()
    known = {r["virtual_slot"]: r["bytes"] for r in sizes.collect()}
    assert sharding.store_map(sharding.first_map(sizes, 16), folder) == 1
    first = {r["virtual_slot"]: r["shard"] for r in sharding.load_map(spark, folder).collect()}
    assert sharding.store_map(sharding.rebalanced(sharding.load_map(spark, folder), sizes, shards), folder) == 2
    second = {r["virtual_slot"]: r["shard"] for r in sharding.load_map(spark, folder).collect()}
    assert second == slow_map(known, shards, first) and sharding.versions(spark, folder) == [1, 2]
    assert {r["virtual_slot"]: r["shard"] for r in sharding.load_map(spark, folder, 1).collect()} == first
    if shards == 17:
        assert sum(known[s] for s in known if first[s] != second[s]) < 1.5 * sum(known.values()) / 17
    check_sharding(small, sharding.placed(rows, sharding.load_map(spark, folder)), shards)
    with pytest.raises(ValueError):
        sharding.load_map(spark, folder, 9)
    with pytest.raises(ValueError):
        sharding.load_map(spark, f"file://{tmp_path}/nothing")
