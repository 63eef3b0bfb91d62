"""Near duplicates against brute force over all pairs."""

import random
import re

import numpy as np

from roadloom.llm import minhash


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def brute(docs):
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    where = {}
    for i in ids:
        for s in sets[i]:
            where.setdefault(s, []).append(i)
    for i in ids:
        for j in {j for s in sets[i] for j in where[s] if j < i}:
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def run(spark, docs):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}


def planted(seed, groups=12, rounds=8):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    docs, n = [], 0
    for g in range(groups):
        base = rng.choices(words, k=rng.choice([3, 5, 8, 40, 120, 300]))
        for _ in range(rng.randint(1, rounds)):
            body = list(base)
            for _ in range(rng.randint(0, max(1, len(body) // 25))):
                body[rng.randrange(len(body))] = rng.choice(words)
            if rng.random() < 0.3:
                base = body  # chains
            docs.append((n, "  ".join(w.upper() if rng.random() < 0.1 else w for w in body) + rng.choice(["", "\n", " \t"])))
            n += 1
    return [*docs, (n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one two"), (n + 4, "one  TWO")]


def test_planted(spark, monkeypatch):
    docs = planted(1)
    want = brute(docs)
    assert run(spark, docs) == want
    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 200)
    assert run(spark, docs) == want


def test_large_group(spark, monkeypatch):
    """A group of near copies, few of which are linked to any one: what is emitted stays below the classes, not their pairs."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(2000)]
    base = rng.choices(words, k=60)
    docs = []
    for n in range(600):
        body = list(base)
        for _ in range(rng.randint(1, 3)):
            body[rng.randrange(60)] = rng.choice(words)
        docs.append((n, " ".join(body)))
    want, made, plain = brute(docs), {}, minhash.stage
    for block in (2000, 50):

        def counted(df, label):
            made[label] = plain(df, label)
            return made[label]

        monkeypatch.setattr(minhash, "stage", counted)
        monkeypatch.setattr(minhash, "BLOCK", block)
        monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 1 << 20 if block > 50 else 10_000)
        assert run(spark, docs) == want
        assert made["star-links"].count() < len(docs)
        if "across-links" in made:
            assert made["members"].count() <= len(docs) and made["across-links"].where("a <> b").count() < len(docs) * (1 if block > 50 else 4)


def test_links_without_stars(spark, monkeypatch):
    """Components are whole even if the stars find no link at all."""
    docs = planted(3, 6, 8)
    monkeypatch.setattr(minhash, "_star_links", lambda pairs, *rest: pairs.limit(0))
    assert run(spark, docs) == brute(docs)
    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 200)
    assert run(spark, docs) == brute(docs)


def test_drop_near_copies(spark):
    t = "a b c d e f g h"
    rows = [(1, t, 5, "x", True), (1, t, 5, "x", True), (2, t.upper(), 6, "y", False), (3, None, 7, "z", None), (3, None, 8, "z", None), (4, "", 9, None, None), (None, t, 1, "n", None), (None, None, 2, "m", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, of int, by string, kept boolean")
    got = minhash.drop_near_copies(docs)
    assert got.columns == docs.columns
    assert sorted((str(r[0]), r[1]) for r in got.collect()) == [("1", t), ("3", None), ("4", ""), ("None", None)]
    assert minhash.drop_near_copies(docs.limit(0)).collect() == []


def test_tables(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    docs = [(r[0], r[1]) for r in rows]
    assert run(spark, docs) == brute(docs)


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**64, 400, np.uint64)
    b = np.concatenate([a[:320], rng.integers(0, 2**64, 80, np.uint64)])
    s = minhash.sketches([np.unique(a), np.unique(b), a[:1], a[:0]])
    assert (s[:3] != minhash._EMPTY).all() and (s[3] == minhash._EMPTY).all()
    assert abs((s[0] == s[1]).mean() - 320 / 480) < 0.15


def test_odd_rows(spark):
    assert run(spark, []) == {}
    t = "a b c d e f g h"
    got = minhash.near_duplicates(spark.createDataFrame([(None, t, 1), (4, t, 2), (4, t, 3), (None, None, 4)], "doc_id long, text string, n int")).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in got) == [("4", 4, "4", True), ("4", 4, "4", True), ("None", 0, "None", True), ("None", 4, "4", False)]
