"""Repeated byte strings against brute force."""

import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from roadloom.llm import suffix


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.binary(max_size=60), st.text("ab", max_size=80).map(str.encode), st.text("abc", max_size=10).map(lambda x: x.encode() * 7)))
def test_suffix_array(s):
    assert suffix.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def brute(docs):
    """docs: (id, bytes) in order; the digest columns of each."""
    seen, out = set(), {}
    for doc_id, s in sorted(docs):
        gone = bytearray(len(s))
        for i in range(len(s) - 99):
            w = s[i : i + 100]
            if w in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(w)
        spans = bytes(gone).split(b"\0")
        out[doc_id] = (doc_id, len(s), sum(gone), sum(1 for x in spans if x), hashlib.sha256(bytes(c for c, g in zip(s, gone) if not g)).hexdigest())
    return out


def run(spark, docs, schema="doc_id long, text string"):
    return {r[0]: tuple(r)[:5] for r in suffix.remove_repeats(spark.createDataFrame(docs, schema)).collect()}


def test_planted(spark, monkeypatch):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgé", k=rng.randint(2, 8))) for _ in range(300)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    passages = [text(40) for _ in range(5)] + ["na" * 120, "x" * 350]
    docs = []
    for i in range(160):
        body = text(rng.randint(0, 150))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            body += " " + p[a : a + rng.randint(50, 400)] + text(rng.randint(0, 20))
        docs.append((i * 3, body))
    docs += [(1000 + i, docs[7][1]) for i in range(4)] + [(2000, ""), (2001, None), (2002, "ab" * 300), (2003, "ab" * 49)]
    want = brute([(i, (t or "").encode()) for i, t in docs])
    assert run(spark, docs) == want
    for name, value in (("HOT_CONTEXTS", 2), ("TASK_CONTEXTS", 50), ("STEP", 512)):
        monkeypatch.setattr(suffix, name, value)
        assert run(spark, docs) == want, name


def test_tables(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    docs = [(r[0], r[1]) for r in rows]
    assert run(spark, docs) == brute([(i, (t or "").encode()) for i, t in docs])


def test_odd_rows(spark):
    assert run(spark, []) == {}
    t = "".join(random.Random(1).choices("abcdef ", k=300))
    got = sorted((r[0] is None, r[0] or 0, r[2]) for r in suffix.remove_repeats(spark.createDataFrame([(None, t, 1), (5, t, 2), (5, t, 3), (6, t + "z", 4), (5, "q" + t, 5)], "doc_id long, text string, a int")).collect())
    # one of the rows with id 5 is the first, its repetition and all later ones lose the common text
    assert [g[2] for g in got if g[0]] == [300] and [g[2] for g in got if g[1] == 6] == [300]
    assert sorted(g[2] for g in got if g[1] == 5) == [0, 300, 300]


def test_clashing_windows(spark):
    """Two different windows under one hash at the last level: each one's later copy is found, the first ones are told apart by bytes."""
    x, y = bytearray(b"x" * suffix.WINDOW), bytearray(b"y" * suffix.WINDOW)
    rows = [(1, 5, x, 1, 0, 10, 110), (1, 5, y, 2, 0, 20, 120), (1, 5, y, 3, 0, 30, 130), (1, 5, x, 4, 0, 40, 140), (1, 6, x, 5, 0, 50, 150)]
    removed, judged, hot = suffix._level(spark.createDataFrame(rows, suffix._ROWS), None, 1 << 20)
    assert hot is None and judged.collect() == []
    assert sorted(map(tuple, removed.collect())) == [(3, 0, 30, 130), (4, 0, 40, 140)]


def test_common_gram(spark, monkeypatch):
    """One gram in many different contexts: each level makes few rows for each one that it reads."""
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choices("abcdefghijkl ", k=n))
    line = noise(96)
    docs = [(i, noise(150) + line + noise(150)) for i in range(400)] + [(500 + i, noise(150) + line + "!same" + noise(150)) for i in range(30)]
    monkeypatch.setattr(suffix, "HOT_CONTEXTS", 20)
    made = []
    plain = suffix.stage
    monkeypatch.setattr(suffix, "stage", lambda df, label: made.append((label, plain(df, label))) or made[-1][1])
    assert run(spark, docs) == brute([(i, t.encode()) for i, t in docs])
    sizes = [df.count() for label, df in made if label in ("contexts", "longer")]
    assert len(sizes) > 1 and all(n <= 20 * len(docs) for n in sizes)
