"""Benchmark decontamination against plain windows."""

import hashlib
import random
import re

import duckdb
from pyspark.sql import functions as F

from conftest import SMALL
from roadloom.llm import contamination, queries

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for name, text in items:
        w = words(text)
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add("" if name is None else str(name))
    out = []
    for doc, text in docs:
        w, hit, names = words(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if found := windows.get(tuple(w[i : i + k])):
                    hit |= set(range(i, i + k))
                    names |= found
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items):
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in contamination.contamination(d, b).collect()), key=str)


def planted(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(30)] + ["ñandú", "x1"]
    items = [(k % 25, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 4, 5, 6, 7, 9, 10, 11, 40])) if k % 3 else ["zz", *rng.choices(vocabulary, k=rng.choice([4, 30]))])) for k in range(30)]
    items = [x for x in items if len(x[1].split()) > 3 or x[0] == 4]
    docs = []
    for k in range(80):
        body = rng.choices(vocabulary, k=rng.randint(0, 60))
        if k % 2:
            item = rng.choice(items)[1].split()
            a = rng.randint(0, len(item) - 1)
            body[len(body) // 2 : len(body) // 2] = item[a:] if k % 4 == 1 else item
        docs.append((k, rng.choice([" ", ", ", "\n- "]).join(w.upper() if rng.random() < 0.2 and w.isascii() else w for w in body)))
    return docs, items


def test_planted(spark, monkeypatch):
    docs, items = planted(1)
    monkeypatch.setattr(contamination, "SHARD_BYTES", 700)  # several shards a task
    monkeypatch.setattr(contamination, "PAIRS", 5)
    assert run(spark, docs, items) == brute(docs, items)


def test_in_blocks(spark, monkeypatch):
    """A benchmark of several blocks, items of several pieces."""
    docs, items = planted(2)
    monkeypatch.setattr(contamination, "BLOCK_WORDS", 100)
    monkeypatch.setattr(contamination, "PIECE_WORDS", 12)
    assert run(spark, docs, items) == brute(docs, items)


def test_odd_rows(spark):
    """Nulls, no words, ids and rows twice, very long texts, one-word items."""
    long = "alpha beta gamma delta " * 100_000
    docs = [(1, None), (None, "one two three"), (2, ""), (2, ""), (3, "-- ++"), (4, long + "needle here"), (5, "Needle"), (5, "Needle"), (6, "ÉTÉ été"), (7, "a b c d e f g h i j k")]
    items = [(None, "needle"), (1, None), (2, ""), (3, "été"), (3, "été"), (4, "b c d e f g h i j k l"), (5, "a b c d e f g h i j"), (6, "beta gamma delta alpha " * 5)]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, [], items) == []
    assert run(spark, docs, []) == brute(docs, [])


def test_longest_matches(spark):
    text = [f"t{k}" for k in range(40)]
    docs = [(1, " ".join(["x", *text[5:30], "y", *text[2:14]])), (2, "nothing here")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, " ".join(text))], "item_id long, text string")
    row = contamination.matches(d, b).where("doc_id = 1").first()
    assert [tuple(x) for x in row["found"]] == [("9", 1, 5, 25)]
    assert [tuple(x) for x in row["spans"]] == [(1, 26), (27, 39)]


def test_clean_keeps_the_rest(spark, monkeypatch):
    docs, items = planted(3)
    bad = {r[0] for r in brute(docs, items) if r[5]}
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("plain_text", F.lit("x")).withColumn("spans", F.lit(1))
    b = spark.createDataFrame(items, "item_id long, text string")
    for size in (1_000_000, 100):
        monkeypatch.setattr(contamination, "BLOCK_WORDS", size)
        kept = contamination.clean(d, b)
        assert kept.columns == d.columns
        assert {r["doc_id"] for r in kept.collect()} == {x[0] for x in docs} - bad


def test_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    want = con.execute(queries.ORACLE["op13_decontamination"]).df()
    got = queries.op13_decontamination(spark, SMALL).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(str, got[columns].values.tolist())) == sorted(map(str, want[columns].values.tolist()))
    assert want["contaminated"].any() and not want["contaminated"].all()
