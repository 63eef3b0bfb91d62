"""Spelling variants against plain deletions."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from conftest import SMALL
from roadloom.llm import spelling
from roadloom.llm.queries import op12_spelling


def words_of(docs):
    total = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def brute(n):
    """Pairs by the words with one character taken out, each checked."""
    by = {}
    for w in n:
        for x in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            by.setdefault(x, set()).add(w)

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: set() for w in n}
    for group in by.values():
        for a, b in itertools.combinations(group, 2):
            if one_edit(a, b):
                near[a].add(b)
                near[b].add(a)
    form = {}
    for w, ws in near.items():
        best = min(ws, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def rows(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def found(spark, n):
    return rows(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long")))


def planted(seed, size, alphabet="abcé", lengths=(6, 7, 8, 9)):
    rng = random.Random(seed)
    out = {}
    while len(out) < size:
        w = "".join(rng.choices(alphabet, k=rng.choice(lengths)))
        out[w] = rng.choice([5, 6, 24, 25, 26, 125, 700, 4000])
    return out


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(words_of(docs))
    assert rows(op12_spelling(spark, SMALL)) == want
    assert any(w[1] for w in want)


def test_dense_words(spark):
    n = planted(1, 700)
    assert found(spark, n) == brute(n)


def test_large_groups_are_split(spark, monkeypatch):
    monkeypatch.setattr(spelling, "GROUP", 3)
    monkeypatch.setattr(spelling, "CHUNK", 50)
    n = planted(2, 300, "ab")
    assert found(spark, n) == brute(n)


def test_runs_of_one_letter_and_long_words(spark):
    n = {"a" * k: 5**k for k in range(6, 14)} | {"ab" * 2_000: 30, "ab" * 2_000 + "a": 5, "ab" * 1_999 + "b": 6, "aaaaaab": 5, "baaaaaa": 5}
    assert found(spark, n) == brute(n)


def test_odd_rows(spark, monkeypatch):
    """Nulls, no words, rows and ids twice, very long texts, signs inside the range."""
    monkeypatch.setattr(spelling, "HELD", 3)
    docs = [(None, "Wörter wörter"), (1, None), (2, ""), (3, "short"), (4, "Übung×÷ÿÀ " * 9), (4, "Übung×÷ÿÀ " * 9), (5, "colour colour color Colors " * 60_000), (6, "wörter WÖRTER wörter wOrter worter"), (7, "wörter " * 30)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as doc", "'x' as word", "null as n")
    assert rows(spelling.spelling(df)) == brute(words_of(docs))
    assert rows(spelling.spelling(df.limit(0))) == set()


@pytest.mark.parametrize("size", [1, 2, 3, 64, 300])
def test_wavelet_tree_reports_rectangles(size):
    rng = np.random.default_rng(size)
    values = rng.permutation(size)
    tree = spelling.Wavelet(values)
    x, y = (np.sort(rng.integers(0, size + 1, (2, 50)), axis=0) for _ in range(2))
    query, value = tree.report(x[0], x[1], y[0], y[1])
    want = {(q, int(v)) for q in range(50) for v in values[x[0][q] : x[1][q]] if y[0][q] <= v < y[1][q]}
    assert set(zip(query.tolist(), value.tolist())) == want and len(query) == len(want)
