"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import zlib
from functools import cache

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from roadloom.llm import turns
from roadloom.llm.queries import op11_conversations

SPACE = " \t\n\x0b\f\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        elif kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.rstrip(SPACE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """Cost, audit and edited turns of the cheapest way through all edits, from the end backwards."""
    legal = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    names = {"u": "user", "a": "assistant"}

    @cache
    def best(i, state, inserts):
        ways = []
        if i == len(rows) and state in (0, 3):
            ways.append((0, "", ()))

        def add(cost, letter, rest, made):
            if rest:
                ways.append((cost + rest[0], letter + rest[1], made + rest[2]))

        if inserts < 3:
            for c, name in names.items():
                if c in legal[state]:
                    add(2, "I", best(i, legal[state][c], inserts + 1), ((name, ""),))
        if i < len(rows):
            role, text = rows[i]
            add(3, "D", best(i + 1, state, 0), ())
            if faults[i] not in ("blank", "duplicate"):
                cut = faults[i] == "truncated"
                if role[:1] in legal[state]:
                    add(cut, "K", best(i + 1, legal[state][role[:1]], 0), ((role, text),))
                for c, name in names.items():
                    if c in legal[state]:
                        add(2 + cut, "R", best(i + 1, legal[state][c], 0), ((name, text),))
        return min(ways) if ways else None

    return best(0, 0, 0)


def plain(rows):
    out = {}
    by_conv = {}
    for r in damaged(rows):
        by_conv.setdefault(r[0], []).append(r)
    for conv in {r[0] for r in rows}:
        own = sorted(by_conv.get(conv, []), key=lambda r: (r[1] is not None, r[1] or 0))
        said = [(r[2], r[3]) for r in own]
        faults = faults_of(said)
        numbers = [r[1] for r in own if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        initials = [r[:1] for r, _ in said]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, made = cheapest(tuple(said), tuple(faults)) if own else (0, "", ())
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, int(cost), audit, digest)
    return out


def same(found, rows):
    got = {None if pd.isna(r[0]) else int(r[0]): tuple(r[1:]) for r in found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").toPandas().itertuples(index=False, name=None)}
    want = plain(rows)
    assert got.keys() == want.keys()
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(op11_conversations(spark, SMALL), rows)


def random_rows(seed, n, turns_each, roles=("system", "user", "assistant", "tool")):
    rng = random.Random(seed)
    return [(c, t, rng.choice(roles), rng.choice(["a.", "b", "c!", "d?", " ", "e e.", "f \n", "g.\t"])) for c in range(n) for t in range(turns_each)]


def test_all_kinds_of_turns(spark):
    rows = random_rows(1, 150, 6)
    same(turns.repair_digest(spark.createDataFrame(rows, SCHEMA)), rows)


def test_long_conversations_go_in_blocks(spark, monkeypatch):
    """Several levels of blocks, conversations that span ranges."""
    monkeypatch.setattr(turns, "BLOCK", 3)
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), f"{rng.random()}" + rng.choice([".", "", "!"])) for c, n in ((1, 150), (2, 40), (3, 3), (4, 1)) for t in range(n)]
    same(turns.repair_digest(spark.createDataFrame(rows, SCHEMA).repartition(3)), rows)


def test_odd_rows(spark):
    """Nulls in all columns, empty and very long texts, no turns left, gaps, extra columns; ties by equal rows."""
    long = "word " * 300_000
    rows = [(None, 1, "user", "x."), (None, 2, "assistant", "y."), (7, None, None, None), (7, None, "user", "z."), (8, 3, "user", long), (8, 9, "assistant", long + "."), (8, 9, "assistant", long + "."), (9, None, "tool", "")]
    rows += [(k, 0, "user", "a.") for k in range(40, 80)]  # some of them are dropped
    df = spark.createDataFrame(rows, SCHEMA).withColumn("conv", F.lit(1)).withColumn("id", F.lit("x")).withColumn("K", F.lit(None).cast("string"))
    same(turns.repair_digest(df), rows)


def test_empty(spark):
    assert turns.repair_digest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Well?"), (1, 2, "tool", "x."), (2, 0, "system", "s."), (2, 1, "user", "u.")]
    fixed = turns.Repair(spark.createDataFrame(rows, SCHEMA)).repaired().collect()
    said = {}
    for r in sorted(fixed, key=lambda r: (r["conv_id"], r["id"] is None, r["id"] or 0, r["part"])):
        said.setdefault(r["conv_id"], []).append((r["role"], r["text"], r["edit"]))
    assert [x[2] for x in said[1]] == list("KIKR")
    assert [x[0] for x in said[1]] == ["user", "assistant"] * 2
    assert [x[0] for x in said[2]] == ["system", "user", "assistant"]


@pytest.mark.parametrize("roles", [("user",), ("assistant", "system"), ("s", "u", "a", "")])
def test_few_roles(spark, roles):
    rows = random_rows(5, 60, 5, roles)
    same(turns.repair_digest(spark.createDataFrame(rows, SCHEMA)), rows)
