"""Levels of an elimination tree take rounds by the bits of its height."""

import random

from roadloom.operators import hierarchy as h


def test_levels_by_doubling(spark, monkeypatch):
    draw, cuts, cut = random.Random(3), [], h.cut
    monkeypatch.setattr(h, "cut", lambda df: cuts.append(1) or cut(df))
    parent = {k: k + 1 for k in range(69)} | {69: None} | {k: draw.randrange(k + 1, 200) if k < 199 else None for k in range(100, 200)} | {300: None}
    level = dict.fromkeys(parent, 0)
    for k in sorted(parent):
        if parent[k] is not None:
            level[parent[k]] = max(level[parent[k]], level[k] + 1)
    tree = spark.createDataFrame(list(parent.items()), "rank long, parent long")
    assert {r["rank"]: r["level"] for r in h.tree_levels(tree).collect()} == level
    assert len(cuts) <= 20
    assert [tuple(r) for r in h.tree_levels(tree.where("rank = 300")).collect()] == [(300, 0)]
