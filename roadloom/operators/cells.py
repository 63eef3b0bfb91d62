"""Elimination in the order of ranks by cells, so that no task sees the network.

Below a rank that only one node in KEEP reaches, a network falls into components. What is inside of one is eliminated
without a look at any other, so each component of at most CELL nodes is a cell: one group, walked node by node in one task,
which gives the finished edges of its nodes and, for the network that is left, shortcuts between the cell's neighbours.
Rounds go on with what is left until nothing is. The number of rounds grows with the logarithm of the network, not with the
height of the elimination tree; a round is a few jobs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Most nodes of a cell.
CELL = 1024
#: So few pairs of nodes are joined to components in one task; cells are eliminated one by one at any size.
LOCAL_PAIRS = 1_000_000
#: One node in so many is left to the next round, if the cells below it aren't too large.
KEEP = 8


def components(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """rank, cell: the highest node that each of nodes (rank) is connected with by pairs (lo, hi)."""
    pairs = cut(pairs.select("lo", "hi"))
    if pairs.count() > LOCAL_PAIRS:
        return _components_loop(pairs, nodes)
    few = pairs.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(_components_local, "rank long, cell long")
    return nodes.join(few, "rank", "left").select("rank", F.coalesce("cell", "rank").alias("cell"))


def _components_local(part: pd.DataFrame) -> pd.DataFrame:
    top: dict[int, int] = {}

    def find(v: int) -> int:
        while top.setdefault(v, v) != v:
            top[v] = top.setdefault(top[v], top[v])
            v = top[v]
        return v

    for a, b in zip(part["lo"].tolist(), part["hi"].tolist()):
        a, b = sorted((find(a), find(b)))
        top[a] = b
    return pd.DataFrame([(v, find(v)) for v in list(top)], columns=["rank", "cell"])


def _components_loop(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """By the neighbours' labels and by their labels' labels, so that ways are halved in each round."""
    both = cut(pairs.select(F.col("lo").alias("a"), F.col("hi").alias("b")).union(pairs.select("hi", "lo")))
    now, total = cut(nodes.select("rank", F.col("rank").alias("cell"))), None
    while True:
        near = both.join(now, F.col("b") == F.col("rank")).groupBy(F.col("a").alias("rank")).agg(F.max("cell").alias("near"))
        step = now.join(near, "rank", "left").select("rank", F.greatest("cell", "near").alias("cell"))
        jump = now.select(F.col("rank").alias("cell"), F.col("cell").alias("far"))
        now = cut(step.join(jump, "cell").select("rank", F.greatest("cell", "far").alias("cell")))
        was, total = total, now.agg(F.sum(F.col("cell").cast("decimal(38,0)"))).first()[0]
        if was == total:
            return now


def next_cells(rest: DataFrame, most: int | None = None) -> DataFrame:
    """rank, cell of the nodes that a round eliminates: the small components (of at most `most` nodes, CELL by default) of the lowest nodes of rest (lo, hi), if they hold a
    good part of all; where it's too dense for that, as in the top separators, the lowest nodes of each component."""
    most = most or CELL
    nodes = cut(rest.select(F.col("lo").alias("rank")).union(rest.select("hi")).distinct())
    low, high, n = nodes.agg(F.min("rank"), F.max("rank"), F.count(F.lit(1))).first()
    if n <= most:
        return nodes.select("rank", F.lit(high).alias("cell"))
    share, first = 1 - 1 / KEEP, None
    for _ in range(3):
        below = max(int(nodes.approxQuantile("rank", [share], 0.001)[0]), low + 1)
        found = cut(components(rest.where(F.col("hi") < below).select("lo", "hi").distinct(), nodes.where(F.col("rank") < below)))
        small = found.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") <= most).select("cell")
        fits = cut(found.join(small, "cell", "left_semi").select("rank", "cell"))
        if 4 * fits.count() >= n:
            return fits
        share, first = share / 2, first or found
    place = F.row_number().over(Window.partitionBy("cell").orderBy("rank"))
    return first.withColumn("place", place).where(F.col("place") <= most).select("rank", "cell")


def eliminate(edges: DataFrame, run: Callable[[set[int], pd.DataFrame], pd.DataFrame], columns: str, combine: Callable[[DataFrame], DataFrame] | None = None, cells: DataFrame | None = None, streamed: bool = False) -> DataFrame:
    """lo, hi, the `columns` (as a schema), cell, round: the edges (lo, hi, columns) with the shortcuts of all eliminations.

    run(nodes, edges) eliminates a cell's nodes; edges are those up from its nodes, and it gives them finished together with
    shortcuts between higher nodes. combine makes one of parallel edges; without it `run` gets them all.
    streamed: the edges are given as a list of arrays (lo, hi) without columns, and come piece by piece, so that a task with
    many of them holds few as rows.
    cells: rank, cell, round of an earlier call for the same edges, if the weights only have changed."""
    names, one = edges.columns, combine or (lambda df: df)
    schema = f"lo long, hi long, {columns}, cell long, inner boolean"

    def of_cell(keys: tuple, part: pd.DataFrame) -> pd.DataFrame:
        nodes = set(part["rank"].tolist())
        out = run(nodes, part[part["hi"].notna()].astype({"lo": "int64", "hi": "int64"}))
        out["cell"], out["inner"] = keys[0], out["lo"].isin(nodes)
        return out

    def of_stream(keys: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nodes, parts = set(), []
        for part in batches:
            nodes.update(part["rank"].unique().tolist())
            ends = part.loc[part["hi"].notna(), ["lo", "hi"]]
            parts.append(tuple(ends[c].to_numpy(np.int64) for c in ("lo", "hi")))
        inner = np.array(sorted(nodes), np.int64)
        for out in run(nodes, parts):
            out["cell"], out["inner"] = keys[0], np.isin(out["lo"].to_numpy(), inner)
            yield out

    rest, done, k = cut(one(edges)), None, 0
    while rest.head(1):
        own = cut(next_cells(rest) if cells is None else cells.where(F.col("round") == k).select("rank", "cell"))
        part = own.join(rest, F.col("rank") == F.col("lo"), "left")
        out = cut(part.groupBy("cell").applyInPandas(of_stream if streamed else of_cell, schema))
        finished = out.where("inner").select(*names, "cell", F.lit(k).alias("round"))
        done = finished if done is None else done.union(finished)
        left = rest.join(own, F.col("rank") == F.col("lo"), "left_anti")
        rest, k = cut(one(left.union(out.where("not inner").select(*names)))), k + 1
    return done if done is not None else edges.withColumns({"cell": F.lit(0).cast("long"), "round": F.lit(0)})


def descend(done: DataFrame, run: Callable[[set[int], pd.DataFrame], pd.DataFrame], columns: str) -> DataFrame:
    """What `run` makes of finished edges (of `eliminate`) from the last round to the first. It gets a cell's edges and, made
    already, those between the cell's higher neighbours, which are all joined with each other."""
    names = [c for c in done.columns if c not in ("cell", "round")]

    def of_cell(keys: tuple, part: pd.DataFrame) -> pd.DataFrame:
        nodes = set(part["lo"][part["own"]].tolist())
        out = run(nodes, part[names])
        out = out[out["lo"].isin(nodes)].copy()
        out["cell"] = keys[0]
        return out

    made = None
    for (k,) in sorted(done.select("round").distinct().collect(), reverse=True):  # a row for each round
        own = done.where(F.col("round") == k).select(*names, "cell", F.lit(True).alias("own"))
        part = own
        if made is not None:
            edge = own.select("cell", F.col("hi").alias("x")).distinct()
            pairs = edge.join(edge.select("cell", F.col("x").alias("y")), "cell").where("x < y")
            between = pairs.join(made.select(*names), (F.col("x") == F.col("lo")) & (F.col("y") == F.col("hi")))
            part = own.unionByName(between.select(*names, "cell", F.lit(False).alias("own")))
        out = cut(part.groupBy("cell").applyInPandas(of_cell, f"lo long, hi long, {columns}, cell long").select(*names, "cell", F.lit(k).alias("round")))
        made = out if made is None else made.union(out)
    return done if made is None else made


def cells_of(done: DataFrame) -> DataFrame:
    """rank, cell, round, to eliminate the same edges with other weights. Nodes without higher neighbours need none."""
    return done.select(F.col("lo").alias("rank"), "cell", "round").distinct()
