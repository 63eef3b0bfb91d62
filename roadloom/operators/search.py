"""Shortest-path search over an edge table (tail, head, weight).

Two interchangeable back-ends with equal distances:
  loop   frontier joins and minimum aggregations until nothing improves; any size of network, all
         queries in one loop by the key column `q`
  local  many independent queries over a network of checked size: its arrays go to the tasks, which
         answer their share of the queries with a heap
`search` picks by the number of edges (`LOCAL_EDGES`).
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Networks of at most so many edges are sent to the tasks.
LOCAL_EDGES = 5_000_000


def loop(edges: DataFrame, seeds: DataFrame, cap: int | None = None, prune: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """q, node, dist, pred of everything reachable from seeds (q, node, dist).

    pred is the smallest tail among the last edges of shortest paths found first; null for seeds.
    cap: no distances beyond it. prune: keeps candidates (q, node, dist) for which it holds."""
    edges = cut(edges.select("tail", "head", "weight").where("weight is not null").groupBy("tail", "head").agg(F.min("weight").alias("weight")))
    state = cut(seeds.groupBy("q", "node").agg(F.min("dist").alias("dist")).select("q", "node", "dist", F.lit(None).cast("long").alias("pred"), F.lit(True).alias("fresh")))
    while state.where("fresh").head(1):
        cand = state.where("fresh").alias("f").join(edges.alias("e"), F.col("f.node") == F.col("e.tail"))
        cand = cand.select("f.q", F.col("e.head").alias("node"), (F.col("f.dist") + F.col("e.weight")).alias("dist"), F.col("e.tail").alias("pred"), F.lit(None).cast("long").alias("old"))
        if cap is not None:
            cand = cand.where(F.col("dist") <= cap)
        if prune is not None:
            cand = cand.where(prune(cand))
        both = state.select("q", "node", "dist", "pred", F.col("dist").alias("old")).union(cand)
        best = both.groupBy("q", "node").agg(F.min(F.struct("dist", "pred")).alias("b"), F.max("old").alias("old"))
        state = cut(best.select("q", "node", "b.dist", "b.pred", (F.col("old").isNull() | (F.col("b.dist") < F.col("old"))).alias("fresh")))
    return state.drop("fresh")


class Csr:
    """A network's edges by tail, with dense positions for its node ids. Arrays, read through views that give plain integers:
    lists of as many numbers are five times as large."""

    def __init__(self, tail: np.ndarray, head: np.ndarray, weight: np.ndarray):
        self.ids = np.unique(np.concatenate([tail, head]))
        small = np.int32 if len(self.ids) <= 1 << 31 else np.int64
        t, h = np.searchsorted(self.ids, tail).astype(small), np.searchsorted(self.ids, head).astype(small)
        order = np.lexsort((weight, h, t))
        self.arrays = [np.searchsorted(t[order], np.arange(len(self.ids) + 1, dtype=small)).astype(np.int64), h[order], np.ascontiguousarray(weight[order])]
        self._view()

    def _view(self) -> None:
        self.first, self.head, self.weight = map(memoryview, self.arrays)

    def __getstate__(self) -> tuple:
        return self.ids, self.arrays

    def __setstate__(self, state: tuple) -> None:
        self.ids, self.arrays = state
        self._view()

    def at(self, node: int) -> int | None:
        k = int(np.searchsorted(self.ids, node))
        return k if k < len(self.ids) and self.ids[k] == node else None

    def dijkstra(self, starts: list[tuple[int, int]], cap: int | None = None, target: int | None = None) -> tuple[dict[int, int], dict[int, int]]:
        """Distances and predecessors (smallest tail among ties), by position."""
        dist: dict[int, int] = {}
        pred: dict[int, int] = {}
        heap = []
        for node, d in starts:
            if d < dist.get(node, d + 1):
                dist[node] = d
                heap.append((d, node))
        heapq.heapify(heap)
        first, head, weight = self.first, self.head, self.weight
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            if u == target:
                break
            for k in range(first[u], first[u + 1]):
                v, new = head[k], d + weight[k]
                if cap is not None and new > cap:
                    continue
                old = dist.get(v)
                if old is None or new < old:
                    dist[v], pred[v] = new, u
                    heapq.heappush(heap, (new, v))
                elif new == old and v in pred and u < pred[v]:
                    pred[v] = u
        return dist, pred

    def turned(self) -> Csr:
        """The same network backwards."""
        first, head, weight = self.arrays
        return Csr(self.ids[head], np.repeat(self.ids, np.diff(first)), weight) if len(self.ids) else self

    def to_all(self, start: int, targets: set[int]) -> dict[int, int]:
        """Distances of the targets; ends when all of them are settled."""
        dist, heap, left, out = {start: 0}, [(0, start)], set(targets), {}
        first, head, weight = self.first, self.head, self.weight
        while heap and left:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            if u in left:
                left.discard(u)
                out[u] = d
            for k in range(first[u], first[u + 1]):
                v, new = head[k], d + weight[k]
                if new < dist.get(v, new + 1):
                    dist[v] = new
                    heapq.heappush(heap, (new, v))
        return out

    def around(self, start: int, ends: set[int]) -> tuple[dict[int, int], int | None]:
        """Distances of all nodes that are settled until the last of `ends` is, and the least that any other node's can be
        (None: no other one is reached)."""
        dist, heap, left, done = {start: 0}, [(0, start)], set(ends), {}
        first, head, weight = self.first, self.head, self.weight
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            if not left:
                return done, d
            done[u] = d
            left.discard(u)
            for k in range(first[u], first[u + 1]):
                v, new = head[k], d + weight[k]
                if new < dist.get(v, new + 1):
                    dist[v] = new
                    heapq.heappush(heap, (new, v))
        return done, None

    def beyond(self, start: int, least: int) -> tuple[int, int] | None:
        """The nearest node farther away than `least` and its distance (ties: smaller node); none if there is none."""
        dist, heap, best = {start: 0}, [(0, start)], None
        first, head, weight = self.first, self.head, self.weight
        while heap and (best is None or heap[0][0] == best[0]):
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            if d > least and (best is None or (d, u) < best):
                best = d, u
            for k in range(first[u], first[u + 1]):
                v, new = head[k], d + weight[k]
                if new < dist.get(v, new + 1):
                    dist[v] = new
                    heapq.heappush(heap, (new, v))
        return None if best is None else (best[1], best[0])

    def astar(self, start: int, target: int, potential: Callable[[int], int | None]) -> tuple[int | None, int]:
        """Distance (None: no way) and the number of settled nodes. Nodes come in order of distance plus potential, a
        lower bound of what is left (None: target out of reach); the search ends when that order passes the best way
        found, so potentials needn't be consistent."""
        pi = potential(start)
        dist, heap, settled, best = {start: 0}, [] if pi is None else [(pi, 0, start)], 0, None
        while heap:
            key, d, u = heapq.heappop(heap)
            if best is not None and key >= best:
                break
            if d > dist[u]:
                continue
            settled += 1
            if u == target:
                best = d
                continue
            for k in range(self.first[u], self.first[u + 1]):
                v, new = self.head[k], d + self.weight[k]
                if new < dist.get(v, new + 1) and (pi := potential(v)) is not None and (best is None or new + pi < best):
                    dist[v] = new
                    heapq.heappush(heap, (new + pi, new, v))
        return best, settled

    def meet(self, back: Csr, start: int, target: int, policy: str = "min_key", potential: Callable[[int, int], int] | None = None) -> tuple[int | None, int]:
        """Distance (None: no way) and settled nodes of a search from both ends; `back` is this network backwards with the
        same positions. policy: min_key goes on at the side with the smaller key, alternating in turns. potential(side,
        node): bounds of what is left of the way, pruning only; it ends when no meeting can be shorter than the best."""
        graphs, ends = (self, back), (start, target)
        dist, heaps = [{start: 0}, {target: 0}], [[(0, start)], [(0, target)]]
        best, settled, side = (0 if start == target else None), 0, 1
        while heaps[0] and heaps[1] and (best is None or heaps[0][0][0] + heaps[1][0][0] < best):
            side = 1 - side if policy == "alternating" else int(heaps[1][0] < heaps[0][0])
            d, u = heapq.heappop(heaps[side])
            if d > dist[side][u] or (potential and best is not None and d + potential(side, u) >= best):
                continue
            settled += 1
            g = graphs[side]
            for k in range(g.first[u], g.first[u + 1]):
                v, new = g.head[k], d + g.weight[k]
                if new < dist[side].get(v, new + 1):
                    dist[side][v] = new
                    heapq.heappush(heaps[side], (new, v))
                    if v in dist[1 - side] and (best is None or new + dist[1 - side][v] < best):
                        best = new + dist[1 - side][v]
        return best, settled


def csr(edges: DataFrame) -> Csr | None:
    """The network's arrays if it is small enough to send to tasks."""
    clean = edges.select("tail", "head", "weight").where("weight is not null")
    if clean.count() > LOCAL_EDGES:
        return None
    # as Arrow's columns; rows would be Python objects, hundreds of bytes each
    x = clean.select(*(F.col(c).cast("long").alias(c) for c in clean.columns)).toArrow()
    return Csr(*(x[c].to_numpy() for c in ("tail", "head", "weight")))


def local(graph: Csr, seeds: DataFrame, cap: int | None = None, partitions: int = 16) -> DataFrame:
    shared = seeds.sparkSession.sparkContext.broadcast(graph)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = shared.value
        for part in parts:
            for q, rows in part.groupby("q"):
                starts = [(g.at(v), d) for v, d in zip(rows["node"], rows["dist"])]
                lone = [(v, d) for (k, d), v in zip(starts, rows["node"]) if k is None]
                dist, pred = g.dijkstra([s for s in starts if s[0] is not None], cap)
                nodes = list(dist)
                out = pd.DataFrame({"q": q, "node": g.ids[nodes] if nodes else [], "dist": [dist[v] for v in nodes], "pred": [int(g.ids[pred[v]]) if v in pred else None for v in nodes]})
                if lone:
                    out = pd.concat([out, pd.DataFrame({"q": q, "node": [v for v, _ in lone], "dist": [d for _, d in lone], "pred": None})])
                yield out.astype({"q": "int64", "node": "int64", "dist": "int64", "pred": "Int64"})

    return seeds.select(*(F.col(c).cast("long").alias(c) for c in ("q", "node", "dist"))).repartition(partitions, "q").sortWithinPartitions("q").groupBy("q").applyInPandas(lambda x: pd.concat(list(run(iter([x])))), "q long, node long, dist long, pred long")


def search(edges: DataFrame, seeds: DataFrame, cap: int | None = None) -> DataFrame:
    graph = csr(edges)
    return local(graph, seeds, cap) if graph is not None else loop(edges, seeds, cap)


def one_to_all(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source node: source, node, dist."""
    seeds = sources.select(F.col("node").alias("q"), "node", F.lit(0).cast("long").alias("dist")).distinct()
    return search(edges, seeds).select(F.col("q").alias("source"), "node", "dist")


def _by_query(graph: Csr, od: DataFrame, answer: Callable[[Csr, pd.DataFrame], list[tuple]], partitions: int = 16, by: str = "src") -> DataFrame:
    """query_id, src, dst, dist, settled by answer(network, queries), a row for each query, on the tasks."""
    shared = od.sparkSession.sparkContext.broadcast(graph)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = answer(shared.value, part)
            yield pd.DataFrame({"query_id": part["query_id"], "src": part["src"], "dst": part["dst"], "dist": pd.array([x[0] for x in found], "Int64"), "settled": pd.array([x[1] for x in found], "Int64")})

    return od.select("query_id", "src", "dst").repartition(partitions, by).mapInPandas(run, "query_id long, src long, dst long, dist long, settled long")


def pairs(edges: DataFrame, od: DataFrame) -> DataFrame:
    """query_id, src, dst, dist (null if unreachable) of od (query_id, src, dst); a local search ends when all
    targets of a source are settled."""
    graph = csr(edges)
    if graph is None:
        reached = one_to_all(edges, od.select(F.col("src").alias("node")).distinct())
        return od.join(reached, (od.src == reached.source) & (od.dst == reached.node), "left").select("query_id", "src", "dst", "dist")

    def answer(g: Csr, part: pd.DataFrame) -> list[tuple]:
        known = {}
        for src, rows in part.groupby("src"):
            at = {t: g.at(t) for t in rows["dst"]}
            found = g.to_all(g.at(src), {k for k in at.values() if k is not None}) if g.at(src) is not None else {}
            known |= {(src, t): 0 if t == src else found.get(k) for t, k in at.items()}
        return [(known[x], None) for x in zip(part["src"], part["dst"])]

    return _by_query(graph, od, answer).select("query_id", "src", "dst", "dist")


def bidirectional(edges: DataFrame, od: DataFrame, policy: str = "min_key") -> DataFrame:
    """As `pairs`, by a search from both ends that stops when no meeting can be better (policy min_key or
    alternating); networks that don't fit into a task are searched to the end from both sides."""
    graph = csr(edges)
    if graph is not None:

        def answer(g: Csr, part: pd.DataFrame) -> list[tuple]:
            back = g.turned()
            ends = [(s, t, g.at(s), g.at(t)) for s, t in zip(part["src"], part["dst"])]
            return [(0 if s == t else None, 0) if a is None or b is None else g.meet(back, a, b, policy) for s, t, a, b in ends]

        return _by_query(graph, od, answer).select("query_id", "src", "dst", "dist")
    forward = one_to_all(edges, od.select(F.col("src").alias("node")).distinct()).select(F.col("source").alias("src"), "node", F.col("dist").alias("df"))
    reverse = edges.select(F.col("head").alias("tail"), F.col("tail").alias("head"), "weight")
    backward = one_to_all(reverse, od.select(F.col("dst").alias("node")).distinct()).select(F.col("source").alias("dst"), "node", F.col("dist").alias("db"))
    met = od.join(forward, "src").join(backward, ["dst", "node"]).groupBy("query_id").agg(F.min(F.col("df") + F.col("db")).alias("dist"))
    return od.join(met, "query_id", "left").select("query_id", "src", "dst", "dist")


def astar(edges: DataFrame, od: DataFrame, potential: DataFrame | None = None) -> DataFrame:
    """As `pairs`, with settled (the number of nodes settled; null beyond LOCAL_EDGES): nodes come in order of
    distance plus potential (dst, node, pi), which must not overestimate; nodes without one can't reach dst. No
    potential: 0 everywhere. Queries of one target meet its potentials in one task."""
    graph = csr(edges)
    if graph is None:
        return _astar_loop(edges, od, potential).withColumn("settled", F.lit(None).cast("long"))
    if potential is None:
        return _by_query(graph, od, lambda g, part: [(0 if s == t else None, 0) if g.at(s) is None or g.at(t) is None else g.astar(g.at(s), g.at(t), lambda v: 0) for s, t in zip(part["src"], part["dst"])])
    shared = od.sparkSession.sparkContext.broadcast(graph)

    def run(queries: pd.DataFrame, bounds: pd.DataFrame) -> pd.DataFrame:
        g, rows = shared.value, []
        pi = {g.at(v): p for v, p in zip(bounds["node"], bounds["pi"])}
        for q, s, t in zip(queries["query_id"], queries["src"], queries["dst"]):
            a, b = g.at(s), g.at(t)
            rows.append((q, s, t, *((0 if s == t else None, 0) if a is None or b is None else g.astar(a, b, pi.get))))
        return pd.DataFrame(rows, columns=["query_id", "src", "dst", "dist", "settled"]).astype({"dist": "Int64"})

    asked, bounds = od.select("query_id", "src", "dst").groupBy("dst"), potential.select("dst", "node", "pi").where("pi is not null").groupBy("dst")
    return asked.cogroup(bounds).applyInPandas(run, "query_id long, src long, dst long, dist long, settled long").where("query_id is not null")


def astar_exact(edges: DataFrame, od: DataFrame) -> DataFrame:
    """As `astar`, with the exact distances to the target as potential. A task searches backwards from each of its targets until
    all of the target's sources are settled; nodes that aren't by then lie farther away than any source, which bounds what is left
    from them. Potentials are used where they are made, no table of all nodes for all targets is written."""
    graph = csr(edges)
    if graph is None:
        back = edges.select(F.col("head").alias("tail"), F.col("tail").alias("head"), "weight")
        pi = one_to_all(back, od.select(F.col("dst").alias("node")).distinct()).select(F.col("source").alias("dst"), "node", F.col("dist").alias("pi"))
        return astar(edges, od, pi)

    def answer(g: Csr, part: pd.DataFrame) -> list[tuple]:
        back, known = g.turned(), {}
        for t, rows in part.groupby("dst"):
            b, at = g.at(t), {s: g.at(s) for s in rows["src"]}
            done, more = back.around(b, {a for a in at.values() if a is not None}) if b is not None else ({}, None)
            for s, a in at.items():
                known[s, t] = (0 if s == t else None, 0) if a is None or b is None else g.astar(a, b, lambda v: done.get(v, more))
        return [known[x] for x in zip(part["src"], part["dst"])]

    return _by_query(graph, od, answer, by="dst")


def astar_batched(edges: DataFrame, od: DataFrame, potentials: DataFrame, dealt: DataFrame, far: int) -> DataFrame:
    """As `astar`, with potentials (batch, node, dist: one for each place of the batch, `far` or more: none) of targets that are dealt
    (rank, batch, place). A task takes the queries of a batch and its potentials as one array."""
    graph = csr(edges)
    if graph is None:
        every = potentials.select("batch", "node", F.posexplode("dist").alias("place", "pi")).where(F.col("pi") < far)
        return astar(edges, od, every.join(F.broadcast(dealt), ["batch", "place"]).select(F.col("rank").alias("dst"), "node", "pi"))
    shared = od.sparkSession.sparkContext.broadcast(graph)

    def run(queries: pd.DataFrame, bounds: pd.DataFrame) -> pd.DataFrame:
        g, rows = shared.value, []
        bounds = bounds[np.isin(bounds["node"].to_numpy(), g.ids)]
        pi = np.stack(bounds["dist"].tolist()) if len(bounds) else np.empty((0, 1), np.int64)
        row = np.full(len(g.ids), -1)
        row[np.searchsorted(g.ids, bounds["node"].to_numpy())] = np.arange(len(bounds))
        for q, s, t, place in zip(queries["query_id"], queries["src"], queries["dst"], queries["place"]):
            a, b = g.at(s), g.at(t)

            def left(v: int, k: int = place) -> int | None:
                x = int(pi[row[v], k]) if row[v] >= 0 else far
                return x if x < far else None

            rows.append((q, s, t, *((0 if s == t else None, 0) if a is None or b is None else g.astar(a, b, left))))
        return pd.DataFrame(rows, columns=["query_id", "src", "dst", "dist", "settled"]).astype({"dist": "Int64"})

    asked = od.select("query_id", "src", "dst").join(dealt.withColumnRenamed("rank", "dst"), "dst").groupBy("batch")
    return asked.cogroup(potentials.groupBy("batch")).applyInPandas(run, "query_id long, src long, dst long, dist long, settled long").where("query_id is not null")


def _astar_loop(edges: DataFrame, od: DataFrame, potential: DataFrame | None) -> DataFrame:
    """By rounds: a candidate goes on while its distance and potential stay below the way to the target that its
    query has found so far; that bound falls from round to round."""
    edges = cut(edges.select("tail", "head", "weight"))
    asked = od.select(F.col("query_id").alias("q"), "dst")
    state = cut(od.select(F.col("query_id").alias("q"), F.col("src").alias("node"), F.lit(0).cast("long").alias("dist"), F.lit(True).alias("fresh")))
    while state.where("fresh").head(1):
        bound = state.join(asked, "q").where("node = dst").select("q", F.col("dist").alias("bound"))  # a row for each query
        cand = state.where("fresh").alias("f").join(edges.alias("e"), F.col("f.node") == F.col("e.tail")).select("f.q", F.col("e.head").alias("node"), (F.col("f.dist") + F.col("e.weight")).alias("dist"))
        cand = cand.join(asked, "q").join(bound, "q", "left")
        if potential is None:
            cand = cand.withColumn("pi", F.lit(0))
        else:
            cand = cand.join(potential.select("dst", "node", "pi"), ["dst", "node"])
        cand = cand.where("bound is null or dist + pi < bound").select("q", "node", "dist", F.lit(None).cast("long").alias("old"))
        best = state.select("q", "node", "dist", F.col("dist").alias("old")).union(cand).groupBy("q", "node").agg(F.min("dist").alias("dist"), F.max("old").alias("old"))
        state = cut(best.select("q", "node", "dist", (F.col("old").isNull() | (F.col("dist") < F.col("old"))).alias("fresh")))
    found = state.select(F.col("q").alias("query_id"), F.col("node").alias("dst"), "dist")
    return od.join(found, ["query_id", "dst"], "left").select("query_id", "src", "dst", "dist")


def within(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """query_id, src, node of starts (query_id, src, low, high): the nodes at distances from low to high. No search goes farther,
    and nothing nearer leaves its task."""
    starts, graph = starts.select(*(F.col(c).cast("long").alias(c) for c in ("query_id", "src", "low", "high"))), csr(edges)
    if graph is not None:
        shared = starts.sparkSession.sparkContext.broadcast(graph)

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            g = shared.value
            for part in parts:
                for q, src, low, high in zip(*(part[c].tolist() for c in ("query_id", "src", "low", "high"))):
                    at = g.at(src)
                    found = [src] * (low <= 0 <= high) if at is None else g.ids[[v for v, d in g.dijkstra([(at, 0)], cap=high)[0].items() if d >= low]]
                    if len(found):
                        yield pd.DataFrame({"query_id": q, "src": src, "node": found})

        return starts.repartition(16, "query_id").mapInPandas(run, "query_id long, src long, node long")
    on = edges.where("weight is not null").groupBy("tail", "head").agg(F.min("weight").alias("weight"))
    seeds = starts.where("high >= 0").select(F.struct("query_id", "src", "low").alias("q"), F.col("src").alias("node"), F.struct(F.lit(0).cast("long").alias("dist"), "high").alias("label"))
    go_on = lambda a, e: F.when(a["dist"] + e("weight") <= a["high"], F.struct((a["dist"] + e("weight")).alias("dist"), a["high"].alias("high")))
    found = label_search(on, seeds, go_on, F.min, lambda a, b: a < b).where("label.dist >= q.low")
    return found.select("q.query_id", "q.src", "node")


def nearest_beyond(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """query_id, src, dst, dist of starts (query_id, src, least): the nearest node farther away than `least` (ties: smaller
    node); starts without one give no row. No search goes on behind such a node."""
    starts, graph = starts.select("query_id", "src", "least"), csr(edges)
    if graph is not None:
        shared = starts.sparkSession.sparkContext.broadcast(graph)

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            g = shared.value
            for part in parts:
                rows = []
                for q, src, least in zip(part["query_id"].tolist(), part["src"].tolist(), part["least"].tolist()):
                    at = g.at(src)
                    if at is not None and (found := g.beyond(at, least)) is not None:
                        rows.append((q, src, int(g.ids[found[0]]), found[1]))
                yield pd.DataFrame(rows, columns=["query_id", "src", "dst", "dist"])

        return starts.repartition(16, "query_id").mapInPandas(run, "query_id long, src long, dst long, dist long")
    on = edges.where("weight is not null").groupBy("tail", "head").agg(F.min("weight").alias("weight"))
    seeds = starts.select(F.struct("query_id", "src", "least").alias("q"), F.col("src").alias("node"), F.struct(F.lit(0).cast("long").alias("dist"), "least").alias("label"))
    go_on = lambda a, e: F.when((a["dist"] <= a["least"]) | (e("weight") == 0), F.struct((a["dist"] + e("weight")).alias("dist"), a["least"].alias("least")))
    found = label_search(on, seeds, go_on, F.min, lambda a, b: a < b).where("label.dist > label.least")
    best = found.groupBy("q").agg(F.min(F.struct(F.col("label.dist").alias("dist"), "node")).alias("b"))
    return best.select("q.query_id", "q.src", F.col("b.node").alias("dst"), "b.dist")


def unreachable(edges: DataFrame, od: DataFrame, look: int = 200) -> DataFrame:
    """query_id of the queries whose target can't be reached. Backwards from a target up to `look` nodes are looked at,
    which settles most cases; the rest is decided by the whole backward search."""
    graph = csr(edges.select("tail", "head", F.lit(0).alias("weight")))
    if graph is None:
        return pairs(edges, od).where("dist is null").select("query_id")

    def answer(g: Csr, part: pd.DataFrame) -> list[tuple]:
        back, out = g.turned(), []
        for s, t in zip(part["src"], part["dst"]):
            a, b = g.at(s), g.at(t)
            if a is None or b is None:
                out.append((0 if s == t else None, 0))
                continue
            seen, todo = {b}, [b]
            while todo and len(seen) < look and a not in seen:
                u = todo.pop()
                fresh = {back.head[k] for k in range(back.first[u], back.first[u + 1])} - seen
                seen |= fresh
                todo += fresh
            if a in seen or not todo:
                out.append((0 if a in seen else None, len(seen)))
            else:
                out.append((0 if a in back.dijkstra([(b, 0)])[0] else None, len(seen)))
        return out

    return _by_query(graph, od, answer).where("dist is null").select("query_id")


def paths(edges: DataFrame, od: DataFrame) -> DataFrame:
    """query_id, idx, node, dist along a shortest path; the predecessor of a node is the smallest tail of an edge (of more than
    weight 0) that lies on a shortest path to it. A task searches from each of its sources until their targets are settled and walks
    back; on networks that don't fit into a task, walks go back by pointer doubling."""
    od = od.where("src is not null and dst is not null").select(*(F.col(c).cast("long").alias(c) for c in ("query_id", "src", "dst"))).distinct()
    graph = csr(edges)
    if graph is None:
        return _paths_loop(edges, od)
    shared = od.sparkSession.sparkContext.broadcast(graph)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, back, out, size = shared.value, None, [], 0
        for part in parts:
            back = back or g.turned()
            for src, rows in part.groupby("src"):
                a, at = g.at(src), [g.at(t) for t in rows["dst"]]
                dist = g.around(a, {k for k in at if k is not None})[0] if a is not None else {}
                for q, t, v in zip(rows["query_id"].tolist(), rows["dst"].tolist(), at):
                    if v is None or v not in dist:
                        if t == src:
                            out.append(pd.DataFrame({"query_id": [q], "idx": [0], "node": [t], "dist": [0]}))
                        continue
                    way = []
                    while v is not None:
                        way.append(v)
                        d, before = dist[v], None
                        for k in range(back.first[v], back.first[v + 1]):
                            u, w = back.head[k], back.weight[k]
                            if w > 0 and dist.get(u) == d - w and (before is None or u < before):
                                before = u
                        v = before
                    way.reverse()
                    out.append(pd.DataFrame({"query_id": q, "idx": np.arange(len(way)), "node": g.ids[way], "dist": [dist[v] for v in way]}))
                    size += len(way)
                if size > 100_000:
                    yield pd.concat(out)
                    out, size = [], 0
        if out:
            yield pd.concat(out)

    return od.repartition(16, "src").mapInPandas(run, "query_id long, idx long, node long, dist long")


def _paths_loop(edges: DataFrame, od: DataFrame) -> DataFrame:
    """No table of all sources' nodes may be broadcast: Spark takes such tables for small, as they come of small ones."""
    seeds = od.select(F.col("src").alias("q"), F.col("src").alias("node"), F.lit(0).cast("long").alias("dist")).distinct()
    reached = loop(edges, seeds).select("q", "node", "dist").hint("merge")
    tight = (
        reached.alias("a")
        .join(edges.alias("e"), F.col("a.node") == F.col("e.tail"))
        .hint("merge")
        .join(reached.alias("b"), (F.col("b.node") == F.col("e.head")) & (F.col("b.q") == F.col("a.q")) & (F.col("b.dist") == F.col("a.dist") + F.col("e.weight")))
        .where("e.weight > 0")
        .groupBy("b.q", "b.node")
        .agg(F.min("e.tail").alias("pred"))
    )
    # on[q, node] = set of nodes on the path to `node`, grown by doubling: jump[k] leads 2^k steps back
    jump = cut(tight.select("q", "node", "pred"))
    walk = cut(od.select("query_id", F.col("src").alias("q"), F.col("dst").alias("node")).join(reached, ["q", "node"]).select("query_id", "q", "node", "dist"))
    while True:
        more = walk.join(jump.hint("merge"), ["q", "node"]).select("query_id", "q", F.col("pred").alias("node"))
        more = more.join(reached, ["q", "node"]).select("query_id", "q", "node", "dist")
        grown = cut(walk.union(more).distinct())
        if grown.count() == walk.count():
            break
        walk = grown
        step = jump.alias("j").hint("merge").join(jump.alias("k"), (F.col("j.q") == F.col("k.q")) & (F.col("j.pred") == F.col("k.node")))
        jump = cut(step.select("j.q", "j.node", "k.pred"))
    return walk.select("query_id", (F.row_number().over(Window.partitionBy("query_id").orderBy("dist")) - 1).cast("long").alias("idx"), "node", "dist")


def reachable(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Distinct nodes reachable from `sources` (node), themselves included."""
    hops = edges.select("tail", "head", F.lit(0).cast("long").alias("weight"))
    return search(hops, sources.select(F.lit(0).cast("long").alias("q"), "node", F.lit(0).cast("long").alias("dist")).distinct()).select("node").distinct()


def components_strong(edges: DataFrame, pivot: int) -> DataFrame:
    """Nodes of the strongly connected component of `pivot`: forward and backward reachable."""
    start = edges.sparkSession.createDataFrame([(pivot,)], "node long")
    reverse = edges.select(F.col("head").alias("tail"), F.col("tail").alias("head"), "weight")
    return reachable(edges, start).join(reachable(reverse, start), "node", "left_semi")


def dijkstra_ranks(edges: DataFrame, source: int) -> DataFrame:
    """Nodes at ranks 2^k in order of distance (ties: smaller node)."""
    start = edges.sparkSession.createDataFrame([(source, source, 0)], "q long, node long, dist long")
    ranked = search(edges, start).select("node", "dist", F.row_number().over(Window.partitionBy("q").orderBy("dist", "node")).cast("long").alias("rank"))
    return ranked.where(F.col("rank").bitwiseAND(F.col("rank") - 1) == 0)


def label_search(edges: DataFrame, seeds: DataFrame, link: Callable[[Column, Callable[[str], Column]], Column], merge: Callable[[Column], Column], better: Callable[[Column, Column], Column]) -> DataFrame:
    """q, node, label for labels of any kind that a column can hold. seeds (q, node, label); link(label, edge) is the label
    after an edge, of whose columns edge(name) gives one; merge aggregates a node's labels into its best; better(a, b)
    says that a improves on b. It ends when no label improves, so links must not improve labels around a circle."""
    edges = cut(edges)
    state = cut(seeds.groupBy("q", "node").agg(merge(F.col("label")).alias("label")).withColumn("fresh", F.lit(True)))
    while state.where("fresh").head(1):
        moved = state.where("fresh").alias("f").join(edges.alias("e"), F.col("f.node") == F.col("e.tail"))
        cand = moved.select("f.q", F.col("e.head").alias("node"), link(F.col("f.label"), lambda c: F.col(f"e.{c}")).alias("label"))
        best = cand.where("label is not null").groupBy("q", "node").agg(merge(F.col("label")).alias("new"))
        both = state.select("q", "node", "label").join(best, ["q", "node"], "full")
        gain = F.col("new").isNotNull() & (F.col("label").isNull() | better(F.col("new"), F.col("label")))
        state = cut(both.select("q", "node", F.when(gain, F.col("new")).otherwise(F.col("label")).alias("label"), gain.alias("fresh")))
    return state.drop("fresh")
