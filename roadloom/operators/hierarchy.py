"""Customizable hierarchies: chordal completion, elimination tree, customization, hub labels.

Eliminations run by cells (`cells`); everything else is relational on their result: cch(lo, hi) with the weights
up and down.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .cells import cells_of, components, descend, eliminate  # noqa: F401
from .ordered import number_rows, running_sum
from .sweep import climb_each, potentials

INFINITE = float("inf")
#: No way, in whole numbers; two may be added.
FAR = np.int64(1 << 61)
#: Most pairs of nodes that one task searches depth first.
SEARCHED_PAIRS = 250_000
#: Edges of a cell that a task gives away at a time.
STREAMED = 1_000_000
#: Largest customized completion that goes to every task, as four arrays (128 MB).
MOST_SHARED = 4_000_000


def _edges(ids: np.ndarray, higher: list[tuple[int, np.ndarray]]) -> pd.DataFrame:
    los = np.repeat(np.array([v for v, _ in higher], np.int64), [len(x) for _, x in higher])
    return pd.DataFrame({"lo": ids[los], "hi": ids[np.concatenate([x for _, x in higher])] if higher else ids[:0], "none": None})


def contract(ranked: DataFrame) -> DataFrame:
    """lo, hi of `contracted_cells`."""
    return contracted_cells(ranked).select("lo", "hi")


def contracted_cells(ranked: DataFrame) -> DataFrame:
    """lo, hi, cell, round: edges between ranks (tail, head) completed so that the higher neighbours of every node form
    a clique, cell by cell. The neighbours of the lowest node go to its lowest neighbour, in ascending order."""

    def run(nodes: set[int], parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pd.DataFrame]:
        ranks = np.array(sorted(nodes), np.int64)
        ids = np.unique(np.concatenate([ranks, *(np.unique(x) for part in parts for x in part)]))
        own = np.searchsorted(ids, ranks)
        above = {int(v): np.zeros(len(ids), bool) for v in own}  # a row for each node with higher neighbours
        for lo, hi in parts:
            order = np.argsort(lo, kind="stable")
            values, starts = np.unique(lo[order], return_index=True)
            for v, some in zip(np.searchsorted(ids, values).tolist(), np.split(np.searchsorted(ids, hi[order]), starts[1:])):
                above[v][some] = True
        parts.clear()
        for v in own.tolist():
            if above[v].any():
                first = int(above[v].argmax())
                row = above.setdefault(first, np.zeros(len(ids), bool))
                row[first + 1 :] |= above[v][first + 1 :]
        some, n = [], 0
        for v, row in above.items():
            some.append((v, np.flatnonzero(row)))
            n += len(some[-1][1])
            if n >= STREAMED:
                yield _edges(ids, some)
                some, n = [], 0
        yield _edges(ids, some)

    pairs = ranked.where("tail <> head").select(F.least("tail", "head").alias("lo"), F.greatest("tail", "head").alias("hi"), F.lit(None).cast("boolean").alias("none"))
    return eliminate(pairs, run, "none boolean", lambda df: df.distinct(), streamed=True).select("lo", "hi", "cell", "round")


def elimination_tree(cch: DataFrame) -> DataFrame:
    """rank, parent: the lowest higher neighbour."""
    return cch.groupBy(F.col("lo").alias("rank")).agg(F.min("hi").alias("parent"))


def respecting(cch: DataFrame, ranked: DataFrame) -> DataFrame:
    """lo, hi, up, down: the smallest weight of an original edge in each direction (null: none)."""
    up = ranked.where("tail < head").groupBy(F.col("tail").alias("lo"), F.col("head").alias("hi")).agg(F.min("weight").alias("up"))
    down = ranked.where("tail > head").groupBy(F.col("head").alias("lo"), F.col("tail").alias("hi")).agg(F.min("weight").alias("down"))
    return cch.join(up, ["lo", "hi"], "left").join(down, ["lo", "hi"], "left")


def lower_triangles(cch: DataFrame) -> DataFrame:
    """low, mid, high of all triangles, by a join of the edges on their lower node."""
    a, b = cch.select(F.col("lo").alias("low"), F.col("hi").alias("mid")), cch.select(F.col("lo").alias("low"), F.col("hi").alias("high"))
    return a.join(b, "low").where("mid < high")


def _lightest(df: DataFrame) -> DataFrame:
    return df.groupBy("lo", "hi").agg(F.min("up").alias("up"), F.min("down").alias("down"))


def _places(nodes: set[int], part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All ranks of a cell and its edges, sorted; in them the places of the cell's nodes and of the edges' ends, by the lower one."""
    own, lo, hi = np.array(sorted(nodes), np.int64), part["lo"].to_numpy(np.int64), part["hi"].to_numpy(np.int64)
    ids = np.unique(np.concatenate([own, lo, hi]))
    order = np.argsort(lo, kind="stable")
    return ids, np.searchsorted(ids, own), np.searchsorted(ids, lo[order]), np.searchsorted(ids, hi[order])


def _square(nodes: set[int], part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ranks, places of the cell's nodes, and by places the weight from each to each other and whether there is an edge. A cell's
    neighbours are joined with each other in what it gives, so this is no larger than its result."""
    ids, own, lo, hi = _places(nodes, part)
    order = np.argsort(part["lo"].to_numpy(np.int64), kind="stable")
    weight, edge = np.full((len(ids), len(ids)), FAR), np.zeros((len(ids), len(ids)), bool)
    for name, a, b in (("up", lo, hi), ("down", hi, lo)):
        x = part[name]
        weight[a, b] = x.where(x.notna(), FAR).to_numpy(np.int64)[order]
    edge[lo, hi] = True
    return ids, own, weight, edge


def _rows(ids: np.ndarray, weight: np.ndarray, edge: np.ndarray) -> pd.DataFrame:
    lo, hi = np.nonzero(np.triu(edge, 1))
    plain = lambda x: pd.arrays.IntegerArray(x, x >= FAR // 2)
    return pd.DataFrame({"lo": ids[lo], "hi": ids[hi], "up": plain(weight[lo, hi]), "down": plain(weight[hi, lo])})


def _range(places: np.ndarray):
    """Rows and columns of places; without copies if they have no gaps."""
    a, b = int(places[0]), int(places[-1]) + 1
    return (slice(a, b), slice(a, b)) if b - a == len(places) else np.ix_(places, places)


def _through_lower(nodes: set[int], part: pd.DataFrame) -> pd.DataFrame:
    """Lower triangles of a cell's nodes, bottom-up: for all pairs of a node's higher neighbours at once."""
    ids, own, weight, edge = _square(nodes, part)
    for v in own.tolist():
        above = np.flatnonzero(edge[v, v + 1 :]) + v + 1
        if len(above) > 1:
            both = _range(above)
            # down to v, then up
            weight[both] = np.minimum(weight[both], weight[above, v][:, None] + weight[v, above])
            edge[both] = True
    return _rows(ids, weight, edge)


def _through_higher(nodes: set[int], part: pd.DataFrame) -> pd.DataFrame:
    """Upper and intermediate triangles of a cell's nodes, top-down. Weights between higher neighbours are distances already,
    so one step over each of them is enough."""
    ids, own, weight, edge = _square(nodes, part)
    for v in own.tolist()[::-1]:
        above = np.flatnonzero(edge[v, v + 1 :]) + v + 1
        if len(above) > 1:
            between = weight[_range(above)].copy()
            np.fill_diagonal(between, 0)
            weight[v, above] = (weight[v, above][:, None] + between).min(axis=0)
            weight[above, v] = (between + weight[above, v]).min(axis=1)
    return _rows(ids, weight, edge)


def customized_cells(weights: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """lo, hi, up, down with every lower triangle applied bottom-up, cell by cell, and cell and round. cells: of an earlier
    customization of the same edges (`cells_of`)."""
    return eliminate(weights.select("lo", "hi", "up", "down"), _through_lower, "up long, down long", _lightest, cells)


def _over_lower(nodes: set[int], part: pd.DataFrame) -> pd.DataFrame:
    """As `_through_lower`, with the lowest rank that each weight leads over."""
    ids, own, weight, edge = _square(nodes, part)
    middle = np.full(weight.shape, FAR)
    lo, hi = np.searchsorted(ids, part["lo"].to_numpy(np.int64)), np.searchsorted(ids, part["hi"].to_numpy(np.int64))
    for name, a, b in (("up_middle", lo, hi), ("down_middle", hi, lo)):
        middle[a, b] = part[name].where(part[name].notna(), FAR).to_numpy(np.int64)
    for v in own.tolist():
        above = np.flatnonzero(edge[v, v + 1 :]) + v + 1
        if len(above) > 1:
            both = _range(above)
            new, old, was = weight[above, v][:, None] + weight[v, above], weight[both], middle[both]
            better = (new < old) | (new == old) & (ids[v] < was)
            weight[both], middle[both], edge[both] = np.where(better, new, old), np.where(better, ids[v], was), True
    out = _rows(ids, weight, edge)
    lo, hi = np.nonzero(np.triu(edge, 1))
    for name, a, b in (("up_middle", lo, hi), ("down_middle", hi, lo)):
        out[name] = pd.arrays.IntegerArray(middle[a, b], weight[a, b] >= FAR // 2)
    return out


def _lightest_over(df: DataFrame) -> DataFrame:
    best = df.groupBy("lo", "hi").agg(*[F.min(F.when(F.col(c).isNotNull(), F.struct(c, f"{c}_middle"))).alias(f"best_{c}") for c in ("up", "down")])
    return best.select("lo", "hi", "best_up.up", "best_down.down", "best_up.up_middle", "best_down.down_middle")


def customized_middles(weights: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """`customized_cells`, with up_middle and down_middle: the lowest rank that a weight leads over (-1: an edge of the network)."""
    own = [F.when(F.col(c).isNotNull(), F.lit(-1).cast("long")).alias(f"{c}_middle") for c in ("up", "down")]
    return eliminate(weights.select("lo", "hi", "up", "down", *own), _over_lower, "up long, down long, up_middle long, down_middle long", _lightest_over, cells)


def perfected(customized: DataFrame) -> DataFrame:
    """lo, hi, up, down of a customization with its cells, with upper and intermediate triangles applied top-down, so that
    weights are distances."""
    return descend(cut(customized), _through_higher, "up long, down long").select("lo", "hi", "up", "down")


def customize(weights: DataFrame, perfect: bool = False, cells: DataFrame | None = None) -> DataFrame:
    """lo, hi, up, down after customization; perfect: weights are distances."""
    done = customized_cells(weights, cells)
    return perfected(done) if perfect else done.select("lo", "hi", "up", "down")


def ancestors(tree: DataFrame, starts: DataFrame) -> DataFrame:
    """start, rank: every node with all nodes on its way to the root, itself included, by doubling."""
    walk = cut(starts.select(F.col("rank").alias("start"), "rank").distinct())
    jump = cut(tree.select("rank", "parent"))
    while True:
        more = walk.join(jump, "rank").select("start", F.col("parent").alias("rank"))
        if not more.head(1):
            return walk
        walk = cut(walk.union(more).distinct())
        step = jump.alias("a").join(jump.alias("b"), F.col("a.parent") == F.col("b.rank"))
        jump = cut(step.select("a.rank", "b.parent"))


class Cch:
    """A customized completion in memory: weights up and down of every edge, by its lower and its higher end."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, up: np.ndarray, down: np.ndarray):
        self.above: dict[int, list[tuple[int, float, float]]] = {}
        self.below: dict[int, dict[int, tuple[float, float]]] = {}
        order = np.lexsort((hi, lo))
        for v, w, u, d in zip(lo[order].tolist(), hi[order].tolist(), up[order].tolist(), down[order].tolist()):
            self.above.setdefault(v, []).append((w, u, d))
            self.below.setdefault(w, {})[v] = (u, d)

    def climb(self, v: int, k: int) -> tuple[dict[int, float], dict[int, int]]:
        """Distances from (k = 1) or to (k = 2) v over rising paths, of the nodes above it in ascending order (in a whole
        completion its ancestors in the elimination tree), and where each is reached from."""
        dist, pred, todo, out = {v: 0.0}, {}, [v], {}
        while todo:  # by rank: all lower neighbours of a node are done before it
            u = heapq.heappop(todo)
            out[u] = dist[u]
            for edge in self.above.get(u, ()):
                new = dist[u] + edge[k]
                if new < INFINITE:
                    if edge[0] not in dist:
                        heapq.heappush(todo, edge[0])
                    if new < dist.get(edge[0], INFINITE):
                        dist[edge[0]], pred[edge[0]] = new, u
        return out, pred

    def meet(self, s: int, t: int) -> tuple[float, int | None, dict[int, int], dict[int, int]]:
        """Distance, the best common ancestor (ties: lowest), and both climbs' predecessors."""
        (a, pa), (b, pb) = self.climb(s, 1), self.climb(t, 2)
        best, mid = min(((a[v] + b[v], v) for v in a if v in b), default=(INFINITE, None))
        return best, mid, pa, pb

    def weight(self, a: int, b: int) -> float:
        return self.below[b][a][0] if a < b else self.below[a][b][1]

    def split(self, a: int, b: int) -> int | None:
        """The lowest common lower neighbour that the edge from a to b leads over; none if it is an edge of its own."""
        least, w = (a, b) if len(self.below.get(a, ())) < len(self.below.get(b, ())) else (b, a), self.weight(a, b)
        for v in sorted(self.below.get(least[0], ())):
            if v in self.below.get(least[1], ()) and self.below[a][v][1] + self.below[b][v][0] == w:
                return v
        return None

    def path(self, s: int, t: int) -> list[int]:
        """The ranks of a shortest path."""
        _, mid, pa, pb = self.meet(s, t)
        if mid is None:
            return []
        front, back = [mid], [mid]
        while front[-1] != s:
            front.append(pa[front[-1]])
        while back[-1] != t:
            back.append(pb[back[-1]])
        out, corners = [s], front[::-1] + back[1:]
        todo = list(zip(corners[:-1], corners[1:]))[::-1]
        while todo:
            a, b = todo.pop()
            v = self.split(a, b)
            if v is None:
                out.append(b)
            else:
                todo += [(v, b), (a, v)]
        return out

    def potential(self, t: int):
        """A function from rank to the distance to t, which looks at a rank's ancestors once for all calls."""
        known, _ = self.climb(t, 2)
        done: dict[int, float] = {}

        def to_target(v: int) -> float:
            todo = [v]
            while todo:
                u = todo[-1]
                missing = [x for x, w, _ in self.above.get(u, ()) if w < INFINITE and x not in done] if u not in done else ()
                if missing:
                    todo += missing
                    continue
                todo.pop()
                if u not in done:
                    done[u] = min([known.get(u, INFINITE), *(w + done[x] for x, w, _ in self.above.get(u, ()) if w < INFINITE)])
            return done[v]

        return to_target


_made: dict[str, Cch] = {}


class SharedCch:
    """A customized completion of checked size, sent to tasks as arrays; each worker builds it once."""

    def __init__(self, weights: DataFrame):
        if weights.count() > MOST_SHARED:
            raise ValueError("the hierarchy is too large to send to tasks")
        # as Arrow's columns; rows would be Python objects on the driver
        far = (F.coalesce(F.col(c).cast("double"), F.lit(INFINITE)).alias(c) for c in ("up", "down"))
        x = weights.select(F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), *far).toArrow()
        arrays = [x[c].to_numpy() for c in ("lo", "hi", "up", "down")]
        self.key, self.arrays = uuid.uuid4().hex, weights.sparkSession.sparkContext.broadcast(arrays)

    def get(self) -> Cch:
        if self.key not in _made:
            _made.clear()
            _made[self.key] = Cch(*self.arrays.value)
        return _made[self.key]


def celled(weights: DataFrame) -> DataFrame:
    """lo, hi, up, down, cell, round of weights that may come without their cells."""
    if "cell" in weights.columns:
        return weights.select("lo", "hi", "up", "down", "cell", "round")
    cells = cells_of(contracted_cells(weights.select(F.col("lo").alias("tail"), F.col("hi").alias("head"))))
    return weights.select("lo", "hi", "up", "down").join(cells.withColumnRenamed("rank", "lo"), "lo")


def etree_query(weights: DataFrame, od: DataFrame, with_path: bool = False) -> DataFrame:
    """query_id, dist (null: no way), and the path's ranks if wanted, of od (query_id, src, dst) between ranks: both
    ends' ancestors in the elimination tree are walked once. Ways without paths go by the cells of the hierarchy; for paths,
    whose edges are unpacked by lower triangles, the hierarchy (of checked size) goes to the tasks."""
    if not with_path:
        ends = od.select(F.lit("up").alias("dir"), F.col("src").alias("source")).union(od.select(F.lit("down"), "dst"))
        return label_query(labels_of(weights, ends), od.select("query_id", "src", "dst"))
    shared = SharedCch(weights)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cch = shared.get()
        for part in parts:
            rows = []
            for q, s, t in zip(part["query_id"], part["src"], part["dst"]):
                best = cch.meet(s, t)[0]
                rows.append((q, None if best == INFINITE else int(best), cch.path(s, t)))
            yield pd.DataFrame(rows, columns=["query_id", "dist", "path"]).astype({"dist": "Int64"})

    return od.select("query_id", "src", "dst").repartition(16, "query_id").mapInPandas(run, "query_id long, dist long, path array<long>")


def cch_potentials(weights: DataFrame, targets: DataFrame, nodes: DataFrame) -> DataFrame:
    """dst, node, pi: exact distances (no row: no way) of all ranks in `nodes` (rank) to each target (rank)."""
    found, dealt = potentials(celled(weights), targets.select("rank").distinct())
    some = found.join(nodes.select(F.col("rank").alias("node")).distinct(), "node", "left_semi").select("batch", "node", F.posexplode("dist").alias("place", "pi"))
    return some.where(F.col("pi") < int(FAR)).join(F.broadcast(dealt), ["batch", "place"]).select(F.col("rank").alias("dst"), "node", "pi")


def unpack_arcs(weights: DataFrame) -> DataFrame:
    """lo, hi, up_mid, down_mid: the lowest common lower neighbour whose two edges weigh as much as the edge in each
    direction; null where the edge has no such triangle or no weight. A join of lower triangles with their sides."""
    w = weights.select("lo", "hi", "up", "down")
    side = lambda lo, hi, n: w.select(F.col("lo").alias(lo), F.col("hi").alias(hi), F.col("up").alias(f"up{n}"), F.col("down").alias(f"down{n}"))
    both = side("low", "mid", 1).join(side("low", "high", 2), "low").where("mid < high").join(side("mid", "high", 0), ["mid", "high"])
    found = both.groupBy("mid", "high").agg(F.min(F.when(F.col("down1") + F.col("up2") == F.col("up0"), F.col("low"))).alias("up_mid"), F.min(F.when(F.col("down2") + F.col("up1") == F.col("down0"), F.col("low"))).alias("down_mid"))
    return w.select("lo", "hi").join(found.select(F.col("mid").alias("lo"), F.col("high").alias("hi"), "up_mid", "down_mid"), ["lo", "hi"], "left")


def without_dominated(before: DataFrame, perfect: DataFrame) -> DataFrame:
    """The edges that a query needs after perfect customization: a weight that a shorter way beats is taken away,
    and edges without any weight left go."""
    p = perfect.select("lo", "hi", F.col("up").alias("u"), F.col("down").alias("d"))
    cells = [c for c in before.columns if c in ("cell", "round")]
    kept = before.join(p, ["lo", "hi"]).select("lo", "hi", F.when(F.col("up") <= F.col("u"), F.col("up")).alias("up"), F.when(F.col("down") <= F.col("d"), F.col("down")).alias("down"), *cells)
    return kept.where("up is not null or down is not null")


def directed(cch: DataFrame, ranked: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """dir, lo, hi of the completion's edges that can ever have a weight in that direction: those that a
    customization with weight 0 for every original edge reaches. cells: as in `customize`."""
    zero = customize(respecting(cch, ranked.withColumn("weight", F.lit(0).cast("long"))), cells=cells)
    up, down = (zero.where(f"{c} is not null").select(F.lit(c).alias("dir"), "lo", "hi") for c in ("up", "down"))
    return up.union(down)


def separator_tree(tree: DataFrame) -> DataFrame:
    """rank, cell: the elimination tree (rank, parent, one row a node, null for roots) with chains of single children
    joined into cells, each named by its highest rank."""
    children = tree.where("parent is not null").groupBy(F.col("parent").alias("rank")).agg(F.count(F.lit(1)).alias("children"))
    # a node goes with its parent if it is the only child
    single = children.where("children = 1").select(F.col("rank").alias("parent"))
    jump = cut(tree.select("rank", "parent").join(single, "parent", "left_semi").select("rank", F.col("parent").alias("cell")).union(tree.select("rank").join(tree.join(single, "parent", "left_semi"), "rank", "left_anti").select("rank", F.col("rank").alias("cell"))))
    while True:  # by doubling
        step = jump.alias("a").join(jump.alias("b"), F.col("a.cell") == F.col("b.rank")).select("a.rank", F.col("b.cell").alias("cell"))
        step = cut(step)
        if not step.join(jump.withColumnRenamed("cell", "was"), "rank").where("cell <> was").head(1):
            return step
        jump = step


def _cell_tree(tree: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """rank, cell of the separator tree; cell, up (null for roots), n (nodes), level (roots: 0) of its cells; and how many levels."""
    cells = cut(separator_tree(tree))
    above = tree.where("parent is not null").join(cells.select("rank", "cell"), "rank").join(cells.select(F.col("rank").alias("parent"), F.col("cell").alias("up")), "parent").where("cell <> up").select("cell", "up").distinct()
    own = cut(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).join(above, "cell", "left").select("cell", "up", "n"))
    now, found, k = own.where("up is null").withColumn("level", F.lit(0)), None, 0
    while True:
        now = cut(now)
        if not now.head(1):
            return cells, now if found is None else found, k
        found, k = now if found is None else found.union(now), k + 1
        now = own.join(now.select(F.col("cell").alias("up")), "up", "left_semi").select("cell", "up", "n", F.lit(k).alias("level"))


def separator_levels(tree: DataFrame) -> DataFrame:
    """level, cells, nodes: how many cells of the separator tree there are at each depth (roots: 0), and their sizes in sum."""
    found = _cell_tree(tree)[1]
    return found.groupBy(F.col("level").cast("long").alias("level")).agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("nodes"))


def full_tree(cch: DataFrame, nodes: DataFrame) -> DataFrame:
    """rank, parent (null for roots) of all nodes (rank)."""
    return nodes.select("rank").distinct().join(elimination_tree(cch), "rank", "left")


def reordered(tree: DataFrame, by: str = "breadth") -> DataFrame:
    """rank, position: another order of the same separator tree, cells above others later: 'breadth' level by level,
    'size' with the larger of a cell's subtrees first. Inside a cell ranks stay in order. A level of cells is a few joins; no
    place sees all cells."""
    cells, own, levels = _cell_tree(tree)
    at = lambda k: own.where(F.col("level") == k)
    if by == "breadth":
        placed, places, before = None, None, 0
        for k in range(levels):  # by the place of the cell above
            now = at(k).select("cell", F.lit(0).cast("long").alias("over")) if placed is None else at(k).join(placed.select(F.col("cell").alias("up"), F.col("place").alias("over")), "up").select("cell", "over")
            placed = cut(number_rows(now, ["over", "cell"], "i").select("cell", (F.col("i") + before).alias("place")))
            before += placed.count()
            places = placed if places is None else places.union(placed)
    else:
        sums, below = None, None
        for k in range(levels - 1, -1, -1):  # nodes and cells of subtrees
            now = at(k).select("cell", "up", "n")
            now = now.withColumns({"total": F.col("n"), "count": F.lit(1).cast("long")}) if below is None else now.join(below, "cell", "left").select("cell", "up", (F.col("n") + F.coalesce("t", F.lit(0))).alias("total"), (1 + F.coalesce("c", F.lit(0))).alias("count"))
            now = cut(now.select("cell", "up", "total", "count", F.lit(k).alias("level")))
            below = now.where("up is not null").groupBy(F.col("up").alias("cell")).agg(F.sum("total").alias("t"), F.sum("count").alias("c"))
            sums = now if sums is None else sums.union(now)
        placed, places = None, None
        earlier = F.coalesce(F.sum("count").over(Window.partitionBy("up").orderBy(F.desc("total"), "cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        for k in range(levels):  # a cell, then its subtrees one after the other
            now = sums.where(F.col("level") == k)
            if placed is None:
                now = running_sum(now, ["cell"], F.col("count"), "place").select("cell", "place")
            else:
                over = placed.select(F.col("cell").alias("up"), F.col("place").alias("over"))
                now = now.withColumn("earlier", earlier).join(over, "up").select("cell", (F.col("over") + 1 + F.col("earlier")).alias("place"))
            placed = cut(now)
            places = placed if places is None else places.union(placed)
    if places is None:
        return cells.select("rank", F.lit(0).cast("long").alias("position"))
    return number_rows(cells.join(places, "cell").select("rank", (-F.col("place")).alias("place")), ["place", "rank"], "position").select("rank", "position")


def labels(weights: DataFrame, nodes: DataFrame) -> DataFrame:
    """dir, node, hub, dist: distances from (up) and to (down) each node over rising paths, to all of its
    ancestors that it reaches."""
    both = F.explode(F.array(F.lit("up"), F.lit("down"))).alias("dir")
    return labels_of(weights, nodes.select(both, F.col("rank").alias("source")))


def labels_of(weights: DataFrame, ends: DataFrame) -> DataFrame:
    """As `labels`, for ends (dir, source) in one direction each. They climb by the cells of the hierarchy."""
    return climb_each(celled(weights), ends).select("dir", F.col("source").alias("node"), F.col("node").alias("hub"), "dist")


def label_query(label: DataFrame, od: DataFrame) -> DataFrame:
    """query_id, dist: the best common hub of source and target ranks (src, dst)."""
    a = label.where("dir = 'up'").select(F.col("node").alias("src"), "hub", F.col("dist").alias("df"))
    b = label.where("dir = 'down'").select(F.col("node").alias("dst"), "hub", F.col("dist").alias("db"))
    best = od.join(a, "src").join(b, ["dst", "hub"]).groupBy("query_id").agg(F.min(F.col("df") + F.col("db")).alias("dist"))
    return od.select("query_id").join(best, "query_id", "left")


def pruned_labels(label: DataFrame) -> DataFrame:
    """Labels without entries that a better hub covers: of an entry (node, hub) the hub's own labels are looked
    up, and for each of their hubs the node's distance to it. No node meets another one's whole label."""
    up, down = label.where("dir = 'up'"), label.where("dir = 'down'")

    def keep(own: DataFrame, other: DataFrame, name: str) -> DataFrame:
        after = other.select(F.col("node").alias("hub"), F.col("hub").alias("mid"), F.col("dist").alias("d2")).where("hub <> mid")
        first = own.select("node", F.col("hub").alias("mid"), F.col("dist").alias("d1"))
        best = own.select("node", "hub").join(after, "hub").join(first, ["node", "mid"]).groupBy("node", "hub").agg(F.min(F.col("d1") + F.col("d2")).alias("best"))
        return own.join(best, ["node", "hub"], "left").where("best is null or dist <= best").select(F.lit(name).alias("dir"), "node", "hub", "dist")

    return keep(up, down, "up").union(keep(down, up, "down"))


def levels(cch: DataFrame) -> DataFrame:
    """rank, up_degree, down_degree of each node of the completion."""
    up = cch.groupBy(F.col("lo").alias("rank")).agg(F.count(F.lit(1)).alias("up_degree"))
    down = cch.groupBy(F.col("hi").alias("rank")).agg(F.count(F.lit(1)).alias("down_degree"))
    return up.join(down, "rank", "full").select("rank", F.coalesce("up_degree", F.lit(0)).alias("up_degree"), F.coalesce("down_degree", F.lit(0)).alias("down_degree"))


def biconnected(edges: DataFrame, most: int = SEARCHED_PAIRS) -> DataFrame:
    """lo, hi, component: biconnected components of the undirected edges, numbered by their smallest edge.
    Up to `most` pairs of nodes are searched depth first in one task; more go by a forest (`_by_forest`)."""

    def run(keys: tuple, part: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[int]] = {}
        for a, b in zip(part["lo"], part["hi"]):
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        number, low, out, stack = {}, {}, [], []
        for root in sorted(near):
            if root in number:
                continue
            number[root] = low[root] = len(number)
            walk = [(root, None, iter(sorted(near[root])))]
            while walk:
                v, parent, rest = walk[-1]
                w = next(rest, None)
                if w is None:
                    walk.pop()
                    if walk:
                        u = walk[-1][0]
                        low[u] = min(low[u], low[v])
                        if low[v] >= number[u]:
                            block = []
                            while True:
                                e = stack.pop()
                                block.append(e)
                                if e == (u, v):
                                    break
                            names = sorted((min(e), max(e)) for e in block)
                            out += [(a, b, *names[0]) for a, b in names]
                elif w not in number:
                    stack.append((v, w))
                    number[w] = low[w] = len(number)
                    walk.append((w, v, iter(sorted(near[w]))))
                elif w != parent and number[w] < number[v]:
                    stack.append((v, w))
                    low[v] = min(low[v], number[w])
        frame = pd.DataFrame(out, columns=["lo", "hi", "a", "b"])
        frame["component"] = frame.groupby(["a", "b"]).ngroup()
        return frame[["lo", "hi", "component"]]

    pairs = cut(edges.where("tail <> head").select(F.least("tail", "head").alias("lo"), F.greatest("tail", "head").alias("hi")).distinct())
    if pairs.count() > most:
        return _by_forest(pairs)
    return pairs.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(run, "lo long, hi long, component long")


def _forest(pairs: DataFrame, both: DataFrame) -> list[DataFrame]:
    """node, parent by their level in a forest that is grown from the highest node of each connected part, breadth first."""
    nodes = both.select(F.col("u").alias("rank")).distinct()
    roots = components(pairs, nodes).select(F.col("cell").alias("node")).distinct()
    levels = [cut(roots.select("node", F.lit(None).cast("long").alias("parent")))]
    while levels[-1].head(1):
        near = both.join(levels[-1].select(F.col("node").alias("u")), "u")
        for known in levels[-2:]:  # neighbours are at most one level apart
            near = near.join(known.select(F.col("node").alias("v")), "v", "left_anti")
        levels.append(cut(near.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("parent"))))
    return levels[:-1]


def _by_forest(pairs: DataFrame) -> DataFrame:
    """`biconnected` after Tarjan and Vishkin: a forest, its nodes in preorder, for each subtree the first and the last node that an edge outside of the
    forest leads to, and the connected parts of a graph on the forest's edges (named by their lower ends). A pass is a job a level; no task gets
    more than rows of a join, nor one of a window more than a node's children."""
    both = cut(pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(pairs.select("hi", "lo")))
    levels = _forest(pairs, both)
    sized, below = [], None
    for level in reversed(levels):
        own = level.withColumn("size", F.lit(1).cast("long"))
        if below is not None:
            under = below.groupBy(F.col("parent").alias("node")).agg(F.sum("size").alias("under"))
            own = level.join(under, "node", "left").select("node", "parent", (F.coalesce("under", F.lit(0)) + 1).alias("size"))
        below = cut(own)
        sized.insert(0, below)
    placed = [cut(running_sum(sized[0], ["node"], F.col("size"), "pre").select("node", "parent", "size", "pre"))]
    earlier = F.sum("size").over(Window.partitionBy("parent").orderBy("node").rowsBetween(Window.unboundedPreceding, -1))
    for level in sized[1:]:
        above = placed[-1].select(F.col("node").alias("parent"), F.col("pre").alias("above"))
        placed.append(cut(level.withColumn("earlier", F.coalesce(earlier, F.lit(0))).join(above, "parent").select("node", "parent", "size", (F.col("above") + 1 + F.col("earlier")).alias("pre"))))
    tree = placed[0]
    for level in placed[1:]:
        tree = tree.union(level)
    tree = cut(tree)
    grown = tree.where("parent is not null").select(F.least("node", "parent").alias("lo"), F.greatest("node", "parent").alias("hi"), F.col("node").alias("named"))
    others = cut(pairs.join(grown, ["lo", "hi"], "left_anti").select("lo", "hi"))
    ends = others.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(others.select("hi", "lo"))
    reach = cut(ends.join(tree.select(F.col("node").alias("v"), "pre"), "v").groupBy(F.col("u").alias("node")).agg(F.min("pre").alias("first"), F.max("pre").alias("last")))
    spans, below = [], None
    for level in reversed(placed):
        own = level.join(reach, "node", "left")
        if below is not None:
            under = below.groupBy(F.col("parent").alias("node")).agg(F.min("first").alias("f"), F.max("last").alias("l"))
            own = own.join(under, "node", "left").select("node", "parent", "size", "pre", F.least("first", "f").alias("first"), F.greatest("last", "l").alias("last"))
        below = cut(own)
        spans.append(below)
    links = others
    for lower, upper in zip(spans, spans[1:]):  # an edge and the one above it, if something leads around the node between them
        up = upper.where("parent is not null").select(F.col("node").alias("parent"), F.col("pre").alias("from"), (F.col("pre") + F.col("size")).alias("to"))
        links = links.union(lower.join(up, "parent").where("first < from or last >= to").select("parent", "node"))
    parts = cut(components(links, tree.where("parent is not null").select(F.col("node").alias("rank"))))
    named = grown.union(others.select("lo", "hi", F.col("lo").alias("named"))).join(parts, F.col("named") == F.col("rank")).select("lo", "hi", "cell")
    named = cut(named)
    least = named.groupBy("cell").agg(F.min(F.struct("lo", "hi")).alias("e")).select("cell", F.col("e.lo").alias("a"), F.col("e.hi").alias("b"))
    return named.join(number_rows(least, ["a", "b"], "component").select("cell", "component"), "cell").select("lo", "hi", "component")


def core(edges: DataFrame) -> DataFrame:
    """node_id: what is left after nodes with one neighbour are taken away again and again."""
    both = edges.select("tail", "head").union(edges.select("head", "tail")).where("tail <> head").distinct()
    both = cut(both)
    while True:
        single = both.groupBy("tail").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("tail")
        if not single.head(1):
            return both.select(F.col("tail").alias("node_id")).distinct()
        rest = both.join(single, "tail", "left_anti")
        both = cut(rest.join(single.withColumnRenamed("tail", "head"), "head", "left_anti").select("tail", "head"))


def tree_levels(tree: DataFrame) -> DataFrame:
    """rank, level: the longest way down from a node (rank, parent, null for roots) to a leaf, whose level is 0. By doubling: after
    k rounds levels are right below 2^k, as a longer way goes on 2^k below its node; as many rounds as the greatest level has bits."""
    now, jump, far = tree.select("rank", F.lit(0).cast("long").alias("level")), cut(tree.where("parent is not null").select("rank", "parent")), 1
    while jump.head(1):
        up = now.join(jump, "rank").groupBy(F.col("parent").alias("rank")).agg((F.max("level") + far).alias("new"))
        now = cut(now.join(up, "rank", "left").select("rank", F.greatest("level", "new").alias("level")))
        step = jump.alias("a").join(jump.alias("b"), F.col("a.parent") == F.col("b.rank"))
        jump, far = cut(step.select("a.rank", "b.parent")), 2 * far
    return now
