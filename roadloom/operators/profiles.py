"""Functions on hierarchies: customization whose weights are travel-time functions, profiles of a whole day or of a part of it
with a path for each range of departures, and unpacking at a time.

A shortcut's row has its function, as points (dep, tt) in milliseconds from 0 to the end of the day, and its sources: from each of `starts` on,
the lower rank in `vias` that the way leads over; an edge of the network itself is -1 - edge_id. Linking two functions and taking the better of
two is NumPy on one pair of arrays; which pairs meet is decided by joins: cells of the elimination (`cells`) for customization, the edges above
both ends of a query for profiles, and an arc's own row for unpacking. Nothing is collected or sent to all tasks.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .cells import eliminate
from .hierarchy import ancestors
from .ttf import DAY

#: Points that lie on their neighbours' line so closely (ms) are left out.
EPS = 1e-6
FUNCTION = "dep array<double>, tt array<double>, starts array<double>, vias array<long>"


class Fn(NamedTuple):
    """A function over [dep[0], dep[-1]] and which source it has from each start on."""

    dep: np.ndarray
    tt: np.ndarray
    starts: list[float]
    vias: list[int]
    low: float
    high: float


def function(dep: np.ndarray, tt: np.ndarray, starts: list[float], vias: list[int]) -> Fn:
    return Fn(dep, tt, starts, vias, float(tt.min()), float(tt.max()))


def _thin(dep: np.ndarray, tt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = np.ones(len(dep), bool)
    keep[1:-1] = np.diff(dep)[:-1] > EPS
    dep, tt = dep[keep], tt[keep]
    if len(dep) > 2:
        keep = np.ones(len(dep), bool)
        keep[1:-1] = np.abs(tt[:-2] + (tt[2:] - tt[:-2]) * (dep[1:-1] - dep[:-2]) / (dep[2:] - dep[:-2]) - tt[1:-1]) > EPS
        dep, tt = dep[keep], tt[keep]
    return dep, tt


def at_times(f: Fn, t: np.ndarray) -> np.ndarray:
    """Values of a whole day's function at any times."""
    return np.interp(np.mod(t, DAY), f.dep, f.tt)


def _reached(times: list[float] | np.ndarray, first: float, last: float) -> np.ndarray:
    """All repetitions of times of the day between first and last."""
    days = np.arange(np.floor(first / DAY), np.floor(last / DAY) + 1) * DAY
    every = (np.asarray(times)[None, :] + days[:, None]).ravel()
    return every[(every > first) & (every < last)]


def link(f: Fn, g: Fn, via: int) -> Fn:
    """f, over any range of departures, and then the whole day's g."""
    arrival = f.dep + f.tt
    dep = np.unique(np.concatenate([f.dep, np.interp(_reached(g.dep[:-1], arrival[0], arrival[-1]), arrival, f.dep)]))
    first = np.interp(dep, f.dep, f.tt)
    return function(*_thin(dep, first + at_times(g, dep + first)), [float(dep[0])], [via])


def merge(f: Fn | None, g: Fn) -> Fn:
    """The better of two functions over the same range at each departure (f if equal), with the sources of the better one."""
    if f is None or g.high <= f.low and f.high > g.low:
        return g
    if g.low >= f.high:
        return f
    dep = np.union1d(f.dep, g.dep)
    a, b = np.interp(dep, f.dep, f.tt), np.interp(dep, g.dep, g.tt)
    d = a - b
    if (d <= EPS).all():
        return f
    if (d >= 0).all():
        return g
    cross = np.flatnonzero(d[:-1] * d[1:] < 0)
    x = dep[cross] + (dep[cross + 1] - dep[cross]) * d[cross] / (d[cross] - d[cross + 1])
    every = np.union1d(dep, x)
    tt = np.minimum(np.interp(every, dep, a), np.interp(every, dep, b))
    second = np.interp((every[1:] + every[:-1]) / 2, dep, d) > 0
    edges = np.concatenate([[0], np.flatnonzero(second[1:] != second[:-1]) + 1, [len(every) - 1]])
    starts, vias = [], []
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
        h, begin, end = g if second[i] else f, float(every[i]), float(every[j])
        p, q = max(bisect_right(h.starts, begin) - 1, 0), bisect_left(h.starts, end)
        for s, v in zip([begin, *h.starts[p + 1 : q]], h.vias[p:q]):
            if not vias or vias[-1] != v:
                starts.append(s)
                vias.append(v)
    return function(*_thin(every, tt), starts, vias)


def source(f: Fn, x: float) -> int:
    return f.vias[max(bisect_right(f.starts, x) - 1, 0)]


def _arrays(f: Fn) -> tuple[list, ...]:
    return f.dep.tolist(), f.tt.tolist(), f.starts, f.vias


def _read(row) -> Fn:
    return function(np.asarray(row.dep, float), np.asarray(row.tt, float), list(row.starts), list(row.vias))


def edge_functions(ranked: DataFrame, ttf: DataFrame) -> DataFrame:
    """lo, hi, dir (up: from lo to hi; down: back), the functions and sources of edges (edge_id, tail, head) between ranks; ttf is
    normalised. Parallel edges have a row each."""
    point = F.struct(F.col("dep").cast("double").alias("dep"), F.col("tt").cast("double").alias("tt"))
    own = ttf.groupBy("edge_id").agg(F.array_sort(F.collect_list(point)).alias("p"))
    last = F.struct(F.lit(float(DAY)).alias("dep"), F.element_at("p", -1)["tt"].alias("tt"))
    own = own.select("edge_id", F.when(F.element_at("p", -1)["dep"] < DAY, F.concat("p", F.array(last))).otherwise(F.col("p")).alias("p"))
    both = ranked.where("tail <> head").select("edge_id", "tail", "head").join(own, "edge_id")
    way = F.when(F.col("tail") < F.col("head"), F.lit("up")).otherwise(F.lit("down"))
    return both.select(F.least("tail", "head").alias("lo"), F.greatest("tail", "head").alias("hi"), way.alias("dir"), F.col("p.dep").alias("dep"), F.col("p.tt").alias("tt"), F.array(F.lit(0.0)).alias("starts"), F.array(-1 - F.col("edge_id")).alias("vias"))


def _through_lower(nodes: set[int], part: pd.DataFrame) -> pd.DataFrame:
    """Functions over lower triangles of a cell's nodes, bottom-up. A function that is always slower than `most` is dropped."""
    above: dict[int, dict[int, list]] = {}
    most: dict[tuple[int, int, int], float] = {}
    for row in part.itertuples(index=False):
        side = 0 if row.dir == "up" else 1
        own = above.setdefault(row.lo, {}).setdefault(row.hi, [None, None])
        if row.dep is not None:
            own[side] = merge(own[side], _read(row))
        if row.most == row.most and row.most is not None:
            most[row.lo, row.hi, side] = row.most

    def joined(f: Fn | None, g: Fn | None, a: int, b: int, side: int, via: int) -> None:
        if f is None or g is None or f.low + g.low > most.get((a, b, side), np.inf):
            return
        own = above.setdefault(a, {}).setdefault(b, [None, None])
        if own[side] is None or f.low + g.low < own[side].high:
            own[side] = merge(own[side], link(f, g, via))

    for v in sorted(nodes):
        if v in above:
            own = sorted(above[v].items(), key=lambda x: x[0])
            for w, fs in own:
                for side in (0, 1):
                    if fs[side] is not None and fs[side].low > most.get((v, w, side), np.inf):
                        fs[side] = None
            own = [(w, fs) for w, fs in own if fs[0] is not None or fs[1] is not None]
            for i, (a, fa) in enumerate(own):
                for b, fb in own[i + 1 :]:
                    joined(fa[1], fb[0], a, b, 0, v)  # a down to v, up to b
                    joined(fb[1], fa[0], a, b, 1, v)
    rows = [(v, w, name, *_arrays(fs[side]), None) for v, ws in above.items() for w, fs in ws.items() for side, name in ((0, "up"), (1, "down")) if fs[side] is not None]
    return pd.DataFrame(rows, columns=["lo", "hi", "dir", "dep", "tt", "starts", "vias", "most"])


def customize(functions: DataFrame, cells: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """lo, hi, dir, dep, tt, starts, vias of all shortcuts: the fastest way between their ends over lower ranks at each departure.

    functions: of the edges (`edge_functions`); cells: of the completion (rank, cell, round). limits (lo, hi, up, down): upper bounds of the
    travel times between ends; a shortcut that never keeps within them is on no fastest way, and is left out."""
    base = functions.withColumn("most", F.lit(None).cast("double"))
    if limits is not None:
        none = [F.lit(None).cast("array<double>").alias(c) for c in ("dep", "tt", "starts")]
        sides = F.explode(F.array(*(F.struct(F.lit(c).alias("dir"), F.col(c).cast("double").alias("most")) for c in ("up", "down"))))
        rows = limits.select("lo", "hi", sides.alias("s")).where("s.most is not null")
        base = base.unionByName(rows.select("lo", "hi", "s.dir", *none, F.lit(None).cast("array<long>").alias("vias"), "s.most"))
    done = eliminate(base, _through_lower, f"dir string, {FUNCTION}, most double", cells=cells)
    return done.select("lo", "hi", "dir", "dep", "tt", "starts", "vias")


def _above(tree: DataFrame, od: DataFrame) -> DataFrame:
    """query_id, side, rank: all ancestors of a query's ends."""
    ends = od.select("query_id", F.explode(F.array(F.struct(F.lit("up").alias("dir"), F.col("src").alias("start")), F.struct(F.lit("down").alias("dir"), F.col("dst").alias("start")))).alias("e")).select("query_id", "e.dir", "e.start")
    return ends.join(ancestors(tree, ends.select(F.col("start").alias("rank"))), "start").select("query_id", "dir", F.col("rank").alias("lo"))


ARC = "query_id long, x0 double, x1 double, pos string, lo long, hi long, dir string, xs array<double>, at array<double>"


def _searched(od: DataFrame, functions: DataFrame, tree: DataFrame, run, schema: str) -> DataFrame:
    """`run` on each query with the functions above its ends: those up from the source's ancestors, those down to the target's."""
    asked = od.select("query_id", "src", "dst", F.col("first").cast("double").alias("first"), F.col("last").cast("double").alias("last"))
    edges = _above(tree, od).join(functions, ["lo", "dir"]).select(F.col("query_id").alias("q"), "lo", "hi", "dir", "dep", "tt", "starts", "vias")
    return asked.groupBy("query_id").cogroup(edges.groupBy("q")).applyInPandas(run, schema)


def _labels(asked, edges: pd.DataFrame) -> dict[int, Fn]:
    """Travel times from the source to all ranks above both ends, as functions of the departure in [first, last] there; a
    label's source is the rank that it was reached from."""
    span = np.array([asked.first, asked.last]) if asked.last > asked.first else np.array([asked.first])
    label = {asked.src: function(span, np.zeros(len(span)), [asked.first], [-1])}
    up, down = {}, {}
    for row in edges.itertuples(index=False):
        if row.dir == "up":
            up.setdefault(row.lo, []).append((row.hi, _read(row)))
        else:
            down.setdefault(row.hi, []).append((row.lo, _read(row)))

    def go(u: int, ways: list) -> None:
        for w, f in ways:
            own, old = label[u], label.get(w)
            if old is None or own.low + f.low < old.high:
                label[w] = merge(old, link(own, f, u))

    for u in sorted(up):  # below any rank nothing is left to come
        if u in label:
            go(u, up[u])
    for u in sorted(down, reverse=True):
        if u in label:
            go(u, down[u])
    return label


def profile(functions: DataFrame, tree: DataFrame, od: DataFrame) -> DataFrame:
    """query_id, dep, tt: the travel-time function from src to dst for departures in [first, last] (od: query_id, src, dst, first, last;
    0 to the end of the day, or a part of it, over which all functions on the way are then cut and shifted). No way: no rows."""

    def run(asked: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        out = []
        for q in asked.itertuples(index=False):
            f = _labels(q, edges).get(q.dst)
            if f is not None:
                out.append(pd.DataFrame({"query_id": q.query_id, "dep": f.dep, "tt": f.tt}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "dep": [], "tt": []})

    return _searched(od, functions, tree, run, "query_id long, dep double, tt double")


def arcs(functions: DataFrame, tree: DataFrame, od: DataFrame) -> DataFrame:
    """query_id, x0, x1 (a range of departures over which the way over shortcuts stays the same), pos, lo, hi, dir of its shortcuts in
    order, and when each is entered: at the times `at` for the departures xs."""

    def run(asked: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        out = []
        for q in asked.itertuples(index=False):
            label = _labels(q, edges)
            if q.dst not in label or q.src == q.dst:
                continue
            x = q.first
            while True:
                way, end, v = [], q.last, q.dst
                while v != q.src:
                    f = label[v]
                    u, k = source(f, x), bisect_right(f.starts, x)
                    end = min(end, f.starts[k]) if k < len(f.starts) else end
                    way.append((u, v))
                    v = u
                for k, (u, v) in enumerate(reversed(way)):
                    f = label[u]
                    xs = np.unique(np.concatenate([[x, end], f.dep[(f.dep > x) & (f.dep < end)]]))
                    out.append((q.query_id, x, end, f"{k:06d}", min(u, v), max(u, v), "up" if u < v else "down", xs.tolist(), (xs + np.interp(xs, f.dep, f.tt)).tolist()))
                if end >= q.last:
                    break
                x = end
        return pd.DataFrame(out, columns=[c.split()[0] for c in ARC.split(", ")])

    return _searched(od, functions, tree, run, ARC)


def _parted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Arcs with their shortcut's row, cut where its source changes: edges of the network are done; of a shortcut, both legs."""
    for part in parts:
        out = []
        for r in part.itertuples(index=False):
            xs, at = np.asarray(r.xs, float), np.asarray(r.at, float)
            f = _read(r)
            turns = np.interp(_reached(f.starts, at[0], at[-1]), at, xs) if len(xs) > 1 else np.zeros(0)
            borders = np.unique(np.concatenate([[r.x0], turns[(turns > r.x0 + EPS) & (turns < r.x1 - EPS)], [r.x1]]))
            for x0, x1 in zip(borders[:-1], borders[1:]) if len(borders) > 1 else [(r.x0, r.x1)]:
                own = np.unique(np.concatenate([[x0, x1], xs[(xs > x0) & (xs < x1)]]))
                when = np.interp(own, xs, at)
                via = source(f, float(np.mod(np.interp((x0 + x1) / 2, xs, at), DAY)))
                if via < 0:
                    out.append((r.query_id, x0, x1, r.pos, -1, -1, "edge", own.tolist(), when.tolist(), -1 - via, None, None, None))
                    continue
                a, b = (r.lo, r.hi) if r.dir == "up" else (r.hi, r.lo)
                out.append((r.query_id, x0, x1, r.pos + "0", via, a, "down", own.tolist(), when.tolist(), None, None, None, None))
                out.append((r.query_id, x0, x1, r.pos + "1", via, b, "up", own.tolist(), when.tolist(), None, via, a, "down"))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _PARTED.split(", ")]).astype({"edge_id": "Int64", "lo1": "Int64", "hi1": "Int64"})


_PARTED = ARC + ", edge_id long, lo1 long, hi1 long, dir1 string"


def _shifted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Second legs, entered when the first one's function says."""
    for part in parts:
        xs, at = [], []
        for r in part.itertuples(index=False):
            own, when = np.asarray(r.xs, float), np.asarray(r.at, float)
            f = _read(r)
            if len(own) > 1:
                own = np.unique(np.concatenate([own, np.interp(_reached(f.dep[:-1], when[0], when[-1]), when, own)]))
                when = np.interp(own, np.asarray(r.xs, float), when)
            xs.append(own.tolist())
            at.append((when + at_times(f, when)).tolist())
        part["xs"], part["at"] = xs, at
        yield part[[c.split()[0] for c in ARC.split(", ")]]


def unpack(functions: DataFrame, ways: DataFrame) -> DataFrame:
    """query_id, x0, x1, pos, edge_id, xs, at: the edges of the network on `ways` (`arcs`), in order of pos, cut to ranges of departures over which
    they stay the same. All shortcuts are resolved at once, a level a round."""
    names = ["dep", "tt", "starts", "vias"]
    own = functions.select("lo", "hi", "dir", *names)
    first = functions.select(F.col("lo").alias("lo1"), F.col("hi").alias("hi1"), F.col("dir").alias("dir1"), *names)
    done, todo = None, cut(ways)
    while todo.head(1):
        parted = cut(todo.join(own, ["lo", "hi", "dir"]).select("query_id", "x0", "x1", "pos", "lo", "hi", "dir", "xs", "at", *names).mapInPandas(_parted, _PARTED))
        edges = parted.where("edge_id is not null").select("query_id", "x0", "x1", "pos", "edge_id", "xs", "at")
        done = edges if done is None else done.union(edges)
        legs = parted.where("edge_id is null")
        plain = [c.split()[0] for c in ARC.split(", ")]
        second = legs.where("lo1 is not null").join(first, ["lo1", "hi1", "dir1"]).select(*plain, *names).mapInPandas(_shifted, ARC)
        todo = cut(legs.where("lo1 is null").select(*plain).union(second))
    return done if done is not None else ways.select("query_id", "x0", "x1", "pos", F.lit(None).cast("long").alias("edge_id"), "xs", "at")


def _ranges(keys: tuple, part: pd.DataFrame) -> pd.DataFrame:
    """A query's edges by ranges in which all of them stay."""
    borders = np.unique(np.concatenate([part["x0"], part["x1"]]))
    out, last = [], None
    for x0, x1 in zip(borders[:-1], borders[1:]) if len(borders) > 1 else [(borders[0], borders[0])]:
        here = part[(part["x0"] <= x0) & (part["x1"] >= x1)].sort_values("pos")["edge_id"].tolist()
        if x1 - x0 <= EPS < borders[-1] - borders[0]:
            continue
        if here == last:
            out[-1] = (*out[-1][:2], float(x1), here)
        else:
            out.append((keys[0], float(x0), float(x1), here))
        last = here
    return pd.DataFrame(out, columns=["query_id", "first", "last", "edges"])


def profile_paths(functions: DataFrame, tree: DataFrame, od: DataFrame) -> DataFrame:
    """query_id, first, last, edges: for each range of departures in od (query_id, src, dst, first, last) the edges of a fastest way."""
    return unpack(functions, arcs(functions, tree, od)).groupBy("query_id").applyInPandas(_ranges, "query_id long, first double, last double, edges array<long>")


def paths_at(functions: DataFrame, tree: DataFrame, od: DataFrame) -> DataFrame:
    """query_id, idx, edge_id, entered of a fastest way for each (query_id, src, dst, departure); a profile of a single departure."""
    at = od.select("query_id", "src", "dst", F.col("departure").alias("first"), F.col("departure").alias("last"))
    found = unpack(functions, arcs(functions, tree, at)).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "edge_id", F.col("at")[0].alias("entered")))).alias("e"))
    return found.select("query_id", F.posexplode("e").alias("idx", "x")).select("query_id", "idx", "x.edge_id", "x.entered")


def source_statistics(functions: DataFrame) -> DataFrame:
    """One row: shortcuts, sources (how many they have in sum), most (of one), single (shortcuts with one). No shortcuts: 0, null, null, 0."""
    n = F.size("vias")
    return functions.agg(F.count(F.lit(1)).alias("shortcuts"), F.sum(n).cast("long").alias("sources"), F.max(n).cast("long").alias("most"), F.count_if(n == 1).alias("single"))


def unique_paths(functions: DataFrame) -> DataFrame:
    """lo, hi, dir of the shortcuts that lead over the same edges all day: they have one source, and so have all shortcuts below them. A round
    for each level on which more of them turn out not to; it looks only at those above the last round's."""
    keys = ["lo", "hi", "dir"]
    one = functions.where(F.size("vias") == 1).select(*keys, F.col("vias")[0].alias("via"))
    start = F.when(F.col("dir") == "up", F.col("lo")).otherwise(F.col("hi"))
    end = F.when(F.col("dir") == "up", F.col("hi")).otherwise(F.col("lo"))
    leg = F.explode(F.array(F.struct(start.alias("hi"), F.lit("down").alias("dir")), F.struct(end.alias("hi"), F.lit("up").alias("dir"))))
    legs = cut(one.where("via >= 0").select(*keys, F.col("via").alias("leg_lo"), leg.alias("e")).select(*keys, "leg_lo", F.col("e.hi").alias("leg_hi"), F.col("e.dir").alias("leg_dir")))
    fresh = cut(functions.where(F.size("vias") > 1).select(*keys))
    varied = fresh
    while fresh.head(1):
        below = fresh.select(*(F.col(c).alias(f"leg_{c}") for c in keys))
        fresh = cut(legs.join(below, [f"leg_{c}" for c in keys], "left_semi").select(*keys).distinct().join(varied, keys, "left_anti"))
        varied = varied.union(fresh)
    return functions.select(*keys).join(varied, keys, "left_anti")
