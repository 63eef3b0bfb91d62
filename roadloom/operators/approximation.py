"""Travel-time functions with fewer points: the fewest that any function within a tunnel around the exact one can have, true lower and
upper bounds, and linking and taking the better of two by their bounds, with the exact functions only where bounds overlap.

The tunnel of a function f goes from f - eps to f + eps, or only to one side of f. Its ends are pinned to f, so that a day's function
stays periodic and pieces fit together. A line can be laid through the tunnel for as long as the steepest and the flattest line that keep
within it still do; where they leave it, the next line must cross the last one between its last support and its exit, so of the tunnel's
two borders one counts from that support on and the other one from the exit on. Each line reaches as far as any could, so there are
fewest. Lines never fall faster than f's arrivals allow: nobody overtakes on an approximation of a function on which nobody does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profiles import EPS, Fn, function, link, merge

#: Rounding that lines are forgiven at a border (ms).
SLACK = 1e-7
SIDES = {"lower": (1.0, 0.0), "both": (1.0, 1.0), "upper": (0.0, 1.0)}


def _slope(x: float, y: float, points: list[tuple[float, float]], best: Callable) -> float:
    """The least or largest slope to (x, y) from points before it; arrays pay for many points only."""
    if len(points) < 40:
        return best([(y - b) / (x - a) for a, b in points])
    p = np.array(points)
    slopes = (y - p[:, 1]) / (x - p[:, 0])
    return float(slopes.min() if best is min else slopes.max())


def _reach(events: list[tuple[float, float, float]]) -> tuple[int, tuple, int]:
    """How many of the events (x, lower, upper border; infinite: none) a line can pass, that line as (x, y, slope), and its side: 1 if
    the tunnel rises above all lines at the next event, -1 if it falls below, 0 at the end. The line's point (x, y) is its last support."""
    lows: list[tuple[float, float]] = []
    highs: list[tuple[float, float]] = []
    steep = flat = None
    for k, (x, low, high) in enumerate(events):
        top = np.inf if steep is None else steep[1] + steep[2] * (x - steep[0])
        bottom = -np.inf if flat is None else flat[1] + flat[2] * (x - flat[0])
        if top < low - SLACK:
            return k, steep, 1
        if bottom > high + SLACK:
            return k, flat, -1
        if top > high and lows:
            steep = x, high, _slope(x, high, lows, min)
        if bottom < low and highs:
            flat = x, low, _slope(x, low, highs, max)
        if low > -np.inf:
            lows.append((x, low))
        if high < np.inf:
            highs.append((x, high))
    return len(events), steep, 0


def fewest(dep: np.ndarray, tt: np.ndarray, eps: float, side: str = "both") -> tuple[np.ndarray, np.ndarray]:
    """The fewest points of a function that is nowhere more than eps away, on both sides or on one side only ("lower", "upper"), and
    equal at both ends. One or two points, and eps 0 up to points on their neighbours' line, come back as they are."""
    if len(dep) <= 2 or eps < 0:
        return dep, tt
    below, above = SIDES[side]
    low, high = tt - below * eps, tt + above * eps
    low[0] = high[0] = tt[0]
    low[-1] = high[-1] = tt[-1]
    xs, lows, highs = dep.tolist(), low.tolist(), high.tolist()
    every = list(zip(xs, lows, highs))
    events, lines = every, []
    while True:
        passed, line, way = _reach(events)
        lines.append(line)
        if way == 0:
            break
        k = len(every) - (len(events) - passed)  # the event that the line can't pass, and the one before it
        border, other = (lows, highs) if way == 1 else (highs, lows)
        x0, y0, x1, y1 = xs[k - 1], border[k - 1], xs[k], border[k]
        gap0 = line[1] + line[2] * (x0 - line[0]) - y0
        gap1 = line[1] + line[2] * (x1 - line[0]) - y1
        share = min(max(gap0 / (gap0 - gap1), 0.0), 1.0) if gap0 != gap1 else 0.0
        exit_x = max(x0 + share * (x1 - x0), line[0])
        exit_y = y0 + (y1 - y0) * (exit_x - x0) / (x1 - x0)
        across = other[k - 1] + (other[k] - other[k - 1]) * (exit_x - x0) / (x1 - x0)
        inner = [e for e in every[:k] if line[0] < e[0] < exit_x]
        support = [(line[0], line[1])] if line[0] < exit_x else []
        if way == 1:
            middle = [*((x, -np.inf, y) for x, y in support), *((x, -np.inf, h) for x, _, h in inner), (exit_x, exit_y, across)]
        else:
            middle = [*((x, y, np.inf) for x, y in support), *((x, l, np.inf) for x, l, _ in inner), (exit_x, across, exit_y)]
        events = [*middle, *every[k:]]
    out = [(xs[0], lines[0][1] + lines[0][2] * (xs[0] - lines[0][0]))]
    for (x0, y0, a), (x1, y1, b) in zip(lines, lines[1:]):
        x = (y1 - b * x1 - y0 + a * x0) / (a - b) if a != b else x1
        x = min(max(x, out[-1][0]), xs[-1])
        out.append((x, y0 + a * (x - x0)))
    out.append((xs[-1], lines[-1][1] + lines[-1][2] * (xs[-1] - lines[-1][0])))
    x, y = np.array(out).T
    keep = np.ones(len(x), bool)
    keep[1:-1] = np.diff(x)[:-1] > EPS
    return x[keep], y[keep]


def better(f: tuple[Fn, Fn], g: tuple[Fn, Fn]) -> list[tuple[float, float, int]]:
    """Ranges (start, end, 0: f, 1: g, -1: the bounds overlap) by the (lower, upper) bounds of two functions over one range."""
    day = np.unique(np.concatenate([h.dep for h in (*f, *g)]))
    at = [[np.interp(day, h.dep, h.tt) for h in pair] for pair in (f, g)]
    gaps = [at[1][0] - at[0][1], at[0][0] - at[1][1]]  # g's lower over f's upper, f's lower over g's upper
    cuts = [day]
    for d in gaps:
        k = np.flatnonzero(d[:-1] * d[1:] < 0)
        cuts.append(day[k] + (day[k + 1] - day[k]) * d[k] / (d[k] - d[k + 1]))
    x = np.unique(np.concatenate(cuts))
    mid = (x[1:] + x[:-1]) / 2
    who = np.where(np.interp(mid, day, gaps[0]) >= 0, 0, np.where(np.interp(mid, day, gaps[1]) > 0, 1, -1))
    start = np.concatenate([[0], np.flatnonzero(who[1:] != who[:-1]) + 1, [len(who)]])
    return [(float(x[i]), float(x[j]), int(who[i])) for i, j in zip(start[:-1], start[1:])]


def _cropped(f: Fn, a: float, b: float) -> Fn:
    inner = (f.dep > a) & (f.dep < b)
    dep = np.concatenate([[a], f.dep[inner], [b]])
    return function(dep, np.interp(dep, f.dep, f.tt), [a], f.vias[:1])


def _plain(points: tuple[np.ndarray, np.ndarray], via: int) -> Fn:
    dep, tt = points
    return function(dep, tt, [float(dep[0])], [via])


def _batches(df: DataFrame, names: list[str], run, schema: str) -> DataFrame:
    """run on each row's key and the functions `names`, every one as arrays (dep, tt), which hold no object a point as rows would.
    Rows are dealt to all tasks: they are small, but not quickly done."""
    cols = [F.col(f"{n}.{c}").alias(f"{n}_{c}") for n in names for c in ("dep", "tt")]
    parts = max(4 * df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def each(all_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = [c.split()[0] for c in schema.split(", ")]
        for part in all_:
            arrays = [zip(part[f"{n}_dep"], part[f"{n}_tt"]) for n in names]
            yield pd.DataFrame([(key, *run(*functions)) for key, *functions in zip(part["key"].tolist(), *arrays)], columns=out)

    return df.select("key", *cols).repartition(parts).mapInPandas(each, schema)


def _points(name: str, prefix: str):
    return F.zip_with(f"{prefix}_dep", f"{prefix}_tt", lambda x, y: F.struct(x.alias("dep"), y.alias("tt"))).alias(name)


def _schema(names: list[str]) -> str:
    return ", ".join(["key long", *(f"{n}_{c} array<double>" for n in names for c in ("dep", "tt"))])


def reduced(functions: DataFrame, eps: float, sides: tuple[str, ...] = ("both", "lower", "upper")) -> DataFrame:
    """key, p, near, lower, upper of functions (key, p: points (dep, tt) over one range): with the fewest points each, near within eps on
    both sides, lower and upper on theirs; only those of `sides`. All are arrays of (dep, tt). No or one point: the same in all."""
    names = ["p", *("near" if side == "both" else side for side in sides)]

    def run(p) -> list:
        if p[0] is None or len(p[0]) < 2:
            return [x for _ in names for x in p]
        return [*p, *(x for side in sides for x in fewest(*p, eps, side))]

    own = functions.select("key", F.transform("p", lambda q: F.struct(q["dep"].cast("double").alias("dep"), q["tt"].cast("double").alias("tt"))).alias("p"))
    return _batches(own, ["p"], run, _schema(names)).select("key", *(_points(n, n) for n in names))


def bounded_links(pairs: DataFrame) -> DataFrame:
    """key, lower, upper: bounds of f and then g, for rows (key, f_lower, f_upper, g_lower, g_upper) of whole days' points. They hold as
    nobody overtakes: the earliest arrival at g's start, and g's lower bound from there on, are both never too late."""

    def run(f_lower, f_upper, g_lower, g_upper) -> list:
        out = [link(_plain(a, 0), _plain(b, 0), 0) for a, b in ((f_lower, g_lower), (f_upper, g_upper))]
        return [x for h in out for x in (h.dep, h.tt)]

    found = _batches(pairs, ["f_lower", "f_upper", "g_lower", "g_upper"], run, _schema(["lower", "upper"]))
    return found.select("key", _points("lower", "lower"), _points("upper", "upper"))


def bounded_merges(pairs: DataFrame) -> DataFrame:
    """key, starts, firsts (true where f is better, or as good, from that start on), refined (ms of the range for which the exact functions
    were needed) for rows (key, f, f_lower, f_upper, g, g_lower, g_upper) over one range. The answer is that of the exact functions."""

    def run(p, f_lower, f_upper, q, g_lower, g_upper) -> tuple:
        bounds = [(_plain(a, 0), _plain(b, 0)) for a, b in ((f_lower, f_upper), (g_lower, g_upper))]
        f = g = None
        starts, firsts, refined = [], [], 0.0
        for a, b, who in better(*bounds):
            if b - a <= EPS:
                continue
            if who >= 0:
                ways = [(a, who)]
            else:
                f, g = f or _plain(p, 0), g or _plain(q, 1)
                h = merge(_cropped(f, a, b), _cropped(g, a, b))
                ways, refined = list(zip(h.starts, h.vias)), refined + b - a
            for s, v in ways:
                if not firsts or firsts[-1] != (v == 0):
                    starts.append(float(s))
                    firsts.append(v == 0)
        return starts, firsts, refined

    return _batches(pairs, ["f", "f_lower", "f_upper", "g", "g_lower", "g_upper"], run, "key long, starts array<double>, firsts array<boolean>, refined double")
