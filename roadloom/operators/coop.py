"""Networks whose weights change with their use: capacities, buckets, metrics, cooperative routing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ttf import DAY, small, speed_profile_times

#: Points of functions that a task gives away at a time.
POINTS = 100_000


def init_capacity(edges: DataFrame, buckets: int) -> DataFrame:
    """capacity per bucket (0 under 50 an hour), free-flow speed, and free-flow time (null: closed)."""
    if DAY % buckets:
        raise ValueError("the number of buckets must divide a day")
    cap = F.when(F.col("capacity_per_h") >= 50, F.expr(f"capacity_per_h * 24 div {buckets}")).otherwise(F.lit(0)).cast("long")
    speed = F.greatest(F.expr("3600 * dist_m div ff_time"), F.lit(1))
    out = edges.select("edge_id", "tail", "head", "dist_m", cap.alias("capacity"), speed.cast("long").alias("ff_speed"))
    return out.withColumn("ff_time", F.when(F.col("capacity") > 0, F.expr("3600 * dist_m div ff_speed")))


def _load(used: Column, capacity: Column, alpha: float, beta: float) -> Column:
    load = used / capacity
    grown = load * load if beta == 2 else F.pow(load, F.lit(float(beta)))
    return 1 + (grown if alpha == 1 else F.lit(float(alpha)) * grown)


def bpr_time(ff: Column, used: Column, capacity: Column, alpha: float = 1, beta: float = 2) -> Column:
    """Free-flow time times 1 + alpha * load^beta, rounded, at least 1."""
    return F.greatest(F.round(ff * _load(used, capacity, alpha, beta)), F.lit(1)).cast("long")


def bpr_speed(ff: Column, used: Column, capacity: Column, alpha: float = 1, beta: float = 2) -> Column:
    """Free-flow speed divided by the same."""
    return F.greatest(F.round(ff / _load(used, capacity, alpha, beta)), F.lit(1)).cast("long")


def free_flow(network: DataFrame, profiles: DataFrame, at: DataFrame) -> DataFrame:
    """edge_id, t, tt: the time on an edge entered at t by the speeds of current use alone (profiles edge_id, start,
    kmh), without any history; free flow where there is no profile, null where the edge is closed."""
    both = at.join(network.select("edge_id", "dist_m", "ff_time"), "edge_id")
    now = both.join(profiles, (both.edge_id == profiles.edge_id) & (F.col("start") <= F.expr(f"pmod(t, {DAY})")), "left").groupBy(both.edge_id, "t")
    found = now.agg(F.max_by("kmh", "start").alias("kmh"), F.max("dist_m").alias("dist_m"), F.max("ff_time").alias("ff_time"))
    return found.select("edge_id", "t", F.expr("case when ff_time is null then null when kmh is null then ff_time else 3600 * dist_m div kmh end").alias("tt"))


def with_history(profiles: DataFrame, history: DataFrame) -> DataFrame:
    """Speed profiles (edge_id, start, kmh) lowered to historic ones: at each start of either the smaller of the
    speeds in force."""
    starts = profiles.select("edge_id", "start").union(history.select("edge_id", "start")).distinct()

    def force(p: DataFrame, name: str) -> DataFrame:
        hit = starts.join(p.select("edge_id", F.col("start").alias("since"), "kmh"), "edge_id").where("since <= start")
        return hit.groupBy("edge_id", "start").agg(F.max_by("kmh", "since").alias(name))

    both = starts.join(force(profiles, "own"), ["edge_id", "start"], "left").join(force(history, "past"), ["edge_id", "start"], "left")
    return both.select("edge_id", "start", F.least("own", "past").alias("kmh"))


def usage_statistics(network: DataFrame, used: DataFrame) -> DataFrame:
    """One row: edges, edges that are used, buckets in use, trips over edges, the largest number in one bucket, and
    buckets beyond their capacity."""
    totals = used.join(network.select("edge_id", "capacity"), "edge_id").agg(
        F.countDistinct("edge_id").alias("used_edges"), F.count(F.lit(1)).alias("buckets"), F.sum("used").alias("uses"), F.max("used").alias("most"), F.count_if(F.col("used") > F.col("capacity")).alias("over")
    )
    return network.agg(F.count(F.lit(1)).alias("edges")).crossJoin(totals)  # two single rows


def bucket_of(t: str, size: int) -> Column:
    return F.expr(f"{size} * (pmod({t}, {DAY}) div {size})")


def usage(events: DataFrame, size: int) -> DataFrame:
    """edge_id, bucket, used: how often an edge is used in each bucket of the day."""
    return events.groupBy("edge_id", bucket_of("t_ms", size).alias("bucket")).agg(F.count(F.lit(1)).alias("used"))


def speed_profiles(network: DataFrame, used: DataFrame, size: int) -> DataFrame:
    """edge_id, start, kmh: a speed per used bucket, back to free flow at the next bucket if that is
    unused, and a point at the start of the day."""
    both = used.join(network, "edge_id").where("capacity > 0")
    slow = both.select("edge_id", F.col("bucket").alias("start"), bpr_speed(F.col("ff_speed"), F.col("used"), F.col("capacity")).alias("kmh"))
    after = both.select("edge_id", (F.col("bucket") + size).alias("start"), F.col("ff_speed").alias("kmh")).where(F.col("start") < DAY)
    begin = both.select("edge_id", F.lit(0).cast("long").alias("start"), F.col("ff_speed").alias("kmh")).distinct()
    free = after.union(begin).distinct().join(slow.select("edge_id", "start"), ["edge_id", "start"], "left_anti")
    return slow.union(free)


def rebuild_functions(profiles: DataFrame, network: DataFrame) -> DataFrame:
    """edge_id, dep, tt: travel-time functions of edges from their speed profiles. Edges come to Python in batches of rows with their points, not one by one."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at, flat = part["p"].offsets.to_pylist(), part["p"].flatten()
            start, kmh = flat.field("start").to_pylist(), flat.field("kmh").to_pylist()
            first = at[0] if at else 0
            ids, deps, tts = [], [], []
            rows = lambda: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, deps, tts)], names=["edge_id", "dep", "tt"])
            for edge, length, a, b in zip(part["edge_id"].to_pylist(), part["dist_m"].to_pylist(), at, at[1:]):
                points = speed_profile_times(list(zip(start[a - first : b - first], kmh[a - first : b - first])), length)
                ids += [edge] * len(points)
                deps += [x for x, _ in points]
                tts += [y for _, y in points]
                if len(ids) >= POINTS:
                    yield rows()
                    ids, deps, tts = [], [], []
            yield rows()

    points = profiles.groupBy("edge_id").agg(F.array_sort(F.collect_list(F.struct("start", "kmh"))).alias("p"))
    return points.join(network.select("edge_id", "dist_m"), "edge_id").select("edge_id", F.col("dist_m").cast("long").alias("dist_m"), "p").mapInArrow(run, "edge_id long, dep long, tt long")


def tightest_metric(queries: DataFrame, metrics: DataFrame) -> DataFrame:
    """query_id, metric_id of the shortest interval that covers [departure, latest] (ties: smaller id);
    metric 0 if the trip ends on another day. Metrics are broadcast up to 10,000."""
    few = small(metrics, 10_000)
    fits = queries.where(F.col("latest") < DAY).join(few, (F.col("start") <= F.col("departure")) & (F.col("latest") <= F.col("end")))
    best = fits.groupBy("query_id").agg(F.min(F.struct((F.col("end") - F.col("start")).alias("len"), "metric_id")).alias("b"))
    return queries.join(best, "query_id", "left").select("query_id", F.coalesce("b.metric_id", F.lit(0)).cast("long").alias("metric_id"))


def _steps(first: int, last: int, step_min: int, length_min: int) -> list[tuple[int, int]]:
    return [(i * step_min, i * step_min + length_min) for i in range(first, last)]


#: Intervals in minutes of the day. balanced: 8, 4, 2 and 1 hours long at half steps, but for the night;
#: complete: the whole day likewise; rush_hour: fixed values.
PATTERNS = {
    "balanced": _steps(1, 4, 240, 480) + _steps(3, 9, 120, 240) + _steps(5, 20, 60, 120) + _steps(10, 40, 30, 30),
    "complete": _steps(0, 5, 240, 480) + _steps(0, 11, 120, 240) + _steps(0, 23, 60, 120) + _steps(0, 47, 30, 30),
    "rush_hour": [
        *((0, 360), (1200, 1440), (360, 600), (600, 900), (600, 612), (720, 840), (660, 780), (900, 1200), (420, 540)),
        *((420, 480), (480, 540), (900, 1020), (1020, 1140), (1140, 1260), (960, 1020), (1020, 1080), (1080, 1140), (1140, 1200)),
    ],
}


def interval_pattern(spark, pattern: str | list[float]) -> DataFrame:
    """metric_id, start, end: metric 0 is the whole day; then the intervals of a pattern by name, or, for a list of
    lengths in hours, intervals of each length at half steps through the day."""
    if isinstance(pattern, str):
        found = [(a * 60_000, b * 60_000) for a, b in PATTERNS[pattern]]
    else:
        lengths = [int(h * 3_600_000) for h in pattern]
        found = [(start, start + n) for n in lengths for start in range(0, DAY - n + 1, n // 2)]
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate([(0, DAY), *found])], "metric_id long, start long, end long")


def metric_difference(metrics: DataFrame) -> DataFrame:
    """a, b, diff: sum over edges of (|difference| div 500)^2 for each pair of metrics (metric_id, edge_id,
    weight). A metric has each edge once, so an edge meets as many rows as there are metrics."""
    x, y = metrics.select("edge_id", F.col("metric_id").alias("a"), F.col("weight").alias("wa")), metrics.select("edge_id", F.col("metric_id").alias("b"), F.col("weight").alias("wb"))
    d = F.expr("abs(wa - wb) div 500")
    return x.join(y, "edge_id").where("a < b").groupBy("a", "b").agg(F.sum(d * d).alias("diff"))


def reduce_metrics(metrics: DataFrame, k: int) -> DataFrame:
    """metric_id, reduced: the closest pair is merged by elementwise minimum until k metrics are left."""
    from ..session import cut

    now = cut(metrics.select("metric_id", "edge_id", "weight"))
    ids = [r["metric_id"] for r in now.select("metric_id").distinct().orderBy("metric_id").collect()]
    into = {i: i for i in ids}
    while len(set(into.values())) > k:
        best = metric_difference(now).orderBy("diff", "a", "b").first()
        a, b = best["a"], best["b"]
        into = {i: a if r == b else r for i, r in into.items()}
        merged = F.when(F.col("metric_id") == b, F.lit(a)).otherwise(F.col("metric_id")).alias("metric_id")
        now = cut(now.select(merged, "edge_id", "weight").groupBy("metric_id", "edge_id").agg(F.min("weight").alias("weight")))
    dense = {r: n for n, r in enumerate(sorted(set(into.values())))}
    return metrics.sparkSession.createDataFrame([(i, dense[r]) for i, r in into.items()], "metric_id long, reduced long")


def cooperative(network: DataFrame, od: DataFrame, size: int, batch: int = 1, used: DataFrame | None = None) -> DataFrame:
    """query_id, duration, realised, uses: trips in order of departure; each answered trip uses its edges'
    buckets, which slows later ones (square of the load).

    The exact order is sequential by nature: one task with the network (of checked size) as its state.
    batch > 1 lets that many trips see the same state. `realised` is the time on the final state, `uses`
    the edges and buckets (edge_id, bucket) that the trip counts for. used (edge_id, bucket, used): earlier trips' uses."""
    if network.count() > 5_000_000:
        raise ValueError("the network is too large for one task")
    rows = network.where("capacity > 0").select("edge_id", "tail", "head", "ff_time", "capacity").collect()
    if used is not None and used.count() > 5_000_000:
        raise ValueError("the state is too large for one task")
    before = {} if used is None else {(r["edge_id"], r["bucket"] // size): r["used"] for r in used.groupBy("edge_id", "bucket").agg(F.sum("used").alias("used")).collect()}
    shared = network.sparkSession.sparkContext.broadcast(([tuple(r) for r in rows], before))

    def run(keys: tuple, part: pd.DataFrame) -> pd.DataFrame:
        graph: dict[int, list] = {}
        for e, u, v, ff, cap in shared.value[0]:
            graph.setdefault(u, []).append((v, e, ff, cap, max(1, int(ff + 0.5))))
        used: dict[int, dict[int, int]] = {}  # by bucket, then edge: a node is left in one bucket, and most edges aren't used in it
        for (e, k), n in shared.value[1].items():
            used.setdefault(k, {})[e] = n
        nobody: dict[int, int] = {}

        def cost(e, ff, cap, t):
            load = used.get(t % DAY // size, nobody).get(e, 0) / cap
            return max(1, int(ff * (1 + load * load) + 0.5))

        def route(src, dst, start):
            best, pred, heap = {src: start}, {}, [(start, src)]
            while heap:
                t, u = heapq.heappop(heap)
                if t > best[u]:
                    continue
                if u == dst:
                    break
                here = used.get(t % DAY // size, nobody)
                for v, e, ff, cap, alone in graph.get(u, ()):
                    new = t + (cost(e, ff, cap, t) if e in here else alone)
                    if new < best.get(v, new + 1):
                        best[v], pred[v] = new, (u, e, ff, cap, t)
                        heapq.heappush(heap, (new, v))
            if dst not in best:
                return None, []
            path, v = [], dst
            while v != src:
                path.append(pred[v])
                v = pred[v][0]
            return best[dst] - start, path[::-1]

        def count(uses):
            for e, k in uses:
                now = used.setdefault(k, {})
                now[e] = now.get(e, 0) + 1

        part = part.sort_values(["departure", "query_id"])
        trips, pending = [], []
        for n, (q, s, d, t) in enumerate(zip(part["query_id"], part["src"], part["dst"], part["departure"])):
            took, path = route(s, d, t)
            trips.append((q, t, took, path))
            pending += [(e, at % DAY // size) for _, e, _, _, at in path]
            if (n + 1) % batch == 0:
                count(pending)
                pending = []
        count(pending)
        out = []
        for q, t, took, path in trips:
            now = t
            for _, e, ff, cap, _ in path:
                now += cost(e, ff, cap, now)
            out.append((q, took, now - t if took is not None else None, [(e, at % DAY // size * size) for _, e, _, _, at in path]))
        return pd.DataFrame(out, columns=["query_id", "duration", "realised", "uses"]).astype({"duration": "Int64", "realised": "Int64"})

    return od.select("query_id", "src", "dst", "departure").withColumn("one", F.lit(0)).groupBy("one").applyInPandas(run, "query_id long, duration long, realised long, uses array<struct<edge_id: long, bucket: long>>")
