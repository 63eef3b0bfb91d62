"""Transforms, identifiers and statistics of networks.

Edges are (edge_id, tail, head, weight); unreachable or blocked is null, never a number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .ordered import carry_last, number_rows, running_sum


def csr_offsets(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node_id, first_out: the running number of edges before the node's."""
    degree = edges.groupBy(F.col("tail").alias("node_id")).agg(F.count(F.lit(1)).alias("n"))
    both = nodes.select("node_id").join(degree, "node_id", "left")
    return running_sum(both, ["node_id"], F.coalesce("n", F.lit(0)), "first_out").select("node_id", "first_out")


def tails_from_offsets(offsets: DataFrame, edges: DataFrame) -> DataFrame:
    """edge_id, tail by the position of the edge among the offsets: one pass over both, sorted by position."""
    marks = offsets.select(F.col("first_out").alias("at"), F.lit(0).alias("kind"), "node_id").unionByName(edges.select(F.col("edge_id").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("node_id")))
    return carry_last(marks, ["at", "kind", "node_id"], "node_id", "tail").where("kind = 1").select(F.col("at").alias("edge_id"), "tail")


def reverse(edges: DataFrame) -> DataFrame:
    """Edges the other way, numbered by (tail, old edge)."""
    turned = edges.select(F.col("head").alias("tail"), F.col("tail").alias("head"), "weight", F.col("edge_id").alias("original"))
    return number_rows(turned, ["tail", "original"], "edge_id").select("edge_id", "tail", "head", "weight", "original")


def ranked(edges: DataFrame, order: DataFrame) -> DataFrame:
    """Edges between ranks (edge_id as before)."""
    a, b = order.select(F.col("node_id").alias("tail"), F.col("rank").alias("t")), order.select(F.col("node_id").alias("head"), F.col("rank").alias("h"))
    return edges.join(a, "tail").join(b, "head").select("edge_id", F.col("t").alias("tail"), F.col("h").alias("head"), "weight")


def permute(edges: DataFrame, order: DataFrame, keep: Column | None = None) -> DataFrame:
    """Edges between ranks that `keep` (of edge_id, tail, head, weight as they were) holds for, numbered by
    (tail, head) rank."""
    chosen = ranked(edges if keep is None else edges.where(keep), order)
    return number_rows(chosen.withColumnRenamed("edge_id", "was"), ["tail", "head", "was"], "edge_id").select("edge_id", "tail", "head", "weight")


def rank_split(edges: DataFrame, order: DataFrame) -> DataFrame:
    """dir, low, high, weight: edges to a higher rank are up, the others go down and are turned."""
    return ranked(edges, order).where("tail <> head").select(
        F.when(F.col("tail") < F.col("head"), "up").otherwise("down").alias("dir"), F.least("tail", "head").alias("low"), F.greatest("tail", "head").alias("high"), "weight"
    )


def line_graph(edges: DataFrame, forbidden: DataFrame | None = None, turn_cost: Column | None = None) -> DataFrame:
    """Edges become nodes, allowed turns edges: (tail, head, weight of the first plus the turn's cost)."""
    a = edges.select(F.col("edge_id").alias("from_edge"), F.col("tail").alias("a_tail"), F.col("head").alias("via"), "weight")
    b = edges.select(F.col("edge_id").alias("to_edge"), F.col("tail").alias("via"), F.col("head").alias("b_head"))
    turns = a.join(b, "via")
    if forbidden is not None:
        turns = turns.join(forbidden.select("from_edge", "to_edge"), ["from_edge", "to_edge"], "left_anti")
    cost = F.lit(0) if turn_cost is None else turn_cost
    return turns.select(F.col("from_edge").alias("tail"), F.col("to_edge").alias("head"), (F.col("weight") + cost).cast("long").alias("weight"))


def no_uturns(edges: DataFrame) -> DataFrame:
    """Turns (from_edge, to_edge) that don't lead back to where the first edge began."""
    a = edges.select(F.col("edge_id").alias("from_edge"), F.col("tail").alias("a_tail"), F.col("head").alias("via"))
    b = edges.select(F.col("edge_id").alias("to_edge"), F.col("tail").alias("via"), F.col("head").alias("b_head"))
    return a.join(b, "via").where("a_tail <> b_head").select("from_edge", "to_edge")


def dense_ids(keys: DataFrame, col: str) -> DataFrame:
    """global_id, local_id: numbers from 0 in ascending order of the distinct keys."""
    return number_rows(keys.select(F.col(col).alias("global_id")).distinct(), ["global_id"], "local_id")


def next_lower(ids: DataFrame, keys: DataFrame) -> DataFrame:
    """key, local_id of the largest global id that isn't above the key (null if all are)."""
    marks = ids.select(F.col("global_id").alias("at"), F.lit(0).alias("kind"), "local_id").unionByName(keys.select(F.col("key").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("local_id")))
    return carry_last(marks, ["at", "kind"], "local_id", "found").where("kind = 1").select(F.col("at").alias("key"), F.col("found").alias("local_id"))


def box(nodes: DataFrame, edges: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """Edges with both ends in the box (inclusive), nodes numbered anew."""
    inside = dense_ids(nodes.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1)), "node_id")
    a, b = inside.select(F.col("global_id").alias("tail"), F.col("local_id").alias("t")), inside.select(F.col("global_id").alias("head"), F.col("local_id").alias("h"))
    return edges.join(a, "tail").join(b, "head").select(F.col("t").alias("tail"), F.col("h").alias("head"), "weight")


def unify_parallel(edges: DataFrame) -> DataFrame:
    """Parallel edges all get the smallest of their weights; rows stay."""
    return edges.withColumn("weight", F.min("weight").over(Window.partitionBy("tail", "head")))


def collapse_multi(edges: DataFrame) -> DataFrame:
    """One edge per (tail, head): capacities added, time and distance of the fastest (ties: shorter)."""
    fastest = F.min(F.struct("ff_time", "dist_m"))
    return edges.groupBy("tail", "head").agg(F.sum("capacity_per_h").alias("capacity_per_h"), fastest.alias("f")).select("tail", "head", "capacity_per_h", "f.ff_time", "f.dist_m")


def symmetric_degree(edges: DataFrame) -> DataFrame:
    """node_id, degree: the number of distinct neighbours in either direction."""
    both = edges.select(F.col("tail").alias("node_id"), F.col("head").alias("other")).union(edges.select("head", "tail")).where("node_id <> other")
    return both.distinct().groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))


def compare_vectors(both: DataFrame) -> DataFrame:
    """Of rows (idx, a, b): how many are smaller, larger, equal, and the first index that differs."""
    return both.agg(
        F.count_if(F.col("a") < F.col("b")).alias("smaller"),
        F.count_if(F.col("a") > F.col("b")).alias("larger"),
        F.count_if(F.col("a") == F.col("b")).alias("equal"),
        F.min(F.when(F.col("a") != F.col("b"), F.col("idx"))).alias("first_diff"),
    )


def hash_uniform(id_col: str, seed: int) -> Column:
    """A number in [0, 1) from an id, by arithmetic that any SQL engine repeats."""
    k = (F.col(id_col) * 7919 + seed * 104729 + 12345) % 1000003
    return ((k * 48271) % 2147483647 % 1000000) / F.lit(1000000.0)


def scale(edges: DataFrame, factor: float) -> DataFrame:
    return edges.withColumn("weight", F.floor(F.col("weight") * F.lit(factor)).cast("long"))


def slow_down(edges: DataFrame, dist: str, time: str, fast_kmh: int, slow_kmh: int, p: float, seed: int) -> DataFrame:
    """Fake traffic: edges faster than `fast_kmh` are slowed to `slow_kmh` with probability p."""
    speed = F.col(dist) * 3600 / F.col(time)
    hit = (speed > fast_kmh) & (hash_uniform("edge_id", seed) < p)
    return edges.withColumn(time, F.when(hit, F.floor(F.col(dist) * 3600 / F.lit(slow_kmh)).cast("long")).otherwise(F.col(time)))


def speed_scaled(edges: DataFrame, dist: str, time: str, p_min: float, p_max: float, v_min: float, v_max: float, factor: float, seed: int) -> DataFrame:
    """Weights times `factor` with a probability that grows with the (clamped) speed."""
    speed = F.col(dist) * 3600 / F.col(time)
    alpha = (F.least(F.greatest(speed, F.lit(v_min)), F.lit(v_max)) - v_min) / (v_max - v_min)
    hit = hash_uniform("edge_id", seed) < p_min + alpha * (p_max - p_min)
    return edges.withColumn(time, F.when(hit, F.floor(F.col(time) * F.lit(factor)).cast("long")).otherwise(F.col(time)))


def fastest(edges: DataFrame, k: int) -> DataFrame:
    """The k fastest edges (ties: smaller id); a top-k report."""
    return edges.withColumn("speed", F.floor(36 * F.col("dist_m") * 1000 / F.col("ff_time")).cast("long")).orderBy(F.desc("speed"), "edge_id").limit(k).select("edge_id", "speed")


def slow_some(edges: DataFrame, k: int, n: int, factor: int, seed: int) -> DataFrame:
    """edge_id, ff_time: of the k fastest edges n, drawn by a hash, take `factor` times as long."""
    from .workload import draw

    chosen = fastest(edges, k).orderBy(draw(F.col("edge_id"), seed, 1_000_003), "edge_id").limit(n).select("edge_id", F.lit(True).alias("hit"))
    return edges.join(F.broadcast(chosen), "edge_id", "left").select("edge_id", F.when(F.col("hit"), F.col("ff_time") * factor).otherwise(F.col("ff_time")).alias("ff_time"))


def nearest(points: DataFrame, nodes: DataFrame, cell: int) -> DataFrame:
    """point_id, node_id, d2 of `_nearest_place`, by the points' places; a point without a place has no nearest node."""
    places = points.select("x", "y").where("x is not null and y is not null").distinct()
    found = _nearest_place(cut(places.withColumn("point_id", F.struct("x", "y"))), nodes, cell)
    return points.join(found.select("point_id.x", "point_id.y", "node_id", "d2"), ["x", "y"], "left").select("point_id", "node_id", "d2")


def _nearest_place(points: DataFrame, nodes: DataFrame, cell: int) -> DataFrame:
    """point_id, node_id, d2: the nearest node by squared distance (ties: smaller node).

    Points of one place have one answer, so each place is looked for once. Nodes are dealt into square cells; a place looks into rings of cells around its own, one ring further
    each round, until no cell further out can be nearer. No side is crossed with the other."""
    celled = nodes.select("node_id", F.col("x").alias("nx"), F.col("y").alias("ny"), F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
    left = points.select("point_id", "x", "y", F.floor(F.col("x") / cell).alias("px"), F.floor(F.col("y") / cell).alias("py")).withColumn("best", F.lit(None).cast("struct<d2:bigint,node_id:bigint>"))
    reach = nodes.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    span = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    done, ring = None, 0
    if reach[0] is None or span[0] is None:
        return left.select("point_id", F.lit(None).cast("long").alias("node_id"), F.lit(None).cast("long").alias("d2"))
    rings = max(max(reach[1], span[1]) - min(reach[0], span[0]), max(reach[3], span[3]) - min(reach[2], span[2])) // cell + 2
    while ring <= rings:
        cells = [(dx, dy) for dx in range(-ring, ring + 1) for dy in range(-ring, ring + 1) if max(abs(dx), abs(dy)) == ring]
        offsets = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in cells]))
        look = left.withColumn("o", offsets).withColumn("cx", F.col("px") + F.col("o.dx")).withColumn("cy", F.col("py") + F.col("o.dy"))
        d2 = ((F.col("x") - F.col("nx")) * (F.col("x") - F.col("nx")) + (F.col("y") - F.col("ny")) * (F.col("y") - F.col("ny"))).cast("long")
        found = look.join(celled, ["cx", "cy"], "left").groupBy("point_id", "x", "y", "px", "py", "best").agg(F.min(F.when(F.col("node_id").isNotNull(), F.struct(d2.alias("d2"), "node_id"))).alias("new"))
        now = found.withColumn("best", F.least("best", "new")).drop("new")
        # what lies `ring` cells out or further is at least ring * cell - (cell - 1) away
        sure = F.col("best.d2") < F.lit((ring * cell + 1) ** 2) if ring else F.lit(False)
        if ring:
            sure = F.col("best.d2") <= F.lit((ring * cell) ** 2)
        now = cut(now)
        part = now.where(sure)
        done = part if done is None else done.union(part)
        left = now.where(~F.coalesce(sure, F.lit(False)))
        if not left.head(1):
            break
        ring += 1
    return done.union(left).select("point_id", "best.node_id", "best.d2")


def isin_category(mask: int) -> Column:
    return F.col("category").bitwiseAND(mask) != 0


def path_prefix(path: DataFrame, edges: DataFrame) -> DataFrame:
    """path_id, idx, node, dist: running length of node paths (path_id, idx, node) over the cheapest of
    parallel edges."""
    nxt = path.select("path_id", (F.col("idx") + 1).alias("idx"), F.col("node").alias("tail"))
    cheapest = edges.groupBy("tail", "head").agg(F.min("weight").alias("weight"))
    steps = path.join(nxt, ["path_id", "idx"], "left").join(cheapest.withColumnRenamed("head", "node"), ["tail", "node"], "left")
    run = F.sum(F.coalesce("weight", F.lit(0))).over(Window.partitionBy("path_id").orderBy("idx"))
    return steps.select("path_id", "idx", "node", run.cast("long").alias("dist"))


def filter_covered(ranges: DataFrame) -> DataFrame:
    """Ranges [a, b) that contain no other one. By a scan in order of (b, -a): a range stays if no
    earlier one starts at or after it."""
    u = ranges.select("a", "b").distinct()
    best = F.max("a").over(Window.orderBy(F.col("b"), F.desc("a")).rowsBetween(Window.unboundedPreceding, -1))
    return u.withColumn("seen", best).where("seen is null or seen < a").select("a", "b")


def cycles(path: DataFrame) -> DataFrame:
    """path_id, from_idx, to_idx of consecutive visits to one node."""
    before = F.lag("idx").over(Window.partitionBy("path_id", "node").orderBy("idx"))
    return path.select("path_id", before.alias("from_idx"), F.col("idx").alias("to_idx")).where("from_idx is not null")
