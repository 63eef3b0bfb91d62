"""Queries on static networks: transforms, identifiers, statistics, joins and shortest paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixtures import view, with_sql
from ..operators import graph as g
from ..operators import landmarks as lm
from ..operators import search as s

QUERIES: dict = {}
ORACLE: dict = {}

#: Shortest paths of (q, v) from seeds(q, v, d) over arcs(tail, head, weight).
SSSP = (
    "sp(q, v, d) using key (q, v)",
    """select q, v, d from seeds union
       select f.q, e.head, min(f.d + e.weight) from sp f join arcs e on e.tail = f.v
       left join recurring.sp r on r.q = f.q and r.v = e.head
       where r.d is null or f.d + e.weight < r.d group by f.q, e.head""",
)
OD = "select * from od where src <> dst"


def sssp(arcs: str, seeds: str, body: str, **more: str) -> str:
    return with_sql(body, extra={"arcs": arcs, "seeds": seeds, SSSP[0]: SSSP[1], **more}, recursive=True)


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def workload(name: str, sql: str, query=query):
    """Registers f(spark, d, od) over the whole workload."""

    def keep(f):
        query(name, sql)(lambda spark, d: f(spark, d, od_all(spark, d)))
        return f

    return keep


ARCS_T, ARCS_G = "select tail, head, weight from g_trans", "select tail, head, weight from g_grid"
ZERO = "select 0::bigint as q, 0::bigint as v, 0::bigint as d"


def longs(spark: SparkSession, rows, names: str) -> DataFrame:
    return spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names.split()))


def od_all(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "od").where("src <> dst")


# --- shortest paths ---------------------------------------------------------------------------------


@query("sssp_trans", sssp(ARCS_T, ZERO, "select v as node, d as dist from sp"))
def sssp_trans(spark, d):
    return s.loop(view(spark, d, "g_trans"), longs(spark, [(0, 0, 0)], "q node dist")).select("node", "dist")


@query("one_to_all_local", sssp(ARCS_G, "select v as q, v, 0::bigint as d from (values (0::bigint), (17), (101)) t(v)", "select q as source, v as node, d as dist from sp"))
def one_to_all_local(spark, d):
    return s.one_to_all(view(spark, d, "g_grid"), longs(spark, [(0,), (17,), (101,)], "node"))


PAIRS = sssp(ARCS_G, f"select distinct src as q, src as v, 0::bigint as d from ({OD})", f"select query_id, src, dst, d as dist from ({OD}) o left join sp on q = src and v = dst")


@workload("p2p_distance", PAIRS)
def p2p_distance(spark, d, od):
    return s.pairs(view(spark, d, "g_grid"), od)


@workload("bidirectional", PAIRS)
def bidirectional(spark, d, od):
    return s.bidirectional(view(spark, d, "g_grid"), od)


T_PAIRS = sssp(ARCS_T, f"select distinct src as q, src as v, 0::bigint as d from ({OD})", f"select query_id, src, dst, d as dist from ({OD}) o left join sp on q = src and v = dst")


@workload("astar_zero", T_PAIRS)
def astar_zero(spark, d, od):
    return s.astar(view(spark, d, "g_trans"), od).drop("settled")


@workload("bidirectional_alternating", PAIRS)
def bidirectional_alternating(spark, d, od):
    return s.bidirectional(view(spark, d, "g_grid"), od, "alternating")


@workload("astar_exact_potential", T_PAIRS)
def astar_exact_potential(spark, d, od):
    return s.astar_exact(view(spark, d, "g_trans"), od).drop("settled")


@query("multi_source", sssp(ARCS_T, "select * from (values (0::bigint, 0::bigint, 0::bigint), (0, 5, 3), (0, 9, 1)) t(q, v, d)", "select v as node, d as dist from sp"))
def multi_source(spark, d):
    return s.loop(view(spark, d, "g_trans"), longs(spark, [(0, 0, 0), (0, 5, 3), (0, 9, 1)], "q node dist")).select("node", "dist")


@query("capped_search", sssp(ARCS_T, ZERO, "select v as node, d as dist from sp where d <= 20"))
def capped_search(spark, d):
    return s.loop(view(spark, d, "g_trans"), longs(spark, [(0, 0, 0)], "q node dist"), cap=20).select("node", "dist")


@query("edge_filtered_search", sssp("select tail, head, weight from g_trans where (tail + head) % 5 <> 0", ZERO, "select v as node, d as dist from sp"))
def edge_filtered_search(spark, d):
    return s.loop(view(spark, d, "g_trans").where("(tail + head) % 5 <> 0"), longs(spark, [(0, 0, 0)], "q node dist")).select("node", "dist")


@workload(
    "shortest_path_nodes",
    sssp(
        ARCS_G,
        f"select distinct src as q, src as v, 0::bigint as d from ({OD})",
        "select query_id, row_number() over (partition by query_id order by dist) - 1 as idx, node, dist from walk",
        tight="select b.q, b.v, min(e.tail) as pred from sp a join arcs e on e.tail = a.v join sp b on b.q = a.q and b.v = e.head and b.d = a.d + e.weight group by b.q, b.v",
        **{"walk(query_id, q, node, dist)": f"select query_id, src, dst, d from ({OD}) o join sp on q = src and v = dst union all select w.query_id, w.q, t.pred, p.d from walk w join tight t on t.q = w.q and t.v = w.node join sp p on p.q = w.q and p.v = t.pred"},
    ),
)
def shortest_path_nodes(spark, d, od):
    return s.paths(view(spark, d, "g_grid"), od)


@query("reachability", sssp("select tail, head, 0::bigint as weight from g_trans", ZERO, "select v as node from sp"))
def reachability(spark, d):
    return s.reachable(view(spark, d, "g_trans"), longs(spark, [(0,)], "node"))


@query(
    "strong_component",
    sssp(
        "select tail, head, 0::bigint as weight from g_trans",
        ZERO,
        "select v as node from sp where v in (select v from back)",
        **{"back(v, d) using key (v)": "select 0::bigint as v, 0::bigint as d union select e.tail, 0::bigint from back f join arcs e on e.head = f.v left join recurring.back r on r.v = e.tail where r.d is null group by e.tail"},
    ),
)
def strong_component(spark, d):
    return s.components_strong(view(spark, d, "g_trans"), 0)


@query("dijkstra_rank", sssp(ARCS_T, ZERO, "select node, dist, rank from (select v as node, d as dist, row_number() over (order by d, v) as rank from sp) where (rank & (rank - 1)) = 0"))
def dijkstra_rank(spark, d):
    return s.dijkstra_ranks(view(spark, d, "g_trans"), 0)


@query(
    "alt_potential",
    sssp(
        ARCS_T,
        "select * from (values (0::bigint, 0::bigint, 0::bigint), (3, 3, 0), (11, 11, 0)) t(q, v, d)",
        "select a.v as node, max(greatest(b.d - a.d, 0))::bigint as pi from sp a join sp b on a.q = b.q and b.v = 7 group by a.v",
    ),
)
def alt_potential(spark, d):
    """Landmark bounds towards node 7: distances from a landmark to the target less those to the node."""
    from_landmarks = s.one_to_all(view(spark, d, "g_trans"), longs(spark, [(0,), (3,), (11,)], "node"))
    target = from_landmarks.where("node = 7").select("source", F.col("dist").alias("t"))
    return from_landmarks.join(F.broadcast(target), "source").groupBy("node").agg(F.max(F.greatest(F.col("t") - F.col("dist"), F.lit(0))).cast("long").alias("pi"))


@query("farthest_landmarks")
def farthest_landmarks(spark, d):
    """Four landmarks: node 0, then again and again the node farthest from those chosen (ties: smaller)."""
    edges, chosen = view(spark, d, "g_grid"), [0]
    while len(chosen) < 4:
        reached = s.one_to_all(edges, longs(spark, [(c,) for c in chosen], "node")).groupBy("node").agg(F.min("dist").alias("dist"))
        chosen.append(reached.agg(F.max_by("node", F.struct("dist", (-F.col("node")).alias("k"))).alias("node")).first()["node"])
    return longs(spark, list(enumerate(chosen)), "idx node")


@query("avoid_landmarks")
def avoid_landmarks(spark, d):
    """Four landmarks, each in the part of a shortest-path tree that those before it bound worst."""
    return lm.avoid_landmarks(view(spark, d, "g_grid"), 4)


@query("avoid_bounds")
def avoid_bounds(spark, d):
    """Bounds of the workload's distances by two such landmarks."""
    edges = view(spark, d, "g_grid")
    return lm.bounds(lm.distances(edges, lm.avoid_landmarks(edges, 2).select("node")), od_all(spark, d))


MANY = "select distinct src as q, src as v, 0::bigint as d from od"


@query("many_to_many", sssp(ARCS_G, MANY, "select q as src, v as dst, d as dist from sp where v in (select dst from od)"))
def many_to_many(spark, d):
    return many_to_many_of(spark, d, view(spark, d, "od"))


def many_to_many_of(spark, d, od):
    reached = s.one_to_all(view(spark, d, "g_grid"), od.select(F.col("src").alias("node")).distinct())
    return reached.join(od.select(F.col("dst").alias("node")).distinct(), "node", "left_semi").select(F.col("source").alias("src"), F.col("node").alias("dst"), "dist")


@workload(
    "penalty_metrics_base",
    sssp(ARCS_G, f"select distinct src as q, src as v, 0::bigint as d from ({OD})", f"select query_id, (d * 125 // 100)::bigint as accept, (d // 100)::bigint as rejoin from ({OD}) o join sp on q = src and v = dst"),
)
def penalty_metrics_base(spark, d, od):
    """What an alternative may cost at most, and the penalty for rejoining the base path."""
    base = s.pairs(view(spark, d, "g_grid"), od).where("dist is not null")
    return base.select("query_id", F.expr("dist * 125 div 100").alias("accept"), F.expr("dist div 100").alias("rejoin"))


# --- transforms -------------------------------------------------------------------------------------


@query("csr_offsets", with_sql("select node_id, coalesce(sum(n) over (order by node_id rows between unbounded preceding and 1 preceding), 0)::bigint as first_out from (select node_id, (select count(*) from g_grid where tail = node_id) as n from grid_nodes)"))
def csr_offsets(spark, d):
    return g.csr_offsets(view(spark, d, "g_grid"), view(spark, d, "grid_nodes"))


@query("edge_tails", with_sql("select edge_id, tail from g_grid"))
def edge_tails(spark, d):
    edges = view(spark, d, "g_grid")
    return g.tails_from_offsets(g.csr_offsets(edges, view(spark, d, "grid_nodes")), edges)


@query("reverse", with_sql("select row_number() over (order by head, edge_id) - 1 as edge_id, head as tail, tail as head, weight, edge_id as original from g_grid"))
def reverse(spark, d):
    return g.reverse(view(spark, d, "g_grid"))


PERMUTED = "select row_number() over (order by a.rank, b.rank, edge_id) - 1 as edge_id, a.rank as tail, b.rank as head, weight from g_grid join grid_order a on a.node_id = tail join grid_order b on b.node_id = head"


@query("permute", with_sql(PERMUTED))
def permute(spark, d):
    return g.permute(view(spark, d, "g_grid"), view(spark, d, "grid_order"))


@query("rank_split", with_sql(f"select case when tail < head then 'up' else 'down' end as dir, least(tail, head) as low, greatest(tail, head) as high, weight from ({PERMUTED})"))
def rank_split(spark, d):
    return g.rank_split(view(spark, d, "g_grid"), view(spark, d, "grid_order"))


@query("invert_order", with_sql("select rank as position, node_id from grid_order"))
def invert_order(spark, d):
    return view(spark, d, "grid_order").select(F.col("rank").alias("position"), "node_id")


@query("permute_node_data", with_sql("select rank, x, y from grid_nodes join grid_order using (node_id)"))
def permute_node_data(spark, d):
    return view(spark, d, "grid_nodes").join(view(spark, d, "grid_order"), "node_id").select("rank", "x", "y")


@query("line_graph", with_sql("select a.edge_id as tail, b.edge_id as head, a.weight from g_grid a join g_grid b on a.head = b.tail where not exists (select 1 from forbidden_turns f where f.from_edge = a.edge_id and f.to_edge = b.edge_id)"))
def line_graph(spark, d):
    return g.line_graph(view(spark, d, "g_grid"), view(spark, d, "forbidden_turns"))


@query("line_graph_turn_costs", with_sql("select a.edge_id as tail, b.edge_id as head, a.weight + case when b.head = a.tail then 60000 else 500 end as weight from g_grid a join g_grid b on a.head = b.tail"))
def line_graph_turn_costs(spark, d):
    return g.line_graph(view(spark, d, "g_grid"), None, F.when(F.col("b_head") == F.col("a_tail"), 60000).otherwise(500))


@query("no_uturns", with_sql("select a.edge_id as from_edge, b.edge_id as to_edge from g_grid a join g_grid b on a.head = b.tail where a.tail <> b.head"))
def no_uturns(spark, d):
    return g.no_uturns(view(spark, d, "g_grid"))


IN_BOX = "select node_id, row_number() over (order by node_id) - 1 as l from grid_nodes where x between 3 and 20 and y between 2 and 15"


@query("box_subgraph", with_sql("select a.l as tail, b.l as head, weight from g_grid join inside a on a.node_id = tail join inside b on b.node_id = head", extra={"inside": IN_BOX}))
def box_subgraph(spark, d):
    return g.box(view(spark, d, "grid_nodes"), view(spark, d, "g_grid"), 3, 2, 20, 15)


CATEGORY = "select edge_id, weight, (edge_id % 8)::int as category from g_grid"


@query("category_block", with_sql("select edge_id, case when (category & 3) <> 0 then null else weight end as weight from c", extra={"c": CATEGORY}))
def category_block(spark, d):
    edges = view(spark, d, "g_grid").withColumn("category", (F.col("edge_id") % 8).cast("int"))
    return edges.select("edge_id", F.when(~g.isin_category(3), F.col("weight")).alias("weight"))


@query("drop_blocked", with_sql("select edge_id, weight from c where (category & 3) = 0", extra={"c": CATEGORY}))
def drop_blocked(spark, d):
    return category_block(spark, d).where("weight is not null")


@query("scale_weights", with_sql("select edge_id, floor(weight * 1.05::double)::bigint as weight from g_grid"))
def scale_weights(spark, d):
    return g.scale(view(spark, d, "g_grid"), 1.05).select("edge_id", "weight")


UNIFORM = "(((edge_id * 7919 + {seed} * 104729 + 12345) % 1000003 * 48271) % 2147483647 % 1000000) / 1000000.0::double"


@query("fake_traffic", with_sql(f"select edge_id, case when dist_m * 3600 / ff_time::double > 300 and {UNIFORM.format(seed=3)} < 0.2 then floor(dist_m * 3600 / 50.0::double)::bigint else ff_time end as ff_time from capacity"))
def fake_traffic(spark, d):
    return g.slow_down(view(spark, d, "capacity"), "dist_m", "ff_time", 300, 50, 0.2, 3).select("edge_id", "ff_time")


@query(
    "speed_weighted_scaling",
    with_sql(f"select edge_id, case when {UNIFORM.format(seed=4)} < 0.1::double + (least(greatest(dist_m * 3600 / ff_time::double, 100.0::double), 400.0::double) - 100.0::double) / 300.0::double * 0.4::double then floor(ff_time * 1.5::double)::bigint else ff_time end as ff_time from capacity"),
)
def speed_weighted_scaling(spark, d):
    return g.speed_scaled(view(spark, d, "capacity"), "dist_m", "ff_time", 0.1, 0.5, 100.0, 400.0, 1.5, 4).select("edge_id", "ff_time")


@query("fastest_edges", with_sql("select edge_id, floor(36 * dist_m * 1000 / ff_time::double)::bigint as speed from capacity order by 2 desc, 1 limit 100"))
def fastest_edges(spark, d):
    return g.fastest(view(spark, d, "capacity"), 100)


@query("apply_live", with_sql("select edge_id, greatest(weight, coalesce(live_tt, 0)) as weight from g_grid left join live using (edge_id)"))
def apply_live(spark, d):
    both = view(spark, d, "g_grid").join(view(spark, d, "live"), "edge_id", "left")
    return both.select("edge_id", F.greatest("weight", F.coalesce("live_tt", F.lit(0))).alias("weight"))


@query("live_above_lower_bound", with_sql("select edge_id, live_tt from live join (select edge_id, min(tt) as lb from ttf group by edge_id) using (edge_id) where live_tt >= lb"))
def live_above_lower_bound(spark, d):
    lower = view(spark, d, "ttf").groupBy("edge_id").agg(F.min("tt").alias("lb"))
    return view(spark, d, "live").join(lower, "edge_id").where("live_tt >= lb").select("edge_id", "live_tt")


@query("clamp_weights", with_sql("select edge_id, greatest(weight - 20000, 1) as weight, coalesce(nullif(live_tt % 5, 0), weight) as live from g_grid left join live using (edge_id)"))
def clamp_weights(spark, d):
    both = view(spark, d, "g_grid").join(view(spark, d, "live"), "edge_id", "left")
    return both.select("edge_id", F.greatest(F.col("weight") - 20000, F.lit(1)).cast("long").alias("weight"), F.coalesce(F.nullif(F.col("live_tt") % 5, F.lit(0)), "weight").cast("long").alias("live"))


EARTH = "6371000.785::double"
CHORD = f"floor({EARTH} * sqrt(pow(cos(radians(lat1)) * cos(radians(lon1)) - cos(radians(lat2)) * cos(radians(lon2)), 2) + pow(cos(radians(lat1)) * sin(radians(lon1)) - cos(radians(lat2)) * sin(radians(lon2)), 2) + pow(sin(radians(lat1)) - sin(radians(lat2)), 2)))::bigint"


@query("geo_length", with_sql(f"select edge_id, {CHORD} as length_m from (select edge_id, 48 + a.y * 0.01::double as lat1, 8 + a.x * 0.01::double as lon1, 48 + b.y * 0.01::double as lat2, 8 + b.x * 0.01::double as lon2 from g_grid join grid_nodes a on a.node_id = tail join grid_nodes b on b.node_id = head)"))
def geo_length(spark, d):
    """Straight distance through the earth between the ends of an edge, in whole metres."""
    at = lambda end: view(spark, d, "grid_nodes").select(F.col("node_id").alias(end), F.radians(48 + F.col("y") * 0.01).alias(f"{end}_lat"), F.radians(8 + F.col("x") * 0.01).alias(f"{end}_lon"))
    e = view(spark, d, "g_grid").join(at("tail"), "tail").join(at("head"), "head")
    xyz = lambda end: (F.cos(f"{end}_lat") * F.cos(f"{end}_lon"), F.cos(f"{end}_lat") * F.sin(f"{end}_lon"), F.sin(f"{end}_lat"))
    squares = sum((F.pow(a - b, F.lit(2)) for a, b in zip(xyz("tail"), xyz("head"))), F.lit(0.0))
    return e.select("edge_id", F.floor(F.lit(6371000.785) * F.sqrt(squares)).cast("long").alias("length_m"))


@query("valid_edges", with_sql("select edge_id from capacity where ff_time < 86400000 and capacity_per_h > 10 and ff_time <= 3600 * 10 and dist_m <= 20000"))
def valid_edges(spark, d):
    return view(spark, d, "capacity").where("ff_time < 86400000 and capacity_per_h > 10 and ff_time <= 36000 and dist_m <= 20000").select("edge_id")


@query("unit_conversion", with_sql("select edge_id, 3600 * dist_m // (10 + edge_id % 100) as tt_ms, dist_m * 36 // greatest(ff_time // 1000 * 10, 1) as kmh from capacity"))
def unit_conversion(spark, d):
    return view(spark, d, "capacity").selectExpr("edge_id", "3600 * dist_m div (10 + edge_id % 100) as tt_ms", "dist_m * 36 div greatest(ff_time div 1000 * 10, 1) as kmh")


# --- identifiers, joins, aggregations ----------------------------------------------------------------


@query("dense_ids", with_sql("select v as global_id, row_number() over (order by v) - 1 as local_id from (select distinct o_custkey::bigint as v from orders)"))
def dense_ids(spark, d):
    return g.dense_ids(view(spark, d, "orders").select(F.col("o_custkey").cast("long").alias("v")), "v")


@query("next_lower_id", with_sql("select c_custkey::bigint as key, (select max(local_id) from (select v, row_number() over (order by v) - 1 as local_id from (select distinct o_custkey::bigint as v from orders)) where v <= c_custkey) as local_id from customer"))
def next_lower_id(spark, d):
    return g.next_lower(dense_ids(spark, d), view(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("key")))


@query("node_degree", with_sql("select node_id, count(edge_id) as out_degree from grid_nodes left join g_grid on tail = node_id group by node_id"))
def node_degree(spark, d):
    return view(spark, d, "grid_nodes").join(view(spark, d, "g_grid"), F.col("tail") == F.col("node_id"), "left").groupBy("node_id").agg(F.count("edge_id").alias("out_degree"))


@query("symmetric_degree", with_sql("select n as node_id, count(distinct o) as degree from (select tail as n, head as o from g_trans union all select head, tail from g_trans) where n <> o group by n"))
def symmetric_degree(spark, d):
    return g.symmetric_degree(view(spark, d, "g_trans"))


MULTI = "select tail % 50 as tail, head % 50 as head, weight, edge_id, capacity_per_h, ff_time, dist_m from capacity join g_grid using (edge_id, tail, head)"


def multi(spark, d):
    both = view(spark, d, "capacity").join(view(spark, d, "g_grid"), ["edge_id", "tail", "head"])
    return both.withColumn("tail", F.col("tail") % 50).withColumn("head", F.col("head") % 50)


@query("unify_parallel", with_sql("select edge_id, min(weight) over (partition by tail, head) as weight from m", extra={"m": MULTI}))
def unify_parallel(spark, d):
    return g.unify_parallel(multi(spark, d)).select("edge_id", "weight")


@query("collapse_multi", with_sql("select tail, head, sum(capacity_per_h)::bigint as capacity_per_h, min(ff_time) as ff_time, min(row(ff_time, dist_m))[2] as dist_m from m group by tail, head", extra={"m": MULTI}))
def collapse_multi(spark, d):
    return g.collapse_multi(multi(spark, d))


@query("speed_stats", with_sql("select min(v)::bigint as slowest, max(v)::bigint as fastest, round(avg(v), 6) as mean from (select 3600 * dist_m // ff_time as v from capacity)"))
def speed_stats(spark, d):
    return view(spark, d, "capacity").select(F.expr("3600 * dist_m div ff_time").alias("v")).agg(F.min("v").alias("slowest"), F.max("v").alias("fastest"), F.round(F.avg("v"), 6).alias("mean"))


@query("vector_compare", with_sql("select count(*) filter (a < b) as smaller, count(*) filter (a > b) as larger, count(*) filter (a = b) as equal, min(idx) filter (a <> b) as first_diff from (select edge_id as idx, weight as a, coalesce(live_tt, weight) as b from g_grid left join live using (edge_id))"))
def vector_compare(spark, d):
    both = view(spark, d, "g_grid").join(view(spark, d, "live"), "edge_id", "left")
    return g.compare_vectors(both.select(F.col("edge_id").alias("idx"), F.col("weight").alias("a"), F.coalesce("live_tt", "weight").alias("b")))


@query(
    "nearest_node",
    with_sql(
        "select point_id, min(row(dx * dx + dy * dy, node_id))[2] as node_id, min(dx * dx + dy * dy) as d2 from (select point_id, node_id, n.x * 3 - p.x as dx, n.y * 5 - p.y as dy from p cross join grid_nodes n) group by point_id",
        extra={"p": "select o_orderkey::bigint as point_id, (o_orderkey * 7919 % 200)::bigint as x, (o_orderkey * 104729 % 260)::bigint as y from orders"},
    ),
)
def nearest_node(spark, d):
    return nearest_node_of(view(spark, d, "orders"), view(spark, d, "grid_nodes"))


def nearest_node_of(orders, grid):
    points = orders.selectExpr("cast(o_orderkey as bigint) as point_id", "cast(o_orderkey * 7919L % 200 as bigint) as x", "cast(o_orderkey * 104729L % 260 as bigint) as y")
    nodes = grid.selectExpr("node_id", "x * 3 as x", "y * 5 as y")
    return g.nearest(points, nodes, 16)


@query("semi_join_active", with_sql("select edge_id from g_grid where tail in (select src from od) or head in (select dst from od)"))
def semi_join_active(spark, d):
    od = view(spark, d, "od")
    active = od.select(F.col("src").alias("node")).distinct()
    ends = od.select(F.col("dst").alias("node")).distinct()
    edges = view(spark, d, "g_grid")
    return edges.join(active, F.col("tail") == F.col("node"), "left_semi").select("edge_id").union(edges.join(ends, F.col("head") == F.col("node"), "left_semi").select("edge_id")).distinct()


@query("id_mapping", with_sql("select e.event_id::bigint as event_id, l.local_id from events e join (select v, row_number() over (order by v) - 1 as local_id from (select distinct user_id as v from events)) l on l.v = e.user_id"))
def id_mapping(spark, d):
    events = view(spark, d, "events")
    ids = g.dense_ids(events, "user_id")
    return events.join(ids, events.user_id == ids.global_id).select(F.col("event_id").cast("long").alias("event_id"), "local_id")


@query("set_algebra", with_sql("select 'union' as op, count(*) as n from (select tail from g_grid where weight < 20000 union select head from g_grid where weight > 30000) union all select 'intersect', count(*) from (select tail from g_grid where weight < 20000 intersect select head from g_grid where weight > 30000) union all select 'except', count(*) from (select tail from g_grid where weight < 20000 except select head from g_grid where weight > 30000)"))
def set_algebra(spark, d):
    edges = view(spark, d, "g_grid")
    a, b = edges.where("weight < 20000").select(F.col("tail").alias("v")), edges.where("weight > 30000").select(F.col("head").alias("v"))
    parts = [("union", a.union(b).distinct()), ("intersect", a.intersect(b)), ("except", a.subtract(b))]
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "n") for op, df in parts]
    return counts[0].union(counts[1]).union(counts[2])


WALKS = "select trip as path_id, seq as idx, link_id % 40 as node from links"


@query("path_cycles", with_sql("select path_id, p as from_idx, idx as to_idx from (select *, lag(idx) over (partition by path_id, node order by idx) as p from w) where p is not null", extra={"w": WALKS}))
def path_cycles(spark, d):
    return g.cycles(view(spark, d, "links").selectExpr("trip as path_id", "seq as idx", "link_id % 40 as node"))


@query("distinct_paths", with_sql("select count(distinct p) as variants from (select string_agg(node::varchar, ',' order by idx) as p from (select trip as path_id, seq as idx, link_id % 3 as node from links) group by path_id)"))
def distinct_paths(spark, d):
    return distinct_paths_of(view(spark, d, "links"))


def distinct_paths_of(links):
    steps = links.selectExpr("trip as path_id", "seq as idx", "link_id % 3 as node")
    whole = steps.groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("idx", "node"))).alias("p"))
    return whole.agg(F.count_distinct(F.array_join(F.col("p.node").cast("array<string>"), ",")).alias("variants"))


RANGES = "select distinct seq as a, seq + 1 + link_id % 7 as b from links"


@query("filter_covered", with_sql("select a, b from r where not exists (select 1 from r q where q.a >= r.a and q.b <= r.b and (q.a > r.a or q.b < r.b))", extra={"r": RANGES}))
def filter_covered(spark, d):
    return filter_covered_of(view(spark, d, "links"))


def filter_covered_of(links):
    return g.filter_covered(links.selectExpr("seq as a", "seq + 1 + link_id % 7 as b"))


@workload("path_prefix_dist", sssp(
    ARCS_G,
    f"select distinct src as q, src as v, 0::bigint as d from ({OD})",
    "select query_id as path_id, row_number() over (partition by query_id order by dist) - 1 as idx, node, dist from walk",
    tight="select b.q, b.v, min(e.tail) as pred from sp a join arcs e on e.tail = a.v join sp b on b.q = a.q and b.v = e.head and b.d = a.d + e.weight group by b.q, b.v",
    **{"walk(query_id, q, node, dist)": f"select query_id, src, dst, d from ({OD}) o join sp on q = src and v = dst union all select w.query_id, w.q, t.pred, p.d from walk w join tight t on t.q = w.q and t.v = w.node join sp p on p.q = w.q and p.v = t.pred"},
))
def path_prefix_dist(spark, d, od):
    edges = view(spark, d, "g_grid")
    return g.path_prefix(s.paths(edges, od).select(F.col("query_id").alias("path_id"), "idx", "node"), edges)


@query("query_stats", with_sql("select count(*) as n, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as std, min(v) as lo, round(quantile_cont(v, 0.25), 6) as q25, round(quantile_cont(v, 0.5), 6) as q50, round(quantile_cont(v, 0.75), 6) as q75, max(v) as hi from (select ff_time::double as v from capacity)"))
def query_stats(spark, d):
    v = view(spark, d, "capacity").select(F.col("ff_time").cast("double").alias("v"))
    cut = lambda p: F.round(F.percentile("v", p), 6)
    return v.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("std"), F.min("v").alias("lo"), cut(0.25).alias("q25"), cut(0.5).alias("q50"), cut(0.75).alias("q75"), F.max("v").alias("hi"))


@query("dimacs_export", with_sql("select 0::bigint as line, 'p sp ' || (select count(*) from grid_nodes) || ' ' || count(*) as text from g_grid union all select edge_id + 1, 'a ' || (tail + 1) || ' ' || (head + 1) || ' ' || weight from g_grid"))
def dimacs_export(spark, d):
    from ..sources import files

    return files.dimacs_lines(view(spark, d, "g_grid"), view(spark, d, "grid_nodes"))
