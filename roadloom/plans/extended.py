"""Queries on hierarchies, potentials, workloads, statistics and file formats."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..fixtures import view, with_sql
from ..operators import alternatives as alt
from ..operators import catchup as cu
from ..operators import ch
from ..operators import coop as c
from ..operators import graph as g
from ..operators import hierarchy as h
from ..operators import search as s
from ..operators import sweep as sw
from ..operators import ttf as t
from ..operators import workload as w
from ..operators.ordered import number_rows
from ..session import cut
from ..sources import files
from .cooperative import CELLS, DRAW, KEYS, NET, USED, keys, net, usage_buckets
from .static import ARCS_G, OD, PAIRS, od_all, sssp
from .structure import CCH, CELL, below, built, cch_sql, cells, completed, customized, rank_od, ranked, weights
from .timed import EA, LINE, SEG

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


# --- hierarchies ------------------------------------------------------------------------------------


def by_ranks(spark, d):
    return rank_od(spark, d, od_all(spark, d)).select("query_id", F.col("s").alias("src"), F.col("t").alias("dst"))


def bounds(spark, d):
    """The completion customized under lower and upper bounds of the functions."""
    return built(spark, d, "bounds", lambda: cu.bound_weights(completed(spark, d), ranked(spark, d), view(spark, d, "ttf"), cells(spark, d)))


def with_ends(spark, d, found):
    return od_all(spark, d).select("query_id", "src", "dst").join(found, "query_id")


def contraction(spark, d):
    return built(spark, d, "contraction", lambda: cut(ch.contract(ranked(spark, d), h.respecting(completed(spark, d), ranked(spark, d)), cells(spark, d))))


@query("ch_edges")
def ch_edges(spark, d):
    return contraction(spark, d)


@query("ch_query", PAIRS)
def ch_query(spark, d):
    return with_ends(spark, d, ch.query(contraction(spark, d), by_ranks(spark, d)).drop("path"))


PATH_LENGTH = sssp(ARCS_G, f"select distinct src as q, src as v, 0::bigint as d from ({OD})", f"select query_id, d as length from ({OD}) o join sp on q = src and v = dst")


def path_length(spark, d, found):
    """The length of paths over ranks, edge by edge: that of a shortest way, if they are unpacked right."""
    edges = ranked(spark, d).groupBy("tail", "head").agg(F.min("weight").alias("weight"))
    steps = found.select("query_id", F.posexplode("path").alias("idx", "tail")).withColumn("head", F.lead("tail").over(Window.partitionBy("query_id").orderBy("idx")))
    return steps.where("head is not null").join(edges, ["tail", "head"], "left").groupBy("query_id").agg(F.when(F.count_if(F.col("weight").isNull()) == 0, F.sum("weight")).alias("length"))


@query("ch_unpacked_paths", PATH_LENGTH)
def ch_unpacked_paths(spark, d):
    return path_length(spark, d, ch.query(contraction(spark, d), by_ranks(spark, d)))


OVERLAY = sssp(
    "select a.rank as tail, b.rank as head, weight from g_grid join grid_order a on a.node_id = tail join grid_order b on b.node_id = head",
    "select rank as q, rank as v, 0::bigint as d from grid_order where rank >= (select count(*) from grid_order) - 20",
    "select q as tail, v as head, d as dist from sp where v >= (select count(*) from grid_order) - 20",
)


@query("ch_overlay", OVERLAY)
def ch_overlay(spark, d):
    """Distances among the 20 highest ranks in the overlay that partial contraction leaves: those of the network."""
    n = view(spark, d, "grid_order").count()
    left = cut(ch.overlay(ranked(spark, d), n - 20, customized(spark, d)))
    top = view(spark, d, "grid_order").where(F.col("rank") >= n - 20).select(F.col("rank").alias("node"))
    return s.one_to_all(left, top).select(F.col("source").alias("tail"), F.col("node").alias("head"), "dist")


TO_ALL_TARGETS = sssp(
    "select b.rank as tail, a.rank as head, weight from g_grid join grid_order a on a.node_id = tail join grid_order b on b.node_id = head",
    f"select distinct rank as q, rank as v, 0::bigint as d from ({OD}) join grid_order on node_id = dst ",
    "select q as dst, v as node, d as pi from sp",
)


@query("ch_potentials", TO_ALL_TARGETS)
def ch_potentials(spark, d):
    """Exact distances of all nodes to every target, from buckets on a contraction hierarchy."""
    targets = by_ranks(spark, d).select("dst").distinct()
    every = view(spark, d, "grid_order").select(F.col("rank").alias("node"))
    return ch.potentials(contraction(spark, d), every.crossJoin(F.broadcast(targets))).select("dst", "node", "pi")  # the question itself: all nodes for each target


@query("cch_potentials", TO_ALL_TARGETS)
def cch_potentials(spark, d):
    targets = by_ranks(spark, d).select(F.col("dst").alias("rank"))
    return h.cch_potentials(customized(spark, d), targets, view(spark, d, "grid_order"))


@query("cch_elimination_query", PAIRS)
def cch_elimination_query(spark, d):
    return with_ends(spark, d, h.etree_query(customized(spark, d), by_ranks(spark, d)))


@query("cch_unpacked_paths", PATH_LENGTH)
def cch_unpacked_paths(spark, d):
    return path_length(spark, d, h.etree_query(weights(spark, d), by_ranks(spark, d), with_path=True))


@query("cch_perfect_query", PAIRS)
def cch_perfect_query(spark, d):
    """On the hierarchy without the weights that perfect customization shows to be needless."""
    before, perfect = customized(spark, d), weights(spark, d, True)
    slim = h.without_dominated(before, perfect)
    ends = rank_od(spark, d, od_all(spark, d))
    label = h.labels(cut(slim), ends.select(F.col("s").alias("rank")).union(ends.select("t")))
    return with_ends(spark, d, h.label_query(cut(label), by_ranks(spark, d)))


W = CCH | dict([below("up", "a", "b"), below("dn", "b", "a")]) | {"w": "select lo, hi, u.d as up, w.d as down from cch left join up u on u.q = lo and u.v = hi left join dn w on w.q = lo and w.v = hi"}
ARCS_UNPACKED = "select x.lo, x.hi, min(case when y.down + z.up = x.up then y.lo end) as up_mid, min(case when z.down + y.up = x.down then y.lo end) as down_mid from w x left join (w y join w z on y.lo = z.lo) on y.hi = x.lo and z.hi = x.hi group by x.lo, x.hi"


@query("cch_unpack_arcs", cch_sql(ARCS_UNPACKED, W))
def cch_unpack_arcs(spark, d):
    return h.unpack_arcs(weights(spark, d))


@query("cch_directed")
def cch_directed(spark, d):
    one_way = ranked(spark, d).where("edge_id % 3 <> 0")
    return h.directed(completed(spark, d), one_way, cells(spark, d))


def tree(spark, d):
    return cut(h.full_tree(completed(spark, d), view(spark, d, "grid_order")))


@query("separator_tree", cch_sql("select rank, cell from cells", CELL))
def separator_tree(spark, d):
    return h.separator_tree(tree(spark, d))


LEVELS = CELL | {
    "up": "select distinct a.cell, b.cell as top from tree t join cells a on a.rank = t.rank join cells b on b.rank = t.parent where a.cell <> b.cell",
    "l(cell, level)": "select cell, 0::bigint from cells where cell not in (select cell from up) group by cell union all select up.cell, level + 1 from l join up on up.top = l.cell",
}


@query("separator_levels", cch_sql("select level, count(distinct cell) as cells, count(*) as nodes from l join cells using (cell) group by level", LEVELS))
def separator_levels(spark, d):
    return h.separator_levels(tree(spark, d))


@query("reordered_breadth")
def reordered_breadth(spark, d):
    return h.reordered(tree(spark, d), "breadth")


@query("reordered_size")
def reordered_size(spark, d):
    return h.reordered(tree(spark, d), "size")


@query("cch_levels", cch_sql("select rank, max(level) as level from h group by rank", CELL | {"h(rank, level)": "select rank, 0::bigint from tree union select t.parent, level + 1 from h join tree t on t.rank = h.rank where t.parent is not null"}))
def cch_levels(spark, d):
    return h.tree_levels(tree(spark, d))


CORE = "select v from (select tail as v, head as o from g_grid union select head, tail from g_grid) where v <> o group by v having count(*) > 2"


@query("topological_core", sssp(ARCS_G, f"select distinct src as q, src as v, 0::bigint as d from od where src in ({CORE})", f"select q as source, v as node, d as dist from sp where v in ({CORE})"))
def topological_core(spark, d):
    """Distances from the workload's sources that lie in the core to all of its nodes, on the core alone."""
    left = cut(ch.topological_core(view(spark, d, "g_grid")))
    nodes = left.select(F.col("tail").alias("node")).union(left.select("head")).distinct()
    return s.one_to_all(left, nodes.join(view(spark, d, "od").select(F.col("src").alias("node")).distinct(), "node", "left_semi"))


WIDEST = ("sp(q, v, d) using key (q, v)", """select 0::bigint as q, 0::bigint as v, 1000000000::bigint as d union
    select f.q, e.head, max(least(f.d, e.weight)) from sp f join g_trans e on e.tail = f.v left join recurring.sp r on r.q = f.q and r.v = e.head
    where r.d is null or least(f.d, e.weight) > r.d group by f.q, e.head""")


@query("widest_paths", with_sql("select v as node, d as width from sp", extra=dict([WIDEST]), recursive=True))
def widest_paths(spark, d):
    """The largest smallest weight on a way from part 0: another label algebra than sums and minima."""
    seeds = spark.createDataFrame([(0, 0, 1_000_000_000)], "q long, node long, label long")
    found = s.label_search(view(spark, d, "g_trans"), seeds, lambda label, edge: F.least(label, edge("weight")), F.max, lambda a, b: a > b)
    return found.select("node", F.col("label").alias("width"))


UPDATED = ARCS_G.replace("g_grid", "(select tail, head, case when u.edge_id is null then weight else weight + 7000 end as weight from g_grid left join (select edge_id from g_grid where edge_id % 5 = 0) u using (edge_id))")


@query("metric_swap", sssp(UPDATED, f"select distinct src as q, src as v, 0::bigint as d from ({OD})", f"select query_id, src, dst, d as dist from ({OD}) o left join sp on q = src and v = dst"))
def metric_swap(spark, d):
    """A new metric on the same completion: only weights are customized anew."""
    from ..streaming import traces as tr

    edges = ranked(spark, d)
    updates = edges.where("edge_id % 5 = 0").select("edge_id", F.lit(1).alias("version"), (F.col("weight") + 7000).alias("weight"))
    changed = edges.drop("weight").join(tr.apply_updates(edges.select("edge_id", "weight"), updates), "edge_id")
    anew = cut(h.customized_cells(h.respecting(completed(spark, d), changed), cells(spark, d)))
    return with_ends(spark, d, h.etree_query(anew, by_ranks(spark, d)))


@query("disconnected_targets", sssp("select tail, head, weight from g_trans", f"select distinct src as q, src as v, 0::bigint as d from ({OD})", f"select query_id from ({OD}) o left join sp on q = src and v = dst where d is null"))
def disconnected_targets(spark, d):
    return s.unreachable(view(spark, d, "g_trans"), od_all(spark, d))


@query("astar_cch", PAIRS)
def astar_cch(spark, d):
    """A* between ranks with distances from the hierarchy as potential."""
    od = by_ranks(spark, d)
    pi, dealt = sw.potentials(customized(spark, d), od.select(F.col("dst").alias("rank")))
    return with_ends(spark, d, s.astar_batched(ranked(spark, d), od, pi, dealt, sw.FAR).select("query_id", "dist"))


@query("rank_averages", sssp(ARCS_G, f"select distinct src as q, src as v, 0::bigint as d from ({OD})", f"select bit_length(bin(r)) // 8 - 1 as rank_pow, count(*) as queries, sum(d)::bigint as total from (select o.query_id, d, (select count(*) from sp x where x.q = src and (x.d < sp.d or (x.d = sp.d and x.v <= sp.v))) as r from ({OD}) o join sp on q = src and v = dst) group by 1"))
def rank_averages(spark, d):
    """Queries by the power of two of their target's rank, and the sum of their distances."""
    reached = s.one_to_all(view(spark, d, "g_grid"), od_all(spark, d).select(F.col("src").alias("node")).distinct())
    place = reached.select("source", "node", "dist", F.row_number().over(Window.partitionBy("source").orderBy("dist", "node")).alias("r"))
    hit = od_all(spark, d).join(place, (F.col("src") == F.col("source")) & (F.col("dst") == F.col("node")))
    return hit.groupBy((F.length(F.bin("r")) - 1).cast("long").alias("rank_pow")).agg(F.count(F.lit(1)).alias("queries"), F.sum("dist").alias("total"))


# --- time-dependent ---------------------------------------------------------------------------------

EARLIEST = with_sql("select query_id, d - departure as duration from o left join sp on q = query_id and v = dst", extra={"s": SEG, "o": OD, EA[0]: EA[1]}, recursive=True)


def by_ranks_at(spark, d):
    return rank_od(spark, d, od_all(spark, d)).select("query_id", F.col("s").alias("src"), F.col("t").alias("dst"), "departure")


@query("td_corridor_query", EARLIEST)
def td_corridor_query(spark, d):
    ttf = view(spark, d, "ttf")
    low, high = bounds(spark, d)
    return cu.earliest_arrival(low, high, ranked(spark, d), ttf, by_ranks_at(spark, d)).select("query_id", "duration")


@query("td_multi_metric_query", EARLIEST)
def td_multi_metric_query(spark, d):
    """Led by the tightest of four metrics that covers the trip up to its latest arrival."""
    ttf, edges, cch, od = view(spark, d, "ttf"), ranked(spark, d), completed(spark, d), cut(by_ranks_at(spark, d))
    low, high = bounds(spark, d)
    metrics = c.interval_pattern(spark, [24, 12])
    latest = cu.interval_query(low, high, od).select("query_id", "upper")
    chosen = c.tightest_metric(od.join(latest, "query_id").select("query_id", "departure", (F.col("departure") + F.coalesce("upper", F.lit(t.DAY))).alias("latest")), metrics)
    led = cu.metric_weights(cch, edges, ttf, metrics, cells(spark, d))
    return cu.earliest_arrival(low, high, edges, ttf, od, led, chosen).select("query_id", "duration")


def _bound(name: str, f: str) -> str:
    arcs = f"select tail, head, {f}(tt) as weight from g_grid join ttf using (edge_id) group by edge_id, tail, head"
    return sssp(arcs, f"select distinct src as q, src as v, 0::bigint as d from ({OD})", f"select query_id, d as {name} from ({OD}) o left join sp on q = src and v = dst")


@query("td_lower_bounds", _bound("lower", "min"))
def td_lower_bounds(spark, d):
    low, high = bounds(spark, d)
    return cu.interval_query(low, high, by_ranks(spark, d)).select("query_id", "lower")


@query("td_upper_bounds", _bound("upper", "max"))
def td_upper_bounds(spark, d):
    low, high = bounds(spark, d)
    return cu.interval_query(low, high, by_ranks(spark, d)).select("query_id", "upper")


@query("td_path_times", EARLIEST.replace("from o left join", "from o join"))
def td_path_times(spark, d):
    """Fastest paths evaluated step by step from their departure: the duration is that of the search."""
    od, edges, ttf = od_all(spark, d), view(spark, d, "g_grid"), view(spark, d, "ttf")
    found = t.earliest_arrival(edges, ttf, od).where("path is not null").select("query_id", "path").join(od.select("query_id", "departure"), "query_id")
    times = t.along_paths(edges, ttf, found)
    return times.groupBy("query_id").agg((F.max("t") - F.min("t")).alias("duration"))


@query("ttf_float", with_sql("select edge_id, idx, dep / 1000.0::double as dep, tt / 1000.0::double as tt from ttf"))
def ttf_float(spark, d):
    return files.to_seconds(view(spark, d, "ttf"))


CROP = f"select edge_id, dep, tt from ttf where dep > 25200000 and dep < 68400000 union all select edge_id, x, {LINE.format(x='x')} from s, (values (25200000::bigint), (68400000)) b(x) where dep <= x and x < dep1"


@query("ttf_crop", with_sql(CROP, extra={"s": SEG}))
def ttf_crop(spark, d):
    return t.crop(view(spark, d, "ttf"), 25_200_000, 68_400_000)


@query("ttf_append", with_sql("select edge_id, dep, tt from ttf where dep < 43200000 union all select edge_id, dep, tt * 2 from ttf where dep >= 43200000"))
def ttf_append(spark, d):
    """The morning of the functions and the afternoon of functions twice as slow."""
    ttf = view(spark, d, "ttf")
    return t.append(ttf, ttf.withColumn("tt", F.col("tt") * 2), 43_200_000)


@query("ttf_turns", with_sql("select edge_id, dep, sign((dep1 - dep) * (tt2 - tt) - (tt1 - tt) * (dep2 - dep))::bigint as turn from (select *, lead(dep, 1) over w as dep1, lead(tt, 1) over w as tt1, lead(dep, 2) over w as dep2, lead(tt, 2) over w as tt2 from ttf window w as (partition by edge_id order by dep)) where dep2 is not null"))
def ttf_turns(spark, d):
    """How each function bends at its points."""
    o = Window.partitionBy("edge_id").orderBy("dep")
    points = view(spark, d, "ttf").select("edge_id", "dep", "tt", *(F.lead(col, k).over(o).alias(f"{col}{k}") for col in ("dep", "tt") for k in (1, 2))).where("dep2 is not null")
    return points.select("edge_id", "dep", t.turn(*map(F.col, ("dep", "tt", "dep1", "tt1", "dep2", "tt2"))).alias("turn"))


@query("ttf_crossings", with_sql("select a.edge_id, a.dep, (2000000 * abs(a.tt - b.tt) + abs((a.tt - b.tt) - (a.tt1 - b.tt1))) // (2 * abs((a.tt - b.tt) - (a.tt1 - b.tt1))) as at_millionths from s a join s b on b.edge_id = a.edge_id + 1 and a.dep = b.dep where a.edge_id % 2 = 0 and (a.tt - b.tt) <> (a.tt1 - b.tt1) and sign(a.tt - b.tt) * sign(a.tt1 - b.tt1) <= 0", extra={"s": SEG}))
def ttf_crossings(spark, d):
    """Where the functions of an even edge and the next one cross, in millionths of their common segment."""
    seg = t.segments(view(spark, d, "ttf"))
    b = seg.select((F.col("edge_id") - 1).alias("edge_id"), "dep", F.col("tt").alias("ub"), F.col("tt1").alias("ub1"))
    both = seg.where("edge_id % 2 = 0").join(b, ["edge_id", "dep"])
    return both.select("edge_id", "dep", t.crossing(F.col("tt"), F.col("tt1"), F.col("ub"), F.col("ub1")).alias("at_millionths")).where("at_millionths is not null")


SWITCH = f"""select l.edge_id, (select min(t) from (select dep, dep1, floor((live_tt - way * 30000000 - tt + (tt1 - tt)::double / (dep1 - dep) * dep) / ((tt1 - tt)::double / (dep1 - dep) - way))::bigint as t
    from s, (select case when l.live_tt > now then -1 else 1 end as way from n where n.edge_id = l.edge_id) where s.edge_id = l.edge_id and dep1 > 30000000) where t >= 30000000 and t >= dep and t < dep1) as switch from live l"""


@query("live_switch_points", with_sql(SWITCH, extra={"s": SEG, "n": f"select edge_id, {LINE.format(x='30000000')} as now from s where dep <= 30000000 and 30000000 < dep1"}))
def live_switch_points(spark, d):
    return t.switch_points(view(spark, d, "ttf"), view(spark, d, "live"), 30_000_000)


@query("delay_statistics", with_sql("select round(sum(case when a < b then (b - a)::double / a end) / count(*) filter (a < b), 6) as nonconst_mean, round(sum((b - a)::double / a) / count(*), 6) as mean, round(sum(b - a) filter (a < b)::double / sum(a) filter (a < b), 6) as nonconst_total, round(sum(b - a)::double / sum(a), 6) as total from (select min(tt) as a, max(tt) as b from ttf group by edge_id)"))
def delay_statistics(spark, d):
    found = t.delay_statistics(view(spark, d, "ttf"))
    return found.select(*(F.round(x, 6).alias(x) for x in found.columns))


# --- cooperative ------------------------------------------------------------------------------------

SLOW = "select edge_id, bucket, ff_speed, greatest(round(ff_speed / (1 + (used / capacity::double) * (used / capacity::double))), 1)::bigint as kmh from used join net using (edge_id) where capacity > 0"
PROFILES = "select edge_id, bucket as start, kmh from slow union all select edge_id, start, ff_speed from (select edge_id, bucket + 900000 as start, ff_speed from slow where bucket + 900000 < 86400000 union select edge_id, 0, ff_speed from slow) f where not exists (select 1 from slow x where x.edge_id = f.edge_id and x.bucket = f.start)"
P = {"used": USED, "net": NET, "slow": SLOW, "p": PROFILES}


def profiles(spark, d):
    return c.speed_profiles(net(spark, d), usage_buckets(spark, d), 900_000)


@query("speed_profile_store", with_sql("select edge_id, start, kmh from p", extra=P))
def speed_profile_store(spark, d):
    """Profiles packed into a row for each edge, and unpacked again."""
    return files.unpack_profiles(files.pack_profiles(profiles(spark, d)))


@query("free_flow_times", with_sql("select edge_id, t, case when ff_time is null then null when k is null then ff_time else 3600 * dist_m // k end as tt from (select q.edge_id, q.t, ff_time, dist_m, (select max_by(kmh, start) from p where p.edge_id = q.edge_id and start <= q.t % 86400000) as k from (select edge_id, (edge_id * 4919003 % 200000000)::bigint as t from g_grid) q join net using (edge_id))", extra=P))
def free_flow_times(spark, d):
    at = view(spark, d, "g_grid").select("edge_id", (F.col("edge_id") * 4919003 % 200000000).alias("t"))
    return c.free_flow(net(spark, d), profiles(spark, d), at)


@query("speeds_with_history", with_sql("select e.edge_id, e.start, least((select max_by(kmh, start) from p where p.edge_id = e.edge_id and p.start <= e.start), (select max_by(kmh, start) from hist h where h.edge_id = e.edge_id and h.start <= e.start)) as kmh from (select edge_id, start from p union select edge_id, start from hist) e", extra={**P, "hist": "select edge_id, (k * 28800000)::bigint as start, (20 + (edge_id * 7 + k * 13) % 60)::bigint as kmh from g_grid, range(0, 3) r(k)"}))
def speeds_with_history(spark, d):
    past = view(spark, d, "g_grid").select("edge_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).select("edge_id", (F.col("k") * 28_800_000).cast("long").alias("start"), (20 + (F.col("edge_id") * 7 + F.col("k") * 13) % 60).alias("kmh"))
    return c.with_history(profiles(spark, d), past)


@query("usage_statistics", with_sql("select (select count(*) from net) as edges, count(distinct edge_id) as used_edges, count(*) as buckets, sum(used)::bigint as uses, max(used) as most, count(*) filter (used > capacity) as over from used join net using (edge_id)", extra={"used": USED, "net": NET}))
def usage_statistics(spark, d):
    return c.usage_statistics(net(spark, d), usage_buckets(spark, d))


def _pattern_sql(name: str) -> str:
    rows = ", ".join(f"({k}::bigint, {a * 60_000}::bigint, {b * 60_000}::bigint)" for k, (a, b) in enumerate([(0, 1440), *c.PATTERNS[name]]))
    return f'select * from (values {rows}) t(metric_id, start, "end")'


@query("interval_pattern_balanced", 'select 0::bigint as metric_id, 0::bigint as start, 86400000::bigint as "end" union all select row_number() over (order by h desc, k)::bigint, k * s * 60000, k * s * 60000 + h * 60000 from (values (480::bigint, 240::bigint, 1, 4), (240, 120, 3, 9), (120, 60, 5, 20), (30, 30, 10, 40)) t(h, s, a, b), range(0, 48) r(k) where a <= k and k < b')
def interval_pattern_balanced(spark, d):
    return c.interval_pattern(spark, "balanced")


@query("interval_pattern_complete", 'select 0::bigint as metric_id, 0::bigint as start, 86400000::bigint as "end" union all select row_number() over (order by h desc, k)::bigint, k * s * 60000, k * s * 60000 + h * 60000 from (values (480::bigint, 240::bigint, 5), (240, 120, 11), (120, 60, 23), (30, 30, 47)) t(h, s, b), range(0, 48) r(k) where k < b')
def interval_pattern_complete(spark, d):
    return c.interval_pattern(spark, "complete")


@query("interval_pattern_rush_hour", _pattern_sql("rush_hour"))
def interval_pattern_rush_hour(spark, d):
    return c.interval_pattern(spark, "rush_hour")


@query("static_vs_cooperative")
def static_vs_cooperative(spark, d):
    """Mean realised times of trips that all see the free network, and of trips that see those before them."""
    od = view(spark, d, "od")
    modes = [("static", od.count() + 1), ("cooperative", 1)]
    runs = [c.cooperative(net(spark, d), od, 900_000, batch=n).agg(F.count("duration").alias("answered"), F.avg("realised").alias("mean")).select(F.lit(name).alias("mode"), "answered", "mean") for name, n in modes]
    return runs[0].union(runs[1])


# --- workloads --------------------------------------------------------------------------------------

BIG = "(select count(*) from grid_nodes)"


@query("departures_normal", f"select i as query_id, greatest(floor(43200 + 7200 * sqrt(-2 * ln(({DRAW.format(k='i', s=3, n=999983)} + 1) / 999984.0::double)) * cos(2 * pi() * (({DRAW.format(k='i', s=4, n=999983)}) / 999983.0::double))), 0)::bigint * 1000 as departure from {KEYS}")
def departures_normal(spark, d):
    return w.departures(keys(spark, d), "normal", 3)


@query("departures_constant", f"select i as query_id, 0::bigint as departure from {KEYS}")
def departures_constant(spark, d):
    return w.departures(keys(spark, d), "constant", 0)


def starts(spark, d):
    return view(spark, d, "od").select("query_id", "src")


LEAST = f"floor(ln(({DRAW.format(k='query_id', s=20, n=999983)} + 1) / 999984.0::double) / ln(1 - 1 / 100000.0::double))::bigint"
FROM_ALL = "select distinct src as q, src as v, 0::bigint as d from od"


@query("od_geometric_trips", sssp(ARCS_G, FROM_ALL, f"select query_id, src, min(row(d, v))[2] as dst from (select query_id, src, {LEAST} as least_ from od) join sp on q = src where d > least_ group by 1, 2"))
def od_geometric_trips(spark, d):
    return w.geometric_trips(view(spark, d, "g_grid"), starts(spark, d), 100_000, 20)


@query("od_rank_trips", sssp(ARCS_G, FROM_ALL, "select query_id, src, round(log2(r))::bigint as rank_pow, v as dst from od join (select q, v, row_number() over (partition by q order by d, v) as r from sp) on q = src where r >= 8 and (r & (r - 1)) = 0"))
def od_rank_trips(spark, d):
    return w.rank_trips(view(spark, d, "g_grid"), starts(spark, d), 3)


def population(spark, d):
    nodes = view(spark, d, "grid_nodes").select("node_id", F.expr("(x div 8) * 1000 + y div 8").alias("cell"), "sz")
    return nodes.select("node_id", "cell"), nodes.groupBy("cell").agg(F.sum("sz").alias("population"))


BAND = f"""select query_id, src, n.node_id as dst from (
    select query_id, src, cell, {DRAW.format(k='query_id', s=21, n='total')} as drawn, high, population from (
      select *, sum(population) over (partition by query_id order by cell)::bigint as high, sum(population) over (partition by query_id)::bigint as total from (
        select distinct query_id, src, cell from (select query_id, src, {LEAST} as l from od) join sp on q = src join n on node_id = v where d between l * 9 // 10 and l * 11 // 10) join p using (cell))) b
    join (select cell, node_id, row_number() over (partition by cell order by node_id) - 1 as k, count(*) over (partition by cell) as size from n) n on n.cell = b.cell
    where high - population <= drawn and drawn < high and k = {DRAW.format(k='query_id', s=22, n='size')}"""


@query("od_population_band", sssp(ARCS_G, FROM_ALL, BAND, n=CELLS["n"], p=CELLS["p"]))
def od_population_band(spark, d):
    nodes, cells = population(spark, d)
    return w.population_band_trips(view(spark, d, "g_grid"), starts(spark, d), cells, nodes, 100_000, 20)


@query("od_by_type")
def od_by_type(spark, d):
    """Trips of all thirteen query types: how many, and the sums of what they are."""
    nodes, cells = population(spark, d)
    nodes, cells, edges = cut(nodes), cut(cells), cut(view(spark, d, "g_grid"))
    parts = [w.generate(name, 200, edges, nodes, cells, mean=100_000, least_rank=3).agg(F.count(F.lit(1)).alias("trips"), F.sum("src").alias("src"), F.sum("dst").alias("dst"), F.sum("departure").alias("departure")).select(F.lit(name).alias("type"), "*") for name in sorted(w.QUERY_TYPES)]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


@query("od_permutation", with_sql(f"select query_id, row_number() over (order by {DRAW.format(k='query_id', s=9, n=1000003)}, query_id) - 1 as position from od"))
def od_permutation(spark, d):
    drawn = view(spark, d, "od").select("query_id", w.draw(F.col("query_id"), 9, 1_000_003).alias("u"))
    return number_rows(drawn, ["u", "query_id"], "position").select("query_id", "position")


# --- tables and text --------------------------------------------------------------------------------


@query("permute_filtered", with_sql("select row_number() over (order by a.rank, b.rank, edge_id) - 1 as edge_id, a.rank as tail, b.rank as head, weight from g_grid join grid_order a on a.node_id = tail join grid_order b on b.node_id = head where weight < 30000"))
def permute_filtered(spark, d):
    return g.permute(view(spark, d, "g_grid"), view(spark, d, "grid_order"), F.col("weight") < 30_000)


@query("population_cells", "select x * 100000 + y as cell, x, y, sum(p)::bigint as population from (select (c_custkey % 50)::bigint as x, (c_nationkey)::bigint as y, (c_custkey % 7)::bigint as p from customer) group by x, y having sum(p) > 0")
def population_cells(spark, d):
    grid = view(spark, d, "customer").select((F.col("c_custkey") % 50).cast("long").alias("grid_x"), F.col("c_nationkey").cast("long").alias("grid_y"), (F.col("c_custkey") % 7).cast("long").alias("population"))
    return files.population_cells(grid)


@query("live_speed_times", with_sql("select edge_id, case when edge_id % 7 = 3 and (edge_id * 11) % 60 > 0 then 3600 * dist_m // ((edge_id * 11) % 60) else 0 end as live_tt from capacity"))
def live_speed_times(spark, d):
    edges = view(spark, d, "capacity")
    return files.live_times(edges, edges.where("edge_id % 7 = 3").select("edge_id", (F.col("edge_id") * 11 % 60).alias("kmh")))


@query("strip_constant", with_sql("select edge_id, idx, kmh from (select edge_id, idx, tt + 1 as kmh from ttf where idx >= 1 and idx < 4) where edge_id in (select edge_id from ttf where idx >= 1 and idx < 4 group by edge_id having min(tt) <> max(tt))"))
def strip_constant(spark, d):
    ttf = view(spark, d, "ttf")
    first, second = ttf.select("edge_id", F.lit(1).alias("version"), "idx", F.col("tt").alias("kmh")), ttf.select("edge_id", F.lit(2).alias("version"), "idx", (F.col("tt") + 1).alias("kmh"))
    return files.strip_constant(first.union(second), 1, 4)


@query("known_ids", with_sql("select count(*) as rows, count(k) as known, 100 * count(k) // count(*) as per_cent from links left join (select distinct edge_id as k from g_grid) on k = link_id"))
def known_ids(spark, d):
    return files.known_share(view(spark, d, "links"), "link_id", view(spark, d, "g_grid"), "edge_id")


@query("vector_text", with_sql("select edge_id as idx, weight as value from g_grid"))
def vector_text(spark, d):
    """Weights as lines of text and back."""
    return files.parsed_values(files.text_values(view(spark, d, "g_grid"), "edge_id", "weight"), "i64")


@query("link_table_export", with_sql("select edge_id as line, tail || ',' || head || ',' || dist_m || ',' || edge_id * 2 || ',' || (edge_id % 2) as text from capacity"))
def link_table_export(spark, d):
    edges = view(spark, d, "capacity")
    return files.link_lines(edges, edges.select("edge_id", (F.col("edge_id") * 2).alias("link_id"), (F.col("edge_id") % 2 == 1).alias("forward")))


@query("result_csv_export", with_sql("select query_id as line, query_id || ',' || src || ',' || dst || ',' || departure as text from od"))
def result_csv_export(spark, d):
    return files.csv_lines(view(spark, d, "od"), "query_id", ["query_id", "src", "dst", "departure"])


@query("tikz_export", with_sql("select edge_id as line, '\\draw (' || a.x || ',' || a.y || ') -- (' || b.x || ',' || b.y || ');' as text from g_grid join grid_nodes a on a.node_id = tail join grid_nodes b on b.node_id = head"))
def tikz_export(spark, d):
    return files.tikz_lines(view(spark, d, "g_grid"), view(spark, d, "grid_nodes"))


@query("unit_table", "select * from (values ('metres_per_kilometre', 1000::bigint), ('ms_per_day', 86400000), ('ms_per_second', 1000), ('seconds_per_hour', 3600)) t(name, value)")
def unit_table(spark, d):
    return files.unit_table(spark)


SPEED = "floor(36 * dist_m * 1000 / ff_time)"


@query("slowed_edges", with_sql(f"select edge_id, case when edge_id in (select edge_id from (select edge_id from capacity order by {SPEED} desc, edge_id limit 1000) order by {DRAW.format(k='edge_id', s=4, n=1000003)}, edge_id limit 100) then ff_time * 10 else ff_time end as ff_time from capacity"))
def slowed_edges(spark, d):
    return g.slow_some(view(spark, d, "capacity"), 1000, 100, 10, 4)


# --- robust routes ----------------------------------------------------------------------------------


def hop_paths(spark, d):
    paths = s.paths(view(spark, d, "g_grid").withColumn("weight", F.lit(1).cast("long")), od_all(spark, d))
    return paths.select(F.col("query_id").alias("path_id"), "idx", "node")


@query("local_optimality")
def local_optimality(spark, d):
    return alt.local_optimality(hop_paths(spark, d), view(spark, d, "g_grid"), 0.1)


@query("fixed_paths")
def fixed_paths(spark, d):
    return alt.fix_paths(hop_paths(spark, d), view(spark, d, "g_grid"), 0.1)


@query("traffic_aware_routes")
def traffic_aware_routes(spark, d):
    edges = view(spark, d, "g_grid")
    live = edges.join(view(spark, d, "live"), "edge_id", "left").select("tail", "head", F.coalesce("live_tt", "weight").alias("weight"))
    return alt.traffic_aware(edges, live, od_all(spark, d), 0.2)
