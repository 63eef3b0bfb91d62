"""Queries on travel-time functions and time-dependent networks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..fixtures import view, with_sql
from ..operators import ttf as t
from ..session import cut

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


SEG = "select edge_id, dep, tt, dep1, tt1 from (select edge_id, dep, tt, lead(dep) over w as dep1, lead(tt) over w as tt1 from ttf window w as (partition by edge_id order by dep)) where dep1 is not null"
AT = "select edge_id as key, edge_id, (edge_id * 4919003 % 200000000)::bigint as t from g_grid"
LINE = "(dep + tt) + ({x} - dep) * ((dep1 + tt1) - (dep + tt)) // (dep1 - dep) - {x}"


def at(spark, d):
    return view(spark, d, "g_grid").select(F.col("edge_id").alias("key"), "edge_id", (F.col("edge_id") * 4919003 % 200000000).alias("t"))


OPEN = "select edge_id, row_number() over (partition by edge_id order by dep) - 1 as idx, dep, tt from (select edge_id, dep, tt from ttf where idx in (1, 2, 3) union all select edge_id, {p}, (select tt from ttf o where o.edge_id = g.edge_id and idx = 3) from g_grid g)"


@query(
    "ttf_normalise",
    with_sql(
        "select edge_id, row_number() over (partition by edge_id order by dep) - 1 as idx, dep, tt from (select edge_id, dep, tt from o where edge_id not in (select edge_id from k) union all select edge_id, x.dep, (select z.tt from o z where z.edge_id = e.edge_id order by z.dep desc limit 1) from (select distinct edge_id from o where edge_id not in (select edge_id from k)) e cross join (values (0::bigint), (86400000)) x(dep) union all select edge_id, 0, tt from k)",
        extra={"o": "select edge_id, dep, tt from ttf where idx in (1, 2, 3)", "k": "select edge_id, min(tt) as tt from o group by edge_id having min(tt) = max(tt)"},
    ),
)
def ttf_normalise(spark, d):
    """Functions without their points at 0 and at the end of the day, closed again."""
    return t.normalise(view(spark, d, "ttf").where("idx in (1, 2, 3)"))


@query("ttf_eval", with_sql(f"select key, edge_id, t, {LINE.format(x='x')} as tt from (select *, t % 86400000 as x from q) join s using (edge_id) where dep <= x and x < dep1", extra={"s": SEG, "q": AT}))
def ttf_eval(spark, d):
    return t.evaluate(view(spark, d, "ttf"), at(spark, d))


@query("ttf_inverse", with_sql("select key, edge_id, t as arrival, dep + (t - dep - tt) * (dep1 - dep) // (dep1 + tt1 - dep - tt) as departure from (select key, edge_id, t % 86400000 as t from q) join s using (edge_id) where dep + tt <= t and t < dep1 + tt1", extra={"s": SEG, "q": AT}))
def ttf_inverse(spark, d):
    return t.inverse(view(spark, d, "ttf"), at(spark, d).select("key", "edge_id", (F.col("t") % t.DAY).alias("arrival")))


def average(spans, total):
    parts = " union all ".join(f"select edge_id, tt, tt1, least(dep1, {b}) - greatest(dep, {a}) as len from s where least(dep1, {b}) > greatest(dep, {a})" for a, b in spans)
    return with_sql(f"select edge_id, (sum((tt + tt1) * len)::bigint // 2 // {total}) as mean from ({parts}) group by edge_id", extra={"s": SEG})


@query("ttf_window_average", average([(25200000, 36000000)], 10800000))
def ttf_window_average(spark, d):
    return t.window_average(view(spark, d, "ttf"), 25_200_000, 36_000_000)


@query("ttf_night_average", average([(79200000, 86400000), (0, 18000000)], 25200000))
def ttf_night_average(spark, d):
    return t.window_average(view(spark, d, "ttf"), 79_200_000, 18_000_000)


@query("ttf_bounds", with_sql("select edge_id, min(tt) as lower, max(tt) as upper, count(*) as points, min(tt) = max(tt) as constant from ttf group by edge_id"))
def ttf_bounds(spark, d):
    return t.bounds(view(spark, d, "ttf"))


@query("ttf_slopes", with_sql("select edge_id, round(min((tt1 - tt) / (dep1 - dep)::double), 6) as lowest, round(max((tt1 - tt) / (dep1 - dep)::double), 6) as highest from s group by edge_id", extra={"s": SEG}))
def ttf_slopes(spark, d):
    return t.slopes(view(spark, d, "ttf"))


@query("fifo_check", with_sql("select edge_id, dep from s where dep + tt * 300 > dep1 + tt1 * 300", extra={"s": SEG}))
def fifo_check(spark, d):
    return t.fifo_violations(view(spark, d, "ttf").withColumn("tt", F.col("tt") * 300))


@query("ttf_statistics", with_sql("select count(*) as points, count(distinct edge_id) as edges, (select count(*) from (select edge_id from ttf group by edge_id having min(tt) = max(tt)))  as constants from ttf"))
def ttf_statistics(spark, d):
    return t.bounds(view(spark, d, "ttf")).agg(F.sum("points").alias("points"), F.count(F.lit(1)).alias("edges"), F.count_if("constant").alias("constants"))


@query(
    "live_eval",
    with_sql(
        f"select key, edge_id, t, case when live_tt is null then tt when t <= 40000000 then live_tt when live_tt > tt then greatest(live_tt - (t - 40000000), tt) else least(live_tt + (t - 40000000), tt) end as tt from (select key, edge_id, t, {LINE.format(x='x')} as tt from (select *, t % 86400000 as x from q) join s using (edge_id) where dep <= x and x < dep1) left join live using (edge_id)",
        extra={"s": SEG, "q": "select edge_id as key, edge_id, 39950000 + edge_id * 4919003 % 100000 as t from g_grid"},
    ),
)
def live_eval(spark, d):
    q = view(spark, d, "g_grid").select(F.col("edge_id").alias("key"), "edge_id", (39_950_000 + F.col("edge_id") * 4919003 % 100_000).alias("t"))
    return t.live_at(view(spark, d, "ttf"), view(spark, d, "live"), q, 40_000_000)


INTERVALS = [(0, 0, 10_000_000), (1, 20_000_000, 30_000_000), (2, 43_200_000, 64_800_000), (3, 70_000_000, 86_000_000)]


@query(
    "interval_minima",
    with_sql(
        f"select edge_id, interval_id, min(tt) as lowest from (select edge_id, interval_id, tt from ttf join i on dep between a and b union all select edge_id, interval_id, {LINE.format(x='x')} from s join (select interval_id, a as x from i union all select interval_id, b from i) on dep <= x and x < dep1) group by edge_id, interval_id",
        extra={"s": SEG, "i": "select * from (values " + ", ".join(f"({k}::bigint, {a}::bigint, {b}::bigint)" for k, a, b in INTERVALS) + ") v(interval_id, a, b)"},
    ),
)
def interval_minima(spark, d):
    return t.interval_minima(view(spark, d, "ttf"), spark.createDataFrame(INTERVALS, "interval_id long, start long, end long"))


@query("merge_profiles", with_sql("select coalesce(a.edge_id, b.edge_id) as edge_id, coalesce(a.dep, b.dep) as dep, least(a.tt, b.tt) as tt from (select * from ttf where idx <> 2) a full join (select edge_id, dep, tt - 500 as tt from ttf where idx <> 3) b on a.edge_id = b.edge_id and a.dep = b.dep"))
def merge_profiles(spark, d):
    ttf = view(spark, d, "ttf")
    return t.merge_profiles(ttf.where("idx <> 2"), ttf.where("idx <> 3").withColumn("tt", F.col("tt") - 500))


EA = (
    "sp(q, v, d) using key (q, v)",
    f"""select query_id as q, src as v, departure as d from o union
        select q, head, min(d + {LINE.format(x='x')}) from
        (select f.q, f.d, f.d % 86400000 as x, e.head, e.edge_id, r.d as old from sp f join g_grid e on e.tail = f.v left join recurring.sp r on r.q = f.q and r.v = e.head)
        join s using (edge_id) where dep <= x and x < dep1 group by q, head having min(d + {LINE.format(x='x')}) < coalesce(min(old), 9000000000000)""",
)


@query("td_earliest_arrival", with_sql("select query_id, d - departure as duration from o left join sp on q = query_id and v = dst", extra={"s": SEG, "o": "select * from od where src <> dst", EA[0]: EA[1]}, recursive=True))
def td_earliest_arrival(spark, d):
    return td_earliest_arrival_of(spark, d, view(spark, d, "od").where("src <> dst"))


def td_earliest_arrival_of(spark, d, od):
    return t.earliest_arrival(view(spark, d, "g_grid"), view(spark, d, "ttf"), od).select("query_id", "duration")


@query("td_path")
def td_path(spark, d):
    od = view(spark, d, "od").where("src <> dst")
    return t.earliest_arrival(view(spark, d, "g_grid"), view(spark, d, "ttf"), od).select("query_id", F.posexplode("path").alias("idx", "node"))


@query("td_sampled_corridor")
def td_sampled_corridor(spark, d):
    """Earliest arrival on the union of the shortest paths of four windows' mean weights: a heuristic
    that can be slower than the optimum, never faster."""
    from ..operators import search as s

    edges, ttf = view(spark, d, "g_grid"), view(spark, d, "ttf")
    od = view(spark, d, "od").where("src <> dst")
    windows = [(79_200_000, 18_000_000), (25_200_000, 36_000_000), (39_600_000, 54_000_000), (57_600_000, 68_400_000)]
    used = None
    for a, b in windows:
        mean = edges.drop("weight").join(t.window_average(ttf, a, b).withColumnRenamed("mean", "weight"), "edge_id")
        p = s.paths(mean, od)
        steps = p.select(F.col("node").alias("tail"), F.lead("node").over(Window.partitionBy("query_id").orderBy("idx")).alias("head")).where("head is not null")
        used = steps if used is None else used.union(steps)
    # both grow with the network, though Spark takes them for small
    only = edges.join(cut(used.distinct()).hint("merge"), ["tail", "head"]).select("edge_id").hint("merge")
    return t.earliest_arrival(edges, ttf, od, only).select("query_id", "duration")


@query("td_profile_minimum")
def td_profile_minimum(spark, d):
    """Fastest and slowest travel time of the day between two nodes, in whole milliseconds."""
    p = t.profile(view(spark, d, "g_grid"), view(spark, d, "ttf"), view(spark, d, "od").where("src <> dst"))
    return p.groupBy("query_id").agg(F.floor(F.min("tt")).cast("long").alias("fastest"), F.floor(F.max("tt")).cast("long").alias("slowest"))


def _arrays(spark, d, parity):
    points = view(spark, d, "ttf").where(f"edge_id % 2 = {parity}").groupBy("edge_id").agg(F.array_sort(F.collect_list(F.struct("dep", "tt"))).alias("p"))
    return points.select((F.col("edge_id") - parity).alias("key"), "p")


@query("ttf_link")
def ttf_link(spark, d):
    """Even edges' functions followed by the odd ones'."""
    both = _arrays(spark, d, 0).withColumnRenamed("p", "f").join(_arrays(spark, d, 1).withColumnRenamed("p", "g"), "key")
    return t.linked_functions(both).select("key", F.round("dep", 3).alias("dep"), F.round("tt", 3).alias("tt"))


@query("ttf_merge")
def ttf_merge(spark, d):
    both = _arrays(spark, d, 0).withColumnRenamed("p", "f").join(_arrays(spark, d, 1).withColumnRenamed("p", "g"), "key")
    return t.merged_functions(both).select("key", F.round("dep", 3).alias("dep"), F.round("tt", 3).alias("tt"))


@query("ttf_text_export", with_sql("select edge_id as line, tail || ' ' || head || ' ' || count(*) || ' ' || string_agg(dep * 10 || ' ' || tt * 10, ' ' order by dep) as text from ttf join g_grid using (edge_id) group by edge_id, tail, head"))
def ttf_text_export(spark, d):
    from ..sources import files

    return files.ttf_lines(view(spark, d, "g_grid"), view(spark, d, "ttf"), 10)


@query("ttf_text_import", with_sql("select tail, head, idx, dep, tt from ttf join g_grid using (edge_id)"))
def ttf_text_import(spark, d):
    from ..sources import files

    return files.read_ttf_lines(files.ttf_lines(view(spark, d, "g_grid"), view(spark, d, "ttf")))
