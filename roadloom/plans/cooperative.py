"""Queries on capacities, buckets, metrics, cooperative routing and workloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import view, with_sql
from ..operators import coop as c
from ..operators import search as s
from ..operators import workload as w
from ..operators.ordered import number_rows
from .static import ARCS_G, sssp

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


NET = "select *, case when capacity > 0 then 3600 * dist_m // ff_speed end as ff_time from (select edge_id, tail, head, dist_m, case when capacity_per_h >= 50 then capacity_per_h * 24 // 96 else 0 end as capacity, greatest(3600 * dist_m // ff_time, 1) as ff_speed from capacity)"
USED = "select edge_id, 900000 * (t_ms % 86400000 // 900000) as bucket, count(*) as used from usage group by 1, 2"


def net(spark, d):
    return c.init_capacity(view(spark, d, "capacity"), 96)


@query("capacity_init", with_sql("select * from net", extra={"net": NET}))
def capacity_init(spark, d):
    return net(spark, d)


@query("usage_buckets", with_sql("select * from used", extra={"used": USED}))
def usage_buckets(spark, d):
    return c.usage(view(spark, d, "usage"), 900_000)


LOAD = "(used / capacity::double) * (used / capacity::double)"


@query("bpr_travel_time", with_sql(f"select edge_id, bucket, greatest(round(ff_time * (1 + {LOAD})), 1)::bigint as tt from used join net using (edge_id) where capacity > 0", extra={"used": USED, "net": NET}))
def bpr_travel_time(spark, d):
    both = usage_buckets(spark, d).join(net(spark, d), "edge_id").where("capacity > 0")
    return both.select("edge_id", "bucket", c.bpr_time(F.col("ff_time"), F.col("used"), F.col("capacity")).alias("tt"))


@query("bpr_speed", with_sql(f"select edge_id, bucket, greatest(round(ff_speed / (1 + {LOAD})), 1)::bigint as kmh from used join net using (edge_id) where capacity > 0", extra={"used": USED, "net": NET}))
def bpr_speed(spark, d):
    both = usage_buckets(spark, d).join(net(spark, d), "edge_id").where("capacity > 0")
    return both.select("edge_id", "bucket", c.bpr_speed(F.col("ff_speed"), F.col("used"), F.col("capacity")).alias("kmh"))


@query(
    "speed_profiles",
    with_sql(
        "select edge_id, bucket as start, kmh from slow union all select edge_id, start, ff_speed from (select edge_id, bucket + 900000 as start, ff_speed from slow where bucket + 900000 < 86400000 union select edge_id, 0, ff_speed from slow) f where not exists (select 1 from slow x where x.edge_id = f.edge_id and x.bucket = f.start)",
        extra={"used": USED, "net": NET, "slow": f"select edge_id, bucket, ff_speed, greatest(round(ff_speed / (1 + {LOAD})), 1)::bigint as kmh from used join net using (edge_id) where capacity > 0"},
    ),
)
def speed_profiles(spark, d):
    return c.speed_profiles(net(spark, d), usage_buckets(spark, d), 900_000)


@query("rebuilt_functions")
def rebuilt_functions(spark, d):
    some = usage_buckets(spark, d)
    return c.rebuild_functions(c.speed_profiles(net(spark, d), some, 900_000), net(spark, d))


PATTERN = [3, 6, 12]


@query("interval_pattern", "select 0::bigint as metric_id, 0::bigint as start, 86400000::bigint as \"end\" union all select row_number() over (order by h, k)::bigint, k * h * 1800000, k * h * 1800000 + h * 3600000 from (values (3::bigint), (6), (12)) t(h), range(0, 60) r(k) where k * h * 1800000 + h * 3600000 <= 86400000")
def interval_pattern(spark, d):
    return c.interval_pattern(spark, PATTERN)


@query(
    "tightest_metric",
    with_sql(
        "select query_id, coalesce((select min(row(b - a, metric_id))[2] from m where a <= departure and latest <= b and latest < 86400000), 0)::bigint as metric_id from (select query_id, departure, departure + 7200000 as latest from od)",
        extra={"m": "select 0::bigint as metric_id, 0::bigint as a, 86400000::bigint as b union all select row_number() over (order by h, k), k * h * 1800000, k * h * 1800000 + h * 3600000 from (values (3::bigint), (6), (12)) t(h), range(0, 60) r(k) where k * h * 1800000 + h * 3600000 <= 86400000"},
    ),
)
def tightest_metric(spark, d):
    q = view(spark, d, "od").select("query_id", "departure", (F.col("departure") + 7_200_000).alias("latest"))
    return c.tightest_metric(q, c.interval_pattern(spark, PATTERN))


METRICS = "select idx as metric_id, edge_id, tt as weight from ttf"


@query("metric_difference", with_sql("select x.metric_id as a, y.metric_id as b, sum((abs(x.weight - y.weight) // 500) * (abs(x.weight - y.weight) // 500))::bigint as diff from m x join m y using (edge_id) where x.metric_id < y.metric_id group by 1, 2", extra={"m": METRICS}))
def metric_difference(spark, d):
    return c.metric_difference(view(spark, d, "ttf").select(F.col("idx").alias("metric_id"), "edge_id", F.col("tt").alias("weight")))


@query("metric_reduction")
def metric_reduction(spark, d):
    return c.reduce_metrics(view(spark, d, "ttf").select(F.col("idx").alias("metric_id"), "edge_id", F.col("tt").alias("weight")), 3)


@query("upper_bound_slack", with_sql("select edge_id, greatest(hi // 2 * 3, 1) as slack from (select edge_id, max(tt) as hi from ttf group by edge_id)"))
def upper_bound_slack(spark, d):
    return view(spark, d, "ttf").groupBy("edge_id").agg(F.max("tt").alias("hi")).select("edge_id", F.expr("greatest(hi div 2 * 3, 1)").alias("slack"))


@query("invalid_updates", with_sql("select edge_id from (select edge_id, max(tt) as upper from ttf group by edge_id) join live using (edge_id) where upper < live_tt"))
def invalid_updates(spark, d):
    upper = view(spark, d, "ttf").groupBy("edge_id").agg(F.max("tt").alias("upper"))
    return upper.join(view(spark, d, "live"), "edge_id").where("upper < live_tt").select("edge_id")


@query("cooperative_trips")
def cooperative_trips(spark, d):
    return c.cooperative(net(spark, d), view(spark, d, "od"), 900_000).drop("uses")


@query("cooperative_batched")
def cooperative_batched(spark, d):
    return c.cooperative(net(spark, d), view(spark, d, "od"), 900_000, batch=10).drop("uses")


DRAW = "('0x' || substr(md5({k} || ':{s}'), 1, 13))::bigint % {n}"
KEYS = "(select o_orderkey::bigint as i from orders)"


def keys(spark, d):
    """A trip for each order."""
    return view(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("query_id"))


@query("od_uniform", f"select i as query_id, {DRAW.format(k='i', s=1, n='n')} as src, ({DRAW.format(k='i', s=1, n='n')} + 1 + {DRAW.format(k='i', s=2, n='(n - 1)')}) % n as dst, {DRAW.format(k='i', s=3, n=86400000)} as departure from {KEYS}, (select count(*) as n from part)")
def od_uniform(spark, d):
    return w.uniform(keys(spark, d), view(spark, d, "part").count(), 1)


#: The first of 245 trips in each hour, written out apart from the operator's own values.
HOURS = "(0, 0), (2, 1), (3, 2), (4, 3), (5, 4), (7, 5), (10, 6), (15, 7), (25, 8), (45, 9), (63, 10), (78, 11), (90, 12), (102, 13), (116, 14), (131, 15), (146, 16), (162, 17), (180, 18), (200, 19), (217, 20), (230, 21), (238, 22), (242, 23)"


@query("departure_rush_hour", f"select i as query_id, (select max(hour) from (values {HOURS}) t(low, hour) where low <= {DRAW.format(k='i', s=5, n=245)})::bigint * 3600000 + {DRAW.format(k='i', s=6, n=3600000)} as departure from {KEYS}")
def departure_rush_hour(spark, d):
    return w.departures(keys(spark, d), "rush_hour", 5)


CELLS = {"n": "select node_id, (x // 8) * 1000 + y // 8 as cell, sz from grid_nodes", "p": "select cell, sum(sz)::bigint as population from n group by cell", "r": "select cell, sum(population) over (order by cell) - population as low, sum(population) over (order by cell) as high from p", "k": "select cell, node_id, row_number() over (partition by cell order by node_id) - 1 as k, count(*) over (partition by cell) as size from n"}


def _population_end(name: str, seed: int) -> str:
    return f"select i as query_id, node_id as {name} from range(0, 1000) t(i) join r on low <= {DRAW.format(k='i', s=seed, n='(select sum(population) from p)::bigint')} and {DRAW.format(k='i', s=seed, n='(select sum(population) from p)::bigint')} < high join k on k.cell = r.cell and k.k = {DRAW.format(k='i', s=seed + 1, n=1000000)} % size"


@query("od_population", with_sql(f"select query_id, src, dst from ({_population_end('src', 20)}) join ({_population_end('dst', 27)}) using (query_id)", extra=CELLS))
def od_population(spark, d):
    nodes = view(spark, d, "grid_nodes").select("node_id", F.expr("(x div 8) * 1000 + y div 8").alias("cell"), "sz")
    cells = nodes.groupBy("cell").agg(F.sum("sz").alias("population"))
    return w.by_population(spark, 1000, cells, nodes, 20)


@query("od_geometric", sssp(ARCS_G, "select distinct src as q, src as v, 0::bigint as d from od", "select q, min(row(d, v))[2] as node, min(d) as dist from sp where d >= 100000 group by q"))
def od_geometric(spark, d):
    """The first node beyond a distance, per source."""
    return od_geometric_of(spark, d, view(spark, d, "od"))


def od_geometric_of(spark, d, od):
    seeds = od.select(F.col("src").alias("q"), F.col("src").alias("node"), F.lit(0).cast("long").alias("dist")).distinct()
    return w.first_beyond(s.search(view(spark, d, "g_grid"), seeds), 100_000)


@query("od_sorted_departures", with_sql("select query_id, row_number() over (order by departure, query_id) - 1 as position from od"))
def od_sorted_departures(spark, d):
    return number_rows(view(spark, d, "od").select("query_id", "departure"), ["departure", "query_id"], "position").select("query_id", "position")


@query("query_text_export", with_sql("select query_id as line, src || ' ' || dst || ' ' || departure as text from od"))
def query_text_export(spark, d):
    from ..sources import files

    return files.query_lines(view(spark, d, "od"))
