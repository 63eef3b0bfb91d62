"""Queries on hierarchies, network structure and traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import view, with_sql
from ..operators import graph as g
from ..operators import hierarchy as h
from ..operators import sweep as sw
from ..session import cut
from ..streaming import traces as tr
from .static import ARCS_G, OD, PAIRS, PERMUTED, od_all, sssp, workload

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def ranked(spark, d):
    return g.ranked(view(spark, d, "g_grid"), view(spark, d, "grid_order"))


#: The completion: two ranks are joined if a way between them has only lower ranks inside.
CCH = {
    "ra": "select a.rank as a, b.rank as b, weight from g_grid join grid_order a on a.node_id = tail join grid_order b on b.node_id = head",
    "sym": "select a, b from ra where a <> b union select b, a from ra where a <> b",
    "r(q, x)": "select rank, rank from grid_order union select r.q, sym.b from r join sym on sym.a = r.x where r.x <= r.q",
    "cch": "select q as lo, x as hi from r where x > q",
}
TREE = CCH | {"tree": "select rank, (select min(hi) from cch where lo = rank) as parent from grid_order"}
CELL = TREE | {
    "single": "select parent from tree where parent is not null group by parent having count(*) = 1",
    "c(rank, top)": "select rank, rank from tree union all select c.rank, t.parent from c join tree t on t.rank = c.top join single s on s.parent = t.parent",
    "cells": "select rank, max(top) as cell from c group by rank",
}


def below(name: str, start: str, end: str) -> tuple[str, str]:
    """Shortest ways from (or to) a rank whose inner ranks are lower than it."""
    return (
        f"{name}(q, v, d) using key (q, v)",
        f"""select rank, rank, 0::bigint from grid_order union select f.q, e.{end}, min(f.d + e.weight) from {name} f join ra e on e.{start} = f.v
            left join recurring.{name} x on x.q = f.q and x.v = e.{end} where f.v <= f.q and (x.d is null or f.d + e.weight < x.d) group by f.q, e.{end}""",
    )


def cch_sql(body: str, more: dict[str, str] = CCH) -> str:
    return with_sql(body, extra=more, recursive=True)


_built: dict[tuple, object] = {}


def built(spark, d, name, make):
    """What `make` gives, kept under its name for this application: a hierarchy is built once, and customized for each metric."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _built:
        _built[key] = make()
    return _built[key]


def contracted(spark, d):
    return built(spark, d, "completion", lambda: cut(h.contracted_cells(ranked(spark, d))))


def completed(spark, d):
    return contracted(spark, d).select("lo", "hi")


def cells(spark, d):
    """rank, cell, round of the completion's elimination: what is below a rank falls into the same components before and after."""
    return built(spark, d, "cells", lambda: cut(h.cells_of(contracted(spark, d))))


def customized(spark, d):
    return built(spark, d, "customized", lambda: cut(h.customized_cells(h.respecting(completed(spark, d), ranked(spark, d)), cells(spark, d))))


@query("cch_edges", cch_sql("select lo, hi from cch"))
def cch_edges(spark, d):
    return completed(spark, d)


@query("elimination_tree", cch_sql("select lo as rank, min(hi) as parent from cch group by lo"))
def elimination_tree(spark, d):
    return h.elimination_tree(completed(spark, d))


@query("cch_degrees", cch_sql("select coalesce(a.rank, b.rank) as rank, coalesce(u, 0) as up_degree, coalesce(w, 0) as down_degree from (select lo as rank, count(*) as u from cch group by lo) a full join (select hi as rank, count(*) as w from cch group by hi) b on a.rank = b.rank"))
def cch_degrees(spark, d):
    return h.levels(completed(spark, d))


@query("cch_respecting", cch_sql("select lo, hi, (select min(weight) from ra where a = lo and b = hi) as up, (select min(weight) from ra where a = hi and b = lo) as down from cch"))
def cch_respecting(spark, d):
    return h.respecting(completed(spark, d), ranked(spark, d))


@query("cch_triangles", cch_sql("select x.lo as low, count(*) as triangles from cch x join cch y on x.lo = y.lo and x.hi < y.hi group by x.lo"))
def cch_triangles(spark, d):
    return h.lower_triangles(completed(spark, d)).groupBy("low").agg(F.count(F.lit(1)).alias("triangles"))


def weights(spark, d, perfect=False):
    """The completion customized for the network's weights."""
    if perfect:
        return built(spark, d, "perfect", lambda: cut(h.perfected(customized(spark, d))))
    return customized(spark, d).select("lo", "hi", "up", "down")


@query("cch_customized", cch_sql("select lo, hi, u.d as up, w.d as down from cch left join up u on u.q = lo and u.v = hi left join dn w on w.q = lo and w.v = hi", CCH | dict([below("up", "a", "b"), below("dn", "b", "a")])))
def cch_customized(spark, d):
    return weights(spark, d)


def rank_od(spark, d, od):
    order = view(spark, d, "grid_order")
    a, b = order.select(F.col("node_id").alias("src"), F.col("rank").alias("s")), order.select(F.col("node_id").alias("dst"), F.col("rank").alias("t"))
    return od.join(a, "src").join(b, "dst")


@workload("cch_query", PAIRS, query)
def cch_query(spark, d, od):
    od = rank_od(spark, d, od)
    ends = od.select(F.lit("up").alias("dir"), F.col("s").alias("source")).union(od.select(F.lit("down"), "t"))
    found = h.label_query(h.labels_of(customized(spark, d), ends), od.select("query_id", F.col("s").alias("src"), F.col("t").alias("dst")))
    return od.select("query_id", "src", "dst").join(found, "query_id")


#: Distances from each rank, as far as its longest edge to a higher one; the edge itself bounds what is asked for.
NEAR = {
    "reach": "select a as q, max(weight) as cap from ra where a < b group by a",
    "sp(q, v, d) using key (q, v)": """select q, q, 0::bigint from reach union select f.q, e.b, min(f.d + e.weight) from sp f join ra e on e.a = f.v join reach c on c.q = f.q
        left join recurring.sp x on x.q = f.q and x.v = e.b where f.d + e.weight <= c.cap and (x.d is null or f.d + e.weight < x.d) group by f.q, e.b""",
}


@query("cch_perfect_distances", cch_sql("select distinct a as lo, b as hi, d as up from ra join sp on q = a and v = b where a < b", {"ra": CCH["ra"]} | NEAR))
def cch_perfect_distances(spark, d):
    """After perfect customization an edge's weight is the distance between its ends."""
    own = ranked(spark, d).where("tail < head").select(F.col("tail").alias("lo"), F.col("head").alias("hi")).distinct()
    return own.join(weights(spark, d, True).select("lo", "hi", "up"), ["lo", "hi"])


@workload("hub_label_query", PAIRS, query)
def hub_label_query(spark, d, od):
    od = rank_od(spark, d, od)
    all_nodes = view(spark, d, "grid_order").select("rank")
    label = cut(h.labels(customized(spark, d), all_nodes))
    found = h.label_query(h.pruned_labels(label), od.select("query_id", F.col("s").alias("src"), F.col("t").alias("dst")))
    return od.select("query_id", "src", "dst").join(found, "query_id")


RPHAST = sssp(ARCS_G, f"select distinct src as q, src as v, 0::bigint as d from ({OD})", f"select q as src, v as dst, d as dist from sp where v in (select dst from ({OD}))")


@workload("rphast", RPHAST, query)
def rphast(spark, d, od):
    """All sources, one by one, to all targets: the targets' part of the hierarchy is selected once and swept for each source."""
    return swept(spark, d, od, 1)


def swept(spark, d, od, size):
    order, od = cut(view(spark, d, "grid_order")), rank_od(spark, d, od)
    found = sw.one_to_many(customized(spark, d), od.select(F.col("s").alias("rank")), od.select(F.col("t").alias("rank")), size)
    names = lambda c: order.select(F.col("rank").alias(c), F.col("node_id").alias(f"{c}_node"))
    return found.join(names("src"), "src").join(names("dst"), "dst").select(F.col("src_node").alias("src"), F.col("dst_node").alias("dst"), "dist")


@workload("rphast_batched", RPHAST, query)
def rphast_batched(spark, d, od):
    """As `rphast`, with the distances of 32 sources in one label."""
    return swept(spark, d, od, sw.BATCH)


#: The hierarchy's edges that can lead down, and the ranks above the workload's targets.
CHOSEN = CCH | dict([below("dn", "b", "a")]) | {
    "leads": "select lo, hi, w.d as down from cch join dn w on w.q = lo and w.v = hi",
    "chosen(v)": f"select rank from grid_order join ({OD}) o on node_id = dst union select hi from chosen join leads on lo = chosen.v",
}


@query("rphast_selection", cch_sql("select lo, hi, down from leads where lo in (select v from chosen)", CHOSEN))
def rphast_selection(spark, d):
    """The edges that ways down to the workload's targets need."""
    chosen = sw.selection(customized(spark, d), rank_od(spark, d, od_all(spark, d)).select(F.col("t").alias("rank")))
    return weights(spark, d).where("down is not null").join(chosen, F.col("lo") == F.col("rank"), "left_semi").select("lo", "hi", "down")


@query("rphast_work", cch_sql(f"select count(*) as edges, count(*) filter (where lo in (select v from chosen)) as selected, cast(count(*) filter (where lo in (select v from chosen)) * ceil((select count(distinct src) from ({OD})) / 32) as bigint) as relaxed from leads", CHOSEN))
def rphast_work(spark, d):
    """How many edges a sweep for the workload's targets looks at."""
    od, edges = rank_od(spark, d, od_all(spark, d)), cut(ranked(spark, d))
    if sw.both_ways(edges):
        return sw.work_by_counts(edges, od.select(F.col("s").alias("rank")), od.select(F.col("t").alias("rank")))
    return sw.work(customized(spark, d), od.select(F.col("s").alias("rank")), od.select(F.col("t").alias("rank")))


@query("biconnected_components")
def biconnected_components(spark, d):
    return h.biconnected(view(spark, d, "g_trans"))


@query("degree_one_core")
def degree_one_core(spark, d):
    return h.core(view(spark, d, "g_trans"))


@query("link_speed_estimate")
def link_speed_estimate(spark, d):
    out = tr.link_speeds(view(spark, d, "links"), view(spark, d, "traces"))
    return out.select("trip", "link_id", "entered_ms", F.round("quality", 6).alias("quality"), F.round("velocity", 6).alias("velocity"))


@query("metric_update", with_sql("select g.edge_id, case when u.edge_id is null then weight else u.w end as weight from g_grid g left join (select edge_id, case when edge_id % 4 = 0 then null else weight + 7 end as w from g_grid where edge_id % 2 = 0) u on u.edge_id = g.edge_id"))
def metric_update(spark, d):
    edges = view(spark, d, "g_grid")
    first = edges.where("edge_id % 2 = 0").select("edge_id", F.lit(1).alias("version"), (F.col("weight") + 1).alias("weight"))
    second = edges.where("edge_id % 2 = 0").select("edge_id", F.lit(2).alias("version"), F.when(F.col("edge_id") % 4 != 0, F.col("weight") + 7).alias("weight"))
    unknown = spark.createDataFrame([(-1, 3, 5)], "edge_id long, version int, weight long")
    return tr.apply_updates(edges.select("edge_id", "weight"), first.union(second).union(unknown))


@query("ubs_ranges")
def ubs_ranges(spark, d):
    """Paths that are shortest by hops, held against shortest ways by weight."""
    from ..operators import alternatives as alt
    from ..operators import search as s

    edges = view(spark, d, "g_grid")
    paths = s.paths(edges.withColumn("weight", F.lit(1).cast("long")), od_all(spark, d))
    return alt.ubs_violations(paths.select(F.col("query_id").alias("path_id"), "idx", "node"), edges, 0.1)


@query("penalty_alternatives")
def penalty_alternatives(spark, d):
    from ..operators import alternatives as alt

    return alt.penalty_alternatives(view(spark, d, "g_grid"), od_all(spark, d))


@query("pareto_routes")
def pareto_routes(spark, d):
    from ..operators import alternatives as alt

    edges = view(spark, d, "g_trans").withColumn("weight2", 1 + (F.col("tail") + F.col("head")) % 5)
    return alt.pareto(edges, od_all(spark, d))


@query("dfs_order")
def dfs_order(spark, d):
    from ..operators import alternatives as alt

    return alt.dfs_order(view(spark, d, "g_trans"))
