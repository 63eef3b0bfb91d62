"""Networks, travel-time functions and workloads derived from the driver's tables.

`SQL` holds one text per view that runs unchanged in Spark SQL and DuckDB; later views read earlier
ones. `view(spark, sf_dir, name)` gives the DataFrame, `with_sql(name, ...)` the common table
expressions that an oracle query starts with. The keys of `extra` are the heads of further expressions,
such as `c` or `sp(q, v, d) using key (q, v)`.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ["part", "orders", "lineitem", "events", "supplier", "customer"]

SQL: dict[str, str] = {
    "g_trans": """
        with li as (
          select l_partkey as p, cast(l_quantity as bigint) as q,
                 lead(l_partkey) over (partition by l_orderkey
                   order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as nx
          from lineitem),
        e0 as (select p as tail, nx as head, min(q) as weight from li where nx is not null and nx <> p group by p, nx),
        e1 as (select tail, head, weight, row_number() over (partition by tail order by weight, head) as rn from e0)
        select cast(tail as bigint) as tail, cast(head as bigint) as head, cast(weight as bigint) as weight from e1 where rn <= 3""",
    "grid_nodes": """
        with d as (select cast(floor(sqrt(count(*))) as bigint) as w, count(*) as n from part)
        select cast(p_partkey as bigint) as node_id, cast(p_partkey % w as bigint) as x, cast(floor(p_partkey / w) as bigint) as y,
               cast(p_size as bigint) as sz, w, n
        from part cross join d""",
    "g_grid": """
        with k as (select * from (values (0), (1), (2), (3)) as t(dir)),
        e as (
          select case when dir in (0, 1) then node_id when dir = 2 then node_id + 1 else node_id + w end as tail,
                 case when dir = 0 then node_id + 1 when dir = 1 then node_id + w else node_id end as head,
                 1000 * (sz + dir) as weight
          from grid_nodes cross join k
          where (dir in (0, 2) and x <> w - 1 and node_id + 1 < n) or (dir in (1, 3) and node_id + w < n))
        select cast(row_number() over (order by tail, head) - 1 as bigint) as edge_id,
               cast(tail as bigint) as tail, cast(head as bigint) as head, cast(weight as bigint) as weight from e""",
    "grid_order": """
        with c as (
          select node_id,
            case when (x+1) % 128 = 0 then 7 when (x+1) % 64 = 0 then 6 when (x+1) % 32 = 0 then 5 when (x+1) % 16 = 0 then 4
                 when (x+1) % 8 = 0 then 3 when (x+1) % 4 = 0 then 2 when (x+1) % 2 = 0 then 1 else 0 end as zx,
            case when (y+1) % 128 = 0 then 7 when (y+1) % 64 = 0 then 6 when (y+1) % 32 = 0 then 5 when (y+1) % 16 = 0 then 4
                 when (y+1) % 8 = 0 then 3 when (y+1) % 4 = 0 then 2 when (y+1) % 2 = 0 then 1 else 0 end as zy
          from grid_nodes)
        select node_id, cast(row_number() over (order by greatest(2 * zx + 1, 2 * zy), node_id) - 1 as bigint) as rank from c""",
    "ttf": """
        with k as (select * from (values (0), (1), (2), (3), (4)) as t(idx))
        select edge_id, cast(idx as bigint) as idx, cast(idx * 21600000 as bigint) as dep,
               cast(weight + case when idx in (0, 4) then 0 else (edge_id * 7919 + idx * 104729) % weight end as bigint) as tt
        from g_grid cross join k""",
    "live": "select edge_id, cast(weight * 2 as bigint) as live_tt from g_grid where edge_id % 7 = 3",
    "forbidden_turns": """
        select cast(a.edge_id as bigint) as from_edge, cast(b.edge_id as bigint) as to_edge
        from g_grid a join g_grid b on a.head = b.tail
        where a.tail = b.head or (a.edge_id + b.edge_id) % 11 = 0""",
    "od": """
        select cast(o_orderkey as bigint) as query_id, cast((o_orderkey * 7919) % n as bigint) as src,
               cast((o_custkey * 104729 + 17) % n as bigint) as dst, cast((o_orderkey * 4919003) % 86400000 as bigint) as departure
        from orders cross join (select count(*) as n from part) d
        where o_orderkey % 300 = 0""",
    "usage": """
        select cast((user_id * 7919 + event_id * 31) % m as bigint) as edge_id,
               cast((hour(ts) * 3600000 + minute(ts) * 60000 + second(ts) * 1000) as bigint) as t_ms
        from events cross join (select count(*) as m from g_grid) d""",
    "capacity": """
        select edge_id, tail, head, cast(greatest(weight / 10, 1) as bigint) as dist_m, weight as ff_time,
               cast(40 + (edge_id * 13) % 400 as bigint) as capacity_per_h from g_grid""",
    "links": """
        select cast(user_id as bigint) as trip, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as seq,
               cast(event_id as bigint) as link_id, cast(10000 * (1 + event_id % 3) as bigint) as length_mm,
               cast(50 + 10 * (event_id % 4) as bigint) as speed_limit,
               cast((cast(day(ts) as bigint) - 1) * 86400000 + hour(ts) * 3600000 + minute(ts) * 60000 + second(ts) * 1000 as bigint) as t_ms
        from events""",
    "traces": """
        with b as (select *, max(seq) over (partition by trip) as mx from links)
        select trip, seq, link_id, t_ms + 86400000 as ts_ms, cast(0.5 as double) as fraction from b where seq % 3 = 0 or seq = mx""",
}


#: Rows with node ids of a range as wide as this are numbered together.
SPAN = 1024


def _numbered(columns: str, table: str, range_: str, order: str, name: str) -> str:
    """SELECT of `columns` of a table and the position in `order`, of which range_ (a list of columns) is a prefix made coarser:
    positions within a range, and a row for each range that counts the rows before it. No task gets all rows."""
    same = " and ".join(f"b_.{c} <=> r_.{c}" for c in range_.split(", "))
    return f"""
        select {columns}, cast(before_ + row_number() over (partition by {", ".join(f"r_.{c}" for c in range_.split(", "))} order by {order}) - 1 as bigint) as {name}
        from {table} r_ join (
          select {range_}, coalesce(sum(count(*)) over (order by {range_} rows between unbounded preceding and 1 preceding), 0) as before_
          from {table} group by {range_}) b_ on {same}"""


#: The same views for Spark, where the text that both engines run would number all rows in one task.
SPREAD: dict[str, str] = {}
_rows, _end = SQL["g_grid"].split("select cast(row_number()")
SPREAD["g_grid"] = (
    _rows.rstrip()
    + f""",
        r as (select cast(tail as bigint) as tail, cast(head as bigint) as head, cast(weight as bigint) as weight, floor(tail / {SPAN}) as range_ from e)"""
    + _numbered("tail, head, weight", "r", "range_", "tail, head", "edge_id")
)
SPREAD["g_grid"] = f"select edge_id, tail, head, weight from ({SPREAD['g_grid']})"
_rows, _end = SQL["grid_order"].split("select node_id, cast(row_number()")
SPREAD["grid_order"] = (
    _rows.rstrip()
    + f""",
        r as (select node_id, greatest(2 * zx + 1, 2 * zy) as level_, floor(node_id / {SPAN}) as range_ from c)"""
    + _numbered("node_id", "r", "level_, range_", "node_id", "rank")
)


def needed(name: str) -> list[str]:
    """The derived views that `name` (or an SQL text) reads, in order of definition."""
    text = SQL.get(name, name)
    found = {x for x in SQL if x != name and re.search(rf"\b{x}\b", text)}
    for x in list(found):
        found |= set(needed(x))
    return [x for x in SQL if x in found]


def with_sql(body: str, *, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """`body` with the views that it and `extra` read as common table expressions."""
    own = extra or {}
    views = needed(" ".join([body, *own.values()]))
    parts = [f"{x} as materialized ({SQL[x]})" for x in views] + [f"{head} as {'' if '(' in head else 'materialized '}({text})" for head, text in own.items()]
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(parts) + "\n" + body if parts else body


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view over the tables in `sf_dir`, without touching the session's catalogue."""
    if name not in SQL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sources = {x: spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in BASE if re.search(rf"\b{x}\b", " ".join(SQL[v] for v in [*needed(name), name]))}
    own = SQL | SPREAD
    text = "".join(f"{x} as ({own[x]}),\n" for x in needed(name)) + f"result_ as ({own[name]})"
    for x in sources:
        text = re.sub(rf"\b(from|join)\s+{x}\b", rf"\1 {{{x}}}", text)
    return spark.sql(f"with {text} select * from result_", **sources)
