"""Queries on hierarchies whose weights are functions. Their answers are no whole numbers, so tests hold them against searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import view
from ..operators import hierarchy as h
from ..operators import profiles as p
from ..operators.ttf import DAY
from ..session import cut
from .structure import built, cells, completed, rank_od, ranked

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str):
    def keep(f):
        QUERIES[name] = f
        return f

    return keep


def limits(spark, d):
    """Upper bounds of the travel times between the completion's ends."""
    upper = view(spark, d, "ttf").groupBy("edge_id").agg(F.max("tt").alias("weight"))
    weights = h.respecting(completed(spark, d), ranked(spark, d).drop("weight").join(upper, "edge_id"))
    return cut(h.perfected(h.customized_cells(weights, cells(spark, d))))


def functions(spark, d):
    return built(spark, d, "functions", lambda: cut(p.customize(p.edge_functions(ranked(spark, d), view(spark, d, "ttf")), cells(spark, d), limits(spark, d))))


def tree(spark, d):
    return built(spark, d, "tree", lambda: cut(h.full_tree(completed(spark, d), view(spark, d, "grid_order"))))


def trips(spark, d, first=0, last=DAY):
    """All trips between ranks, with a range of departures."""
    od = rank_od(spark, d, view(spark, d, "od").where("src <> dst"))
    return od.select("query_id", F.col("s").alias("src"), F.col("t").alias("dst"), F.lit(first).alias("first"), F.lit(last).alias("last"), "departure")


def _whole(value):
    return F.floor(value).cast("long")


@query("td_shortcuts")
def td_shortcuts(spark, d):
    """Every shortcut that a fastest way can need: its function's size, extremes in whole milliseconds, and from when on it leads over what."""
    f = functions(spark, d)
    return f.select("lo", "hi", "dir", F.size("dep").alias("points"), _whole(F.array_min("tt")).alias("lowest"), _whole(F.array_max("tt")).alias("highest"), F.transform("starts", lambda x: F.floor(x).cast("long")).alias("starts"), "vias")


@query("td_profiles")
def td_profiles(spark, d):
    """Travel-time functions of all trips over the day, from the hierarchy."""
    return p.profile(functions(spark, d), tree(spark, d), trips(spark, d))


@query("td_partial_profiles")
def td_partial_profiles(spark, d):
    """The same for departures from seven to ten."""
    return p.profile(functions(spark, d), tree(spark, d), trips(spark, d, 25_200_000, 36_000_000))


@query("td_profile_paths")
def td_profile_paths(spark, d):
    """The edges of a fastest way of all trips for each range of departures."""
    return p.profile_paths(functions(spark, d), tree(spark, d), trips(spark, d))


@query("td_unpacked_paths")
def td_unpacked_paths(spark, d):
    """The edges of a fastest way of all trips at their own departure."""
    return p.paths_at(functions(spark, d), tree(spark, d), trips(spark, d))


@query("td_source_statistics")
def td_source_statistics(spark, d):
    """How many sources the shortcuts have."""
    return p.source_statistics(functions(spark, d))


@query("td_unique_paths")
def td_unique_paths(spark, d):
    """Shortcuts that lead over the same edges all day."""
    return p.unique_paths(functions(spark, d))
