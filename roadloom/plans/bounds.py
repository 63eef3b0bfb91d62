"""Queries of bounds by the time of day and of functions with fewer points. Their answers are no whole numbers, so tests hold them
against searches, a grid search and the exact functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import approximation as a
from ..operators import buckets as b
from ..session import cut
from .profiles import functions, tree, trips
from .structure import built
from .timed import _arrays

QUERIES: dict = {}
ORACLE: dict = {}
#: Parts of the day: quarters of an hour.
BUCKETS = 96
#: How far (ms) a reduced function may be from the exact one.
WITHIN = 500.0


def query(name: str):
    def keep(f):
        QUERIES[name] = f
        return f

    return keep


def bucketed(spark, d):
    return built(spark, d, "bucketed", lambda: cut(b.bucketed(functions(spark, d), BUCKETS)))


def _whole(value):
    return F.floor(value).cast("long")


@query("td_bucket_minima")
def td_bucket_minima(spark, d):
    """Every shortcut's least travel time in each quarter of an hour, in whole milliseconds."""
    return bucketed(spark, d).select("lo", "hi", "dir", F.transform("lows", lambda x: F.floor(x).cast("long")).alias("lows"), _whole("high").alias("high"))


@query("td_bucket_query")
def td_bucket_query(spark, d):
    """Earliest arrivals of all trips, led by the minima of the quarters in which a node can be passed."""
    found = b.earliest_arrival(bucketed(spark, d), tree(spark, d), trips(spark, d))
    return found.select("query_id", *(_whole(c).alias(c) for c in ("duration", "bound", "upper")), "settled")


@query("td_bucket_potentials")
def td_bucket_potentials(spark, d):
    """For all trips, what is left at least from each other trip's source that has the same target, and from their own."""
    od = trips(spark, d)
    nodes = od.select("query_id", "dst").join(od.select("dst", F.col("src").alias("rank")), "dst").select("query_id", "rank").distinct()
    return b.potentials(bucketed(spark, d), tree(spark, d), od, nodes).select("query_id", "rank", _whole("bound").alias("bound"), _whole("day_bound").alias("day_bound"))


@query("td_reduced_shortcuts")
def td_reduced_shortcuts(spark, d):
    """How many points all shortcuts' functions have, and how few are enough within half a second, on both sides and on one."""
    keyed = functions(spark, d).select(F.xxhash64("lo", "hi", "dir").alias("key"), "lo", "hi", "dir", F.arrays_zip("dep", "tt").alias("p"))
    few = a.reduced(keyed, WITHIN).select("key", *(F.size(c).alias(c) for c in ("p", "near", "lower", "upper")))
    return keyed.select("key", "lo", "hi", "dir").join(few, "key").drop("key").withColumnRenamed("p", "points")


def _with_bounds(spark, d, parity, name):
    day = a.reduced(_arrays(spark, d, parity), WITHIN, ("lower", "upper"))
    return day.select("key", F.col("p").alias(name), F.col("lower").alias(f"{name}_lower"), F.col("upper").alias(f"{name}_upper"))


def _both(spark, d):
    return _with_bounds(spark, d, 0, "f").join(_with_bounds(spark, d, 1, "g"), "key")


@query("ttf_bounded_link")
def ttf_bounded_link(spark, d):
    """Bounds of even edges' functions followed by the odd ones': their points and extremes in whole milliseconds."""
    found = a.bounded_links(_both(spark, d))
    return found.select("key", F.size("lower").alias("n_lower"), F.size("upper").alias("n_upper"), _whole(F.array_min("lower.tt")).alias("least"), _whole(F.array_max("upper.tt")).alias("most"))


@query("ttf_bounded_merge")
def ttf_bounded_merge(spark, d):
    """When even edges' functions are better than the odd ones', told by bounds where these don't overlap."""
    found = a.bounded_merges(_both(spark, d))
    return found.select("key", F.transform("starts", lambda x: F.floor(x).cast("long")).alias("starts"), "firsts", _whole("refined").alias("refined"))
