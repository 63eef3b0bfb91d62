"""Golden values and properties of the network operators."""

import numpy as np
import pytest

from conftest import SMALL
from roadloom.fixtures import view
from roadloom.operators import graph, hierarchy, search, ttf
from roadloom.sources import files
from roadloom.streaming import traces

SIX = [(0, 0, 2, 10), (1, 0, 1, 1), (2, 1, 3, 2), (3, 2, 1, 1), (4, 2, 3, 3), (5, 2, 4, 1), (6, 3, 0, 7), (7, 3, 4, 2)]
EDGES = "edge_id long, tail long, head long, weight long"


@pytest.fixture(scope="module")
def six(spark):
    return spark.createDataFrame(SIX, EDGES)


@pytest.mark.parametrize("way", [search.pairs, search.bidirectional])
def test_six_nodes(spark, six, way):
    od = spark.createDataFrame([(0, 0, 1), (1, 0, 3), (2, 3, 0), (3, 0, 4), (4, 4, 0)], "query_id long, src long, dst long")
    assert [r["dist"] for r in way(six, od).orderBy("query_id").collect()] == [1, 3, 7, 5, None]


def test_loop_equals_local(spark):
    edges = view(spark, SMALL, "g_trans")
    seeds = spark.createDataFrame([(q, v, d) for q, v, d in [(0, 0, 0), (1, 7, 0), (1, 9, 4), (2, 10**6, 0)]], "q long, node long, dist long")
    a = {(r["q"], r["node"], r["dist"]) for r in search.loop(edges, seeds).collect()}
    assert a == {(r["q"], r["node"], r["dist"]) for r in search.local(search.csr(edges), seeds).collect()}
    capped = {(r["q"], r["node"], r["dist"]) for r in search.loop(edges, seeds, cap=15).collect()}
    assert capped == {x for x in a if x[2] <= 15}


def test_reversal_and_offsets(spark, six):
    r = graph.reverse(six).orderBy("edge_id").collect()
    assert [(x["head"], x["weight"]) for x in r] == [(3, 7), (0, 1), (2, 1), (0, 10), (1, 2), (2, 3), (2, 1), (3, 2)]
    nodes = spark.range(6).withColumnRenamed("id", "node_id")
    back = graph.reverse(six)
    assert [x["first_out"] for x in graph.csr_offsets(back, nodes).orderBy("node_id").collect()] == [0, 1, 3, 4, 6, 8]


@pytest.mark.parametrize(
    "dep,tt,want",
    [
        ([0, 6, 9, 14, 17, 20, 24], [2, 1, 3, 2, 4, 1, 2], {14: 2, 17: 4}),
        ([0, 5, 9, 14, 17, 20, 24], [1, 1, 3, 2, 4, 1, 1], {0: 1, 6: 1, 7: 2, 8: 2, 10: 2, 11: 2, 12: 2, 13: 2, 15: 2, 16: 3, 18: 3, 19: 2, 23: 1}),
    ],
)
def test_integer_function(spark, dep, tt, want):
    f = spark.createDataFrame([(0, k, a, b) for k, (a, b) in enumerate(zip(dep, tt))], "edge_id long, idx long, dep long, tt long")
    at = spark.createDataFrame([(t, 0, t) for t in want], "key long, edge_id long, t long")
    assert {r["t"]: r["tt"] for r in ttf.evaluate(f, at).collect()} == want


def test_link_and_merge_pointwise():
    rng = np.random.default_rng(0)
    grid = np.array([0.0, 21.6e6, 43.2e6, 64.8e6, 86.4e6])
    for _ in range(20):
        f, g = ((grid, np.append(v, v[0])) for v in rng.integers(1000, 500_000, (2, 4)).astype(float))
        h, m = ttf.link(f, g), ttf.merge(f, g)
        for t in rng.uniform(0, 86.4e6, 50):
            a = np.interp(t, *f)
            assert abs(np.interp(t, *h) - (a + np.interp((t + a) % 86.4e6, *g))) < 1e-3
            assert abs(np.interp(t, *m) - min(a, np.interp(t, *g))) < 1e-3
        d, v = ttf.approximate(*h, 5000.0)
        assert np.abs(np.interp(h[0], d, v) - h[1]).max() <= 5000.0
        fixed = ttf.repair_fifo(grid, rng.integers(0, 10**8, 5).astype(float))
        assert (np.diff(grid + fixed) >= 0).all()


def test_speed_profile():
    points = ttf.speed_profile_times([(0, 36), (43_200_000, 72)], 1000)
    times = dict(points)
    assert times[0] == 100_000 and times[43_200_000] == 50_000
    assert all(a + x <= b + y + 1 for (a, x), (b, y) in zip(points, points[1:]))


CASES = [
    ([(1, 10000, 50)], [(100000, 1, 0.1), (101000, 1, 0.9)], [(1, 99875, 0.8, 28.8)]),
    ([(1, 10000, 80), (2, 30000, 80)], [(100000, 1, 0.5), (101000, 2, 0.5)], [(1, 99750, 0.125, 72), (2, 100250, 0.375, 72)]),
    ([(1, 10000, 80), (2, 30000, 80), (3, 10000, 80)], [(100000, 1, 0.5), (102000, 3, 0.5)], [(1, 99750, 0.0625, 72), (2, 100250, 0.75, 72), (3, 101750, 0.0625, 72)]),
    ([(1, 10000, 80), (2, 30000, 80), (3, 10000, 80)], [(100000, 1, 0.5), (100250, 1, 1.0), (102000, 3, 0.5)], [(1, 99750, 0.5, 72), (2, 100250, 30 / 35, 72), (3, 101750, 2.5 / 35, 72)]),
    ([(1, 10000, 100), (2, 10000, 50), (3, 10000, 100)], [(100000, 1, 0.0), (101000, 3, 1.0)], [(1, 100000, 1 / 3, 144), (2, 100250, 1 / 3, 72), (3, 100750, 1 / 3, 144)]),
    ([(0, 10000, 100), (1, 10000, 100), (2, 10000, 50), (3, 10000, 100)], [(99500, 0, 0.0), (100000, 1, 0.0), (101000, 3, 1.0)], [(0, 99500, 1.0, 72), (1, 100000, 1 / 3, 144), (2, 100250, 1 / 3, 72), (3, 100750, 1 / 3, 144)]),
]


def _frames(spark, links, positions):
    order = {x[0]: k for k, x in enumerate(links)}
    a = spark.createDataFrame([(5, k, *x) for k, x in enumerate(links)], "trip long, seq long, link_id long, length_mm long, speed_limit long")
    b = spark.createDataFrame([(5, order[x[1]], *x) for x in positions], "trip long, seq long, ts_ms long, link_id long, fraction double")
    return a, b


@pytest.mark.parametrize("links,positions,want", CASES)
def test_link_speeds(spark, links, positions, want):
    got = sorted(map(tuple, traces.link_speeds(*_frames(spark, links, positions)).drop("trip").collect()))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2:] for g in got], [w[2:] for w in want])


def test_link_speed_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    a, b = _frames(spark, *CASES[5][:2])
    end = spark.createDataFrame([(5, 9, 2, 0, 0, 0, 0, 0.0)], "trip long, seq long, kind int, ts_ms long, link_id long, length_mm long, speed_limit long, fraction double")
    every = traces.events(a, b).unionByName(end).coalesce(1).sortWithinPartitions("seq", "kind", "ts_ms")
    src = str(tmp_path / "in")
    every.where("seq < 2").coalesce(1).write.json(src)
    every.where("seq >= 2").coalesce(1).write.mode("append").json(src)
    stream = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).json(src)
    q = traces.link_speed_stream(stream).writeStream.format("memory").queryName("speeds").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.table("speeds").drop("trip").collect()))
    assert [g[:2] for g in got] == [w[:2] for w in CASES[5][2]]
    assert spark.table("speeds").where(F.col("velocity").isNull()).count() == 0


def test_usage_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.read.parquet(f"{SMALL}/events.parquet").selectExpr("user_id as edge_id", "cast(ts as timestamp) as ts").write.parquet(src)
    stream = spark.readStream.schema("edge_id bigint, ts timestamp").parquet(src)
    q = traces.usage_stream(stream).writeStream.format("memory").queryName("used").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert spark.table("used").selectExpr("sum(used)").first()[0] == spark.read.parquet(src).count()


def test_files(spark, six, tmp_path):
    nodes = spark.range(6).withColumnRenamed("id", "node_id")
    path = str(tmp_path / "graph")
    files.dimacs_lines(six, nodes).orderBy("line").select("text").coalesce(1).write.text(path)
    assert sorted(map(tuple, files.read_dimacs(spark, path).collect())) == sorted(x[1:] for x in SIX)
    np.array([x[3] for x in SIX], "<u4").tofile(tmp_path / "weight")
    assert [r["value"] for r in files.read_column(spark, str(tmp_path / "weight"), "u32").orderBy("idx").collect()] == [x[3] for x in SIX]
    files.write_column(six, str(tmp_path / "col"), "u32", "edge_id", "weight")
    assert [r["value"] for r in files.read_written(spark, str(tmp_path / "col"), "u32").orderBy("idx").collect()] == [x[3] for x in SIX]
    r = files.Report(name="x")
    with r.context("runs"):
        r.put("ms", 3)
    assert r.json() == '{"name": "x", "runs": [{"ms": 3}]}'


def test_vendor_import(spark):
    nodes = spark.createDataFrame([(10, 48.0, 8.0), (20, 48.1, 8.1), (30, 60.0, 8.0)], "node_id long, lat double, lon double")
    links = spark.createDataFrame([(1, 10, 20, "B", 6, None, 100.0), (2, 20, 10, "F", 6, 25, 100.0), (3, 10, 30, "F", 1, None, 5.0)], "link_id long, ref long, non_ref long, direction string, category int, limit_kmh int, length_m double")
    got = files.import_vendor(links, nodes, (47.0, 7.0, 49.0, 9.0)).orderBy("edge_id").collect()
    assert [tuple(r) for r in got] == [(0, 0, 1, 100000, 7200), (1, 1, 0, 100000, 7200), (2, 1, 0, 100000, 14400)]


def test_small_helpers(spark):
    ranges = lambda x: spark.createDataFrame(x, "a long, b long")
    for given, want in (([(1, 3), (1, 2), (2, 3), (0, 3)], [(1, 2), (2, 3)]), ([(0, 1), (0, 2)], [(0, 1)]), ([(1, 2), (0, 2)], [(1, 2)])):
        assert sorted(map(tuple, graph.filter_covered(ranges(given)).collect())) == want
    ids = graph.dense_ids(spark.createDataFrame([(x,) for x in (0, 2, 52, 130, 149, 999)], "v long"), "v")
    assert {r["global_id"]: r["local_id"] for r in ids.collect()}[130] == 3


def test_hierarchy(spark, six):
    ranked = six.select("edge_id", "tail", "head", "weight")
    cch = hierarchy.contract(ranked)
    w = hierarchy.customize(hierarchy.respecting(cch, ranked))
    label = hierarchy.labels(w, spark.range(5).withColumnRenamed("id", "rank"))
    od = spark.createDataFrame([(a * 10 + b, a, b) for a in range(5) for b in range(5)], "query_id long, src long, dst long")
    want = {r["query_id"]: r["dist"] for r in search.pairs(six, od).collect()}
    assert {r["query_id"]: r["dist"] for r in hierarchy.label_query(label, od).collect()} == want
    assert {r["query_id"]: r["dist"] for r in hierarchy.label_query(hierarchy.pruned_labels(label), od).collect()} == want


def test_alternatives(spark, six):
    from roadloom.operators import alternatives as alt

    way = spark.createDataFrame([(0, 0, 0), (0, 1, 2), (0, 2, 3), (0, 3, 4)], "path_id long, idx long, node long")
    # 0-2-3-4: 10 + 3 + 2; the shortest 0-3 has 3, 2-4 has 1, 0-4 has 5
    assert sorted(map(tuple, alt.ubs_violations(way, six, 0.0).collect())) == [(0, 0, 2), (0, 1, 3)]
    od = spark.createDataFrame([(0, 0, 4)], "query_id long, src long, dst long")
    assert alt.penalty_alternatives(six, od).where("alternative = 0").first()["length"] == 5
    from pyspark.sql import functions as F

    two = six.withColumn("weight2", F.when(F.col("edge_id") == 0, 1).otherwise(4).cast("long"))
    assert sorted(map(tuple, alt.pareto(two, od).drop("query_id").collect())) == [(5, 12), (11, 5)]
    assert [r["node_id"] for r in alt.dfs_order(six).orderBy("rank").collect()] == [0, 1, 3, 4, 2]


def test_many_intervals(spark):
    from roadloom.operators import coop

    f = spark.createDataFrame([(0, 0, 0, 50), (0, 1, 40_000_000, 10), (0, 2, 86_400_000, 50)], "edge_id long, idx long, dep long, tt long")
    many = spark.range(100_010).selectExpr("id as interval_id", "10000000L as start", "80000000L as end")
    assert ttf.interval_minima(f, many).where("lowest = 10").count() == 100_010
    metrics = spark.range(10_010).selectExpr("id as metric_id", "0L as start", "86400000L - id as end")
    q = spark.createDataFrame([(1, 0, 1000)], "query_id long, departure long, latest long")
    assert coop.tightest_metric(q, metrics).first()["metric_id"] == 10_009
