"""Streams that change tables, against the same work in one batch."""

from conftest import SMALL
from roadloom.fixtures import view
from roadloom.operators import coop
from roadloom.streaming import versions


def run(spark, schema, source, path, f):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream.writeStream.foreachBatch(f).option("checkpointLocation", path).trigger(availableNow=True).start().awaitTermination()


def test_cooperative_stream(spark, tmp_path):
    network = coop.init_capacity(view(spark, SMALL, "capacity").selectExpr("edge_id", "tail", "head", "dist_m", "ff_time", "50L as capacity_per_h"), 96)
    od = view(spark, SMALL, "orders").selectExpr("cast(o_orderkey as long) as query_id", "o_orderkey * 31L % 40 as src", "o_custkey * 17L % 150 as dst", "o_orderkey * 61L % 3600000 as departure").where("src <> dst").orderBy("departure", "query_id").limit(120)
    trips = od.toPandas()
    for k in range(3):  # one file after the other, in order of departure
        spark.createDataFrame(trips.iloc[k * 40 : k * 40 + 40]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run(spark, od.schema, f"{tmp_path}/in", f"{tmp_path}/check", versions.cooperative_trips(network, 900_000, f"{tmp_path}/out", f"{tmp_path}/state"))
    assert versions.versions(spark, f"{tmp_path}/out") == [0, 1, 2]
    want = {r["query_id"]: r["duration"] for r in coop.cooperative(network, od, 900_000).collect()}
    alone = {r["query_id"]: r["duration"] for r in coop.cooperative(network, od, 900_000, batch=1000).collect()}
    got = {r["query_id"]: r["duration"] for r in spark.read.parquet(*(f"{tmp_path}/out/v{v}" for v in range(3))).collect()}
    assert got == want and want != alone  # trips do slow each other


def test_metric_stream(spark, tmp_path):
    path = f"{tmp_path}/metric"
    versions.publish(spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "edge_id long, weight long"), path, 0)
    schema = "edge_id long, version int, weight long"
    for rows in ([(1, 1, 11), (9, 1, 5)], [(1, 2, 12), (1, 3, None), (2, 1, 21)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run(spark, schema, f"{tmp_path}/in", f"{tmp_path}/check", versions.metric_updater(path))
    assert versions.versions(spark, path) == [0, 1, 2]
    assert {tuple(r) for r in versions.current(spark, path).collect()} == {(1, None), (2, 21), (3, 30)}
    versions.metric_updater(path)(spark.createDataFrame([(1, 2, 12), (1, 3, None), (2, 1, 21)], schema), 1)  # a batch again
    assert {tuple(r) for r in versions.current(spark, path).collect()} == {(1, None), (2, 21), (3, 30)}
