"""Views whose rows are numbered."""

import duckdb
import pytest
from pyspark.sql import functions as F

from roadloom.fixtures import view, with_sql

LARGE = "/root/testdata/sf0.1"


@pytest.mark.parametrize("name", ["g_grid", "grid_order"])
def test_numbers_of_rows_without_one_task_for_all(spark, name):
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{LARGE}/part.parquet'")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = view(spark, LARGE, name)
        number = "edge_id" if name == "g_grid" else "rank"
        tasks = found.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count(number).alias("count"), F.max(number)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    most, total = max(r["count"] for r in tasks), sum(r["count"] for r in tasks)
    assert 4 * most <= 3 * total  # twenty ranges of nodes, four partitions
    want = con.execute(with_sql(f"select {', '.join(found.columns)} from {name}")).fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want)


@pytest.mark.parametrize("name", ["g_grid", "grid_order"])
def test_numbers_of_rows_with_gaps_between_ids(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute(f"copy (select p_partkey * 977 as p_partkey, p_size from '{LARGE}/part.parquet' where p_partkey < 400) to '{tmp_path}/part.parquet' (format parquet)")
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet'")
    found = view(spark, str(tmp_path), name)
    want = con.execute(with_sql(f"select {', '.join(found.columns)} from {name}")).fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want)
