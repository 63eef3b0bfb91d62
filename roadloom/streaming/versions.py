"""Tables that streams change batch by batch: metrics in versions, and cooperative trips with the use of the network.

A version is a folder `v<batch id>`; it is written before anything reads it, and a batch that is run again writes the same
version again, so a query that fails between two steps loses and repeats nothing. Readers take the highest version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.coop import cooperative
from .traces import apply_updates


def versions(spark: SparkSession, path: str) -> list[int]:
    """The finished versions under `path`, in order."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    names = [s.getPath().getName() for s in files.listStatus(root)]
    return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and files.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def publish(df: DataFrame, path: str, version: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/v{version}")


def current(spark: SparkSession, path: str, below: int | None = None) -> DataFrame:
    """The highest version (below `below`)."""
    found = [v for v in versions(spark, path) if below is None or v < below]
    if not found:
        raise ValueError(f"no version in {path}")
    return spark.read.parquet(f"{path}/v{found[-1]}")


def metric_updater(path: str) -> Callable[[DataFrame, int], None]:
    """For `foreachBatch` over updates (edge_id, version, weight): each batch makes the next version of the metric
    (edge_id, weight), whose first one is published as version 0. Customize the hierarchy from `current` afterwards."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        publish(apply_updates(current(batch.sparkSession, path, batch_id + 1), batch), path, batch_id + 1)

    return apply


def cooperative_trips(network: DataFrame, size: int, results: str, state: str) -> Callable[[DataFrame, int], None]:
    """For `foreachBatch` over trips (query_id, src, dst, departure): a batch's trips are answered in order of departure on
    the use that earlier batches have left; answers (query_id, duration) and uses (edge_id, bucket) go to versions of
    their own, so that the state is the sum of all versions below the batch's."""

    def route(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier = [v for v in versions(spark, state) if v < batch_id]
        used = spark.read.parquet(*[f"{state}/v{v}" for v in earlier]) if earlier else None
        answered = cooperative(network, batch, size, used=used)
        publish(answered.select("query_id", "duration", "uses"), results, batch_id)
        uses = spark.read.parquet(f"{results}/v{batch_id}").select(F.explode("uses").alias("u")).groupBy("u.edge_id", "u.bucket").agg(F.count(F.lit(1)).alias("used"))
        publish(uses, state, batch_id)

    return route
