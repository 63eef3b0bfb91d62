"""Cutting lineage in iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint to the folder that spark.checkpoint.dir names; to a temporary one only in local mode.

    A checkpoint keeps its plan's estimated size, and joins multiply these: after rounds of joins they are numbers of millions
    of digits that cost the driver minutes. Where an estimate is beyond any size, a table is written there and read instead."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        base = sc.getConf().get("spark.checkpoint.dir")
        if not base:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="roadloom-")
        sc.setCheckpointDir(base)
    size = df._jdf.queryExecution().optimizedPlan().stats().simpleString().split(",")[0]
    if "E+" not in size:  # written with a unit: up to 2,048 EiB
        return df.checkpoint()
    path = f"{sc._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
