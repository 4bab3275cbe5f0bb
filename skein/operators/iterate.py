"""Cutting lineage between rounds of an iterative operator, and counting rows across tasks."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_folder(spark: SparkSession) -> None:
    """Checkpoints go to spark.checkpoint.dir; where that is unset on a local master, as in tests, to a temp folder."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="skein-checkpoints-"))


def settle(df: DataFrame) -> DataFrame:
    """df, computed once and kept in reliable storage."""
    ensure_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def dense_rank(df: DataFrame, by: str | list[str], name: str) -> DataFrame:
    """df with ``name``: the place from 1 in the order of ``by``.

    Rows are dealt out by ranges and counted within them; the ranges' sizes, a row a task, give what
    comes before each. So no task has to see all rows."""
    keys = [by] if isinstance(by, str) else by
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = settle(ranged.withColumn("_part", F.spark_partition_id()).withColumn(name, local + 1))
    sizes = {r["_part"]: r["count"] for r in placed.groupBy("_part").count().collect()}
    before, rows = 0, []
    for part in sorted(sizes):
        rows.append((part, before))
        before += sizes[part]
    offsets = df.sparkSession.createDataFrame(rows, "_part int, _before long")
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")
