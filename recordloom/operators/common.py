"""Helpers of the operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of files a slot, up to which a table is spread over all slots before slow work on its rows; and bytes of them a task at least.
SPREAD_BYTES, TASK_BYTES = 16 << 20, 16 << 10
#: Bytes of rows, as they come to the driver, up to which a side of a join is broadcast without being asked for.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset on a single machine, as in tests, a new folder, which goes when the driver ends; on a cluster that is an error."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="recordloom-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
    if not context.getCheckpointDir():
        context.setCheckpointDir(where)
    return where


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the folder all executors share and read back: a short plan that outlives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, to be broadcast if its rows have at most ``most`` bytes as text; beyond, the planner picks the join. It is written and read back, so that measuring doesn't compute it twice."""
    df = saved(df)
    size = F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))) if df.columns else F.lit(0)
    return F.broadcast(df) if (df.agg(size.alias("n")).first()["n"] or 0) <= most else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` for work that is slow for each row: a small table in few files, or in few groups of rows, goes to all slots.

    A task reads whole groups of rows, a million of them or more, however few bytes they have. Large tables with
    partitions for all slots stay where they are, and so does what comes from a shuffle.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming:
        return df
    run = df._jdf.queryExecution()
    plan = run.executedPlan().toString()
    if "AdaptiveSparkPlan" in plan or "Exchange" in plan:
        return df
    size = int(str(run.optimizedPlan().stats().sizeInBytes()))
    tasks = min(4 * slots, size // TASK_BYTES + 1)
    few = run.toRdd().getNumPartitions() < min(slots, tasks)
    return df.repartition(tasks) if few or "FileScan" in plan and 1 < tasks and size < slots * SPREAD_BYTES else df


def with_row_index(df: DataFrame, *order: str, name: str = "row_index") -> DataFrame:
    """``df`` with 0-based places in the given order, without bringing all rows into one task.

    Rows are range-partitioned, sorted and written; the rows before each partition are told by a table of partitions.
    """
    local, part, before = f"__{name}", f"__{name}_part", f"__{name}_before"
    placed = saved(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(local, F.monotonically_increasing_id()))
    placed = placed.withColumn(part, F.shiftright(local, 33))
    counts = placed.groupBy(part).agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))  # of partitions, not of rows
    starts = counts.select(part, F.coalesce(earlier, F.lit(0)).alias(before))
    joined = placed.join(F.broadcast(starts), part)
    return joined.withColumn(name, (F.col(before) + F.col(local).bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop(local, part, before)
