"""Rows dealt into tasks by the size of the tables under them."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of table files for each task of a wide step: about a million lines of an order log.
TASK_BYTES = 16 * 2**20


def table_bytes(df: DataFrame) -> int:
    """Bytes of the files that a plan reads."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    plans = [leaves.apply(i) for i in range(leaves.size())]
    return sum(int(str(p.stats().sizeInBytes())) for p in plans if p.getClass().getSimpleName() == "LogicalRelation")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows with equal keys in one task, in more tasks than the session's where its number would make them larger than
    ``TASK_BYTES``, so that a task's memory doesn't grow with the tables.  Smaller tables are left to Spark."""
    n = -(-table_bytes(df) // TASK_BYTES)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df
