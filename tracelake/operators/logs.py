"""Logs as a whole: other keys, streams of events, Arrow, and filters and orders by a caller's own functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.functions.keys import ACT, CASE, IDX, TS
from tracelake.functions.shipping import ship_package


def rebase(log: DataFrame, case: str = CASE, act: str = ACT, ts: str = TS) -> DataFrame:
    """The same events by other columns for case, activity and time; ties of time stay in their old order."""
    old = log.withColumnsRenamed({CASE: "_case", ACT: "_act", TS: "_ts", IDX: "_idx"})
    name = {CASE: "_case", ACT: "_act", TS: "_ts"}
    x = old.withColumn(CASE, F.col(name.get(case, case)).cast("string")).withColumn(ACT, F.col(name.get(act, act)).cast("string")).withColumn(TS, F.col(name.get(ts, ts)).cast("timestamp")).dropna(subset=[CASE, ACT, TS])
    return x.withColumn(IDX, F.row_number().over(Window.partitionBy(CASE).orderBy(TS, "_case", "_idx")).cast("long") - 1).drop("_case", "_act", "_ts", "_idx")


def to_stream(log: DataFrame) -> DataFrame:
    """Events in order of time over all cases (ties by case and place)."""
    return log.orderBy(TS, CASE, IDX)


def of_stream(events: DataFrame, order: str) -> DataFrame:
    """Cases of events whose column ``order`` has their arrival."""
    return events.withColumn(IDX, F.row_number().over(Window.partitionBy(CASE).orderBy(order)).cast("long") - 1)


def to_arrow(log: DataFrame) -> pa.Table:
    """The log as one Arrow table on the driver: for logs that fit there."""
    return log.toArrow()


def to_arrow_batches(log: DataFrame) -> Iterator[pa.RecordBatch]:
    """The log as Arrow batches on the driver, one partition at a time."""
    n = log.rdd.getNumPartitions()
    part = log.withColumn("_part", F.spark_partition_id())
    for i in range(n):
        yield from part.filter(F.col("_part") == i).drop("_part").toArrow().to_batches()


def of_arrow(spark: SparkSession, table: pa.Table | Iterable[pa.RecordBatch]) -> DataFrame:
    """A log from an Arrow table or batches."""
    return spark.createDataFrame(table if isinstance(table, pa.Table) else pa.Table.from_batches(list(table)))


def filter_events(log: DataFrame, condition: Column, renumber: bool = False) -> DataFrame:
    """Events that meet a condition, with their old places or new ones."""
    x = log.filter(condition)
    return x.withColumn(IDX, F.row_number().over(Window.partitionBy(CASE).orderBy(IDX)).cast("long") - 1) if renumber else x


def sort_events(log: DataFrame, key: Column, reverse: bool = False) -> DataFrame:
    """New places by a key within each case; ties stay in their old order either way."""
    return log.withColumn(IDX, F.row_number().over(Window.partitionBy(CASE).orderBy(key.desc() if reverse else key.asc(), IDX)).cast("long") - 1)


def filter_traces(log: DataFrame, predicate: Column | Callable[[pd.DataFrame], bool]) -> DataFrame:
    """Cases for which an aggregate condition holds, or a function of the case's events (in order) is true."""
    if isinstance(predicate, Column):
        keep = log.groupBy(CASE).agg(predicate.alias("_ok")).filter("_ok").select(CASE)
        return log.join(keep, CASE, "left_semi")
    ship_package(log.sparkSession)

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(IDX)
        return part if predicate(part) else part.iloc[:0]

    return log.groupBy(CASE).applyInPandas(one, log.schema)


def sort_traces(log: DataFrame, key: Column, reverse: bool = False) -> DataFrame:
    """case_id, key in the order of an aggregate key; ties by case."""
    return log.groupBy(CASE).agg(key.alias("key")).orderBy(F.desc("key") if reverse else F.asc("key"), CASE)


def last_of_case(log: DataFrame, attempt: str) -> DataFrame:
    """Of cases that come several times (told apart by a column) the last one's events."""
    top = F.max(attempt).over(Window.partitionBy(CASE))
    return log.withColumn("_top", top).filter(F.col(attempt) == F.col("_top")).drop("_top")


def events_of(log: DataFrame, case: str) -> DataFrame:
    """The events of one case, in order."""
    return log.filter(F.col(CASE) == case).orderBy(IDX)
