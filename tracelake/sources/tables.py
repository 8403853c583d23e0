"""Logs from the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.functions.layout import spread


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _indexed(df: DataFrame, *order: str) -> DataFrame:
    """Adds idx, the place in the case (from 0), and drops the columns that only gave the order."""
    w = Window.partitionBy("case_id").orderBy(*order)
    return df.withColumn("idx", F.row_number().over(w).cast("long") - 1)


def click_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: a case is a user."""
    e = read(spark, sf_dir, "events")
    e = e.select(F.col("user_id").cast("string").alias("case_id"), F.col("event_type").alias("act"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    return _indexed(e, "ts", "event_id")


def line_log(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    """lineitem: a case is an order, the activity its return flag and status, the resource its supplier.  ``wide``: for steps
    that make several rows of each where its case lies."""
    x = read(spark, sf_dir, "lineitem")
    x = x.select(
        F.col("l_orderkey").cast("string").alias("case_id"), F.concat("l_returnflag", "l_linestatus").alias("act"), F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.col("l_suppkey").cast("string").alias("res"), "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("quantity"),
    )
    return _indexed(spread(x, "case_id") if wide else x, "ts", "l_linenumber", "l_partkey", "l_suppkey").drop("l_linenumber", "l_partkey", "l_suppkey")


def interval_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line log with start_ts, the earlier of order and ship date, and ts, the later."""
    start = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("case_id"), F.col("o_orderdate").cast("timestamp").alias("_o"))
    log = line_log(spark, sf_dir).join(start, "case_id")
    return log.select("case_id", "idx", "act", "res", F.least("_o", "ts").alias("start_ts"), F.greatest("_o", "ts").alias("ts"))


def chat_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations: a case is a conversation, the activity its role."""
    x = read(spark, sf_dir, "conversations")
    x = x.select(F.col("conv_id").cast("string").alias("case_id"), F.col("role").alias("act"), F.timestamp_seconds("turn").alias("ts"), "turn")
    return _indexed(x, "turn").drop("turn")


@dataclass(frozen=True)
class Ocel:
    """An object-centric log: events (eid, act, ts), objects (oid, type), e2o (eid, oid, qualifier),
    o2o (oid, oid2, qualifier).  Events are in order of eid.

    Further columns of events and objects are their attributes.  ``changes`` has the objects' attribute values in time (oid, ts,
    field, value); ``relations`` is e2o with what it refers to (eid, oid, type, act, ts, perhaps qualifier), where a
    source has it at hand, so that operators need not join for it.  ``whole`` gives rows (eid, act, ts, objects
    array<struct<oid, type>>) in which every row of an event has all of the event's objects, or none where the source can't say so; where they have a further column ``plain``,
    an event's objects are of distinct types and in the same order in all its rows.
    """

    events: DataFrame
    objects: DataFrame
    e2o: DataFrame
    o2o: DataFrame
    changes: DataFrame | None = None
    relations: DataFrame | None = None
    whole: Callable[[], DataFrame | None] | None = None


def order_ocel(spark: SparkSession, sf_dir: str) -> Ocel:
    """Lines as events; orders, parts and suppliers as objects; orders related to customers."""
    x = read(spark, sf_dir, "lineitem")
    # a global number needs one total order; it is taken from the columns themselves, so no task sees all rows
    eid = F.concat_ws("-", F.date_format("l_shipdate", "yyyyMMdd"), F.lpad(F.col("l_orderkey").cast("string"), 9, "0"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), F.lpad(F.col("l_partkey").cast("string"), 9, "0"), F.lpad(F.col("l_suppkey").cast("string"), 7, "0"))
    x = x.select(eid.alias("eid"), F.concat("l_returnflag", "l_linestatus").alias("act"), F.col("l_shipdate").cast("timestamp").alias("ts"), F.col("l_quantity").alias("quantity"), "l_orderkey", "l_partkey", "l_suppkey")
    events = spread(x, "eid").groupBy("eid").agg(F.min("act").alias("act"), F.min("ts").alias("ts"), F.min("quantity").alias("quantity"))
    objects_of = F.array(*[F.struct(F.concat(F.lit(p), F.col(c).cast("string")).alias("oid"), F.lit(t).alias("type")) for t, p, c in (("order", "o", "l_orderkey"), ("part", "p", "l_partkey"), ("supplier", "s", "l_suppkey"))])
    relations = x.select("eid", F.explode(objects_of).alias("x"), "act", "ts").select("eid", "x.oid", "x.type", "act", "ts", F.lit("").alias("qualifier"))
    o = read(spark, sf_dir, "orders")
    customers = o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("oid"), F.lit("customer").alias("type")).distinct()
    orders = o.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("oid"), F.col("o_orderpriority").alias("priority"))
    objects = relations.select("oid", "type").distinct().unionByName(customers).join(orders, "oid", "left")
    o2o = o.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("oid"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("oid2"), F.lit("placed by").alias("qualifier"))
    status = o.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("oid"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.lit("status").alias("field"), F.col("o_orderstatus").alias("value"))

    def whole():
        # an id tells the row's objects as long as its keys fit their places
        fit = F.lit(True)
        for c, most in (("l_orderkey", 9), ("l_linenumber", 2), ("l_partkey", 9), ("l_suppkey", 7)):
            fit = fit & F.coalesce(F.col(c).between(0, 10**most - 1), F.lit(False))
        odd = read(spark, sf_dir, "lineitem").agg(F.count_if(~(fit & F.col("l_shipdate").isNotNull())).alias("n")).first()["n"]
        return None if odd else x.select("eid", "act", "ts", objects_of.alias("objects"), F.lit(True).alias("plain"))

    return Ocel(events, objects, relations.select("eid", "oid", "qualifier"), o2o, status, relations, whole)
