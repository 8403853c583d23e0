"""Construction, sorting, sampling and reshaping of logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.functions.keys import ACT, CASE, IDX, TS, by_case, first_of, traces


def format_log(df: DataFrame, case: str, act: str, ts: str, order: tuple[str, ...] = (), ts_format: str | None = None) -> DataFrame:
    """Canonical columns from any table; rows without case, activity or time go.
    ``order`` breaks ties of time in place of an input position, which Spark doesn't have."""
    when = F.to_timestamp(ts, ts_format) if ts_format else F.col(ts).cast("timestamp")
    x = df.withColumn(CASE, F.col(case).cast("string")).withColumn(ACT, F.col(act).cast("string")).withColumn(TS, when).dropna(subset=[CASE, ACT, TS])
    return x.withColumn(IDX, F.row_number().over(Window.partitionBy(CASE).orderBy(TS, *order)).cast("long") - 1)


def from_trace_strings(spark: SparkSession, strings: list[str], separator: str = ",") -> DataFrame:
    """A log from texts such as "A,B,C"; times are a second apart from 10,000,000 s after the epoch."""
    rows = [(str(i), s.split(separator)) for i, s in enumerate(strings)]
    x = spark.createDataFrame(rows, "case_id string, seq array<string>").select(CASE, F.posexplode("seq").alias(IDX, ACT))
    return x.withColumn(IDX, F.col(IDX).cast("long")).withColumn(TS, F.timestamp_seconds(F.lit(10_000_000) + F.col(IDX)))


def classifier(log: DataFrame, columns: list[str], target: str = "classifier") -> DataFrame:
    """Values joined with + ; null where any is missing."""
    whole = F.concat_ws("+", *[F.col(c).cast("string") for c in columns])
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull()
    return log.withColumn(target, F.when(~missing, whole))


def variants(log: DataFrame) -> DataFrame:
    """seq, n: distinct sequences and their cases."""
    return traces(log).groupBy("seq").agg(F.count("*").alias("n"))


def sort_by_time(log: DataFrame) -> DataFrame:
    """Places anew by time, ties in their old order."""
    return log.withColumn(IDX, F.row_number().over(Window.partitionBy(CASE).orderBy(TS, IDX)).cast("long") - 1)


def sample_cases(log: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Exactly n cases (or all), drawn by hash without replacement."""
    chosen = log.select(CASE).distinct().orderBy(F.xxhash64(CASE, F.lit(seed)), CASE).limit(n)
    return log.join(chosen, CASE, "left_semi")


def sample_events(log: DataFrame, n: int, seed: int = 0) -> DataFrame:
    return log.orderBy(F.xxhash64(CASE, IDX, F.lit(seed)), CASE, IDX).limit(n)


def artificial_start_end(log: DataFrame, start: str = "▶", end: str = "■") -> DataFrame:
    """Adds an event a second before each case's first time and one a second after its last."""
    edge = log.groupBy(CASE).agg(F.min(TS).alias("lo"), F.max(TS).alias("hi"), F.max(IDX).alias("n"))
    second = F.expr("INTERVAL 1 SECOND")
    more = edge.select(CASE, F.explode(F.array(
        F.struct(F.lit(0).cast("long").alias(IDX), F.lit(start).alias(ACT), (F.col("lo") - second).alias(TS)),
        F.struct((F.col("n") + 2).alias(IDX), F.lit(end).alias(ACT), (F.col("hi") + second).alias(TS)),
    )).alias("x")).select(CASE, "x.*")
    return log.select(CASE, (F.col(IDX) + 1).alias(IDX), ACT, TS).unionByName(more)


def to_lifecycle(log: DataFrame) -> DataFrame:
    """Each interval as a start and a complete event."""
    x = log.select(CASE, IDX, ACT, F.explode(F.array(
        F.struct(F.col("start_ts").alias(TS), F.lit("start").alias("lifecycle"), F.lit(0).alias("_k")),
        F.struct(F.col(TS).alias(TS), F.lit("complete").alias("lifecycle"), F.lit(1).alias("_k")),
    )).alias("x")).select(CASE, IDX, ACT, "x.*")
    w = Window.partitionBy(CASE).orderBy(TS, IDX, "_k")
    return x.withColumn("_new", F.row_number().over(w).cast("long") - 1).drop(IDX, "_k").withColumnRenamed("_new", IDX)


def to_interval(log: DataFrame) -> DataFrame:
    """Pairs each complete event with the oldest start of its activity in its case that is still open.

    The n-th complete takes the n-th start as long as that start comes before it; this is the
    queue's rule when no complete comes without an open start, and such a complete (start after
    it, or none) is its own interval.
    """
    n = F.row_number().over(Window.partitionBy(CASE, ACT, "lifecycle").orderBy(IDX))
    x = log.filter(F.col("lifecycle").isin("start", "complete")).withColumn("_n", n)
    starts = x.filter("lifecycle = 'start'").select(CASE, ACT, "_n", F.col(TS).alias("_s"), F.col(IDX).alias("_si"))
    ends = x.filter("lifecycle = 'complete'")
    joined = ends.join(starts, [CASE, ACT, "_n"], "left")
    return joined.withColumn("start_ts", F.when(F.col("_si") < F.col(IDX), F.col("_s")).otherwise(F.col(TS))).drop("_s", "_si", "_n", "lifecycle")


def graph_edges(log: DataFrame) -> DataFrame:
    """source, target, kind: events belong to cases and follow each other."""
    event = F.concat_ws("/", CASE, IDX)
    belongs = log.select(event.alias("source"), F.col(CASE).alias("target"), F.lit("belongs_to").alias("kind"))
    nxt = log.withColumn("_n", F.lead(IDX).over(by_case())).filter("_n is not null").select(event.alias("source"), F.concat_ws("/", CASE, "_n").alias("target"), F.lit("directly_follows").alias("kind"))
    return belongs.unionByName(nxt)


def case_attributes(log: DataFrame, columns: list[str]) -> DataFrame:
    """One row a case with the attributes of its first event."""
    return log.groupBy(CASE).agg(*[first_of(c).alias(c) for c in columns])


def shorter(log: DataFrame, length: int) -> DataFrame:
    """At most the first events of each case."""
    return log.filter(F.col(IDX) < length)
