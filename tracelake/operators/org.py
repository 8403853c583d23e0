"""Organizational mining: networks of resources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.keys import ACT, CASE, IDX, RES, by_case
from tracelake.functions.layout import spread
from tracelake.functions.shipping import ship_package


def handover(log: DataFrame, beta: float = 0.0) -> DataFrame:
    """source, target, weight: shares of all handovers; with ``beta`` also over longer distances, less each step."""
    if beta == 0:
        x = log.select(F.col(RES).alias("source"), F.lead(RES).over(by_case()).alias("target"), F.lit(1.0).alias("w")).filter("target is not null")
    else:
        a = log.select(CASE, F.col(IDX).alias("i"), F.col(RES).alias("source"))
        b = log.select(CASE, F.col(IDX).alias("j"), F.col(RES).alias("target"))
        x = a.join(b, CASE).filter("i < j").withColumn("w", F.pow(F.lit(beta), F.col("j") - F.col("i") - 1))
    g = x.groupBy("source", "target").agg(F.sum("w").alias("w"))
    total = g.agg(F.sum("w").alias("all"))
    return g.join(F.broadcast(total)).select("source", "target", (F.col("w") / F.col("all")).alias("weight"))


def working_together(log: DataFrame) -> DataFrame:
    """source, target, weight: cases of both, over the number of cases."""
    n = log.agg(F.count_distinct(CASE).alias("cases"))
    # a case's resources make each pair once, in one order; both come from its count
    x = spread(log.filter(F.col(CASE).isNotNull()).select(CASE, RES), CASE).groupBy(CASE).agg(F.sort_array(F.collect_set(RES)).alias("r")).filter("size(r) > 1")
    one = x.select("r", F.posexplode("r").alias("_i", "a")).select("a", F.explode(F.slice("r", F.col("_i") + 2, F.size("r"))).alias("b"))
    pairs = spread(one, "a", "b").groupBy("a", "b").agg(F.count("*").alias("n"))
    both = pairs.select("n", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("target")), F.struct(F.col("b").alias("source"), F.col("a").alias("target")))).alias("p"))
    return both.join(F.broadcast(n)).select("p.source", "p.target", (F.col("n") / F.col("cases")).alias("weight"))


def resource_activities(log: DataFrame) -> DataFrame:
    return log.groupBy(RES, ACT).agg(F.count("*").alias("n"))


#: Blocks of resources in ``activity_similarity``, and the most pairs that a task gives out at a time.
BLOCKS, AT_ONCE = 64, 1_000_000


def activity_similarity(log: DataFrame) -> DataFrame:
    """source, target, weight: Pearson's correlation of two resources' counts over all activities.

    Resources that share an activity make a pair each way (the missing counts are zeros).  The counts are few beside
    the pairs: every task has all of them in blocks, multiplies its own blocks by each and gives the pairs out, so no pair is shuffled.
    """
    ship_package(log.sparkSession)
    c = resource_activities(log).filter(F.col(RES).isNotNull())
    k = log.agg(F.count_distinct(ACT).cast("double").alias("k"))
    own = c.withColumn("n", F.col("n").cast("double")).groupBy(RES).agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"), F.collect_list(F.struct(ACT, "n")).alias("counts"))
    own = own.join(F.broadcast(k)).withColumn("v", F.col("k") * F.col("q") - F.col("s") * F.col("s")).filter("v > 0")
    blocks = own.groupBy(F.pmod(F.xxhash64(RES), F.lit(BLOCKS)).alias("b")).agg(F.collect_list(F.struct(RES, "counts", "s", "v", "k")).alias("x"))
    pairs = blocks.repartition(BLOCKS, "b").crossJoin(F.broadcast(blocks.select(F.col("b").alias("b2"), F.col("x").alias("x2"))))
    return pairs.mapInArrow(_correlations, "source string, target string, weight double")


def _correlations(batches):
    """Pairs of the resources of two blocks with their weights."""
    import numpy as np
    import pyarrow as pa

    def counts(block, place):
        m = np.zeros((len(block), len(place)))
        for i, r in enumerate(block):
            for x in r["counts"]:
                if x[ACT] in place:
                    m[i, place[x[ACT]]] = x["n"]
        return m

    for batch in batches:
        for at in range(batch.num_rows):
            one = batch.slice(at, 1).to_pylist()[0]
            x, y = (sorted(one[c], key=lambda r: r[RES]) for c in ("x", "x2"))
            acts = [{c[ACT] for r in block for c in r["counts"]} - {None} for block in (x, y)]
            place = {a: i for i, a in enumerate(sorted(acts[0] & acts[1]))}
            m, o = counts(x, place), counts(y, place)
            sources, targets = (pa.array([r[RES] for r in block], pa.string()) for block in (x, y))
            (s1, v1), (s2, v2) = (([np.array([r[c] for r in block]) for c in "sv"]) for block in (x, y))
            step = max(1, AT_ONCE // len(y))
            for a in range(0, len(x), step):
                dot = m[a : a + step] @ o.T
                weight = (x[0]["k"] * dot - s1[a : a + step, None] * s2) / np.sqrt(v1[a : a + step, None] * v2)
                shared = dot > 0
                if one["b"] == one["b2"]:
                    shared[np.arange(len(shared)), a + np.arange(len(shared))] = False
                i, j = np.nonzero(shared)
                yield pa.RecordBatch.from_arrays([sources.take(pa.array(i + a)), targets.take(pa.array(j)), pa.array(weight[i, j])], ["source", "target", "weight"])


def network(log: DataFrame, out_column: str, node_column: str, edge_column: str) -> DataFrame:
    """source, target, edge, n: each event leads to the next one (in order of time) with the same value of ``out_column``."""
    from pyspark.sql import Window

    w = Window.partitionBy(out_column).orderBy("ts", CASE, IDX)
    x = log.filter(F.col(out_column).isNotNull()).select(F.col(node_column).alias("source"), F.lead(node_column).over(w).alias("target"), F.col(edge_column).alias("edge")).filter("target is not null")
    return x.groupBy("source", "target", "edge").agg(F.count("*").alias("n"))
