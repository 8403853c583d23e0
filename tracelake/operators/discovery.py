"""Discovery of directly-follows graphs, profiles, footprints, trees and skeletons as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.keys import ACT, CASE, IDX, START, TS, by_case, seconds, traces


def dfg(log: DataFrame, window: int = 1, once_per_case: bool = False) -> DataFrame:
    """source, target, n.  ``window`` is the distance of the two events."""
    x = log.select(CASE, F.col(ACT).alias("source"), F.lead(ACT, window).over(by_case()).alias("target")).filter("target is not null")
    x = x.distinct() if once_per_case else x
    return x.groupBy("source", "target").agg(F.count("*").alias("n"))


def performance_dfg(log: DataFrame, start: str = TS) -> DataFrame:
    """Statistics of the seconds from an event's completion to the next one's start, negative ones as 0."""
    w = by_case()
    d = F.greatest(seconds(F.lead(start).over(w)) - seconds(TS), F.lit(0.0))
    x = log.select(F.col(ACT).alias("source"), F.lead(ACT).over(w).alias("target"), d.alias("_d")).filter("target is not null")
    return x.groupBy("source", "target").agg(F.count("*").alias("n"), F.avg("_d").alias("mean"), F.expr("percentile(_d, 0.5)").alias("median"), F.min("_d").alias("min"), F.max("_d").alias("max"), F.sum("_d").alias("sum"), F.coalesce(F.stddev_samp("_d"), F.lit(0.0)).alias("stdev"))


def temporal_profile(log: DataFrame, start: str = TS) -> DataFrame:
    """source, target, mean, stdev of the seconds between ordered events that don't overlap."""
    a = log.select(CASE, F.col(IDX).alias("i"), F.col(ACT).alias("source"), seconds(TS).alias("_e"))
    b = log.select(CASE, F.col(IDX).alias("j"), F.col(ACT).alias("target"), seconds(start).alias("_s"))
    x = a.join(b, CASE).filter("i < j and _s >= _e").withColumn("_d", F.col("_s") - F.col("_e"))
    return x.groupBy("source", "target").agg(F.avg("_d").alias("mean"), F.coalesce(F.stddev_samp("_d"), F.lit(0.0)).alias("stdev"))


def footprints(edges: DataFrame) -> DataFrame:
    """source, target, relation of a graph's edges: sequence (one way) or parallel (both ways)."""
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), F.lit(True).alias("_b"))
    return edges.select("source", "target").join(back, ["source", "target"], "left").select("source", "target", F.when(F.col("_b"), "parallel").otherwise("sequence").alias("relation"))


def prefix_tree(log: DataFrame, most: int | None = None) -> DataFrame:
    """prefix, depth, n (cases through it), n_final (cases that end there); of cases cut to ``most`` activities, if given."""
    t = traces(log).select("seq" if most is None else F.slice("seq", 1, most).alias("seq"))
    v = t.groupBy("seq").agg(F.count("*").alias("n"))
    steps = v.select("seq", "n", F.explode(F.sequence(F.lit(1), F.size("seq"))).alias("depth"))
    return steps.groupBy(F.slice("seq", F.lit(1), F.col("depth")).alias("prefix"), "depth").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("depth") == F.size("seq"), F.col("n")).otherwise(0)).alias("n_final"))


def transition_system(log: DataFrame, window: int = 2, view: str = "sequence") -> DataFrame:
    """source, act, target, n: states are the last ``window`` activities as a sequence, multiset or set."""
    as_view = {"sequence": lambda x: x, "multiset": F.array_sort, "set": lambda x: F.array_sort(F.array_distinct(x))}[view]
    v = traces(log).groupBy("seq").agg(F.count("*").alias("n"))
    x = v.select("seq", "n", F.explode(F.sequence(F.lit(1), F.size("seq"))).alias("i"))
    past = lambda i: as_view(F.slice("seq", F.greatest(F.lit(1), i - window + 1), F.least(i, F.lit(window))))
    return x.select(past(F.col("i") - 1).alias("source"), F.element_at("seq", F.col("i")).alias("act"), past(F.col("i")).alias("target"), "n").groupBy("source", "act", "target").agg(F.sum("n").alias("n"))


def skeleton(log: DataFrame, noise: float = 0.0) -> DataFrame:
    """relation, source, target of a log skeleton: equivalence, always_after, always_before,
    never_together, directly_follows.

    A pair is kept if its count reaches the source's *occurrences* (less the noise): equivalence
    adds the occurrences of cases with equal counts, after and before count a case once, direct succession each time.
    """
    c = log.groupBy(CASE, ACT).agg(F.count("*").alias("n"), F.min(IDX).alias("lo"), F.max(IDX).alias("hi"))
    total = log.groupBy(ACT).agg(F.count("*").alias("all"))
    a = c.select(CASE, F.col(ACT).alias("source"), F.col("n").alias("n1"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"))
    b = c.select(CASE, F.col(ACT).alias("target"), F.col("n").alias("n2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    both = a.join(b, CASE).filter("source != target").groupBy("source", "target").agg(
        F.count("*").alias("together"),
        F.sum(F.when(F.col("n1") == F.col("n2"), F.col("n1")).otherwise(0)).alias("equal"),
        F.count_if(F.col("lo1") < F.col("hi2")).alias("after"),
        F.count_if(F.col("lo2") < F.col("hi1")).alias("before"),
    )
    acts = total.select(F.col(ACT).alias("source"), (F.col("all") * F.lit(1.0 - noise)).alias("wanted"), "all")
    others = total.select(F.col(ACT).alias("target"))
    pairs = acts.join(F.broadcast(others), F.col("source") != F.col("target"))  # pairs of activities, not of events
    x = pairs.join(both, ["source", "target"], "left").fillna(0)
    direct = dfg(log).join(acts, "source").filter("n >= wanted").select(F.lit("directly_follows").alias("relation"), "source", "target")
    rule = lambda name, condition: x.filter(condition).select(F.lit(name).alias("relation"), "source", "target")
    return rule("equivalence", "equal >= wanted").unionByName(rule("always_after", "after >= wanted")).unionByName(rule("always_before", "before >= wanted")).unionByName(rule("never_together", "all - together >= wanted")).unionByName(direct)


def clean_noise(edges: DataFrame, threshold: float) -> DataFrame:
    """Edges of at least a share of the largest edge at either end (the lesser of the two)."""
    ends = edges.select(F.col("source").alias("act"), "n").union(edges.select("target", "n")).groupBy("act").agg(F.max("n").alias("m"))
    x = edges.join(ends.select(F.col("act").alias("source"), F.col("m").alias("m1")), "source").join(ends.select(F.col("act").alias("target"), F.col("m").alias("m2")), "target")
    return x.filter(F.col("n") >= threshold * F.least("m1", "m2")).select("source", "target", "n")


def dependency(edges: DataFrame) -> DataFrame:
    """source, target, dependency: (ab - ba) / (ab + ba + 1), for loops aa / (aa + 1)."""
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), F.col("n").alias("m"))
    x = edges.join(back, ["source", "target"], "left").fillna(0, ["m"])
    return x.select("source", "target", F.when(F.col("source") == F.col("target"), F.col("n") / (F.col("n") + 1)).otherwise((F.col("n") - F.col("m")) / (F.col("n") + F.col("m") + 1)).alias("dependency"))


def footprint_deviations(log_edges: DataFrame, model: DataFrame) -> DataFrame:
    """Edges of a log that a model's footprints (source, target) don't have."""
    return log_edges.join(model.select("source", "target").distinct(), ["source", "target"], "left_anti")


def temporal_deviations(log: DataFrame, profile: DataFrame, zeta: float = 1.0, start: str = TS) -> DataFrame:
    """case_id, source, target, seconds: pairs further than ``zeta`` deviations from their mean."""
    a = log.select(CASE, F.col(IDX).alias("i"), F.col(ACT).alias("source"), seconds(TS).alias("_e"))
    b = log.select(CASE, F.col(IDX).alias("j"), F.col(ACT).alias("target"), seconds(start).alias("_s"))
    x = a.join(b, CASE).filter("i < j and _s >= _e").join(F.broadcast(profile), ["source", "target"]).withColumn("seconds", F.col("_s") - F.col("_e"))
    far = F.abs(F.col("seconds") - F.col("mean"))
    return x.filter(F.when(F.col("stdev") == 0, far > 0).otherwise(far > zeta * F.col("stdev"))).select(CASE, "source", "target", "seconds")
