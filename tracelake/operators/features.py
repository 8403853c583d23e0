"""Tables for learning: features and targets of cases and events, bins of time, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.keys import ACT, CASE, IDX, TS, by_case, kept, last_of, seconds


def case_features(log: DataFrame, one_hot: dict[str, list[str]], numeric: list[str]) -> DataFrame:
    """case_id, a 0/1 column for each listed value, and each numeric attribute's last value."""
    hot = [F.max(F.when(F.col(c) == v, 1).otherwise(0)).alias(f"{c}_{v}") for c, vs in one_hot.items() for v in vs]
    return log.groupBy(CASE).agg(*hot, *[last_of(c).cast("double").alias(c) for c in numeric])


def targets(log: DataFrame) -> DataFrame:
    """case_id, idx, next_act, next_time and remaining_time in seconds (0 at a case's end)."""
    w = by_case()
    last = seconds(F.last(TS).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return log.select(CASE, IDX, F.lead(ACT).over(w).alias("next_act"), F.coalesce(seconds(F.lead(TS).over(w)) - seconds(TS), F.lit(0.0)).alias("next_time"), (last - seconds(TS)).alias("remaining_time"))


def weekly(log: DataFrame) -> DataFrame:
    """bin, n_cases, n_events, n_acts: by the week an event falls in."""
    return log.groupBy(F.date_format(F.date_trunc("week", TS), "yyyy-MM-dd").alias("bin")).agg(F.count_distinct(CASE).alias("n_cases"), F.count("*").alias("n_events"), F.count_distinct(ACT).alias("n_acts"))


def split(log: DataFrame, share: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Training and test log; training has floor(n * share) + 1 cases, in the order of their hash.

    A case's place comes from running counts over ranges of the hash, so no task sorts them all.
    """
    from tracelake.operators.attributes import running

    cases = log.select(CASE).distinct().withColumn("_h", F.xxhash64(CASE, F.lit(seed))).withColumn("_one", F.lit(1))
    n = cases.count()
    chosen = running(cases, "_h", "_one", "_place", (CASE,)).filter(F.col("_place") <= min(n, int(n * share) + 1)).select(CASE)
    return kept(log, chosen), kept(log, chosen, False)


def cube(features: DataFrame, x: str, y: str, divisions: int = 4) -> DataFrame:
    """x_bin, y_bin, n, mean_x: cases by right-closed bins of two numeric features (the lowest bin has the least value too)."""
    s = features.agg(*[f(c).alias(f"{n}_{c}") for c in (x, y) for n, f in (("lo", F.min), ("hi", F.max))])

    def place(c: str):
        lo, hi = F.col(f"lo_{c}"), F.col(f"hi_{c}")
        step = F.when(hi > lo, (hi - lo) / divisions).otherwise(F.lit(1.0))
        return F.greatest(F.lit(0), F.ceil((F.col(c) - lo) / step).cast("int") - 1)

    return features.join(F.broadcast(s)).groupBy(place(x).alias("x_bin"), place(y).alias("y_bin")).agg(F.count("*").alias("n"), F.avg(x).alias("mean_x"))
