"""Filters of classic logs.  ``retain=False`` gives the complement of cases (or events).

A missing value never matches; so it is out of a retained result and stays in a complement.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.keys import ACT, CASE, IDX, RES, TS, by_case, first_of, kept, last_of, seconds, traces


def _cases(log: DataFrame, predicate: Column) -> DataFrame:
    return log.groupBy(CASE).agg(predicate.alias("_ok")).filter("_ok")


def event_attribute_values(log: DataFrame, column: str, values: list, retain: bool = True, level: str = "events") -> DataFrame:
    """Events whose value is among ``values``; at the level of cases, cases with such an event."""
    hit = F.coalesce(F.col(column).isin(values), F.lit(False))
    if level == "events":
        return log.filter(hit if retain else ~hit)
    return kept(log, _cases(log, F.bool_or(hit)), retain)


def case_attribute_values(log: DataFrame, column: str, values: list, retain: bool = True) -> DataFrame:
    """Cases whose attribute, taken at their first event, is among ``values``."""
    return kept(log, _cases(log, F.coalesce(first_of(column).isin(values), F.lit(False))), retain)


def relative_occurrence(log: DataFrame, column: str, share: float, level: str = "cases") -> DataFrame:
    """Events whose value occurs in at least a share of the cases (or of the events)."""
    n = F.count_distinct(CASE) if level == "cases" else F.count("*")
    total = log.agg(n.alias("_total"))
    often = log.filter(F.col(column).isNotNull()).groupBy(column).agg(n.alias("_n")).join(F.broadcast(total)).filter(F.col("_n") >= share * F.col("_total"))
    return log.join(often.select(column), column, "left_semi")


def start_activities(log: DataFrame, acts: list[str], retain: bool = True) -> DataFrame:
    return kept(log, _cases(log, first_of(ACT).isin(acts)), retain)


def end_activities(log: DataFrame, acts: list[str], retain: bool = True) -> DataFrame:
    return kept(log, _cases(log, last_of(ACT).isin(acts)), retain)


def variants(log: DataFrame, wanted: list[list[str]], retain: bool = True) -> DataFrame:
    one = reduce(lambda a, b: a | b, [F.col("seq") == F.array(*map(F.lit, v)) for v in wanted], F.lit(False))
    return kept(log, traces(log).filter(one), retain)


def variants_top_k(log: DataFrame, k: int) -> DataFrame:
    """Cases of the k most frequent variants; ties take the greater sequence first."""
    t = traces(log)
    top = t.groupBy("seq").count().orderBy(F.desc("count"), F.desc("seq")).limit(k)
    return kept(log, t.join(top, "seq", "left_semi"))


def variants_by_coverage(log: DataFrame, share: float) -> DataFrame:
    """Cases of variants that each cover at least a share of all cases."""
    t = traces(log)
    total = t.agg(F.count("*").alias("_total"))
    often = t.groupBy("seq").count().join(F.broadcast(total)).filter(F.col("count") >= share * F.col("_total"))
    return kept(log, t.join(often, "seq", "left_semi"))


def _pair_hits(log: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    nxt = F.col("_next")
    return reduce(lambda a, b: a | b, [(F.col(ACT) == a) & (nxt == b) for a, b in pairs], F.lit(False))


def directly_follows(log: DataFrame, pairs: list[tuple[str, str]], retain: bool = True) -> DataFrame:
    """Cases with any of the adjacent pairs."""
    x = log.withColumn("_next", F.lead(ACT).over(by_case()))
    return kept(log, _cases(x, F.bool_or(F.coalesce(_pair_hits(x, pairs), F.lit(False)))), retain)


def eventually_follows(log: DataFrame, pattern: list[str], retain: bool = True) -> DataFrame:
    """Cases that hold the activities in this order, others between them allowed."""
    p = F.array(*map(F.lit, pattern))
    reached = F.aggregate("seq", F.lit(0), lambda i, a: F.when(F.try_element_at(p, i + 1) == a, i + 1).otherwise(i))
    return kept(log, traces(log).filter(reached >= len(pattern)), retain)


def activities_rework(log: DataFrame, act: str, least: int = 2, retain: bool = True) -> DataFrame:
    return kept(log, _cases(log, F.count_if(F.col(ACT) == act) >= least), retain)


def _boundary(log: DataFrame, act: str, occurrence: str) -> DataFrame:
    at = F.min(IDX) if occurrence == "first" else F.max(IDX)
    return log.filter(F.col(ACT) == act).groupBy(CASE).agg(at.alias("_at"))


def prefixes(log: DataFrame, act: str, strict: bool = True, occurrence: str = "first") -> DataFrame:
    """What comes before an activity in the cases that have it (with it, unless strict).
    Cases left without events aren't rows of the result; ``prefix_cases`` has them all."""
    x = log.join(_boundary(log, act, occurrence), CASE)
    return x.filter(F.col(IDX) < F.col("_at") if strict else F.col(IDX) <= F.col("_at")).drop("_at")


def prefix_cases(log: DataFrame, act: str) -> DataFrame:
    return log.filter(F.col(ACT) == act).select(CASE).distinct()


def suffixes(log: DataFrame, act: str, strict: bool = True, occurrence: str = "first") -> DataFrame:
    x = log.join(_boundary(log, act, occurrence), CASE)
    return x.filter(F.col(IDX) > F.col("_at") if strict else F.col(IDX) >= F.col("_at")).drop("_at")


def between(log: DataFrame, starts: list[str], ends: list[str], separator: str = "##@@") -> DataFrame:
    """Each stretch from a start activity to the next end activity as a case of its own.
    A later start inside an open stretch doesn't begin another; a shared boundary ends one and begins the next only where the sets meet."""
    same = set(starts) == set(ends)
    seq = F.array_sort(F.collect_list(F.struct(F.col(IDX).alias("i"), F.col(ACT).alias("a"))))
    none = F.lit(None).cast("long")
    state = F.struct(none.alias("from"), F.array().cast("array<struct<lo:bigint,hi:bigint>>").alias("done"))

    def step(s, e):
        starts_here, ends_here = e["a"].isin(starts), e["a"].isin(ends)
        closes = s["from"].isNotNull() & ends_here
        opened = F.when(closes, e["i"] if same else none).when(s["from"].isNull() & starts_here, e["i"]).otherwise(s["from"])
        done = F.when(closes, F.concat(s["done"], F.array(F.struct(s["from"].alias("lo"), e["i"].alias("hi"))))).otherwise(s["done"])
        return F.struct(opened.alias("from"), done.alias("done"))

    found = log.groupBy(CASE).agg(F.aggregate(seq, state, step)["done"].alias("_d")).select(CASE, F.posexplode("_d").alias("_n", "_r"))
    x = log.join(found, CASE).filter(F.col(IDX).between(F.col("_r.lo"), F.col("_r.hi")))
    return x.withColumn(CASE, F.concat(CASE, F.lit(separator), F.col("_n").cast("string"))).withColumn(IDX, F.col(IDX) - F.col("_r.lo")).drop("_n", "_r")


def four_eyes(log: DataFrame, a: str, b: str, retain: bool = True) -> DataFrame:
    """Cases whose two activities have resources, none of them shared; the violations otherwise."""
    sets = log.groupBy(CASE).agg(F.collect_set(F.when(F.col(ACT) == a, F.col(RES))).alias("x"), F.collect_set(F.when(F.col(ACT) == b, F.col(RES))).alias("y"))
    both = sets.filter((F.size("x") > 0) & (F.size("y") > 0))
    return kept(log, both.filter(~F.arrays_overlap("x", "y") if retain else F.arrays_overlap("x", "y")))


def different_resources(log: DataFrame, act: str, retain: bool = True) -> DataFrame:
    """Cases in which an activity has more than one resource; at most one otherwise."""
    n = F.count_distinct(F.when(F.col(ACT) == act, F.col(RES)))
    return kept(log, _cases(log, n > 1 if retain else n <= 1))


def trace_segments(log: DataFrame, pattern: list[str], retain: bool = True) -> DataFrame:
    """Cases whose whole sequence matches activities and ``...`` (any number of events)."""
    size = len(pattern)
    reach0 = [i == 0 or all(p == "..." for p in pattern[:i]) for i in range(size + 1)]

    def step(state, a):
        cells = []
        for i in range(size + 1):
            if i == 0:
                cells.append(F.lit(False))
                continue
            p = pattern[i - 1]
            if p == "...":
                cells.append(cells[i - 1] | state[i] | state[i - 1])
            else:
                cells.append(state[i - 1] & (a == p))
        return F.array(*cells)

    end = F.aggregate("seq", F.array(*map(F.lit, reach0)), step)[size]
    return kept(log, traces(log).filter(end), retain)


def case_size(log: DataFrame, least: int, most: int, retain: bool = True) -> DataFrame:
    return kept(log, _cases(log, F.count("*").between(least, most)), retain)


def case_performance(log: DataFrame, least: float, most: float, retain: bool = True) -> DataFrame:
    """By seconds from the first event to the last, by place and not by time."""
    return kept(log, _cases(log, (seconds(last_of(TS)) - seconds(first_of(TS))).between(least, most)), retain)


def paths_performance(log: DataFrame, path: tuple[str, str], least: float, most: float, retain: bool = True) -> DataFrame:
    w = by_case()
    x = log.withColumn("_next", F.lead(ACT).over(w)).withColumn("_dt", seconds(F.lead(TS).over(w)) - seconds(TS))
    hit = (F.col(ACT) == path[0]) & (F.col("_next") == path[1]) & F.col("_dt").between(least, most)
    return kept(log, _cases(x, F.bool_or(F.coalesce(hit, F.lit(False)))), retain)


def time_range(log: DataFrame, begin: str, end: str, mode: str = "contained", retain: bool = True) -> DataFrame:
    """Modes: events, contained, intersecting, starting, completing."""
    lo, hi = F.to_timestamp(F.lit(begin)), F.to_timestamp(F.lit(end))
    inside = F.col(TS).between(lo, hi)
    if mode == "events":
        return log.filter(inside if retain else ~inside)
    first, last = first_of(TS), last_of(TS)
    ok = {"contained": (first >= lo) & (last <= hi), "intersecting": (first <= hi) & (last >= lo), "starting": first.between(lo, hi), "completing": last.between(lo, hi)}[mode]
    return kept(log, _cases(log, ok), retain)
