"""Further operators: graph filters, roles, subcontracting, batches, entropy by activity, business hours, transport distance."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.keys import ACT, CASE, IDX, RES, START, TS, seconds, traces
from tracelake.functions.layout import spread
from tracelake.functions.shipping import ship_package

Graph = tuple[Counter, Counter, Counter]


def _reach(edges, sources: set, back: bool = False) -> set:
    seen, stack = set(sources), list(sources)
    while stack:
        x = stack.pop()
        for a, b in edges:
            a, b = (b, a) if back else (a, b)
            if a == x and b not in seen:
                seen.add(b)
                stack.append(b)
    return seen


def on_path(graph: Graph) -> set:
    """Activities on some way from a start to an end."""
    edges, starts, ends = graph
    return _reach(edges, set(starts)) & _reach(edges, set(ends), True)


def _restrict(graph: Graph, acts: set) -> Graph:
    edges, starts, ends = graph
    return Counter({e: n for e, n in edges.items() if set(e) <= acts}), Counter({a: n for a, n in starts.items() if a in acts}), Counter({a: n for a, n in ends.items() if a in acts})


def to_activity(graph: Graph, act: str) -> Graph:
    """``act`` becomes the only end; what isn't on a way to it goes."""
    edges, starts, _ = graph
    keep = _reach(edges, set(starts)) & _reach(edges, {act}, True)
    e, s, _ = _restrict(graph, keep)
    return e, s, Counter({act: sum(n for (_, b), n in edges.items() if b == act) + starts.get(act, 0)})


def from_activity(graph: Graph, act: str) -> Graph:
    edges, _, ends = graph
    keep = _reach(edges, {act}) & _reach(edges, set(ends), True)
    e, _, t = _restrict(graph, keep)
    return e, Counter({act: sum(n for (a, _), n in edges.items() if a == act) + ends.get(act, 0)}), t


def containing(graph: Graph, act: str) -> Graph:
    return _restrict(graph, _reach(graph[0], {act}) | _reach(graph[0], {act}, True))


def activities_percentage(graph: Graph, share: float) -> Graph:
    """The most frequent share of activities; a rarer one stays if, without it, a kept one
    would have no way from start to end."""
    edges, starts, ends = graph
    into, out = Counter(starts), Counter(ends)
    for (a, b), n in edges.items():
        into[b] += n
        out[a] += n
    acts = {a for e in edges for a in e} | set(starts) | set(ends)
    size = {a: max(into[a], out[a]) for a in acts}
    order = sorted(acts, key=lambda a: (-size[a], a))
    kept = max(1, int(np.ceil(len(order) * share))) if order else 0
    must, now = set(order[:kept]), set(order)
    for a in reversed(order[kept:]):
        trial = _restrict(graph, now - {a})
        if must <= on_path(trial):
            now.discard(a)
    return _restrict(graph, now)


def paths_percentage(graph: Graph, share: float) -> Graph:
    """The most frequent share of edges (start and end ones too), and those that keep all activities connected."""
    edges, starts, ends = graph
    every = [(n, 0, e) for e, n in edges.items()] + [(n, 1, a) for a, n in starts.items()] + [(n, 2, a) for a, n in ends.items()]
    every.sort(key=lambda x: (-x[0], x[1], str(x[2])))
    acts = {a for e in edges for a in e} | set(starts) | set(ends)
    e, s, t = Counter(edges), Counter(starts), Counter(ends)
    for _, kind, key in reversed(every[int(np.ceil(len(every) * share)) :]):
        part = (e, s, t)[kind]
        n = part.pop(key)
        if on_path((e, s, t)) != acts:
            part[key] = n
    return e, s, t


def roles(log: DataFrame, threshold: float = 0.65) -> list[tuple[list[str], dict[str, int]]]:
    """Groups of activities whose resources are alike (weighted Jaccard), merged greedily; with the resources' counts."""
    counts: dict[str, Counter] = {}
    for r in log.groupBy(ACT, RES).agg(F.count("*").alias("n")).orderBy(ACT, RES).collect():
        counts.setdefault(r[ACT], Counter())[r[RES]] = r["n"]
    groups = [([a], c) for a, c in sorted(counts.items())]

    def alike(x: Counter, y: Counter) -> float:
        p, q = sum(x.values()), sum(y.values())
        keys = set(x) | set(y)
        least = sum(min(x[k] / p, y[k] / q) for k in keys)
        most = sum(max(x[k] / p, y[k] / q) for k in keys)
        return least / most if most else 0.0

    while True:
        best = max(((alike(groups[i][1], groups[j][1]), -i, -j) for i in range(len(groups)) for j in range(i + 1, len(groups))), default=(0, 0, 0))
        if best[0] <= threshold:
            return [(sorted(a), dict(c)) for a, c in groups]
        i, j = -best[1], -best[2]
        groups[i] = (groups[i][0] + groups[j][0], groups[i][1] + groups[j][1])
        del groups[j]


def subcontracting(log: DataFrame, n: int = 2) -> DataFrame:
    """source, target, weight: resources that stand between a resource and its return n steps on, by cases."""
    w = Window.partitionBy(CASE).orderBy(IDX)
    x = log.select(CASE, IDX, F.col(RES).alias("source"), F.lead(RES, n).over(w).alias("_r"), F.array(*[F.lead(RES, i).over(w) for i in range(1, n)]).alias("_between")).filter("source = _r")
    pairs = x.select(CASE, "source", F.explode("_between").alias("target")).filter("source != target")
    cases = log.agg(F.count_distinct(CASE).alias("cases"))
    return pairs.groupBy("source", "target").agg(F.count("*").alias("n")).join(F.broadcast(cases)).select("source", "target", (F.col("n") / F.col("cases")).alias("weight"))


def batches(log: DataFrame, gap: float = 900.0, least: int = 2) -> DataFrame:
    """act, res, n_events, kind of each batch: events of one activity and resource at most ``gap`` seconds apart.

    Kinds by precedence: simultaneous, start, end, sequential, concurrent.  The batches of one resource
    and activity come from windows over that pair alone, all in one order, where rows that come again stand side by side.
    """
    part = Window.partitionBy(RES, ACT).orderBy("s", "e", CASE)
    x = spread(log.select(ACT, RES, CASE, seconds(START).alias("s"), seconds(TS).alias("e")), RES, ACT)
    own = F.struct("s", "e", CASE)
    x = x.withColumn("_i", F.row_number().over(part)).withColumn("_p", F.lag(own).over(part)).filter((F.col("_i") == 1) | ~own.eqNullSafe(F.col("_p")))
    before = F.max("e").over(part.rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("_new", F.when(before.isNull() | (F.col("s") - before > gap), 1).otherwise(0))
    x = x.withColumn("_g", F.sum("_new").over(part.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.lag("e").over(part)
    x = x.withColumn("_touch", F.when((F.col("_new") == 1) | last.isNull() | (last <= F.col("s")), 0).otherwise(1))
    g = x.groupBy(ACT, RES, "_g").agg(F.count("*").alias("n_events"), (F.min("s") == F.max("s")).alias("_s"), (F.min("e") == F.max("e")).alias("_e"), F.sum("_touch").alias("_t")).filter(F.col("n_events") >= least)
    kind = F.when(F.col("_s") & F.col("_e"), "simultaneous").when(F.col("_s"), "start").when(F.col("_e"), "end").when(F.col("_t") == 0, "sequential").otherwise("concurrent")
    return g.select(ACT, RES, "n_events", kind.alias("kind"))


def activity_entropy(log: DataFrame) -> DataFrame:
    """act, entropy: of what follows and what precedes each activity, in bits, with artificial ends."""
    t = traces(log).select(F.concat(F.array(F.lit("▶")), "seq", F.array(F.lit("■"))).alias("s"))
    pairs = t.select(F.explode(F.arrays_zip(F.slice("s", F.lit(1), F.size("s") - 1).alias("a"), F.slice("s", F.lit(2), F.size("s") - 1).alias("b"))).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))
    one = lambda k: pairs.groupBy(F.col(k).alias(ACT)).agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("h"))
    return one("a").union(one("b")).filter(~F.col(ACT).isin("▶", "■")).groupBy(ACT).agg(F.sum("h").alias("entropy"))


def business_seconds(start: Column, end: Column, open_hour: int = 9, close_hour: int = 17, days: int = 5) -> Column:
    """Seconds within the week's slots between two times (wall clock), in closed form."""
    slot = (close_hour - open_hour) * 3600

    def upto(t: Column) -> Column:
        days_on = F.datediff(F.to_date(t), F.lit("1970-01-05").cast("date"))  # a Monday
        weeks, day = F.floor(days_on / 7), F.pmod(days_on, F.lit(7))
        clock = F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t) + F.pmod(F.unix_micros(t), F.lit(1_000_000)) / 1e6
        today = F.when(day < days, F.least(F.greatest(clock - open_hour * 3600, F.lit(0)), F.lit(slot))).otherwise(0)
        return weeks * days * slot + F.least(day, F.lit(days)) * slot + today

    return (upto(end) - upto(start)).cast("double")


def edit_distance(a: tuple[str, ...], b: tuple[str, ...]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def trace_distance(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    return edit_distance(a, b) / max(len(a), len(b)) if a or b else 0.0


def transport_distance(p: dict[tuple[str, ...], float], q: dict[tuple[str, ...], float]) -> float:
    """Least cost of moving one language's mass to another's, by successive shortest paths."""
    left, right = sorted(p), sorted(q)
    cost = np.array([[trace_distance(a, b) for b in right] for a in left])
    supply, demand = np.array([p[a] for a in left], float), np.array([q[b] for b in right], float)
    flow, total = np.zeros_like(cost), 0.0
    n, m = cost.shape
    while supply.max(initial=0) > 1e-12 and demand.max(initial=0) > 1e-12:
        dist_l, dist_r = np.where(supply > 1e-12, 0.0, np.inf), np.full(m, np.inf)
        from_r, from_l = np.full(m, -1), np.full(n, -1)
        for _ in range(n + m + 1):
            via = dist_l[:, None] + cost
            k = via.argmin(0)
            better = via[k, np.arange(m)] < dist_r - 1e-12
            dist_r[better], from_r[better] = via[k, np.arange(m)][better], k[better]
            back = np.where(flow > 1e-12, dist_r[None, :] - cost, np.inf)
            k = back.argmin(1)
            again = back[np.arange(n), k] < dist_l - 1e-12
            dist_l[again], from_l[again] = back[np.arange(n), k][again], k[again]
            if not better.any() and not again.any():
                break
        j = int(np.where(demand > 1e-12, dist_r, np.inf).argmin())
        path, at = [], j
        while True:
            i = int(from_r[at])
            path.append((i, at, 1))
            if from_l[i] < 0:
                break
            at = int(from_l[i])
            path.append((i, at, -1))
        amount = min([supply[i], demand[j], *[flow[a, b] for a, b, s in path if s < 0]])
        for a, b, s in path:
            flow[a, b] += s * amount
            total += s * amount * cost[a, b]
        supply[i] -= amount
        demand[j] -= amount
    return float(total)


def variant_distances(log: DataFrame, reference: list[str]) -> DataFrame:
    """seq, distance: each distinct variant's normalized distance to a reference, in workers."""
    ship_package(log.sparkSession)
    goal = tuple(reference)

    def run(parts):
        for part in parts:
            yield pd.DataFrame({"seq": part["seq"], "distance": [trace_distance(tuple(s), goal) for s in part["seq"]]})

    return traces(log).select("seq").distinct().mapInPandas(run, "seq array<string>, distance double")
