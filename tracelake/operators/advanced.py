"""Further model operators: dependency nets, object-centric nets, edge-graph playout and alignment,
edit-distance alignment, noisy variant counts, trace profiles and clusters."""

from __future__ import annotations

import difflib
import heapq
import itertools
import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.keys import ACT, CASE, IDX, by_case, traces
from tracelake.functions.shipping import ship_package
from tracelake.operators import core, discovery, miners
from tracelake.operators import ocel as oc
from tracelake.operators.more import edit_distance
from tracelake.operators.nets import Net, Tree
from tracelake.sources.tables import Ocel


def heuristics_net(log: DataFrame, threshold: float = 0.5, noise: float = 0.05, loop2: float = 0.5) -> DataFrame:
    """source, target, n, dependency, kind (edge, loop1 or loop2) of a dependency net.

    Edges under a share of their ends' largest edge go first; then those under the threshold.
    """
    edges = discovery.clean_noise(discovery.dfg(log), noise)
    x = edges.join(discovery.dependency(edges), ["source", "target"])
    plain = x.filter(F.col("dependency") >= threshold).withColumn("kind", F.when(F.col("source") == F.col("target"), "loop1").otherwise("edge"))
    w = by_case()
    there = log.select(F.col(ACT).alias("source"), F.lead(ACT).over(w).alias("target"), F.lead(ACT, 2).over(w).alias("_c")).filter("source = _c and source != target").groupBy("source", "target").agg(F.count("*").alias("n"))
    back = there.select(F.col("target").alias("source"), F.col("source").alias("target"), F.col("n").alias("m"))
    short = there.join(back, ["source", "target"], "left").fillna(0, ["m"]).select("source", "target", "n", ((F.col("n") + F.col("m")) / (F.col("n") + F.col("m") + 1)).alias("dependency"), F.lit("loop2").alias("kind"))
    return plain.select("source", "target", "n", "dependency", "kind").unionByName(short.filter(F.col("dependency") >= loop2))


def object_centric_nets(log: Ocel, types: list[str]) -> dict[str, Tree]:
    """A process tree for each type, from the edge graph of its flattened log: all types' edges, starts and ends in one pass."""
    w = oc.by_object()
    x = oc.lifecycles(log, types).select("type", F.col("act").alias("source"), F.lead("act").over(w).alias("target"), (F.row_number().over(w) == 1).alias("first"), F.lead(F.lit(1)).over(w).isNull().alias("last"))
    graphs = {t: (Counter(), Counter(), Counter()) for t in types}
    for r in x.groupBy("type", "source", "target", "first", "last").agg(F.count("*").alias("n")).collect():
        edges, starts, ends = graphs[r["type"]]
        if r["target"] is not None:
            edges[r["source"], r["target"]] += r["n"]
        if r["first"]:
            starts[r["source"]] += r["n"]
        if r["last"]:
            ends[r["source"]] += r["n"]
    return {t: miners.inductive_dfg(*graphs[t]) for t in types}


def variable_arcs(log: Ocel, threshold: float = 0.8) -> DataFrame:
    """type, act, is_variable: whether under a share of an activity's events have exactly one object of the type."""
    return oc.per_event(log).groupBy("type", "act").agg((F.avg(F.when(F.col("n") == 1, 1.0).otherwise(0.0)) < threshold).alias("is_variable"))


def play_out_graph(edges: Counter, starts: Counter, ends: Counter, most: int = 3000, repeats: int = 2, steps: int = 1_000_000) -> list[tuple[tuple[str, ...], float]]:
    """Likely variants of an edge graph with their probabilities, best first; an activity occurs ``repeats`` times at most."""
    out: dict[str, list[tuple[str | None, int]]] = {}
    for (a, b), n in edges.items():
        out.setdefault(a, []).append((b, n))
    for a, n in ends.items():
        out.setdefault(a, []).append((None, n))
    total = {a: sum(n for _, n in options) for a, options in out.items()}
    tie = itertools.count()
    whole = sum(starts.values())
    heap = [(-math.log(n / whole) if n else 0.0, next(tie), (a,), False) for a, n in sorted(starts.items())]
    heap = [(abs(c), t, v, d) for c, t, v, d in heap]
    heapq.heapify(heap)
    found = []
    for _ in range(steps):
        if not heap or len(found) >= most:
            break
        cost, _, trace, done = heapq.heappop(heap)
        if done:
            found.append((trace, math.exp(-cost)))
            continue
        a = trace[-1]
        for b, n in sorted(out.get(a, []), key=lambda x: str(x[0])):
            c = cost - math.log(n / total[a])
            if b is None:
                heapq.heappush(heap, (c, next(tie), trace, True))
            elif trace.count(b) < repeats:
                heapq.heappush(heap, (c, next(tie), (*trace, b), False))
    return found


def net_of_graph(edges: Counter, starts: Counter, ends: Counter) -> Net:
    """A net whose runs are the walks of an edge graph: one place for each activity just done."""
    net = Net()
    source, sink = net.place(), net.place()
    net.initial[source] = net.final[sink] = 1
    acts = sorted({a for e in edges for a in e} | set(starts) | set(ends))
    after = {a: net.place() for a in acts}
    for a in sorted(starts):
        net.add(a, [source], [after[a]])
    for a, b in sorted(edges):
        net.add(b, [after[a]], [after[b]])
    for a in sorted(ends):
        net.add(None, [after[a]], [sink])
    return net


def edit_alignment(trace: tuple[str, ...], models: list[tuple[str, ...]]) -> tuple[int, list[tuple[str | None, str | None]]]:
    """The nearest model trace (the first of equals) and moves by matching blocks."""
    best = min(models, key=lambda m: edit_distance(trace, m))
    steps: list[tuple[str | None, str | None]] = []
    i = j = 0
    for block in difflib.SequenceMatcher(None, trace, best, autojunk=False).get_matching_blocks():
        steps += [(a, None) for a in trace[i : block.a]] + [(None, b) for b in best[j : block.b]]
        steps += [(a, a) for a in trace[block.a : block.a + block.size]]
        i, j = block.a + block.size, block.b + block.size
    return edit_distance(trace, best), steps


def edit_alignments(log: DataFrame, models: list[tuple[str, ...]]) -> DataFrame:
    """seq, n, distance of each distinct variant to the nearest model trace, in workers."""
    ship_package(log.sparkSession)

    def run(parts):
        for part in parts:
            yield part.assign(distance=[edit_alignment(tuple(s), models)[0] for s in part["seq"]])

    return core.variants(log).mapInPandas(run, "seq array<string>, n long, distance long")


def noisy_variants(log: DataFrame, epsilon: float = 1.0, depth: int = 10, prune: int = 20, seed: int = 0) -> list[tuple[tuple[str, ...], int]]:
    """Variants from a prefix tree with Laplace noise on every count: differentially private control flow.

    Prefix counts come from Spark; the tree grows on the driver, where noisy counts under ``prune`` end it.
    """
    acts = sorted(r[ACT] for r in log.select(ACT).distinct().collect())
    v = traces(log).groupBy("seq").agg(F.count("*").alias("n"))
    ends = v.select(F.concat("seq", F.array(F.lit("■"))).alias("seq"), "n")
    steps = ends.select("seq", "n", F.explode(F.sequence(F.lit(1), F.least(F.size("seq"), F.lit(depth + 1)))).alias("k"))
    counts = {tuple(r["p"]): r["n"] for r in steps.groupBy(F.slice("seq", F.lit(1), F.col("k")).alias("p")).agg(F.sum("n").alias("n")).filter(F.col("n") >= 1).collect()}
    g, out, level = np.random.default_rng(seed), [], [()]
    for _ in range(depth + 1):
        grown = []
        for p in level:
            for a in [*acts, "■"]:
                n = round(counts.get((*p, a), 0) + g.laplace(0, 1 / epsilon))
                if n < prune:
                    continue
                if a == "■":
                    if p:
                        out.append((p, n))
                elif len(p) < depth:
                    grown.append((*p, a))
        level = grown
    return out


def trace_profiles(log: DataFrame) -> DataFrame:
    """case_id, profile map<string, double>: presence of activities and of adjacent pairs."""
    x = log.withColumn("_next", F.lead(ACT).over(by_case())).select(CASE, F.explode(F.array(F.col(ACT), F.concat(ACT, F.lit("#"), "_next"))).alias("f")).filter("f is not null").distinct()
    return x.groupBy(CASE).agg(F.map_from_entries(F.collect_list(F.struct("f", F.lit(1.0).alias("v")))).alias("profile"))


def cluster_cases(log: DataFrame, k: int = 2, rounds: int = 300, tolerance: float = 1e-4) -> DataFrame:
    """case_id, cluster by Lloyd's algorithm on profiles, with farthest points to begin with.

    Distinct variants stand for their cases, so a round is one pass of workers over variants;
    the driver holds k centres over features, which activities bound.
    """
    ship_package(log.sparkSession)
    acts = sorted(r[ACT] for r in log.select(ACT).distinct().collect())
    names = [*acts, *[f"{a}#{b}" for a in acts for b in acts]]
    at = {f: i for i, f in enumerate(names)}
    v = core.variants(log).persist()

    def point(seq) -> np.ndarray:
        x = np.zeros(len(names))
        x[[at[a] for a in seq]] = 1
        x[[at[f"{a}#{b}"] for a, b in itertools.pairwise(seq)]] = 1
        return x

    def farthest(centres):
        def run(parts):
            for part in parts:
                d = [min(((point(s) - c) ** 2).sum() for c in centres) if centres else 0.0 for s in part["seq"]]
                yield pd.DataFrame({"seq": part["seq"], "d": d})

        r = v.mapInPandas(run, "seq array<string>, d double").orderBy(F.desc("d"), "seq").first()
        return point(r["seq"])

    centres: list[np.ndarray] = []
    try:
        for _ in range(k):
            centres.append(farthest(list(centres)))
        for _ in range(rounds):
            now = list(centres)

            def sums(parts, now=now):
                for part in parts:
                    total, n = np.zeros((k, len(names))), np.zeros(k)
                    for s, m in zip(part["seq"], part["n"], strict=True):
                        x = point(s)
                        c = int(np.argmin([((x - y) ** 2).sum() for y in now]))
                        total[c] += m * x
                        n[c] += m
                    yield pd.DataFrame({"c": range(k), "n": n, "t": list(total)})

            rows = v.mapInPandas(sums, "c int, n double, t array<double>").select("c", "n", F.posexplode("t").alias("i", "t")).groupBy("c", "i").agg(F.sum("t").alias("t"), F.sum("n").alias("n")).collect()
            new = [np.array(c) for c in now]
            for r in rows:
                if r["n"]:
                    new[r["c"]][r["i"]] = r["t"] / r["n"]
            moved = sum(((a - b) ** 2).sum() for a, b in zip(new, now, strict=True))
            centres = new
            if moved <= tolerance:
                break
    finally:
        v.unpersist()
    final = list(centres)

    def assign(parts):
        for part in parts:
            yield part.assign(cluster=[int(np.argmin([((point(s) - y) ** 2).sum() for y in final])) for s in part["seq"]])[["case_id", "cluster"]]

    return traces(log).mapInPandas(assign, "case_id string, cluster int")


def ordered_position(log: DataFrame) -> DataFrame:
    """case_id, idx, act, share: how far along its case each event stands (0 to 1)."""
    n = F.count("*").over(Window.partitionBy(CASE))
    return log.select(CASE, IDX, ACT, (F.col(IDX) / F.greatest(n - 1, F.lit(1))).alias("share"))


