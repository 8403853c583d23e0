"""Conformance of logs with nets: each distinct variant is checked once, in a worker that has the model."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.shipping import ship_package
from tracelake.operators import core
from tracelake.operators.nets import Net, alignment_fitness, replay, shortest_run


def _per_variant(log: DataFrame, check, schema: str, names: list[str]) -> DataFrame:
    """seq, n and what ``check`` returns for each variant."""
    ship_package(log.sparkSession)

    def run(parts):
        for part in parts:
            got = [check(tuple(s)) for s in part["seq"]]
            yield part.assign(**{c: [g[i] for g in got] for i, c in enumerate(names)})

    return core.variants(log).mapInPandas(run, f"seq array<string>, n long, {schema}")


def token_replay(log: DataFrame, net: Net) -> DataFrame:
    def check(v):
        r = replay(net, v)
        return r.missing, r.consumed, r.remaining, r.produced, r.fitness, r.fits

    return _per_variant(log, check, "missing long, consumed long, remaining long, produced long, fitness double, fits boolean", ["missing", "consumed", "remaining", "produced", "fitness", "fits"])


def replay_fitness(replayed: DataFrame) -> DataFrame:
    """log_fitness, mean_fitness, share_fitting over cases; 0 where nothing was consumed or produced."""
    s = lambda c: F.sum(F.col(c) * F.col("n"))
    log_fitness = 0.5 * (1 - s("missing") / s("consumed")) + 0.5 * (1 - s("remaining") / s("produced"))
    return replayed.agg(F.coalesce(log_fitness, F.lit(0.0)).alias("log_fitness"), F.coalesce(s("fitness") / F.sum("n"), F.lit(0.0)).alias("mean_fitness"), F.coalesce(F.sum(F.when(F.col("fits"), F.col("n")).otherwise(0)) / F.sum("n"), F.lit(0.0)).alias("share_fitting"))


def alignments(log: DataFrame, net: Net) -> DataFrame:
    """seq, n, cost, fitness; nulls where the search gave up."""
    shortest = shortest_run(net)
    return _per_variant(log, lambda v: alignment_fitness(net, v, shortest) or (None, None), "cost long, fitness double", ["cost", "fitness"])


def generalization(log: DataFrame, net: Net) -> float:
    """1 less the mean of 1 / sqrt(firings) over transitions, with 1 for those that never fire."""
    ship_package(log.sparkSession)

    def run(parts):
        for part in parts:
            rows = [(i, n) for s, n in zip(part["seq"], part["n"], strict=True) for i in replay(net, tuple(s)).activated]
            yield pd.DataFrame(rows, columns=["t", "n"])

    fired = {r["t"]: r["n"] for r in core.variants(log).mapInPandas(run, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()}
    k = len(net.transitions)
    return 1.0 if not k else 1 - sum(fired[i] ** -0.5 if fired.get(i) else 1.0 for i in range(k)) / k


def trace_footprints(log: DataFrame, allowed: set[tuple[str, str]], starts: set[str], ends: set[str], always: set[str] = frozenset(), least: int = 0) -> DataFrame:
    """case_id, deviations: pairs that a model doesn't have, wrong ends, activities that should always happen, and too short cases."""
    from tracelake.functions.keys import traces

    pair = lambda a, b: F.concat(a, F.lit("\x01"), b)
    ok = F.array(*[F.lit(f"{a}\x01{b}") for a, b in sorted(allowed)]).cast("array<string>")
    some = lambda values: F.array(*map(F.lit, sorted(values))).cast("array<string>")
    found = F.array_distinct(F.zip_with(F.slice("seq", F.lit(1), F.size("seq") - 1), F.slice("seq", F.lit(2), F.size("seq") - 1), pair))
    n = F.size(F.array_except(found, ok)) + F.when(F.array_contains(some(starts), F.element_at("seq", 1)), 0).otherwise(1) + F.when(F.array_contains(some(ends), F.element_at("seq", -1)), 0).otherwise(1)
    n = n + F.size(F.array_except(some(always), "seq")) + F.when(F.size("seq") < least, 1).otherwise(0)
    return traces(log).select("case_id", n.alias("deviations"))


def footprint_precision(log_edges: DataFrame, model: set[tuple[str, str]]) -> float:
    """Share of a model's pairs that the log has; 1 for a model without pairs."""
    if not model:
        return 1.0
    pairs = log_edges.sparkSession.createDataFrame(sorted(model), "source string, target string")
    return pairs.join(log_edges, ["source", "target"], "left_semi").count() / len(model)


def precision(log: DataFrame, net: Net) -> float:
    """Escaping-edges precision: over prefixes that replay, 1 less what the net allows and the log never does.

    Prefixes come with their weights from the log; only distinct ones are replayed, in workers.
    """
    from collections import Counter

    from tracelake.operators.nets import enabled, fired, silent_path

    ship_package(log.sparkSession)
    v = core.variants(log)
    steps = v.select("n", "seq", F.explode(F.sequence(F.lit(0), F.size("seq") - 1)).alias("k"))
    prefixes = steps.groupBy(F.slice("seq", F.lit(1), F.col("k")).alias("prefix")).agg(F.sum("n").alias("n"), F.collect_set(F.element_at("seq", F.col("k") + 1)).alias("seen"))

    def reached(prefix):
        m = Counter(net.initial)
        for act in prefix:
            can = lambda x, a=act: any(net.transitions[i][1] == a for i in enabled(net, x))
            path = silent_path(net, m, can)
            if path is None:
                return None
            for i in path:
                m = fired(net, m, i)
            m = fired(net, m, next(i for i in enabled(net, m) if net.transitions[i][1] == act))
        return m

    def allowed(m):
        found, stack, been = set(), [m], set()
        while stack:
            x = stack.pop()
            key = tuple(sorted((+x).items()))
            if key in been:
                continue
            been.add(key)
            for i in enabled(net, x):
                if net.transitions[i][1] is None:
                    stack.append(fired(net, x, i))
                else:
                    found.add(net.transitions[i][1])
        return found

    def run(parts):
        for part in parts:
            rows = []
            for prefix, n, seen in zip(part["prefix"], part["n"], part["seen"], strict=True):
                m = reached(tuple(prefix))
                if m is not None:
                    on = allowed(m)
                    rows.append((n * len(on - set(seen)), n * len(on)))
            yield pd.DataFrame(rows, columns=["escaping", "activated"])

    got = prefixes.mapInPandas(run, "escaping long, activated long").agg(F.sum("escaping").alias("e"), F.sum("activated").alias("a")).first()
    return 1.0 if not got["a"] else 1 - got["e"] / got["a"]
