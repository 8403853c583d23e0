"""Alignments beyond the plain one: own costs, discounts, parts, beams and subsets; membership in trees; precision by alignments.

A search runs once for each distinct variant, in workers that hold the model.
"""

from __future__ import annotations

import heapq
import itertools
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.shipping import ship_package
from tracelake.operators import core, petri
from tracelake.operators.conformance import _per_variant
from tracelake.operators.more import edit_distance
from tracelake.operators.nets import Net, Tree, align, enabled, fired, marking, net_of, shortest_run, silent_path

MOVE = 10_000
Steps = list[tuple[str | None, str | None]]


def replay_prefix(net: Net, prefix: tuple[str, ...]) -> Counter:
    """The marking after replaying a prefix: silent ways first, then missing tokens; unknown activities change nothing."""
    m = Counter(net.initial)
    for act in prefix:
        options = [i for i, t in enumerate(net.transitions) if t[1] == act]
        if not options:
            continue
        path = silent_path(net, m, lambda x, o=options: any(i in o for i in enabled(net, x)))
        for i in path or []:
            m = fired(net, m, i)
        i = next((i for i in options if i in enabled(net, m)), options[0])
        m = petri.weak_fire(net, m, i)
    return +m


def closure(net: Net, markings: set[tuple]) -> set[tuple]:
    """Markings and what silent transitions lead to from them."""
    seen, stack = set(markings), list(markings)
    while stack:
        m = Counter(dict(stack.pop()))
        for i in enabled(net, m):
            if net.transitions[i][1] is None and (key := marking(fired(net, m, i))) not in seen:
                seen.add(key)
                stack.append(key)
    return seen


def fits(net: Net, trace: tuple[str, ...]) -> bool:
    """Whether a trace is a run of the net, by following all markings at once."""
    now = closure(net, {marking(net.initial)})
    for act in trace:
        after = {marking(fired(net, m, i)) for m in (Counter(dict(k)) for k in now) for i in enabled(net, m) if net.transitions[i][1] == act}
        now = closure(net, after)
        if not now:
            return False
    return marking(net.final) in now


def fits_tree(tree: Tree, trace: tuple[str, ...]) -> bool:
    return fits(net_of(tree), trace)


def align_with_costs(net: Net, trace: tuple[str, ...], log_costs: list[int] | None = None, model_cost: int = MOVE, whole: bool = True, width: int | None = None) -> tuple[int, Steps, Counter] | None:
    """Cost, moves and last marking of a cheapest alignment, where a move on event i alone costs ``log_costs[i]``.

    Without ``whole`` it may end in any marking once the trace is used up.  With ``width`` only so many markings are kept at each
    event: then the cost is an upper bound.
    """
    costs = log_costs or [MOVE] * len(trace)
    goal, tie = marking(net.final), itertools.count()
    start = (0, marking(net.initial))
    best, heap, taken = {start: 0}, [(0, next(tie), start, None)], Counter()
    while heap:
        cost, _, state, back = heapq.heappop(heap)
        if cost > best[state]:
            continue
        at, key = state
        if at == len(trace) and (not whole or key == goal):
            steps = []
            while back:
                steps.append(back[0])
                back = back[1]
            return cost, steps[::-1], Counter(dict(key))
        if width is not None and at < len(trace):
            taken[at] += 1
            if taken[at] > width:
                continue
        m = Counter(dict(key))
        moves = [(costs[at], (at + 1, key), (trace[at], None))] if at < len(trace) else []
        for i in enabled(net, m):
            label, to = net.transitions[i][1], marking(fired(net, m, i))
            moves.append((1 if label is None else model_cost, (at, to), (None, label)))
            if at < len(trace) and trace[at] == label:
                moves.append((0, (at + 1, to), (label, label)))
        for c, to, step in moves:
            if cost + c < best.get(to, 1 << 60):
                best[to] = cost + c
                heapq.heappush(heap, (cost + c, next(tie), to, (step, back)))
    return None


def align_discounted(net: Net, trace: tuple[str, ...], base: float = 1.2) -> tuple[float, Steps] | None:
    """The alignment whose deviations, the i-th move at base^-i, cost the least: late deviations weigh less.

    Silent moves cost nothing and have no place.  A run of moves on the model alone is as long as the model has markings at most.
    """
    goal, tie = marking(net.final), itertools.count()
    limit = (len(trace) + 1) * (len(net.transitions) + 1)
    start = (0, marking(net.initial), 0)
    best, heap = {start: 0.0}, [(0.0, 0, next(tie), start, None)]
    while heap:
        cost, _, _, state, back = heapq.heappop(heap)
        if cost > best[state] + 1e-12:
            continue
        at, key, depth = state
        if at == len(trace) and key == goal:
            steps = []
            while back:
                steps.append(back[0])
                back = back[1]
            return cost, steps[::-1]
        if depth >= limit:
            continue
        m, off = Counter(dict(key)), base ** -(depth + 1)
        moves = [(off, (at + 1, key, depth + 1), (trace[at], None))] if at < len(trace) else []
        for i in enabled(net, m):
            label, to = net.transitions[i][1], marking(fired(net, m, i))
            moves.append((0.0, (at, to, depth), (None, None)) if label is None else (off, (at, to, depth + 1), (None, label)))
            if at < len(trace) and trace[at] == label:
                moves.append((0.0, (at + 1, to, depth + 1), (label, label)))
        for c, to, step in moves:
            if cost + c < best.get(to, float("inf")) - 1e-12:
                best[to] = cost + c
                heapq.heappush(heap, (cost + c, -to[0], next(tie), to, (step, back)))
    return None


def align_decomposed(net: Net, trace: tuple[str, ...]) -> tuple[int, bool] | None:
    """Cost from the parts of the maximal decomposition, and whether the parts agreed.

    Each part aligns the trace's events that it knows; a label of several parts costs its share in each.  Parts that agree on every shared
    event give the exact cost; else the whole net is aligned.
    """
    parts = petri.decomposition(net)
    known = [{t[1] for t in p.transitions if t[1] is not None} for p in parts]
    shared = Counter(label for k in known for label in k)
    # places that nothing marks at first hold what the shared transitions put there; parts keep their own share of the markings
    total, verdicts = 0.0, {}
    for p, labels in zip(parts, known, strict=True):
        own = [(i, a) for i, a in enumerate(trace) if a in labels]
        found = _align_share(p, [a for _, a in own], shared)
        if found is None:
            return None
        total += found[0]
        at = 0
        for a, b in found[1]:
            if a is not None:
                verdicts.setdefault(own[at][0], set()).add(a == b)
                at += 1
            elif b is not None and shared[b] > 1:
                verdicts.setdefault(("model", b), set()).add((len(verdicts), False))
    total += MOVE * sum(not shared[a] for a in trace)
    agreed = all(len(v) == 1 for k, v in verdicts.items() if not isinstance(k, tuple)) and not any(isinstance(k, tuple) for k in verdicts)
    if agreed:
        return round(total), True
    whole = align(net, trace)
    return None if whole is None else (whole[0], False)


def _align_share(net: Net, trace: list[str], shared: Counter) -> tuple[float, Steps] | None:
    """Cheapest alignment of a part, each move at its share of the labels' parts."""
    goal, tie = marking(net.final), itertools.count()
    start = (0, marking(net.initial))
    best, heap = {start: 0.0}, [(0.0, next(tie), start, None)]
    while heap:
        cost, _, state, back = heapq.heappop(heap)
        if cost > best[state] + 1e-9:
            continue
        at, key = state
        if at == len(trace) and key == goal:
            steps = []
            while back:
                steps.append(back[0])
                back = back[1]
            return cost, steps[::-1]
        m = Counter(dict(key))
        moves = [(MOVE / shared[trace[at]], (at + 1, key), (trace[at], None))] if at < len(trace) else []
        for i in enabled(net, m):
            label, to = net.transitions[i][1], marking(fired(net, m, i))
            moves.append((1.0 if label is None else MOVE / shared[label], (at, to), (None, label)))
            if at < len(trace) and trace[at] == label:
                moves.append((0.0, (at + 1, to), (label, label)))
        for c, to, step in moves:
            if cost + c < best.get(to, float("inf")) - 1e-9:
                best[to] = cost + c
                heapq.heappush(heap, (cost + c, next(tie), to, (step, back)))
    return None


# --- logs


def _fitness(cost: float, trace, shortest: int) -> float:
    worst = len(trace) + shortest
    return 1.0 if not worst else 1 - (cost // MOVE) / worst


def align_log(log: DataFrame, net: Net, log_costs: dict[str, int] | None = None) -> DataFrame:
    """seq, n, cost, fitness, moves (texts log/model) of each variant; ``log_costs`` by activity."""
    shortest = shortest_run(net)

    def check(v):
        got = align_with_costs(net, v, [(log_costs or {}).get(a, MOVE) for a in v])
        return (None, None, None) if got is None else (got[0], _fitness(got[0], v, shortest), [f"{a or '>>'}/{b or '>>'}" for a, b in got[1] if a or b])

    return _per_variant(log, check, "cost long, fitness double, moves array<string>", ["cost", "fitness", "moves"])


def align_log_tree(log: DataFrame, tree: Tree) -> DataFrame:
    return align_log(log, net_of(tree))


def align_log_discounted(log: DataFrame, net: Net, base: float = 1.2) -> DataFrame:
    """seq, n, cost of each variant."""
    return _per_variant(log, lambda v: ((align_discounted(net, v, base) or (None,))[0],), "cost double", ["cost"])


def align_log_decomposed(log: DataFrame, net: Net) -> DataFrame:
    """seq, n, cost, agreed of each variant."""
    return _per_variant(log, lambda v: align_decomposed(net, v) or (None, None), "cost long, agreed boolean", ["cost", "agreed"])


def align_log_beam(log: DataFrame, net: Net, width: int = 50) -> DataFrame:
    """seq, n, cost (an upper bound; null where the beam lost the end) of each variant."""

    def check(v):
        got = align_with_costs(net, v, width=width)
        return (None if got is None else got[0],)

    return _per_variant(log, check, "cost long", ["cost"])


def align_log_subset(log: DataFrame, net: Net, most: int = 20) -> DataFrame:
    """seq, n, lower, upper: exact costs of the ``most`` most frequent variants, bounds for the others.

    The upper bound is the way over the nearest of the model's runs that exact alignments found; the lower one counts events that the model
    doesn't know.
    """
    chosen = [tuple(r["seq"]) for r in core.variants(log).orderBy(F.desc("n"), "seq").limit(most).collect()]
    exact, runs = {}, set()
    for v in chosen:
        got = align(net, v)
        if got is not None:
            exact[v] = got[0]
            runs.add(tuple(b for _, b in got[1] if b is not None))
    labels = {t[1] for t in net.transitions}
    ordered = sorted(runs)

    def check(v):
        if v in exact:
            return exact[v], exact[v]
        lower = MOVE * sum(a not in labels for a in v)
        # an exchange is a move on either side
        upper = min((MOVE * _indels(v, r) for r in ordered), default=None)
        return lower, upper

    return _per_variant(log, check, "lower long, upper long", ["lower", "upper"])


def _indels(a: tuple, b: tuple) -> int:
    """Insertions and deletions between two sequences."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last if x == y else 1 + min(row[j], row[j - 1])
    return row[-1]


def subset_summary(aligned: DataFrame, net: Net) -> DataFrame:
    """Bounds of the log's fitness over all cases; 1 for an empty log."""
    worst = F.col("n") * (F.size("seq") + shortest_run(net)) * MOVE
    sums = aligned.agg(F.sum(worst).alias("w"), F.sum(F.col("lower") * F.col("n")).alias("l"), F.sum(F.col("upper") * F.col("n")).alias("u"))
    part = lambda c: F.when(F.coalesce("w", F.lit(0)) == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col(c) / F.col("w")))
    return sums.select(part("u").alias("least"), part("l").alias("most"))


def precision(log: DataFrame, net: Net) -> float:
    """Escaping-edges precision where every prefix stands at the marking of its cheapest alignment: no prefix is left out."""
    ship_package(log.sparkSession)
    v = core.variants(log)
    steps = v.select("n", "seq", F.explode(F.sequence(F.lit(0), F.size("seq") - 1)).alias("k"))
    prefixes = steps.groupBy(F.slice("seq", F.lit(1), F.col("k")).alias("prefix")).agg(F.sum("n").alias("n"), F.collect_set(F.element_at("seq", F.col("k") + 1)).alias("seen"))

    def run(parts):
        for part in parts:
            rows = []
            for prefix, n, seen in zip(part["prefix"], part["n"], part["seen"], strict=True):
                got = align_with_costs(net, tuple(prefix), whole=False)
                on = {net.transitions[i][1] for i in petri.eventually_enabled(net, got[2])}
                rows.append((n * len(on - set(seen)), n * len(on)))
            yield pd.DataFrame(rows, columns=["escaping", "activated"])

    got = prefixes.mapInPandas(run, "escaping long, activated long").agg(F.sum("escaping").alias("e"), F.sum("activated").alias("a")).first()
    return 1.0 if not got["a"] else 1 - got["e"] / got["a"]


def nearest_run(trace: tuple[str, ...], runs: list[tuple[str, ...]]) -> tuple[str, ...]:
    return min(runs, key=lambda r: (edit_distance(trace, r), r))
