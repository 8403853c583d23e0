"""Edge graphs as tables and on the driver: ends, degrees, reach; dependency nets and the nets they make; further miners."""

from __future__ import annotations

import itertools
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators import bpmn as diagrams
from tracelake.operators import miners, powl
from tracelake.operators.nets import Net, Tree, net_of

# --- as tables


def vertices(edges: DataFrame, starts: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
    """act: what edges (source, target), starts and ends (act) name."""
    out = edges.select(F.explode(F.array("source", "target")).alias("act"))
    for x in (starts, ends):
        out = out if x is None else out.union(x.select("act"))
    return out.distinct()


def inferred_starts(edges: DataFrame) -> DataFrame:
    """act: vertices with an edge out and none in."""
    return edges.select(F.col("source").alias("act")).distinct().join(edges.select(F.col("target").alias("act")), "act", "left_anti")


def inferred_ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("target").alias("act")).distinct().join(edges.select(F.col("source").alias("act")), "act", "left_anti")


def vertex_frequencies(edges: DataFrame, starts: DataFrame, ends: DataFrame) -> DataFrame:
    """act, n: how often each vertex occurs: its edges out and the cases that end with it."""
    out = edges.select(F.col("source").alias("act"), "n").union(ends.select("act", "n"))
    known = vertices(edges, starts, ends)
    return known.join(out.groupBy("act").agg(F.sum("n").alias("n")), "act", "left").fillna(0, ["n"])


def activity_count(edges: DataFrame) -> DataFrame:
    """act, n: edge counts in and out, halved (down) where there are both."""
    both = edges.select(F.col("source").alias("act"), "n", F.lit(1).alias("side")).union(edges.select("target", "n", F.lit(0)))
    x = both.groupBy("act").agg(F.sum("n").alias("n"), F.count_distinct("side").alias("sides"))
    return x.select("act", F.when(F.col("sides") == 2, F.floor(F.col("n") / 2)).otherwise(F.col("n")).cast("long").alias("n"))


def reach(edges: DataFrame) -> DataFrame:
    """source, target: what every vertex leads to by one or more edges (pairs of activities, not of events).

    Reach doubles in each round, so there are as many rounds as the longest way has digits in binary.
    """
    now = edges.select("source", "target").distinct().persist()
    n = now.count()
    while True:
        far = now.select(F.col("source").alias("target"), F.col("target").alias("end"))
        grown = now.union(now.join(far, "target").select("source", "end")).distinct().persist()
        more = grown.count()
        now.unpersist()
        now = grown
        if more == n:
            return now
        n = more


def successors(edges: DataFrame) -> DataFrame:
    return reach(edges)


def predecessors(edges: DataFrame) -> DataFrame:
    """source, target: what leads to every vertex (as source)."""
    return reach(edges).select(F.col("target").alias("source"), F.col("source").alias("target"))


# --- dependency nets


@dataclass
class HeuristicsNet:
    """Edges with counts and dependencies, starts, ends, and which targets (and sources) of an activity go together."""

    edges: dict[tuple[str, str], tuple[int, float]] = field(default_factory=dict)
    counts: Counter = field(default_factory=Counter)
    starts: Counter = field(default_factory=Counter)
    ends: Counter = field(default_factory=Counter)
    outputs: dict[str, list[set[str]]] = field(default_factory=dict)
    inputs: dict[str, list[set[str]]] = field(default_factory=dict)
    short_loops: set[tuple[str, str]] = field(default_factory=set)


def heuristics_of(edges: Counter, starts: Counter, ends: Counter, dependency: float = 0.5, concurrent: float = 0.65, noise: float = 0.05, loop2: float = 0.5, triples: Counter | None = None) -> HeuristicsNet:
    """A dependency net of an edge graph; ``triples`` counts a, b, a."""
    top = Counter()
    for (a, b), n in edges.items():
        top[a], top[b] = max(top[a], n), max(top[b], n)
    clean = Counter({(a, b): n for (a, b), n in edges.items() if n >= noise * min(top[a], top[b])})
    net = HeuristicsNet(starts=Counter(starts), ends=Counter(ends))
    for (a, b), n in clean.items():
        net.counts[a] += n
        d = n / (n + 1) if a == b else (n - clean[b, a]) / (n + clean[b, a] + 1)
        if d >= dependency:
            net.edges[a, b] = n, d
    for a, n in ends.items():
        net.counts[a] += n
    for (a, b), n in (triples or Counter()).items():
        back = (triples or Counter())[b, a]
        if (n + back) / (n + back + 1) >= loop2:
            net.short_loops.add((a, b))
            for e in ((a, b), (b, a)):
                if e in clean:
                    net.edges.setdefault(e, (clean[e], (n + back) / (n + back + 1)))
    measures(net, clean, concurrent)
    return net


def measures(net: HeuristicsNet, edges: Counter, concurrent: float = 0.65) -> None:
    """Groups of an activity's targets (and sources) that happen together: ab + ba over what leads to them and 1, at the threshold or over."""

    def groups(others: list[str], weight) -> list[set[str]]:
        out: list[set[str]] = []
        for x in sorted(others):
            mine = next((g for g in out if all((edges[x, y] + edges[y, x]) / (weight(x) + weight(y) + 1) >= concurrent for y in g)), None)
            if mine is None:
                out.append({x})
            else:
                mine.add(x)
        return out

    acts = sorted({a for e in net.edges for a in e} | set(net.starts) | set(net.ends))
    for a in acts:
        net.outputs[a] = groups([b for x, b in net.edges if x == a and b != a], lambda b, a=a: edges[a, b])
        net.inputs[a] = groups([x for x, b in net.edges if b == a and x != a], lambda x, a=a: edges[x, a])


def merged(one: HeuristicsNet, two: HeuristicsNet) -> HeuristicsNet:
    """Both nets' edges; counts add up, the greater dependency holds, groups that share a member become one."""
    out = HeuristicsNet(counts=one.counts + two.counts, starts=one.starts + two.starts, ends=one.ends + two.ends, short_loops=one.short_loops | two.short_loops)
    for net in (one, two):
        for e, (n, d) in net.edges.items():
            m, c = out.edges.get(e, (0, d))
            out.edges[e] = n + m, max(c, d)
        for ours, theirs in ((out.outputs, net.outputs), (out.inputs, net.inputs)):
            for a, groups in theirs.items():
                for g in groups:
                    mine = ours.setdefault(a, [])
                    touching = [x for x in mine if x & g]
                    ours[a] = [x for x in mine if not x & g] + [set(g).union(*touching)]
    return out


def net_of_heuristics(h: HeuristicsNet) -> Net:
    """An activity's transition stands between a place before and one after; silent transitions take a group of its edges at once."""
    net = Net()
    source, sink = net.place(), net.place()
    net.initial[source] = net.final[sink] = 1
    acts = sorted(set(h.outputs) | set(h.inputs))
    before, after = {a: net.place() for a in acts}, {a: net.place() for a in acts}
    link = {e: net.place() for e in sorted(h.edges) if e[0] != e[1]}
    for a in acts:
        net.add(a, [before[a]], [after[a]])
        if (a, a) in h.edges:
            net.add(None, [after[a]], [before[a]])
        for g in h.outputs.get(a, []):
            net.add(None, [after[a]], [link[a, b] for b in sorted(g)])
        for g in h.inputs.get(a, []):
            net.add(None, [link[x, a] for x in sorted(g)], [before[a]])
        if a in h.starts:
            net.add(None, [source], [before[a]])
        if a in h.ends:
            net.add(None, [after[a]], [sink])
    return net


# --- miners


def net_per_edge(edges: Counter, starts: Counter, ends: Counter) -> Net:
    """One transition an activity, one silent transition an edge."""
    net = Net()
    source, sink = net.place(), net.place()
    net.initial[source] = net.final[sink] = 1
    acts = sorted({a for e in edges for a in e} | set(starts) | set(ends))
    before, after = {a: net.place() for a in acts}, {a: net.place() for a in acts}
    for a in acts:
        net.add(a, [before[a]], [after[a]])
    for a in sorted(starts):
        net.add(None, [source], [before[a]])
    for a, b in sorted(edges):
        net.add(None, [after[a]], [before[b]])
    for a in sorted(ends):
        net.add(None, [after[a]], [sink])
    return net


def alpha_plus(edges: Counter, starts: Counter, ends: Counter, triples: Counter | None = None) -> Net:
    """Alpha miner with short loops: activities that follow themselves are left out and put back beside the places around them,
    and a, b, a tells a loop of two from parallels."""
    alone = {a for a, b in edges if a == b}
    back = triples or Counter()
    kept = Counter()
    for (a, b), n in edges.items():
        if a not in alone and b not in alone:
            kept[a, b] += n
    # what surrounds a left-out activity follows each other
    for c in alone:
        for a in {x for x, y in edges if y == c and x not in alone}:
            for b in {y for x, y in edges if x == c and y not in alone}:
                kept[a, b] += 1
    two = {(a, b) for (a, b), n in back.items() if n and a != b}
    marked = Counter({e: n for e, n in kept.items()})
    acts = sorted({a for e in kept for a in e} | {a for a in (*starts, *ends) if a not in alone})
    cause = {(a, b) for a, b in marked if (b, a) not in marked or (a, b) in two or (b, a) in two}
    apart = lambda a, b: (a, b) not in marked and (b, a) not in marked
    pairs = {(frozenset([a]), frozenset([b])) for a, b in cause if apart(a, a) and apart(b, b)}
    frontier = set(pairs)
    while frontier:
        grown = set()
        for x, y in frontier:
            for a in acts:
                if a not in x and all((a, b) in cause for b in y) and all(apart(a, c) for c in (*x, a)):
                    grown.add((x | {a}, y))
                if a not in y and all((b, a) in cause for b in x) and all(apart(a, c) for c in (*y, a)):
                    grown.add((x, y | {a}))
        frontier = grown - pairs
        pairs |= frontier
    top = [p for p in pairs if not any(p != q and p[0] <= q[0] and p[1] <= q[1] for q in pairs)]
    net = Net()
    source, sink = net.place(), net.place()
    net.initial[source] = net.final[sink] = 1
    into, out = {a: [source] if a in starts else [] for a in acts}, {a: [sink] if a in ends else [] for a in acts}
    around: dict[str, list[int]] = {c: [] for c in sorted(alone)}
    for x, y in sorted(top, key=lambda p: (sorted(p[0]), sorted(p[1]))):
        p = net.place()
        for a in x:
            out[a].append(p)
        for b in y:
            into[b].append(p)
        for c in around:
            if any((a, c) in edges for a in x) and any((c, b) in edges for b in y):
                around[c].append(p)
    for a in acts:
        net.add(a, into[a], out[a])
    for c, places in around.items():
        net.add(c, places or [source], places or [sink])
    return net


def triples_of(variants: miners.Variants) -> Counter:
    """Counts of a, b, a (a not b)."""
    out: Counter = Counter()
    for v, n in variants.items():
        for a, b, c in zip(v, v[1:], v[2:], strict=False):
            if a == c and a != b:
                out[a, b] += n
    return out


def powl_inductive(variants: miners.Variants) -> powl.Powl:
    """The inductive miner's tree as a partially ordered model."""
    return powl.simplify(powl.of_tree(miners.inductive(variants)))


def bpmn_inductive(variants: miners.Variants) -> diagrams.Bpmn:
    return diagrams.of_tree(miners.inductive(variants))


def bpmn_inductive_dfg(edges: Counter, starts: Counter, ends: Counter) -> diagrams.Bpmn:
    return diagrams.of_tree(miners.inductive_dfg(edges, starts, ends))


def ilp_places(variants: miners.Variants, most: int = 200) -> Net:
    """A net of places that every trace allows, each the tightest of its kind between a causal pair.

    A place is x (producers), y (consumers) and m (its tokens at first): no prefix of a trace may take more from it than it has.
    For each causal pair a linear program finds the place that a feeds and b empties with the fewest tokens over all prefixes;
    solutions in whole numbers become places.
    """
    from tracelake.operators.petri import linear_program

    edges, starts, ends = miners.edges_of(variants)
    acts = sorted({a for v in variants for a in v})
    at = {a: i for i, a in enumerate(acts)}
    prefixes = sorted({v[:k] for v in variants for k in range(1, len(v) + 1)})[: most * 50]
    n = len(acts)
    done, last = np.zeros((len(prefixes), n)), np.zeros((len(prefixes), n))
    for i, p in enumerate(prefixes):
        for a in p[:-1]:
            done[i, at[a]] += 1
        last[i] = done[i]
        last[i, at[p[-1]]] += 1
    net = Net()
    source, sink = net.place(), net.place()
    net.initial[source] = net.final[sink] = 1
    into, out = {a: [source] if a in starts else [] for a in acts}, {a: [sink] if a in ends else [] for a in acts}
    seen = set()
    for a, b in sorted(edges):
        if a == b or (b, a) in edges or len(seen) >= most:
            continue
        # x, y in [0, 1]; done x - last y >= 0 for every prefix; x_a = y_b = 1; the least sum of what is left
        k = len(prefixes)
        rows, right = [], []
        for i in range(k):
            slack = np.zeros(k)
            slack[i] = -1
            rows.append(np.concatenate([done[i], -last[i], slack, np.zeros(2 * n)]))
            right.append(0.0)
        for j in range(2 * n):
            r = np.zeros(4 * n + k)
            r[j], r[2 * n + k + j] = 1, 1
            rows.append(r)
            right.append(1.0)
        for j in (at[a], n + at[b]):
            r = np.zeros(4 * n + k)
            r[j] = 1
            rows.append(r)
            right.append(1.0)
        cost = np.concatenate([done.sum(0) + 0.001, 0.001 - last.sum(0), np.zeros(k), np.zeros(2 * n)])
        got = linear_program(cost, np.array(rows), np.array(right))
        if got is None:
            continue
        x, y = got[:n].round(6), got[n : 2 * n].round(6)
        if set(np.unique(np.concatenate([x, y])).tolist()) <= {0.0, 1.0} and (key := (tuple(x), tuple(y))) not in seen:
            seen.add(key)
            p = net.place()
            for c in acts:
                if x[at[c]]:
                    out[c].append(p)
                if y[at[c]]:
                    into[c].append(p)
    for a in acts:
        net.add(a, into[a], out[a])
    return net


def split_miner(edges: Counter, starts: Counter, ends: Counter, epsilon: float = 0.1, eta: float = 0.4) -> diagrams.Bpmn:
    """A diagram from an edge graph: loops aside, concurrent pairs dropped, edges filtered by frequency but for each activity's
    best way from the start and to the end, then gateways where several edges leave or arrive."""
    alone = {a for a, b in edges if a == b}
    plain = Counter({(a, b): n for (a, b), n in edges.items() if a != b})
    concurrent = {(a, b) for a, b in plain if (b, a) in plain and abs(plain[a, b] - plain[b, a]) / (plain[a, b] + plain[b, a]) < epsilon}
    kept = Counter()
    for (a, b), n in plain.items():
        if (a, b) not in concurrent and not ((b, a) in plain and (b, a) not in concurrent and plain[b, a] > n):
            kept[a, b] = n
    kept.update({("▶", a): n for a, n in starts.items()} | {(a, "■"): n for a, n in ends.items()})
    nodes = sorted({x for e in kept for x in e} | {x for e in plain for x in e} | alone)
    for a in nodes:  # what lost all edges keeps its largest
        if a not in ("▶", "■"):
            for side in (0, 1):
                if not any(e[side] == a for e in kept):
                    best = max((e for e in plain if e[side] == a), key=lambda e: (plain[e], e), default=None)
                    if best:
                        kept[best] = plain[best]

    def best_ways(start: str, forward: bool) -> set:
        width, way = {start: float("inf")}, {}
        left = set(nodes) | {"▶", "■"}
        while left:
            x = max(left, key=lambda v: (width.get(v, -1.0), v))
            left.discard(x)
            if width.get(x, -1.0) < 0:
                break
            for (a, b), n in kept.items():
                p, q = (a, b) if forward else (b, a)
                if p == x and q in left and min(width[x], n) > width.get(q, -1.0):
                    width[q], way[q] = min(width[x], n), (a, b)
        return set(way.values())

    must = best_ways("▶", True) | best_ways("■", False)
    line = float(np.quantile([n for e, n in kept.items()], eta)) if kept else 0.0
    chosen = must | {e for e, n in kept.items() if n > line}
    out = diagrams.Bpmn()
    node = {a: out.add("start" if a == "▶" else "end" if a == "■" else "task", "" if a in "▶■" else a) for a in nodes}
    leave, enter = dict(node), dict(node)
    for a in nodes:
        after = sorted(b for x, b in chosen if x == a)
        if len(after) > 1:
            together = all((b, c) in concurrent for b, c in itertools.combinations(after, 2))
            some = any((b, c) in concurrent for b, c in itertools.combinations(after, 2))
            g = out.add("parallel" if together else "inclusive" if some else "exclusive")
            out.flows.append((node[a], g))
            leave[a] = g
        before = sorted(x for x, b in chosen if b == a)
        if len(before) > 1:
            together = all((b, c) in concurrent for b, c in itertools.combinations(before, 2))
            some = any((b, c) in concurrent for b, c in itertools.combinations(before, 2))
            g = out.add("parallel" if together else "inclusive" if some else "exclusive")
            out.flows.append((g, node[a]))
            enter[a] = g
    out.flows += [(leave[a], enter[b]) for a, b in sorted(chosen)]
    for a in sorted(alone & set(nodes)):
        first, last = out.add("exclusive"), out.add("exclusive")
        out.flows = [(x, first) if y == node[a] else (last, y) if x == node[a] else (x, y) for x, y in out.flows]
        out.flows += [(first, node[a]), (node[a], last), (last, first)]
    return diagrams.without_trivial(out)


def genetic(variants: miners.Variants, rounds: int = 30, size: int = 20, seed: int = 0) -> tuple[HeuristicsNet, float]:
    """A dependency net by selection: individuals are subsets of the edges, parents recombine, a few edges flip; the fitness is
    the share of events (and ends) that follow along chosen edges, less a little for every chosen edge."""
    edges, starts, ends = miners.edges_of(variants)
    names = sorted(edges)
    g = np.random.default_rng(seed)
    counts = np.array([edges[e] for e in names], float)
    whole = counts.sum() or 1.0
    fitness = lambda x: float(counts[x].sum() / whole - 0.2 * x.mean()) if len(x) else 0.0
    people = [g.random(len(names)) < g.uniform(0.3, 1.0) for _ in range(size)]
    for _ in range(rounds):
        people.sort(key=fitness, reverse=True)
        best = people[: max(2, size // 4)]
        people = list(best)
        while len(people) < size:
            a, b = (best[int(i)] for i in g.integers(len(best), size=2))
            child = np.where(g.random(len(names)) < 0.5, a, b)
            people.append(child ^ (g.random(len(names)) < 0.02))
    top = max(people, key=fitness)
    chosen = Counter({e: edges[e] for e, k in zip(names, top, strict=True) if k})
    return heuristics_of(chosen, starts, ends, dependency=-1.0, noise=0.0), fitness(top)


def correlation(times: dict[str, list[float]]) -> dict[tuple[str, str], tuple[int, float]]:
    """Edges of a log without cases: activity -> times.  (count, mean seconds) by pair.

    A pair's share of precedence and mean distance make its cost; a transport program over the activities' counts
    picks the flows of the least cost.
    """
    from tracelake.operators.petri import linear_program

    acts = sorted(times)
    ordered = {a: np.sort(np.array(times[a], float)) for a in acts}
    n, big = len(acts), 1e11
    cost, far = np.full((n, n), big), np.zeros((n, n))
    for i, a in enumerate(acts):
        for j, b in enumerate(acts):
            x, y = ordered[a], ordered[b]
            if i == j or not len(x) or not len(y):
                continue
            share = (len(y) - np.searchsorted(y, x, side="right")).sum() / (len(x) * len(y))
            pairs = first_pairs(x, y)
            if share > 0 and len(pairs):
                far[i, j] = float(np.mean([v - u for u, v in pairs]))
                cost[i, j] = max(far[i, j], 1e-6) / share / min(len(x), len(y))
    size = [len(ordered[a]) for a in acts]
    # out and in of an activity never exceed its count; slack takes the rest, at a cost over every real one's
    k = n * n
    rows, right, costs = [], [], np.concatenate([cost.ravel(), np.full(2 * n, big / 10)])
    for side in (0, 1):
        for i in range(n):
            r = np.zeros(k + 2 * n)
            r[[i * n + j if side == 0 else j * n + i for j in range(n)]] = 1
            r[k + side * n + i] = 1
            rows.append(r)
            right.append(size[i])
    got = linear_program(costs, np.array(rows), np.array(right, float)) if n else None
    out = {}
    for i, j in itertools.product(range(n), repeat=2):
        if got is not None and got[i * n + j] > 1e-6 and cost[i, j] < big:
            out[acts[i], acts[j]] = round(float(got[i * n + j])), float(far[i, j])
    return out


def first_pairs(x: np.ndarray, y: np.ndarray) -> list[tuple[float, float]]:
    """Each time of x with the first later one of y that no earlier one took; of first-in and last-in order the one of the lesser mean."""

    def greedy(a, b):
        out, j = [], 0
        for u in a:
            while j < len(b) and b[j] < u:
                j += 1
            if j == len(b):
                break
            out.append((float(u), float(b[j])))
            j += 1
        return out

    one = greedy(x, y)
    two = [(-v, -u) for u, v in greedy(-y[::-1], -x[::-1])]
    mean = lambda p: np.mean([v - u for u, v in p]) if p else np.inf
    return one if mean(one) <= mean(two) else two


def assignment(left: list[float], right: list[float]) -> list[tuple[float, float]]:
    """The pairing of least total distance of all of the shorter side, less pairs whose second time comes first."""
    if not left or not right:
        return []
    swapped = len(left) > len(right)
    a, b = (right, left) if swapped else (left, right)
    n, m = len(a), len(b)
    cost = np.abs(np.subtract.outer(np.array(a, float), np.array(b, float)))
    late = np.subtract.outer(np.array(a, float), np.array(b, float)) if not swapped else -np.subtract.outer(np.array(a, float), np.array(b, float))
    cost = np.where(late > 0, 1e12 + cost, cost)
    # shortest augmenting paths with potentials
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = np.flatnonzero(~used[1:]) + 1
            now = cost[i0 - 1, free - 1] - u[i0] - v[free]
            better = now < least[free]
            least[free[better]], way[free[better]] = now[better], j0
            j1 = int(free[np.argmin(least[free])])
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if not match[j0]:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    pairs = [(a[match[j] - 1], b[j - 1]) for j in range(1, m + 1) if match[j]]
    pairs = [(y, x) for x, y in pairs] if swapped else pairs
    return sorted((float(x), float(y)) for x, y in pairs if y >= x)


def flower(acts: list[str]) -> Net:
    return net_of(Tree("*", None, (Tree(), *(Tree(label=a) for a in acts))))
