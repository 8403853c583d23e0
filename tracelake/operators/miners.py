"""Model discovery over small aggregates: variants or edge counts come from Spark, search runs on the driver."""

from __future__ import annotations

import itertools
from collections import Counter

from pyspark.sql import DataFrame

from tracelake.operators import core, discovery, stats
from tracelake.operators.nets import Net, Tree

Variants = dict[tuple[str, ...], int]


def variants_of(log: DataFrame, most: int = 1_000_000) -> Variants:
    """Distinct sequences with their cases.  More than ``most`` of them raise: the driver holds a model's input, not a log."""
    rows = core.variants(log).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} variants; discover from edge counts instead")
    return {tuple(r["seq"]): r["n"] for r in rows}


def edges_of(variants: Variants) -> tuple[Counter, Counter, Counter]:
    """Edge, start and end counts."""
    edges, starts, ends = Counter(), Counter(), Counter()
    for v, n in variants.items():
        if v:
            starts[v[0]] += n
            ends[v[-1]] += n
            for pair in itertools.pairwise(v):
                edges[pair] += n
    return edges, starts, ends


def groups(nodes: set, linked) -> list[set]:
    """Connected components of a symmetric relation, larger first, then by least name."""
    left, out = set(nodes), []
    while left:
        part, stack = set(), [min(left)]
        while stack:
            x = stack.pop()
            if x in left:
                left.discard(x)
                part.add(x)
                stack += [y for y in left if linked(x, y)]
        out.append(part)
    return sorted(out, key=lambda p: (-len(p), min(p)))


def reachable(nodes: set, edges) -> dict[str, set]:
    out = {}
    for a in nodes:
        seen, stack = set(), [a]
        while stack:
            for b in nodes:
                if (stack[-1], b) in edges and b not in seen:
                    break
            else:
                stack.pop()
                continue
            seen.add(b)
            stack.append(b)
        out[a] = seen
    return out


def xor_cut(acts: set, edges, starts, ends) -> list[set] | None:
    parts = groups(acts, lambda a, b: (a, b) in edges or (b, a) in edges)
    return parts if len(parts) > 1 else None


def sequence_cut(acts: set, edges, starts, ends) -> list[set] | None:
    r = reachable(acts, edges)
    parts = groups(acts, lambda a, b: (b in r[a]) == (a in r[b]))
    if len(parts) < 2:
        return None
    # every member of one part reaches, or is reached by, every one of another
    before = lambda p, q: min(q) in r[min(p)]
    return sorted(parts, key=lambda p: (sum(before(q, p) for q in parts if q is not p), min(p)))


def concurrent_cut(acts: set, edges, starts, ends) -> list[set] | None:
    parts = groups(acts, lambda a, b: (a, b) not in edges or (b, a) not in edges)
    good = [p for p in parts if p & set(starts) and p & set(ends)]
    rest = [p for p in parts if not (p & set(starts) and p & set(ends))]
    if not good:
        return None
    for p in rest:
        good[0] |= p
    return good if len(good) > 1 else None


def loop_cut(acts: set, edges, starts, ends) -> list[set] | None:
    do = set(starts) | set(ends)
    inner = acts - do
    if not inner:
        return None
    parts = groups(inner, lambda a, b: (a, b) in edges or (b, a) in edges)
    redo = []
    for p in parts:
        into = {a for a, b in edges if b in p and a not in p}
        out = {b for a, b in edges if a in p and b not in p}
        from_ends = all((e, x) in edges for x in {b for a, b in edges if b in p and a in ends} for e in ends)
        to_starts = all((x, s) in edges for x in {a for a, b in edges if a in p and b in starts} for s in starts)
        if into <= set(ends) and out <= set(starts) and into and out and from_ends and to_starts:
            redo.append(p)
        else:
            do |= p
    return [do, *redo] if redo else None


CUTS = (("X", xor_cut), ("->", sequence_cut), ("+", concurrent_cut), ("*", loop_cut))


def _split(variants: Variants, op: str, parts: list[set]) -> list[Variants]:
    out: list[Counter] = [Counter() for _ in parts]
    for v, n in variants.items():
        if op == "X":
            best = max(range(len(parts)), key=lambda i: (sum(a in parts[i] for a in v), -i))
            out[best][tuple(a for a in v if a in parts[best])] += n
        elif op == "+":
            for i, p in enumerate(parts):
                out[i][tuple(a for a in v if a in p)] += n
        elif op == "->":
            at = 0
            for i, p in enumerate(parts):
                end = len(v) if i == len(parts) - 1 else at
                if i < len(parts) - 1:
                    later = set().union(*parts[i + 1 :])
                    while end < len(v) and v[end] not in later:
                        end += 1
                out[i][tuple(a for a in v[at:end] if a in p)] += n
                at = end
        else:
            run, now = [], 0
            for a in v:
                i = next(i for i, p in enumerate(parts) if a in p)
                if i != now:
                    out[now][tuple(run)] += n
                    run, now = [], i
                run.append(a)
            out[now][tuple(run)] += n
            if now:
                out[0][()] += n
    return [dict(o) for o in out]


def inductive(variants: Variants) -> Tree:
    """Inductive miner: cuts in the order exclusive, sequence, concurrent, loop; then fall-throughs."""
    variants = {v: n for v, n in variants.items() if n}
    acts = {a for v in variants for a in v}
    if not acts:
        return Tree()
    if () in variants:
        return Tree("X", None, (Tree(), inductive({v: n for v, n in variants.items() if v})))
    if len(acts) == 1 and all(len(v) == 1 for v in variants):
        return Tree(label=next(iter(acts)))
    edges, starts, ends = edges_of(variants)
    if len(acts) > 1:
        for op, cut in CUTS:
            parts = cut(acts, edges, starts, ends)
            if parts:
                return Tree(op, None, tuple(map(inductive, _split(variants, op, parts))))
    # an activity once in every trace, beside the rest
    for a in sorted(acts):
        if len(acts) > 1 and all(v.count(a) == 1 for v in variants):
            rest: Counter = Counter()
            for v, n in variants.items():
                rest[tuple(x for x in v if x != a)] += n
            return Tree("+", None, (Tree(label=a), inductive(dict(rest))))
    # traces that begin anew: cut before a start that follows an end
    again: Counter = Counter()
    for v, n in variants.items():
        at = 0
        for i in range(1, len(v)):
            if v[i] in starts and v[i - 1] in ends:
                again[v[at:i]] += n
                at = i
        again[v[at:]] += n
    if sum(again.values()) > sum(variants.values()):
        return Tree("*", None, (inductive(dict(again)), Tree()))
    return Tree("*", None, (Tree(), *(Tree(label=a) for a in sorted(acts)))) if len(acts) > 1 else Tree("*", None, (Tree(label=min(acts)), Tree()))


def inductive_dfg(edges: Counter, starts: Counter, ends: Counter) -> Tree:
    """The same cuts on an edge graph alone: the input no longer grows with the log."""
    acts = {a for e in edges for a in e} | set(starts) | set(ends)
    if not acts:
        return Tree()
    if len(acts) == 1:
        a = min(acts)
        return Tree("*", None, (Tree(label=a), Tree())) if (a, a) in edges else Tree(label=a)
    for op, cut in CUTS:
        parts = cut(acts, edges, starts, ends)
        if not parts:
            continue
        kids = []
        for i, p in enumerate(parts):
            inner = Counter({e: n for e, n in edges.items() if e[0] in p and e[1] in p})
            s, e = Counter({a: n for a, n in starts.items() if a in p}), Counter({a: n for a, n in ends.items() if a in p})
            if op == "->" or (op == "*" and i):
                for (a, b), n in edges.items():
                    if b in p and a not in p:
                        s[b] += n
                    if a in p and b not in p:
                        e[a] += n
            kid = inductive_dfg(inner, s, e)
            skipped = op == "->" and (any(a in set().union(*parts[:i]) and b in set().union(*parts[i + 1 :]) for a, b in edges) or (i == 0 and any(a not in p for a in starts)) or (i == len(parts) - 1 and any(a not in p for a in ends)))
            kids.append(Tree("X", None, (Tree(), kid)) if skipped else kid)
        return Tree(op, None, tuple(kids))
    return Tree("*", None, (Tree(), *(Tree(label=a) for a in sorted(acts))))


def graph_of(log: DataFrame) -> tuple[Counter, Counter, Counter]:
    """Edge, start and end counts of a log (as many rows as pairs of activities)."""
    edges = Counter({(r["source"], r["target"]): r["n"] for r in discovery.dfg(log).collect()})
    starts = Counter({r["act"]: r["n"] for r in stats.start_activities(log).collect()})
    ends = Counter({r["act"]: r["n"] for r in stats.end_activities(log).collect()})
    return edges, starts, ends


def alpha(edges: Counter, starts: Counter, ends: Counter) -> Net:
    """Alpha miner: places between maximal pairs of sets where each of one causes each of the other."""
    acts = sorted({a for e in edges for a in e} | set(starts) | set(ends))
    cause = {(a, b) for a, b in edges if (b, a) not in edges}
    apart = lambda a, b: (a, b) not in edges and (b, a) not in edges
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
    maximal = [p for p in pairs if not any(p != q and p[0] <= q[0] and p[1] <= q[1] for q in pairs)]
    net = Net()
    into, out = {a: [] for a in acts}, {a: [] for a in acts}
    source, sink = net.place(), net.place()
    net.initial[source] = net.final[sink] = 1
    for a in starts:
        into[a].append(source)
    for a in ends:
        out[a].append(sink)
    for x, y in sorted(maximal, key=lambda p: (sorted(p[0]), sorted(p[1]))):
        p = net.place()
        for a in x:
            out[a].append(p)
        for b in y:
            into[b].append(p)
    for a in acts:
        net.add(a, into[a], out[a])
    return net


# --- declarative rules


def _places(v: tuple[str, ...]) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for i, a in enumerate(v):
        out.setdefault(a, []).append(i)
    return out


def rule_scores(v: tuple[str, ...], acts: list[str]) -> dict[tuple, int]:
    """(rule, a, b) -> 1 or -1 for a trace; rules that don't apply to it are left out."""
    at, out = _places(v), {}
    sign = lambda ok: 1 if ok else -1
    for a in acts:
        p = at.get(a, [])
        out["existence", a, ""] = sign(p)
        out["absence", a, ""] = sign(not p)
        if p:
            out["exactly_one", a, ""] = sign(len(p) == 1)
        out["init", a, ""] = sign(bool(v) and v[0] == a)
    for a, b in itertools.permutations(acts, 2):
        p, q = at.get(a), at.get(b)
        if p:
            out["responded_existence", a, b] = sign(q)
            out["non_responded_existence", a, b] = sign(not q)
            out["response", a, b] = sign(q and p[-1] < q[-1])
            nexts = [*p[1:], len(v)]
            out["alternate_response", a, b] = sign(q and all(any(i < j < k for j in q) for i, k in zip(p, nexts, strict=True)))
            out["chain_response", a, b] = sign(all(i + 1 < len(v) and v[i + 1] == b for i in p))
        if q:
            out["precedence", a, b] = sign(p and p[0] < q[0])
            befores = [-1, *q[:-1]]
            out["alternate_precedence", a, b] = sign(p and all(any(k < i < j for i in p) for k, j in zip(befores, q, strict=True)))
            out["chain_precedence", a, b] = sign(all(j and v[j - 1] == a for j in q))
    for a, b in itertools.permutations(acts, 2):
        for name, one, two in (("succession", "response", "precedence"), ("alternate_succession", "alternate_response", "alternate_precedence"), ("chain_succession", "chain_response", "chain_precedence")):
            if (one, a, b) in out and (two, a, b) in out:
                out[name, a, b] = min(out[one, a, b], out[two, a, b])
        if ("responded_existence", a, b) in out or ("responded_existence", b, a) in out:
            out["coexistence", a, b] = min(out.get(("responded_existence", a, b), 1), out.get(("responded_existence", b, a), 1))
    return out


def declare(log: DataFrame, support: float = 0.1, confidence: float = 0.8) -> DataFrame:
    """rule, a, b, support, confidence (shares of cases); each variant is scored once, in a worker."""
    import pandas as pd
    from pyspark.sql import functions as F

    from tracelake.functions.shipping import ship_package

    ship_package(log.sparkSession)
    acts = sorted(r["act"] for r in log.select("act").distinct().collect())
    n = log.agg(F.count_distinct("case_id")).first()[0]

    def score(parts):
        for part in parts:
            total: Counter = Counter()
            for seq, k in zip(part["seq"], part["n"], strict=True):
                for rule, s in rule_scores(tuple(seq), acts).items():
                    total[(*rule, "held")] += k * (s > 0)
                    total[(*rule, "met")] += k
            rules = sorted({r[:3] for r in total})
            yield pd.DataFrame({"rule": [r[0] for r in rules], "a": [r[1] for r in rules], "b": [r[2] for r in rules], "held": [total[(*r, "held")] for r in rules], "met": [total[(*r, "met")] for r in rules]})

    scored = core.variants(log).mapInPandas(score, "rule string, a string, b string, held long, met long").groupBy("rule", "a", "b").agg(F.sum("held").alias("held"), F.sum("met").alias("met"))
    out = scored.select("rule", "a", "b", (F.col("met") / F.lit(n)).alias("support"), (F.col("held") / F.col("met")).alias("confidence"))
    return out.filter((F.col("support") >= support) & (F.col("confidence") >= confidence))
