"""Process trees and Petri nets on the driver: conversion, text forms, token replay, alignment, playout.

Models are small; logs reach them as distinct variants, or they go to the variants in workers.
"""

from __future__ import annotations

import heapq
import itertools
import xml.etree.ElementTree as ET
from collections import Counter, deque
from dataclasses import dataclass, field

import numpy as np

SILENT = None


@dataclass(frozen=True)
class Tree:
    """op is "->", "X", "+", "*" (do, redo) or "" for a leaf; a leaf without label is silent."""

    op: str = ""
    label: str | None = SILENT
    children: tuple[Tree, ...] = ()

    def __str__(self) -> str:
        if not self.op:
            return "tau" if self.label is None else f"'{self.label}'"
        return f"{self.op}( {', '.join(map(str, self.children))} )"


def parse_tree(text: str) -> Tree:
    """Reads the notation that ``str`` writes."""
    at = 0

    def blank() -> None:
        nonlocal at
        while at < len(text) and text[at].isspace():
            at += 1

    def node() -> Tree:
        nonlocal at
        blank()
        if text[at] == "'":
            end = text.index("'", at + 1)
            label, at = text[at + 1 : end], end + 1
            return Tree(label=label)
        if text.startswith("tau", at):
            at += 3
            return Tree()
        op = next(o for o in ("->", "X", "+", "*") if text.startswith(o, at))
        at += len(op)
        blank()
        at += 1  # the bracket
        children = [node()]
        blank()
        while text[at] == ",":
            at += 1
            children.append(node())
            blank()
        at += 1
        return Tree(op, None, tuple(children))

    return node()


@dataclass
class Net:
    """An accepting net.  transitions: (name, label or None, places in, places out)."""

    transitions: list[tuple[str, str | None, tuple[int, ...], tuple[int, ...]]] = field(default_factory=list)
    places: int = 0
    initial: Counter = field(default_factory=Counter)
    final: Counter = field(default_factory=Counter)

    def place(self) -> int:
        self.places += 1
        return self.places - 1

    def add(self, label: str | None, before: list[int], after: list[int]) -> None:
        self.transitions.append((f"t{len(self.transitions)}", label, tuple(before), tuple(after)))


def net_of(tree: Tree) -> Net:
    """The tree's net with one source and one sink."""
    net = Net()
    source, sink = net.place(), net.place()
    net.initial[source] = net.final[sink] = 1

    def build(t: Tree, a: int, b: int) -> None:
        if not t.op:
            net.add(t.label, [a], [b])
        elif t.op == "->":
            at = a
            for i, c in enumerate(t.children):
                to = b if i == len(t.children) - 1 else net.place()
                build(c, at, to)
                at = to
        elif t.op == "X":
            for c in t.children:
                build(c, a, b)
        elif t.op == "+":
            ends = [(net.place(), net.place()) for _ in t.children]
            net.add(None, [a], [x for x, _ in ends])
            for c, (x, y) in zip(t.children, ends, strict=True):
                build(c, x, y)
            net.add(None, [y for _, y in ends], [b])
        else:
            x, y = net.place(), net.place()
            net.add(None, [a], [x])
            build(t.children[0], x, y)
            for c in t.children[1:]:
                build(c, y, x)
            net.add(None, [y], [b])

    build(tree, source, sink)
    return net


def marking(c: Counter) -> tuple:
    return tuple(sorted((p, n) for p, n in c.items() if n))


def enabled(net: Net, m: Counter) -> list[int]:
    return [i for i, (_, _, a, _) in enumerate(net.transitions) if all(m[p] >= n for p, n in Counter(a).items())]


def fired(net: Net, m: Counter, i: int) -> Counter:
    out = Counter(m)
    out.subtract(net.transitions[i][2])
    out.update(net.transitions[i][3])
    return +out


def silent_path(net: Net, m: Counter, goal, most: int | None = None) -> list[int] | None:
    """Shortest run of silent transitions after which ``goal`` holds (by name at ties); None if there is none, or not
    within ``most`` markings, if given.  Without ``most`` silent transitions must not make tokens without end."""
    if goal(m):
        return []
    seen, queue = {marking(m)}, deque([(m, [])])
    while queue and (most is None or len(seen) < most):
        at, path = queue.popleft()
        for i in enabled(net, at):
            if net.transitions[i][1] is None:
                to = fired(net, at, i)
                if marking(to) not in seen:
                    if goal(to):
                        return [*path, i]
                    seen.add(marking(to))
                    queue.append((to, [*path, i]))
    return None


@dataclass
class Replay:
    missing: int = 0
    consumed: int = 0
    remaining: int = 0
    produced: int = 0
    unknown: int = 0
    activated: list[int] = field(default_factory=list)

    @property
    def fitness(self) -> float:
        if not self.consumed or not self.produced:
            return 0.0
        return 0.5 * (1 - self.missing / self.consumed) + 0.5 * (1 - self.remaining / self.produced)

    @property
    def fits(self) -> bool:
        return not (self.missing or self.remaining or self.unknown)


def replay(net: Net, trace: tuple[str, ...]) -> Replay:
    """Token replay: silent paths first, then missing tokens."""
    r, m = Replay(), Counter(net.initial)
    r.produced += sum(m.values())

    def fire(i: int) -> None:
        nonlocal m
        _, _, a, b = net.transitions[i]
        for p, n in Counter(a).items():
            lack = max(0, n - m[p])
            r.missing += lack
            m[p] += lack
        r.consumed += len(a)
        r.produced += len(b)
        m = fired(net, m, i)
        r.activated.append(i)

    by_label: dict = {}
    for i, t in enumerate(net.transitions):
        by_label.setdefault(t[1], []).append(i)
    for act in trace:
        options = by_label.get(act)
        if not options:
            r.unknown += 1
            continue
        on = [i for i in options if i in enabled(net, m)]
        if not on:
            path = silent_path(net, m, lambda x, o=options: any(i in o for i in enabled(net, x)))
            for i in path or []:
                fire(i)
            on = [i for i in options if i in enabled(net, m)]
        fire((on or options)[0])
    for i in silent_path(net, m, lambda x: all(x[p] >= n for p, n in net.final.items())) or []:
        fire(i)
    for p, n in net.final.items():
        r.missing += max(0, n - m[p])
        r.consumed += n
        m[p] = max(0, m[p] - n)
    r.remaining = sum(m.values())
    return r


def align(net: Net, trace: tuple[str, ...], most: int | None = None) -> tuple[int, list[tuple[str | None, str | None]]] | None:
    """Cheapest alignment: moves on log or model cost 10,000, silent moves 1.  Steps are (log, model); None is a skip.

    None if the final marking can't be reached, or not within ``most`` states, if given.
    """
    goal = marking(net.final)
    start = (0, marking(net.initial))
    best, tie = {start: 0}, itertools.count()
    heap = [(0, next(tie), start, None)]
    done = set()
    while heap and (most is None or len(done) < most):
        cost, _, state, back = heapq.heappop(heap)
        if state in done:
            continue
        done.add(state)
        at, m = state
        if at == len(trace) and m == goal:
            steps = []
            while back:
                steps.append(back[0])
                back = back[1]
            return cost, steps[::-1]
        now = Counter(dict(m))
        moves = [(10_000, (at + 1, m), (trace[at], None))] if at < len(trace) else []
        for i in enabled(net, now):
            label = net.transitions[i][1]
            to = marking(fired(net, now, i))
            if label is None:
                moves.append((1, (at, to), (None, None)))
            else:
                moves.append((10_000, (at, to), (None, label)))
                if at < len(trace) and trace[at] == label:
                    moves.append((0, (at + 1, to), (label, label)))
        for c, to, step in moves:
            if to not in done and cost + c < best.get(to, 1 << 60):
                best[to] = cost + c
                heapq.heappush(heap, (cost + c, next(tie), to, (step, back)))
    return None


def shortest_run(net: Net) -> int:
    """Visible moves on the cheapest way from start to end."""
    got = align(net, ())
    return sum(1 for _, m in got[1] if m is not None) if got else 0


def alignment_fitness(net: Net, trace: tuple[str, ...], shortest: int) -> tuple[int, float] | None:
    got = align(net, trace)
    if got is None:
        return None
    worst = len(trace) + shortest
    return got[0], 1.0 if not worst else 1 - (got[0] // 10_000) / worst


def play_out(net: Net, n: int, seed: int = 0, longest: int = 100) -> list[tuple[str, ...]]:
    """Random runs; each begins with its own stream of the seed."""
    out = []
    for k in range(n):
        g, m, run = np.random.default_rng([seed, k]), Counter(net.initial), []
        for _ in range(10 * longest):
            if marking(m) == marking(net.final) or len(run) >= longest:
                break
            on = enabled(net, m)
            if not on:
                break
            i = on[int(g.integers(len(on)))]
            if net.transitions[i][1] is not None:
                run.append(net.transitions[i][1])
            m = fired(net, m, i)
        out.append(tuple(run))
    return out


def footprints(net: Net, most: int = 10_000) -> dict:
    """Sequence and parallel pairs, start and end activities from reachable markings."""
    seen, queue, after = {}, deque([Counter(net.initial)]), set()
    visible: dict = {}

    def next_visible(m: Counter) -> set:
        key = marking(m)
        if key not in visible:
            found, stack, been = set(), [m], {key}
            while stack:
                x = stack.pop()
                for i in enabled(net, x):
                    to = fired(net, x, i)
                    if net.transitions[i][1] is not None:
                        found.add(i)
                    elif marking(to) not in been:
                        been.add(marking(to))
                        stack.append(to)
            visible[key] = found
        return visible[key]

    ends = set()
    seen[marking(net.initial)] = True
    while queue and len(seen) < most:
        m = queue.popleft()
        for i in enabled(net, m):
            to = fired(net, m, i)
            label = net.transitions[i][1]
            if label is not None:
                after |= {(label, net.transitions[j][1]) for j in next_visible(to)}
                if silent_path(net, to, lambda x: marking(x) == marking(net.final)) is not None:
                    ends.add(label)
            if marking(to) not in seen:
                seen[marking(to)] = True
                queue.append(to)
    both = {(a, b) for a, b in after if (b, a) in after}
    return {"sequence": after - both, "parallel": both, "start": {net.transitions[i][1] for i in next_visible(Counter(net.initial))}, "end": ends}


def write_pnml(net: Net) -> str:
    root = ET.Element("pnml")
    page = ET.SubElement(ET.SubElement(root, "net", id="net", type="http://www.pnml.org/version-2009/grammar/pnmlcoremodel"), "page", id="page")
    text = lambda e, tag, value: setattr(ET.SubElement(ET.SubElement(e, tag), "text"), "text", value)
    for p in range(net.places):
        e = ET.SubElement(page, "place", id=f"p{p}")
        text(e, "name", f"p{p}")
        if net.initial[p]:
            text(e, "initialMarking", str(net.initial[p]))
    arc = itertools.count()
    for name, label, a, b in net.transitions:
        e = ET.SubElement(page, "transition", id=name)
        text(e, "name", name if label is None else label)
        if label is None:
            ET.SubElement(e, "toolspecific", tool="ProM", version="6.4", activity="$invisible$")
        for p in a:
            ET.SubElement(page, "arc", id=f"a{next(arc)}", source=f"p{p}", target=name)
        for p in b:
            ET.SubElement(page, "arc", id=f"a{next(arc)}", source=name, target=f"p{p}")
    finals = ET.SubElement(ET.SubElement(page.find("..") if page.find("..") is not None else root[0], "finalmarkings"), "marking")
    for p, n in sorted(net.final.items()):
        e = ET.SubElement(finals, "place", idref=f"p{p}")
        setattr(ET.SubElement(e, "text"), "text", str(n))
    return ET.tostring(root, encoding="unicode")


def read_pnml(text: str) -> Net:
    if "<!DOCTYPE" in text:
        raise ValueError("a document type is not read")
    root = ET.fromstring(text)
    for e in root.iter():
        e.tag = e.tag.rpartition("}")[2]
    net, ids = Net(), {}
    inner = lambda e, tag: next((x.text for x in e.iter() if x.tag == "text" and x in list(e.find(tag))), None) if e.find(tag) is not None else None
    nodes = {}
    for e in root.iter("place"):
        if "id" in e.attrib:
            ids[e.attrib["id"]] = net.place()
            n = inner(e, "initialMarking")
            if n:
                net.initial[ids[e.attrib["id"]]] = int(n)
    for e in root.iter("transition"):
        silent = any(x.attrib.get("activity") == "$invisible$" for x in e.iter("toolspecific"))
        nodes[e.attrib["id"]] = (None if silent else inner(e, "name"), [], [])
    for e in root.iter("arc"):
        a, b = e.attrib["source"], e.attrib["target"]
        if a in ids and b in nodes:
            nodes[b][1].append(ids[a])
        elif a in nodes and b in ids:
            nodes[a][2].append(ids[b])
    for label, a, b in nodes.values():
        net.add(label, a, b)
    for e in root.iter("finalmarkings"):
        for p in e.iter("place"):
            net.final[ids[p.attrib["idref"]]] = int(p.find("text").text)
    return net


def write_ptml(tree: Tree) -> str:
    kinds = {"->": "sequence", "X": "xor", "+": "and", "*": "xorLoop"}
    root = ET.Element("ptml")
    top = ET.SubElement(root, "processTree", id="tree", name="tree")
    ids, links = itertools.count(), []

    def put(t: Tree) -> str:
        me = f"n{next(ids)}"
        if not t.op:
            ET.SubElement(top, "automaticTask" if t.label is None else "manualTask", id=me, name=t.label or "")
        else:
            ET.SubElement(top, kinds[t.op], id=me, name="")
            kids = list(t.children) + ([Tree()] if t.op == "*" and len(t.children) == 2 else [])
            links.extend((me, put(c)) for c in kids)
        return me

    top.attrib["root"] = put(tree)
    for i, (a, b) in enumerate(links):
        ET.SubElement(top, "parentsNode", id=f"l{i}", sourceId=a, targetId=b)
    return ET.tostring(root, encoding="unicode")


def read_ptml(text: str) -> Tree:
    if "<!DOCTYPE" in text:
        raise ValueError("a document type is not read")
    top = ET.fromstring(text).find("processTree")
    kinds = {"sequence": "->", "xor": "X", "and": "+", "xorLoop": "*"}
    nodes = {e.attrib["id"]: e for e in top if e.tag != "parentsNode"}
    kids: dict[str, list[str]] = {}
    for e in top.iter("parentsNode"):
        kids.setdefault(e.attrib["sourceId"], []).append(e.attrib["targetId"])

    def make(i: str) -> Tree:
        e = nodes[i]
        if e.tag in ("manualTask", "automaticTask"):
            return Tree(label=e.attrib["name"] if e.tag == "manualTask" else None)
        c = [make(k) for k in kids.get(i, [])]
        if e.tag == "xorLoop" and len(c) == 3:
            tail = c.pop()
            loop = Tree("*", None, tuple(c))
            return loop if tail == Tree() else Tree("->", None, (loop, tail))
        return Tree(kinds[e.tag], None, tuple(c))

    return make(top.attrib["root"])
