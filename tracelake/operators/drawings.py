"""DOT texts of models and small results, and their files.

Everything here works on what already is small: models, counts by activity, or drawn samples.  ``write``
saves the text itself, or calls Graphviz for other endings.
"""

from __future__ import annotations

import shutil
import subprocess
from collections import Counter
from pathlib import Path

from tracelake.operators.nets import Net, Tree

SCALE = ("#e8f0fa", "#cfe0f5", "#a9c8ec", "#7eabdf", "#4f8acb", "#2b68ad")


def quoted(x) -> str:
    return '"' + str(x).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'


def styled(options: dict) -> str:
    parts = [f"{k}={quoted(v)}" for k, v in options.items() if v is not None]
    return f" [{', '.join(parts)}]" if parts else ""


class Dot:
    """Lines of a graph in order."""

    def __init__(self, directed: bool = True, **options):
        self.arrow, self.lines = ("->", ["digraph {"]) if directed else ("--", ["graph {"])
        self.lines += [f"  {k}={quoted(v)};" for k, v in options.items()]

    def node(self, name, label=None, **options) -> None:
        self.lines.append(f"  {quoted(name)}{styled({'label': name if label is None else label} | options)};")

    def edge(self, a, b, label=None, **options) -> None:
        self.lines.append(f"  {quoted(a)} {self.arrow} {quoted(b)}{styled({'label': label} | options)};")

    def __str__(self) -> str:
        return "\n".join([*self.lines, "}"]) + "\n"


def shade(n: float, most: float) -> str:
    return SCALE[min(len(SCALE) - 1, int(len(SCALE) * n / most))] if most > 0 else SCALE[0]


def width(n: float, most: float) -> str:
    return f"{1 + 3 * n / most:.2f}" if most > 0 else "1.00"


def duration(seconds: float) -> str:
    """Seconds in the largest unit of which there is one at least."""
    for unit, size in (("D", 86400), ("h", 3600), ("m", 60)):
        if abs(seconds) >= size:
            return f"{seconds / size:.4g}{unit}"
    return f"{seconds:.4g}s"


def write(text: str, path: str, engine: str = "dot") -> str:
    """Saves a DOT text (.dot, .gv), or what Graphviz draws of it; returns the path."""
    kind = Path(path).suffix.lstrip(".").lower()
    if kind in ("dot", "gv", ""):
        Path(path).write_text(text, encoding="utf-8")
        return path
    tool = shutil.which(engine)
    if tool is None:
        raise FileNotFoundError(f"Graphviz ({engine}) is not installed; save as .dot instead")
    subprocess.run([tool, f"-T{kind}", "-o", path], input=text.encode(), check=True)
    return path


def write_neato(text: str, path: str) -> str:
    """As ``write``, with fixed positions."""
    return write(text, path, "neato")


# --- edge graphs


def dfg_dot(edges: Counter, starts: Counter, ends: Counter, counts: Counter | None = None, most_edges: int | None = None) -> str:
    """An edge graph; of many edges the most frequent ones, if a number is given."""
    return _graph(edges, starts, ends, counts or Counter(), most_edges, str)


def performance_dfg_dot(seconds: dict[tuple[str, str], float], starts: Counter, ends: Counter, counts: Counter | None = None, most_edges: int | None = None) -> str:
    """The same with durations on the edges; the slowest are the widest."""
    return _graph(seconds, starts, ends, counts or Counter(), most_edges, duration)


def _graph(edges, starts, ends, counts, most_edges, shown) -> str:
    chosen = sorted(edges.items(), key=lambda e: (-e[1], e[0]))[:most_edges]
    acts = sorted({a for (a, b), _ in chosen for a in (a, b)} | set(starts) | set(ends))
    top, many = max((n for _, n in chosen), default=0), max(counts.values(), default=0)
    dot = Dot(rankdir="LR")
    for a in acts:
        dot.node(a, f"{a} ({counts[a]})" if counts.get(a) else a, shape="box", style="filled", fillcolor=shade(counts.get(a, 0), many))
    for (a, b), n in sorted(chosen):
        dot.edge(a, b, shown(n), penwidth=width(n, top))
    for side, shape, ours in (("@start", "circle", starts), ("@end", "doublecircle", ends)):
        if ours:
            dot.node(side, "", shape=shape, style="filled", fillcolor="#1b9e4b" if side == "@start" else "#c0392b")
        for a, n in sorted(ours.items()):
            dot.edge(*((side, a) if side == "@start" else (a, side)), n, penwidth=width(n, max(ours.values())))
    return str(dot)


def heuristics_dot(edges: list[tuple[str, str, int, float]], counts: Counter, starts: Counter, ends: Counter) -> str:
    """A dependency net: count and dependency on each edge."""
    dot, top = Dot(), max((n for *_, n, _ in edges), default=0)
    for a, n in sorted(counts.items()):
        dot.node(a, f"{a} ({n})", shape="box", style="filled", fillcolor=shade(n, max(counts.values())))
    for a, b, n, d in sorted(edges):
        dot.edge(a, b, f"{n} ({d:.3f})", penwidth=width(n, top))
    for side, ours in (("@start", starts), ("@end", ends)):
        if ours:
            dot.node(side, side[1:], shape="circle", style="filled", fillcolor="#eeeeee")
        for a, n in sorted(ours.items()):
            dot.edge(*((side, a) if side == "@start" else (a, side)), n)
    return str(dot)


def network_dot(rows: list[tuple[str, str, str, int]], directed: bool = True) -> str:
    """source, target, edge, n of a network analysis."""
    dot, top = Dot(directed), max((n for *_, n in rows), default=0)
    for x in sorted({x for a, b, *_ in rows for x in (a, b)}):
        dot.node(x, shape="ellipse")
    for a, b, e, n in sorted(rows):
        dot.edge(a, b, f"{e} ({n})", penwidth=width(n, top))
    return str(dot)


def network_performance_dot(rows: list[tuple[str, str, str, float]]) -> str:
    """source, target, edge, mean seconds."""
    dot, top = Dot(), max((n for *_, n in rows), default=0)
    for x in sorted({x for a, b, *_ in rows for x in (a, b)}):
        dot.node(x, shape="ellipse")
    for a, b, e, n in sorted(rows):
        dot.edge(a, b, f"{e} ({duration(n)})", penwidth=width(n, top))
    return str(dot)


def footprints_dot(model) -> str:
    """Footprints as a table: > and < for sequences, || for parallels, # for neither."""
    acts = sorted(set(model.activities) | {a for p in (*model.sequence, *model.parallel) for a in p})
    mark = lambda a, b: "||" if (a, b) in model.parallel else "&gt;" if (a, b) in model.sequence else "&lt;" if (b, a) in model.sequence else "#"
    return _table(acts, mark, lambda a, b: "#ffffff")


def footprints_comparison_dot(found, wanted) -> str:
    """The second model's footprints; cells where the first differs are red."""
    acts = sorted(set(found.activities) | set(wanted.activities))

    def mark(model, a, b):
        return "||" if (a, b) in model.parallel else "&gt;" if (a, b) in model.sequence else "&lt;" if (b, a) in model.sequence else "#"

    return _table(acts, lambda a, b: mark(wanted, a, b), lambda a, b: "#ffffff" if mark(found, a, b) == mark(wanted, a, b) else "#f5b7b1")


def _escaped(x: str) -> str:
    return x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _table(acts: list[str], mark, colour) -> str:
    head = "<TR><TD></TD>" + "".join(f"<TD><B>{_escaped(a)}</B></TD>" for a in acts) + "</TR>"
    rows = "".join(f"<TR><TD><B>{_escaped(a)}</B></TD>" + "".join(f'<TD BGCOLOR="{colour(a, b)}">{mark(a, b)}</TD>' for b in acts) + "</TR>" for a in acts)
    return f'digraph {{\n  "table" [shape="plain", label=<<TABLE BORDER="0" CELLBORDER="1" CELLSPACING="0">{head}{rows}</TABLE>>];\n}}\n'


# --- models


def petri_net_dot(net: Net, frequency: Counter | None = None) -> str:
    """Places as circles (tokens inside, final ones doubled), transitions as boxes (silent ones black)."""
    dot, n = Dot(rankdir="LR"), frequency or Counter()
    for p in range(net.places):
        dot.node(f"p{p}", net.initial[p] or "", shape="doublecircle" if net.final[p] else "circle", style="filled", fillcolor="#f9e79f" if net.initial[p] else "#ffffff")
    for i, (name, label, before, after) in enumerate(net.transitions):
        dot.node(name, "" if label is None else f"{label} ({n[i]})" if n[i] else label, shape="box", style="filled", fillcolor="#000000" if label is None else shade(n[i], max(n.values(), default=0)))
        for p, k in sorted(Counter(before).items()):
            dot.edge(f"p{p}", name, k if k > 1 else None)
        for p, k in sorted(Counter(after).items()):
            dot.edge(name, f"p{p}", k if k > 1 else None)
    return str(dot)


def process_tree_dot(tree: Tree) -> str:
    dot, names = Dot(False), {"->": "seq", "X": "xor", "+": "and", "*": "xor loop", "O": "or"}

    def put(t: Tree, at: str) -> None:
        dot.node(at, names[t.op] if t.op else "" if t.label is None else t.label, shape="circle" if t.op else "box", style=None if t.op or t.label is not None else "filled", fillcolor=None if t.op or t.label is not None else "#000000")
        for i, c in enumerate(t.children):
            dot.edge(at, f"{at}.{i}")
            put(c, f"{at}.{i}")

    put(tree, "0")
    return str(dot)


def powl_dot(model) -> str:
    """Choices, loops and partial orders as clusters; orders are drawn without what follows from others."""
    dot = Dot(rankdir="LR", compound="true")

    def put(m, at: str) -> str:
        if m.kind == "leaf":
            dot.node(at, "" if m.label is None else m.label, shape="box", style=None if m.label is not None else "filled", fillcolor=None if m.label is not None else "#000000")
            return at
        dot.lines += [f"  subgraph {quoted('cluster' + at)} {{", f"  label={quoted({'X': 'choice', '*': 'loop', 'order': 'order'}[m.kind])};"]
        heads = [put(c, f"{at}.{i}") for i, c in enumerate(m.children)]
        dot.lines.append("  }")
        for i, j in sorted(m.reduced()) if m.kind == "order" else []:
            dot.edge(heads[i], heads[j])
        return heads[0]

    put(model, "0")
    return str(dot)


def bpmn_dot(model) -> str:
    """Tasks as boxes, gateways as diamonds (X, +, O), events as circles."""
    dot, marks = Dot(rankdir="LR"), {"exclusive": "X", "parallel": "+", "inclusive": "O"}
    for i, (kind, name) in sorted(model.nodes.items()):
        if kind in marks:
            dot.node(i, marks[kind], shape="diamond")
        elif kind in ("start", "end", "intermediate"):
            dot.node(i, name or "", shape="doublecircle" if kind == "end" else "circle")
        else:
            dot.node(i, name, shape="box")
    for a, b in sorted(model.flows):
        dot.edge(a, b)
    return str(dot)


def transition_system_dot(rows: list[tuple[str, str, str, int]]) -> str:
    """source state, activity, target state, n."""
    dot = Dot()
    for x in sorted({x for a, _, b, _ in rows for x in (a, b)}):
        dot.node(x, shape="ellipse")
    for a, act, b, n in sorted(rows):
        dot.edge(a, b, f"{act} ({n})")
    return str(dot)


def prefix_tree_dot(rows: list[tuple[tuple[str, ...], int, int]]) -> str:
    """prefix, n, n_final; where cases end is doubled."""
    dot = Dot(rankdir="LR")
    dot.node("", "root", shape="circle")
    for prefix, n, final in sorted(rows):
        at = "\x1f".join(prefix)
        dot.node(at, f"{prefix[-1]} ({n})", shape="box", peripheries=2 if final else 1)
        dot.edge("\x1f".join(prefix[:-1]), at)
    return str(dot)


# --- alignments


def alignment_dot(steps: list[tuple[str | None, str | None]]) -> str:
    """One alignment as a row of moves: green for both, yellow on the log alone, violet on the model alone, grey for silent ones."""
    return alignment_table_dot([(steps, 1)])


def alignment_table_dot(alignments: list[tuple[list[tuple[str | None, str | None]], int]]) -> str:
    """Alignments with their cases, a row each, most frequent first."""

    def cell(log, model) -> str:
        colour = "#abebc6" if log == model and log is not None else "#d7dbdd" if log is None and model is None else "#f9e79f" if model is None else "#d2b4de"
        return f'<TD BGCOLOR="{colour}">{_escaped(log or "»")} / {_escaped(model or "»")}</TD>'

    rows = "".join(f"<TR><TD>{n}</TD>{''.join(cell(a, b) for a, b in steps)}</TR>" for steps, n in sorted(alignments, key=lambda x: -x[1]))
    return f'digraph {{\n  "table" [shape="plain", label=<<TABLE BORDER="0" CELLBORDER="1" CELLSPACING="0">{rows or "<TR><TD></TD></TR>"}</TABLE>>];\n}}\n'


# --- object-centric


def object_type_colour(name: str) -> str:
    """A colour that depends on the type's name alone."""
    h = 0
    for c in name.encode():
        h = (h * 131 + c) % (1 << 32)
    return f"{h % 360 / 360:.3f} 0.550 0.850"


def ocdfg_dot(rows: list[tuple[str, str, str, int]], ends: list[tuple[str, str, int, int]] = (), counts: Counter | None = None) -> str:
    """type, source, target, n; ends: type, act, n_start, n_end.  Each type has its colour."""
    dot, counts, top = Dot(), counts or Counter(), max((n for *_, n in rows), default=0)
    for a in sorted({a for _, s, t, _ in rows for a in (s, t)} | {a for _, a, *_ in ends}):
        dot.node(a, f"{a} ({counts[a]})" if counts.get(a) else a, shape="box")
    for t, a, b, n in sorted(rows):
        dot.edge(a, b, f"{t} ({n})", color=object_type_colour(t), penwidth=width(n, top))
    for t in sorted({t for t, *_ in ends}):
        for side, shape in (("start", "ellipse"), ("end", "underline")):
            dot.node(f"@{side} {t}", t, shape=shape, style="filled" if side == "start" else None, fillcolor=object_type_colour(t) if side == "start" else None)
    for t, a, s, e in sorted(ends):
        if s:
            dot.edge(f"@start {t}", a, s, color=object_type_colour(t))
        if e:
            dot.edge(a, f"@end {t}", e, color=object_type_colour(t))
    return str(dot)


def ocpn_dot(nets: dict[str, Net], variable: set[tuple[str, str]] = frozenset()) -> str:
    """Nets by object type, joined at their labels; arcs of a variable number of objects (type, act) are double."""
    dot = Dot(rankdir="LR")
    for a in sorted({x[1] for n in nets.values() for x in n.transitions if x[1] is not None}):
        dot.node(a, shape="box")
    for t, net in sorted(nets.items()):
        colour = object_type_colour(t)
        for p in range(net.places):
            dot.node(f"{t} p{p}", t if net.initial[p] or net.final[p] else "", shape="circle", style="filled", fillcolor=colour)
        for name, label, before, after in net.transitions:
            at = label if label is not None else f"{t} {name}"
            if label is None:
                dot.node(at, "", shape="box", style="filled", fillcolor="#000000")
            line = f"{colour}:white:{colour}" if (t, label) in variable else colour
            for p in before:
                dot.edge(f"{t} p{p}", at, color=line)
            for p in after:
                dot.edge(at, f"{t} p{p}", color=line)
    return str(dot)


def object_graph_dot(pairs: list[tuple[str, str]], types: dict[str, str] | None = None, directed: bool = True) -> str:
    dot, types = Dot(directed), types or {}
    for x in sorted({x for p in pairs for x in p}):
        dot.node(x, shape="box", style="filled", fillcolor=object_type_colour(types.get(x, "")))
    for a, b in sorted(pairs):
        dot.edge(a, b)
    return str(dot)


# --- charts


def _placed(values: list) -> dict:
    """Places of values along an axis: numbers by size, others in order of appearance."""
    if values and all(isinstance(v, (int, float)) for v in values):
        lo, hi = min(values), max(values)
        return {v: (v - lo) / (hi - lo) if hi > lo else 0.0 for v in values}
    seen = list(dict.fromkeys(values))
    return {v: i / max(1, len(seen) - 1) for i, v in enumerate(seen)}


def dotted_chart_dot(points: list[tuple], size: float = 10.0) -> str:
    """Points (x, y, colour) at fixed places, for the neato engine."""
    dot, x, y = Dot(False, layout="neato"), _placed([p[0] for p in points]), _placed([p[1] for p in points])
    for i, (a, b, c) in enumerate(points):
        dot.node(i, "", pos=f"{size * x[a]:.3f},{size * y[b]:.3f}!", shape="circle", width="0.05", style="filled", color=object_type_colour(str(c)))
    return str(dot)


def performance_spectrum_dot(activities: list[str], runs: list[list[float]], size: float = 10.0, between: float = 3.0, share: float = 1.0) -> str:
    """Runs as lines from activity to activity along time; of all runs a share, the longest first."""
    dot = Dot(False, layout="neato", splines="false")
    chosen = sorted(runs, key=lambda r: r[0] - r[-1])[: max(1, round(share * len(runs)))] if runs else []
    x = _placed([t for r in chosen for t in r])
    for j, a in enumerate(activities):
        dot.node(f"@{j}", a, pos=f"-1,{-between * j}!", shape="plaintext")
    for i, r in enumerate(chosen):
        for j, t in enumerate(r):
            dot.node(f"{i}.{j}", "", pos=f"{size * x[t]:.3f},{-between * j}!", shape="point")
            if j:
                dot.edge(f"{i}.{j - 1}", f"{i}.{j}", color="#4f8acb")
    return str(dot)
