"""Live streams: consumers that come and go, readers of event and trace files, and per-case monitors of rules and runs.

The monitors are plain objects; ``watched`` keeps one for each case in a Structured Streaming state.
"""

from __future__ import annotations

import gzip
import itertools
import json
import xml.etree.ElementTree as ET
from collections import Counter, deque
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracelake.functions.shipping import ship_package
from tracelake.operators.nets import Net, enabled, fired, marking
from tracelake.streaming.online import TERMINATE, ordered


class Collector:
    """Keeps all items."""

    def __init__(self):
        self.items: list = []

    def __call__(self, item) -> None:
        self.items.append(item)

    def get(self) -> list:
        return self.items


class LiveStream:
    """A queue in order of arrival: items wait until it starts, then go to all consumers at once."""

    def __init__(self):
        self._sinks: dict[int, Callable] = {}
        self._ids, self._queue = itertools.count(), deque()
        self.running = self.finished = False

    def register(self, sink: Callable) -> int:
        """The consumer's number; a consumer that is there already keeps its own."""
        for i, s in self._sinks.items():
            if s is sink:
                return i
        i = next(self._ids)
        self._sinks[i] = sink
        return i

    def deregister(self, number: int) -> bool:
        return self._sinks.pop(number, None) is not None

    def append(self, item) -> bool:
        """False once the stream has finished."""
        if self.finished:
            return False
        self._queue.append(item)
        if self.running:
            self._drain()
        return True

    def start(self) -> None:
        if self.running or self.finished:
            raise RuntimeError("the stream has started before")
        self.running = True
        self._drain()

    def stop(self) -> None:
        """Delivers what waits and finishes; harmless when repeated."""
        if not self.finished:
            self._drain()
            self.running, self.finished = False, True

    def _drain(self) -> None:
        while self._queue:
            item = self._queue.popleft()
            for sink in list(self._sinks.values()):
                sink(item)


def feed(items: Iterable, sink: Callable) -> int:
    """Delivers items until one raises; how many there were."""
    n = 0
    for item in items:
        sink(item)
        n += 1
    return n


class Distributor:
    """Gives a consumer of an object type one event for each of its objects in an arriving event."""

    def __init__(self):
        self._sinks: list[tuple[str, Callable]] = []

    def register(self, object_type: str, sink: Callable) -> None:
        self._sinks.append((object_type, sink))

    def append(self, event: dict, objects: dict[str, list[str]]) -> None:
        """All lists are looked at first; a consumer's error comes after the others had their turn."""
        for ids in objects.values():
            if not isinstance(ids, (list, tuple)):
                raise TypeError("an object type has a list of ids")
        first = None
        for kind, sink in self._sinks:
            for oid in objects.get(kind, ()):
                try:
                    sink(event | {"case_id": oid})
                except Exception as e:  # noqa: BLE001
                    first = first or e
        if first:
            raise first


# --- sources


def csv_stream(spark: SparkSession, folder: str, schema: str = "case_id string, act string, ts timestamp, order long") -> DataFrame:
    """Events of CSV files as they come into a folder, in the order of files."""
    return spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", 1).csv(folder)


def csv_events(path: str) -> Iterator[dict]:
    """Rows of one file, all fields as text."""
    import csv

    with (gzip.open if path.endswith(".gz") else open)(path, "rt", encoding="utf-8", newline="") as f:
        yield from csv.DictReader(f)


_KINDS = ("string", "date", "int", "float", "boolean", "id")


def xes_traces(path: str) -> Iterator[tuple[dict, list[dict]]]:
    """Attributes and events of each trace, one at a time, without holding the document."""
    with (gzip.open if path.endswith(".gz") else open)(path, "rb") as f:
        depth = 0
        for kind, e in ET.iterparse(f, ("start", "end")):
            tag = e.tag.rpartition("}")[2]
            depth += (kind == "start") - (kind == "end")
            if kind == "end" and tag == "trace":
                plain = lambda x: {a.attrib["key"]: a.attrib.get("value") for a in x if a.tag.rpartition("}")[2] in _KINDS}
                yield plain(e), [plain(x) for x in e if x.tag.rpartition("}")[2] == "event"]
                e.clear()


def xes_events(path: str) -> Iterator[dict]:
    """Events of each trace in order; the trace's attributes stand with case: before their names."""
    for attributes, events in xes_traces(path):
        for e in events:
            yield e | {f"case:{k}": v for k, v in attributes.items()}


def traces_of(events: Iterable[dict], case: str = "case_id") -> Iterator[tuple[str, list[dict]]]:
    """Events grouped by case, in order of each case's first event (a file's worth of events)."""
    held: dict[str, list[dict]] = {}
    for e in events:
        held.setdefault(e[case], []).append(e)
    yield from held.items()


def collected(stream: DataFrame, name: str, mode: str = "append") -> StreamingQuery:
    """A query into a table in memory of that name."""
    return stream.writeStream.format("memory").queryName(name).outputMode(mode).start()


def delivered(stream: DataFrame, sink: Callable[[DataFrame], None]) -> StreamingQuery:
    """A query that hands each batch to a consumer."""
    return stream.writeStream.foreachBatch(lambda df, _: sink(df)).start()


# --- monitors


class RuleMonitor:
    """Declarative rules over one case: breaches that no later event can mend, as they come."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.rules = rules
        self.last: dict[str, int] = {}
        self.n, self.previous = 0, ""

    def push(self, act: str) -> list[str]:
        last, i = self.last, self.n
        broken = []
        for rule, a, b in self.rules:
            bad = {
                "absence": act == a, "exactly_one": act == a and a in last, "init": not i and act != a, "precedence": act == b and a not in last,
                "alternate_precedence": act == b and not last.get(a, -1) > last.get(b, -1), "chain_precedence": act == b and self.previous != a, "chain_response": self.previous == a and i > 0 and act != b,
                "alternate_response": act == a and a in last and last.get(b, -1) < last[a], "non_responded_existence": (act == b and a in last) or (act == a and b in last), "non_succession": act == b and a in last, "non_chain_succession": act == b and self.previous == a and i > 0,
            }.get(rule, False)
            if bad:
                broken.append(f"{rule}({a}{', ' + b if b else ''})")
        last[act] = i
        self.n, self.previous = i + 1, act
        return broken

    def state(self) -> str:
        return json.dumps([self.last, self.n, self.previous])

    def restore(self, text: str) -> RuleMonitor:
        self.last, self.n, self.previous = json.loads(text)
        return self


def proxy_runs(net: Net, most: int = 1000, repeats: int = 2) -> list[tuple[str, ...]]:
    """Distinct visible runs of a net, shortest first; a marking comes ``repeats`` times in a run at most."""
    out, seen = [], set()
    queue = deque([(Counter(net.initial), (), Counter([marking(net.initial)]))])
    while queue and len(out) < most:
        m, run, been = queue.popleft()
        if marking(m) == marking(net.final) and run not in seen:
            seen.add(run)
            out.append(run)
        for i in enabled(net, m):
            to = fired(net, m, i)
            key, label = marking(to), net.transitions[i][1]
            if been[key] < repeats:
                queue.append((to, run if label is None else (*run, label), been + Counter([key])))
    return out


class RunMonitor:
    """One case along the runs of a model: the cheapest places in their common prefix tree, with what they cost so far.

    An event that a place knows is free; an event alone costs 1, as does each step of the model alone on the way to one that does (``ahead`` of
    them at most).  ``width`` places are kept.
    """

    def __init__(self, runs: list[tuple[str, ...]], width: int = 50, ahead: int = 3):
        self.children: list[dict[str, int]] = [{}]
        self.rest: list[float] = [float("inf")]
        for r in runs:
            at, path = 0, [0]
            for a in r:
                if a not in self.children[at]:
                    self.children[at][a] = len(self.children)
                    self.children.append({})
                    self.rest.append(float("inf"))
                at = self.children[at][a]
                path.append(at)
            for left, node in enumerate(reversed(path)):
                self.rest[node] = min(self.rest[node], left)
        self.width, self.ahead = width, ahead
        self.places: dict[int, float] = {0: 0.0}

    def push(self, act: str) -> float:
        """The least cost so far, after an event."""
        after: dict[int, float] = {}
        for node, cost in self.places.items():
            after[node] = min(after.get(node, float("inf")), cost + 1)
            level = [(node, cost)]
            for _ in range(self.ahead + 1):
                for x, c in level:
                    to = self.children[x].get(act)
                    if to is not None:
                        after[to] = min(after.get(to, float("inf")), c)
                level = [(y, c + 1) for x, c in level for y in self.children[x].values()]
        self.places = dict(sorted(after.items(), key=lambda p: (p[1], p[0]))[: self.width])
        return min(self.places.values())

    def finish(self) -> float:
        """The least cost when the rest of a run is added by the model alone."""
        return min(c + self.rest[n] for n, c in self.places.items())

    def state(self) -> str:
        return json.dumps(sorted(self.places.items()))

    def restore(self, text: str) -> RunMonitor:
        self.places = {int(n): float(c) for n, c in json.loads(text)}
        return self


def watched(stream: DataFrame, make: Callable, emit: Callable, schema: str, finish: Callable | None = None) -> DataFrame:
    """A monitor for each case: ``make()`` gives one, ``emit(monitor, act)`` the rows (after case_id) of an event, ``finish``
    those of a case's end, after which it begins anew."""
    ship_package(stream.sparkSession)
    names = [x.split()[0] for x in schema.split(",")]

    def step(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        monitor = make()
        if state.exists and state.get[0]:
            monitor.restore(state.get[0])
        rows = []
        for part in ordered(parts):
            for act in part["act"]:
                if act == TERMINATE:
                    rows += [(key[0], *r) for r in (finish(monitor) if finish else [])]
                    monitor = make()
                else:
                    rows += [(key[0], *r) for r in emit(monitor, act)]
        state.update((monitor.state(),))
        yield pd.DataFrame(rows, columns=["case_id", *names])

    return stream.groupBy("case_id").applyInPandasWithState(step, f"case_id string, {schema}", "state string", "append", "NoTimeout")


def rule_breaches(stream: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """case_id, rule: breaches as they come."""
    return watched(stream, lambda: RuleMonitor(rules), lambda m, act: [(r,) for r in m.push(act)], "rule string")


def run_costs(stream: DataFrame, runs: list[tuple[str, ...]], width: int = 50) -> DataFrame:
    """case_id, cost, done: the least cost so far after every event, and at a case's end the whole."""
    return watched(stream, lambda: RunMonitor(runs, width), lambda m, act: [(m.push(act), False)], "cost double, done boolean", lambda m: [(m.finish(), True)])


def summary(found: DataFrame) -> DataFrame:
    """rule, n of all breaches that a sink holds."""
    return found.groupBy("rule").agg(F.count("*").alias("n"))
