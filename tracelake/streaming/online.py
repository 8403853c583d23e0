"""Online mining over Structured Streaming: state by case, snapshots as aggregates.

A stream has ``case_id, act`` (and ``ts`` for times) in order of arrival.  State is
kept per case by ``applyInPandasWithState``; a case ends by a row whose act is
``TERMINATE``, which clears it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.folders import shared_folder
from tracelake.functions.shipping import ship_package

TERMINATE = "<terminate>"


def ordered(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A case's new rows in order, as one table: they come in parts where Arrow's batches end, in the order of no column."""
    rows = list(parts)
    if rows:
        yield pd.concat(rows).sort_values("order", kind="stable")


def edge_changes(stream: DataFrame) -> DataFrame:
    """kind (edge, start, end, act), source, target, change: what each event adds or takes back.

    A case's end is provisional: its next event takes the earlier end back.
    """
    ship_package(stream.sparkSession)

    def step(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for part in ordered(parts):
            for act in part["act"]:
                if act == TERMINATE:
                    last = None
                    continue
                if last is None:
                    out.append(("start", act, "", 1))
                else:
                    out += [("edge", last, act, 1), ("end", last, "", -1)]
                out += [("end", act, "", 1), ("act", act, "", 1)]
                last = act
        if last is None:
            if state.exists:
                state.remove()
        else:
            state.update((last,))
        yield pd.DataFrame(out, columns=["kind", "source", "target", "change"])

    return stream.groupBy("case_id").applyInPandasWithState(step, "kind string, source string, target string, change long", "last string", "append", "NoTimeout")


def footprint_deviations(stream: DataFrame, allowed: set[tuple[str, str]], starts: set[str], acts: set[str]) -> DataFrame:
    """case_id, deviations (so far): pairs that a model doesn't allow, wrong starts, unknown activities.
    An unknown activity counts and doesn't replace the last known one."""
    ship_package(stream.sparkSession)

    def step(key, parts, state):
        last, n = state.get if state.exists else ("", 0)
        for part in ordered(parts):
            for act in part["act"]:
                if act == TERMINATE:
                    last, n = "", 0
                elif act not in acts:
                    n += 1
                else:
                    n += (act not in starts) if not last else ((last, act) not in allowed)
                    last = act
        state.update((last, n))
        yield pd.DataFrame({"case_id": [key[0]], "deviations": [n]})

    return stream.groupBy("case_id").applyInPandasWithState(step, "case_id string, deviations long", "last string, n long", "update", "NoTimeout")


def snapshot(sink: DataFrame, kind: str = "edge") -> DataFrame:
    """The current counts of a kind from all changes that a sink holds."""
    return sink.filter(F.col("kind") == kind).groupBy("source", "target").agg(F.sum("change").alias("n")).filter("n > 0")


def event_counts(stream: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events by activity and time window; the watermark bounds the state."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window), "act").agg(F.count("*").alias("n")).select(F.col("window.start").alias("begin"), "act", "n")


def flattened(stream: DataFrame, objects: str = "objects") -> DataFrame:
    """One event for each related object, for the operators above: rows with an array<string> of ids."""
    return stream.withColumn("case_id", F.explode(objects)).drop(objects)


def temporal_deviations(stream: DataFrame, profile: dict[tuple[str, str], tuple[float, float]], zeta: float = 6.0) -> DataFrame:
    """case_id, source, target, seconds: pairs further than ``zeta`` deviations from a profile's mean,
    found when the later event arrives.  State is a case's earlier activities and times."""
    ship_package(stream.sparkSession)

    def step(key, parts, state):
        acts, times = (list(x) for x in state.get) if state.exists else ([], [])
        out = []
        for part in ordered(parts):
            for act, ts in zip(part["act"], part["ts"], strict=True):
                if act == TERMINATE:
                    acts, times = [], []
                    continue
                now = ts.timestamp()
                for before, then in zip(acts, times, strict=True):
                    if (before, act) in profile and now >= then:
                        mean, stdev = profile[before, act]
                        off = abs(now - then - mean)
                        if off > (zeta * stdev if stdev else 0.0):
                            out.append((key[0], before, act, now - then))
                acts.append(act)
                times.append(now)
        state.update((acts, times))
        yield pd.DataFrame(out, columns=["case_id", "source", "target", "seconds"])

    return stream.groupBy("case_id").applyInPandasWithState(step, "case_id string, source string, target string, seconds double", "acts array<string>, times array<double>", "append", "NoTimeout")


def replay_state(stream: DataFrame, net) -> DataFrame:
    """case_id, missing, remaining, unknown so far: a net's marking is kept by case; silent ways come first, then missing tokens."""
    from collections import Counter

    from tracelake.operators.nets import enabled, fired, silent_path

    ship_package(stream.sparkSession)

    def step(key, parts, state):
        if state.exists:
            places, counts, missing, unknown = state.get
            m = Counter(dict(zip(places, counts, strict=True)))
        else:
            m, missing, unknown = Counter(net.initial), 0, 0
        for part in ordered(parts):
            for act in part["act"]:
                if act == TERMINATE:
                    m, missing, unknown = Counter(net.initial), 0, 0
                    continue
                options = [i for i, t in enumerate(net.transitions) if t[1] == act]
                if not options:
                    unknown += 1
                    continue
                for i in silent_path(net, m, lambda x, o=options: any(i in o for i in enabled(net, x)), 200) or []:
                    m = fired(net, m, i)
                on = [i for i in options if i in enabled(net, m)]
                i = (on or options)[0]
                for p, n in Counter(net.transitions[i][2]).items():
                    lack = max(0, n - m[p])
                    missing += lack
                    m[p] += lack
                m = fired(net, m, i)
        m = +m
        state.update((list(m), list(m.values()), missing, unknown))
        rest = sum(max(0, n - net.final[p]) for p, n in m.items())
        yield pd.DataFrame({"case_id": [key[0]], "missing": [missing], "remaining": [rest], "unknown": [unknown]})

    return stream.groupBy("case_id").applyInPandasWithState(step, "case_id string, missing long, remaining long, unknown long", "places array<int>, counts array<int>, missing long, unknown long", "update", "NoTimeout")


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All rows that a stream gives for what its source holds now, through a table in the shared folder; of updates every
    batch's rows, with its number (``batch``)."""
    spark = stream.sparkSession
    path = shared_folder(spark, "stream")
    out = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True)
    if mode == "append":
        query = out.format("parquet").option("path", path).start()
        schema = stream.schema
    else:
        schema = stream.withColumn("batch", F.lit(0).cast("long")).schema
        spark.createDataFrame([], schema).write.parquet(path)  # a source without rows gives no batch
        query = out.foreachBatch(lambda df, i: df.withColumn("batch", F.lit(i).cast("long")).write.mode("append").parquet(path)).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(path)


def latest(updates: DataFrame) -> DataFrame:
    """The last row of each case."""
    rest = [c for c in updates.columns if c not in ("case_id", "batch")]
    return updates.groupBy("case_id").agg(F.max_by(F.struct(*rest), "batch").alias("x")).select("case_id", "x.*")
