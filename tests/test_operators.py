"""Operators that SQL can't check, on literals worked out by hand."""

from pyspark.sql import functions as F

from tracelake.functions.keys import traces
from tracelake.operators import core, discovery, features, filters, ocel, stats


def log_of(spark, *strings):
    return core.from_trace_strings(spark, list(strings))


def seqs(df):
    return {r["case_id"]: r["seq"] for r in traces(df).collect()}


def test_between_ends_and_begins(spark):
    log = log_of(spark, "S,A,E,S,S,B,E", "A,B", "S,A")
    assert seqs(filters.between(log, ["S"], ["E"])) == {"0##@@0": ["S", "A", "E"], "0##@@1": ["S", "S", "B", "E"]}
    log = log_of(spark, "S,A,S,B,S")
    assert seqs(filters.between(log, ["S"], ["S"])) == {"0##@@0": ["S", "A", "S"], "0##@@1": ["S", "B", "S"]}


def test_trace_segments(spark):
    log = log_of(spark, "A,B,C", "A,C", "C,A", "A")
    assert set(seqs(filters.trace_segments(log, ["A", "...", "C"]))) == {"0", "1"}
    assert set(seqs(filters.trace_segments(log, ["...", "A", "..."]))) == {"0", "1", "2", "3"}
    assert set(seqs(filters.trace_segments(log, ["A"]))) == {"3"}
    assert set(seqs(filters.trace_segments(log, ["A", "...", "C"], False))) == {"2", "3"}


def test_interval_of_lifecycle_is_the_log(spark):
    log = log_of(spark, "A,B,A").withColumn("start_ts", F.col("ts") - F.expr("INTERVAL 5 SECONDS"))
    back = core.to_interval(core.to_lifecycle(log))
    assert sorted((r["act"], (r["ts"] - r["start_ts"]).total_seconds()) for r in back.collect()) == [("A", 5.0), ("A", 5.0), ("B", 5.0)]


def test_sampling_is_exact_and_repeats(spark):
    log = log_of(spark, *["A,B"] * 20)
    a, b = (seqs(core.sample_cases(log, 7, 3)) for _ in range(2))
    assert len(a) == 7 and a == b
    assert core.sample_events(log, 9).count() == 9


def test_split_sizes(spark):
    train, test = features.split(log_of(spark, *["A"] * 10), 0.8)
    assert train.count() == 9 and test.count() == 1


def test_transition_views(spark):
    log = log_of(spark, "B,A")
    x = discovery.transition_system(log, 2, "set").filter("act = 'A'").first()
    assert x["source"] == ["B"] and x["target"] == ["A", "B"]


def test_cycle_time_leaves_the_last_interval_out(spark):
    rows = [("1", 0, "A", 0, 10), ("1", 1, "B", 5, 20), ("2", 0, "A", 100, 130)]
    log = spark.createDataFrame(rows, "case_id string, idx long, act string, a long, b long").select("case_id", "idx", "act", F.timestamp_seconds("a").alias("start_ts"), F.timestamp_seconds("b").alias("ts"))
    assert stats.cycle_time(log).first()["cycle_time"] == 10.0


def test_components(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("d", "c")], "oid string, oid2 string")
    got = {r["oid"]: r["component"] for r in ocel.connected_components(edges).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}


def test_components_of_long_chains(spark):
    chain = [(i, i + 1) for i in range(1, 150)] + [(150, 0)]  # the least vertex at the far end
    edges = spark.createDataFrame([(f"{a:04d}", f"{b:04d}") for a, b in chain], "oid string, oid2 string")
    assert {r["component"] for r in ocel.connected_components(edges).collect()} == {"0000"}


def test_prefix_tree_of_a_long_case(spark):
    got = {r["depth"]: r["n_final"] for r in discovery.prefix_tree(log_of(spark, ",".join("AB" * 15))).collect()}
    assert got == dict.fromkeys(range(1, 30), 0) | {30: 1}


def test_empty_log(spark):
    log = log_of(spark, "A").filter("false")
    assert discovery.dfg(log).count() == 0
    assert stats.rework(log).count() == 0
    assert filters.variants_top_k(log, 3).count() == 0


def test_graph_filters():
    from collections import Counter

    from tracelake.operators import more

    graph = Counter({("a", "b"): 9, ("b", "d"): 8, ("a", "c"): 1, ("c", "d"): 1, ("x", "d"): 1}), Counter({"a": 10}), Counter({"d": 10})
    assert more.on_path(graph) == {"a", "b", "c", "d"}
    assert set(more.activities_percentage((graph[0] - Counter({("x", "d"): 1}), *graph[1:]), 0.75)[0]) == {("a", "b"), ("b", "d")}
    assert set(more.paths_percentage((graph[0] - Counter({("x", "d"): 1}), *graph[1:]), 0.5)[0]) == {("a", "b"), ("b", "d"), ("a", "c"), ("c", "d")}
    assert more.to_activity(graph, "b")[2] == Counter({"b": 9})
    assert set(more.from_activity(graph, "b")[0]) == {("b", "d")}
    assert set(more.containing(graph, "c")[0]) == {("a", "c"), ("c", "d")}


def test_distances():
    from tracelake.operators import more

    assert more.edit_distance(tuple("kitten"), tuple("sitting")) == 3
    assert more.trace_distance((), ()) == 0
    p = {tuple("ab"): 0.5, tuple("ac"): 0.5}
    assert more.transport_distance(p, p) == 0
    assert abs(more.transport_distance(p, {tuple("ab"): 1.0}) - 0.25) < 1e-9


def test_batches_roles_hours(spark):
    from tracelake.operators import more

    rows = [("1", "A", "r", 0, 10), ("2", "A", "r", 0, 10), ("3", "A", "r", 5000, 5010), ("4", "A", "r", 5010, 5030), ("5", "B", "q", 0, 1)]
    log = spark.createDataFrame(rows, "case_id string, act string, res string, s long, e long").select("case_id", "act", "res", F.lit(0).cast("long").alias("idx"), F.timestamp_seconds("s").alias("start_ts"), F.timestamp_seconds("e").alias("ts"))
    assert sorted((r["n_events"], r["kind"]) for r in more.batches(log).collect()) == [(2, "sequential"), (2, "simultaneous")]
    assert more.roles(log) == [(["A"], {"r": 4}), (["B"], {"q": 1})]
    t = spark.sql("select timestamp'2024-01-05 16:00:00' a, timestamp'2024-01-08 10:30:00' b")
    assert t.select(more.business_seconds(F.col("a"), F.col("b"))).first()[0] == 3600 + 5400
    assert more.variant_distances(log_of(spark, "a,b"), ["a", "c"]).first()["distance"] == 0.5
