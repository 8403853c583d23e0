"""Streams against the batch operators on the same events."""

from pyspark.sql import functions as F

from tracelake.operators import core, discovery, stats
from tracelake.streaming import online


def drained(spark, tmp_path, make, mode, name):
    """Runs a stream over the files of a folder, two at a time or one, to its end."""
    source = spark.readStream.schema("case_id string, act string, order long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = make(source).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def test_online_graph_is_the_batch_graph(spark, tmp_path):
    log = core.from_trace_strings(spark, ["a,b,c", "a,c", "b", "a,b,b"]).withColumn("order", F.col("idx"))
    for i in range(3):  # each file has one event of each case
        log.filter(F.col("idx") == i).select("case_id", "act", "order", "ts").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    changes = drained(spark, tmp_path, online.edge_changes, "append", "changes")
    as_set = lambda df: {tuple(r) for r in df.collect()}
    assert as_set(online.snapshot(changes)) == as_set(discovery.dfg(log))
    assert as_set(online.snapshot(changes, "start").select("source", "n")) == as_set(stats.start_activities(log))
    assert as_set(online.snapshot(changes, "end").select("source", "n")) == as_set(stats.end_activities(log))


def test_online_footprints(spark, tmp_path):
    log = core.from_trace_strings(spark, ["a,b", "b,a", "a,x,b"]).withColumn("order", F.col("idx"))
    log.select("case_id", "act", "order", "ts").coalesce(1).write.parquet(f"{tmp_path}/in")
    out = drained(spark, tmp_path, lambda s: online.footprint_deviations(s, {("a", "b")}, {"a"}, {"a", "b"}), "update", "deviations")
    assert {r["case_id"]: r["deviations"] for r in out.collect()} == {"0": 0, "1": 2, "2": 1}


def test_online_times_and_replay(spark, tmp_path):
    from tracelake.operators.nets import Tree, net_of

    log = core.from_trace_strings(spark, ["a,b", "b", "a,x"]).withColumn("order", F.col("idx"))
    log.select("case_id", "act", "order", "ts").coalesce(1).write.parquet(f"{tmp_path}/in")
    out = drained(spark, tmp_path, lambda s: online.temporal_deviations(s, {("a", "b"): (5.0, 0.5)}), "append", "late")
    assert [tuple(r) for r in out.collect()] == [("0", "a", "b", 1.0)]
    net = net_of(Tree("->", None, (Tree(label="a"), Tree(label="b"))))
    out = drained(spark, tmp_path, lambda s: online.replay_state(s, net), "update", "replayed")
    assert {r["case_id"]: tuple(r)[1:] for r in out.collect()} == {"0": (0, 0, 0), "1": (1, 1, 0), "2": (0, 1, 1)}
