"""Queries on tables laid out, filled or sized as the larger ones are."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tracelake.functions import components, layout
from tracelake.operators import more, ocel, org, stats
from tracelake.operators import ocel, org
from tracelake.plans import catalog
from tracelake.sources.tables import Ocel
from tracelake.streaming import online

CHAT = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "system", "c"), (2, 1, "user", "d"), (2, 2, "user", None), (3, 0, "assistant", "e"), (3, 1, "user", "f"), (3, 2, "assistant", "g"), (3, 3, "assistant", "h")]
STREAMS = ["streaming_footprints", "streaming_alignments", "streaming_declare", "streaming_dfg", "streaming_end_activities", "streaming_temporal"]


def by_sql(folder, name, *names):
    """Rows of a query's SQL over tables that are folders of files."""
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in names:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return sorted(map(str, c.sql(catalog.SQL[name]).fetchall()))


def ours(df):
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("name", STREAMS)
def test_streams_of_a_folder_of_files(spark, tmp_path, name):
    chat = spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string")
    chat.repartitionByRange(3, "conv_id").write.parquet(f"{tmp_path}/conversations.parquet")
    got = ours(catalog.queries()[name](spark, str(tmp_path)))
    assert got and got == by_sql(tmp_path, name, "conversations")


@pytest.mark.parametrize("name", STREAMS)
def test_streams_of_cases_that_arrow_splits(spark, tmp_path, name):
    """A case's rows come in several parts, the later turns first."""
    chat = spark.createDataFrame(sorted(CHAT, key=lambda r: (r[0], -r[1])), "conv_id long, turn long, role string, text string")
    chat.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 2)
    try:
        assert ours(catalog.queries()[name](spark, str(tmp_path))) == by_sql(tmp_path, name, "conversations")
    finally:
        spark.conf.set(key, before)


def test_updates_of_a_stream_without_rows(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    stream = spark.readStream.schema("case_id string, act string, order long, ts timestamp").parquet(f"{tmp_path}/in")
    assert online.latest(online.drained(online.footprint_deviations(stream, set(), set(), set()), "update")).count() == 0


def events_of(spark, folder, rows):
    """rows: event_id, seconds, user."""
    x = spark.createDataFrame(rows, "event_id long, s long, user_id long")
    x.select("event_id", F.timestamp_seconds("s").alias("ts"), "user_id", F.lit("view").alias("event_type"), F.lit(1.0).alias("value")).write.parquet(f"{folder}/events.parquet")


@pytest.mark.parametrize("gap", [30, 100])
def test_cycle_time_of_a_dense_log(spark, tmp_path, gap):
    events_of(spark, tmp_path, [(i, 1_700_000_000 + i * gap, i % 7) for i in range(40)])
    assert ours(catalog.queries()["cycle_time"](spark, str(tmp_path))) == by_sql(tmp_path, "cycle_time", "events")


def test_intervals_whose_sum_is_over_a_long(spark, tmp_path):
    n, day = 12_000, 86_400 * 1_000_000
    x = spark.range(n).select(F.col("id").alias("l_orderkey"), F.lit(1).alias("l_partkey"), F.lit(1).alias("l_suppkey"), F.lit(1).alias("l_linenumber"), F.lit(1.0).alias("l_quantity"), F.lit("N").alias("l_returnflag"), F.lit("O").alias("l_linestatus"), F.timestamp_seconds(F.lit(10_000 * 86_400)).alias("l_shipdate"))
    x.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(n).select(F.col("id").alias("o_orderkey"), F.timestamp_seconds(F.lit(0)).alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    r = catalog.queries()["to_interval"](spark, str(tmp_path)).first()
    assert r["n"] == n and int(r["us"]) == n * 10_000 * day > 2**63


def test_similarity_of_resources_with_many_events(spark):
    """Deviations whose product is over a long; pairs as from whole vectors."""
    x = spark.range(300_000).select(F.col("id").cast("string").alias("case_id"), F.lit(0).cast("long").alias("idx"), F.when(F.col("id") % 5 == 0, "b").otherwise("a").alias("act"), (F.col("id") % 3).cast("string").alias("res"))
    got = {(r["source"], r["target"]): round(r["weight"], 6) for r in org.activity_similarity(x).collect()}
    assert got == {(str(i), str(j)): 1.0 for i in range(3) for j in range(3) if i != j}


def log_of(spark, whole):
    rows = [("1", "A", 1, "o1", "o"), ("1", "A", 1, "p1", "p"), ("2", "B", 2, "o1", "o"), ("2", "B", 2, "p2", "p"), ("2", "B", 2, "p2", "p"), ("3", "B", 3, "o2", "o"), ("3", "B", 3, "p2", "p"), ("3", "B", 3, "p1", "p")]
    r = spark.createDataFrame(rows, "eid string, act string, s long, oid string, type string").select("eid", "oid", "type", "act", F.timestamp_seconds("s").alias("ts"))
    groups = r.groupBy("eid", "act", "ts").agg(F.collect_list(F.struct("oid", "type")).alias("objects"))
    o2o = spark.createDataFrame([], "oid string, oid2 string, qualifier string")
    return Ocel(r.select("eid", "act", "ts").distinct(), r.select("oid", "type").distinct(), r.select("eid", "oid", F.lit("").alias("qualifier")), o2o, None, r, (lambda: groups) if whole else None)


@pytest.mark.parametrize("whole", [True, False])
def test_object_graphs_of_whole_events(spark, whole):
    log = log_of(spark, whole)
    pairs = lambda df: sorted(tuple(r) for r in df.collect())
    assert pairs(ocel.interactions(log)) == [("o1", "p1"), ("o1", "p2"), ("o2", "p1"), ("o2", "p2"), ("p1", "p2")]
    assert pairs(ocel.object_graph(log, "descendants")) == [("o1", "p2"), ("p1", "o2"), ("p1", "p2"), ("p2", "o2")]
    assert pairs(ocel.object_graph(log, "inheritance")) == [("o1", "p2"), ("p1", "o2"), ("p2", "o2")]
    assert pairs(ocel.object_graph(log, "cobirth")) == [("o1", "p1")]
    assert pairs(ocel.object_graph(log, "codeath")) == [("o2", "p1"), ("o2", "p2"), ("p1", "p2")]
    assert pairs(ocel.type_graph(log)) == [("o", "p", 4), ("p", "o", 4), ("p", "p", 2)]
    assert pairs(ocel.activity_type_graph(log).select("act", "type", "n", "n_objects", "n_events")) == [("A", "o", 1, 1, 1), ("A", "p", 1, 1, 1), ("B", "o", 2, 2, 2), ("B", "p", 3, 2, 2)]


def test_pairs_look_up_their_objects_once(spark):
    """Both orientations of a pair come from one look at it; events of known objects aren't gathered again."""
    text = ocel.object_graph(log_of(spark, True), "inheritance")._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Join ") == 2 and "LeftAnti" not in text and "Union" not in text


def test_components_are_contracted_where_links_lie(spark, monkeypatch):
    """Chains over many tasks and a long ring; one event's objects are linked by its first one alone."""
    links = spark.range(3000).select((F.col("id") * 7919 % 3001).alias("a"), ((F.col("id") + 1) * 7919 % 3001).alias("b")).repartition(7)
    apart = spark.createDataFrame([(9001, 9000), (9002, 9001), (9005, 9005), (None, 9007)], "a long, b long")
    rounds = []
    got = {r["v"]: r["label"] for r in components.components(links.union(apart), lambda df: rounds.append(df) or df.localCheckpoint()).collect()}
    assert got == {v: 0 for v in range(3001)} | {9000: 9000, 9001: 9000, 9002: 9000, 9005: 9005, 9007: 9007}
    assert {"others"} < set(rounds[0].columns)
    for whole in (True, False):
        assert {tuple(r) for r in ocel.components(log_of(spark, whole)).collect()} == {(o, "o1") for o in ("o1", "o2", "p1", "p2")}


def test_large_tables_have_more_tasks(spark, tmp_path, monkeypatch):
    spark.range(1000).write.parquet(f"{tmp_path}/t.parquet")
    x = spark.read.parquet(f"{tmp_path}/t.parquet")
    assert layout.spread(x, "id") is x
    monkeypatch.setattr(layout, "TASK_BYTES", layout.table_bytes(x) // 9)
    assert layout.spread(x, "id").rdd.getNumPartitions() >= 9


@pytest.mark.parametrize("whole", [True, False])
def test_graphs_of_shared_and_own_couples(spark, whole):
    """Couples that several objects of a type share count once; events count once whatever their objects."""
    log = log_of(spark, whole)
    couples = lambda df: sorted(tuple(r) for r in df.collect())
    assert couples(ocel.ocdfg(log)) == [("o", "A", "B", 1, 1, 1), ("p", "A", "B", 1, 1, 1), ("p", "B", "B", 1, 1, 1)]
    acts, flows = ocel.ocdfg_measures(log)
    assert couples(acts) == [("A", 1), ("B", 2)] and couples(flows.select("source", "target", "n")) == [("A", "B", 2), ("B", "B", 1)]
    late = ocel.in_time(log, "1970-01-01 00:00:02", "1970-01-01 00:00:03")
    assert couples(ocel.ocdfg(late)) == [("p", "B", "B", 1, 1, 1)] and couples(ocel.ocdfg_measures(late)[0]) == [("B", 2)]
    twice = log.e2o.union(log.e2o)
    assert couples(ocel.lifecycle_qualifiers(Ocel(log.events, log.objects, twice, log.o2o)).groupBy("qualifier").count()) == [("creation", 4), ("termination", 3)]
    merged = ocel.merge_duplicates(log)
    assert merged.events.count() == 3 and merged.e2o.count() == 7


def test_wide_steps_move_relations_once(spark):
    text = lambda df: df._jdf.queryExecution().executedPlan().toString()
    log = catalog.O(spark, "/root/testdata/sf0.001")
    assert text(ocel.lifecycle_qualifiers(log)).count("Exchange hash") == 1
    assert text(org.working_together(catalog.L(spark, "/root/testdata/sf0.001"))).count("Join") == 1
    assert text(more.batches(catalog.I(spark, "/root/testdata/sf0.001"))).count("Exchange hashpartitioning(res") == 1
    rows, alone = ocel.marked(log)
    assert alone and rows.filter("marks is null").count() == 0


def test_batches_and_pairs_with_repeats(spark):
    rows = [("1", 0, "A", "x", 0, 5), ("1", 1, "A", "x", 0, 5), ("2", 0, "A", "x", 0, 5), ("3", 0, "A", "y", 0, 9), ("4", 0, "A", "y", 3, 9), ("5", 0, "A", "y", 4000, 4001), ("1", 2, "B", None, 1, 2), ("1", 3, "B", "y", 1, 2), (None, 0, "B", "z", 1, 2), (None, 1, "B", "y", 9000, 9002)]
    log = spark.createDataFrame(rows, "case_id string, idx long, act string, res string, a long, b long").select("case_id", "idx", "act", "res", F.timestamp_seconds("a").alias("start_ts"), F.timestamp_seconds("b").alias("ts"))
    assert sorted(tuple(r) for r in more.batches(log).collect()) == [("A", "x", 2, "simultaneous"), ("A", "y", 2, "end")]
    assert sorted(tuple(r) for r in org.working_together(log).collect()) == [("x", "y", 0.2), ("y", "x", 0.2)]
