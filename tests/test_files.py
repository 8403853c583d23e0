"""Round trips of file forms."""

import json

from tracelake.functions.keys import traces
from tracelake.operators import core, discovery, ocel, stats
from tracelake.sources import files


def seqs(df):
    return sorted(tuple(r["seq"]) for r in traces(df).collect())


def test_csv(spark, tmp_path):
    log = core.from_trace_strings(spark, ["a,b", "c & d,<e>"])
    files.write_csv(log, f"{tmp_path}/x")
    assert seqs(files.read_csv(spark, f"{tmp_path}/x", "case_id", "act", "ts")) == seqs(log)
    (tmp_path / "na.csv").write_text("case:concept:name,concept:name,time:timestamp\n1,a,2020-01-01\n1,NA,2020-01-02\n1,b,2020-01-03\n")
    assert seqs(files.read_csv(spark, f"{tmp_path}/na.csv")) == [("a", "b")]


def test_xes(spark, tmp_path):
    log = core.from_trace_strings(spark, ["a,b", 'c & "d",<e>'])
    files.write_xes(log, f"{tmp_path}/x")
    back = files.read_xes(spark, f"{tmp_path}/x")
    assert seqs(back) == seqs(log)
    assert sorted(r["ts"] for r in back.collect()) == sorted(r["ts"] for r in log.collect())


def test_ocel(spark, tmp_path):
    doc = {"events": [{"id": "e1", "type": "pay", "time": "2024-01-01T00:00:00Z", "relationships": [{"objectId": "o1", "qualifier": "q"}]}], "objects": [{"id": "o1", "type": "order", "relationships": [{"objectId": "o2", "qualifier": "r"}]}, {"id": "o2", "type": "item"}]}
    (tmp_path / "x.json").write_text(json.dumps(doc))
    log = files.read_ocel2_json(spark, f"{tmp_path}/x.json")
    files.write_ocel_tables(log, f"{tmp_path}/bundle")
    back = files.read_ocel_tables(spark, f"{tmp_path}/bundle")
    assert {tuple(r) for r in ocel.summary(back).collect()} == {("events", 1), ("objects", 2), ("relations", 1), ("o2o", 1)}
    assert [tuple(r) for r in ocel.flatten(back, "order").select("case_id", "idx", "act").collect()] == [("o1", 0, "pay")]


def test_edge_graph_text(spark):
    log = core.from_trace_strings(spark, ["a,b,b", "b"])
    text = files.dfg_text(discovery.dfg(log), stats.start_activities(log), stats.end_activities(log))
    assert files.read_dfg_text(text) == ({("a", "b"): 1, ("b", "b"): 1}, {"a": 1, "b": 1}, {"b": 2})


def test_open_files(spark, tmp_path):
    import io

    log = core.from_trace_strings(spark, ["a,b", "c & d,<e>"])
    text = io.StringIO()
    files.csv_text(log, text)
    assert seqs(files.read_csv_text(spark, text.getvalue(), "case_id", "act", "ts")) == seqs(log)
    assert seqs(files.read_csv_text(spark, io.StringIO(text.getvalue()), "case_id", "act", "ts")) == seqs(log)
    raw = io.BytesIO()
    files.parquet_file(log, raw)
    assert seqs(files.read_parquet_file(spark, raw.getvalue(), "case_id", "act", "ts")) == seqs(log)
    files.write_parquet(log, f"{tmp_path}/p")
    assert seqs(files.read_parquet(spark, f"{tmp_path}/p", "case_id", "act", "ts")) == seqs(log)
    with open(f"{tmp_path}/one.xes", "w", encoding="utf-8") as f:
        files.xes_file(log, f)
    assert seqs(files.read_xes(spark, f"{tmp_path}/one.xes")) == seqs(files.read_xes_file(spark, f"{tmp_path}/one.xes")) == seqs(log)


def test_equal_times_keep_the_order_of_the_file(spark, tmp_path):
    rows = "".join(f"1,{a},2020-01-01T00:00:00Z\n" for a in "zyxwvutsrq")
    (tmp_path / "ties.csv").write_text("c,a,t\n" + rows)
    assert seqs(files.read_csv(spark, f"{tmp_path}/ties.csv", "c", "a", "t")) == [tuple("zyxwvutsrq")]


def test_logs_as_a_whole(spark):
    from pyspark.sql import functions as F

    from tracelake.operators import logs

    log = core.from_trace_strings(spark, ["a,b,c", "c,a", "b"])
    assert seqs(logs.of_arrow(spark, logs.to_arrow(log))) == seqs(logs.of_arrow(spark, logs.to_arrow_batches(log))) == seqs(log)
    assert seqs(logs.filter_traces(log, F.count("*") > 1)) == seqs(logs.filter_traces(log, lambda e: len(e) > 1)) == [("a", "b", "c"), ("c", "a")]
    assert seqs(logs.filter_events(log, F.col("act") != "a", True)) == [("b",), ("b", "c"), ("c",)]
    assert seqs(logs.sort_events(log, F.col("act"), True)) == [("b",), ("c", "a"), ("c", "b", "a")]
    assert [r["case_id"] for r in logs.sort_traces(log, F.count("*"), True).collect()] == ["0", "1", "2"]
    stream = logs.to_stream(log).withColumn("at", F.monotonically_increasing_id()).drop("idx")
    assert seqs(logs.of_stream(stream, "at")) == seqs(log)
    assert sorted(map(len, seqs(logs.rebase(log, case="act", act="case_id")))) == [2, 2, 2]
    assert [r["act"] for r in logs.events_of(log, "0").collect()] == ["a", "b", "c"]
    twice = log.withColumn("attempt", F.lit(1)).union(log.filter("case_id = '0' and idx < 1").withColumn("attempt", F.lit(2)))
    assert logs.last_of_case(twice, "attempt").filter("case_id = '0'").count() == 1
