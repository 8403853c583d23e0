"""Object-centric logs through every file form and back, and operators on whole tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tracelake.operators import ocel
from tracelake.sources import ocel_files
from tracelake.sources.tables import Ocel


def at(h, m=0):
    return dt.datetime(2024, 3, 1, h, m)


@pytest.fixture(scope="module")
def log(spark):
    events = spark.createDataFrame([("e1", "place order", at(8), "10.5", None), ("e2", 'pack & "send"', at(9), None, "a<b"), ("e3", "pay", at(10), "7", "it's, here"), ("e4", "alone", at(11), None, None)], "eid string, act string, ts timestamp, cost string, note string")
    objects = spark.createDataFrame([("o1", "order", "high"), ("o2", "order", None), ("i1", "item, big", "low"), ("lonely", "item, big", None)], "oid string, type string, prio string")
    e2o = spark.createDataFrame([("e1", "o1", "made"), ("e1", "i1", ""), ("e2", "o1", ""), ("e2", "i1", "in"), ("e3", "o2", "")], "eid string, oid string, qualifier string")
    o2o = spark.createDataFrame([("o1", "i1", "has")], "oid string, oid2 string, qualifier string")
    changes = spark.createDataFrame([("o1", at(9, 30), "prio", "low"), ("o1", at(10, 30), "prio", "none")], "oid string, ts timestamp, field string, value string")
    return Ocel(events, objects, e2o, o2o, changes)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def same(a, b, qualifiers=True, whole=True):
    assert rows(a.events, "eid", "act", "ts", "cost", "note") == rows(b.events, "eid", "act", "ts", "cost", "note")
    q = ["qualifier"] if qualifiers else []
    assert rows(a.e2o, "eid", "oid", *q) == rows(b.e2o, "eid", "oid", *q)
    if whole:
        assert rows(a.objects, "oid", "type", "prio") == rows(b.objects, "oid", "type", "prio")


@pytest.mark.parametrize("ending", ["jsonocel", "xmlocel", "sqlite"])
def test_version_2_forms(spark, log, tmp_path, ending):
    path = f"{tmp_path}/log.{ending}"
    ocel_files.write(log, path)
    back = ocel_files.read(spark, path)
    same(log, back)
    assert rows(log.o2o, "oid", "oid2", "qualifier") == rows(back.o2o, "oid", "oid2", "qualifier")
    assert rows(log.changes, "oid", "ts", "field", "value") == rows(back.changes, "oid", "ts", "field", "value")
    ocel_files.write(back, f"{tmp_path}/again.{ending}")
    same(log, ocel_files.read(spark, f"{tmp_path}/again.{ending}"))


@pytest.mark.parametrize("ending", ["jsonocel", "xmlocel", "sqlite"])
def test_version_1_forms(spark, log, tmp_path, ending):
    path = f"{tmp_path}/log.{ending}"
    ocel_files.write(log, path, 1)
    same(log, ocel_files.read(spark, path, 1), qualifiers=False)


def test_tables(spark, log, tmp_path):
    ocel_files.write_csv2(log, f"{tmp_path}/two.csv")
    back = ocel_files.read_csv2(spark, f"{tmp_path}/two.csv")
    same(log, back, qualifiers=False, whole=False)
    ocel_files.write_csv(log, f"{tmp_path}/one.csv", f"{tmp_path}/objects.csv")
    back = ocel_files.read_csv(spark, f"{tmp_path}/one.csv", f"{tmp_path}/objects.csv")
    same(log, back, qualifiers=False, whole=False)
    assert rows(back.objects, "oid", "type", "prio") == [x for x in rows(log.objects, "oid", "type", "prio") if x[0] != "lonely"]
    text = spark.createDataFrame([("1", "go", "2024-03-01T08:00:00+00:00", "['a', 'b']", "")], "`ocel:eid` string, `ocel:activity` string, `ocel:timestamp` string, `ocel:type:x` string, `ocel:type:y` string")
    text.write.csv(f"{tmp_path}/lists.csv", header=True)
    assert rows(ocel_files.read_csv(spark, f"{tmp_path}/lists.csv").e2o, "eid", "oid") == [("1", "a"), ("1", "b")]


def test_no_form(log):
    with pytest.raises(ValueError, match="no form"):
        ocel_files.write(log, "x.unknown")


def test_attribute_filters_and_tables(log):
    assert rows(ocel.object_attribute(log, "prio", ["high"]).events, "eid") == [("e1",), ("e2",)]
    assert rows(ocel.object_attribute(log, "prio", ["high"], False).objects, "oid") == [("i1",), ("lonely",), ("o2",)]
    assert rows(ocel.event_attribute(log, "cost", ["7"]).objects, "oid") == [("o2",)]
    assert ocel.is_ocel20(log) and not ocel.is_ocel20(Ocel(log.events, log.objects, log.e2o.withColumn("qualifier", F.lit("")), log.o2o.limit(0)))
    assert ocel.attribute_names(log) == ["cost", "note", "prio"]
    odd = Ocel(log.events.withColumn("act", F.when(F.col("eid") != "e1", F.col("act")).otherwise("")), log.objects, log.e2o.withColumn("qualifier", F.lit(None).cast("string")), log.o2o)
    plain = ocel.consistent(odd)
    assert plain.events.count() == 3 and plain.e2o.filter("qualifier = ''").count() == 5
    nodes, edges = ocel.graph_tables(log)
    assert nodes.count() == 10 and rows(edges.groupBy("kind").count(), "kind", "count") == [("CHANGE", 2), ("DF", 2), ("E2O", 5), ("O2O", 1)]


def test_merging_and_executions(spark):
    events = spark.createDataFrame([(f"e{i}", a, at(8 + i // 2)) for i, a in enumerate("aabbcc")], "eid string, act string, ts timestamp")
    objects = spark.createDataFrame([("x", "t"), ("y", "t"), ("z", "u")], "oid string, type string")
    e2o = spark.createDataFrame([("e0", "x"), ("e1", "y"), ("e2", "x"), ("e3", "y"), ("e4", "x"), ("e5", "y"), ("e5", "z")], "eid string, oid string").withColumn("qualifier", F.lit(""))
    log = Ocel(events, objects, e2o, spark.createDataFrame([], "oid string, oid2 string, qualifier string"))
    merged = ocel.merge_duplicates(log)
    assert rows(merged.events, "act") == [("a",), ("b",), ("c",)] and merged.e2o.count() == 7
    assert ocel.merge_duplicates(log, True).events.count() == 6
    assert rows(ocel.equivalent_executions(log, "t"), "description", "n") == [("a(t_1)>b(t_1)>c(t_1)", 1), ("a(t_1)>b(t_1)>c(t_1,u_1)", 1)]
    assert rows(ocel.o2o_enrichment(log, ("interaction",)).o2o, "oid", "oid2", "qualifier") == [("y", "z", "interaction_graph"), ("z", "y", "interaction_graph")]
    classic = spark.createDataFrame([("c", 0, "a", at(1), "p AND q", 3), ("c", 1, "b", at(2), "q", 4)], "case_id string, idx long, act string, ts timestamp, res string, size int")
    made = ocel.of_log(classic, ["res"], object_attributes={"res": ["size"]})
    assert rows(made.objects, "oid", "type", "size") == [("p", "res", 3), ("q", "res", 3)] and made.e2o.count() == 3


def test_components_match_brute_force(spark):
    import random

    r = random.Random(3)
    rel = [(f"e{i:03}", f"o{r.randrange(60)}", "") for i in range(45) for _ in range(r.randrange(1, 4))]
    objects = sorted({o for _, o, _ in rel})
    parent = {o: o for o in objects}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    events = {}
    for e, o, _ in rel:
        events.setdefault(e, []).append(o)
    for os in events.values():
        for o in os[1:]:
            a, b = sorted((root(os[0]), root(o)))
            parent[b] = a
    log = Ocel(spark.createDataFrame([(e, "a", at(1)) for e in events], "eid string, act string, ts timestamp"), spark.createDataFrame([(o, "t") for o in objects], "oid string, type string"), spark.createDataFrame(rel, "eid string, oid string, qualifier string"), spark.createDataFrame([], "oid string, oid2 string, qualifier string"))
    pairs = ocel.interactions(log)
    assert rows(pairs, "oid", "oid2") == sorted({tuple(sorted((a, b))) for os in events.values() for a in os for b in os if a < b}, key=str)
    lonely = {o for o in objects if all(set(os) == {o} for os in events.values() if o in os)}
    assert rows(ocel.connected_components(pairs), "oid", "component") == sorted([(o, root(o)) for o in objects if o not in lonely], key=str)
