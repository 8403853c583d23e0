"""Files of object-centric logs: JSON and XML documents of both versions, CSV tables, SQLite databases, with attributes and changes.

A document or database is one file by its format, so its rows stream through one task on the way out;
the tables that come from it, or go into Parquet bundles (``files.write_ocel_tables``), are spread as usual.
"""

from __future__ import annotations

import json
import re
import sqlite3
from collections.abc import Iterator
from xml.sax.saxutils import quoteattr

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.sources.tables import Ocel

# Names of the formats.
KINDS = ("string", "int", "float", "boolean", "date")
EMPTY = "1970-01-01T00:00:00+00:00"
TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"


def _wide(df: DataFrame, values: str) -> DataFrame:
    """A column for each key of a map column (as many as the log has attributes)."""
    names = sorted(r[0] for r in df.select(F.explode(F.map_keys(values))).distinct().collect())
    return df.select(*[c for c in df.columns if c != values], *[F.try_element_at(values, F.lit(n)).alias(n) for n in names])


def _entries(pairs: Column, key: str, value: str) -> Column:
    """A map of an array of structs; of repeated keys the last one counts."""
    return F.map_from_entries(F.transform(F.array_distinct(F.transform(pairs, lambda x: x[key])), lambda k: F.struct(k.alias("k"), F.element_at(F.filter(pairs, lambda x: x[key] == k), -1)[value].alias("v"))))


def _with_values(objects: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Objects with their first value of every field as columns, and the later ones as changes.

    A value that has no earlier one than its time belongs to the object; the rest are changes."""
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("oid", "field").orderBy("ts", "value")) == 1
    marked = changes.withColumn("_first", first)
    own = marked.filter("_first").groupBy("oid").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_values"))
    wide = _wide(objects.join(own, "oid", "left").withColumn("_values", F.coalesce("_values", F.create_map().cast("map<string,string>"))), "_values")
    return wide, marked.filter("not _first").drop("_first")


# --- JSON


_RELATED = "relationships array<struct<objectId string, qualifier string>>"
_JSON2 = f"events array<struct<id string, type string, time string, attributes array<struct<name string, value string>>, {_RELATED}>>, objects array<struct<id string, type string, attributes array<struct<name string, time string, value string>>, {_RELATED}>>"
_JSON1 = "`ocel:events` map<string, struct<`ocel:activity`: string, `ocel:timestamp`: string, `ocel:omap`: array<string>, `ocel:vmap`: map<string, string>>>, `ocel:objects` map<string, struct<`ocel:type`: string, `ocel:ovmap`: map<string, string>>>"


def _relations(df: DataFrame, a: str, b: str, pairs: str, target: str = "objectId", qualifier: str = "qualifier") -> DataFrame:
    return df.select(F.col("id").alias(a), F.explode(pairs).alias("r")).select(a, F.col(f"r.`{target}`").alias(b), F.coalesce(F.col(f"r.`{qualifier}`"), F.lit("")).alias("qualifier"))


def read_json2(spark: SparkSession, path: str) -> Ocel:
    """A JSON document of version 2."""
    doc = spark.read.schema(_JSON2).json(path, multiLine=True)
    e = doc.select(F.explode("events").alias("x")).select("x.*")
    o = doc.select(F.explode("objects").alias("x")).select("x.*")
    events = _wide(e.select(F.col("id").alias("eid"), F.col("type").alias("act"), F.to_timestamp("time").alias("ts"), F.coalesce(_entries(F.col("attributes"), "name", "value"), F.create_map().cast("map<string,string>")).alias("_values")), "_values")
    values = o.select(F.col("id").alias("oid"), F.explode("attributes").alias("a")).select("oid", F.to_timestamp("a.time").alias("ts"), F.col("a.name").alias("field"), "a.value")
    objects, changes = _with_values(o.select(F.col("id").alias("oid"), "type"), values)
    return Ocel(events, objects, _relations(e, "eid", "oid", "relationships"), _relations(o, "oid", "oid2", "relationships"), changes)


def read_json(spark: SparkSession, path: str) -> Ocel:
    """A JSON document of version 1."""
    doc = spark.read.schema(_JSON1).json(path, multiLine=True)
    e = doc.select(F.explode("`ocel:events`").alias("id", "x")).select("id", "x.*")
    o = doc.select(F.explode("`ocel:objects`").alias("id", "x")).select("id", "x.*")
    none = F.create_map().cast("map<string,string>")
    events = _wide(e.select(F.col("id").alias("eid"), F.col("`ocel:activity`").alias("act"), F.to_timestamp("`ocel:timestamp`").alias("ts"), F.coalesce(F.col("`ocel:vmap`"), none).alias("_values")), "_values")
    objects = _wide(o.select(F.col("id").alias("oid"), F.col("`ocel:type`").alias("type"), F.coalesce(F.col("`ocel:ovmap`"), none).alias("_values")), "_values")
    e2o = e.select(F.col("id").alias("eid"), F.explode("`ocel:omap`").alias("oid"), F.lit("").alias("qualifier"))
    return Ocel(events, objects, e2o, spark.createDataFrame([], "oid string, oid2 string, qualifier string"))


def _attributes(df: DataFrame, keys: tuple[str, ...]) -> list[str]:
    return [c for c in df.columns if c not in keys]


def _named(df: DataFrame, keys: tuple[str, ...], more: Column | None = None) -> Column:
    """name, value (and time) of the attributes that a row has."""
    own = [F.struct(F.lit(c).alias("name"), *([F.lit(EMPTY).alias("time")] if more is not None else []), F.col(f"`{c}`").cast("string").alias("value")) for c in _attributes(df, keys)]
    some = F.filter(F.array(*own), lambda x: x["value"].isNotNull()) if own else F.array()
    return some if more is None else F.concat(some, more) if own else more


def _one_file(parts: list[str | DataFrame], path: str) -> None:
    """Texts and the rows of one-column frames, in order, as one file; rows are joined by commas if the text before ends with a bracket.

    Rows come to the driver partition by partition, never all at once."""
    with open(path, "w", encoding="utf-8") as f:
        before = ""
        for part in parts:
            if isinstance(part, str):
                f.write(part)
                before = part
            else:
                comma = "," if before.rstrip().endswith(("[", "{")) else ""
                for i, r in enumerate(part.toLocalIterator()):
                    f.write((comma + "\n" if i and comma else "\n" if not comma else "") + r[0])


def _linked(base: DataFrame, links: DataFrame, on: str, to: str, other: str) -> DataFrame:
    rel = links.groupBy(on).agg(F.array_sort(F.collect_list(F.struct(F.col(other).alias("objectId"), "qualifier"))).alias("relationships"))
    return base.join(rel, on, "left").withColumn("relationships", F.coalesce("relationships", F.array().cast("array<struct<objectId:string,qualifier:string>>"))).withColumnRenamed(on, to)


def _changes(log: Ocel) -> DataFrame:
    if log.changes is None:
        return log.objects.select("oid").limit(0).withColumn("later", F.array().cast("array<struct<name:string,time:string,value:string>>"))
    x = log.changes.select("oid", F.struct(F.col("field").alias("name"), F.date_format("ts", TIME).alias("time"), F.col("value").cast("string").alias("value")).alias("x"))
    return x.groupBy("oid").agg(F.array_sort(F.collect_list("x")).alias("later"))


def _types(df: DataFrame, kind: str, keys: tuple[str, ...]) -> str:
    """Declarations of the types and their attributes (few rows)."""
    names = _attributes(df, keys)
    seen = df.groupBy(F.col(kind).alias("name")).agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in names]).collect()
    return json.dumps([{"name": r["name"], "attributes": [{"name": c, "type": "string"} for c in names if r[c]]} for r in sorted(seen, key=lambda r: str(r["name"]))])


def write_json2(log: Ocel, path: str) -> None:
    """One JSON document of version 2 on the driver's disk."""
    e, o = log.events, log.objects.join(_changes(log), "oid", "left").withColumn("later", F.coalesce("later", F.array().cast("array<struct<name:string,time:string,value:string>>")))
    events = _linked(e.select("eid", F.col("act").alias("type"), F.date_format("ts", TIME).alias("time"), _named(e, ("eid", "act", "ts")).alias("attributes")), log.e2o, "eid", "id", "oid")
    objects = _linked(o.select("oid", "type", _named(o, ("oid", "type", "later"), F.col("later")).alias("attributes")), log.o2o, "oid", "id", "oid2")
    text = lambda df, *cs: df.orderBy("id").select(F.to_json(F.struct(*cs)))
    _one_file(['{"objectTypes": ', _types(log.objects, "type", ("oid", "type")), ', "eventTypes": ', _types(e, "act", ("eid", "act", "ts")), ', "events": [', text(events, "id", "type", "time", "attributes", "relationships"), '], "objects": [', text(objects, "id", "type", "attributes", "relationships"), "]}\n"], path)


def write_json(log: Ocel, path: str) -> None:
    """One JSON document of version 1 on the driver's disk (object relations and changes have no place there)."""
    none = F.create_map().cast("map<string,string>")
    values = lambda df, keys: F.coalesce(F.map_from_entries(_named(df, keys)), none) if _attributes(df, keys) else none
    e = _linked(log.events.select("eid", "act", "ts", values(log.events, ("eid", "act", "ts")).alias("vmap")), log.e2o, "eid", "id", "oid")
    pair = lambda i, x: F.concat(F.to_json(F.array(i)).substr(F.lit(2), F.length(F.to_json(F.array(i))) - 2), F.lit(": "), F.to_json(x))
    events = e.orderBy("id").select(pair(F.col("id"), F.struct(F.col("act").alias("ocel:activity"), F.date_format("ts", TIME).alias("ocel:timestamp"), F.transform("relationships", lambda x: x["objectId"]).alias("ocel:omap"), F.col("vmap").alias("ocel:vmap"))))
    objects = log.objects.orderBy("oid").select(pair(F.col("oid"), F.struct(F.col("type").alias("ocel:type"), values(log.objects, ("oid", "type")).alias("ocel:ovmap"))))
    kinds = [r[0] for r in log.objects.select("type").distinct().collect()]
    names = _attributes(log.events, ("eid", "act", "ts")) + _attributes(log.objects, ("oid", "type"))
    head = json.dumps({"ocel:version": "1.0", "ocel:ordering": "timestamp", "ocel:attribute-names": sorted(names), "ocel:object-types": sorted(kinds)})
    _one_file([f'{{"ocel:global-log": {head}, "ocel:events": {{', events, '}, "ocel:objects": {', objects, "}}\n"], path)


# --- XML


_KEYED = "array<struct<_key: string, _value: string>>"
_LISTS = f"list array<struct<_key: string, {', '.join(f'`{k}`: {_KEYED}' for k in KINDS)}>>"
_XML1 = f"{', '.join(f'`{k}` {_KEYED}' for k in KINDS)}, {_LISTS}"
_REL = "objects struct<relationship: array<struct<`_object-id`: string, _qualifier: string>>>"
_XML2E = f"_id string, _type string, _time string, attributes struct<attribute: array<struct<_name: string, _VALUE: string>>>, {_REL}"
_XML2O = f"_id string, _type string, attributes struct<attribute: array<struct<_name: string, _time: string, _VALUE: string>>>, {_REL}"


def read_xml2(spark: SparkSession, path: str) -> Ocel:
    """An XML document of version 2."""
    rows = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path).filter("_id is not null").withColumnRenamed("_id", "id")
    e, o = rows("event", _XML2E), rows("object", _XML2O)
    none = F.create_map().cast("map<string,string>")
    events = _wide(e.select(F.col("id").alias("eid"), F.col("_type").alias("act"), F.to_timestamp("_time").alias("ts"), F.coalesce(_entries(F.col("attributes.attribute"), "_name", "_VALUE"), none).alias("_values")), "_values")
    values = o.select(F.col("id").alias("oid"), F.explode("attributes.attribute").alias("a")).select("oid", F.to_timestamp("a._time").alias("ts"), F.col("a._name").alias("field"), F.col("a._VALUE").alias("value"))
    objects, changes = _with_values(o.select(F.col("id").alias("oid"), F.col("_type").alias("type")), values)
    link = lambda df, a, b: _relations(df, a, b, "objects.relationship", "_object-id", "_qualifier")
    return Ocel(events, objects, link(e, "eid", "oid"), link(o, "oid", "oid2"), changes)


def read_xml(spark: SparkSession, path: str) -> Ocel:
    """An XML document of version 1."""
    rows = lambda tag: spark.read.format("xml").option("rowTag", tag).schema(_XML1).load(path)
    one = lambda kind, key: F.get(F.filter(F.col(f"`{kind}`"), lambda x: x["_key"] == key), F.lit(0))["_value"]
    lists = lambda key: F.get(F.filter("list", lambda x: x["_key"] == key), F.lit(0))
    none = F.create_map().cast("map<string,string>")

    def values(key: str) -> Column:
        parts = [F.coalesce(lists(key)[k], F.array().cast("array<struct<_key:string,_value:string>>")) for k in KINDS]
        return F.coalesce(_entries(F.concat(*parts), "_key", "_value"), none).alias("_values")

    e, o = rows("event"), rows("object")
    events = _wide(e.select(one("string", "id").alias("eid"), one("string", "activity").alias("act"), F.to_timestamp(one("date", "timestamp")).alias("ts"), values("vmap")).filter("eid is not null"), "_values")
    objects = _wide(o.select(one("string", "id").alias("oid"), one("string", "type").alias("type"), values("ovmap")).filter("oid is not null"), "_values")
    e2o = e.select(one("string", "id").alias("eid"), F.explode(lists("omap")["string"]).alias("x")).select("eid", F.col("x._value").alias("oid"), F.lit("").alias("qualifier"))
    return Ocel(events, objects, e2o, spark.createDataFrame([], "oid string, oid2 string, qualifier string"))


def _escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _tag(name: str, body: Column, /, **attributes: Column) -> Column:
    parts = [x for k, v in attributes.items() for x in (F.lit(f' {k.replace("_", "-")}="'), _escape(F.coalesce(v, F.lit(""))), F.lit('"'))]
    return F.concat(F.lit(f"<{name}"), *parts, F.lit(">"), body, F.lit(f"</{name}>"))


def write_xml2(log: Ocel, path: str) -> None:
    """One XML document of version 2 on the driver's disk."""
    o = log.objects.join(_changes(log), "oid", "left").withColumn("later", F.coalesce("later", F.array().cast("array<struct<name:string,time:string,value:string>>")))
    none = F.lit("")
    related = _tag("objects", F.array_join(F.transform("relationships", lambda r: _tag("relationship", none, object_id=r["objectId"], qualifier=r["qualifier"])), ""))
    e = _linked(log.events.select("eid", "act", F.date_format("ts", TIME).alias("time"), _named(log.events, ("eid", "act", "ts")).cast("array<struct<name:string,value:string>>").alias("a")), log.e2o, "eid", "id", "oid")
    values = F.array_join(F.transform("a", lambda a: _tag("attribute", _escape(a["value"]), name=a["name"])), "")
    events = e.orderBy("id").select(_tag("event", F.concat(_tag("attributes", values), related), id=F.col("id"), type=F.col("act"), time=F.col("time")))
    x = _linked(o.select("oid", "type", _named(o, ("oid", "type", "later"), F.col("later")).alias("a")), log.o2o, "oid", "id", "oid2")
    values = F.array_join(F.transform("a", lambda a: _tag("attribute", _escape(F.coalesce(a["value"], none)), name=a["name"], time=a["time"])), "")
    objects = x.orderBy("id").select(_tag("object", F.concat(_tag("attributes", values), related), id=F.col("id"), type=F.col("type")))
    named = lambda tag, x, rest: f"<{tag} name={quoteattr(x['name'])}{rest}"
    inner = lambda t: "".join(named("attribute", a, ' type="string"/>') for a in t["attributes"])
    kinds = lambda text, kind: "".join(named(kind, t, f"><attributes>{inner(t)}</attributes></{kind}>") for t in json.loads(text))
    head = f"<object-types>{kinds(_types(log.objects, 'type', ('oid', 'type')), 'object-type')}</object-types><event-types>{kinds(_types(log.events, 'act', ('eid', 'act', 'ts')), 'event-type')}</event-types>"
    _one_file(['<?xml version="1.0" encoding="UTF-8"?>\n<log>', head, "<objects>", objects, "</objects><events>", events, "</events></log>\n"], path)


def write_xml(log: Ocel, path: str) -> None:
    """One XML document of version 1 on the driver's disk."""
    none = F.lit("")
    key = lambda kind, k, v: _tag(kind, none, key=F.lit(k) if isinstance(k, str) else k, value=v)
    listed = lambda name, items: _tag("list", F.array_join(items, ""), key=F.lit(name))
    named = lambda df, keys: F.transform(_named(df, keys).cast("array<struct<name:string,value:string>>"), lambda a: key("string", a["name"], a["value"]))
    e = _linked(log.events.select("eid", "act", F.date_format("ts", TIME).alias("time"), named(log.events, ("eid", "act", "ts")).alias("a")), log.e2o, "eid", "id", "oid")
    omap = F.transform("relationships", lambda r: key("string", "object-id", r["objectId"]))
    events = e.orderBy("id").select(_tag("event", F.concat(key("string", "id", F.col("id")), key("string", "activity", F.col("act")), key("date", "timestamp", F.col("time")), listed("omap", omap), listed("vmap", F.col("a")))))
    objects = log.objects.orderBy("oid").select(_tag("object", F.concat(key("string", "id", F.col("oid")), key("string", "type", F.col("type")), listed("ovmap", named(log.objects, ("oid", "type"))))))
    _one_file(['<?xml version="1.0" encoding="UTF-8"?>\n<log><global scope="log"><string key="version" value="1.0"/></global><events>', events, "</events><objects>", objects, "</objects></log>\n"], path)


# --- CSV


def _listed(c: Column) -> Column:
    """Items of a list in Python's notation, or of a text parted by slashes."""
    inner = F.regexp_replace(F.trim(c), r"^\[|\]$", "")
    items = F.regexp_extract_all(inner, F.lit(r"""'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)"|([^,'"\s][^,]*)"""), F.lit(0))
    plain = F.transform(items, lambda x: F.regexp_replace(F.trim(x), r"""^['"]|['"]$""", ""))
    return F.filter(plain, lambda x: x != "")


def _csv(spark: SparkSession, path: str, names: tuple[str, str, str], prefix: str, separator: str, objects: str | None, ids: tuple[str, str]) -> Ocel:
    raw = spark.read.csv(path, header=True, sep=separator, escape='"', multiLine=True)
    col = lambda c: F.col(f"`{c}`")
    types = [c for c in raw.columns if c.startswith(prefix)]
    eid, act, ts = names
    own = [c for c in raw.columns if c not in (*names, *types)]
    events = raw.select(col(eid).alias("eid"), col(act).alias("act"), F.to_timestamp(col(ts)).alias("ts"), *[col(c) for c in own])
    pieces = [_pieces(col(t), t[len(prefix) :]) for t in types]
    x = raw.select(col(eid).alias("eid"), F.explode(F.concat(*pieces) if pieces else F.array().cast("array<struct<oid:string,type:string>>")).alias("o")).select("eid", "o.oid", "o.type")
    found = x.groupBy("oid").agg(F.min_by("type", "eid").alias("type"))
    if objects:
        table = spark.read.csv(objects, header=True, sep=separator, escape='"', multiLine=True)
        found = found.join(table.withColumnRenamed(ids[0], "oid").drop(ids[1]), "oid", "left")
    return Ocel(events, found, x.select("eid", "oid", F.lit("").alias("qualifier")).distinct(), spark.createDataFrame([], "oid string, oid2 string, qualifier string"))


def _pieces(c: Column, name: str) -> Column:
    return F.transform(F.coalesce(_listed(c), F.array().cast("array<string>")), lambda v: F.struct(v.alias("oid"), F.lit(name).alias("type")))


def read_csv(spark: SparkSession, path: str, objects: str | None = None, separator: str = ",") -> Ocel:
    """A table of version 1, objects in ocel:type: columns; a second table may have the objects' attributes."""
    return _csv(spark, path, ("ocel:eid", "ocel:activity", "ocel:timestamp"), "ocel:type:", separator, objects, ("ocel:oid", "ocel:type"))


def read_csv2(spark: SparkSession, path: str, separator: str = ",") -> Ocel:
    """A table of version 2, objects in ot: columns."""
    return _csv(spark, path, ("id", "activity", "timestamp"), "ot:", separator, None, ("id", "type"))


def _write_csv(log: Ocel, path: str, names: tuple[str, str, str], prefix: str) -> None:
    types = sorted(r[0] for r in log.objects.select("type").distinct().collect())
    lists = [F.to_json(F.array_sort(F.collect_set(F.when(F.col("type") == t, F.col("oid"))))).alias(f"{prefix}{t}") for t in types]
    x = log.e2o.join(log.objects.select("oid", "type"), "oid").groupBy("eid").agg(*lists)
    more = _attributes(log.events, ("eid", "act", "ts"))
    out = log.events.join(x, "eid", "left").select(F.col("eid").alias(names[0]), F.col("act").alias(names[1]), F.date_format("ts", TIME).alias(names[2]), *[F.col(f"`{prefix}{t}`") for t in types], *[F.col(f"`{c}`") for c in more])
    out.write.mode("overwrite").csv(path, header=True, escape='"')


def write_csv(log: Ocel, path: str, objects: str | None = None) -> None:
    """Tables of version 1 (a folder each)."""
    _write_csv(log, path, ("ocel:eid", "ocel:activity", "ocel:timestamp"), "ocel:type:")
    if objects:
        log.objects.withColumnsRenamed({"oid": "ocel:oid", "type": "ocel:type"}).write.mode("overwrite").csv(objects, header=True, escape='"')


def write_csv2(log: Ocel, path: str) -> None:
    """A table of version 2 (a folder)."""
    _write_csv(log, path, ("id", "activity", "timestamp"), "ot:")


# --- SQLite


def _sql_rows(spark: SparkSession, path: str, query: str, schema: str, chunk: int = 10_000) -> DataFrame:
    """Rows of a query, streamed through one task; the file must be where executors can open it."""

    def run(_) -> Iterator[pd.DataFrame]:
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
            got = c.execute(query)
            names = [d[0] for d in got.description]
            while rows := got.fetchmany(chunk):
                yield pd.DataFrame(rows, columns=names).astype(object).map(lambda v: None if v is None else str(v))

    return spark.range(1).repartition(1).mapInPandas(run, schema)


def _tables(path: str) -> dict[str, list[str]]:
    """Names of a database's tables and their columns."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
        return {t: [r[1] for r in c.execute(f'PRAGMA table_info("{t}")')] for (t,) in c.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}


def read_sqlite2(spark: SparkSession, path: str) -> Ocel:
    """A database of version 2: one table for each type."""
    there = _tables(path)

    def maps(name: str) -> list[tuple[str, str]]:
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
            return c.execute(f"SELECT ocel_type, ocel_type_map FROM {name}").fetchall()

    def all_of(side: str, own: tuple[str, ...]) -> tuple[str, list[str]]:
        kinds = maps(f"{side}_map_type")
        names = sorted({c for _, m in kinds for c in there.get(f"{side}_{m}", []) if c not in own})
        parts = []
        for _, m in kinds:
            has = there.get(f"{side}_{m}", [])
            cells = [f'CAST("{c}" AS TEXT) AS "{c}"' if c in has else f'NULL AS "{c}"' for c in (*own, *names)]
            parts.append(f'SELECT {", ".join(cells)} FROM "{side}_{m}"')
        return " UNION ALL ".join(parts), names

    text = lambda cs: ", ".join(f"`{c}` string" for c in cs)
    query, names = all_of("event", ("ocel_id", "ocel_time"))
    times = _sql_rows(spark, path, query, text(("ocel_id", "ocel_time", *names)))
    kinds = _sql_rows(spark, path, "SELECT ocel_id, ocel_type FROM event", "ocel_id string, ocel_type string")
    events = kinds.join(times, "ocel_id", "left").select(F.col("ocel_id").alias("eid"), F.col("ocel_type").alias("act"), F.to_timestamp("ocel_time").alias("ts"), *names)
    query, names = all_of("object", ("ocel_id", "ocel_time", "ocel_changed_field"))
    values = _sql_rows(spark, path, query, text(("ocel_id", "ocel_time", "ocel_changed_field", *names)))
    first = values.filter("ocel_changed_field is null or ocel_changed_field = ''").groupBy("ocel_id").agg(F.count("*").alias("_"), *[F.min(c).alias(c) for c in names]).drop("_")
    objects = _sql_rows(spark, path, "SELECT ocel_id, ocel_type FROM object", "ocel_id string, ocel_type string").join(first, "ocel_id", "left").select(F.col("ocel_id").alias("oid"), F.col("ocel_type").alias("type"), *names)
    later = values.filter("ocel_changed_field != ''")
    field = F.coalesce(*[F.when(F.col("ocel_changed_field") == c, F.col(c)) for c in names], F.lit(None).cast("string"))
    changes = later.select(F.col("ocel_id").alias("oid"), F.to_timestamp("ocel_time").alias("ts"), F.col("ocel_changed_field").alias("field"), field.alias("value"))
    e2o = _sql_rows(spark, path, "SELECT ocel_event_id AS eid, ocel_object_id AS oid, coalesce(ocel_qualifier, '') AS qualifier FROM event_object", "eid string, oid string, qualifier string")
    o2o = _sql_rows(spark, path, "SELECT ocel_source_id AS oid, ocel_target_id AS oid2, coalesce(ocel_qualifier, '') AS qualifier FROM object_object", "oid string, oid2 string, qualifier string")
    return Ocel(events, objects, e2o, o2o, changes)


def _insert(c: sqlite3.Connection, table: str, df: DataFrame) -> None:
    """Creates a table of texts and fills it, one partition of the frame after the other."""
    names = ", ".join(f'"{x}" TEXT' for x in df.columns)
    c.execute(f'CREATE TABLE "{table}" ({names})')
    c.executemany(f'INSERT INTO "{table}" VALUES ({", ".join("?" * len(df.columns))})', (tuple(None if v is None else str(v) for v in r) for r in df.toLocalIterator()))


def write_sqlite2(log: Ocel, path: str) -> None:
    """A new database of version 2 on the driver's disk."""
    plain = lambda t: re.sub(r"[^A-Za-z0-9]", "", t.title())
    with sqlite3.connect(path) as c:
        _insert(c, "event", log.events.select(F.col("eid").alias("ocel_id"), F.col("act").alias("ocel_type")))
        _insert(c, "object", log.objects.select(F.col("oid").alias("ocel_id"), F.col("type").alias("ocel_type")))
        _insert(c, "event_object", log.e2o.select(F.col("eid").alias("ocel_event_id"), F.col("oid").alias("ocel_object_id"), F.col("qualifier").alias("ocel_qualifier")))
        _insert(c, "object_object", log.o2o.select(F.col("oid").alias("ocel_source_id"), F.col("oid2").alias("ocel_target_id"), F.col("qualifier").alias("ocel_qualifier")))
        for side, df, kind, key in (("event", log.events, "act", "eid"), ("object", log.objects, "type", "oid")):
            kinds = sorted(r[0] for r in df.select(kind).distinct().collect())
            c.execute(f"CREATE TABLE {side}_map_type (ocel_type TEXT, ocel_type_map TEXT)")
            c.executemany(f"INSERT INTO {side}_map_type VALUES (?, ?)", [(k, f"{plain(k)}{i}") for i, k in enumerate(kinds)])
            more = _attributes(df, ("eid", "act", "ts", "oid", "type"))
            for i, k in enumerate(kinds):
                rows = df.filter(F.col(kind) == k)
                if side == "event":
                    out = rows.select(F.col("eid").alias("ocel_id"), F.date_format("ts", TIME).alias("ocel_time"), *more)
                else:
                    out = rows.select(F.col("oid").alias("ocel_id"), F.lit(EMPTY).alias("ocel_time"), F.lit(None).cast("string").alias("ocel_changed_field"), *[F.col(m).cast("string").alias(m) for m in more])
                    if log.changes is not None:
                        fields = sorted({*more, *(r[0] for r in log.changes.select("field").distinct().collect())})
                        for f in fields:
                            if f not in out.columns:
                                out = out.withColumn(f, F.lit(None).cast("string"))
                        own = log.changes.join(rows.select("oid"), "oid", "left_semi").select(F.col("oid").alias("ocel_id"), F.date_format("ts", TIME).alias("ocel_time"), F.col("field").alias("ocel_changed_field"), *[F.when(F.col("field") == f, F.col("value")).alias(f) for f in fields])
                        out = out.unionByName(own)
                _insert(c, f"{side}_{plain(k)}{i}", out)


def write_sqlite(log: Ocel, path: str) -> None:
    """A new database of version 1: tables EVENTS, OBJECTS and RELATIONS."""
    with sqlite3.connect(path) as c:
        more = _attributes(log.events, ("eid", "act", "ts"))
        _insert(c, "EVENTS", log.events.select(F.col("eid").alias("ocel:eid"), F.col("act").alias("ocel:activity"), F.date_format("ts", TIME).alias("ocel:timestamp"), *more))
        _insert(c, "OBJECTS", log.objects.withColumnsRenamed({"oid": "ocel:oid", "type": "ocel:type"}))
        rel = log.e2o.join(log.events.select("eid", "act", "ts"), "eid").join(log.objects.select("oid", "type"), "oid")
        _insert(c, "RELATIONS", rel.select(F.col("eid").alias("ocel:eid"), F.col("act").alias("ocel:activity"), F.date_format("ts", TIME).alias("ocel:timestamp"), F.col("oid").alias("ocel:oid"), F.col("type").alias("ocel:type")))


def read_sqlite(spark: SparkSession, path: str) -> Ocel:
    """A database of version 1."""
    there = _tables(path)
    rows = lambda t: _sql_rows(spark, path, f'SELECT * FROM "{t}"', ", ".join(f"`{c}` string" for c in there[t]))
    e, o, r = rows("EVENTS"), rows("OBJECTS"), rows("RELATIONS")
    events = e.select(F.col("`ocel:eid`").alias("eid"), F.col("`ocel:activity`").alias("act"), F.to_timestamp("`ocel:timestamp`").alias("ts"), *[F.col(f"`{c}`") for c in e.columns if not c.startswith("ocel:")])
    objects = o.select(F.col("`ocel:oid`").alias("oid"), F.col("`ocel:type`").alias("type"), *[F.col(f"`{c}`") for c in o.columns if not c.startswith("ocel:")])
    return Ocel(events, objects, r.select(F.col("`ocel:eid`").alias("eid"), F.col("`ocel:oid`").alias("oid"), F.lit("").alias("qualifier")).distinct(), spark.createDataFrame([], "oid string, oid2 string, qualifier string"))


READERS = {".jsonocel": read_json2, ".xmlocel": read_xml2, ".sqlite": read_sqlite2, ".json": read_json2, ".xml": read_xml2, ".csv": read_csv2}


def read(spark: SparkSession, path: str, version: int = 2) -> Ocel:
    """A log by its file's ending."""
    ending = re.search(r"\.[a-z]+$", path.lower())
    if not ending or ending[0] not in READERS:
        raise ValueError(f"no form is known for {path!r}")
    old = {read_json2: read_json, read_xml2: read_xml, read_sqlite2: read_sqlite, read_csv2: read_csv}
    reader = READERS[ending[0]]
    return (reader if version == 2 else old[reader])(spark, path)


def write(log: Ocel, path: str, version: int = 2) -> None:
    """A log in the form of its file's ending."""
    new = {".jsonocel": write_json2, ".json": write_json2, ".xmlocel": write_xml2, ".xml": write_xml2, ".sqlite": write_sqlite2, ".csv": write_csv2}
    old = {".jsonocel": write_json, ".json": write_json, ".xmlocel": write_xml, ".xml": write_xml, ".sqlite": write_sqlite, ".csv": write_csv}
    ending = re.search(r"\.[a-z]+$", path.lower())
    if not ending or ending[0] not in new:
        raise ValueError(f"no form is known for {path!r}")
    (new if version == 2 else old)[ending[0]](log, path)
