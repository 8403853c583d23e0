"""Readers and writers of log files: CSV, XES, OCEL 2.0 JSON, edge-graph text."""

from __future__ import annotations

from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.operators.core import format_log
from tracelake.sources.tables import Ocel

# Texts that stand for a missing value in tables.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def _positioned(df: DataFrame) -> DataFrame:
    """A reader's rows with ``_at``: their file, and their place in what one task reads of it, which goes along the file."""
    return df.withColumn("_at", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")))


def _logged(x: DataFrame, case: str, act: str, ts: str) -> DataFrame:
    """Canonical columns; events of equal times stay in the order of the file."""
    return format_log(x, case, act, ts, ("_at",)).drop("_at")


def read_csv(spark: SparkSession, path: str, case: str = "case:concept:name", act: str = "concept:name", ts: str = "time:timestamp", separator: str = ",") -> DataFrame:
    """A CSV table as a log; missing-value texts are nulls; events of equal times keep the file's order."""
    return _csv_log(_positioned(spark.read.csv(path, header=True, sep=separator)), case, act, ts)


def read_csv_text(spark: SparkSession, text, case: str = "case:concept:name", act: str = "concept:name", ts: str = "time:timestamp", separator: str = ",") -> DataFrame:
    """The same from an open text file or a text."""
    import csv
    import io

    rows = list(csv.reader(io.StringIO(text) if isinstance(text, str) else text, delimiter=separator))
    names = rows[0] if rows else [case, act, ts]
    df = spark.createDataFrame([(*[v or None for v in r], i) for i, r in enumerate(rows[1:])], ", ".join([*(f"`{n}` string" for n in names), "_at long"]))
    return _csv_log(df, case, act, ts)


def _csv_log(raw: DataFrame, case: str, act: str, ts: str) -> DataFrame:
    own = [c for c in raw.columns if c != "_at"]
    plain = lambda n: n.replace(":", "_").replace(".", "_")
    x = raw.select(*[F.when(~F.col(f"`{c}`").isin(MISSING), F.col(f"`{c}`")).alias(plain(c)) for c in own], "_at")
    return _logged(x, plain(case), plain(act), plain(ts))


def write_csv(log: DataFrame, path: str) -> None:
    """One row an event; times in RFC 3339."""
    times = [f.name for f in log.schema if isinstance(f.dataType, T.TimestampType)]
    log.withColumns({c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX") for c in times}).write.mode("overwrite").csv(path, header=True)


def csv_text(log: DataFrame, out) -> None:
    """The same into an open text file on the driver, partition after partition."""
    import csv

    times = [f.name for f in log.schema if isinstance(f.dataType, T.TimestampType)]
    rows = log.withColumns({c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX") for c in times})
    w = csv.writer(out)
    w.writerow(rows.columns)
    w.writerows(rows.toLocalIterator())


def read_parquet(spark: SparkSession, path: str, case: str, act: str, ts: str) -> DataFrame:
    """A Parquet table as a log; events of equal times keep the file's order."""
    return _logged(_positioned(spark.read.parquet(path)), case, act, ts)


def read_parquet_file(spark: SparkSession, source, case: str, act: str, ts: str) -> DataFrame:
    """The same from an open binary file (or bytes) on the driver."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    table = pq.read_table(pa.BufferReader(source) if isinstance(source, bytes) else source)
    return _logged(spark.createDataFrame(table.append_column("_at", pa.array(range(table.num_rows), pa.int64()))), case, act, ts)


def write_parquet(log: DataFrame, path: str) -> None:
    log.write.mode("overwrite").parquet(path)


def parquet_file(log: DataFrame, out) -> None:
    """The log as one Parquet file into an open binary file on the driver, partition after partition."""
    import pyarrow.parquet as pq

    from tracelake.operators.logs import to_arrow_batches

    writer = None
    for batch in to_arrow_batches(log):
        writer = writer or pq.ParquetWriter(out, batch.schema)
        writer.write_batch(batch)
    if writer is None:
        writer = pq.ParquetWriter(out, log.limit(0).toArrow().schema)
    writer.close()


def read_xes_file(spark: SparkSession, path: str) -> DataFrame:
    """A XES document as a log by one pass on the driver, trace by trace: for documents on the driver's disk; all attributes are texts."""
    from tracelake.streaming.live import xes_traces

    rows = [(a.get("concept:name") or f"trace-{i}", j, e.get("concept:name"), e.get("time:timestamp")) for i, (a, events) in enumerate(xes_traces(path)) for j, e in enumerate(events)]
    return spark.createDataFrame(rows, "case_id string, idx long, act string, ts string").withColumn("ts", F.to_timestamp("ts"))


_ATTRIBUTE = T.ArrayType(T.StructType([T.StructField("_key", T.StringType()), T.StructField("_value", T.StringType())]))
_KINDS = ("string", "date", "int", "float", "boolean", "id")
_FIELDS = [T.StructField(k, _ATTRIBUTE) for k in _KINDS]
_TRACE = T.StructType([*_FIELDS, T.StructField("event", T.ArrayType(T.StructType(_FIELDS)))])


def _value(holder: str, kind: str, key: str):
    return F.get(F.filter(F.col(f"{holder}`{kind}`" if not holder else f"{holder}.{kind}"), lambda a: a["_key"] == key), F.lit(0))["_value"]


def read_xes(spark: SparkSession, path: str, attributes: dict[str, str] | None = None) -> DataFrame:
    """XES traces (plain or .gz) as a log; ``attributes`` gives further event attributes and their kinds.

    Traces without a name are named by their place in the file.
    """
    traces = spark.read.format("xml").option("rowTag", "trace").schema(_TRACE).load(path)
    named = traces.select(F.coalesce(_value("", "string", "concept:name"), F.concat(F.lit("trace-"), F.monotonically_increasing_id().cast("string"))).alias("case_id"), F.posexplode("event").alias("pos", "e"))
    types = {"int": "long", "float": "double", "boolean": "boolean", "date": "timestamp"}
    more = [_value("e", k, a).cast(types.get(k, "string")).alias(a.replace(":", "_")) for a, k in (attributes or {}).items()]
    return named.select("case_id", F.col("pos").cast("long").alias("idx"), _value("e", "string", "concept:name").alias("act"), F.to_timestamp(_value("e", "date", "time:timestamp")).alias("ts"), *more)


def xes_text(log: DataFrame) -> DataFrame:
    """case_id, xml: each case as a trace element (names and times)."""

    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    event = F.concat(F.lit('<event><string key="concept:name" value="'), esc(F.col("act")), F.lit('"/><date key="time:timestamp" value="'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"), F.lit('"/></event>'))
    events = F.transform(F.array_sort(F.collect_list(F.struct("idx", event.alias("x")))), lambda e: e["x"])
    return log.groupBy("case_id").agg(F.array_join(events, "").alias("_e")).select("case_id", F.concat(F.lit('<trace><string key="concept:name" value="'), esc(F.col("case_id")), F.lit('"/>'), "_e", F.lit("</trace>")).alias("xml"))


def write_xes(log: DataFrame, path: str) -> None:
    """One XES document a part file: traces are written where they are, between a header and a footer.  ``xes_file`` makes a single document."""
    parts = xes_text(log)

    def document(batches):
        import pandas as pd

        yield pd.DataFrame({"value": [f"<log xes.version={quoteattr('1.0')}>"]})
        for b in batches:
            yield pd.DataFrame({"value": b["xml"]})
        yield pd.DataFrame({"value": ["</log>"]})

    parts.mapInPandas(document, "value string").write.mode("overwrite").text(path)


def xes_file(log: DataFrame, out) -> None:
    """One XES document into an open text file on the driver: traces in order of their case, partition after partition."""
    out.write(f"<log xes.version={quoteattr('1.0')}>\n")
    for r in xes_text(log).orderBy("case_id").toLocalIterator():
        out.write(r["xml"] + "\n")
    out.write("</log>\n")


def read_ocel2_json(spark: SparkSession, path: str) -> Ocel:
    """OCEL 2.0 JSON as tables, with attributes and changes."""
    from tracelake.sources import ocel_files

    return ocel_files.read_json2(spark, path)


def write_ocel_tables(log: Ocel, folder: str) -> None:
    """A bundle: one Parquet table each for events, objects, relations and (if there are any) changes."""
    for name in ("events", "objects", "e2o", "o2o", "changes"):
        if getattr(log, name) is not None:
            getattr(log, name).write.mode("overwrite").parquet(f"{folder}/{name}")


def read_ocel_tables(spark: SparkSession, folder: str) -> Ocel:
    """A bundle; one without changes has none."""
    from pyspark.errors import AnalysisException

    tables = [spark.read.parquet(f"{folder}/{name}") for name in ("events", "objects", "e2o", "o2o")]
    try:
        return Ocel(*tables, spark.read.parquet(f"{folder}/changes"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return Ocel(*tables)


def dfg_text(edges: DataFrame, starts: DataFrame, ends: DataFrame) -> str:
    """The line form of an edge graph: activities, start and end counts, edges as i>jxn (pairs of activities, not events)."""
    e, s, t = ([tuple(r) for r in df.collect()] for df in (edges.select("source", "target", "n"), starts.select("act", "n"), ends.select("act", "n")))
    acts = sorted({a for x in e for a in x[:2]} | {a for a, _ in (*s, *t)})
    at = {a: i for i, a in enumerate(acts)}
    lines = [str(len(acts)), *acts, str(len(s)), *[f"{at[a]}x{n}" for a, n in sorted(s)], str(len(t)), *[f"{at[a]}x{n}" for a, n in sorted(t)], *[f"{at[a]}>{at[b]}x{n}" for a, b, n in sorted(e)]]
    return "\n".join(lines) + "\n"


def read_dfg_text(text: str) -> tuple[dict, dict, dict]:
    """Edge, start and end counts; of repeated records the last one counts."""
    lines = iter(text.splitlines())
    acts = [next(lines) for _ in range(int(next(lines)))]
    ends = []
    for _ in range(2):
        ends.append({acts[int(a)]: int(n) for a, _, n in (next(lines).rpartition("x") for _ in range(int(next(lines))))})
    edges = {}
    for line in lines:
        pair, _, n = line.rpartition("x")
        a, b = pair.split(">")
        edges[acts[int(a)], acts[int(b)]] = int(n)
    return edges, ends[0], ends[1]
