"""What the training-data operators share: table access and bounded Arrow batches.

Python stages run under ``mapInArrow``.  Spark hands a stage batches of a bounded
number of records; long texts can still make one batch large, so ``slices``
cuts every batch again by bytes of text before numpy expands it.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.shipping import ship_package

#: Bytes of text that one numpy step expands at once.
SLICE_BYTES = 1 << 20
#: Rows in one Arrow batch.
BATCH_ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read by Spark's own reader (paths may be remote)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Caps the rows of an Arrow batch; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose ``column`` holds about ``limit`` bytes (one row at least)."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    starts = [0, *cuts.tolist()]
    for a, b in zip(starts, [*cuts.tolist(), batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def give_back() -> None:
    """Returns a task's freed memory to the system: Spark keeps the worker for other stages, which
    would have to live beside what this one has taken."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def gathered(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Joins small batches until ``column`` holds ``limit`` bytes, then cuts them by ``slices``."""
    held: list[pa.RecordBatch] = []
    size = 0

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        n = pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if held and size + n > limit:
            yield from slices(joined(), column, limit)
            held, size = [], 0
        if batch.num_rows:
            held.append(batch)
            size += n
    if held:
        yield from slices(joined(), column, limit)


def map_slices(df: DataFrame, text: str, make: Callable[[], Callable[[dict], dict]], schema: str, limit: int = SLICE_BYTES) -> DataFrame:
    """Applies a columnar function to bounded slices of ``df``.

    ``make`` runs once in every task and returns the function, which gets a dict
    of Python lists and returns a dict of lists or arrays in the schema's order.
    """
    ship_package(df.sparkSession)
    bounded_batches(df.sparkSession)
    fields = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for part in gathered(batches, text, limit):
            out = f(part.to_pydict())
            yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, t.type, from_pandas=False) for v, t in zip(out.values(), fields, strict=True)], schema=fields)
            del out, part
        del f
        give_back()

    return df.mapInArrow(run, schema)


def _arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def crc_mod(column: str, n: int):
    """crc32 of a column's text, modulo n; null counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.  Only a local session without that
    setting (a test's) gets one of its own; a cluster without it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="tracelake-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


#: Folders that ``written`` made, in order.
_made: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it again: the lineage is cut, and
    a lost executor takes nothing of it along."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/tracelake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def marker() -> int:
    """A place in the order of written tables, for ``forget``."""
    return len(_made)


def forget(spark: SparkSession, since: int, *kept: DataFrame) -> None:
    """Deletes the tables written since a place in their order, but for those that ``kept`` read."""
    used = [f for k in kept for f in k.inputFiles()]
    for path in _made[since:]:
        if not any(path.rpartition("/")[2] in f for f in used):
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            _made.remove(path)


#: A key counts as hot if it has more than this share of the rows, and more rows than that.
HOT_SHARE, HOT_ROWS = 1 / 1024, 4096


def spread_join(left: DataFrame, right: DataFrame, key: str, sizes: DataFrame | None = None) -> DataFrame:
    """Inner join of many rows with one right row for each key, whatever a key's share of ``left``.

    The right rows of hot keys (under 1024 of them, by the definition of hot) are broadcast, so no task
    gets all the rows of one; the others meet in a plain join.  ``left`` is read several times and
    should be a table; ``sizes`` (key, n) saves the count of its keys.
    """
    sizes = left.groupBy(key).agg(F.count("*").alias("n")) if sizes is None else sizes
    least = max(HOT_ROWS, int(left.count() * HOT_SHARE))
    hot = sizes.filter(F.col("n") > least).select(key).collect()
    if not hot:
        return left.join(right, key)
    some = F.broadcast(left.sparkSession.createDataFrame([tuple(r) for r in hot], left.select(key).schema))
    return left.join(some, key, "left_anti").join(right, key).unionByName(left.join(F.broadcast(right.join(some, key, "left_semi")), key))


MEMBER_BITS = (24, 28)  # a bitmap of 2 MB, for many ids up to 32 MB


def maybe_among(ids: DataFrame, *keys: str):
    """A function of columns like ``keys``: false only where they are none of the ids.

    Ids set bits of one bitmap by their hash, 8 bits an id within ``MEMBER_BITS``; its parts are made on the executors.
    It lets most rows pass (or stay out) before an exact join moves the rest; with more ids than the bitmap
    can tell apart more rows move, and none is lost.
    """
    spark = ids.sparkSession
    low, high = MEMBER_BITS
    size = 1 << min(high, max(low, (8 * ids.count()).bit_length()))
    place = F.pmod(F.xxhash64(*keys), F.lit(size))
    parts = ids.select(place.alias("p")).groupBy(F.floor(F.col("p") / 32768).alias("part")).agg(F.bitmap_construct_agg(F.pmod("p", F.lit(32768))).alias("bits")).collect()
    bits = np.zeros(size // 32768 * 4096, np.uint8).reshape(-1, 4096)
    for r in parts:
        bits[r["part"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    shared = spark.sparkContext.broadcast(bits.ravel())
    ship_package(spark)

    @F.pandas_udf("boolean")
    def test(p: pd.Series) -> pd.Series:
        at = p.to_numpy()
        return pd.Series((shared.value[at >> 3] >> (at & 7)) & 1 == 1)

    return lambda *columns: test(F.pmod(F.xxhash64(*columns), F.lit(size)))


def sample_share(n: int, bound: int) -> int:
    """Parts in a million that keep about ``bound`` of ``n`` rows."""
    return 1_000_000 if n <= bound else max(1, bound * 1_000_000 // n)


def hash_sampled(df: DataFrame, key: str, parts: int) -> DataFrame:
    """The rows whose key's hash falls below ``parts`` in a million (stable under reruns)."""
    return df if parts >= 1_000_000 else df.filter(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < parts)
