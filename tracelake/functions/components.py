"""Connected components: links contracted where they lie, then large and small stars of what still meets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.layout import spread
from tracelake.functions.shipping import ship_package

#: Links that a task contracts at a time, which bounds its memory.
AT_ONCE = 2_000_000


def _roots(a, b, n: int):
    """The least vertex of each vertex's component over links a-b of vertices 0 to n - 1."""
    import numpy as np

    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _contracted(batches):
    """v, label (the least vertex that v hangs together with) of the vertices of up to ``AT_ONCE`` links a time."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def labels(held):
        t = pa.Table.from_batches(held)
        both = pa.chunked_array([*t.column("v").chunks, *t.column("m").chunks]).combine_chunks()
        coded = (both.combine_chunks() if isinstance(both, pa.ChunkedArray) else both).dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        codes = place[coded.indices.to_numpy()]
        v = coded.dictionary.take(pa.array(order))
        label = v.take(pa.array(_roots(codes[: t.num_rows], codes[t.num_rows :], len(order))))
        return pa.Table.from_arrays([v, label], ["v", "label"]).to_batches(max_chunksize=100_000)

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= AT_ONCE:
            yield from labels(held)
            held, n = [], 0
    if n:
        yield from labels(held)


def _open(edges: DataFrame) -> bool:
    """Whether a vertex has two parents, or a parent has one itself."""
    ends = edges.select("v", "m").unionByName(edges.select(F.col("m").alias("v"), F.lit(None).cast(edges.schema["m"].dataType).alias("m")))
    seen = ends.groupBy("v").agg(F.min("m").alias("lo"), F.max("m").alias("hi"), F.count_if(F.col("m").isNull()).alias("child"))
    return bool(seen.filter("lo is not null and (lo != hi or child > 0)").limit(1).count())


def stars(links: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """v, label (the least vertex of its component) of every vertex of links (a, b), round by round.

    Rounds grow with the logarithm of the longest chain; there is no cap.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct())
    vertices = edges.select("v").union(edges.select("m")).distinct()
    edges = edges.filter("v != m")
    while _open(edges):
        both = edges.union(edges.select("m", "v"))
        low = both.groupBy("v").agg(F.least(F.col("v"), F.min("m")).alias("low"))
        large = cut(both.filter("m > v").join(low, "v").select(F.col("m").alias("v"), F.col("low").alias("m")).distinct())
        low = large.groupBy("v").agg(F.min("m").alias("low"))
        small = large.join(low, "v").select(F.col("m").alias("v"), F.col("low").alias("m")).filter("v != m")
        edges = cut(small.union(low).distinct())
    return vertices.join(edges, "v", "left").select("v", F.coalesce("m", "v").alias("label"))


def components(links: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """v, label (the least vertex of its component) of every vertex of links (a, b).

    Tasks contract the links they read, so a vertex moves once for each contraction it is in.  Only the labels that meet
    in a vertex are links of their own then, and go through ``stars``.  ``cut`` keeps rows and cuts their lineage.
    """
    ship_package(links.sparkSession)
    pairs = links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).filter("v is not null")
    kind = pairs.schema["v"].dataType.simpleString()
    rows = spread(pairs.mapInArrow(_contracted, f"v {kind}, label {kind}"), "v")
    met = cut(rows.groupBy("v").agg(F.min("label").alias("m"), F.collect_set("label").alias("all")).select("v", "m", F.filter("all", lambda x: x != F.col("m")).alias("others")))
    roots = stars(met.select(F.explode("others").alias("a"), F.col("m").alias("b")), cut)
    return met.select("v", "m").join(roots.select(F.col("v").alias("m"), "label"), "m", "left").select("v", F.coalesce("label", "m").alias("label"))
