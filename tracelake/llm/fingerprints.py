"""Operator 7, document fingerprints by winnowing.

A rolling polynomial hash covers every K code points; in every window of W
neighbouring hashes the least is kept, the rightmost of equal ones, with its
position.  Any passage of K + W - 1 code points that two texts share therefore
puts at least one common hash in both fingerprints.

Defined cases: a null text is empty and has no fingerprint; a text under K code
points is hashed as a whole (position 0); one of under W hashes is one window; a text of any length is read whole.
Two empty fingerprints have likeness 1, an empty and another 0.  Rows with equal
ids are ordered by their text's hash; a null id counts as the lowest; an id may be any integer of 64 bits, and ids
of another type are an error.  An id that many rows share (null, say) is dealt out by its texts' hashes.  No rows give
no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_slices, table

K, W = 24, 32
BASE = np.uint64(0x100000001B3)
MIX = np.uint64(0x9E3779B97F4A7C15)
ID_FLOOR = -(1 << 63)


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(points: np.ndarray, k: int = K) -> np.ndarray:
    """32-bit hashes of every run of k code points, by doubling: a run of 2m is two runs of m."""
    if not points.size:
        return np.zeros(0, np.uint64)
    k = min(k, points.size)
    with np.errstate(over="ignore"):
        run = (points.astype(np.uint64) + np.uint64(1)) * MIX
        run ^= run >> np.uint64(29)
        power, size = BASE, 1
        have, have_size = None, 0
        while True:
            if k & size:
                if have is None:
                    have, have_size = run, size
                else:
                    n = points.size - have_size - size + 1
                    have = have[:n] * power + run[have_size : have_size + n]
                    have_size += size
            if size * 2 > k:
                break
            n = points.size - 2 * size + 1
            run = run[:n] * power + run[size : size + n]
            power = power * power
            size *= 2
        have = have ^ (have >> np.uint64(31))
        have = have * MIX
    return have >> np.uint64(32)


def winnow(points: np.ndarray, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """Kept hashes and their positions, in order of position."""
    h = gram_hashes(points, k)
    if not h.size:
        return h.astype(np.int64), np.zeros(0, np.int64)
    low = np.uint64(0xFFFFFFFF)
    key = (h << np.uint64(32)) | (low - np.arange(h.size, dtype=np.uint64))  # of equal hashes the rightmost is least
    w = min(w, h.size)
    span, size, best = key, 1, None
    done = 0
    while True:  # least of every window, by doubling
        if w & size:
            best = span if best is None else np.minimum(best[: h.size - done - size + 1], span[done : done + h.size - done - size + 1])
            done += size
        if size * 2 > w:
            break
        n = h.size - 2 * size + 1
        span = np.minimum(span[:n], span[size : size + n])
        size *= 2
    kept = best[np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))]
    return (kept >> np.uint64(32)).astype(np.int64), (low - (kept & low)).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of kept hashes."""
    a, b = np.unique(a), np.unique(b)
    both = np.intersect1d(a, b, assume_unique=True).size
    return both / (a.size + b.size - both) if a.size + b.size else 1.0


def fingerprint(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, w: int = W) -> DataFrame:
    """key, n_chars, hashes array<long>, positions array<long> of every row."""

    def make():
        def f(x):
            points = [code_points(t) for t in x["text"]]
            got = [winnow(p, k, w) for p in points]
            return {"k": x["k"], "n": [p.size for p in points], "h": [g[0] for g in got], "p": [g[1] for g in got]}

        return f

    kind = df.schema[key].dataType.simpleString()
    return map_slices(df.select(F.col(key).alias("k"), F.col(text).alias("text")), "text", make, f"k {kind}, n_chars long, hashes array<long>, positions array<long>").withColumnRenamed("k", key)


def _range_of(k, h, cuts: list[int]):
    """A row's range from its key and its text's hash, given sorted cut points.

    A cut that comes several times is a key with more than one range's share of rows; those rows get as many ranges,
    by hash.  The place among the cuts is found by bisection.
    """
    seen = Counter(cuts)
    points = sorted(seen)
    times = [0, *(seen[p] if seen[p] > 1 else 0 for p in points)]  # by how many points are at most the key
    first = np.concatenate([[0], np.cumsum([t + 1 for t in times])])[:-1].tolist()
    bits = max(1, len(points).bit_length())
    padded = F.lit([*points, *[(1 << 63) - 1] * ((1 << bits) - len(points))]).cast("array<long>")
    step = lambda lo, i: F.when(F.element_at(padded, (lo + i).cast("int")) <= k, lo + i).otherwise(lo)
    at = F.least(F.aggregate(F.lit([1 << i for i in reversed(range(bits))]).cast("array<int>"), F.lit(0), step), F.lit(len(points)))
    n = F.element_at(F.lit(times).cast("array<int>"), at + 1)
    own = F.when((n > 0) & (k == F.element_at(padded, F.greatest(at, F.lit(1)))), F.least(F.floor((h / F.lit(2.0**64) + 0.5) * n).cast("int"), n - 1)).otherwise(n)
    return F.element_at(F.lit(first).cast("array<int>"), at + 1) + own


def with_next(df: DataFrame, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Rows of (k, text, part, halo), dealt out by ranges of the key and sorted in them,
    so that a row's next document (descending key) is the one before it.

    One shuffle of the texts; no task gets more than its range.  Ranges come from
    approximate quantiles of the key.  The last row of each range is dealt a second
    time, as the ``halo`` of the range after it (the last of all to the first).
    Only the ranges' last keys, one for each, reach the driver.
    """
    if df.schema[key].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{key} must be of an integer type to have an order of documents")
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    k = F.coalesce(F.col(key).cast("long"), F.lit(ID_FLOOR))
    cuts = sorted(min(int(c), (1 << 63) - 2) for c in df.select(k.alias("k")).approxQuantile("k", [i / (4 * n) for i in range(1, 4 * n)], 1 / (16 * n)))
    often = [c for c, times in Counter(cuts).items() if times > 1]
    # the text is read for this only where a key has several ranges
    all_rows = df.select(k.alias("k"), F.col(text).alias("text")).withColumn("h", F.when(F.col("k").isin(often), F.xxhash64("text")).otherwise(F.lit(0)) if often else F.lit(0).cast("long"))
    rows = all_rows.withColumn("part", _range_of(F.col("k"), F.col("h"), cuts) if cuts else F.lit(0))
    ends = sorted((r["part"], *r["last"]) for r in rows.groupBy("part").agg(F.max(F.struct("k", "h")).alias("last")).collect())
    if not ends:
        return rows.drop("h").withColumn("halo", F.lit(0)).limit(0)
    targets = spark.createDataFrame([(k_, h_, ends[(i + 1) % len(ends)][0]) for i, (_, k_, h_) in enumerate(ends)], "k long, h long, part int")
    halo = all_rows.join(F.broadcast(targets), ["k", "h"]).select("k", "text", "part").dropDuplicates()
    dealt = rows.drop("h").withColumn("halo", F.lit(0)).unionByName(halo.withColumn("halo", F.lit(-1)))
    return dealt.repartition(n, "part").sortWithinPartitions("part", "halo", "k", F.xxhash64("text"))


def edited_fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, w: int = W, parts: int | None = None) -> DataFrame:
    """Each text's fingerprint, that of its edited text, and their likenesses."""

    def make():
        before: dict = {"part": None, "points": None, "kept": None}

        def f(x):
            out = {c: [] for c in ("k", "n", "sha", "h", "p", "eh", "ep", "near", "next")}
            for key_, text_, part, halo in zip(x["k"], x["text"], x["part"], x["halo"], strict=True):
                points = code_points(text_)
                kept = winnow(points, k, w)
                if halo == 0:
                    half = points.size // 2
                    edited = np.concatenate([points[: points.size - half], before["points"][:half]])
                    same = np.array_equal(edited, points)
                    new = kept if same else winnow(edited, k, w)
                    for c, v in zip(out, (key_, points.size, hashlib.sha256(edited.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest(), *kept, *new, likeness(kept[0], new[0]), likeness(kept[0], before["kept"][0])), strict=True):
                        out[c].append(v)
                before.update(points=points, kept=kept)
            return out

        return f

    rows = with_next(df, key, text, parts)
    return map_slices(rows, "text", make, "k long, n_chars long, edited_sha256 string, hashes array<long>, positions array<long>, edited_hashes array<long>, edited_positions array<long>, near_edited double, near_next double").withColumn("k", F.when(F.col("k") != ID_FLOOR, F.col("k"))).withColumnRenamed("k", key)


def _digest(hashes: str, positions: str):
    """The count and a digest of the pairs hash:position, from the operator's columns."""
    pairs = F.array_join(F.col(hashes), ",")
    return F.concat(F.size(hashes), F.lit(":"), F.sha2(F.concat(pairs, F.lit(";"), F.array_join(F.col(positions), ",")), 256))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowed fingerprints of every text and of its edited text."""
    out = edited_fingerprints(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", "edited_sha256", _digest("hashes", "positions").alias("fingerprint"), _digest("edited_hashes", "edited_positions").alias("edited_fingerprint"), "near_edited", "near_next")
