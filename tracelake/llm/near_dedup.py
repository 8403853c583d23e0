"""Operator 5, near-duplicates: improved consistent weighted sampling, banded and verified.

A text is a weighted set of word shingles (five words; a shorter text is one
shingle).  A shingle weighs ``(1 + ln tf) * idf`` with
``idf = 1 + DAMPING * ln((1 + N) / (1 + df)) / ln(1 + N)``; the damping keeps a
shared passage from counting fully while large groups of copies, whose shingles
are frequent by nature, stay above the threshold.  Document frequencies come
from a sketch of fixed size with two rows that count every shingle of every document, less
each row's own noise; the lesser row holds, so a stranger beside a frequent shingle in one row
keeps its weight.  What is broadcast never grows; the price is that a shingle in fewer documents than the noise
(four deviations of a row's mean count) counts as one that stands in a single document.

Steps: equal texts collapse first (by digest) and get a number each; ids come in only at the end, to name
the classes.  Each text gets BANDS x ROWS consistent weighted samples; texts that agree on a band meet
in its bucket.  A bucket's least number is its pivot and is compared with the other members (first by the
samples, then exactly, by weighted Jaccard similarity of at least
``threshold``): rows grow with the members, not with their pairs.  Verified links
join into components.  A bucket that still holds several components is compared with
itself: its greatest component meets the rest, and the rest itself, in blocks dealt to tasks that hold two blocks each, test
pairs of different components (by samples, then exactly; a pair only in the first band
that it shares) and emit links alone.  So no pair of a bucket stays untested unless both are in one class already.
Joins on buckets, pivots and digests take hot keys apart (``spread_join``).

Defined cases: the key may have any type that has an order; a null text is an empty one; all empty texts are one class; a class
is named by the least id among its rows that stands with one text alone, else by its least id, and by null if no row has an id
(``class_key`` always tells classes apart); one id with several texts is in the class of each; negative ids are ids as others; repeated
rows share their class; no rows give no rows; extra columns are not read, and may have any name; texts of any length are read whole, a slice at a time.  A pair
of similarity s meets with probability 1 - (1 - s^ROWS)^BANDS (0.9996 at 0.8).
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import components as stars
from tracelake.functions.shipping import ship_package

from .common import bounded_batches, forget, fresh, give_back, map_slices, marker, maybe_among, slices, spread_join, table, written

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 5
SKETCH_BITS, SKETCH_ROWS, SKETCH_BLOCK = 18, 2, 1 << 13
DAMPING = 0.25
#: A pair goes on to the exact test if at least so many of its samples agree (0.8 is five deviations off).
AGREE = 0.6 * BANDS * ROWS
TABLE = 1 << 12
#: Members of a bucket that meet as one block when a bucket is compared with itself.
BLOCK_MEMBERS = 256
#: Members that one task compares with one pivot, and the most tasks for one pivot (they stream, so a group has no bound).
SALT_MEMBERS, SALTS = 256, 4096


class WordTable(dict):
    """word -> place of its hash in ``hashes``; both start anew when they hold too many words."""

    def __init__(self):
        self.hashes = array("Q")

    def __missing__(self, w: str) -> int:
        self[w] = at = len(self.hashes)
        self.hashes.append(xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")))
        return at


class Shingles:
    """Hashed word shingles of texts; memory of seen words is bounded."""

    def __init__(self, size: int = SHINGLE):
        self.size = size
        self.words = WordTable()

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingle hashes, ascending, and how often each occurs."""
        words = (text or "").split()
        if not words:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(self.words) > 200_000:
            self.words = WordTable()
        at = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        h = np.frombuffer(self.words.hashes, np.uint64)[at]
        k = min(self.size, h.size)
        n = h.size - k + 1
        with np.errstate(over="ignore"):
            run = np.full(n, k, np.uint64)
            for i in range(k):
                run = (run ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
                run ^= run >> np.uint64(32)
        run.sort()
        first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        return run[first], np.diff(np.append(first, n))


def sketch_bucket(hashes: np.ndarray, row: int = 0) -> np.ndarray:
    """Each hash's place in a row of the sketch."""
    with np.errstate(over="ignore"):
        spread = hashes * np.uint64(0xBF58476D1CE4E5B9) if row else hashes
    return (spread >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def document_frequencies(df: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """Counts of every document's distinct shingles by sketch row and bucket, and the number of documents.

    Each task sums its own documents and sends fixed blocks; the driver gets SKETCH_ROWS arrays of 2^SKETCH_BITS counts.
    """
    ship_package(df.sparkSession)
    bounded_batches(df.sparkSession)
    schema = "block int, sums binary, docs long"

    def packed(total):
        most = int(total.max())
        return total.astype("<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8").tobytes()

    def run(batches):
        of, total, docs = Shingles(), np.zeros((SKETCH_ROWS, 1 << SKETCH_BITS), np.int64), 0
        for batch in batches:
            for part in slices(batch, "t"):
                sets = [of(t)[0] for t in part.column("t").to_pylist()]
                docs += len(sets)
                flat = np.concatenate(sets)
                for row in range(SKETCH_ROWS):
                    total[row] += np.bincount(sketch_bucket(flat, row), minlength=1 << SKETCH_BITS)
        if docs:
            blocks = total.reshape(-1, SKETCH_BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([packed(b) for b in blocks], pa.binary()), pa.array([docs] + [0] * (len(blocks) - 1), pa.int64())], names=["block", "sums", "docs"])

    def add(key, parts):
        total, docs = np.zeros(SKETCH_BLOCK, np.int64), 0
        for v, d in zip(parts.column("sums").to_pylist(), parts.column("docs").to_pylist(), strict=True):
            total += np.frombuffer(v, f"<u{len(v) // SKETCH_BLOCK}").astype(np.int64)
            docs += d
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([packed(total)], pa.binary()), "docs": pa.array([docs], pa.int64())})

    partial = df.select(F.col(text).alias("t")).mapInArrow(run, schema)
    # blocks are summed in two steps, so that no task gets a block of every task
    first = partial.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(16))).groupBy("block", "salt").applyInArrow(add, schema)
    counts, docs = np.zeros((SKETCH_ROWS << SKETCH_BITS) // SKETCH_BLOCK * SKETCH_BLOCK, np.int64).reshape(-1, SKETCH_BLOCK), 0
    for r in first.groupBy("block").applyInArrow(add, schema).collect():
        counts[r["block"]] = np.frombuffer(bytes(r["sums"]), f"<u{len(r['sums']) // SKETCH_BLOCK}")
        docs += r["docs"]
    return counts.reshape(SKETCH_ROWS, -1), docs


def idf_table(counts: np.ndarray, docs: int) -> np.ndarray:
    """Damped inverse document frequency by sketch row and bucket (float32)."""
    noise = counts.mean(axis=-1, keepdims=True)
    df = np.clip(counts - noise - 4 * np.sqrt(noise), 1, max(1, docs))
    return (1 + DAMPING * np.log((1 + docs) / (1 + df)) / np.log(2 + docs)).astype(np.float32)


def weights(hashes: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weights of shingles; of the sketch's rows the one that has counted less holds."""
    rows = np.atleast_2d(idf)
    of = rows[0][sketch_bucket(hashes)]
    for i in range(1, len(rows)):
        of = np.maximum(of, rows[i][sketch_bucket(hashes, i)])
    return (1 + np.log(counts)) * of


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of least over sum of greatest weights of two sets of (ascending hashes, weights)."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][i], b[1][j]).sum()
    whole = a[1].sum() + b[1].sum() - least
    return float(least / whole) if whole > 0 else 1.0


class Sampler:
    """Improved consistent weighted sampling.

    The draws r, c ~ Gamma(2, 1) and beta ~ U(0, 1) of a shingle come from three
    fixed tables, each by its own twelve bits of the shingle's hash.
    """

    def __init__(self, seed: int = 41):
        g = np.random.default_rng(seed)
        n = BANDS * ROWS
        self.r = g.gamma(2, 1, (TABLE, n)).astype(np.float32)
        self.log_c = np.log(g.gamma(2, 1, (TABLE, n))).astype(np.float32)
        self.beta = g.uniform(0, 1, (TABLE, n)).astype(np.float32)

    def __call__(self, hashes: np.ndarray, w: np.ndarray, step: int = 2048) -> np.ndarray:
        """BANDS * ROWS samples (uint64): the shingle and its level, mixed."""
        n = BANDS * ROWS
        best, who, level = np.full(n, np.inf, np.float32), np.zeros(n, np.uint64), np.zeros(n, np.float32)
        log_w = np.log(w).astype(np.float32)[:, None]
        mask = np.uint64(TABLE - 1)
        at = np.arange(n)
        for i in range(0, hashes.size, step):
            h = hashes[i : i + step]
            r, beta = self.r[h & mask], self.beta[(h >> np.uint64(12)) & mask]
            t = np.floor(log_w[i : i + step] / r + beta)
            a = self.log_c[(h >> np.uint64(24)) & mask] - r * (t - beta + 1)
            low = a.min(0)
            rows, cols = np.nonzero(a == low)
            k = np.zeros(n, np.int64)
            k[cols[::-1]] = rows[::-1]  # of equal ones the first
            better = low < best
            best[better], who[better], level[better] = low[better], h[k[better]], t[k[better], at[better]]
        with np.errstate(over="ignore"):
            out = (who + level.astype(np.int64).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x9E3779B97F4A7C15)
        return out ^ (out >> np.uint64(29))


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One key for each band, from the band's samples and its number."""
    rows = samples.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(ROWS):
            key = (key ^ rows[:, i]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(31)
    return key.view(np.int64)


def signatures(df: DataFrame, idf) -> DataFrame:
    """k, digest, bands array<long>, samples binary (32 bits each) of rows (k, digest, text)."""

    def make():
        of, sampler, table_ = Shingles(), Sampler(), idf.value

        def f(x):
            bands, samples = [], []
            for t in x["text"]:
                h, c = of(t)
                if h.size:
                    s = sampler(h, weights(h, c, table_))
                    bands.append(band_keys(s))
                    samples.append((s >> np.uint64(32)).astype("<u4").tobytes())
                else:
                    bands.append(np.zeros(0, np.int64))
                    samples.append(b"")
            return {"k": x["k"], "digest": x["digest"], "bands": bands, "samples": samples}

        return f

    return map_slices(df, "text", make, f"k {df.schema['k'].dataType.simpleString()}, digest binary, bands array<long>, samples binary")


def _agreeing(a, b):
    """How many 32-bit samples of two binaries are equal (in the JVM)."""
    n = BANDS * ROWS
    at = F.sequence(F.lit(0), F.lit(n - 1))
    return F.size(F.filter(at, lambda i: F.substring(a, i * 4 + 1, 4) == F.substring(b, i * 4 + 1, 4)))


def verified(pairs: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """The pairs (a, b) whose weighted similarity is at least ``threshold``, with it.

    pairs: a, b, n (about how many a has); texts: v, text.  Members travel to their pivot ``a`` once; a pivot with many
    members is dealt to several tasks (``SALT_MEMBERS`` each).
    """
    sized = pairs.select("a", "b", F.least(F.ceil(F.col("n") / SALT_MEMBERS), F.lit(SALTS)).cast("int").alias("salts")).withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    members = sized.select(F.col("b").alias("v"), "a", "salts", "salt", F.lit(1).alias("kind"))
    pivots = sized.select("a", "salts", "salt").distinct().select(F.col("a").alias("v"), "a", "salts", "salt", F.lit(0).alias("kind"))
    rows = texts.join(members.unionByName(pivots), "v").select("v", "a", "salts", "salt", "kind", "text")
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = rows.repartition(n, "a", "salts", "salt").sortWithinPartitions("a", "salts", "salt", "kind")

    def make():
        of, table_ = Shingles(), idf.value
        now: dict = {}

        def f(x):
            out = {"a": [], "b": [], "similarity": []}
            for v, a, kind, text in zip(x["v"], x["a"], x["kind"], x["text"], strict=True):
                h, c = of(text)
                mine = h, weights(h, c, table_)
                if kind == 0:
                    now["pivot"] = mine
                else:
                    s = weighted_jaccard(now["pivot"], mine)
                    if s >= threshold:
                        for k, value in zip(out, (a, v, s), strict=True):
                            out[k].append(value)
            return out

        return f

    return map_slices(dealt, "text", make, "a long, b long, similarity double")


def components(links: DataFrame) -> DataFrame:
    """v, label (the least vertex of its component) of every vertex that a link (a, b) touches."""
    return written(stars.components(links, lambda df: written(df, "stars")), "labels")


def _open_members(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """bucket, v, label, lo, hi, side: members of buckets (bucket, v, pivot) with several components (without their
    pivots, which all were compared with), dealt to pairs of blocks.

    The greatest component's blocks come first and meet the blocks of the rest; those also meet each other.
    So copies of rows grow with the members times the *rest's* blocks."""
    rows = written(buckets.filter("v != pivot").select("bucket", "v").join(labels, "v", "left").withColumn("label", F.coalesce("label", "v")), "members")
    parts = rows.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    sizes = written(parts.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("parts"), F.max(F.struct("n", "label")).alias("top")).filter("parts > 1"), "sizes")
    blocks = lambda n: F.ceil(n / BLOCK_MEMBERS).cast("int")
    dealt = spread_join(rows, sizes.select("bucket", F.col("top.label").alias("top"), blocks(F.col("top.n")).alias("first"), blocks(F.col("n") - F.col("top.n")).alias("rest")), "bucket", sizes)
    is_top, h = F.col("label") == F.col("top"), F.xxhash64("v")
    own = F.when(is_top, F.pmod(h, F.col("first"))).otherwise(F.col("first") + F.pmod(h, F.col("rest"))).cast("int")
    other = F.explode(F.sequence(F.when(is_top, F.col("first")).otherwise(F.lit(0)), F.col("first") + F.col("rest") - 1))
    return dealt.withColumn("own", own).withColumn("other", other).select("bucket", "v", "label", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side"))


def _block_links(rows: list[dict], of: Shingles, idf: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
    """Links between members of different components within one block (all of side 0, or own pair) or across two."""
    n = len(rows)
    samples = np.stack([np.frombuffer(r["samples"], "<u4") for r in rows])
    bands = np.array([r["bands"] for r in rows], np.int64)
    band = int(np.flatnonzero(bands[0] == rows[0]["bucket"])[0])
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first: dict[int, int] = {}
    for i, r in enumerate(rows):
        parent[i] = first.setdefault(r["label"], i)
    label = np.array([r["label"] for r in rows])
    side = np.array([r["side"] for r in rows])
    within = rows[0]["lo"] == rows[0]["hi"]
    sets: dict[int, tuple] = {}

    def set_of(i: int) -> tuple:
        if i not in sets:
            h, c = of(rows[i]["text"])
            w = weights(h, c, idf)
            sets[i] = h, w, w.sum()
        return sets[i]

    out = []
    for i in range(n):
        rest = np.arange(i + 1, n) if within else np.flatnonzero(side == 1) if side[i] == 0 else np.zeros(0, int)
        rest = rest[label[rest] != label[i]]
        if rest.size:
            rest = rest[~(bands[rest, :band] == bands[i, :band]).any(1)]
        if rest.size:
            rest = rest[(samples[rest] == samples[i]).sum(1) >= AGREE]
        for j in rest.tolist():
            a, b = root(i), root(j)
            if a == b:
                continue
            x, y = set_of(i), set_of(j)
            if min(x[2], y[2]) < threshold * max(x[2], y[2]):
                continue  # can't be alike
            s = weighted_jaccard(x[:2], y[:2])
            if s >= threshold:
                parent[a] = b
                out.append((rows[i]["v"], rows[j]["v"], s))
    return out


def block_links(members: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """a, b, similarity: links that join components of a bucket.  members: see ``_open_members``;
    texts: v, bands, samples, text."""
    spark = members.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = members.join(texts, "v").select("bucket", "lo", "hi", "side", "v", "label", "bands", "samples", "text").repartition(n, "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    ship_package(spark)
    bounded_batches(spark)

    def run(batches):
        of, table_ = Shingles(), idf.value
        key, held = None, []

        def links():
            found = _block_links(held, of, table_, threshold) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "similarity"])

        for batch in batches:
            for row in batch.to_pylist():
                now = row["bucket"], row["lo"], row["hi"]
                if now != key:
                    yield links()
                    key, held = now, []
                held.append(row)
        yield links()
        held.clear()
        del of
        give_back()

    return dealt.mapInArrow(run, "a long, b long, similarity double")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``df``: key, digest (of the text), class_id, class_key (long; tells classes apart) and class_rows."""
    spark, begun = df.sparkSession, marker()
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).alias("k"), F.unhex(F.md5(body)).alias("digest"), body.alias("text"))
    counts, n = document_frequencies(rows)
    idf = spark.sparkContext.broadcast(idf_table(counts, n))
    seen = written(signatures(rows, idf), "samples")
    # ids that stand with several texts name a class only if no other id can
    h = F.xxhash64("digest")
    shared = written(seen.filter("k is not null").groupBy("k").agg(F.min(h).alias("a"), F.max(h).alias("b")).filter("a != b").select("k"), "shared-ids")
    known = seen.withColumn("clear", F.col("k"))
    if not shared.isEmpty():
        known = seen.join(shared.withColumn("clear", F.lit(True)), "k", "left").withColumn("clear", F.when(F.col("clear").isNull(), F.col("k")))
    texts = written(known.groupBy("digest").agg(F.min("clear").alias("clear"), F.min("k").alias("k"), F.count("*").alias("rows"), F.first("bands").alias("bands"), F.first("samples").alias("samples")).withColumn("v", F.monotonically_increasing_id()), "texts")
    keyed = texts.select("v", F.explode("bands").alias("bucket"))
    met = written(keyed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("v").alias("pivot")).filter("n > 1"), "met")
    buckets = written(spread_join(keyed, met, "bucket", met), "buckets")
    found = texts.join(buckets.select("v").distinct(), "v", "left_semi").select("v", "digest", "bands", "samples")
    near = maybe_among(found, "digest")
    # one row of each text, chosen before anything moves
    one = rows.filter(near(F.col("digest"))).groupBy("digest").agg(F.first("text").alias("text"))
    bodies = written(found.join(one, "digest").drop("digest"), "bodies")
    samples = bodies.select("v", "samples")
    pairs = written(buckets.filter("v != pivot").groupBy(F.col("pivot").alias("a"), F.col("v").alias("b")).agg(F.max("n").alias("n")), "pairs")
    both = spread_join(pairs, samples.select(F.col("v").alias("a"), F.col("samples").alias("sa")), "a").join(samples.select(F.col("v").alias("b"), F.col("samples").alias("sb")), "b")
    likely = written(both.filter(_agreeing(F.col("sa"), F.col("sb")) >= AGREE).select("a", "b", "n"), "likely")
    links = written(verified(likely, bodies.select("v", "text"), idf, threshold), "links")
    labels = components(links)
    more = written(block_links(_open_members(buckets, labels), bodies, idf, threshold), "links")
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    by_text = written(texts.select("digest", "v", "clear", "k", "rows").join(labels, "v", "left").withColumn("class_key", F.coalesce("label", "v")).drop("label", "v"), "labelled")
    names = by_text.groupBy("class_key").agg(F.coalesce(F.min("clear"), F.min("k")).alias("class_id"), F.sum("rows").alias("class_rows"))
    classes = written(spread_join(by_text.select("digest", "rows", "class_key"), names, "class_key"), "classes")
    out = spread_join(seen.select("k", "digest"), classes.drop("rows"), "digest", classes.select("digest", F.col("rows").alias("n")))
    forget(spark, begun, seen, classes)
    return out.select(F.col("k").alias(key), "digest", "class_id", "class_key", "class_rows")


def _tagged(key: str):
    """An id as text; null is none of them."""
    return F.when(F.col(key).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(key).cast("string")))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, with all columns of ``df``: the one whose id names the class (of several such texts that of the
    least digest, of repeated rows any)."""
    spark, begun = df.sparkSession, marker()
    names = [fresh(df, n) for n in ("tag", "digest", "doubtful")]
    tag_, digest_, flag_ = names
    out = written(near_duplicates(df, key, text, threshold).filter("class_rows > 1").withColumn("tag", _tagged(key)), "classes")
    named = out.filter(F.col(key).eqNullSafe(F.col("class_id"))).groupBy("class_key", "tag", "digest").agg(F.count("*").alias("n"))
    keep = written(named.groupBy("class_key").agg(F.min(F.struct("digest", "tag", "n")).alias("x")).select(F.col("x.tag").alias(tag_), F.col("x.digest").alias(digest_), F.col("x.n").alias("n")), "keep")
    # most rows are alone in their class; only the others move
    doubtful = written(out.select("tag", "digest").distinct(), "doubtful")
    among = maybe_among(doubtful, "tag", "digest")
    rows = df.withColumn(tag_, _tagged(key)).withColumn(digest_, F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))).withColumn(flag_, among(F.col(tag_), F.col(digest_)))
    passed, moved = rows.filter(~F.col(flag_)), rows.filter(flag_)
    lost = doubtful.withColumnsRenamed({"tag": tag_, "digest": digest_})
    alone = moved.join(lost, [tag_, digest_], "left_anti")  # the bitmap's false alarms
    once = moved.join(keep.filter("n = 1").drop("n"), [tag_, digest_], "left_semi")
    often = moved.join(keep.filter("n > 1").drop("n"), [tag_, digest_], "left_semi").dropDuplicates([tag_, digest_])
    forget(spark, begun, keep, doubtful)
    return passed.unionByName(alone).unionByName(once).unionByName(often).select(*[f"`{c}`" for c in df.columns])


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("is_kept"))
