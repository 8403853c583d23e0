"""Attributes, variants and times beyond plain counts: presence, cutoffs, densities, segments, following events, overlaps, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.functions.keys import ACT, CASE, IDX, START, TS, first_of, last_of, seconds, traces

#: Columns that are no attributes, and the prefix of attributes of the whole case.
PLACES, OF_CASE, LIFECYCLE = (CASE, IDX), "case_", "lifecycle"


def event_attributes(log: DataFrame) -> list[str]:
    """Names of event attributes, without the lifecycle."""
    return sorted(c for c in log.columns if c not in PLACES and not c.startswith(OF_CASE) and c != LIFECYCLE)


def trace_attributes(log: DataFrame) -> list[str]:
    """Names of case attributes, without the id."""
    return sorted(c for c in log.columns if c.startswith(OF_CASE) and c != CASE)


def threshold(counts: list[int], factor: float, least: int = 1, most: int | None = None) -> int:
    """The count at which descending counts fall off: the last that is over ``factor`` times the one kept before.

    Counting begins at place ``least`` and looks at places up to ``most``, that one included.
    """
    at = max(0, min(least - 1, len(counts) - 1))
    kept = counts[at]
    for i in range(at + 1, len(counts)):
        if counts[i] > kept * factor:
            kept = counts[i]
        if most is not None and i >= most:
            break
    return kept


def in_every_case(log: DataFrame, column: str) -> bool:
    """Whether each case has an event with the attribute."""
    return not log.groupBy(CASE).agg(F.bool_or(F.col(column).isNotNull()).alias("there")).filter("not there").limit(1).count()


def present_in_every_case(log: DataFrame, columns: list[str]) -> list[str]:
    """Those of the attributes that each case has, in one pass."""
    per = log.groupBy(CASE).agg(*[F.bool_or(F.col(c).isNotNull()).alias(c) for c in columns])
    row = per.agg(*[F.coalesce(F.bool_and(c), F.lit(True)).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def select_for_tree(log: DataFrame, cases: int = 50, most: int = 50) -> dict[str, list[str]]:
    """Attributes that a decision tree can use: text_case, text_event, number_case, number_event.

    Candidates have a value in one of the first ``cases`` cases (by id); texts must have fewer than ``most`` values in the
    whole log, case attributes and numbers must be there in every case.
    """
    first = log.join(log.select(CASE).distinct().orderBy(CASE).limit(cases), CASE, "left_semi")
    names = event_attributes(log) + trace_attributes(log)
    kinds = {f.name: "text" if isinstance(f.dataType, T.StringType) else "number" for f in log.schema if isinstance(f.dataType, (T.StringType, T.NumericType))}
    names = [c for c in names if c in kinds]
    if not names:
        return {f"{k}_{w}": [] for k in ("text", "number") for w in ("case", "event")}
    seen = first.agg(*[F.count(c).alias(c) for c in names]).first()
    names = [c for c in names if seen[c]]
    texts = [c for c in names if kinds[c] == "text"]
    # at most ``most`` values of a column stay in its buffer: more than that are as many as needed
    few = {c for c in texts if log.select(c).filter(F.col(c).isNotNull()).distinct().limit(most).count() < most}
    always = set(present_in_every_case(log, names)) if names else set()
    out: dict[str, list[str]] = {f"{k}_{w}": [] for k in ("text", "number") for w in ("case", "event")}
    for c in names:
        where = "case" if c.startswith(OF_CASE) else "event"
        if (kinds[c] == "number" or c in few) and (c in always or (kinds[c] == "text" and where == "event")):
            out[f"{kinds[c]}_{where}"].append(c)
    return out


def profile_attributes(log: DataFrame, bound: float = 12.5) -> dict[str, list[str]]:
    """Attributes of every case: texts with fewer than ``bound`` values, and numbers."""
    kinds = {f.name: f.dataType for f in log.schema}
    names = [c for c in event_attributes(log) if isinstance(kinds[c], (T.StringType, T.NumericType))]
    always = present_in_every_case(log, names) if names else []
    most = int(bound) + 1
    few = lambda c: log.select(c).filter(F.col(c).isNotNull()).distinct().limit(most).count() < bound
    return {"text": [c for c in always if isinstance(kinds[c], T.StringType) and few(c)], "number": [c for c in always if not isinstance(kinds[c], T.StringType)]}


def activity_labels(log: DataFrame) -> DataFrame:
    return log.select(ACT).distinct()


# --- densities


def density(values: DataFrame, grid: Column) -> DataFrame:
    """x, density of values (v) by Gaussian kernels of Scott's width at the points that ``grid`` makes of lo and hi.

    Values are counted first; the product is of distinct values and grid points.
    """
    v = values.filter(F.col("v").isNotNull()).select(F.col("v").cast("double").alias("v"))
    s = v.agg(F.count("*").alias("n"), F.stddev_samp("v").alias("sd"), F.min("v").alias("lo"), F.max("v").alias("hi")).withColumn("h", F.col("sd") * F.pow(F.col("n"), F.lit(-0.2)))
    points = s.select(F.explode(F.array_distinct(grid)).alias("x"), "h", "n")
    z = (F.col("x") - F.col("v")) / F.col("h")
    sums = v.groupBy("v").agg(F.count("*").alias("m")).join(F.broadcast(points)).groupBy("x", "h", "n").agg(F.sum(F.col("m") * F.exp(-0.5 * z * z)).alias("k"))
    return sums.select("x", (F.col("k") / (F.col("n") * F.col("h") * F.sqrt(2 * F.pi()))).alias("density"))


def even_grid(points: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("lo") + i * (F.col("hi") - F.col("lo")) / (points - 1))


def duration_grid(points: int) -> Column:
    """Half of the points even, half geometric (from a millionth at least); a point may come twice."""
    low = F.greatest(F.col("lo"), F.lit(1e-6))
    half = points // 2
    geometric = F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda i: low * F.pow(F.col("hi") / low, i / (half - 1)))
    return F.concat(even_grid(half), geometric)


def date_density(log: DataFrame, column: str = TS, points: int = 50) -> DataFrame:
    """x (seconds since the epoch), density of a time attribute."""
    return density(log.select(seconds(column).alias("v")), even_grid(points))


def duration_density(log: DataFrame, points: int = 50) -> DataFrame:
    """x (seconds), density of case durations; points that the two halves share are one row."""
    d = log.groupBy(CASE).agg((seconds(last_of(TS)) - seconds(first_of(TS))).alias("v"))
    return density(d, duration_grid(points))


# --- variants


def variant_cases(log: DataFrame) -> DataFrame:
    """seq, case_id: the cases of each variant, as rows, so that a frequent variant is no single value."""
    return traces(log).select("seq", CASE)


def split_by_variant(log: DataFrame) -> DataFrame:
    """All events with their case's variant (an array); write it partitioned to have a log each."""
    return log.join(traces(log).withColumnRenamed("seq", "variant"), CASE)


def variants_with_durations(log: DataFrame) -> DataFrame:
    """case_id, seq, duration."""
    return traces(log).join(log.groupBy(CASE).agg((seconds(last_of(TS)) - seconds(first_of(TS))).alias("duration")), CASE)


def frequent_segments(log: DataFrame, least: int, longest: int = 64) -> DataFrame:
    """segment (activities with ... around and between), n: subsequences of at least so many cases."""
    from pyspark.ml.fpm import PrefixSpan

    t = traces(log).select(F.transform("seq", lambda a: F.array(a)).alias("sequence"))
    n = t.count()
    if not n:
        return log.sparkSession.createDataFrame([], "segment string, n long")
    found = PrefixSpan(minSupport=min(1.0, (least - 0.5) / n), maxPatternLength=longest, maxLocalProjDBSize=32_000_000).findFrequentSequentialPatterns(t)
    dots = F.concat(F.lit("...>"), F.array_join(F.transform("sequence", lambda a: a[0]), ">...>"), F.lit(">..."))
    return found.filter(F.col("freq") >= least).select(dots.alias("segment"), F.col("freq").alias("n"))


def first_following(log: DataFrame, start: str = TS) -> DataFrame:
    """case_id, i, source, begin, j, target, end: each event and the first later one of its case that starts no earlier
    than it completes.

    Mostly that is the very next event; only events whose next one overlaps are joined with the rest of their case.
    """
    w = Window.partitionBy(CASE).orderBy(IDX)
    x = log.select(CASE, F.col(IDX).alias("i"), F.col(ACT).alias("source"), seconds(TS).alias("begin"), F.lead(IDX).over(w).alias("j"), F.lead(ACT).over(w).alias("target"), F.lead(seconds(start)).over(w).alias("end"))
    x = x.filter("j is not null")
    plain = x.filter(F.col("end") >= F.col("begin"))
    late = x.filter(F.col("end") < F.col("begin")).select(CASE, "i", "source", "begin")
    rest = log.select(CASE, F.col(IDX).alias("j"), F.col(ACT).alias("target"), seconds(start).alias("end"))
    near = late.join(rest, CASE).filter("j > i and end >= begin").groupBy(CASE, "i", "source", "begin").agg(F.min(F.struct("j", "target", "end")).alias("x"))
    return plain.unionByName(near.select(CASE, "i", "source", "begin", "x.j", "x.target", "x.end"))


def time_intervals(log: DataFrame, start: str = TS, couple: tuple[str, str] | None = None) -> DataFrame:
    """case_id, i, j, begin, end of ``first_following``; of one pair of activities, if given."""
    x = first_following(log, start)
    if couple:
        x = x.filter((F.col("source") == couple[0]) & (F.col("target") == couple[1]))
    return x.select(CASE, "i", "j", "begin", "end")


def paths_durations(log: DataFrame, start: str = TS) -> DataFrame:
    """seq, n, position, occurrence, mean, median, min, max, sum: seconds to the following event at each place of a variant.

    ``occurrence`` is the least number of earlier pairs of the same activities in a case.
    """
    x = first_following(log, start).withColumn("d", F.col("end") - F.col("begin"))
    x = x.withColumn("occurrence", F.row_number().over(Window.partitionBy(CASE, "source", "target").orderBy("i")) - 1)
    t = traces(log)
    n = t.groupBy("seq").agg(F.count("*").alias("n"))
    got = x.join(t, CASE).groupBy("seq", F.col("i").alias("position")).agg(
        F.min("occurrence").cast("long").alias("occurrence"), F.avg("d").alias("mean"), F.expr("percentile(d, 0.5)").alias("median"), F.min("d").alias("min"), F.max("d").alias("max"), F.sum("d").alias("sum")
    )
    return got.join(n, "seq")


# --- order over the whole log, without a task that sees it all


def ranged(x: DataFrame, key: str) -> DataFrame:
    """x with ``_part``, the number of the key's range: as many ranges as partitions, cut at approximate quantiles."""
    from pyspark.ml.feature import Bucketizer

    n = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    cuts = sorted(set(x.select(F.col(key).cast("double").alias("k")).approxQuantile("k", [i / n for i in range(1, n)], 0.25 / n))) if n > 1 else []
    if not cuts:
        return x.withColumn("_part", F.lit(0))
    put = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="_k", outputCol="_b")
    return put.transform(x.withColumn("_k", F.col(key).cast("double"))).withColumn("_part", F.col("_b").cast("int")).drop("_k", "_b")


def running(x: DataFrame, key: str, value: str, name: str, order: tuple[str, ...] = ()) -> DataFrame:
    """x with ``name``, the sum of ``value`` up to and with each row in the order of the key (and ``order``, at ties).

    Ranges of the key are summed apart, their totals are summed over the ranges, and both are added.
    """
    parts = ranged(x, key)
    inside = F.sum(value).over(Window.partitionBy("_part").orderBy(key, *order))
    whole = parts.groupBy("_part").agg(F.sum(value).alias("_all"))
    before = whole.withColumn("_before", F.coalesce(F.sum("_all").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_all")
    return parts.withColumn("_in", inside).join(F.broadcast(before), "_part").withColumn(name, F.col("_in") + F.col("_before")).drop("_part", "_in", "_before")


def overlaps(spans: DataFrame, epsilon: int = 10) -> DataFrame:
    """spans (s, e in microseconds) with ``overlap``: how many spans, widened by ``epsilon`` at both ends, meet each one, itself included.

    Starts before its end less ends up to its start, both as running counts over distinct times: no pair of spans is made.
    """
    wide = spans.withColumn("_s", F.col("s") - epsilon).withColumn("_e", F.col("e") + epsilon)
    side = lambda c, a, b: F.struct(F.col(c).alias("t"), F.lit(a).alias("starts"), F.lit(b).alias("ends"))
    marks = wide.select(F.explode(F.array(side("_s", 1, 0), side("_e", 0, 1))).alias("m")).groupBy("m.t").agg(F.sum("m.starts").alias("starts"), F.sum("m.ends").alias("ends"))
    counted = running(running(marks, "t", "starts", "started"), "t", "ends", "ended").select("t", (F.col("started") - F.col("starts")).alias("before"), F.col("ended").alias("upto"))
    at = lambda name, c: counted.select(F.col("t").alias(name), c)
    x = wide.join(at("_e", "before"), "_e").join(at("_s", "upto"), "_s")
    return x.withColumn("overlap", F.col("before") - F.col("upto")).drop("_s", "_e", "before", "upto")


def event_overlap(log: DataFrame, start: str = START) -> DataFrame:
    """case_id, idx, overlap: how many events of the whole log meet each event's interval."""
    return overlaps(log.select(CASE, IDX, F.unix_micros(start).alias("s"), F.unix_micros(TS).alias("e"))).select(CASE, IDX, "overlap")


def _gaps(x: DataFrame, key: str, name: str) -> DataFrame:
    """x (case_id, key) with the seconds since the value before it in the order of (key, case_id); 0 for the first."""
    parts = ranged(x, key)
    lasts = parts.groupBy("_part").agg(F.max(key).alias("_last")).withColumn("_last", F.last("_last", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.lag(key).over(Window.partitionBy("_part").orderBy(key, CASE))
    return parts.withColumn("_p", inside).join(F.broadcast(lasts), "_part").withColumn(name, F.coalesce(F.col(key) - F.coalesce("_p", "_last"), F.lit(0.0))).drop("_part", "_p", "_last")


def case_times(log: DataFrame, start: str = TS) -> DataFrame:
    """case_id and its first start, last end, service, sojourn and waiting seconds, and seconds since the preceding case's start and end."""
    c = log.groupBy(CASE).agg(F.min(seconds(start)).alias("first"), F.max(seconds(TS)).alias("last"), F.sum(seconds(TS) - seconds(start)).alias("service"))
    c = _gaps(c, "first", "arrival_rate").join(_gaps(c.select(CASE, "last"), "last", "finish_rate").select(CASE, "finish_rate"), CASE)
    return c.withColumn("sojourn", F.col("last") - F.col("first")).withColumn("waiting", F.col("last") - F.col("first") - F.col("service"))


def arrival_finish_rate(log: DataFrame, start: str = TS) -> DataFrame:
    """All events with their case's arrival_rate and finish_rate."""
    return log.join(case_times(log, start).select(CASE, "arrival_rate", "finish_rate"), CASE)


def outcome_enriched(log: DataFrame, features: DataFrame, start: str = TS) -> DataFrame:
    """All events with their case's times and features (case_id and one column each), and their own length."""
    times = case_times(log, start).drop("first", "last")
    return log.withColumn("diff_start_end", seconds(TS) - seconds(start)).join(times, CASE).join(features, CASE)


def network_durations(log: DataFrame, node: str, edge: str, link: str) -> DataFrame:
    """source, target, edge, n, mean, min, max, sum of the seconds between an event and the next with the same ``link`` value."""
    w = Window.partitionBy(link).orderBy(TS, CASE, IDX)
    x = log.filter(F.col(link).isNotNull()).select(F.col(node).alias("source"), F.lead(node).over(w).alias("target"), F.col(edge).alias("edge"), (F.lead(seconds(TS)).over(w) - seconds(TS)).alias("d")).filter("target is not null")
    return x.groupBy("source", "target", "edge").agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.min("d").alias("min"), F.max("d").alias("max"), F.sum("d").alias("sum"))


# --- drawings' data


def dotted_points(log: DataFrame, x: str = TS, y: str = CASE, colour: str = ACT) -> DataFrame:
    """x, y, colour of every event that has all three."""
    return log.select(F.col(x).alias("x"), F.col(y).alias("y"), F.col(colour).alias("colour")).dropna()


def performance_spectrum(log: DataFrame, activities: list[str], sample: int = 10_000) -> DataFrame:
    """times array<double>: runs of exactly these activities among the events of each case that have one of them, by first time.

    Of more than ``sample`` runs an evenly spaced sample is kept, with the first and the last.
    """
    k = len(activities)
    w = Window.partitionBy(CASE).orderBy(TS, IDX)
    x = log.filter(F.col(ACT).isin(activities)).withColumns({f"_a{i}": F.lead(ACT, i).over(w) for i in range(k)} | {f"_t{i}": F.lead(seconds(TS), i).over(w) for i in range(k)})
    for i, a in enumerate(activities):
        x = x.filter(F.col(f"_a{i}") == a)
    runs = x.select(CASE, IDX, F.array(*[f"_t{i}" for i in range(k)]).alias("times"))
    n = runs.count()
    if n <= sample or sample < 1:
        return runs.select("times")
    wanted = sorted({0, n - 1, *(i * n // sample + n // (2 * sample) for i in range(sample))})
    placed = running(runs.withColumn("first", F.col("times")[0]).withColumn("one", F.lit(1)), "first", "one", "place", ("times", CASE, IDX))
    picks = log.sparkSession.createDataFrame([(i + 1,) for i in wanted], "place long")  # sample + 2 rows at most
    return placed.join(F.broadcast(picks), "place", "left_semi").select("times")
