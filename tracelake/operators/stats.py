"""Statistics of attributes, variants, cases and times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.keys import ACT, CASE, IDX, START, TS, by_case, first_of, last_of, seconds, traces


def attribute_values(log: DataFrame, column: str, once_per_case: bool = False) -> DataFrame:
    n = F.count_distinct(CASE) if once_per_case else F.count("*")
    return log.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(n.alias("n"))


def start_activities(log: DataFrame) -> DataFrame:
    return log.groupBy(CASE).agg(first_of(ACT).alias("act")).groupBy("act").agg(F.count("*").alias("n"))


def end_activities(log: DataFrame) -> DataFrame:
    return log.groupBy(CASE).agg(last_of(ACT).alias("act")).groupBy("act").agg(F.count("*").alias("n"))


def attribute_presence(log: DataFrame, columns: list[str]) -> DataFrame:
    """column, in_every_case: whether each case has an event with it."""
    per = log.groupBy(CASE).agg(*[F.bool_or(F.col(c).isNotNull()).alias(c) for c in columns])
    row = per.agg(*[F.coalesce(F.bool_and(c), F.lit(True)).alias(c) for c in columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("in_every_case")) for c in columns])).alias("x")).select("x.*")


#: Calendar bins: first and last value.
BINS = {"month": (1, 12), "hour": (0, 23), "days_month": (1, 31), "days_week": (0, 6), "weeks": (0, 53)}


def events_distribution(log: DataFrame, kind: str = "hour") -> DataFrame:
    """bin, n: events by calendar bin; empty bins stay with 0."""
    c = {"month": F.month(TS), "hour": F.hour(TS), "days_month": F.dayofmonth(TS), "days_week": F.weekday(TS), "weeks": F.weekofyear(TS)}[kind]
    lo, hi = BINS[kind]
    bins = log.sparkSession.range(lo, hi + 1).select(F.col("id").alias("bin"))
    counts = log.groupBy(c.cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def stochastic_language(log: DataFrame) -> DataFrame:
    v = traces(log).groupBy("seq").agg(F.count("*").alias("n"))
    total = v.agg(F.sum("n").alias("total"))
    return v.join(F.broadcast(total)).select("seq", (F.col("n") / F.col("total")).alias("p"))


def rework(log: DataFrame) -> DataFrame:
    """act, n: cases in which it occurs more than once."""
    return log.groupBy(CASE, ACT).agg(F.count("*").alias("_n")).filter("_n > 1").groupBy(ACT).agg(F.count("*").alias("n"))


def rework_cases(log: DataFrame) -> DataFrame:
    return log.groupBy(CASE).agg(F.count("*").alias("n_events"), (F.count("*") - F.count_distinct(ACT)).alias("rework"))


def case_description(log: DataFrame) -> DataFrame:
    """First and last event by place, in seconds."""
    x = log.groupBy(CASE).agg(seconds(first_of(TS)).alias("start"), seconds(last_of(TS)).alias("end"), F.count("*").alias("n_events"))
    return x.withColumn("duration", F.col("end") - F.col("start"))


def upper_median_duration(log: DataFrame) -> DataFrame:
    """The element at place floor(n / 2) of the sorted durations, and the one at floor(3 n / 4)."""
    from tracelake.operators.attributes import running

    d = case_description(log)
    n = d.agg(F.count("*").alias("n"))
    places = running(d.groupBy("duration").agg(F.count("*").alias("m")), "duration", "m", "hi")
    at = lambda k: F.min(F.when(F.col("hi") > k, F.col("duration")))
    return places.join(F.broadcast(n)).agg(at(F.floor(F.col("n") / 2)).alias("median"), at(F.floor(3 * F.col("n") / 4)).alias("quartile"))


def arrival_average(log: DataFrame) -> DataFrame:
    """Mean seconds between case starts in order: last minus first over one less than their number."""
    x = log.groupBy(CASE).agg(seconds(first_of(TS)).alias("s"), seconds(last_of(TS)).alias("e"))
    mean = lambda c: (F.max(c) - F.min(c)) / F.nullif(F.count(c) - 1, F.lit(0))
    return x.agg(mean("s").alias("arrival"), mean("e").alias("dispersion"))


def variant_statistics(log: DataFrame) -> DataFrame:
    t = traces(log).join(case_description(log).select(CASE, "duration"), CASE)
    return t.groupBy("seq").agg(F.count("*").alias("n"), F.avg("duration").alias("mean_duration"))


def minimum_self_distances(log: DataFrame) -> DataFrame:
    prev = F.lag(IDX).over(Window.partitionBy(CASE, ACT).orderBy(IDX))
    return log.withColumn("_d", F.col(IDX) - prev - 1).filter("_d is not null").groupBy(ACT).agg(F.min("_d").alias("distance"))


def self_distance_witnesses(log: DataFrame) -> DataFrame:
    """act, witness: what stands between occurrences at the least (positive) distance."""
    prev = F.lag(IDX).over(Window.partitionBy(CASE, ACT).orderBy(IDX))
    near = log.withColumn("_p", prev).filter("_p is not null").select(CASE, ACT, F.col("_p").alias("lo"), F.col(IDX).alias("hi"))
    least = minimum_self_distances(log).filter("distance > 0")
    ends = near.join(F.broadcast(least), ACT).filter(F.col("hi") - F.col("lo") - 1 == F.col("distance")).select(CASE, ACT, F.explode(F.sequence(F.col("lo") + 1, F.col("hi") - 1)).alias(IDX))
    return ends.join(log.select(CASE, IDX, F.col(ACT).alias("witness")), [CASE, IDX]).select(ACT, "witness").distinct()


def activity_positions(log: DataFrame, act: str) -> DataFrame:
    return log.filter(F.col(ACT) == act).groupBy(F.col(IDX).alias("position")).agg(F.count("*").alias("n"))


def service_time(log: DataFrame) -> DataFrame:
    d = seconds(TS) - seconds(START)
    return log.withColumn("_d", d).groupBy(ACT).agg(F.avg("_d").alias("mean"), F.expr("percentile(_d, 0.5)").alias("median"), F.min("_d").alias("min"), F.max("_d").alias("max"), F.sum("_d").alias("sum"), F.coalesce(F.stddev_samp("_d"), F.lit(0.0)).alias("stdev"))


def eventually_follows(log: DataFrame) -> DataFrame:
    """source, target, n: pairs in the order of events, whatever their times.

    Each event counts the earlier ones of every activity of its case by a running count, so work grows with
    events times activities of a case, not with pairs of events.
    """
    # a case's rows stay where its order was made: neither its activities nor the running counts need another shuffle
    acts = F.collect_set(ACT).over(Window.partitionBy(CASE))
    x = log.select(CASE, IDX, F.col(ACT).alias("target"), acts.alias("_acts")).select(CASE, IDX, "target", F.explode("_acts").alias("source"))
    before = Window.partitionBy(CASE, "source").orderBy(IDX).rowsBetween(Window.unboundedPreceding, -1)
    counted = x.withColumn("_n", F.sum((F.col("source") == F.col("target")).cast("long")).over(before)).filter("_n > 0")
    return counted.groupBy("source", "target").agg(F.sum("_n").alias("n"))


def partial_order_pairs(log: DataFrame) -> DataFrame:
    """Pairs of a case in which the first completes before (or when) the second starts."""
    a = log.select(CASE, F.col(IDX).alias("i"), F.col(ACT).alias("source"), F.col(TS).alias("_e"), F.col(START).alias("_as"))
    b = log.select(CASE, F.col(IDX).alias("j"), F.col(ACT).alias("target"), F.col(START).alias("_s"))
    earlier = (F.col("_as") < F.col("_s")) | ((F.col("_as") == F.col("_s")) & (F.col("i") < F.col("j")))
    return a.join(b, CASE).filter((F.col("i") != F.col("j")) & (F.col("_e") <= F.col("_s")) & earlier).withColumn("seconds", seconds("_s") - seconds("_e")).drop("_e", "_s", "_as")


def concurrent_pairs(log: DataFrame, strict: bool = True) -> DataFrame:
    """act_a <= act_b, n: pairs of a case's events whose intervals overlap."""
    a = log.select(CASE, F.col(IDX).alias("i"), F.col(ACT).alias("x"), F.col(START).alias("s1"), F.col(TS).alias("e1"))
    b = log.select(CASE, F.col(IDX).alias("j"), F.col(ACT).alias("y"), F.col(START).alias("s2"), F.col(TS).alias("e2"))
    lo, hi = F.greatest("s1", "s2"), F.least("e1", "e2")
    pairs = a.join(b, CASE).filter((F.col("i") < F.col("j")) & (lo < hi if strict else lo <= hi))
    return pairs.groupBy(F.least("x", "y").alias("act_a"), F.greatest("x", "y").alias("act_b")).agg(F.count("*").alias("n"))


def cycle_time(log: DataFrame) -> DataFrame:
    """Lengths of merged intervals of the whole log but the last one's, over the number of cases.

    Intervals merge inside ranges of their starts.  A range then knows by the greatest end of the ranges before it (one row a
    range) how far it is covered already; what is covered anew has the same length as the merged whole, and the last merged interval
    begins where the last uncovered start is.
    """
    from tracelake.operators.attributes import ranged

    # microseconds, so that sums are exact and a log of one merged interval has 0
    parts = ranged(log.select(F.unix_micros(START).alias("s"), F.unix_micros(TS).alias("e")).distinct(), "s")
    reach = parts.groupBy("_part").agg(F.max("e").alias("_top"))
    upto = reach.withColumn("_upto", F.max("_top").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).drop("_top")
    before = F.max("e").over(Window.partitionBy("_part").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1))
    x = parts.withColumn("_in", before).join(F.broadcast(upto), "_part").withColumn("_b", F.greatest("_in", "_upto"))
    x = x.withColumn("_new", F.greatest(F.col("e") - F.greatest(F.col("s"), F.coalesce("_b", F.col("s"))), F.lit(0))).withColumn("_opens", F.col("_b").isNull() | (F.col("s") > F.col("_b")))
    whole = x.agg(F.sum("_new").alias("all"), F.max("e").alias("end"), F.max(F.when(F.col("_opens"), F.col("s"))).alias("begin"))
    n = log.agg(F.count_distinct(CASE).alias("n"))
    return whole.join(F.broadcast(n)).select(((F.col("all") - (F.col("end") - F.col("begin"))) / F.lit(1_000_000.0) / F.col("n")).alias("cycle_time"))


def passed_time(log: DataFrame, act: str) -> DataFrame:
    """Mean seconds (negative ones as 0) before and after an activity along direct successions."""
    w = by_case()
    x = log.select(ACT, F.lead(ACT).over(w).alias("_n"), F.greatest(seconds(F.lead(TS).over(w)) - seconds(TS), F.lit(0.0)).alias("_d")).filter("_n is not null")
    return x.agg(F.avg(F.when(F.col("_n") == act, F.col("_d"))).alias("pre"), F.avg(F.when(F.col(ACT) == act, F.col("_d"))).alias("post"))


def case_overlap(log: DataFrame) -> DataFrame:
    """case_id, overlap: how many cases' spans meet the case's own (itself too), without pairs of cases."""
    from tracelake.operators.attributes import overlaps

    c = log.groupBy(CASE).agg(F.min(F.unix_micros(TS)).alias("s"), F.max(F.unix_micros(TS)).alias("e"))
    return overlaps(c).select(CASE, "overlap")


def service_waiting_time(log: DataFrame) -> DataFrame:
    """Every event with its case's service, sojourn and waiting seconds."""
    w = Window.partitionBy(CASE)
    x = log.withColumn("service", F.sum(seconds(TS) - seconds(START)).over(w)).withColumn("sojourn", seconds(F.max(TS).over(w)) - seconds(F.min(START).over(w)))
    return x.withColumn("waiting", F.col("sojourn") - F.col("service"))


def entropy(log: DataFrame, start: str = "▶", end: str = "■") -> DataFrame:
    """Sum over activities of the entropies of what follows and of what precedes, in bits."""
    t = traces(log).select(F.concat(F.array(F.lit(start)), "seq", F.array(F.lit(end))).alias("s"))
    pairs = t.select(F.explode(F.zip_with(F.slice("s", F.lit(1), F.size("s") - 1), F.slice("s", F.lit(2), F.size("s") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))

    def one(key: str) -> DataFrame:
        total = pairs.groupBy(key).agg(F.sum("n").alias("m"))
        p = F.col("n") / F.col("m")
        return pairs.join(total, key).agg((-F.sum(p * F.log2(p))).alias("h"))

    return one("a").withColumnRenamed("h", "follows").join(one("b").withColumnRenamed("h", "precedes")).select((F.col("follows") + F.col("precedes")).alias("entropy"))


def kde(log: DataFrame, column: str, points: int = 50) -> DataFrame:
    """x, density: Gaussian kernels of Scott's width on an even grid; values are counted first, so
    the product is of grid points and distinct values."""
    v = log.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    s = v.agg(F.count("*").alias("n"), F.stddev_samp("v").alias("sd"), F.min("v").alias("lo"), F.max("v").alias("hi")).withColumn("h", F.col("sd") * F.pow(F.col("n"), F.lit(-0.2)))
    grid = log.sparkSession.range(points).join(F.broadcast(s)).withColumn("x", F.col("lo") + F.col("id") * (F.col("hi") - F.col("lo")) / (points - 1)).select("x", "h", "n")
    z = (F.col("x") - F.col("v")) / F.col("h")
    counted = v.groupBy("v").agg(F.count("*").alias("m"))
    return counted.join(F.broadcast(grid)).groupBy("x", "h", "n").agg(F.sum(F.col("m") * F.exp(-0.5 * z * z)).alias("k")).select("x", (F.col("k") / (F.col("n") * F.col("h") * F.sqrt(2 * F.pi()))).alias("density"))
