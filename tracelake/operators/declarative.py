"""Conformance with declarative rules, log skeletons and footprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.keys import ACT, CASE, IDX, by_case
from tracelake.operators import core, discovery, miners, stats
from tracelake.operators.conformance import _per_variant

UNARY = ("existence", "absence", "exactly_one", "init")


def declare_conformance(log: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """case-weighted variants (seq, n) with broken rules (texts), their number and the fitness.

    rules: (rule, a, b), b empty for rules of one activity.  A rule that doesn't apply to a trace holds there.
    """
    for rule, a, b in rules:
        if (rule in UNARY) != (b == ""):
            raise ValueError(f"{rule} takes {'one activity' if rule in UNARY else 'two activities'}: {a!r}, {b!r}")
    acts = sorted({x for _, a, b in rules for x in (a, b) if x})

    def check(v):
        scores = miners.rule_scores(v, acts)
        broken = [f"{r}({a}{', ' + b if b else ''})" for r, a, b in rules if scores.get((r, a, b), 0) < 0]
        return broken, len(broken), 1 - len(broken) / len(rules) if rules else 1.0

    return _per_variant(log, check, "broken array<string>, deviations long, fitness double", ["broken", "deviations", "fitness"])


def activity_frequencies(log: DataFrame) -> DataFrame:
    """act, counts array<long>: how often an activity occurs in a case, 0 among them where a case lacks it."""
    per = log.groupBy(CASE, ACT).agg(F.count("*").alias("k"))
    cases = log.agg(F.count_distinct(CASE).alias("all"))
    by = per.groupBy(ACT).agg(F.collect_set("k").alias("c"), F.count("*").alias("n"))
    return by.join(F.broadcast(cases)).select(ACT, F.array_sort(F.when(F.col("n") < F.col("all"), F.array_union("c", F.array(F.lit(0).cast("long")))).otherwise(F.col("c"))).alias("counts"))


def skeleton_conformance(log: DataFrame, relations: DataFrame, frequencies: DataFrame) -> DataFrame:
    """case_id, deviations, constraints, fitness against a skeleton: relations (relation, source, target) and frequencies (act, counts).

    A pair applies to a case that has its source; every activity of a case, and every one the model always wants, applies
    to the frequencies.
    """
    c = log.groupBy(CASE, ACT).agg(F.count("*").alias("n"), F.min(IDX).alias("lo"), F.max(IDX).alias("hi"))
    next_ = log.select(CASE, F.col(ACT).alias("source"), F.lead(ACT).over(by_case()).alias("target")).filter("target is not null").distinct().withColumn("next", F.lit(True))
    x = c.withColumnRenamed(ACT, "source").join(F.broadcast(relations), "source")
    x = x.join(c.select(CASE, F.col(ACT).alias("target"), F.col("n").alias("n2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2")), [CASE, "target"], "left").join(next_, [CASE, "source", "target"], "left")
    there, other = F.col("n2").isNotNull(), F.col("source") != F.col("target")
    holds = F.when(F.col("relation") == "equivalence", other & there & (F.col("n") == F.col("n2"))).when(F.col("relation") == "always_after", there & (F.col("lo") < F.col("hi2"))).when(F.col("relation") == "always_before", there & (F.col("lo2") < F.col("hi"))).when(F.col("relation") == "never_together", ~(other & there)).otherwise(F.col("next").isNotNull())
    pairs = x.select(CASE, F.when(F.coalesce(holds, F.lit(False)), 0).otherwise(1).alias("off"))
    counted = c.join(F.broadcast(frequencies), ACT, "left").select(CASE, F.when(F.coalesce(F.array_contains("counts", F.col("n")), F.lit(False)), 0).otherwise(1).alias("off"))
    wanted = frequencies.filter("counts[0] > 0").select(ACT)
    lacking = c.select(CASE).distinct().join(F.broadcast(wanted)).join(c.select(CASE, ACT), [CASE, ACT], "left_anti").select(CASE, F.lit(1).alias("off"))
    got = pairs.union(counted).union(lacking).groupBy(CASE).agg(F.sum("off").alias("deviations"), F.count("*").alias("constraints"))
    return got.withColumn("fitness", 1 - F.col("deviations") / F.col("constraints"))


def footprints_fitness(log: DataFrame, model) -> DataFrame:
    """One row, fitness: deviating edges by their counts against the pairs, wrong starts and ends against those of the log."""
    edges = discovery.dfg(log)
    spark = log.sparkSession
    pairs = spark.createDataFrame(sorted(set(model.sequence) | set(model.parallel)) or [(None, None)], "source string, target string").dropna()
    off = discovery.footprint_deviations(edges, pairs).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("off"))
    whole = edges.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.count("*").alias("pairs"))
    ends = stats.start_activities(log).select(F.lit("start").alias("side"), ACT).union(stats.end_activities(log).select(F.lit("end"), ACT))
    ok = F.when(F.col("side") == "start", F.col(ACT).isin(sorted(model.start))).otherwise(F.col(ACT).isin(sorted(model.end)))
    bound = ends.agg(F.count("*").alias("bounds"), F.count_if(ok).alias("right"))
    x = whole.join(F.broadcast(off)).join(F.broadcast(bound))
    return x.select(F.when(F.col("pairs") == 0, 1.0).otherwise(((1 - F.col("off") / F.col("all")) * F.col("pairs") + F.col("right")) / (F.col("pairs") + F.col("bounds"))).alias("fitness"))


def trace_footprints_fitness(log: DataFrame, model) -> DataFrame:
    """share_fitting, mean_fitness over cases, each checked on its own."""
    pairs = set(model.sequence) | set(model.parallel)

    def check(v):
        own = set(zip(v, v[1:], strict=False))
        ends = (v[0] not in model.start) + (v[-1] not in model.end) if v else 0
        off, size = len(own - pairs) + ends, len(own) + (2 if v else 0)
        missing = len(set(model.always) - set(v))
        return off + missing == 0 and len(v) >= model.shortest, 1 - off / size if size else 1.0

    v = _per_variant(log, check, "fits boolean, fitness double", ["fits", "fitness"])
    return v.agg((F.sum(F.when(F.col("fits"), F.col("n")).otherwise(0)) / F.sum("n")).alias("share_fitting"), (F.sum(F.col("fitness") * F.col("n")) / F.sum("n")).alias("mean_fitness"))


def play_out_declare(rules: list[tuple[str, str, str]], acts: list[str], n: int = 100, longest: int = 12, seed: int = 0) -> list[tuple[str, ...]]:
    """Random traces: every step is an even choice of the activities after which no rule is broken for good; a trace
    ends early where there is none."""
    import numpy as np

    final = {"init", "absence", "exactly_one", "precedence", "alternate_precedence", "chain_precedence", "non_responded_existence"}

    def safe(t: tuple[str, ...]) -> bool:
        scores = miners.rule_scores(t, acts)
        for rule, a, b in rules:
            if rule in final and rule != "exactly_one" and scores.get((rule, a, b), 0) < 0:
                return False
            if rule == "exactly_one" and t.count(a) > 1:
                return False
            if rule == "chain_response" and len(t) > 1 and t[-2] == a and t[-1] != b:
                return False
            if rule == "alternate_response" and t and t[-1] == a and a in t[:-1] and b not in t[len(t) - 1 - t[-2::-1].index(a) :]:
                return False
        return True

    out = []
    for k in range(n):
        g, t = np.random.default_rng([seed, k]), ()
        for _ in range(int(g.integers(1, longest + 1))):
            options = [a for a in acts if safe((*t, a))]
            if not options:
                break
            t = (*t, options[int(g.integers(len(options)))])
        out.append(t)
    return out


def replay_prefixes(log: DataFrame) -> DataFrame:
    """prefix, n: distinct prefixes of the log with how many cases go through each."""
    v = core.variants(log)
    steps = v.select("seq", "n", F.explode(F.sequence(F.lit(1), F.size("seq"))).alias("k"))
    return steps.groupBy(F.slice("seq", F.lit(1), F.col("k")).alias("prefix")).agg(F.sum("n").alias("n"))
