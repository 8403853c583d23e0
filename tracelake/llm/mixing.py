"""Operator 8, mixing sources to target weights by soft membership.

Domains are the classes of the labelled rows: quality (junk, good) by language, the
``LANGUAGES`` most frequent languages apart and the rest together.  A classifier
trained on them (pooled word vectors and two dense layers, calibrated) gives every
document, labelled or not, a posterior over the domains; it never sees the language column.  Document
rates r >= 0 are then fitted so that the expected tokens of each domain,
``sum_d r_d n_d p_dk``, match the target totals: projected-gradient least
squares from r = 1, preconditioned by the domains' Gram matrix.  A step needs
only one sum over all documents with as many numbers as domains; a document's
rate is the fold of the steps' vectors over its own posterior, so no rates are
collected or shuffled.

A rate becomes copies by ``floor(rate + u)`` with u from a hash of the id, so the
expected copies are the rate.

Defined cases: null and empty texts have no tokens, the network's posterior of the zero document and
a rate like any other; a domain without expected tokens has the target 0;
without labels all domains share evenly; no rows give no rows;
repeated rows get the same rate and copies; a null id draws as any other value; texts of any length are read whole;
extra columns come along untouched, whatever their names.  The fit returns how far its totals stay from the targets
(``Fit.residual``, as a share of all tokens): targets out of reach are not hidden.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table, written
from .quality import PooledModel, posteriors, train

LANGUAGES = 6
#: Share of all tokens that good documents are to have, and the power that flattens the languages' shares.
GOOD_SHARE, FLATTEN = 0.93, 0.7
STEPS, CLOSE = 40, 1e-7


class Domains:
    """The languages apart, and the classifier over quality by language (junk first)."""

    def __init__(self, languages: list[str], model: PooledModel):
        self.model = model
        self.names = [f"{q}_{x}" for q in ("junk", "good") for x in languages]


def train_domains(docs: DataFrame, labels: DataFrame) -> Domains:
    """docs: doc_id, text, lang; labels: doc_id, quality.  Rows without a mark are left out."""
    marked = labels.filter("quality is not null").select("doc_id", F.col("quality").cast("int").alias("quality")).join(docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang")), "doc_id")
    often = marked.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES + 1).collect()
    languages = sorted(r["lang"] for r in often[:LANGUAGES])
    places = {v: i for i, v in enumerate(languages)}
    place = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in places.items() for x in kv]), F.col("lang")), F.lit(len(languages))) if languages else F.lit(0)
    if len(often) > LANGUAGES or not languages:  # the rest together
        languages.append("other")
    rows = marked.select("doc_id", (F.col("quality") * len(languages) + place).cast("int").alias("label"))
    return Domains(languages, train(docs, rows, classes=2 * len(languages)))


def target_totals(now: np.ndarray) -> np.ndarray:
    """Targets: all tokens of now, shared out by quality and flattened language shares."""
    by = now.reshape(2, -1)
    flat = by.sum(0) ** FLATTEN
    flat = flat / max(flat.sum(), 1e-12)
    return (now.sum() * np.array([1 - GOOD_SHARE, GOOD_SHARE])[:, None] * flat[None, :]).ravel()


class Fit(list):
    """The steps whose fold gives the rates, the greatest rate allowed, and what is left of the targets."""

    most: float | None = None
    residual: float = 0.0


def rate(p: Column, steps: list[list[float]]) -> Column:
    """A document's rate: 1, then r - p . step for each step, held at 0 or more and at the fit's greatest rate or less."""
    moves = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps]) if steps else F.array().cast("array<array<double>>")
    along = lambda s: F.aggregate(F.zip_with(p, s, lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
    most = getattr(steps, "most", None)
    held = (lambda x: x) if most is None else (lambda x: F.least(F.lit(float(most)), x))
    return F.aggregate(moves, F.lit(1.0), lambda r, s: held(F.greatest(F.lit(0.0), r - along(s))))


def domain_totals(rows: DataFrame, steps: list[list[float]], k: int, n: str = "n_tokens", p: str = "p") -> np.ndarray:
    """Expected tokens of each domain at the rates of ``steps``: one row reaches the driver."""
    r = rows.select(F.col(n).alias("n"), F.col(p).alias("p"), rate(F.col(p), steps).alias("r"))
    got = r.agg(*[F.sum(F.col("r") * F.col("n") * F.col("p")[i]).alias(f"t{i}") for i in range(k)]).first()
    return np.array([got[f"t{i}"] or 0.0 for i in range(k)])


def gram(rows: DataFrame, k: int, n: str = "n_tokens", p: str = "p") -> np.ndarray:
    got = rows.agg(*[F.sum(F.col(n) * F.col(p)[i] * F.col(p)[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    return np.array([[got[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])


def fit_rates(rows: DataFrame, targets: np.ndarray, n: str = "n_tokens", p: str = "p", steps: int = STEPS, most: float | None = None) -> Fit:
    """The steps whose fold gives the rates.  Each is one distributed sum; they end when the targets are met
    or a step changes nothing any more."""
    k = len(targets)
    whole = max(1.0, float(np.sum(targets)))
    inverse = np.linalg.pinv(gram(rows, k, n, p) / whole, rcond=1e-9) / whole
    done, before = Fit(), None
    done.most = most
    while True:
        off = domain_totals(rows, done, k, n, p) - targets
        done.residual = float(np.abs(off).sum() / whole)
        still = before is not None and np.abs(off - before).sum() <= CLOSE * whole
        if done.residual <= CLOSE or still or len(done) == steps:
            return done
        before = off
        done.append([float(f"{x:.10g}") for x in inverse @ off])  # rounded: sums differ in their last digits between runs


def copies(r: Column, key: str, seed: int = 23) -> Column:
    """Whole copies whose expectation is the rate."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return F.floor(r + u).cast("int")


def mix(df: DataFrame, domains: Domains, factors: tuple[float, float] | None = None, repeat: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` as often as their copies say, with the same columns.

    ``factors`` gives the targets of junk and of good domains as multiples of their tokens in ``df``; ``target_totals`` holds otherwise.
    Without ``repeat`` a rate is 1 at most, so a document stays once or goes.
    """
    k = len(domains.names)
    n, p, c = fresh(df, "n_tokens"), fresh(df, "p"), fresh(df, "copies")
    rows = written(posteriors(df, domains.model, tuple(df.columns), text, n, p), "posteriors")  # the network runs once
    now = domain_totals(rows, [], k, n, p)
    steps = fit_rates(rows, target_totals(now) if factors is None else now * np.repeat(factors, k // 2), n, p, most=None if repeat else 1.0)
    out = rows.withColumn(c, copies(rate(F.col(p), steps), key)).filter(F.col(c) > 0)
    if repeat:
        out = out.withColumn(c, F.explode(F.sequence(F.lit(1), F.col(c))))
    return out.select(*[f"`{x}`" for x in df.columns])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior (in the order of ``Domains.names``), rate and copies of every document."""
    docs = table(spark, sf_dir, "documents")
    domains = train_domains(docs, table(spark, sf_dir, "labels"))
    rows = written(posteriors(docs, domains.model), "posteriors")
    steps = fit_rates(rows, target_totals(domain_totals(rows, [], len(domains.names))))
    out = rows.withColumn("rate", rate(F.col("p"), steps))
    return out.select("doc_id", "n_tokens", F.lit(",".join(domains.names)).alias("domains"), F.col("p").alias("posterior"), "rate", copies(F.col("rate"), "doc_id").alias("copies"), F.lit(steps.residual).alias("residual"))
