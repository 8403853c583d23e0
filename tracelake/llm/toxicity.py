"""Operator 3, toxicity: boosted trees over dense features, with isotonic calibration.

Features of a text: densities of two lexicons (a fixed one, and one learned from
labelled rows: whole words and beginnings of words that toxic texts have far oftener), how near a
second-person word stands to a lexicon word, capitals, punctuation, and
obfuscation (letters parted by digits or signs, and lexicon words found only
after undoing that).

Labels come from training rows alone.  A bounded, hash-chosen sample of them is
cut in three by hash: one part finds the learned lexicon, one fits the trees, one
calibrates.  Copies of a text count once, near copies about once (by the least
hash of their word triples), so that one copied text's own words don't become a lexicon.

Defined cases: null and empty texts have all-zero features and the model's score
for those; without training labels of both kinds every score is the share of
label 1 (0 without labels) held under one half; repeated rows are scored each;
extra columns are not read, and a kept column's name never clashes with the score's; a text may have
any length and need not have a space (time grows in proportion); equal raw scores are ordered by nothing but the
isotonic value (a sigmoid of 0.2 % weight parts raw scores within one isotonic step).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Boosted, Isotonic
from .common import crc_mod, fresh, hash_sampled, map_slices, sample_share, table

#: Labelled rows (expected) that the model is fitted on.
TRAIN_ROWS = 24_000
#: Word beginnings that the driver weighs, and the most that the learned lexicon holds.
STEMS, LEXICON = 20_000, 2_000
PREFIXES = (4, 5, 6, 7)
LIFT = 9.0  # how much oftener toxic texts must have a stem

# Insults and second-person words.
INSULTS = frozenset("idiot idiots moron morons stupid dumb dumbass loser losers trash garbage scum scumbag clown pathetic worthless disgusting fool imbecile retard retarded jerk bastard bitch asshole crap shit fuck fucking damn ugly hate kill idiota estúpido imbécil basura asqueroso idioten dumm dummkopf abschaum wertlos widerlich trottel arschloch stupide crétin débile ordure minable dégoûtant".split())
SECOND = frozenset("you your yours yourself yourselves u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen deinem ihr euch euer usted ustedes ti tus vosotros su".split())
LEET = str.maketrans("013457@$!|*", "oieastasiii")
# Tried only where a run begins, and without giving back: a run without a sign or digit is read once, however long.
OBFUSCATED = re.compile(r"(?<![^\W_])[^\W_]++(?:[@$!|*.\-_]++[^\W_]++)++|(?<![^\W\d_])[^\W\d_]++\d++[^\W\d_]++")
WORD = re.compile(r"\w+")
PUNCTUATION = b"!?*%#&$@|.,;:-\"'"
UPPER = bytes(range(65, 91))
ALPHA = UPPER + bytes(range(97, 123)) + bytes(range(128, 256))

FEATURES = 24
FIXED = 1000.0  # what a fixed insult adds to a word's mark


def stems(word: str) -> list[str]:
    """What of a word can enter the learned lexicon: beginnings, and (marked =) the whole word."""
    return [word[:n] for n in PREFIXES if len(word) >= n] + ["=" + word]


class Features:
    """Dense features of a text, given the learned lexicon (stem -> weight)."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.memo: dict[str, float] = {}

    def mark(self, word: str) -> float:
        """The greatest weight of the word's stems, and FIXED more for a fixed insult; 0 for others."""
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) > 150_000:
                self.memo.clear()
            lex = self.lexicon
            got = FIXED * (word in INSULTS) + max((lex[s] for s in stems(word) if s in lex), default=0.0)
            self.memo[word] = got
        return got

    def __call__(self, text: str | None) -> list[float]:
        if not text:
            return [0.0] * FEATURES
        low = text.lower()
        words = WORD.findall(low)
        n = len(words) or 1
        memo = self.memo
        marks = [memo[w] if w in memo else self.mark(w) for w in words]
        fixed = learned = weight = most = 0.0
        hits = []
        if any(marks):
            for i, m in enumerate(marks):
                if m:
                    hits.append(i)
                    if m >= FIXED:
                        fixed += 1
                        m -= FIXED
                    learned += m > 0
                    weight += m
                    most = max(most, m)
        near = close = 0.0
        you = [i for i, w in enumerate(words) if w in SECOND] if hits else []
        if you:
            at, places = np.array(hits), np.array(you)
            after = np.searchsorted(places, at)
            gap = np.minimum(np.abs(at - places[np.maximum(after - 1, 0)]), np.abs(places[np.minimum(after, len(you) - 1)] - at))
            near, close = float((1 / (1 + gap)).max()), float((gap <= 5).mean())
        odd = hidden = 0
        for m in OBFUSCATED.finditer(low):
            odd += 1
            plain = re.sub(r"[^\w]|_", "", m[0].translate(LEET))
            hidden += self.mark(plain) > 0
        raw = text.encode("utf-8", "surrogatepass")
        size = len(raw)
        letters = size - len(raw.translate(None, ALPHA)) or 1
        capitals = size - len(raw.translate(None, UPPER))
        counts = [raw.count(PUNCTUATION[i : i + 1]) for i in range(7)]
        signs = size - len(raw.translate(None, PUNCTUATION))
        return [
            fixed / n, fixed, learned / n, learned, weight, weight / n, most, float(len({words[i] for i in hits})), near, close, odd / n, float(hidden), hidden / n,
            capitals / letters, signs / size, *[c / size for c in counts], np.log1p(n), letters / n,
        ]


class ToxicityModel:
    """Lexicon, trees and calibration; scores are within (0, 1)."""

    def __init__(self, lexicon: dict[str, float], trees: Boosted | None, calibration: Isotonic | None, base: float):
        self.lexicon, self.trees, self.calibration, self.base = lexicon, trees, calibration, base

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.base)
        raw = self.trees.raw(x)
        return np.clip(0.998 * self.calibration(raw) + 0.002 / (1 + np.exp(-np.clip(raw, -30, 30))), 0, 1)


def _sketch(words: list[str]) -> int:
    """Least hash of a text's word triples: mostly alike for near copies."""
    return min((zlib.crc32(" ".join(words[i : i + 3]).encode("utf-8", "surrogatepass")) for i in range(0, max(1, len(words) - 2))), default=0)


def _stem_counts(df: DataFrame, wanted: frozenset[str] | None) -> DataFrame:
    """stem, n: in how many of the rows' texts it stands (of ``wanted`` stems alone, if given)."""

    def make():
        def f(x):
            c: Counter = Counter()
            for t in x["text"]:
                found = {s for w in set(WORD.findall((t or "").lower())) for s in stems(w) if 3 <= len(s) <= 24}
                c.update(found if wanted is None else found & wanted)
            return {"stem": list(c), "n": list(c.values())}

        return f

    return map_slices(df.select("text"), "text", make, "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n"))


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Stems that toxic texts have far oftener, with the logarithm of how much.  rows: text, label.

    At most ``STEMS`` stems, the most frequent in toxic texts, and for each toxic
    text of the bounded sample those that clean texts hardly have, reach the driver.
    """
    toxic, clean = rows.filter("label = 1"), rows.filter("label = 0")
    n_toxic, n_clean = toxic.count(), clean.count()
    if not n_toxic or not n_clean:
        return {}
    often = {r["stem"]: r["n"] for r in _stem_counts(toxic, None).filter(F.col("n") >= 3).orderBy(F.desc("n"), "stem").limit(STEMS).collect()}
    other = {r["stem"]: r["n"] for r in _stem_counts(clean, frozenset(often)).collect()}
    lift = {s: (n / n_toxic) / ((other.get(s, 0) + 0.25) / n_clean) for s, n in often.items()}
    pure = frozenset(s for s, k in lift.items() if k >= LIFT)

    def make():
        def f(x):
            out = {"sketch": [], "hits": []}
            for t in x["text"]:
                words = WORD.findall((t or "").lower())
                out["sketch"].append(_sketch(words))
                out["hits"].append(sorted({s for w in set(words) for s in stems(w)} & pure))
            return out

        return f

    docs = map_slices(toxic.select("text"), "text", make, "sketch long, hits array<string>").collect()
    by_stem: dict[str, set] = {}
    for r in docs:
        for s in r["hits"]:
            by_stem.setdefault(s, set()).add(r["sketch"])
    left = {r["sketch"] for r in docs}
    wanted = max(3, min(8, len(left) // 40))
    chosen = [s for s, k in sorted(by_stem.items(), key=lambda i: (-len(i[1]), i[0])) if len(k) >= max(wanted, 1 + len(left) // 100)][:LEXICON]
    for s in chosen:
        left -= by_stem[s]
    while left:  # then whatever covers the most of the rest
        s = max(by_stem, key=lambda k: (len(by_stem[k] & left), k), default=None)
        if s is None or len(by_stem[s] & left) < 2 or len(chosen) >= LEXICON:
            break
        chosen.append(s)
        left -= by_stem[s]
    return {s: float(np.log(lift[s])) for s in chosen}


def featurize(df: DataFrame, lexicon: dict[str, float], keep: str) -> DataFrame:
    """keep (one column) and x array<double> of every row's text."""

    def make():
        g = Features(lexicon)
        return lambda x: {"k": x["k"], "x": [g(t) for t in x["text"]]}

    kind = df.schema[keep].dataType.simpleString()
    return map_slices(df.select(F.col(keep).alias("k"), "text"), "text", make, f"k {kind}, x array<double>").withColumnRenamed("k", keep)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> ToxicityModel:
    """docs: doc_id, text; labels: doc_id, label (training rows alone)."""
    labels = labels.filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = hash_sampled(labels, "doc_id", sample_share(labels.count(), rows))
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen) if rows <= 100_000 else chosen, "doc_id").withColumn("h", F.xxhash64("text")).dropDuplicates(["h"]).withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(8))).select("text", "label", "part").persist()
    try:
        lexicon = learn_lexicon(sample.filter("part < 5"))
        fit = featurize(sample.filter("part >= 5").withColumn("k", F.struct("label", "part")), lexicon, "k").select("k.label", "k.part", "x").collect()
    finally:
        sample.unpersist()
    y, part = np.array([r["label"] for r in fit], float), np.array([r["part"] for r in fit])
    x = np.array([r["x"] for r in fit], float).reshape(len(fit), FEATURES)
    fits, held = part < 7, part >= 7
    if len({*y[fits]}) < 2 or len({*y[held]}) < 2:
        fits = held = np.ones(len(y), bool)
    if len({*y}) < 2:
        return ToxicityModel(lexicon, None, None, min(0.49, float(y.mean())) if len(y) else 0.0)
    trees = Boosted().fit(x[fits], y[fits])
    return ToxicityModel(lexicon, trees, Isotonic().fit(trees.raw(x[held]), y[held]), 0.0)


def score(df: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",), text: str = "text", out: str = "score") -> DataFrame:
    """The kept columns and each text's score (under a name that they don't have)."""
    body = text if text in keep else fresh(df, "body")

    def make():
        g = Features(model.lexicon)

        def f(x):
            features = np.array([g(t) for t in x[body]], float).reshape(-1, FEATURES)
            return {c: x[c] for c in keep} | {out: model.score(features)}

        return f

    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]
    return map_slices(df.select(*[f"`{c}`" for c in keep], *([] if body in keep else [F.col(text).alias(body)])), body, make, ", ".join([*kinds, f"`{out}` double"]))


def train_rows(labels: DataFrame, label: str, n: int, held: int) -> DataFrame:
    """doc_id, label of the rows that a model may learn from."""
    return labels.filter(crc_mod("doc_id", n) != held).select("doc_id", F.col(label).alias("label"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, train_rows(table(spark, sf_dir, "labels"), "toxic", 5, 0))
    return score(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
