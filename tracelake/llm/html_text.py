"""Operator 10, HTML extraction by a maximum-scoring subsequence.

A page becomes one run of scored tokens: a word scores by where it stands, a tag
scores below zero, an element that is never content (scripts, menus, forms,
adverts, comments ...) is one negative token without text.  A linear scan finds
the contiguous region of the greatest sum; the blocks that it touches are the text.

The weights come from labelled pages: pages that mark their article with
<article> or <main> label their own tokens, and log odds of being inside give
the weights (words between -3 and 3, tags and dropped elements at most -0.01).  The mark itself is
hidden from them, so they hold for pages without one; where a page has the mark, it is a feature of its own: words inside
score ``INSIDE`` at least, and stepping over its edge costs ``BOUNDARY`` (but not between articles
that have no text between them).  A bounded, hash-chosen sample of pages is
counted on the executors; only counts by feature (under 200 names) reach the driver.

Defined cases: a null or empty page has the empty text; broken markup (unclosed
tags, stray ends or quotes, a lone <) is read as far as it goes, never dropped; a page
without any word outside dropped elements has the empty text; of equal regions
the first and shortest wins; repeated pages give equal rows; reading takes time in
proportion to a page's length, whatever stands in it; only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import html
import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_sampled, map_slices, sample_share, table

#: Pages (expected) that the weights are learned from.
TRAIN_PAGES = 4_000
BOUNDARY, DROPPED, INSIDE = -50.0, -0.5, 1.0

# Element kinds of HTML.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "math", "canvas", "xmp")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
NEVER = frozenset("head nav footer aside form button select option dialog menu object audio video map fieldset".split())
HINTS = frozenset("ad ads adv advert adverts advertisement advertising adbox banner banners promo promos promotion promoted sponsor sponsored cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup paywall sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar comment comments commentlist reply replies respond discussion disqus share sharing social related recommended recommendations popup modal overlay widget widgets pagination pager login search".split())
#: Words of HINTS that have other uses within an article: there they count only as a whole class name.
AMBIGUOUS = frozenset("side share sharing social related reply replies respond discussion alert alerts notice notices header footer menu widget widgets search overlay modal recommended recommendations consent subscription".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
CONTAINERS = frozenset("html body main article section div table tbody tr td ul ol dl aside figure blockquote details".split())

# Possessive parts: no place of a page can be read in two ways, so an attempt never costs more than its own length.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b(?:[^>]*+(?<=/)>|.*?(?:</(?P=raw)\s*+>|\Z))"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^<>\"'=]++|=\s*+(?:\"(?:[^\"<]|<(?![a-zA-Z/!]))*+\"|'(?:[^'<]|<(?![a-zA-Z/!]))*+'|)|[\"'])*+)>|<[!?][^>]*+(?:>|\Z)",
    re.S | re.I,
)
ATTR = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++)))?")
CONTEXT = {"a": "link", "li": "item", "p": "p", "td": "cell", "th": "cell", "blockquote": "p", "pre": "p", "dd": "item", "dt": "item"} | {f"h{i}": "h" for i in range(1, 7)}


def _hinted(value: str, inside: bool) -> bool:
    for name in value.split():
        if name in HINTS:
            return True
        parts = HINTS.intersection(re.split(r"[^a-z0-9]+", name))
        if parts and not (inside and parts <= AMBIGUOUS):
            return True
    return False


def is_dropped(tag: str, attrs: str, inside: bool) -> bool:
    """Never content: by kind of element, by role, or by a word of its class or id."""
    if tag in NEVER or (tag == "header" and not inside):
        return True
    if "=" not in attrs and "hidden" not in attrs:
        return False
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in ROLES):
            return True
        if name in ("class", "id") and tag not in ("html", "body", "main") and _hinted(value, inside):
            return True
    return False


def tokens(page: str):
    """Yields (kind, feature, text): "text" (a run of text and its context), "inline" or "block" (a tag), "drop" or "edge"."""
    at, inside = 0, 0
    skip, within = None, {}  # the dropped element that is open, and what is open in it
    around: dict[str, int] = {}  # containers open outside of it
    link, context = 0, "plain"
    for m in TOKEN.finditer(page):
        if m.start() > at and skip is None:
            yield "text", "word:" + ("link" if link else context), page[at : m.start()]
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag, end = tag.lower(), bool(m["end"])
        if skip is not None:
            if tag in ("article", "main") and not end and skip not in ("article", "main"):
                skip = None  # what should have ended before the article didn't
            elif not end:
                if tag not in VOID:
                    within[tag] = within.get(tag, 0) + 1
                continue
            elif within.get(tag, 0):
                within[tag] -= 1
                continue
            elif tag == skip:
                skip = None
                yield "block", "", ""
                continue
            elif tag in CONTAINERS and around.get(tag, 0):
                skip = None  # the end of what holds it ends it
            else:
                continue
        if not end and is_dropped(tag, m["attrs"], inside > 0):
            yield "drop", "drop", ""
            if tag not in VOID and not m["attrs"].endswith("/"):
                skip, within = tag, {}
            continue
        if tag in CONTAINERS:
            around[tag] = max(0, around.get(tag, 0) + (-1 if end else 1))
        if tag in ("article", "main"):
            inside = max(0, inside + (-1 if end else 1))
            yield "edge", "close" if end else "open", ""
            context, link = "plain", 0
            continue
        if tag == "a":
            link = 0 if end else 1
        elif tag in CONTEXT:
            context = "plain" if end else CONTEXT[tag]
        if tag not in INLINE:
            link = 0
        yield ("inline" if tag in INLINE else "block"), "tag:" + tag, " " if tag == "br" else ""
    if at < len(page) and skip is None:
        yield "text", "word:" + ("link" if link else context), page[at:]


def count_features(page: str, counts: dict) -> None:
    """Adds a self-labelled page's tokens: feature -> [outside, inside]."""
    found, depth, marked = [], 0, False
    for kind, feature, text in tokens(page):
        if kind == "edge":
            depth, marked = max(0, depth + (1 if feature == "open" else -1)), True
        elif feature:
            found.append((feature, int(depth > 0), len(text.split()) if kind == "text" else 1))
    if marked:
        for feature, side, n in found:
            counts.setdefault(feature, [0, 0])[side] += n


def weights_of(counts: dict) -> dict[str, float]:
    """Log odds; words within -3 and 3, tags within -3 and -0.01."""
    out = {}
    for feature, (outside, inside) in counts.items():
        w = math.log((inside + 1) / (outside + 1))
        out[feature] = min(3.0, max(-3.0, w)) if feature.startswith("word:") else max(-3.0, min(-0.01, w))
    return out


#: For features that no labelled page shows.
DEFAULTS = {"word:plain": 0.5, "word:p": 1.0, "word:h": 1.0, "word:cell": 0.5, "word:item": 1.0, "word:link": -0.1}


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and last place of the contiguous run of the greatest sum, the first and shortest of equal
    ones; (0, -1) if no sum is over 0."""
    best, span, total, start = 0.0, (0, -1), 0.0, 0
    for i, w in enumerate(scores):
        total += w
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, span = total, (start, i)
    return span


def scored(page: str, weights: dict[str, float]) -> tuple[list[float], list[list]]:
    """The score of every token, and the blocks: first token, last token, parts of text."""
    scores: list[float] = []
    blocks: list[list] = []
    open_block, depth, left = False, 0, None  # left: the last step out of an article that no word has followed yet
    for i, (kind, feature, text) in enumerate(tokens(page)):
        if kind in ("block", "edge", "drop"):
            open_block = open_block and kind == "drop"
        if kind == "edge":
            w, depth = BOUNDARY, max(0, depth + (1 if feature == "open" else -1))
            if feature == "close":
                left = i
            elif left is not None:  # the next article follows at once: no edge lies between
                scores[left] = w = -0.01
                left = None
        elif kind == "drop":
            w = weights.get("drop", DROPPED)
        elif kind == "text":
            words = len(text.split())
            w = weights.get(feature, DEFAULTS.get(feature, 0.5))
            w = words * (max(w, INSIDE) if depth else w)
            if words:
                left = None
            if open_block:
                blocks[-1][1] = i
                blocks[-1][2].append(text)
            elif words:
                blocks.append([i, i, [text]])
                open_block = True
        else:
            w = weights.get(feature, -0.02 if kind == "inline" else -0.05) if feature else 0.0
            if text and open_block:
                blocks[-1][2].append(text)
        scores.append(w)
    return scores, blocks


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The blocks of the region with the greatest sum, whole, joined by newlines."""
    scores, blocks = scored(page or "", weights)
    lo, hi = best_region(scores)
    found = (" ".join(html.unescape("".join(parts)).split()) for a, b, parts in blocks if b >= lo and a <= hi)
    return "\n".join(x for x in found if x)


def learn_weights(df: DataFrame, key: str = "page_id", page: str = "html", pages: int = TRAIN_PAGES) -> dict[str, float]:
    """Weights from about ``pages`` hash-chosen pages."""

    def make():
        def f(x):
            counts: dict = {}
            for p in x["p"]:
                count_features(p or "", counts)
            return {"f": list(counts), "o": [c[0] for c in counts.values()], "i": [c[1] for c in counts.values()]}

        return f

    sample = hash_sampled(df, key, sample_share(df.count(), pages)).select(F.col(page).alias("p"))
    known = [f"tag:{t}" for t in sorted(INLINE | VOID | NEVER | set(CONTEXT) | set("div section ul ol dl table tr tbody thead tfoot caption figure figcaption html body header address hgroup summary details center".split()))]
    counted = map_slices(sample, "p", make, "feature string, outside long, inside long")
    rows = counted.filter(F.col("feature").startswith("word:") | (F.col("feature") == "drop") | F.col("feature").isin(known)).groupBy("feature").agg(F.sum("outside").alias("o"), F.sum("inside").alias("i")).collect()
    return weights_of({r["feature"]: [r["o"], r["i"]] for r in rows})


def extract(df: DataFrame, weights: dict[str, float], keep: tuple[str, ...] = ("page_id", "url"), page: str = "html") -> DataFrame:
    """The kept columns and the main text of every page."""

    def make():
        def f(x):
            return {c: x[c] for c in keep} | {"text": [main_text(p, weights) for p in x["_page"]]}

        return f

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return map_slices(df.select(*keep, F.col(page).alias("_page")), "_page", make, f"{kinds}, text string")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return extract(pages, learn_weights(pages)).withColumn("n_chars", F.length("text").cast("long"))
