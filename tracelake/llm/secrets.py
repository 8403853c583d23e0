"""Operator 2, secret scans: rules, then a character convolutional network.

Three rules (assignments, access keys, hexadecimal runs) give the base spans,
which always stay.  Every other token of ``SHORTEST`` or more characters (the
shortest value of the rules), of whatever shape, goes with the characters around it
through a small convolutional network written in numpy; a candidate over the
threshold becomes a ``model`` span.  Base spans are cut out of a token and what is left of
it is scored; a token that encloses a base span is scored whole as well.

The network learns from labelled findings: the rules' values in a bounded,
hash-chosen sample of documents are positive, with the keyword hidden in a half of them so
that the value's own shape must tell; all other candidates are negative, and a
few made-up ones (numbers, addresses, words, dates, paths) join them so that a sample without
any can't leave them out.  Scores are calibrated by temperature on a held-out
part, and the threshold is the highest that keeps ``RECALL`` of the held-out
positives; ``held_out`` has the precision and recall there.

Defined cases: a null text is empty and has no spans; a text may have any
length and any number of findings: candidates are at most as many as its tokens and spans, and spans are found by bisection; without any finding in
the sample the made-up examples alone train the network; rows that repeat are
scanned each on its own.
"""

from __future__ import annotations

import bisect
import itertools
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_sampled, map_slices, sample_share, table

# The three rules.
ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run is matched whole, so 24 or more is the same as a run that is then tested
KINDS = ("assign", "access", "hex")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")  # lower case of what the first rule begins with
SHORTEST = 6
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=@:-]{%d,}" % SHORTEST)

#: Documents (expected) whose findings train the network, and the most findings of each label.
TRAIN_DOCUMENTS, TRAIN_FINDINGS, ROW_FINDINGS = 20_000, 6_000, 32
WIDTH, BEFORE = 64, 16  # characters of a window, those before the candidate
VALUE, STRIDE = 40, 20  # most characters of a value, and how far windows along a longer one are apart
TAIL = WIDTH - BEFORE - VALUE - 2  # those after it
PART = re.compile(r"[^/.=@:]{%d,}" % SHORTEST)
RECALL = 0.98
ALPHABET = {c: i for i, c in enumerate("\n \"'()[]{}<>,;:=+/_.-@#%&*!?|\\$~^`", 3)}
CLASSES = 3 + len(ALPHABET) + 36 + 26 + 1


def char_code(c: str) -> int:
    if c in ALPHABET:
        return ALPHABET[c]
    base = 3 + len(ALPHABET)
    if "0" <= c <= "9":
        return base + ord(c) - 48
    if "a" <= c <= "z":
        return base + 10 + ord(c) - 97
    if "A" <= c <= "Z":
        return base + 36 + ord(c) - 65
    return CLASSES - 1 if c.isalpha() else 1


_TABLE = np.array([char_code(chr(i)) for i in range(1024)], np.int16)


def encode(text: str, start: int, end: int, hide: bool = False) -> np.ndarray:
    """Codes of a window: ``BEFORE`` characters, a value of ``VALUE`` characters at most
    (see ``pieces_of``), what follows.  0 pads, 2 parts them."""
    head = text[max(0, start - BEFORE) : start]
    value = text[start:end]
    tail = text[end : end + TAIL]
    if hide:
        head = ""
    codes = [0] * (BEFORE - len(head))
    as_codes = lambda s: [int(_TABLE[ord(c)]) if ord(c) < 1024 else CLASSES - 1 for c in s]
    codes += as_codes(head) + [2] + as_codes(value) + [2] + as_codes(tail)
    return np.array((codes + [0] * WIDTH)[:WIDTH], np.int16)


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all characters, each text between WIDTH zeros, and where each text begins."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes + WIDTH) - sizes
    out = np.zeros(int((sizes + WIDTH).sum()) + WIDTH, np.int16)
    for t, at in zip(texts, begins.tolist(), strict=True):
        raw = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")
        out[at : at + raw.size] = np.where(raw < 1024, _TABLE[np.minimum(raw, 1023)], CLASSES - 1)
    return out, begins


def windows(codes: np.ndarray, start: np.ndarray, end: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The first ``width`` codes of ``encode`` for values of at most VALUE characters, by places in ``codes``."""
    j, size = np.arange(width), (end - start)[:, None]
    value = j - BEFORE - 1
    at = start[:, None] + np.where(j < BEFORE, j - BEFORE, value - (value > size))
    x = codes[np.minimum(at, codes.size - 1)]
    x[:, BEFORE] = 2
    np.put_along_axis(x, np.minimum(size + BEFORE + 1, width - 1), 2, 1)
    x[value > size + TAIL] = 0
    return x


def pieces_of(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """A candidate itself, or of a longer one than VALUE: overlapping windows that cover it and its parts between separators."""
    if end - start <= VALUE:
        return [(start, end)]
    along = lambda a, b: [(i, min(i + VALUE, b)) for i in range(a, max(a + 1, b - VALUE + STRIDE), STRIDE)]
    return list(dict.fromkeys([*along(start, end), *(w for m in PART.finditer(text, start, end) for w in along(*m.span()))]))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's index, end) of the rules' findings."""
    low = text.lower()
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if any(w in low for w in WORDS) else []
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Tokens of SHORTEST or more characters: what base spans leave of them, and the whole token if it encloses one."""
    tokens = [m.span() for m in CANDIDATE.finditer(text)]
    if not taken:
        return tokens
    starts = [s for s, _, _ in taken]
    reach = list(itertools.accumulate((e for _, _, e in taken), max))  # how far the spans up to each one go
    out = []
    for a, b in tokens:
        inside = [(s, e) for s, _, e in taken[bisect.bisect_right(reach, a) : bisect.bisect_left(starts, b)] if a < e]
        if not inside:
            out.append((a, b))
            continue
        if any(a <= s and e <= b and (s, e) != (a, b) for s, e in inside):
            out.append((a, b))
        at = a
        for s, e in [*inside, (b, b)]:
            piece = text[at:s].lstrip(":=@./") if s > at else ""
            if len(piece) >= SHORTEST:
                out.append((s - len(piece), s))
            at = max(at, e)
    return sorted(set(out))


class CharNet:
    """Embedding, one convolution over characters, maximum and mean pools, one hidden layer."""

    def __init__(self, seed: int = 7, dim: int = 12, filters: int = 24, span: int = 5, hidden: int = 16):
        g = np.random.default_rng(seed)
        self.span = span
        self.p = {
            "e": g.normal(0, 0.3, (CLASSES, dim)), "k": g.normal(0, 1 / np.sqrt(dim * span), (span * dim, filters)), "kb": np.zeros(filters),
            "h": g.normal(0, 1 / np.sqrt(2 * filters), (2 * filters, hidden)), "hb": np.zeros(hidden), "o": g.normal(0, 1 / np.sqrt(hidden), hidden), "ob": np.zeros(1),
        }
        self.temperature, self.threshold, self.held_out = 1.0, 0.5, (0.0, 0.0)

    def _forward(self, x: np.ndarray):
        p = self.p
        e = p["e"][x]
        n = x.shape[1] - self.span + 1
        cols = np.concatenate([e[:, i : i + n] for i in range(self.span)], axis=2)
        z = cols @ p["k"] + p["kb"]
        r = np.maximum(z, 0)
        top = r.argmax(axis=1)
        pooled = np.concatenate([r.max(axis=1), r.mean(axis=1)], axis=1)
        h = np.maximum(pooled @ p["h"] + p["hb"], 0)
        return h @ p["o"] + p["ob"][0], (cols, z, r, top, pooled, h)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 512])[0] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))

    def score_places(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray, step: int = 1024) -> np.ndarray:
        """``score`` of ``windows``: the convolution as a sum of tables by pairs of codes, place by place for many windows at once,
        the zeros behind short windows once for all."""
        p, k = self.p, self.span
        tables = [(p["e"] @ w).astype(np.float32) for w in np.split(p["k"], k)]
        tables[-1] += p["kb"].astype(np.float32)
        blank = np.maximum(sum(t[0] for t in tables), 0)
        filters = blank.size
        pairs = [(o, (tables[o][:, None] + tables[o + 1]).reshape(-1, filters)) for o in range(0, k - 1, 2)]
        ones = [(o, tables[o]) for o in range(k - k % 2, k)]
        whole, out = WIDTH - k + 1, np.zeros(start.size)
        size = end - start
        order = np.argsort(size, kind="stable")
        for i in range(0, order.size, step):
            at = order[i : i + step]
            width = min(WIDTH, BEFORE + 2 + int(size[at].max()) + TAIL + k - 1)
            x = np.ascontiguousarray(windows(codes, start[at], end[at], width).T, np.intp)
            two = x[:-1] * CLASSES + x[1:]
            n = width - k + 1
            z, more = np.empty((2, at.size, filters), np.float32)
            top, total = np.zeros((2, at.size, filters), np.float32)
            for j in range(n):
                np.take(pairs[0][1], two[j], 0, z, "clip")
                for o, t in pairs[1:]:
                    np.take(t, two[j + o], 0, more, "clip")
                    z += more
                for o, t in ones:
                    np.take(t, x[j + o], 0, more, "clip")
                    z += more
                np.maximum(z, 0, out=z)
                np.maximum(top, z, out=top)
                total += z
            mean = (total + (whole - n) * blank) / whole
            if n < whole:
                top = np.maximum(top, blank)
            h = np.maximum(np.concatenate([top, mean], 1) @ p["h"] + p["hb"], 0)
            out[at] = h @ p["o"] + p["ob"][0]
        return 1 / (1 + np.exp(-np.clip(out / self.temperature, -30, 30)))

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict:
        p, f = self.p, self.p["k"].shape[1]
        z_out, (cols, z, _, top, pooled, h) = self._forward(x)
        d = (1 / (1 + np.exp(-np.clip(z_out, -30, 30))) - y) / len(y)
        g = {"o": h.T @ d, "ob": np.array([d.sum()])}
        dh = np.outer(d, p["o"]) * (h > 0)
        g |= {"h": pooled.T @ dh, "hb": dh.sum(0)}
        dp = dh @ p["h"].T
        dr = np.repeat(dp[:, None, f:] / z.shape[1], z.shape[1], axis=1)
        np.put_along_axis(dr, top[:, None, :], np.take_along_axis(dr, top[:, None, :], 1) + dp[:, None, :f], 1)
        dz = dr * (z > 0)
        g |= {"k": np.einsum("nic,nif->cf", cols, dz, optimize=True), "kb": dz.sum((0, 1))}
        dc = dz @ p["k"].T
        de, dim, n = np.zeros_like(p["e"]), p["e"].shape[1], z.shape[1]
        for i in range(self.span):
            np.add.at(de, x[:, i : i + n], dc[:, :, i * dim : (i + 1) * dim])
        return g | {"e": de}

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 500, batch: int = 96, rate: float = 0.006, seed: int = 11) -> CharNet:
        """Adam on balanced batches."""
        g = np.random.default_rng(seed)
        pos, neg = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for t in range(1, steps + 1):
            at = np.concatenate([g.choice(pos, batch // 2), g.choice(neg, batch // 2)])
            for k, d in self._gradients(x[at], y[at]).items():
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float = RECALL) -> CharNet:
        """Temperature by held-out likelihood; then the highest threshold with the wanted recall (0.5 without a positive)."""
        z = self.logits(x)
        loss = lambda t: np.mean(np.logaddexp(0, -np.where(y == 1, 1, -1) * z / t))
        self.temperature = float(min(np.geomspace(0.25, 8, 41), key=loss))
        p = self.score(x)
        kept = np.sort(p[y == 1])
        if len(kept):
            self.threshold = float(kept[int((1 - recall) * len(kept))])
            over = p >= self.threshold
            self.held_out = float((y[over] == 1).mean()), float(over[y == 1].mean())
        return self


def made_up(seed: int = 3, n: int = 240) -> tuple[np.ndarray, np.ndarray]:
    """Examples of known kind: random keys, and numbers, dates, addresses, paths and words (shouted ones too)."""
    g = np.random.default_rng(seed)
    pick = lambda s, k: "".join(g.choice(list(s), k))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda: pick(low, int(g.integers(3, 9)))
    yes = lambda: [pick(low + up + dig, int(g.integers(20, 44))), pick("0123456789abcdef", int(g.integers(18, 44))), pick(up + dig, int(g.integers(18, 30))), f"{pick(low, 2)}_{pick(low + up + dig, 32)}"]
    no = lambda: [pick(dig, int(g.integers(16, 20))), f"{word()}.{pick(dig, 2)}@{word()}{pick(dig, 1)}.{word()}.com", f"{g.integers(1990, 2030)}-{pick(dig, 2)}-{pick(dig, 2)}T{pick(dig, 2)}:{pick(dig, 2)}:{pick(dig, 2)}", f"https://{word()}.{word()}.org/{word()}/{pick(dig, 4)}", f"{word()}-{word()}-{word()}-{pick(dig, 2)}", f"https://{word()}.{word()}.org/" + "/".join(word() for _ in range(12)) + f"?{word()}={pick(dig, 3)}", f"{pick(dig, 4)}-{pick(dig, 4)}-{pick(dig, 4)}-{pick(dig, 4)}", f"{word()}_{word()}_{word()}{pick(dig, 1)}", f"{word()}{word()}".upper(), f"{word()}{word()}.", word().capitalize() + word(), f"{pick(dig, 3)}.{pick(dig, 3)}.{pick(dig, 3)}.{pick(dig, 3)}:{pick(dig, 4)}"]
    x, y = [], []
    for label, kinds in ((1, yes), (0, no)):
        for _ in range(n // 4):
            for v in kinds():
                before = " ".join(word() for _ in range(3)) + " "
                t = f"{before}{v} {word()}"
                for a, b in pieces_of(t, len(before), len(before) + len(v)) if not label else [(len(before), len(before) + min(len(v), VALUE))]:
                    x.append(encode(t, a, b))
                    y.append(label)
    return np.array(x), np.array(y, np.int8)


def _rank(text: str, start: int, end: int) -> tuple[int, int]:
    """Order of a row's negatives: each eighth word of any shape and all with digits or of 16 characters first."""
    mix = zlib.crc32(text[start:end].encode("utf-8", "surrogatepass"))
    return mix % 8 > 0 and end - start < 16 and not any("0" <= c <= "9" for c in text[start:end]), mix


def _findings(df: DataFrame, key: str, text: str) -> DataFrame:
    """Labelled windows of each row: 1 for rules' values, 0 for other candidates."""

    def make():
        def f(x):
            codes, labels = [], []
            for i, t in enumerate(x["text"]):
                t = t or ""
                taken = base_spans(t)
                free = candidates(t, taken)
                if taken:
                    starts, reach = [s for s, _, _ in taken], list(itertools.accumulate((e for _, _, e in taken), max))
                    free = [c for c in free if bisect.bisect_right(reach, c[0]) >= bisect.bisect_left(starts, c[1])]
                here, marks = [], []
                for s, kind, e in sorted(taken, key=lambda x: zlib.crc32(t[x[0] : x[2]].encode("utf-8", "surrogatepass")))[:ROW_FINDINGS]:
                    value = ASSIGN.match(t, s).start(2) if kind == 0 else s
                    here.append(encode(t, value, min(e, value + VALUE), hide=(i + s) % 2 == 0))
                    marks.append(1)
                for s, e in sorted(free, key=lambda c: _rank(t, *c)):
                    if len(here) >= ROW_FINDINGS:
                        break
                    for a, b in pieces_of(t, s, e)[: ROW_FINDINGS - len(here)]:
                        here.append(encode(t, a, b))
                        marks.append(0)
                codes.append(b"".join(h.astype("<i2").tobytes() for h in here))
                labels.append(marks)
            return {"codes": codes, "labels": labels}

        return f

    return map_slices(df.select(F.col(key).alias("k"), F.col(text).alias("text")), "text", make, "codes binary, labels array<int>").filter(F.size("labels") > 0)


def train(df: DataFrame, key: str = "doc_id", text: str = "text", documents: int = TRAIN_DOCUMENTS, findings: int = TRAIN_FINDINGS) -> CharNet:
    """Fits the network on the findings of about ``documents`` hash-chosen rows.

    A row gives 32 findings at most, chosen by the hash of their characters; of all windows each label's ``findings`` of
    the least hash are taken, on the executors, so the driver gets ``2 * findings`` windows (128 bytes each) at most.
    """
    sample = hash_sampled(df, key, sample_share(df.count(), documents))
    rows = _findings(sample, key, text).select("codes", F.posexplode("labels").alias("i", "label"))
    one = rows.select("label", F.expr(f"substring(codes, {2 * WIDTH} * i + 1, {2 * WIDTH})").alias("code")).distinct().withColumn("h", F.xxhash64("code")).persist()  # a window that comes again counts once
    try:
        n = {r["label"]: r["count"] for r in one.groupBy("label").count().collect()}
        # hashes under a bound leave a little more than ``findings``, so that what is put in order is bounded too
        low = lambda v: F.col("h") <= F.lit((min(1 << 20, int(1.2 * findings * (1 << 20) / max(1, n.get(v, 0)))) << 44) - (1 << 63) - 1)
        top = [one.filter((F.col("label") == v) & low(v)).orderBy("h", "code").limit(findings) for v in (1, 0)]
        found = top[0].unionByName(top[1]).collect()
    finally:
        one.unpersist()
    x, y = made_up()
    if found:
        seen = sorted((r["h"], bytes(r["code"]), r["label"]) for r in found)
        x = np.concatenate([x, np.array([np.frombuffer(c, "<i2") for _, c, _ in seen])])
        y = np.concatenate([y, np.array([v for _, _, v in seen], np.int8)])
    held = np.arange(len(y)) % 5 == 0
    return CharNet().fit(x[~held], y[~held]).calibrate(x[held], y[held])


def model_spans(net: CharNet, texts: list[str], taken: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int]]]:
    """(start, end) of each text's candidates over the threshold."""
    codes, begins = coded(texts)
    found = [candidates(t, spans) for t, spans in zip(texts, taken, strict=True)]
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    counts = np.array([len(c) for c in found], np.int64)
    if not counts.sum():
        return out
    place = np.array([c for cs in found for c in cs], np.int64)
    of = np.repeat(np.arange(len(texts)), counts)
    score = np.zeros(len(place))
    short = np.flatnonzero(place[:, 1] - place[:, 0] <= VALUE)  # one window each
    score[short] = net.score_places(codes, *(place[short] + begins[of[short], None]).T)
    long = np.flatnonzero(place[:, 1] - place[:, 0] > VALUE)
    if long.size:
        pieces = [pieces_of(texts[of[i]], *place[i].tolist()) for i in long.tolist()]
        sizes = np.array([len(p) for p in pieces])
        start, end = np.array([w for p in pieces for w in p], np.int64).T + np.repeat(begins[of[long]], sizes)
        score[long] = np.maximum.reduceat(net.score_places(codes, start, end), np.cumsum(sizes) - sizes)
    for i in np.flatnonzero(score >= net.threshold).tolist():
        out[of[i]].append((int(place[i, 0]), int(place[i, 1])))
    return out


def scan(df: DataFrame, net: CharNet, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, spans array<struct<kind, start, stop>> in order (model spans after base ones at a tie)."""

    def make():
        def f(x):
            texts = [t or "" for t in x["text"]]
            out = [base_spans(t) for t in texts]
            for spans, more in zip(out, model_spans(net, texts, out), strict=True):
                spans += [(s, len(KINDS), e) for s, e in more]
            names = (*KINDS, "model")
            return {"k": x["k"], "spans": [[{"kind": names[k], "start": s, "stop": e} for s, k, e in sorted(o)] for o in out]}

        return f

    kind = df.schema[key].dataType.simpleString()
    return map_slices(df.select(F.col(key).alias("k"), F.col(text).alias("text")), "text", make, f"k {kind}, spans array<struct<kind:string,start:int,stop:int>>").withColumnRenamed("k", key)


def redact(df: DataFrame, net: CharNet, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns; every span (overlapping ones joined) becomes ``mark``.
    A null text stays null."""
    names = df.columns
    schema = df.schema

    def cut(t: str, spans: list[tuple[int, int]]) -> str:
        out, at, end = [], 0, 0
        for s, e in sorted(spans):
            if s >= end:
                out += [t[at:s], mark]
            end = max(end, e)
            at = end
        return "".join([*out, t[at:]])

    def make():
        def f(x):
            texts = [t or "" for t in x[text]]
            taken = [base_spans(t) for t in texts]
            spans = [[(s, e) for s, _, e in of] + more for of, more in zip(taken, model_spans(net, texts, taken), strict=True)]
            return {c: x[c] if c != text else [t if t is None or not sp else cut(t, sp) for t, sp in zip(x[text], spans, strict=True)] for c in names}

        return f

    return map_slices(df, text, make, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields))


def _joined(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model spans of every whole text."""
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, train(docs))
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.withColumn("base", F.filter("spans", lambda s: s["kind"] != "model")).select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"), of("model").alias("n_model"),
    )
