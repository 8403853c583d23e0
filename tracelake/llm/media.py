"""Operator 9, media columns: PNG in binary columns, read back and hashed.

A payload becomes an 8-bit RGB image of 64 pixels a row (192 bytes).  The writer
filters each row (None, Sub or Up, whichever has the least sum of absolute
differences) and deflates.  The reader walks the chunks, tests every checksum,
inflates, undoes all five filters in numpy, and takes a perceptual hash: the
signs of the 63 lowest cosine coefficients against their median, beside the mean.

Defined cases: a null text is an empty one; an empty text is one row of spaces;
equal texts have equal values; a blob that isn't a PNG, fails a checksum, has a bad header, no samples or not
as many as its header says raises ``PngError`` in ``decode_png`` and gives nulls in ``media_features``; inflating
stops at the size that the header gives, so a small blob can't fill the memory; only the named columns are read.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_slices, table

WIDTH, CHANNELS = 64, 3
ROW_BYTES = WIDTH * CHANNELS
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels by PNG colour type (fixed values of the format).
COLOURS = {0: 1, 2: 3, 4: 2, 6: 4}
GRID, LOW = 32, 8
#: Samples that a reader takes from one blob at most (Arrow's own limit for one value).
MOST_BYTES = 1 << 31


class PngError(ValueError):
    """The bytes are no readable PNG."""


def pad(data: bytes, unit: int = ROW_BYTES) -> bytes:
    """Spaces up to a positive multiple of ``unit``."""
    return data + b" " * (-len(data) % unit if data else unit)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_png(payload: bytes, width: int = WIDTH, channels: int = CHANNELS, level: int = 4) -> bytes:
    """Stores whole rows of 8-bit samples; each row takes the filter of the least absolute sum."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width * channels)
    left, up = np.zeros_like(rows), np.zeros_like(rows)
    left[:, channels:] = rows[:, :-channels]
    up[1:] = rows[:-1]
    forms = np.stack([rows, rows - left, rows - up])
    cost = np.abs(forms.view(np.int8).astype(np.int16)).sum(axis=2)
    best = cost.argmin(axis=0)
    out = np.empty((rows.shape[0], rows.shape[1] + 1), np.uint8)
    out[:, 0] = best
    out[:, 1:] = forms[best, np.arange(rows.shape[0])]
    kind = {1: 0, 3: 2, 2: 4, 4: 6}[channels]
    head = struct.pack(">IIBBBBB", width, rows.shape[0], 8, kind, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(out.tobytes(), level)) + _chunk(b"IEND", b"")


def _average(row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    out = row.astype(np.int64)
    for i in range(0, len(row), step):
        before = out[i - step : i] if i else 0
        out[i : i + step] = (out[i : i + step] + (before + above[i : i + step].astype(np.int64)) // 2) & 255
    return out.astype(np.uint8)


def _paeth(row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    out, up = row.astype(np.int64), above.astype(np.int64)
    zero = np.zeros(step, np.int64)
    for i in range(0, len(row), step):
        a, b, c = (out[i - step : i], up[i : i + step], up[i - step : i]) if i else (zero, up[:step], zero)
        pa, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
        near = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
        out[i : i + step] = (out[i : i + step] + near) & 255
    return out.astype(np.uint8)


def unfilter(kinds: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray:
    """Undoes the row filters.  Rows of None and Sub don't read other rows and go
    all at once; a run of Up rows is one cumulative sum modulo 256."""
    if kinds.max(initial=0) > 4:
        raise PngError("unknown filter")
    out = rows.copy()
    sub = np.flatnonzero(kinds == 1)
    if len(sub):
        grid = rows[sub].reshape(len(sub), -1, step)
        out[sub] = np.cumsum(grid, axis=1, dtype=np.uint8).reshape(len(sub), -1)
    i, n = 0, len(kinds)
    rest = np.flatnonzero(kinds >= 2)
    zero = np.zeros(rows.shape[1], np.uint8)
    at = 0
    while at < len(rest):
        i = rest[at]
        above = out[i - 1] if i else zero
        if kinds[i] == 2:
            j = i + 1
            while j < n and kinds[j] == 2:
                j += 1
            out[i:j] = np.cumsum(rows[i:j], axis=0, dtype=np.uint8) + above
            at += j - i
        else:
            out[i] = (_average if kinds[i] == 3 else _paeth)(rows[i], above, step)
            at += 1
    return out


def decode_png(blob: bytes) -> np.ndarray:
    """Samples as (height, width, channels); every chunk's checksum is tested."""
    if blob[:8] != SIGNATURE:
        raise PngError("no signature")
    at, head, data, ended = 8, None, [], False
    while at < len(blob) and not ended:
        if at + 12 > len(blob):
            raise PngError("a chunk is cut off")
        (n,), kind = struct.unpack_from(">I", blob, at), blob[at + 4 : at + 8]
        body, end = blob[at + 8 : at + 8 + n], at + 12 + n
        if end > len(blob) or struct.unpack_from(">I", blob, end - 4)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise PngError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            if n != 13:
                raise PngError("the size of the header")
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        ended = kind == b"IEND"
        at = end
    if head is None or not ended:
        raise PngError("no header or end")
    width, height, depth, colour, _, _, interlaced = head
    if depth != 8 or colour not in COLOURS or interlaced:
        raise PngError("only 8-bit samples, not interlaced and without a palette, are read")
    if not width or not height:
        raise PngError("no samples")
    step = COLOURS[colour]
    size = height * (width * step + 1)
    if size > MOST_BYTES:
        raise PngError("the header promises more than can be read")
    try:
        inflate = zlib.decompressobj()
        raw = np.frombuffer(inflate.decompress(b"".join(data), size + 1), np.uint8)  # never more than the header says
    except zlib.error as e:
        raise PngError(str(e)) from e
    if raw.size != size or not inflate.eof:
        raise PngError("the size of the samples")
    raw = raw.reshape(height, -1)
    return unfilter(raw[:, 0], raw[:, 1:], step).reshape(height, width, step)


def _shrink(x: np.ndarray) -> np.ndarray:
    """Area averages of the rows of x: GRID rows, of exact (fractional) height each, by running sums."""
    n = x.shape[0]
    total = np.vstack([np.zeros(x.shape[1]), np.cumsum(x, axis=0)])
    edges = np.linspace(0, n, GRID + 1)
    whole = np.minimum(edges.astype(int), n - 1)
    at = total[whole] + (edges - whole)[:, None] * x[whole]
    return np.diff(at, axis=0) * (GRID / n)


@functools.lru_cache(1)
def _cosines() -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(GRID)[None, :]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * GRID))


def perceptual_hash(samples: np.ndarray) -> bytes:
    """Eight bytes: the mean, then signs of low-frequency coefficients against their median."""
    grey = samples.mean(axis=2)
    grid = _shrink(_shrink(grey).T).T
    low = np.round(_cosines() @ grid @ _cosines().T, 6).ravel()
    bits = low[1:] > np.median(low[1:])
    return np.packbits(np.concatenate([[low[0] / GRID**2 > 127.5], bits])).tobytes()


def store_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One PNG a row: key, n_bytes (unpadded), media binary."""

    def make():
        def f(x):
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in x["text"]]
            return {"k": x["k"], "n": [len(r) for r in raw], "m": [encode_png(pad(r)) for r in raw]}

        return f

    kind = df.schema[key].dataType.simpleString()
    return map_slices(df.select(F.col(key).alias("k"), F.col(text).alias("text")), "text", make, f"k {kind}, n_bytes long, media binary").withColumnRenamed("k", key)


def media_features(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """Reads stored media back: payload facts and the cosine hash (all null where the blob is bad)."""

    def make():
        def read(blob):
            try:
                samples = decode_png(blob)
            except (PngError, TypeError):
                return None, None, None, None
            payload = samples.tobytes()
            return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), perceptual_hash(samples)

        def f(x):
            got = [read(m) for m in x["media"]]
            return {"k": x["k"], "n_bytes": x["n_bytes"], "media": x["media"]} | {c: [g[i] for g in got] for i, c in enumerate(("size", "sha", "tail", "feature"))}

        return f

    kind = df.schema[key].dataType.simpleString()
    out = map_slices(df.select(F.col(key).alias("k"), "n_bytes", F.col(media).alias("media")), "media", make, f"k {kind}, n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, feature binary")
    return out.withColumnRenamed("k", key)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as PNG, read back, checked and hashed."""
    stored = store_media(table(spark, sf_dir, "documents"))
    seen = media_features(stored)
    return seen.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.lower(F.hex("feature")).alias("feature"),
    )
