"""Operator 1, SentencePiece encoding and decoding with sampled segmentations.

A text becomes a lattice over its characters whose edges are the vocabulary's
pieces; an edge of the piece at rank r weighs ``-SHARPNESS * ln(r + RANK_SHIFT)``
(the vocabulary is of the byte-pair kind and orders its pieces by merge, so the weights
follow its ranks).  A character without a piece is one edge of its UTF-8 bytes.

k distinct segmentations are drawn without replacement by Gumbel top-k: a search
best first over regions of the lattice, where a region is a prefix of pieces and
the pieces that may not follow it.  A region's perturbed bound is exact (a Gumbel
of its log mass, held below its parent's bound, masses from a backward pass), so
the first k regions taken are the k greatest perturbed segmentations.  The bound of
the next region is the threshold kappa, and ``1 - exp(-exp(log_prob - kappa))`` is a
sample's inclusion score.  All draws come from a hash of the row's key, the
sample's rank and the place, so a row's samples never depend on its neighbours,
its partition or a rerun.

No piece goes on over a space, so the lattice falls apart into units; the
distinct units of a slice of text are built once, all in numpy.

Defined cases: a null text is an empty one and has one segmentation, the empty
one; a text with fewer than k segmentations gives all of them, each with
inclusion score 1; equal keys and texts give equal samples; a null key draws as
key 0; a literal U+2581 is spelled in bytes, so that decoding always gives
the text back.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_slices, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES, SEED = 3, 17
SHARPNESS, RANK_SHIFT, BYTE_COST = 1.0, 16.0, 4.0
SPACE, LITERAL = "▁", "\udfff"  # the second can't stand in a text
UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Bytes of text that share one lattice.
SLICE = 1 << 20
#: The greatest Gumbel draw that ``uniforms`` can give is below this.
GUMBEL_MOST = 36.8
#: Places of all texts that one step of the search looks at.
BLOCK = 96

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit integers (wraps around)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _B
        x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def uniforms(x: np.ndarray) -> np.ndarray:
    """Numbers within (0, 1) from mixed integers: odd multiples of 2^-53, all exact."""
    return ((mixed(x) >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def code_points(text: str) -> np.ndarray:
    """The code points of a text, each more by one, and a last place for none."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass") + b"\0\0\0\0", np.uint32).astype(np.uint64) + np.uint64(1)


def joined_text(strings: pa.StringArray) -> str:
    """All strings of an array without nulls in a row, from its one buffer."""
    if not len(strings):
        return ""
    ends = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1]
    return str(strings.buffers()[2][int(ends[0]) : int(ends[-1])], "utf-8")


def load_pieces(path: str = MODEL) -> list[tuple[str, int]]:
    """(piece, kind) by id; kind 0 is text, 1 a byte, 2 control or unknown."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), 1 if sp.is_byte(i) else 2 if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else 0) for i in range(sp.get_piece_size())]


class Vocabulary:
    """Hash table of pieces for whole arrays of substrings, weights, and bytes for decoding."""

    def __init__(self, pieces: list[tuple[str, int]]):
        self.byte_ids = np.zeros(256, np.int32)
        self.raw: list[bytes] = []
        rank = 0
        keys, ids, weights = [], [], []
        self.longest = 1
        for i, (piece, kind) in enumerate(pieces):
            if kind == 1:
                self.byte_ids[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif kind == 2:
                self.raw.append("⁇".encode() if piece == "<unk>" else b"")
            else:
                self.raw.append(piece.replace(SPACE, " ").encode())
                keys.append(piece)
                ids.append(i)
                weights.append(-SHARPNESS * math.log(rank + RANK_SHIFT))
                rank += 1
                self.longest = max(self.longest, len(piece))
        whole = set(keys)  # beginnings of pieces stand in the table too, without an id: what isn't there needs no longer look
        for start in sorted({k[:n] for k in keys for n in range(1, len(k))} - whole):
            keys.append(start)
            ids.append(-1)
            weights.append(0.0)
        self.ids, self.weights = np.array([*ids, -1], np.int32), np.array([*weights, 0.0])
        self.sizes = np.array([len(r) for r in self.raw], np.int64)
        self.flat, self.begin = np.frombuffer(b"".join(self.raw), np.uint8), np.cumsum(self.sizes) - self.sizes
        self.byte_weight = -SHARPNESS * (math.log(rank + RANK_SHIFT) + BYTE_COST)
        self.keys = np.append(self._hashes(keys), np.uint64(0))
        self.bits = 20
        self.tables = [np.full(1 << self.bits, -1, np.int32) for _ in range(3)]
        left = np.arange(len(keys))
        for t, slots in zip(self.tables, self._slots(self.keys[:-1]), strict=True):
            slot = slots[left]
            t[slot[::-1]] = left[::-1]  # of several keys the first stands, the others go on to the next table
            left = left[t[slot] != left]
        if left.size:
            raise ValueError("piece table is full")

    def _slots(self, h):
        m = np.uint64((1 << self.bits) - 1)
        return (h >> np.uint64(44)) & m, (h >> np.uint64(22)) & m, h & m

    @staticmethod
    def _step(h, c):
        h = (h ^ c) * _A
        return h ^ (h >> np.uint64(32))

    @classmethod
    def _hashes(cls, pieces: list[str]) -> np.ndarray:
        """The hash of every piece, one step for each character of the longest."""
        sizes, points = np.array([len(p) for p in pieces], np.int64), code_points("".join(pieces))
        begin, h = np.cumsum(sizes) - sizes, np.zeros(sizes.size, np.uint64)
        for n in range(int(sizes.max(initial=0))):
            left = np.flatnonzero(sizes > n)
            with np.errstate(over="ignore"):
                h[left] = cls._step(h[left], points[begin[left] + n])
        return h

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index into ids and weights for each hash, -1 where no piece has it."""
        out = np.full(h.size, -1, np.int32)
        left = None
        for t, slot in zip(self.tables, self._slots(h), strict=True):
            at = t[slot] if left is None else t[slot[left]]
            full = np.flatnonzero(at >= 0)
            where = full if left is None else left[full]
            hit = self.keys[at[full]] == h[where]
            out[where[hit]] = at[full][hit]
            left = where[~hit]  # an empty first place means: in none
            if not left.size:
                break
        return out

    def decoded_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of a long run of ids, in one step (with the leading spaces of texts)."""
        n = self.sizes[ids]
        return self.flat[np.arange(int(n.sum())) + np.repeat(self.begin[ids] - (np.cumsum(n) - n), n)].tobytes()

    def decode(self, ids) -> str:
        """The text of a sequence of ids."""
        raw = self.raw
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


class Lattice:
    """All distinct units of a slice: nodes are places in units, edges pieces, with conditional probabilities.

    Nodes are numbered by how many characters remain to their unit's end, then
    by unit, longest first; so the backward pass is one contiguous step for each number of remaining characters.
    """

    def __init__(self, text: str, sizes: np.ndarray, vocabulary: Vocabulary):
        """text: all units in a row, ``sizes`` of each (in characters)."""
        v, units = vocabulary, sizes.size
        order = np.argsort(-sizes, kind="stable")
        place = np.empty(units, np.int64)
        place[order] = np.arange(units)
        length = sizes[order]
        longest = int(length[0]) if units else 0
        at_level = units - np.searchsorted(length[::-1], np.arange(longest + 1))  # units with so many characters
        base = np.concatenate([[0], np.cumsum(at_level)])
        nodes = int(base[-1])
        level = np.repeat(np.arange(longest + 1, dtype=np.int32), at_level)
        unit = (np.arange(nodes) - base[level]).astype(np.int32)
        self.first = base[sizes] + place if units else np.zeros(0, np.int64)
        points = code_points(text)
        begin = (np.cumsum(sizes) - sizes)[order]
        char = (begin[unit] + length[unit] - level).astype(np.int32)
        char[: base[1] if nodes else 0] = points.size - 1
        alive = np.arange(int(base[1]) if nodes else 0, nodes)
        h = np.zeros(alive.size, np.uint64)
        found: list[tuple] = []
        for n in range(1, v.longest + 1):
            short = int(np.searchsorted(alive, base[min(n, longest + 1)]))  # levels stand in order
            alive, h = alive[short:], h[short:]
            if not alive.size:
                break
            with np.errstate(over="ignore"):
                h = v._step(h, points[char[alive] + n - 1])
            got = v.find(h)
            hit = np.flatnonzero((got >= 0) & (v.ids[got] >= 0))
            found.append((alive[hit], n, got[hit]))
            if n == 1:
                bare = alive[(got < 0) | (v.ids[got] < 0)]
                found.append((bare, 1, np.full(bare.size, -1, np.int32)))
            more = np.flatnonzero(got >= 0)  # the rest begins no piece
            alive, h = alive[more], h[more]
        found.reverse()
        degree = np.zeros(nodes, np.int16)
        for starts, *_ in found:
            degree[starts] += 1  # a list has a node once at most
        self.ptr = np.concatenate([[0], np.cumsum(degree, dtype=np.int64)])
        edges = int(self.ptr[-1])
        entry, size = np.empty(edges, np.int32), np.empty(edges, np.int16)
        free = self.ptr[:-1].copy()
        for starts, n, entries in found:  # longest pieces first at each node
            at = free[starts]
            free[starts] += 1
            entry[at], size[at] = entries, n
        self.start, self.piece, weight = np.repeat(np.arange(nodes, dtype=np.int32), degree), v.ids[entry], v.weights[entry]
        self.end = base.astype(np.int32)[np.repeat(level, degree) - size] + np.repeat(unit, degree)
        other = np.flatnonzero(entry < 0)
        code = points[char[self.start[other]]] - np.uint64(1)
        weight[other] = v.byte_weight * (1 + (code > 0x7F).astype(int) + (code > 0x7FF) + (code > 0xFFFF))
        beta = np.zeros(nodes)
        for m in range(1, longest + 1):
            lo, hi = self.ptr[base[m]], self.ptr[base[m + 1]]
            heads = self.ptr[base[m] : base[m + 1]] - lo
            s = weight[lo:hi] + beta[self.end[lo:hi]]
            top = np.maximum.reduceat(s, heads)
            beta[base[m] : base[m + 1]] = top + np.log(np.add.reduceat(np.exp(s - np.repeat(top, degree[base[m] : base[m + 1]])), heads))
        self.log_p = np.minimum(weight + beta[self.end] - beta[self.start], 0.0)
        self.cum = np.exp(self.log_p)
        more, nth = np.flatnonzero(degree > 1), 1
        while more.size:  # node by node, so that no sum depends on the units beside
            at = self.ptr[more] + nth
            self.cum[at] += self.cum[at - 1]
            nth += 1
            more = more[degree[more] > nth]
        self.cum[self.ptr[1:][degree > 0] - 1] = 2.0
        self.terminal = level == 0
        self.choice = np.repeat(degree > 1, degree)
        self.code = (points[char] - np.uint64(1)).astype(np.uint32)

    def draw(self, cur: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Free continuation of every walk from its node to its unit's end: edges of all walks in order, and their numbers."""
        active = np.flatnonzero(~self.terminal[cur])
        counts = np.zeros(cur.size, np.int64)
        steps, step = [], 0
        node = cur[active]
        while active.size:
            with np.errstate(over="ignore"):
                u = uniforms(base[active] + np.uint64(step + 1) * _B)
            e = self.ptr[node]
            m = np.flatnonzero(u > self.cum[e])
            while m.size:
                e[m] += 1
                m = m[u[m] > self.cum[e[m]]]
            steps.append((active, e))
            counts[active] += 1
            node = self.end[e]
            go = ~self.terminal[node]
            active, node = active[go], node[go]
            step += 1
        offset = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.int64)
        for i, (who, e) in enumerate(steps):
            out[offset[who] + i] = e
        return out, counts


class Sample:
    """One segmentation: its edges and its perturbed log probability."""

    __slots__ = ("edges", "log_prob", "perturbed")

    def __init__(self, edges: np.ndarray, log_prob: float, perturbed: float):
        self.edges, self.log_prob, self.perturbed = edges, log_prob, perturbed


class Encoder:
    """Draws k segmentations of each of a list of texts."""

    def __init__(self, pieces: list[tuple[str, int]], k: int = SAMPLES, seed: int = SEED):
        self.v, self.k, self.seed = Vocabulary(pieces), k, seed

    def lattice(self, texts: list[str | None]) -> tuple[Lattice, np.ndarray, np.ndarray]:
        """The slice's lattice, the unit of every occurrence, and where each text's occurrences begin."""
        parts: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
        plain = [i for i, t in enumerate(texts) if t and "  " not in t and SPACE not in t]
        try:
            split = pc.split_pattern(pa.array([texts[i] for i in plain], pa.string()), " ")
        except UnicodeEncodeError:  # half a surrogate pair
            plain, split = [], pa.array([], pa.list_(pa.string()))
        words = split.flatten().dictionary_encode()
        units = pc.binary_join_element_wise(SPACE, words.dictionary, "")  # they never become one object each
        cuts = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))[:-1]
        for i, part in zip(plain, np.split(words.indices.to_numpy(zero_copy_only=False).astype(np.int64), cuts), strict=False):
            parts[i] = part
        known: defaultdict[str, int] = defaultdict(itertools.count(len(units)).__next__)  # other texts' units, without their first space -> number
        for i in sorted(set(range(len(texts))).difference(plain)):
            if t := texts[i]:
                t = t.replace(SPACE, LITERAL)
                found = [u[1:] for u in UNIT.findall(SPACE + t.replace(" ", SPACE))] if "  " in t else t.split(" ")
                parts[i] = np.fromiter(map(known.__getitem__, found), np.int64, len(found))
        others = [SPACE + u for u in known]
        sizes = np.concatenate([pc.utf8_length(units).to_numpy(zero_copy_only=False), [len(u) for u in others]]).astype(np.int64)
        lattice = Lattice("".join([joined_text(units), *others]), sizes, self.v)
        return lattice, np.concatenate(parts) if parts else np.zeros(0, np.int64), np.concatenate([[0], np.cumsum([p.size for p in parts])]).astype(np.int64)

    def seeds(self, keys: list) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed(np.array([0 if k is None else int(k) & 0xFFFFFFFFFFFFFFFF for k in keys], np.uint64) * _A + np.uint64(self.seed))

    def _regions(self, heaps: list[list], lattice: Lattice, docs: list[int], flat: np.ndarray, sizes: np.ndarray, begin: np.ndarray, g: np.ndarray, taken: list[tuple], seeds: np.ndarray, rank: int) -> None:
        """Puts what remains of the taken regions of all texts on their heaps: at each place a region
        whose next piece is another one.  flat: the edges of the texts' new samples, ``sizes`` of each.
        A text is done when its rest can't matter: no bound there can exceed the least that counts."""
        wanted = self.k - rank
        off = np.cumsum(sizes) - sizes
        phi = np.array([float(lattice.log_p[flat[o : o + b]].sum()) if b else 0.0 for o, b in zip(off.tolist(), begin.tolist(), strict=True)])
        at, todo = begin.copy(), np.flatnonzero(begin < sizes)
        step = np.arange(BLOCK)
        while todo.size:
            place = at[todo, None] + step
            inside = place < sizes[todo, None]
            part = flat[np.where(inside, off[todo, None] + place, 0)]
            lp = np.where(inside, lattice.log_p[part], 0.0)
            before = np.cumsum(lp, axis=1)
            end = before[:, -1] + phi[todo]
            before += phi[todo, None] - lp
            rest = -np.expm1(lp)
            free = lattice.choice[part]
            for i in np.flatnonzero(at[todo] == begin[todo]).tolist():
                if used := taken[todo[i]]:
                    rest[i, 0] -= np.exp(lattice.log_p[list(used)]).sum()
                    node = lattice.start[part[i, 0]]
                    free[i, 0] = lattice.ptr[node + 1] - lattice.ptr[node] > 1 + len(used)
            r, c = np.nonzero(inside & free & (rest > 1e-13))
            with np.errstate(over="ignore"):
                u = uniforms(seeds[todo[r]] + np.uint64(rank) * _C + (place[r, c] + 1).astype(np.uint64) * _A)
            bound = np.full(part.shape, -np.inf)
            bound[r, c] = -np.logaddexp(np.log(-np.log(u)) - before[r, c] - np.log(rest[r, c]), -g[todo[r]])
            best = np.argpartition(-bound, wanted - 1, axis=1)[:, :wanted]
            least = np.full(todo.size, -np.inf)
            for i, (d, columns, bounds) in enumerate(zip(todo.tolist(), best.tolist(), np.take_along_axis(bound, best, 1).tolist(), strict=True)):
                heap = heaps[docs[d]]
                for col, b in zip(columns, bounds, strict=True):
                    if b > -math.inf:
                        e, where = int(part[i, col]), int(place[i, col])
                        heap.append((-b, rank, where, (*taken[d], e) if where == begin[d] else (e,)))
                heap.sort()
                del heap[wanted:]
                if len(heap) == wanted:
                    least[i] = -heap[-1][0]
            phi[todo] = end
            at[todo] += BLOCK
            todo = todo[(at[todo] < sizes[todo]) & (end + GUMBEL_MOST >= least)]

    def __call__(self, keys: list, texts: list[str | None]) -> tuple[Lattice, list[list[Sample]], list[float]]:
        """For each text its samples in order of perturbed log probability, and kappa."""
        lattice, units, begin = self.lattice(texts)
        n, seeds = len(texts), self.seeds(keys)
        owner = np.repeat(np.arange(n), np.diff(begin))
        place = (np.arange(units.size) - begin[owner]).astype(np.uint64)
        heaps: list[list] = [[] for _ in range(n)]
        samples: list[list[Sample]] = [[] for _ in range(n)]
        with np.errstate(over="ignore"):
            roots = -np.log(-np.log(uniforms(seeds * _B + _C)))
        cur = lattice.first[units]
        docs, heads, at, g, taken = list(range(n)), [], np.zeros(n, np.int64), roots, [()] * n
        for rank in range(self.k):
            start = cur
            if rank:
                docs = [d for d in docs if heaps[d]]
                if not docs:
                    break
                with np.errstate(over="ignore"):
                    draws = uniforms(seeds[docs] * _C + np.uint64(rank) * _A).tolist()
                chosen = [heaps[d].pop(0) for d in docs]
                heads = []
                live = np.zeros(n, bool)
                live[docs] = True
                start, begins = cur.copy(), begin[:-1].copy()  # begins: the first unit of each text that is drawn anew
                for d, u, (_, parent, where, used) in zip(docs, draws, chosen, strict=True):
                    edges = samples[d][parent].edges
                    node = lattice.start[edges[where]]
                    options = [o for o in range(int(lattice.ptr[node]), int(lattice.ptr[node + 1])) if o not in used]
                    p = np.cumsum(np.exp(lattice.log_p[options]))
                    e = options[min(int(np.searchsorted(p, u * p[-1])), len(options) - 1)]
                    head = edges[: where + 1].copy()
                    head[where] = e
                    heads.append(head)
                    begins[d] += np.count_nonzero(lattice.terminal[lattice.end[head[:where]]])
                    start[begins[d]] = lattice.end[e]
                start[(np.arange(units.size) < begins[owner]) | ~live[owner]] = 0  # a unit's end
                at, g, taken = np.array([c[2] for c in chosen], np.int64), np.array([-c[0] for c in chosen]), [c[3] for c in chosen]
            with np.errstate(over="ignore"):
                base = seeds[owner] + np.uint64(rank + 1) * _C + (place + np.uint64(1)) * _A
            edges, counts = lattice.draw(start, mixed(base))
            total = np.concatenate([[0], np.cumsum(counts)])[begin].tolist()
            for i, d in enumerate(docs):
                tail = edges[total[d] : total[d + 1]]
                whole = np.concatenate([heads[i], tail]) if rank else tail
                samples[d].append(Sample(whole, float(lattice.log_p[whole].sum()), float(g[i])))
            new = [samples[d][-1].edges for d in docs]
            self._regions(heaps, lattice, docs, np.concatenate(new) if new else edges, np.array([e.size for e in new], np.int64), at, g, taken, seeds[docs], rank)
        return lattice, samples, [-h[0][0] if h else -math.inf for h in heaps]

    def ids(self, lattice: Lattice, edges: np.ndarray, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of edges, characters without a piece spelled in bytes; and where each run of
        edges (``ends``) then ends."""
        ends = np.array([edges.size]) if ends is None else ends
        ids = lattice.piece[edges]
        bare = np.flatnonzero(ids < 0)
        if not bare.size:
            return ids, ends
        spelled = [(SPACE if c == LITERAL else c).encode("utf-8", "surrogatepass") for c in map(chr, lattice.code[lattice.start[edges[bare]]].tolist())]
        n = np.ones(ids.size, np.int64)
        n[bare] = [len(b) for b in spelled]
        out = np.repeat(ids, n)
        out[out < 0] = self.v.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
        return out, np.concatenate([[0], np.cumsum(n)])[ends]


def inclusion(log_prob: float, kappa: float) -> float:
    """Probability that a segmentation is among those over the threshold."""
    return 1.0 if kappa == -math.inf else -math.expm1(-math.exp(min(50.0, log_prob - kappa)))


def encode_samples(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = SAMPLES, seed: int = SEED, model: str = MODEL, with_ids: bool = True, slice_bytes: int = SLICE) -> DataFrame:
    """key, and arrays over the samples: ids (null without ``with_ids``), ids_sha256 (of the
    little-endian 32-bit ids), n_tokens, log_prob, perturbed, inclusion; and whether every
    sample decodes to the text (``round_trip``).  ``slice_bytes`` of text share a lattice: more
    of them cost less time and more memory."""
    pieces = df.sparkSession.sparkContext.broadcast(load_pieces(model))  # a vocabulary of fixed size

    def make():
        encoder = Encoder(pieces.value, k, seed)

        def f(x):
            lattice, samples, kappas = encoder(x["k"], x["text"])
            n = len(samples)
            out: dict[str, list] = {c: [[] for _ in range(n)] for c in ("ids", "sha", "n", "lp", "g", "inc")} | {"ok": [True] * n}
            wanted = [b" " + t.encode("utf-8", "surrogatepass") if t else b"" for t in x["text"]]
            for rank in range(k):
                docs = [d for d in range(n) if len(samples[d]) > rank]
                if not docs:
                    break
                edges = [samples[d][rank].edges for d in docs]
                ids, ends = encoder.ids(lattice, np.concatenate(edges), np.cumsum([e.size for e in edges]))
                raw, sizes = encoder.v.decoded_bytes(ids), np.concatenate([[0], np.cumsum(encoder.v.sizes[ids])])[np.concatenate([[0], ends])].tolist()
                ids, ends = ids.astype("<i4"), [0, *ends.tolist()]
                for i, d in enumerate(docs):
                    own, s = ids[ends[i] : ends[i + 1]], samples[d][rank]
                    out["ids"][d].append(own)
                    out["sha"][d].append(hashlib.sha256(own.tobytes()).hexdigest())
                    out["n"][d].append(own.size)
                    out["lp"][d].append(s.log_prob)
                    out["g"][d].append(s.perturbed)
                    out["inc"][d].append(inclusion(s.log_prob, kappas[d]))
                    out["ok"][d] &= raw[sizes[i] : sizes[i + 1]] == wanted[d]
            if not with_ids:
                out["ids"] = [None] * n
            return {"k": x["k"]} | out

        return f

    kind = df.schema[key].dataType.simpleString()
    return map_slices(df.select(F.col(key).alias("k"), F.col(text).alias("text")), "text", make, f"k {kind}, ids array<array<int>>, ids_sha256 array<string>, n_tokens array<int>, log_prob array<double>, perturbed array<double>, inclusion array<double>, round_trip boolean", slice_bytes).withColumnRenamed("k", key)


def decode_ids(df: DataFrame, ids: str, out: str = "text", model: str = MODEL) -> DataFrame:
    """All columns of ``df`` and the decoded text of an array<int> column (null stays null)."""
    pieces = df.sparkSession.sparkContext.broadcast(load_pieces(model))
    names = df.columns

    def make():
        v = Vocabulary(pieces.value)
        return lambda x: {c: x[c] for c in names} | {"_text": [None if i is None else v.decode(i) for i in x[ids]]}

    sized = df.withColumn("_size", F.col(ids).cast("string"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return map_slices(sized, "_size", make, f"{fields}, _text string").withColumnRenamed("_text", out)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sampled segmentations of every whole text, by digest, with scores."""
    out = encode_samples(table(spark, sf_dir, "documents"), with_ids=False)
    return out.select("doc_id", F.size("n_tokens").cast("long").alias("n_samples"), "n_tokens", "ids_sha256", "log_prob", "perturbed", "inclusion", "round_trip")
