"""SentencePiece encoding and decoding: Gumbel top-k segmentations without replacement.

A text's lattice has an edge for every vocabulary piece that occurs in it; characters
without a piece of their own are one edge of byte pieces.  Pieces weigh by Zipf's law of
their rank in the vocabulary (the file's merge order), so every path has a probability.
A perturbed A-star search gives the ``k`` paths of greatest Gumbel-perturbed
log-probability: the agenda holds sets of paths that agree up to one lattice node and
leave it by none of the edges already taken there; each set carries the maximum of its
paths' Gumbels, drawn below the maximum of the set it was split from.  The greatest is
popped and followed down exactly by forward filtering and backward sampling.  The
greatest Gumbel left on the agenda is the threshold of the inclusion scores
``log P(path is among the k) = log(1 - exp(-exp(log_prob - threshold)))``.

No piece crosses the start of a run of blanks, so the lattice is a chain of short units
and equal units share one table.  All draws are hashes of (seed, row key, path, place),
so they do not depend on partitioning.  Blanks are written as U+2581; a U+2581 of the
text itself goes to byte pieces, so decoding gives every text back exactly.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass
from itertools import chain, count, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shingles import mix64
from quire.session import trim_memory

BLANK = "▁"
CHUNK = 100_000
#: Units whose tables are kept; when there are more, the quarter used most stays.
LEXICON = 60_000
#: Characters whose tables are filled at once.
STRETCH = 1 << 15
#: UTF-8 bytes up to which a unit's scaled probabilities stay in range.
_SHORT = 48
_SCALE = 3.0
#: -log(-log(u)) of a 53-bit uniform is below this.
_TOP_GUMBEL = 36.75
_NEAR = -40.0
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)

Samples = list[tuple[int, float, float, float, np.ndarray]]


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id, ``None`` for control ids; ``byte_ids[b]`` is the id of byte ``b``."""

    pieces: tuple[str | None, ...]
    byte_ids: tuple[int, ...]


def load_vocabulary(path: str) -> Vocabulary:
    """Read the pieces of a SentencePiece model file with byte fallback, on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    byte_ids = [-1] * 256
    pieces: list[str | None] = []
    for k in range(n):
        special = model.is_control(k) or model.is_unknown(k) or model.is_byte(k)
        pieces.append(None if special else model.id_to_piece(k))
        if model.is_byte(k):
            byte_ids[int(model.id_to_piece(k)[3:5], 16)] = k
    if min(byte_ids) < 0:
        raise ValueError("the model has no byte pieces: texts could not be encoded exactly")
    return Vocabulary(tuple(pieces), tuple(byte_ids))


class _Growing:
    """Arrays of one length that grow by doubling."""

    def __init__(self, **kinds):
        self.n, self.at = 0, {k: np.empty(1024, dtype=v) for k, v in kinds.items()}

    def extend(self, **values) -> None:
        size = len(next(iter(values.values())))
        for k, v in values.items():
            if self.n + size > len(self.at[k]):
                old = self.at[k]
                self.at[k] = np.empty(max(2 * len(old), self.n + size), dtype=old.dtype)
                self.at[k][:self.n] = old[:self.n]
            self.at[k][self.n:self.n + size] = v
        self.n += size

    def keep(self, rows: np.ndarray) -> None:
        """Only these rows, in the same arrays unless they are far too long."""
        for k, v in self.at.items():
            kept = v[rows]
            if len(v) > 16 * len(rows):
                self.at[k] = kept
            else:
                v[:len(rows)] = kept
        self.n = len(rows)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after another."""
    end = np.cumsum(size)
    return np.repeat(start - (end - size), size) + np.arange(end[-1] if len(end) else 0)


def _utf8_width(code: np.ndarray) -> np.ndarray:
    return 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)


class Lattice:
    """The vocabulary's trie by hash, and the tables of the units met so far."""

    def __init__(self, vocabulary: Vocabulary, theta: float = 1.0):
        pieces = [(k, p) for k, p in enumerate(vocabulary.pieces) if p]
        for _, p in pieces:
            if BLANK in p.lstrip(BLANK):
                raise ValueError("a piece has a blank after another character")
        self._solo = not any("\n" in p and len(p) > 1 for _, p in pieces)
        self._units = re.compile(r" *[^ \n]+|\n| +" if self._solo else r" *[^ ]+| +").findall
        weight = -theta * np.log(np.arange(1, len(vocabulary.pieces) + 1) + 9.0)
        self.logp = weight - np.logaddexp.reduce(weight)
        self.byte_logp = float(self.logp[-1])
        self.longest = max((len(p) for _, p in pieces), default=1)
        prefixes: dict[int, int] = {}
        for k, p in pieces:
            h = 0
            for n, c in enumerate(p, 1):
                h = (h * int(_ODD) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
                prefixes[h] = k if n == len(p) else prefixes.get(h, -1)
        self.keys = np.array(sorted(prefixes), dtype=np.uint64)
        self.ids = np.array([prefixes[int(h)] for h in self.keys], dtype=np.int32)
        self._bits = np.uint64(64 - 19)
        slot = (self.keys * _STEP) >> self._bits
        self._slots = np.full(1 << 19, -1, dtype=np.int32)
        self._slots[slot[::-1]] = np.arange(len(self.keys) - 1, -1, -1)
        several = np.bincount(slot.astype(np.int64), minlength=1 << 19) > 1
        self._crowded = several
        self.byte_ids = np.array(vocabulary.byte_ids, dtype=np.int32)
        raw = [b"" if p is None else p.replace(BLANK, " ").encode() for p in vocabulary.pieces]
        for b, k in enumerate(vocabulary.byte_ids):
            raw[k] = bytes([b])
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.raw_size = np.array([len(x) for x in raw], dtype=np.int64)
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        self.forget()

    def units(self, text: str) -> list[str]:
        """A run of blanks with the word after it, or a line end if no longer piece has one."""
        if not self._solo or "  " in text or " \n" in text or "\0" in text:
            return self._units(text)
        marked = text.replace(" ", "\0 ").replace("\n", "\0\n\0")
        return [u for u in marked.split("\0") if u]

    def forget(self) -> None:
        self.known: dict[str, int] = defaultdict(count().__next__)  # numbered by first sight
        self.unit = _Growing(first=np.int64, last=np.int64, uses=np.int64)
        self.node = _Growing(edge=np.int64, count=np.int32)
        self.edge = _Growing(back=np.int32, piece=np.int32, p=np.float64, cdf=np.float64)

    def shed(self) -> None:
        """Keep the quarter of the lexicon that was used most; older uses count half."""
        uses = self.unit.at["uses"][:self.unit.n]
        kept = np.sort(np.argsort(-uses, kind="stable")[:LEXICON // 4])
        names = list(self.known)
        self.known = defaultdict(count(len(kept)).__next__, zip(
            map(names.__getitem__, kept.tolist()), range(len(kept))))
        self.unit.keep(kept)
        unit, n = self.unit.at, self.unit.n
        sizes = unit["last"][:n] - unit["first"][:n] + 1
        self.node.keep(_ranges(unit["first"][:n], sizes))
        unit["last"][:n] = np.cumsum(sizes) - 1
        unit["first"][:n] = unit["last"][:n] - sizes + 1
        unit["uses"][:n] >>= 1
        node, n = self.node.at, self.node.n
        many = node["count"][:n].astype(np.int64)
        self.edge.keep(_ranges(node["edge"][:n], many))
        node["edge"][:n] = np.cumsum(many) - many

    def number(self, units, size: int) -> np.ndarray:
        """Numbers of these units; the tables of new ones are added."""
        found = np.fromiter(map(self.known.__getitem__, units), dtype=np.int64, count=size)
        fresh = len(self.known) - self.unit.n
        if fresh:
            self.learn(list(islice(reversed(self.known), fresh))[::-1])
        self.unit.at["uses"][:self.unit.n] += np.bincount(found, minlength=self.unit.n)
        return found

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Index in ``keys`` or -1."""
        slot = ((h * _STEP) >> self._bits).astype(np.int64)
        at = self._slots[slot]
        hit = (at >= 0) & (self.keys[at] == h)
        more = np.flatnonzero(~hit & self._crowded[slot])
        at = np.where(hit, at, -1)
        if len(more):
            k = np.searchsorted(self.keys, h[more])
            k[k == len(self.keys)] = 0
            at[more] = np.where(self.keys[k] == h[more], k, -1)
        return at

    def learn(self, units: list[str]) -> None:
        """Add the tables of new distinct units, longest first within a stretch."""
        sizes = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        code = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        begin = np.cumsum(sizes) - sizes
        limit = min(_SHORT, int(600 / -self.byte_logp))
        plain = np.add.reduceat(_utf8_width(code), begin) <= limit
        first = np.empty(len(units), dtype=np.int64)
        for short in (True, False):
            part = np.flatnonzero(plain == short)
            part = part[np.argsort(-sizes[part], kind="stable")]
            stretch = np.cumsum(sizes[part]) // STRETCH
            for some in np.split(part, np.flatnonzero(np.diff(stretch)) + 1):
                if len(some):
                    first[some] = self._learn(code[_ranges(begin[some], sizes[some])],
                                              sizes[some], short)
        self.unit.extend(first=first, last=first + sizes, uses=np.zeros(len(units), dtype=np.int64))

    def _learn(self, text_code: np.ndarray, sizes: np.ndarray, plain: bool) -> np.ndarray:
        """First nodes of units of falling size; ``plain``: scaled probabilities stay in range."""
        code = text_code.astype(np.uint64)
        own_blank = text_code == ord(BLANK)
        code[text_code == 32] = ord(BLANK)
        code[own_blank] = 0x110000
        begin = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(sizes)), sizes)
        left = (begin + sizes)[owner] - np.arange(len(code))  # characters from here to the unit's end
        at = np.arange(len(code))
        h = np.zeros(len(code), dtype=np.uint64)
        start, length, piece = [], [], []
        single = np.zeros(len(code), dtype=bool)
        for n in range(1, self.longest + 1):
            if n > 1:
                inside = np.flatnonzero(left[at] >= n)
                at, h = at[inside], h[inside]
            if not len(at):
                break
            h = h * _ODD + code[at + (n - 1)] + np.uint64(1)
            found = self._find(h)
            alive = np.flatnonzero(found >= 0)
            at, h = at[alive], h[alive]
            ids = self.ids[found[alive]]
            whole = np.flatnonzero(ids >= 0)
            start.append(at[whole])
            length.append(np.full(len(whole), n))
            piece.append(ids[whole])
            if n == 1:
                single[start[0]] = True
        lost = np.flatnonzero(~single)  # byte pieces: the edge keeps the character itself
        c = text_code[lost].astype(np.int32)
        logp = np.concatenate([self.logp[x] for x in piece] + [_utf8_width(c) * self.byte_logp])
        start.append(lost)
        length.append(np.ones(len(lost), dtype=np.int64))
        piece.append(-1 - c)
        start, length, piece = map(np.concatenate, (start, length, piece))
        fill = self._fill_plain if plain else self._fill_long
        target, length, piece, p, cdf = fill(sizes, begin, owner, start, length, piece, logp)
        first = np.flatnonzero(np.diff(target, prepend=-1))
        many = np.diff(np.append(first, len(target)))
        cdf[first + many - 1] = 2.0  # the last edge takes what rounding leaves
        node0, edge0 = self.node.n, self.edge.n
        node_edge = np.zeros(len(code) + len(sizes), dtype=np.int64)
        node_count = np.zeros(len(node_edge), dtype=np.int32)
        node_edge[target[first]] = edge0 + first
        node_count[target[first]] = many
        self.edge.extend(back=length, piece=piece, p=p, cdf=cdf)
        self.node.extend(edge=node_edge, count=node_count)
        return node0 + begin + np.arange(len(sizes))

    @staticmethod
    def _fill_plain(sizes, begin, owner, start, length, piece, logp):
        """Edges by place, node and length: (node, length, piece, p, cdf).

        A node is a row of cells, one for each length; the nodes at one place of all units
        that reach it stand together.  A unit of n characters has n + 1 nodes.
        """
        longest, width = int(sizes[0]), int(length.max())
        reach = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")
        row0 = np.cumsum(reach) - reach
        who = owner[start]
        cell = (row0[start - begin[who] + length - 1] + who) * width + (length - 1)
        # every path of a unit is scaled alike, once a character
        mass = np.zeros(int(reach.sum()) * width)
        mass[cell] = np.exp(logp + _SCALE * length)
        cells = np.flatnonzero(mass)
        named = np.empty(len(mass), dtype=np.int32)
        named[cell] = piece
        mass = mass.reshape(-1, width)
        alpha = np.zeros((len(sizes), longest + width))  # by falling place
        alpha[:, longest] = 1.0
        for place, lo, many in zip(range(1, longest + 1), row0.tolist(), reach.tolist()):
            here = mass[lo:lo + many]
            column = longest - place
            here *= alpha[:many, column + 1:column + 1 + width]
            total = here.sum(axis=1)
            alpha[:many, column] = total
            here /= total[:, None]
        p = mass.ravel()[cells]
        cdf = np.cumsum(mass, axis=1).ravel()[cells]
        row, length = np.divmod(cells, width)
        who = np.arange(len(mass)) - np.repeat(row0, reach)
        node = (begin + np.arange(len(sizes)))[who] + np.repeat(np.arange(1, longest + 1), reach)
        return node[row], length + 1, named[cells], p, cdf

    @staticmethod
    def _fill_long(sizes, begin, owner, start, length, piece, logp):
        """As ``_fill_plain``, in logarithms and without empty cells."""
        n_nodes = len(owner) + len(sizes)
        place = start - begin[owner[start]] + length
        target = start + owner[start] + length
        order = np.lexsort((length, target, place))
        length, piece, logp, place, target = (
            x[order] for x in (length, piece, logp, place, target))
        source = target - length
        alpha = np.zeros(n_nodes)
        p = np.empty(len(order))
        cdf = np.empty(len(order))
        bounds = np.flatnonzero(np.diff(place, prepend=-1))
        for lo, hi in zip(bounds, np.append(bounds[1:], len(order))):
            node = target[lo:hi]
            first = np.flatnonzero(np.diff(node, prepend=-1))
            many = np.diff(np.append(first, hi - lo))
            v = logp[lo:hi] + alpha[source[lo:hi]]
            top = np.maximum.reduceat(v, first)
            e = np.exp(v - np.repeat(top, many))
            total = np.add.reduceat(e, first)
            alpha[node[first]] = top + np.log(total)
            p[lo:hi] = e / np.repeat(total, many)
            run = np.cumsum(p[lo:hi])
            cdf[lo:hi] = run - np.repeat(run[first] - p[lo:hi][first], many)
        return target, length, piece, p, cdf

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.raw_size[ids]
        end = np.cumsum(size)
        if not len(end) or not end[-1]:
            return b""
        return self.raw[_ranges(self.raw_at[ids], size)].tobytes()

    def decode_rows(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """Bytes of each row of ids; ``sizes``: 0, then their lengths."""
        back = self.decode(ids)
        ends = np.concatenate([[0], np.cumsum(self.raw_size[ids])])[np.cumsum(sizes)].tolist()
        return [back[lo:hi] for lo, hi in zip(ends, ends[1:])]


_LATTICES: dict[tuple[Vocabulary, float], Lattice] = {}


def _lattice(vocabulary: Vocabulary, theta: float) -> Lattice:
    key = (vocabulary, theta)
    if key not in _LATTICES:
        _LATTICES.clear()
        _LATTICES[key] = Lattice(vocabulary, theta)
    return _LATTICES[key]


def _uniform(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """53-bit uniforms in (0, 1) by key and place."""
    bits = mix64(key + place.astype(np.uint64) * _STEP) >> np.uint64(11)
    return np.minimum((bits.astype(np.float64) + 0.5) * 2.0 ** -53, 1 - 2.0 ** -53)


_PLACE = np.int64(1 << 20)


@dataclass
class _Paths:
    """One path for each of some documents: edges in sampling order (units left to right,
    each from its end), the log-probability before each, and the Gumbel maxima of the
    sets of paths that leave it at each place (-inf: none, taken, or another path's)."""

    token: np.ndarray
    step: np.ndarray
    node: np.ndarray
    edge: np.ndarray
    bounds: np.ndarray
    before: np.ndarray
    own: np.ndarray            # first place of each document whose sets belong to this path
    rest: dict[int, float]     # mass left at that place, where edges had been taken before
    near: np.ndarray           # places whose Gumbels are drawn, and their values
    value: np.ndarray
    far: np.ndarray            # documents with places left out, to be drawn if need be
    forced: np.ndarray
    taken: dict[int, list[int]]


def _walk(lattice: Lattice, token: np.ndarray, unit: np.ndarray, node: np.ndarray,
          step: np.ndarray, key: np.ndarray, place: np.ndarray):
    """Sample edges from ``node`` back to the start of each unit: (token, step, node, edge)."""
    back, cdf = lattice.edge.at["back"], lattice.edge.at["cdf"]
    first_edge, home = lattice.node.at["edge"], lattice.unit.at["first"][unit]
    out: list[list[np.ndarray]] = [[], [], [], []]
    while True:
        live = np.flatnonzero(node > home)
        if not len(live):
            break
        if len(live) < len(node):
            token, node, home, step, key, place = (
                x[live] for x in (token, node, home, step, key, place))
        e = first_edge[node]
        u = _uniform(key, place * _PLACE + step)
        on = np.flatnonzero(u > cdf[e])
        while len(on):
            e[on] += 1
            on = on[u[on] > cdf[e[on]]]
        for x, y in zip(out, (token, step, node, e)):
            x.append(y)
        node = node - back[e]
        step = step + 1
    none = [np.empty(0, dtype=np.int64)]
    return [np.concatenate(x or none) for x in out]


def _ids(lattice: Lattice, paths: _Paths) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all documents in text order, and each document's bounds among them."""
    ends = np.flatnonzero(np.diff(paths.token, append=-1))  # places of each unit's last step
    many = np.diff(ends, prepend=-1)
    at = np.arange(len(paths.token))
    piece = lattice.edge.at["piece"][paths.edge[
        np.repeat(2 * ends - many + 1, many) - at]].astype(np.int64)
    lost = np.flatnonzero(piece < 0)
    if not len(lost):
        return piece.astype(np.int32), paths.bounds
    c = -1 - piece[lost]
    width = _utf8_width(c)
    many = np.ones(len(piece), dtype=np.int64)
    many[lost] = width
    ends = np.concatenate([[0], np.cumsum(many)])
    ids = np.repeat(piece, many)
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])
    for b in range(4):
        some = width > b
        w, x = width[some], c[some] >> (6 * (width[some] - 1 - b))
        ids[ends[lost[some]] + b] = lattice.byte_ids[
            (lead[w] | x) if b == 0 else (0x80 | (x & 0x3F))]
    return ids.astype(np.int32), ends[paths.bounds]


def _gumbels(lattice: Lattice, paths: _Paths, slots: np.ndarray, doc: np.ndarray,
             top: np.ndarray, key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Gumbel maxima of the sets that leave at these places, below their document's current one."""
    p, node = lattice.edge.at["p"][paths.edge[slots]], paths.node[slots]
    with np.errstate(divide="ignore"):
        mass = np.where(lattice.node.at["count"][node] > 1, np.log1p(-np.minimum(p, 1.0)), -np.inf)
        if paths.rest:
            for k in np.flatnonzero(slots == paths.forced[doc]).tolist():
                left = paths.rest.get(int(doc[k]))
                if left is not None:
                    mass[k] = np.log(left) if left > 0 else -np.inf
    mass[slots < paths.own[doc]] = -np.inf
    u = _uniform(key[doc], place[paths.token[slots]] * _PLACE + paths.step[slots])
    g = paths.before[slots] + mass - np.log(-np.log(u))
    return -np.logaddexp(-top[doc], -g)


def sample_texts(lattice: Lattice, texts: list[str], keys: np.ndarray, k: int) -> list[Samples]:
    """Up to ``k`` distinct segmentations per text, by falling perturbed log-probability."""
    n_docs = len(texts)
    if len(lattice.known) > LEXICON:
        lattice.shed()
    split = [lattice.units(t) for t in texts]
    counts = np.fromiter(map(len, split), dtype=np.int64, count=n_docs)
    unit = lattice.number(chain.from_iterable(split), int(counts.sum()))
    doc = np.repeat(np.arange(n_docs), counts)
    place = np.arange(len(unit)) - (np.cumsum(counts) - counts)[doc]
    last = lattice.unit.at["last"][unit]
    p_of, back = lattice.edge.at["p"], lattice.edge.at["back"]
    first_edge, n_edges = lattice.node.at["edge"], lattice.node.at["count"]
    starts_of = np.concatenate([[0], np.cumsum(counts)])
    salt = [mix64(keys + np.uint64((3 * j + 1) * int(_ODD) % 2**64)) for j in range(3 * (k + 1))]
    top = -np.log(-np.log(_uniform(salt[0], np.zeros(n_docs, dtype=np.int64))))
    found: list[Samples] = [[] for _ in range(n_docs)]
    done: list[_Paths] = []
    drawn: list[tuple] = []
    live = np.ones(n_docs, dtype=bool)
    source = np.full(n_docs, -1)           # the path whose set was popped, and where
    slot = np.zeros(n_docs, dtype=np.int64)
    pick = np.zeros(n_docs, dtype=np.int64)  # the popped set among the path's drawn ones
    forced = np.full(n_docs, -1)
    taken: dict[int, list[int]] = {}
    for j in range(k):
        if not live.any():
            break
        # prefix of the path it leaves, the forced edge, then free choices
        parts: list[list[np.ndarray]] = [[], [], [], []]
        cut = np.full(n_docs, -1, dtype=np.int64)  # last token that is not sampled afresh
        starts = [[], [], [], []]                  # token, node, step of a broken unit
        for b, path in enumerate(done):
            who = np.flatnonzero(live & (source == b))
            if not len(who):
                continue
            at = slot[who]
            owner = doc[path.token]
            keep = np.zeros(n_docs, dtype=np.int64)
            keep[who] = at + 1
            some = np.flatnonzero(np.arange(len(owner)) < keep[owner])
            edge = path.edge[some].copy()
            edge[np.searchsorted(some, at)] = forced[who]
            for x, y in zip(parts, (path.token[some], path.step[some], path.node[some], edge)):
                x.append(y)
            cut[who] = path.token[at]
            starts[0].append(path.token[at])
            starts[1].append(path.node[at] - back[forced[who]])
            starts[2].append(path.step[at] + 1)
        free = np.flatnonzero(live[doc] & (np.arange(len(doc)) > cut[doc]))
        token = np.concatenate([*starts[0], free])
        node = np.concatenate([*starts[1], last[free]])
        step = np.concatenate([*starts[2], np.zeros(len(free), dtype=np.int64)])
        walked = _walk(lattice, token, unit[token], node, step, salt[3 * j + 1][doc[token]],
                       place[token])
        token, step, node, edge = (np.concatenate([*x, y]) for x, y in zip(parts, walked))
        many = np.bincount(token, minlength=len(unit))
        at = (np.cumsum(many) - many)[token] + step
        bounds = np.concatenate([[0], np.cumsum(many)])[starts_of]
        ordered = []
        for x in (token, step, node, edge):
            y = np.empty_like(x)
            y[at] = x
            ordered.append(y)
        token, step, node, edge = ordered
        run = np.concatenate([[0.0], np.cumsum(np.log(p_of[edge]))])
        before = run[:-1] - np.repeat(run[bounds[:-1]], np.diff(bounds))
        own, here, rest = bounds[:-1].copy(), np.full(n_docs, -1, dtype=np.int64), {}
        for d in np.flatnonzero(live & (source >= 0)).tolist():
            at = int(bounds[d] + slot[d] - done[source[d]].bounds[d])
            own[d] = here[d] = at
            spare = n_edges[node[at]] > len(taken[d]) + 1
            rest[d] = (1.0 - float(p_of[taken[d]].sum()) - float(p_of[edge[at]])) if spare else 0.0
        near = np.flatnonzero(before >= _NEAR)
        path = _Paths(token, step, node, edge, bounds, before, own, rest, near, near, live.copy(),
                      here, dict(taken))
        who = doc[token[near]]
        path.value = _gumbels(lattice, path, near, who, top, salt[3 * j + 2], place)
        path.far &= np.diff(bounds) > np.bincount(who, minlength=n_docs)
        done.append(path)
        log_prob = run[bounds[1:]] - run[bounds[:-1]]
        drawn.append((live.copy(), top.copy(), log_prob, *_ids(lattice, path)))
        # the greatest set left on each agenda
        best = np.full(n_docs, -np.inf)
        for b, path in enumerate(done):
            who = doc[path.token[path.near]]
            most = np.full(n_docs, -np.inf)
            np.maximum.at(most, who, path.value)
            # what is not drawn is below the bound; above it, draw all for that document
            late = np.flatnonzero(live & path.far & (np.maximum(most, best) < _NEAR + _TOP_GUMBEL))
            for d in late.tolist():
                lo, hi = path.bounds[d], path.bounds[d + 1]
                more = lo + np.flatnonzero(path.before[lo:hi] < _NEAR)
                value = _gumbels(lattice, path, more, np.full(len(more), d), drawn[b][1],
                                 salt[3 * b + 2], place)
                path.near = np.concatenate([path.near, more])
                path.value = np.concatenate([path.value, value])
                path.far[d] = False
            if len(late):
                who = doc[path.token[path.near]]
                np.maximum.at(most, who, path.value)
            better = live & (most > best)
            source[better] = b
            best[better] = most[better]
            first = np.flatnonzero(better[who] & (path.value == most[who]))
            slot[who[first]], pick[who[first]] = path.near[first], first
        live &= best > -np.inf
        top = np.where(live, best, -np.inf)  # after the last round: the threshold
        if j + 1 == k:
            break
        taken = {}
        who = np.flatnonzero(live)
        start = np.zeros(n_docs, dtype=np.int64)
        for b, path in enumerate(done):
            mine = who[source[who] == b]
            path.value[pick[mine]] = -np.inf
            start[mine] = path.bounds[mine]
        draws = _uniform(salt[3 * j + 3][who], slot[who] - start[who])
        for d, u in zip(who.tolist(), draws.tolist()):
            path, at = done[source[d]], int(slot[d])
            already = [int(path.edge[at])]
            if path.forced[d] == at:
                already += path.taken[d]
            lo = int(first_edge[path.node[at]])
            e = [x for x in range(lo, lo + int(n_edges[path.node[at]])) if x not in already]
            share = np.cumsum(p_of[e])
            forced[d] = e[min(int(np.searchsorted(share, u * share[-1])), len(e) - 1)]
            taken[d] = already
    for rank, (has, perturbed, log_prob, ids, bounds) in enumerate(drawn, 1):
        for d in np.flatnonzero(has).tolist():
            found[d].append((rank, float(perturbed[d]), float(log_prob[d]),
                             _log_inclusion(float(log_prob[d]), float(top[d])),
                             ids[bounds[d]:bounds[d + 1]]))
    return found


def _log_inclusion(log_prob: float, threshold: float) -> float:
    """log(1 - exp(-exp(log_prob - threshold))); nothing left on the agenda means certainty."""
    if threshold == -np.inf:
        return 0.0
    x = log_prob - threshold
    if x < -30:
        return x
    return float(np.log(-np.expm1(-np.exp(min(x, 700.0)))))


def _sampler(vocabulary: Vocabulary, k: int, seed: int, theta: float):
    def run(batches):
        lattice = _lattice(vocabulary, theta)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            lo = 0
            while lo < len(texts):
                hi, chars = lo, 0
                while hi < len(texts) and (hi == lo or chars + len(texts[hi]) <= CHUNK):
                    chars += len(texts[hi])
                    hi += 1
                part = texts[lo:hi]
                rows = np.array([xxhash.xxh3_64_intdigest(
                    part[i].encode() if keys[lo + i] is None else b"%d" % keys[lo + i], seed)
                    for i in range(hi - lo)], dtype=np.uint64)
                out: list[list] = [[] for _ in range(7)]
                for i, samples in enumerate(sample_texts(lattice, part, rows, k)):
                    data = part[i].encode("utf-8", "surrogatepass")
                    for rank, perturbed, log_prob, inclusion, ids in samples:
                        for x, y in zip(out, (keys[lo + i], rank, perturbed, log_prob, inclusion,
                                              data, ids)):
                            x.append(y)
                sizes = np.array([0] + [len(x) for x in out[6]], dtype=np.int64)
                flat = np.concatenate(out[6]) if out[6] else np.empty(0, dtype=np.int32)
                out[5] = [x == y for x, y in zip(out[5], lattice.decode_rows(flat, sizes))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()),
                     *[pa.array(x, pa.float64()) for x in out[2:5]],
                     pa.array(out[5], pa.bool_()),
                     pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()),
                                              pa.array(flat, pa.int32()))],
                    names=["key", "rank", "perturbed", "log_prob", "log_inclusion", "exact",
                           "ids"])
                lo = hi
        trim_memory()
    return run


def sample_segmentations(docs: DataFrame, vocabulary: Vocabulary, *, k: int = 2, seed: int = 11,
                         theta: float = 1.0, key: str = "doc_id",
                         text: str = "text") -> DataFrame:
    """``key, rank, perturbed, log_prob, log_inclusion, exact, ids``, ``k`` rows per row of ``docs``.

    ``ids`` of one row are distinct segmentations of its whole text in falling order of
    their perturbed log-probability; fewer where the text has fewer.  ``exact``: they
    decode to the text.  Null and empty texts have the one empty segmentation.  A null
    key is replaced by the text as the seed; rows of one key and text draw alike.  Other
    columns are ignored; an empty table gives no rows.  Memory follows the longest text.
    """
    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(
        _sampler(vocabulary, k, seed, theta),
        "key long, rank int, perturbed double, log_prob double, log_inclusion double, "
        "exact boolean, ids array<int>")


def decode_ids(ids, vocabulary: Vocabulary):
    """Text of an ``array<int>`` column of piece ids (null stays null)."""
    def run(column: pd.Series) -> pd.Series:
        lattice = _lattice(vocabulary, 1.0)
        return pd.Series([None if x is None else
                          lattice.decode(np.asarray(x, dtype=np.int64)).decode("utf-8", "replace")
                          for x in column], dtype=object)

    return F.pandas_udf(run, "string")(ids)
