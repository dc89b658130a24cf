"""Sampled subword segmentations without replacement, with inclusion scores; decoding.

A SentencePiece model's normalisation and pieces span a lattice over each text: an edge for
every piece that matches, weighted exp(score / temperature), and for a character in no piece
one edge of its byte pieces. A segmentation's probability is its weight over that of all.
The ``k`` segmentations drawn are the ``k`` largest of independent Gumbel-perturbed log
probabilities (Gumbel top-k: sampling without replacement), found by A* search on a tree of
subsets of segmentations instead of listing them:

* the root is the set of all; the largest value in a set of log mass m is Gumbel with
  location m, and the segmentation that has it is an independent draw by probability, so a
  node's bound is the value itself and the search never expands a node in vain;
* a node popped from the agenda gives its segmentation; the rest of its set falls into
  disjoint sets -- agree up to a step of the path, differ there -- whose masses follow from
  the edge probabilities and whose largest values are Gumbel truncated at the popped value;
  the sets of a range of steps are kept as one node and split when that is popped.

Draws are backward through the lattice, edge by edge, by probabilities from the forward
sums. Where two characters stand side by side in no piece of the vocabulary no edge reaches
across, so the lattice is a chain of short units' lattices (words, mostly): these are compiled once per distinct word (a bounded table per
worker) and walked for all words of a batch in step with numpy. The random numbers are a
hash of (seed, row key, draw, word, step): a row's samples don't depend on its batch or
on retries.

The inclusion score of a drawn segmentation, given kappa, the (k+1)-th largest value, is
the log probability that it is among those drawn: log(1 - exp(-exp(log p - kappa))). A
text with ``k`` segmentations or fewer gives them all, with score 0.

A null text is an empty one; an empty text has one segmentation, without pieces. A null key
is a key like any other for the random numbers; repeated rows get equal samples. Whole
texts are segmented. An empty table gives an empty one. Other columns are not read."""

from __future__ import annotations

import heapq
import math
import zlib
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .search import _ranges as ranges
from .token_files import batches_of

SPACE = "▁"
WORDS_KEPT = 400_000
_LOW64 = (1 << 64) - 1
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xDA942042E4DD58B5)
SAMPLES = "doc_id long, sample int, n_tokens long, ids_crc32 long, log_prob double, log_inclusion double, decodes boolean"


def _pairs(chars) -> np.ndarray:
    """Bucket of each two characters (whole numbers of 64 bits)."""
    return ((chars[0] * np.uint64(0x1F3D5B79) + chars[1]) * _MIX) >> np.uint64(42)


class Lattices:
    """Pieces of a model and the compiled lattices of words."""

    def __init__(self, path: str, temperature: float):
        import sentencepiece

        self.lib = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.pieces = {sp.id_to_piece(i): (i, sp.get_score(i) / temperature) for i in plain}
        self.longest = max(map(len, self.pieces))
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(not sp.is_byte(i) for i in self.byte_ids):
            self.byte_ids = None
        self.unknown = min(s for _, s in self.pieces.values()) - 10 / temperature
        # Two characters that stand side by side in no piece are never in one edge. (A bitmap of
        # hashed pairs: a false hit only leaves a cut out.)
        self.joined = np.zeros(1 << 22, bool)
        self.joined[_pairs(np.array([[ord(a), ord(b)] for p in self.pieces for a, b in zip(p, p[1:], strict=False)], np.uint64).reshape(-1, 2).T)] = True
        text = [b""] * n
        for p, (i, _) in self.pieces.items():
            text[i] = p.encode("utf-8", "surrogatepass")
        for b, i in enumerate(self.byte_ids or ()):
            text[i] = bytes([b])
        self.text, sizes = np.frombuffer(b"".join(text), np.uint8), np.fromiter(map(len, text), np.int64, n)
        self.text_at, self.text_size = np.cumsum(sizes) - sizes, sizes
        rows = [np.frombuffer(p.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) for p in self.pieces]
        self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.longest, _MIX)]))
        names = np.array([(c[::-1] * self.power[: len(c)]).sum(dtype=np.uint64) + np.uint64(len(c)) for c in rows])
        order = np.argsort(names)
        self.names = names[order]
        if (self.names[1:] == self.names[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.name_piece, self.name_weight = (np.array([v[j] for v in self.pieces.values()])[order] for j in (0, 1))
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[names * _MIX >> np.uint64(44)] = True
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.room = [np.zeros(1 << 16, t) for t in (np.int64, np.float64, np.float64, np.int8, np.int32)]
        self.tables = tuple(x[:0] for x in self.room)

    def units(self, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The texts cut where no edge of their lattices reaches across: (their characters end
        to end in UTF-32, first character of each word, words of each text)."""
        joined = "".join(texts).encode("utf-32-le", "surrogatepass")
        chars = np.frombuffer(joined, "<u4")
        apart = np.ones(len(chars), bool)
        # Some characters at a time: the hashes stay in the cache.
        for lo in range(0, len(chars) - 1, 1 << 14):
            part = chars[lo : lo + (1 << 14) + 1].astype(np.uint64)
            np.logical_not(self.joined[_pairs((part[:-1], part[1:]))], out=apart[lo + 1 : lo + len(part)])
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        apart[ends[ends < len(chars)]] = True
        begins = np.flatnonzero(apart)
        return joined, begins, np.diff(np.searchsorted(begins, ends), prepend=0)

    def edges(self, chars: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weight (-inf: no edge) and piece of the edges of lengths ``longest`` (or the longest
        word's) ... 1 that end at each character of the words laid end to end."""
        n, longest = len(chars), min(self.longest, int(sizes.max()))
        inside = np.arange(n) - np.repeat(begins, sizes)
        weight, piece = np.full((n, longest), -np.inf), np.zeros((n, longest), np.int32)
        run = np.zeros(n, np.uint64)
        for length in range(1, longest + 1):
            at = np.flatnonzero(inside >= length - 1)
            run[at] += chars[at - (length - 1)] * self.power[length - 1]
            name = run[at] + np.uint64(length)
            at, name = (x[self.bitmap[name * _MIX >> np.uint64(44)]] for x in (at, name))
            place = np.minimum(np.searchsorted(self.names, name), len(self.names) - 1)
            hit = self.names[place] == name
            at, place = at[hit], place[hit]
            weight[at, longest - length], piece[at, longest - length] = self.name_weight[place], self.name_piece[place]
        lone = np.flatnonzero(weight[:, -1] == -np.inf)
        weight[lone, -1], piece[lone, -1] = self.unknown, -1 - chars[lone].astype(np.int32)
        return weight, piece

    def learn(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first node, length) of each word of the texts and the words of each text, new words
        compiled. A word's nodes are its end positions; a node's edges lie together, the
        longest first, with their running probability (the last: 2), log probability, length and
        piece (-1 - its code point for a character in no piece)."""
        joined, begins, counts = self.units(texts)
        if not joined:
            return begins, begins, counts
        # Arrow tells the words apart; each distinct one is looked up once.
        ends = pa.py_buffer(np.append(begins * 4, len(joined)))
        coded = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, ends, pa.py_buffer(joined)]).dictionary_encode()
        places, chars = (np.frombuffer(x, t) for x, t in zip(coded.dictionary.buffers()[1:], (np.int64, np.uint8), strict=True))
        places, chars = places[: len(coded.dictionary) + 1].tolist(), chars.tobytes()
        words = [chars[a:b] for a, b in zip(places, places[1:], strict=False)]
        known = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(known < 0).tolist()
        new = sorted((words[i] for i in missing), key=len)
        at, base, edge = 0, len(self.tables[0]), len(self.tables[1])
        while at < len(new):
            end = at + 1
            while end < len(new) and (end + 1 - at) * len(new[end]) <= 1 << 17:
                end += 1
            made, firsts = self._compile(new[at:end], edge)
            self.at.update(zip(new[at:end], (base + firsts).tolist(), strict=True))
            self._append(made)
            base, edge, at = base + len(made[0]), edge + len(made[1]), end
        known[missing] = [self.at[words[i]] for i in missing]
        return known[coded.indices.to_numpy()], np.diff(begins, append=len(joined) // 4), counts

    def _append(self, made: tuple[np.ndarray, ...]) -> None:
        """Add rows to the tables, their room made a quarter larger when it is used up."""
        grown = []
        for i, (have, more) in enumerate(zip(self.tables, made, strict=True)):
            n = len(have) + len(more)
            if n > len(self.room[i]):
                room = np.empty(max(n, len(self.room[i]) * 5 // 4), have.dtype)
                room[: len(have)] = have
                self.room[i] = room
            self.room[i][len(have) : n] = more
            grown.append(self.room[i][:n])
        self.tables = tuple(grown)

    def _compile(self, words: list[bytes], edge: int) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
        """(tables, first nodes) of words in order of length: forward sums, one position after
        the other for all."""
        chars = np.frombuffer(b"".join(words), "<u4").astype(np.uint64)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) // 4
        begins = np.cumsum(sizes) - sizes
        weight, piece = self.edges(chars, begins, sizes)
        longest = weight.shape[1]
        forward = np.full((len(words), int(sizes[-1]) + 1 + longest), -np.inf)
        forward[:, longest] = 0.0
        for end in range(1, int(sizes[-1]) + 1):
            own = int(np.searchsorted(sizes, end))
            node = begins[own:] + end - 1
            # An edge is no longer than the way to the start.
            some = slice(max(longest - end, 0), None)
            through = weight[node, some] + forward[own:, max(end, longest) : longest + end]
            top = through.max(axis=1)
            total = top + np.log(np.exp(through - top[:, None]).sum(axis=1))
            forward[own:, longest + end] = total
            weight[node, some] = through - total[:, None]
        real = np.flatnonzero(weight > -np.inf)
        count = np.bincount(real // longest, minlength=len(weight))
        cdf = np.cumsum(np.exp(weight), axis=1).ravel()[real]
        last = np.cumsum(count)
        cdf[last - 1] = 2.0
        return (edge + last - count, cdf, weight.ravel()[real], (longest - real % longest).astype(np.int8), piece.ravel()[real]), begins

    def rest(self, edges: np.ndarray) -> np.ndarray:
        """The log mass of the other edges of each edge's node."""
        cdf, logp = self.tables[1:3]
        flat = logp[edges]
        out = log1mexp(np.minimum(flat, 0.0))
        # Beside a near-certain edge the others' mass is lost in 1 - p: add them up themselves.
        alone = (cdf[edges] == 2.0) & (cdf[edges - 1] == 2.0)
        for i in np.flatnonzero((flat > -1e-6) & ~alone).tolist():
            lo = hi = int(edges[i])
            while lo and cdf[lo - 1] < 2.0:
                lo -= 1
            while cdf[hi] < 2.0:
                hi += 1
            others = logp[lo : hi + 1]
            out[i] = np.logaddexp.reduce(others[others != flat[i]])
        return out


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finisher."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(seed: np.ndarray, draw: int, a, b) -> np.ndarray:
    """Numbers in (0, 1) by row seed, draw and place."""
    # Arrays of one at least: whole-number overflow wraps without a warning.
    a, b = np.atleast_1d(np.asarray(a, np.int64)).view(np.uint64), np.atleast_1d(np.asarray(b, np.int64)).view(np.uint64)
    x = seed + np.full(1, draw, np.uint64) * _MIX + a * np.uint64(0xD1342543DE82EF95) + b * _STEP
    return ((mixed(x) >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def walk(lat: Lattices, seed: np.ndarray, draw: int, number: np.ndarray, base: np.ndarray, pos: np.ndarray, done: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Walk each word's lattice from position ``pos`` back to its start: the edges taken, word
    by word, and how many each word took. Steps are counted on from ``done``."""
    first, cdf, _, length, _ = lat.tables
    live = np.flatnonzero(pos > 0)
    left, node = pos[live], (base + pos - 1)[live]
    # What a word's numbers are made of; a step adds its own part (see ``uniform``).
    own = (seed + np.full(1, draw, np.uint64) * _MIX + number.view(np.uint64) * np.uint64(0xD1342543DE82EF95) + done.view(np.uint64) * _STEP)[live]
    taken, found = np.zeros(len(pos), np.int64), []
    while len(live):
        e = first[node]
        u = ((mixed(own) >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52
        late = np.flatnonzero(u > cdf[e])
        v = u[late]
        while len(late):
            at = e[late] + 1
            e[late] = at
            on = v > cdf[at]
            late, v = late[on], v[on]
        found.append((live, e))
        n = length[e]
        left = left - n
        on = left > 0
        taken[live[~on]] = len(found)
        live, left, node, own = live[on], left[on], (node - n)[on], own[on] + _STEP
    edges = np.empty(int(taken.sum()), np.int64)
    at = np.cumsum(taken) - taken
    for step, (live, e) in enumerate(found):
        edges[at[live] + step] = e
    return edges, taken


def number_at(seed: int, draw: int, a: int, b: int) -> float:
    """``uniform`` of one place, in whole numbers."""
    x = (seed + draw * 0x9E3779B97F4A7C15 + a * 0xD1342543DE82EF95 + b * 0xDA942042E4DD58B5) & _LOW64
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _LOW64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _LOW64
    return (((x ^ (x >> 31)) >> 12) + 0.5) * 2.0**-52


class Path:
    """A segmentation of one text in tree order (words forwards, a word's edges backwards);
    ``total[t]``: log probability of its first ``t`` edges."""

    __slots__ = ("edges", "word", "lat", "total")

    def __init__(self, edges: np.ndarray, word: np.ndarray, logp: np.ndarray, lat: Lattices):
        self.edges, self.word, self.lat = edges, word, lat
        self.total = np.empty(len(edges) + 1)
        self.total[0] = 0.0
        np.cumsum(logp, out=self.total[1:])

    @property
    def logp(self) -> float:
        return float(self.total[-1])

    def falls(self, start: int, end: int) -> np.ndarray:
        """Log mass of what first differs from the path at each step of [start, end)."""
        return self.total[start:end] + self.lat.rest(self.edges[start:end])


def truncated(mass: float, most: float, u: float) -> float:
    """A Gumbel value with location ``mass``, not above ``most``."""
    a, b = math.log(-math.log(u)) - mass, -most
    top = max(a, b)
    return -(top + math.log(math.exp(a - top) + math.exp(b - top)))


def log1mexp(x):
    """log(1 - exp(x)) for x <= 0."""
    with np.errstate(divide="ignore"):
        return np.where(x > -0.6931471805599453, np.log(-np.expm1(x)), np.log1p(-np.exp(x)))


def mass_of(path: Path, start: int, end: int) -> float:
    """Log mass of what agrees with ``path`` before ``start`` and differs before ``end``."""
    if end <= start:
        return -math.inf
    fall = float(path.total[end] - path.total[start])
    if fall < -1e-6:
        return float(path.total[start]) + math.log(-math.expm1(fall))
    return float(np.logaddexp.reduce(path.falls(start, end)))


class Search:
    """The agenda of one text. A node is (-value, tie, path, step, end, excluded edges): agree
    with ``path`` before ``step`` and differ from it before ``end``, or, for ``end`` 0, take
    none of ``excluded`` at ``step`` (``step`` -1: everything)."""

    def __init__(self, seed: int):
        self.seed, self.tie, self.agenda, self.draws = seed, 0, [], 0
        self.push(-math.log(-math.log(self.number())), None, -1, 0, ())

    def number(self) -> float:
        self.draws += 1
        return number_at(self.seed, self.draws, 1 << 41, 0)

    def push(self, value: float, path, step: int, end: int, excluded: tuple) -> None:
        self.tie += 1
        heapq.heappush(self.agenda, (-value, self.tie, path, step, end, excluded))

    def push_set(self, path: Path, start: int, end: int, most: float) -> None:
        """Push what differs from ``path`` within [start, end), its value at most ``most``."""
        mass = mass_of(path, start, end)
        if mass > -math.inf:
            self.push(truncated(mass, most, self.number()), path, start, end, ())

    def pop(self):
        """The next node to draw from (value, path, step, excluded); None at the end."""
        if not self.agenda:
            return None
        value, _, path, step, end, excluded = heapq.heappop(self.agenda)
        if not end:
            return -value, path, step, excluded
        # The step at which the value's segmentation first differs, by mass; what differs
        # before it or after it are sets of their own, with values below.
        u, total = self.number(), path.total
        fall = float(total[end] - total[step])
        if fall < -1e-6:
            level = float(total[step]) + math.log1p(u * math.expm1(fall))
            hit = step + int(np.searchsorted(-total[step + 1 : end], -level, "left"))
        else:
            p = path.falls(step, end)
            p = np.cumsum(np.exp(p - p.max()))
            hit = step + min(int(np.searchsorted(p, u * p[-1])), end - step - 1)
        self.push_set(path, step, hit, -value)
        self.push_set(path, hit + 1, end, -value)
        return -value, path, hit, (int(path.edges[hit]),)


def sample_batch(lat: Lattices, seeds: np.ndarray, texts: list[str], k: int):
    """For each text the list of (value, path) drawn and kappa (None: nothing is left)."""
    if len(lat.at) > WORDS_KEPT:
        lat.clear()
    base, size, counts = lat.learn(texts)
    ends = np.cumsum(counts)
    starts = ends - counts
    first, cdf, logp, length, _ = lat.tables
    searches = [Search(int(s)) for s in seeds]
    drawn: list[list] = [[] for _ in texts]
    for draw in range(k):
        # What each text's next node asks for: its whole lattice, or its path from one step on.
        jobs = []
        for i, s in enumerate(searches):
            node = s.pop()
            if node is not None:
                jobs.append((i, *node))
        if not jobs:
            break
        text_of = np.array([x[0] for x in jobs])
        heads, w0s, fresh = [], np.zeros(len(jobs), np.int64), []
        for j, (i, _, path, step, excluded) in enumerate(jobs):
            if path is None:
                heads.append(None)
                continue
            # Another edge at this step, by the probabilities of those not excluded.
            w0 = w0s[j] = int(path.word[step])
            taken = path.edges[int(np.searchsorted(path.word, w0)) : step]
            at = int(size[starts[i] + w0] - length[taken].sum())
            lo = int(first[base[starts[i] + w0] + at - 1])
            hi = lo + 1
            while cdf[hi - 1] < 2.0:
                hi += 1
            others = np.array([e for e in range(lo, hi) if e not in excluded])
            p = np.cumsum(np.exp(logp[others] - logp[others].max()))
            u = number_at(searches[i].seed, draw + 1, 1 << 43, step)
            edge = int(others[min(int(np.searchsorted(p, u * p[-1])), len(others) - 1)])
            heads.append((edge, w0, lo, hi))
            fresh.append((j, at - int(length[edge]), len(taken) + 1))
        left = counts[text_of] - w0s
        word, job = ranges(starts[text_of] + w0s, left), np.repeat(np.arange(len(jobs)), left)
        pos, done, begin = size[word], np.zeros(len(word), np.int64), np.cumsum(left) - left
        for j, at, n in fresh:
            pos[begin[j]], done[begin[j]] = at, n
        number = word - starts[text_of[job]]
        edges, taken = walk(lat, seeds[text_of[job]], draw + 1, number, base[word], pos, done)
        p_of, w_of = logp[edges], np.repeat(number, taken)
        cuts = np.append(0, np.cumsum(taken))[np.append(begin, len(word))]
        for j, (i, value, path, step, excluded) in enumerate(jobs):
            own, at, p = (x[cuts[j] : cuts[j + 1]] for x in (edges, w_of, p_of))
            if path is not None:
                edge, w0, lo, hi = heads[j]
                head = np.append(path.edges[:step], edge)
                own, at, p = np.concatenate([head, own]), np.concatenate([path.word[:step], [w0], at]), np.concatenate([logp[head], p])
            new = Path(own, at, p, lat)
            drawn[i].append((value, new))
            s_ = searches[i]
            if path is None:
                s_.push_set(new, 0, len(new.edges), value)
            else:
                # The same step with both edges out, then the steps after it.
                out = (*excluded, edge)
                others = [x for x in range(lo, hi) if x not in out]
                if others:
                    mass = float(path.total[step] + np.logaddexp.reduce(logp[others]))
                    s_.push(truncated(mass, value, s_.number()), path, step, 0, out)
                s_.push_set(new, step + 1, len(new.edges), value)
    return drawn, [-s.agenda[0][0] if s.agenda else None for s in searches]


def ids_of_all(lat: Lattices, paths: list[Path]) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids in text order, path by path, and how many each path has."""
    sizes = np.fromiter((len(p.edges) for p in paths), np.int64, len(paths))
    ends = np.cumsum(sizes)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int32), sizes
    pid, word = lat.tables[4][np.concatenate([p.edges for p in paths])], np.concatenate([p.word for p in paths])
    # Within a word edges were taken from its end.
    fresh = np.append(True, word[1:] != word[:-1])
    fresh[ends[ends < len(pid)]] = True
    start = np.flatnonzero(fresh)
    count = np.diff(start, append=len(pid))
    ids = pid[np.repeat(2 * start + count - 1, count) - np.arange(len(pid))]
    odd = np.flatnonzero(ids < 0)
    if len(odd):
        chars, which = np.unique(ids[odd], return_inverse=True)
        spelt = [[lat.byte_ids[b] for b in chr(-1 - x).encode("utf-8", "surrogatepass")] if lat.byte_ids else [lat.lib.unk_id()] for x in chars.tolist()]
        n = np.fromiter(map(len, spelt), np.int64, len(spelt))
        more = np.zeros(len(ids), np.int64)
        more[odd] = n[which] - 1
        begin = (np.arange(len(ids)) + np.cumsum(more) - more)[odd]
        upto = np.append(0, np.cumsum(more))[np.append(0, ends)]
        ids, sizes = np.repeat(ids, more + 1), sizes + np.diff(upto)
        ids[ranges(begin, n[which])] = np.array(list(chain.from_iterable(spelt)), np.int32)[ranges((np.cumsum(n) - n)[which], n[which])]
    return ids, sizes


def ids_of(lat: Lattices, path: Path) -> np.ndarray:
    """Piece ids in text order."""
    return ids_of_all(lat, [path])[0]


def decoded(lat: Lattices, ids: np.ndarray) -> bytes:
    """The bytes that the pieces of ``ids`` stand for (normalised text)."""
    return lat.text[ranges(lat.text_at[ids], lat.text_size[ids])].tobytes()


def spelt_out(lat: Lattices, paths: list[Path]):
    """(ids, bytes that they stand for) of each path, those of some paths worked out together."""
    for lo, hi in slices([len(p.edges) for p in paths], 1 << 16):
        ids, sizes = ids_of_all(lat, paths[lo:hi])
        text, ends = decoded(lat, ids), np.cumsum(sizes)
        upto = np.append(0, np.cumsum(lat.text_size[ids]))
        at = 0
        for end, a, b in zip(ends.tolist(), upto[ends - sizes].tolist(), upto[ends].tolist(), strict=True):
            yield ids[at:end], text[a:b]
            at = end


_LATTICES: dict[tuple[str, float], Lattices] = {}


def lattices(path: str, temperature: float) -> Lattices:
    if (path, temperature) not in _LATTICES:
        _LATTICES[path, temperature] = Lattices(path, temperature)
    return _LATTICES[path, temperature]


def sample_segmentations(docs: DataFrame, model: str, k: int = 3, temperature: float = 10_000.0, seed: int = 42, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """The ``k`` sampled segmentations of every text (module docstring), in the order drawn;
    ``decodes``: the pieces give the normalised text again; with ``with_ids`` also the ids."""
    names = [x.split()[0] for x in SAMPLES.split(", ")] + (["ids"] if with_ids else [])
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()] + ([pa.list_(pa.int32())] if with_ids else [])

    def sample(batches):
        lat = lattices(model, temperature)
        for b in batches:
            keys, texts, seeds = b.column(0).to_pylist(), b.column(1).to_pylist(), np.asarray(b.column(2)).view(np.uint64)
            for lo, hi in batches_of(texts):
                normal = [lat.lib.normalize(t) for t in texts[lo:hi]]
                rows = []
                drawn, kappas = sample_batch(lat, seeds[lo:hi], normal, k)
                spelt = spelt_out(lat, [path for got in drawn for _, path in got])
                for i, (got, kappa) in enumerate(zip(drawn, kappas, strict=True)):
                    whole = normal[i].encode("utf-8", "surrogatepass")
                    for n, (_, path) in enumerate(got):
                        ids, said = next(spelt)
                        p = path.logp
                        over = math.inf if kappa is None else p - kappa
                        score = 0.0 if over > 30 else (float(log1mexp(-math.exp(over))) if over > -30 else over)
                        rows.append((keys[lo + i], n + 1, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), p, score, said == whole) + ((ids,) if with_ids else ()))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types, strict=True)], names=names)

    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    return rows.select("k", "t", F.xxhash64("k", F.lit(seed)).alias("s")).mapInArrow(sample, SAMPLES + (", ids array<int>" if with_ids else ""))


def decode(rows: DataFrame, model: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """``rows`` with a column of the text that piece ids stand for (null for null ids)."""

    @F.pandas_udf("string")
    def text_of(xs: pd.Series) -> pd.Series:
        lat = lattices(model, 1.0)

        def one(x):
            if x is None:
                return None
            t = decoded(lat, np.asarray(x, np.int64)).decode("utf-8", "replace").replace(SPACE, " ")
            return t[1:] if t.startswith(" ") else t

        return xs.map(one)

    return rows.withColumn(out, text_of(F.col(ids)))
