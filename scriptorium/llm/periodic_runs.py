"""Periodic runs of words inside a document.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are
identical) of at least ``least`` words and ``exponent`` periods that no neighbouring word
extends keeping period ``q``.

Method: the suffix automaton of the words is built and its suffix-link tree held in a
link-cut forest. Appending word ``i`` is one ``access`` of the state of prefix ``i``: the
path to the root becomes one preferred path of colour ``i``. The preferred paths it crosses
are the segments of suffixes whose last occurrence so far ended at the same word ``e``, the
colour of that path. The longest suffix of a segment, ``n`` words, ends at ``e`` and at
``i``: with ``p = i - e <= n`` that is a repetition of period ``p`` over ``n + p`` words, a
square at least. In a run of two periods or more the longest such suffix reaches back to the
run's first word, so each run is met at its last word with its own smallest period, and all
that is left is to keep the last end met for each (start, period). The automaton is complete
before the first access, so the tree doesn't change and the forest needs ``access`` alone.

Only words that can lie in a run enter an automaton: in a run of ``l`` words and period
``q`` every ``GRAM`` words from word ``q`` on repeat earlier ones at most ``q`` words back,
which numpy finds for many documents at a time by sorted hashes. A stretch of such
places shorter than a run's, or repeating from further back than a run of its size could,
rules its words out; nothing else does (a hash clash rules nothing out).

Results: a null, empty or blank text has no words, no runs and an empty collapsed text; a
row is worked on by itself, so repeated rows, ties and null keys give a row each; an empty
table gives an empty one; other columns are not read, whatever their names. Memory is
bounded by ``CHARS_AT_ONCE`` bytes of text, or one document if it has more; the time for ``n``
words is O(n log n), whatever their repeats."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

CHARS_AT_ONCE = 1 << 22
RUNS = "array<struct<start: long, length: long, period: long>>"


def suffix_automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(suffix link, length) by state and the state of each prefix; state 0 is the empty word."""
    step: list[dict] = [{}]
    link, length, ends = [-1], [0], []
    last = 0
    for c in words:
        cur = len(length)
        length.append(length[last] + 1)
        link.append(0)
        step.append({})
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p != -1:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                step.append(step[q].copy())
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        ends.append(cur)
        last = cur
    return link, length, ends


class LinkCutForest:
    """Rooted forest under ``access``: each preferred path is a splay tree keyed by depth,
    and its colour stands at the splay tree's root. Node 0 means none."""

    def __init__(self, parent: list[int]):
        self.up = parent
        n = len(parent)
        self.left, self.right, self.colour = [0] * n, [0] * n, [-1] * n

    def splay(self, x: int) -> None:
        up, left, right, colour = self.up, self.left, self.right, self.colour
        y = up[x]
        if not y or (left[y] != x and right[y] != x):
            return
        while y and (left[y] == x or right[y] == x):
            z = up[y]
            inner = z and (left[z] == y or right[z] == y)
            if inner and (left[z] == y) == (left[y] == x):  # zig-zig: the parent first
                w = up[z]
                if left[z] == y:
                    left[z] = b = right[y]
                    right[y] = z
                else:
                    right[z] = b = left[y]
                    left[y] = z
                if b:
                    up[b] = z
                up[z], up[y] = y, w
                if w:
                    if left[w] == z:
                        left[w] = y
                    elif right[w] == z:
                        right[w] = y
                if colour[z] != colour[y]:
                    colour[y] = colour[z]
                z = w
            # x over y
            z = up[y]
            if left[y] == x:
                left[y] = b = right[x]
                right[x] = y
            else:
                right[y] = b = left[x]
                left[x] = y
            if b:
                up[b] = y
            up[y], up[x] = x, z
            if z:
                if left[z] == y:
                    left[z] = x
                elif right[z] == y:
                    right[z] = x
            colour[x] = colour[y]
            y = z

    def access(self, x: int, colour: int) -> list[tuple[int, int]]:
        """Make the path from ``x`` to its root one preferred path of ``colour``; returns the
        (deepest node, colour) of the preferred paths it crossed, deepest first."""
        up, right, shade = self.up, self.right, self.colour
        crossed = []
        below, v = 0, x
        while v:
            self.splay(v)
            crossed.append((v, shade[v]))
            if right[v]:
                shade[right[v]] = shade[v]
            right[v] = below
            below, v = v, up[v]
        self.splay(x)
        shade[x] = colour
        return crossed


def repetitions(words: list[int], least: int, exponent: int) -> dict[tuple[int, int], int]:
    """(start, period) to last word of the runs of ``words``."""
    link, length, ends = suffix_automaton(words)
    link[0] = 0
    forest = LinkCutForest(link)
    found: dict[tuple[int, int], int] = {}
    for i, state in enumerate(ends):
        for v, e in forest.access(state, i):
            if e >= 0:
                p, n = i - e, length[v]
                if n >= (exponent - 1) * p and n + p >= least:
                    found[i - n - p + 1, p] = i
    return found


def gram_size(least: int, exponent: int) -> int:
    """Half of what a shortest run repeats: its grams repeat at as many places again."""
    return max(1, (least - least // exponent) // 2)


def candidate_regions(codes: np.ndarray, sizes: np.ndarray, least: int, exponent: int) -> list[tuple[int, int, int]]:
    """(document, first, end) of word ranges, in the document's own numbers, that hold every
    run of documents laid end to end (``sizes`` words each, ``codes`` their hashes)."""
    gram = gram_size(least, exponent)
    if len(codes) < least:
        return []
    doc = np.repeat(np.arange(len(sizes)), sizes)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    codes = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    places = len(codes) - gram + 1
    mixed = (doc[:places].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(gram):
        mixed = (mixed ^ codes[j : j + places]) * np.uint64(0xFF51AFD7ED558CCD)
        mixed ^= mixed >> np.uint64(32)
    at = np.flatnonzero(doc[:places] == doc[gram - 1 :])
    order = at[np.argsort(mixed[at], kind="stable")]
    same = np.flatnonzero(mixed[order[1:]] == mixed[order[:-1]])
    back = np.zeros(places, np.int64)  # words to the gram's last occurrence before
    back[order[same + 1]] = order[same + 1] - order[same]
    shortest = least - least // exponent - gram + 1
    places_of = np.flatnonzero(back)
    while True:
        if not len(places_of):
            return []
        cut = np.flatnonzero((np.diff(places_of) != 1) | (np.diff(doc[places_of]) != 0)) + 1
        starts = np.concatenate([[0], cut])
        lengths = np.diff(np.concatenate([starts, [len(places_of)]]))
        most = (lengths + gram - 1) // (exponent - 1)  # a run's period at most
        keep = (back[places_of] <= np.repeat(most, lengths)) & np.repeat(lengths >= shortest, lengths)
        if keep.all():
            break
        places_of = places_of[keep]
    regions = []
    for x, n, q in zip(places_of[starts].tolist(), lengths.tolist(), most.tolist(), strict=True):
        d = int(doc[x])
        regions.append((d, max(0, x - int(begin[d]) - q), min(int(sizes[d]), x - int(begin[d]) + n + gram - 1)))
    out: list[list[int]] = []
    for d, first, end in sorted(regions):
        if out and out[-1][0] == d and first <= out[-1][2]:
            out[-1][2] = max(out[-1][2], end)
        else:
            out.append([d, first, end])
    return [tuple(x) for x in out]


def runs_of(texts: list[bytes], least: int = 24, exponent: int = 3) -> list[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """The words and the runs (start, length, period), by start and period, of each text."""
    docs = [t.split() for t in texts]  # bytes.split() cuts at the six ASCII spaces and no others
    sizes = np.array([len(w) for w in docs], np.int64)
    codes = np.fromiter((hash(w) for d in docs for w in d), np.int64, int(sizes.sum()))
    runs: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    for d, first, end in candidate_regions(codes, sizes, least, exponent):
        words = docs[d]
        numbers: dict[bytes, int] = {}
        found = repetitions([numbers.setdefault(w, len(numbers)) for w in words[first:end]], least, exponent)
        for (start, period), last in found.items():
            # Exact check against the whole text: no neighbour goes on with the period.
            start, last = start + first, last + first
            if start and words[start - 1] == words[start - 1 + period]:
                continue
            if last + 1 < len(words) and words[last + 1] == words[last + 1 - period]:
                continue
            runs[d].append((start, last - start + 1, period))
    return [(w, sorted(r, key=lambda x: (x[0], x[2]))) for w, r in zip(docs, runs, strict=True)]


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by a space, without those that follow a run's first period in it."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])


def periodic_runs(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 24, exponent: int = 3
) -> DataFrame:
    """(key, n_words, runs, collapsed) of each row: ``runs`` by start, then period, and the
    text without the words that follow a run's first period in it."""
    if exponent < 2 or least < 2:
        raise ValueError("a run has two periods and two words at least")
    runs_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    names = ["n_words", "runs", "collapsed"]

    def find(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            for lo, hi in slices(pc.binary_length(texts).to_pylist(), CHARS_AT_ONCE):
                got = runs_of(texts.slice(lo, hi - lo).to_pylist(), least, exponent)
                rows = [
                    pa.array([len(w) for w, _ in got], pa.int64()),
                    pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for _, r in got], runs_type),
                    pa.array([without_repeats(w, r) for w, r in got], pa.binary()).cast(pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *rows], names=["k", *names])

    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    found = rows.mapInArrow(find, f"k {kind}, n_words long, runs {RUNS}, collapsed string")
    return found.withColumnRenamed("k", key)
