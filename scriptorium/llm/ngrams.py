"""Hashed byte n-grams of many texts at once (numpy), for the generative models.

Texts are laid end to end, one line feed apart; an n-gram never spans two texts. Sums are
taken over whole numbers, so they are the same whatever batch a text falls in. What is
several bytes for each byte of text is held for ``BLOCK`` bytes at a time, so that a long
text takes little more than its own room."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_K = np.uint64(0x9E3779B97F4A7C15)
_K_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BLOCK = 1 << 17
_POWERS: dict[int, np.ndarray] = {}


class Texts:
    """The bytes of some texts with the place of each."""

    def __init__(self, texts: list[str | None], lower: bool = False):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        joined = b"\n".join(raw) + b"\n"
        self.buf = np.frombuffer(joined.lower() if lower else joined, np.uint8)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64)
        self.ends = self.starts + sizes

    def grams(self, n: int) -> np.ndarray:
        """Number of n-grams of each text."""
        return np.maximum(self.ends - self.starts - n + 1, 0)

    def buckets(self, n: int, bits: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Bucket of the n-gram (up to four bytes) at every place of the joined bytes, or at
        those from ``lo`` to ``hi``."""
        m = max(len(self.buf) - n + 1, 0)
        buf = self.buf[lo:]
        m = (m if hi is None else min(hi, m)) - lo
        x = np.zeros(m, np.uint32)
        for k in range(n):
            x |= buf[k : k + m].astype(np.uint32) << np.uint32(8 * k)
        return (x * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)

    def blocks(self, n: int, bits: int):
        """(first place, buckets) of ``BLOCK`` places at a time."""
        for lo in range(0, len(self.buf) - n + 1, BLOCK):
            yield lo, self.buckets(n, bits, lo, lo + BLOCK)

    def gram_counts(self, n: int, bits: int) -> np.ndarray:
        """``counts`` of the buckets of all places."""
        size = 1 << bits
        across = (self.ends[:, None] - np.arange(n)[None, :]).ravel()
        across = np.unique(across[(across >= 0) & (across < len(self.buf) - n + 1)])
        out = np.zeros(size, np.int64)
        for lo, x in self.blocks(n, bits):
            own = across[np.searchsorted(across, lo) : np.searchsorted(across, lo + len(x))]
            out += np.bincount(x, minlength=size) - np.bincount(x[own - lo], minlength=size)
        return out

    def gram_sums(self, weight: np.ndarray, n: int, bits: int) -> np.ndarray:
        """``sums`` of the weights (whole numbers) of the buckets of all places."""
        top = max(len(self.buf) - n + 1, 0)
        ends = [np.minimum(self.starts + self.grams(n), top), np.minimum(self.starts, top)]
        sums, held = [np.zeros(len(x), np.int64) for x in ends], 0
        for lo, x in self.blocks(n, bits):
            total = np.cumsum(np.concatenate([[held], weight[x]]))
            for at, out in zip(ends, sums, strict=True):
                own = slice(*np.searchsorted(at, [lo, lo + len(x) + 1]))
                out[own] = total[at[own] - lo]
            held = total[-1]
        return sums[0] - sums[1]

    def counts(self, buckets: np.ndarray, n: int, size: int) -> np.ndarray:
        """Occurrences of each bucket over all the texts, places across texts left out."""
        across = (self.ends[:, None] - np.arange(n)[None, :]).ravel()
        across = np.unique(across[(across >= 0) & (across < len(buckets))])
        return np.bincount(buckets, minlength=size) - np.bincount(buckets[across], minlength=size)

    def sums(self, values: np.ndarray, n: int) -> np.ndarray:
        """Sum for each text of the whole numbers ``values``, one at each n-gram's place."""
        total = np.concatenate([[0], np.cumsum(values)])
        top = len(values)
        return total[np.minimum(self.starts + self.grams(n), top)] - total[np.minimum(self.starts, top)]

    def repeats(self) -> tuple[np.ndarray, np.ndarray]:
        """(words that equal the word before them, words that don't) of each text, its
        first word aside; words are told apart by a 64-bit hash."""
        firsts, hashes, lo = [], [], 0
        while lo < len(self.buf):
            hi = self._after_gap(lo + BLOCK)
            part = self.buf[lo:hi]
            gap = _SPACE[part]
            before = np.concatenate([[True], gap[:-1]])
            first = np.flatnonzero(before & ~gap)
            last = np.flatnonzero(~before & gap)
            up, down = _power(_K, len(part)), _power(_K_INVERSE, len(part))
            total = np.concatenate([[np.uint64(0)], np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up)])
            firsts.append(first + lo)
            hashes.append((total[last] - total[first]) * down[first])
            lo = hi
        first, words = np.concatenate(firsts), np.concatenate(hashes)
        same = np.concatenate([[0], np.cumsum(np.concatenate([[False], words[1:] == words[:-1]]))])
        a, b = np.searchsorted(first, self.starts), np.searchsorted(first, self.ends)
        a = np.minimum(a + 1, b)  # the first word has none before it
        return same[b] - same[a], (b - a) - (same[b] - same[a])

    def _after_gap(self, at: int) -> int:
        """The first place from ``at`` on that follows a gap (the joined bytes end in one)."""
        while at < len(self.buf):
            gap = _SPACE[self.buf[at - 1 : at - 1 + BLOCK]]
            if gap.any():
                return at + int(gap.argmax())
            at += len(gap)
        return len(self.buf)


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 18)
        have = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, base)]))
        if size <= 1 << 22:
            _POWERS[int(base)] = have
    return have[:n]
