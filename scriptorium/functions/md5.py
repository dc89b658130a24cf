"""The first 32 bits of md5 of ``<key>:<place>:<seed>`` for many places at once, in numpy."""

from __future__ import annotations

import hashlib

import numpy as np

PLACES = 1 << 14  # messages hashed together: a megabyte of blocks
TAIL = 32
_KEPT: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
_K = [int(abs(np.sin(i + 1.0)) * 4294967296.0) for i in range(64)]
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _tails(lo: int, hi: int, end: bytes) -> tuple[np.ndarray, np.ndarray]:
    """What follows the key for the places ``lo`` to ``hi``: the bytes with md5's end mark, and
    their number without it."""
    at = np.arange(lo, hi, dtype=np.int64)
    digits = np.searchsorted(10 ** np.arange(1, 19, dtype=np.int64), at, "right") + 1
    out = np.zeros((len(at), TAIL), np.uint8)
    rows = np.arange(len(at))
    rest = at.copy()
    for k in range(int(digits.max(initial=0))):
        here = rows[digits > k]
        out[here, digits[here] - 1 - k] = 48 + rest[here] % 10
        rest[here] //= 10
    for k, c in enumerate(end + b"\x80"):
        out[rows, digits + k] = c
    return out, digits + len(end)


def _first_words(blocks: np.ndarray, longest: int) -> np.ndarray:
    """The first digest word of each one-block message; words past ``longest`` are zero."""
    n = len(blocks)
    m = [np.ascontiguousarray(blocks[:, k]) if 4 * k <= longest or k == 14 else None for k in range(16)]
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(61):  # the last three steps leave the first word alone
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            g = (7 * i) % 16
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        np.add(f, np.uint32(_K[i]), out=f)
        if m[g] is not None:
            np.add(f, m[g], out=f)
        turn = _TURNS[i // 16][i % 4]
        np.right_shift(f, np.uint32(32 - turn), out=t)
        np.left_shift(f, np.uint32(turn), out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=f)
        a, d, c, b, f = d, c, b, f, a
    # Three steps on, what is the second word now would have come round to be the first.
    return b + np.uint32(_START[0])


def first_bits(keys: list[bytes | None], counts: list[int], seed: bytes) -> np.ndarray:
    """For each key in turn, and each place from 0 to its count, the first 32 bits of the md5 of
    key, place and seed with colons between; a key that is None is left out with its colon."""
    out = np.empty(sum(counts), np.uint32)
    end = b":" + seed
    heads = [b"" if k is None else k + b":" for k in keys]
    fits = len(end) + 20 <= TAIL
    blocks = np.zeros((PLACES, 64), np.uint8)
    words, filled, first, longest = blocks.view("<u4"), 0, 0, 0

    def hashed() -> None:
        nonlocal filled, first, longest
        out[first : first + filled] = _first_words(words[:filled], longest).byteswap()
        first, filled, longest = first + filled, 0, 0
        blocks[:] = 0

    for head, n in zip(heads, counts, strict=True):
        if not fits or len(head) + len(end) + 20 > 55:
            hashed()
            for k in range(n):
                out[first + k] = int.from_bytes(hashlib.md5(head + str(k).encode() + end).digest()[:4], "big")
            first += n
            continue
        at = 0
        while at < n:
            if filled == PLACES:
                hashed()
            some = min(n - at, PLACES - filled)
            if at + some <= PLACES:
                if end not in _KEPT:
                    _KEPT.clear()
                    _KEPT[end] = _tails(0, PLACES, end)
                tails, sizes = (x[at : at + some] for x in _KEPT[end])
            else:
                tails, sizes = _tails(at, at + some, end)
            rows = slice(filled, filled + some)
            blocks[rows, : len(head)] = np.frombuffer(head, np.uint8)
            room = min(TAIL, 56 - len(head))
            blocks[rows, len(head) : len(head) + room] = tails[:, :room]
            words[rows, 14] = 8 * (len(head) + sizes)
            longest = max(longest, len(head) + int(sizes[-1]))
            filled, at = filled + some, at + some
    hashed()
    return out
