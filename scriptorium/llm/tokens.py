"""Encoding with files of the ``tokenizers`` library inside tasks.

Most words of a corpus repeat, so a worker keeps the ids of words it has met (a bounded
table) and calls the library for new ones only. Texts are cut where the file's own
pre-tokenizer certainly cuts: before a single space that follows a non-space (byte-level
splitting, which glues one space to the next word), or at spaces (splitting that drops
white space). Any other kind of file, and texts with runs of spaces, go to the library
whole, and so do texts with the string of an added token, so the ids are those of
``Tokenizer.encode(text, add_special_tokens=False)``.

Byte-level files whose merges are told by the tokens' ranks alone (checked, see ``ranked``)
are also given to ``tiktoken``, which has the same pattern and is several times faster; it
encodes texts of characters on whose class the two libraries' Unicode tables can't differ,
without very long runs of white space."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array

import numpy as np

WORDS_KEPT = 1_000_000
LONG_WORD = 64
# A plain word: letters that normalisation leaves alone but for their case, then ASCII
# punctuation. Either part is one piece for both kinds of splitting.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
PLAIN = re.compile(rf"([{LETTERS}]+)([!-&(-/:-@\[-^`{{-~]*)\Z")

# The pattern of byte-level splitting (a fixed value of this kind of file).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Latin letters, marks of punctuation: assigned and classed since the first Unicode versions.
SETTLED = re.compile("[\0-\u012f\u0131-\u024f\u2010-\u2027]*\\Z")
LONG_SPACE = re.compile(r"\s{1000}")
# A space that goes on a run of white space: no cut before it.
SPACED = re.compile(r"\s ")
# Pieces but runs of letters in such texts, lower-cased, of files that drop white space: what
# stands between letters, digits one by one. Characters that only str.split() cuts at.
_SMALL = sorted({c for x in range(0x250) for c in chr(x).lower()})
_LETTERS = "".join(c for c in _SMALL if unicodedata.category(c)[0] == "L")
_NUMBERS = "".join(c for c in _SMALL if unicodedata.category(c)[0] == "N")
PIECES = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")
OTHER_SPACE = re.compile("[\x1c-\x1f]")


def byte_letters() -> dict[str, int]:
    """The letters of the byte-level alphabet: printable bytes stand for themselves, the
    others for the letters from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def merged(symbols: list[str], rank: dict[tuple[str, str], int]) -> list[str]:
    """The symbols after merging by the pair that is listed first, over and over."""
    while len(symbols) > 1:
        r, i = min((rank.get(p, len(rank)), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)))
        if r == len(rank):
            break
        symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]
    return symbols


def ranked(lib, spec: dict):
    """A ``tiktoken`` encoding with the ids of a byte-level file, or None.

    It merges, of two neighbours whose union is a token, those of the smallest id; the file
    merges the pairs that it lists, the first of them first. These are the same if the pairs
    are listed by the id of their union and every token, encoded by itself, is itself: were
    two neighbours' union a token and the pair not listed, then that token by itself would
    end at this pair too. Both are checked here. A mark at the end of words is a space here:
    words are given with a space behind each, and joining it to a word's last byte comes
    before all other merges, as the tokens of a byte with the mark have smaller ids."""
    model = spec.get("model") or {}
    if model.get("type") != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
        return None
    letters, mark = byte_letters(), model.get("end_of_word_suffix") or ""
    added = {t["content"] for t in spec.get("added_tokens") or []}
    vocab = {t: i for t, i in (model.get("vocab") or {}).items() if t not in added}
    split = {t: (t[: -len(mark)], mark) if mark and t.endswith(mark) else (t, "") for t in vocab}
    if not set("".join(x for x, _ in split.values())) <= letters.keys():
        return None
    ranks = {bytes(map(letters.get, x)) + (b" " if end else b""): vocab[t] for t, (x, end) in split.items()}
    single = [vocab.get(c + end, -1) for c in letters for end in {"", mark}]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    order = [vocab.get(a + b, -1) for a, b in pairs]
    if len(ranks) != len(vocab) or min(single) < 0 or order != sorted(set(order)) or (order and order[0] < max(single)):
        return None
    rank = {p: i for i, p in enumerate(pairs)}
    for t, (x, end) in split.items():
        alone = [y.id for y in lib.model.tokenize(x)] if end or not mark else [vocab[y] for y in merged(list(x), rank)]
        if alone != [vocab[t]]:
            return None
    from tiktoken import Encoding

    return Encoding("ranked", pat_str="[^ ]+ " if mark else BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes. With ``added`` the strings of
    added tokens have their ids, as in the library unless told otherwise; without it those
    of special tokens are ordinary text."""

    def __init__(self, path: str, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = not added
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec.get("pre_tokenizer") or {}
        parts = kind.get("pretokenizers", [kind])
        own_split = len(parts) == 2 and parts[0].get("type") == "Split" and parts[0].get("invert") and parts[0].get("behavior") == "Removed" and "\\s" in parts[0].get("pattern", {}).get("Regex", "")
        self.glue = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space") and spec.get("normalizer") is None
        self.drop = bool(own_split) and parts[1].get("type") == "ByteLevel" and not parts[1].get("use_regex", True)
        tokens = [t for t in spec.get("added_tokens") or [] if added or not t.get("special")]
        # A string looked for in the normalised text may come from other characters.
        unseen = spec.get("normalizer") is not None and any(t.get("normalized") for t in tokens)
        self.cuts = (self.glue or self.drop) and not unseen
        self.added = [t["content"] for t in tokens]
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        self.lower = [x.get("type") for x in steps] == ["NFC", "Replace", "Lowercase"]
        self.plain = self.glue or (self.drop and self.lower)
        if self.plain:
            # The library's own byte alphabet for the letters of plain words.
            every = [chr(c) for c in range(0x41, 0x100) if re.match(f"[{LETTERS}]", chr(c))]
            self.alphabet = str.maketrans({c: self.lib.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in every})
            self.space = self.lib.pre_tokenizer.pre_tokenize_str(" a")[0][0][:-1] if self.glue else ""
        self.vocab_size = self.lib.get_vocab_size()
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.ranks = ranked(self.lib, spec) if self.cuts and (self.glue or self.lower) else None
        mark = spec["model"].get("end_of_word_suffix") or ""
        if self.ranks is not None and bool(mark) == self.glue:
            self.ranks = None
        if self.drop:
            self.last = np.zeros(self.vocab_size, bool)
            for t, i in self.lib.get_vocab().items():
                self.last[i] = t.endswith(mark)

    def whole(self, text: str) -> bytes:
        return array("I", self.lib.encode(text, add_special_tokens=False).ids).tobytes()

    def piecewise(self, text: str) -> bytes:
        if self.lib.normalizer is not None:
            text = self.lib.normalizer.normalize_str(text)
        got = self.pieces
        out = []
        for piece, _ in self.lib.pre_tokenizer.pre_tokenize_str(text):
            ids = got.get(piece)
            if ids is None:
                ids = array("I", [t.id for t in self.lib.model.tokenize(piece)]).tobytes()
                if len(piece) <= LONG_WORD:
                    got[piece] = ids
            out.append(ids)
        return b"".join(out)

    def word(self, unit: str) -> bytes:
        """Ids of a unit that follows a space."""
        m = PLAIN.match(unit) if self.plain else None
        if m is None:
            return self.piecewise((" " if self.glue else "") + unit)
        got = self.pieces
        letters, tail = m.groups()
        piece = self.space + (letters.lower() if self.drop else letters).translate(self.alphabet)
        ids = got.get(piece)
        if ids is None:
            ids = array("I", [t.id for t in self.lib.model.tokenize(piece)]).tobytes()
            if len(piece) <= LONG_WORD:
                got[piece] = ids
        if not tail:
            return ids
        last = got.get(tail)
        if last is None:
            last = self.piecewise(tail)
            if len(tail) <= LONG_WORD:
                got[tail] = last
        return ids + last

    def learn(self, units: list[str]) -> dict[str, bytes]:
        """The ids of lower-case texts without white space met for the first time, which are
        cut into pieces and encoded all at once."""
        pieces = [x.split() for x in PIECES.sub(r" \g<0> ", "\n".join(units)).split("\n")]
        ids = self.ranks.encode_to_numpy(" ".join([p for ps in pieces for p in ps]) + " ", disallowed_special=()).astype("<u4")
        last = np.cumsum([len(ps) for ps in pieces]) - 1
        stops = (4 * (np.flatnonzero(self.last[ids]) + 1))[last].tolist()
        raw = ids.tobytes()
        return {u: raw[x:y] for u, x, y in zip(units, [0, *stops], stops, strict=False)}

    def encode(self, texts: list[str]) -> list[bytes]:
        """One value of ids per text; a bounded number of words is kept between calls."""
        if not self.cuts:
            return [self.whole(t) for t in texts]
        if len(self.words) > WORDS_KEPT:
            self.words = {}
        if len(self.pieces) > WORDS_KEPT:
            self.pieces = {}
        got = self.words
        out: list = []
        later, missing = [], set()  # texts that hold units not met before, and these
        for t in texts:
            added = any(x in t for x in self.added)
            if self.ranks is not None and not added and SETTLED.match(t):
                if self.drop and not OTHER_SPACE.search(t):
                    units = t.lower().split()
                    ids = list(map(got.get, units))
                    if None in ids:
                        missing.update([u for u, x in zip(units, ids, strict=True) if x is None])
                        later.append((len(out), units))
                    out.append(b"" if None in ids else b"".join(ids))
                    continue
                if self.glue and not LONG_SPACE.search(t):
                    out.append(self.ranks.encode_to_numpy(t, disallowed_special=()).astype("<u4", copy=False).tobytes())
                    continue
            if added or "  " in t or (self.glue and SPACED.search(t)):
                out.append(self.whole(t))
                continue
            units = t.split(" ")
            # The first word has no space before it; with dropped white space that is no difference.
            head = b"" if self.drop else self.piecewise(units[0])
            rest = units if self.drop else units[1:]
            ids = list(map(got.get, rest))
            if None in ids:
                for k, x in enumerate(ids):
                    if x is None:
                        u = rest[k]
                        x = got.get(u)
                        if x is None:
                            x = self.word(u)
                            if len(u) <= LONG_WORD:
                                got[u] = x
                        ids[k] = x
            out.append(head + b"".join(ids))
        if later:
            new = self.learn(list(missing))
            got.update((u, x) for u, x in new.items() if len(u) <= LONG_WORD)
            for i, units in later:
                ids = list(map(got.get, units))
                out[i] = b"".join([new[u] if x is None else x for u, x in zip(units, ids, strict=True)] if None in ids else ids)
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a file; workers live on between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path, added=True)
    return _ENCODERS[path]
