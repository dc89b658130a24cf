"""Byte-pair-encoding vocabulary learning and encoding as Spark jobs.

Training works on the distinct-word table ``(freq, ids)`` where ``ids`` are the word's
current token ids. Each round starts with the pair counts; where the words of the top pairs
are few enough (``MOST_SYMBOLS``) the driver collects those words and merges in them one
pair at a time, exactly, until a pair that it did not ask for can be the best
(``_merge_run``). Otherwise:

1. pair counts: explode adjacent id pairs, ``groupBy(pair).sum(freq)`` (map-side
   combine, so a very frequent word costs nothing extra); the top candidates in
   (count desc, left id asc, right id asc) order reach the driver (a bounded number);
2. for those candidates, an upper bound on the count of every pair a merge can create:
   a new pair ``(x, ab)`` occurs at most as often as the triple ``x a b`` (and ``(ab, y)``
   as ``a b y``), so triple counts next to the candidates are summed and maxed (one
   aggregation, candidates broadcast; again a bounded result);
3. merges are accepted in candidate order while the result provably equals
   one-merge-per-round training. A merge ``(a, b)`` changes the count of an existing pair
   only where occurrences overlap, i.e. pairs ``(x, a)`` and ``(b, y)``, and only
   downwards. A further candidate is accepted when no accepted merge overlaps it (its
   count is unchanged), its count exceeds every bound from step 2 (no created pair can
   overtake it) and every candidate passed over so far provably dropped below it (old
   count minus the occurrences one accepted merge removes, from the same triple counts);
   an overlapped candidate is passed over, and any candidate that fails these tests ends
   the round. Self-pairs (``(a, a)``, whose runs merge unevenly) are never passed over;
4. the accepted merges rewrite ``ids`` in acceptance order (of either kind of round), left
   to right and non-overlapping like the sequential merge.

The word table is persisted each round and, every few rounds, written to one of two
alternating folders under ``spark.checkpoint.dir`` and read back to cut lineage. Vocabulary order: special tokens, the alphabet in
code-point order, then merges in order; a merge whose string already exists reuses its id
(and ends the round, since it changes counts of an existing token).
"""

from __future__ import annotations

import heapq
import itertools
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as PT

from ..functions import text as T
from ..functions.batches import slices
from ..session import ensure_checkpoint_dir

DEFAULT_SPECIALS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]"]
WORDS_PER_PARTITION = 500_000
# What the driver holds in a round: pairs, and symbols of the words that hold them.
MOST_PAIRS, MOST_SYMBOLS, FEW_PAIRS = 20_000, 4_000_000, 8
LONG_WORD = 64
PACKED_WORDS = 50_000
# Symbols counted together by a task; merges up to which a task looks for each in all its words at once.
TOGETHER, FEW_MERGES = 1_000_000, 400


def normalize_text(col: Column | str) -> Column:
    return F.lower(F.col(col) if isinstance(col, str) else col)


def word_frequencies(texts: DataFrame, text_col: str = "text", lower: bool = True) -> DataFrame:
    """``(word, freq)`` over the whitespace pre-tokenizer pieces of the texts."""
    from ..session import ensure_parallelism

    t = normalize_text(text_col) if lower else F.col(text_col)
    words = ensure_parallelism(texts.select(text_col)).select(F.explode(T.pretokenize(t)).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def code_points(col: Column) -> Column:
    """Characters of a string as code points (a supplementary character stays whole)."""
    return F.regexp_extract_all(col, F.lit("(?s)."), F.lit(0))


def char_alphabet(freqs: DataFrame) -> DataFrame:
    """Distinct characters of the words with their weighted counts."""
    chars = freqs.select(F.explode(code_points(F.col("word"))).alias("ch"), "freq")
    return chars.groupBy("ch").agg(F.sum("freq").alias("freq"))


@dataclass
class BpeModel:
    vocab: list[str]
    merges: list[tuple[str, str]]
    specials: list[str] = field(default_factory=list)
    rounds: int = 0  # training rounds (Spark passes over the word table)
    n_alphabet: int = 0

    @property
    def token_to_id(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for i, t in enumerate(self.vocab):
            out.setdefault(t, i)
        return out


def _symbols(batches):
    """Batches of words, ``TOGETHER`` symbols at a time: frequencies, the ids laid end to end,
    the word of each id."""
    some, n = [], 0

    def laid():
        t = pa.Table.from_batches(some).combine_chunks()
        ids = t["ids"].combine_chunks()
        sizes = np.diff(ids.offsets.to_numpy())
        return t["freq"].to_numpy(), ids.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)

    for b in batches:
        some.append(b)
        n += len(b.column(1).flatten())
        if n >= TOGETHER:
            yield laid()
            some, n = [], 0
    if n:
        yield laid()


def _pair_counts(words: DataFrame) -> DataFrame:
    """``(l, r, cnt, vol)``: the pair's count and, roughly, the symbols of its words. Pairs
    are counted in numpy by batch of words, then added up."""

    def count(batches):
        for freq, flat, row in _symbols(batches):
            size = np.bincount(row, minlength=len(freq))
            inner = np.flatnonzero(row[1:] == row[:-1])
            pairs, which = np.unique(flat[inner] << 32 | flat[inner + 1], return_inverse=True)
            cnt, vol = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
            np.add.at(cnt, which, freq[row[inner]])
            np.add.at(vol, which, np.minimum(size, LONG_WORD)[row[inner]])
            columns = [(pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32), cnt, vol]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["l", "r", "cnt", "vol"])

    part = words.select("freq", "ids").mapInArrow(count, "l int, r int, cnt long, vol long")
    return part.groupBy("l", "r").agg(F.sum("cnt").alias("cnt"), F.sum("vol").alias("vol"))


def _neighbour_stats(words: DataFrame, pairs: list[tuple[int, int]]) -> tuple[dict, dict]:
    """For candidate pairs ``p = (l, r)`` (a short list) and the triples around
    them: ``bounds[p]`` = the largest summed triple count next to ``p`` (an upper bound on
    any pair merging ``p`` creates) and ``destroyed[(p, q)]`` = the summed count of triples
    ``x l r`` / ``l r y`` whose other pair ``q = (x, l)`` / ``(r, y)`` is also a candidate
    (occurrences of ``q`` that merging ``p`` removes). Both results are bounded by the
    candidate count, not by the data."""
    keys = _pair_keys(pairs)

    def count(batches):
        for freq, flat, row in _symbols(batches):
            if len(flat) < 3:
                continue
            ends = np.flatnonzero(row[2:] == row[:-2])  # the triples' first symbols
            side = flat[:-1] << 32 | flat[1:]
            at = np.minimum(np.searchsorted(keys, side), len(keys) - 1)
            held = keys[at] == side
            # Triple (x, y, z): merging (y, z) touches (x, y); merging (x, y) touches (y, z).
            right, left = ends[held[ends + 1]], ends[held[ends]]
            what = np.concatenate([at[right + 1] << 33 | flat[right], at[left] << 33 | 1 << 32 | flat[left + 2]])
            found, which = np.unique(what, return_inverse=True)
            c = np.zeros(len(found), np.int64)
            np.add.at(c, which, freq[row[np.concatenate([right, left])]])
            pair = keys[found >> 33]
            columns = [(pair >> 32).astype(np.int32), (pair & 0xFFFFFFFF).astype(np.int32), (found >> 32 & 1).astype(np.int32), (found & 0xFFFFFFFF).astype(np.int32), c]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["l", "r", "side", "o", "c"])

    per = (
        words.select("freq", "ids")
        .mapInArrow(count, "l int, r int, side int, o int, c long")
        .groupBy("l", "r", "side", "o")
        .agg(F.sum("c").alias("c"))
        .coalesce(words.rdd.getNumPartitions())
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    cands = words.sparkSession.createDataFrame(pairs, "l int, r int")
    q = cands.select(F.col("l").alias("ql"), F.col("r").alias("qr"))
    left_q = per.where("side = 0").join(F.broadcast(q), (F.col("o") == F.col("ql")) & (F.col("l") == F.col("qr")))
    right_q = per.where("side = 1").join(F.broadcast(q), (F.col("r") == F.col("ql")) & (F.col("o") == F.col("qr")))
    # One collect for both results; ``per`` is cached so it is aggregated once.
    rows = (
        per.groupBy("l", "r")
        .agg(F.max("c").alias("c"))
        .select("l", "r", F.lit(None).cast("int").alias("ql"), F.lit(None).cast("int").alias("qr"), "c")
        .unionByName(left_q.unionByName(right_q).select("l", "r", "ql", "qr", "c"))
        .collect()
    )
    bounds: dict = {}
    destroyed: dict = {}
    for r in rows:
        if r["ql"] is None:
            bounds[(r["l"], r["r"])] = r["c"]
        else:
            key = ((r["l"], r["r"]), (r["ql"], r["qr"]))
            destroyed[key] = max(destroyed.get(key, 0), r["c"])
    per.unpersist()
    return bounds, destroyed


def _upper(q: tuple[int, int], count: int, accepted: list[tuple[int, int, int]], destroyed: dict) -> int:
    """Upper bound on the count of a passed-over pair ``q`` after the accepted merges:
    its old count minus the occurrences the most destructive single merge removes (the
    accepted merges are non-self and never overlap one another, so each of them merges
    every one of its occurrences and removes every occurrence of ``q`` it overlaps)."""
    removed = max((destroyed.get(((a, b), q), 0) for a, b, _ in accepted), default=0)
    return count - removed


WORD_TYPE = "freq long, ids array<int>"


def _pair_keys(pairs) -> np.ndarray:
    """Pairs of ids as one sorted array of 64-bit keys."""
    xs = np.array(sorted(pairs), np.int64).reshape(-1, 2)
    return xs[:, 0] << 32 | xs[:, 1]


def _rows_with(ids: pa.ListArray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids laid end to end, the offsets of the rows, the rows that hold one of the pairs."""
    flat, at = ids.flatten().to_numpy().astype(np.int64), ids.offsets.to_numpy().astype(np.int64)
    at = at - at[0]
    hit = np.zeros(len(flat), bool)
    if len(flat) > 1:
        pairs = flat[:-1] << 32 | flat[1:]
        hit[:-1] = keys[np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)] == pairs
        ends = at[1:][at[1:] > 0] - 1
        hit[ends] = False
    return flat, at, np.unique(np.searchsorted(at, np.flatnonzero(hit), side="right") - 1)


def _words_with(words: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """The words that hold one of the pairs, packed (the driver gets them): a row for those of
    some batches, with the symbols they have."""
    keys = _pair_keys(pairs)

    def packed(found):
        words = pa.Table.from_batches(found).combine_chunks()
        return pa.RecordBatch.from_arrays([pa.array([len(words["ids"].combine_chunks().flatten())]), pa.array([_packed(words)], pa.binary())], names=["symbols", "words"])

    def of(batches):
        found, n = [], 0
        for b in batches:
            rows = _rows_with(b.column(1), keys)[2]
            if len(rows):
                found.append(b.take(pa.array(rows)))
                n += len(rows)
            if n >= PACKED_WORDS:
                yield packed(found)
                found, n = [], 0
        if found:
            yield packed(found)

    return words.select("freq", "ids").mapInArrow(of, "symbols long, words binary")


def _packed(words: pa.Table) -> bytes:
    """Frequencies and ids as a compressed Arrow stream."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, words.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(words)
    return out.getvalue().to_pybytes()


def _unpacked(words: bytes) -> tuple[pa.ChunkedArray, pa.ChunkedArray]:
    got = pa.ipc.open_stream(words).read_all()
    return got["freq"], got["ids"]


def _laid_out(words: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequencies, ids end to end, sizes of packed words."""
    freq, ids = (x.combine_chunks() for x in _unpacked(words))
    return freq.to_numpy(), ids.flatten().to_numpy(), np.diff(ids.offsets.to_numpy())


def _merge_ids(ids: list[int], rank: dict[tuple[int, int], int], merges: list[tuple[int, int, int]]) -> list[int]:
    """The merges one after the other, each left to right."""
    heap = [(rank[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in rank]
    heapq.heapify(heap)
    alive = list(ids)
    nxt, prv = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
    while heap:
        k, i = heapq.heappop(heap)
        a, b, new = merges[k]
        j = nxt[i]
        if alive[i] != a or j == -1 or alive[j] != b:
            continue
        alive[i], alive[j] = new, -1
        nxt[i] = nxt[j]
        if nxt[j] != -1:
            prv[nxt[j]] = i
        for x, y in ((prv[i], i), (i, nxt[i])):
            # A merge that is already done does not come again.
            if x != -1 and y != -1 and (r := rank.get((alive[x], alive[y]), -1)) > k:
                heapq.heappush(heap, (r, x))
    return [x for x in alive if x != -1]


def _pairs_merged(flat: np.ndarray, row: np.ndarray, a: int, b: int) -> np.ndarray:
    """The places of the left symbols of (a, b) within the words, left to right, none overlapping."""
    at = np.flatnonzero((flat[:-1] == a) & (flat[1:] == b) & (row[:-1] == row[1:]))
    return at if a != b else _every_other(at, at[1:] == at[:-1] + 1)


def _every_other(at: np.ndarray, goes_on: np.ndarray) -> np.ndarray:
    """Of places in turn, ``goes_on`` where one overlaps the one before: the first, third, ... of
    each run."""
    if not len(at):
        return at
    k = np.arange(len(at))
    first = np.maximum.accumulate(np.where(np.concatenate([[True], ~goes_on]), k, 0))
    return at[(k - first) % 2 == 0]


def _merged_words(flat: np.ndarray, sizes: np.ndarray, merges: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Words laid end to end after the merges, one after the other: the ids and the words' sizes."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    for a, b, new in merges:
        at = _pairs_merged(flat, row, a, b)
        if len(at):
            kept = np.ones(len(flat), bool)
            kept[at + 1] = False
            flat[at] = new
            flat, row = flat[kept], row[kept]
    return flat, np.bincount(row, minlength=len(sizes))


def _apply_merges(words: DataFrame, merges: list[tuple[int, int, int]]) -> DataFrame:
    """Words after the merges (no pair comes twice among them)."""
    rank = {(a, b): k for k, (a, b, _) in enumerate(merges)}
    keys = _pair_keys(rank)

    def of(batches):
        for b in batches:
            flat, at, rows = _rows_with(b.column(1), keys)
            size, row = np.diff(at), np.repeat(np.arange(len(at) - 1), np.diff(at))
            if len(rows):
                touched = np.zeros(len(size), bool)
                touched[rows] = True
                mine = flat[touched[row]]
                if len(merges) <= FEW_MERGES:
                    mine, sizes = _merged_words(mine, size[rows], merges)
                else:  # word by word
                    ends = np.cumsum(size[rows])
                    out = [_merge_ids(mine[y - n : y].tolist(), rank, merges) for n, y in zip(size[rows].tolist(), ends.tolist(), strict=True)]
                    mine, sizes = np.array([x for one in out for x in one], np.int64), np.array([len(x) for x in out])
                size[rows] = sizes
                kept = np.arange(len(flat)) - at[:-1][row] < size[row]
                flat, row = flat[kept], row[kept]
                flat[touched[row]] = mine
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["freq", "ids"])

    return words.select("freq", "ids").mapInArrow(of, WORD_TYPE)


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of the keys in the keys' order, where each distinct key begins and ends there."""
    order = np.argsort(keys, kind="stable")
    got = keys[order]
    cuts = np.flatnonzero(got[1:] != got[:-1]) + 1
    return order, np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])


def _merge_run(freqs: np.ndarray, ids: np.ndarray, sizes: np.ndarray, counts: dict[tuple[int, int], int], stop: tuple[int, int, int], first_new: int, accept):
    """Merges one at a time over the words that hold the candidates (``counts``, over all
    words; the words' ``ids`` end to end), as long as the best pair comes before ``stop``, the
    place in the order (-count, l, r) of the first pair that is no candidate. Pairs that are not
    tracked only lose occurrences, except where a merge reuses a token: such a pair is tracked
    with an upper bound, and the run ends when that is the best. A pair with a token made for the
    first time is tracked only if it comes before ``stop``: it gets no more occurrences.
    ``accept(a, b)`` gives the id of a merged token, or None at the end of the training.

    A symbol knows the places of its neighbours in the word (-1: none); of each tracked pair the
    places of its left symbols are kept, which may have gone since."""
    n = len(ids)
    word = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    ends = np.cumsum(sizes)[sizes > 0]
    nxt[ends - 1] = -1
    prv[ends - sizes[sizes > 0]] = -1
    keys = _pair_keys(counts)
    places, which = [np.empty(0, np.int32)], [np.empty(0, np.int32)]
    for lo in range(0, n, TOGETHER):
        first = lo + np.flatnonzero(nxt[lo : lo + TOGETHER] >= 0).astype(np.int32)
        pairs = ids[first].astype(np.int64) << 32 | ids[first + 1]
        at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
        held = keys[at] == pairs
        places.append(first[held])
        which.append(at[held].astype(np.int32))
    first, at = np.concatenate(places), np.concatenate(which)
    del places, which
    where: dict[tuple[int, int], list[np.ndarray]] = {p: [] for p in counts}
    if len(at):
        order, begin, end = _grouped(at)
        first = first[order]
        for k, x, y in zip(keys[at[order[begin]]].tolist(), begin.tolist(), end.tolist(), strict=True):
            where[k >> 32, k & 0xFFFFFFFF].append(first[x:y])
        del order
    del at, first
    heap = [(-c, *p) for p, c in counts.items()]
    heapq.heapify(heap)
    loose: set[tuple[int, int]] = set()
    done: set[tuple[int, int]] = set()
    made: set[int] = set()
    merges: list[tuple[int, int, int]] = []
    marked = np.zeros(n, bool)

    def beside(places: np.ndarray, others: np.ndarray) -> np.ndarray:
        """The places that are there and none of the others."""
        places = places[places >= 0]
        marked[others] = True
        places = places[~marked[places]]
        marked[others] = False
        return places

    def pairs_at(places: np.ndarray):
        """The pairs that begin at the places, with how often they come and their places."""
        if not len(places):
            return ()
        keys = ids[places].astype(np.int64) << 32 | ids[nxt[places]]
        order, begin, end = _grouped(keys)
        places = places[order]
        f = np.add.reduceat(freqs[word[places]], begin)
        return zip(keys[order[begin]].tolist(), f.tolist(), begin.tolist(), end.tolist(), itertools.repeat(places))

    while heap:
        c, a, b = heapq.heappop(heap)
        p = (a, b)
        if p not in counts:
            continue
        if counts[p] != -c:
            heapq.heappush(heap, (-counts[p], a, b))
            continue
        if (c, a, b) >= stop or p in loose or p in done:
            break
        new = accept(a, b)
        if new is None:
            break
        merges.append((a, b, new))
        done.add(p)
        first_made = new >= first_new and new not in made
        made.add(new)
        risen = set()
        left, where[p] = where[p], []
        if not left:
            continue
        left = np.concatenate(left)
        left = left[(ids[left] == a) & (nxt[left] >= 0)]
        left = left[ids[nxt[left]] == b]
        if a == b:
            left.sort()
            left = _every_other(left, left[1:] == nxt[left[:-1]])
        right = nxt[left]
        after = nxt[right]
        ends = after >= 0
        gone = np.concatenate([left, right[ends], beside(prv[left], right)])
        for k, f, *_ in pairs_at(gone):
            q = (k >> 32, k & 0xFFFFFFFF)
            if q in counts:
                counts[q] -= f
        ids[left], ids[right] = new, -1
        nxt[left] = after
        prv[after[ends]] = left[ends]
        # What stands before has changed where that was merged too.
        for k, f, x, y, places in pairs_at(np.concatenate([left[ends], beside(prv[left], left)])):
            q = (k >> 32, k & 0xFFFFFFFF)
            if q not in counts:
                if first_made and (-f, *q) >= stop:
                    continue  # all of its occurrences, and these only go
                counts[q], where[q] = 0 if first_made else -stop[0], []
                if not first_made:
                    loose.add(q)
            counts[q] += f
            where[q].append(places[x:y])
            risen.add(q)
        for q in risen:
            heapq.heappush(heap, (-counts[q], *q))
    return merges


def _wide_round(spark, words: DataFrame, top: list, first_new: int, accept) -> list[tuple[int, int, int]]:
    """A round that collects counts only, for pairs that too many words hold."""
    bounds, destroyed = {}, {}
    if len(top) > 1:
        bounds, destroyed = _neighbour_stats(words, [(r["l"], r["r"]) for r in top])
    accepted: list[tuple[int, int, int]] = []
    skipped: list[tuple[tuple[int, int], int]] = []  # (pair, count) passed over
    bound = -1  # largest count a pair created by the accepted merges can reach
    self_pair = False
    for row in top:
        a, b, cnt = row["l"], row["r"], row["cnt"]
        if accepted:
            if cnt <= bound:
                break
            # A pair passed over must now count strictly less than this candidate.
            if any(_upper(q, qc, accepted, destroyed) >= cnt for q, qc in skipped):
                break
            # Merging (pa, pb) can only remove occurrences of (a, b) where they overlap:
            # pb == a (x a b -> (x a) merged) or pa == b (a b y -> (b y) merged).
            if any(pb == a or pa == b for pa, pb, _ in accepted):
                if self_pair or a == b:
                    break
                skipped.append(((a, b), cnt))
                continue
        new_id = accept(a, b)
        if new_id is None:
            break
        accepted.append((a, b, new_id))
        bound = max(bound, bounds.get((a, b), 0))
        self_pair = self_pair or a == b
        if new_id < first_new:
            break
    return accepted


def _collected_round(words: DataFrame, top: list, first_new: int, min_count: int, accept) -> list[tuple[int, int, int]] | None:
    """A round over the collected words of as many top pairs as ``MOST_SYMBOLS`` allows;
    None if these are few."""
    vol = np.cumsum([r["vol"] for r in top])
    n = min(int(np.searchsorted(vol, MOST_SYMBOLS, side="right")), MOST_PAIRS)
    while n >= min(FEW_PAIRS, len(top)):
        found = _words_with(words, [(r["l"], r["r"]) for r in top[:n]]).persist(StorageLevel.MEMORY_AND_DISK)
        symbols = found.agg(F.sum("symbols")).first()[0] or 0
        got = [_laid_out(r["words"]) for r in found.select("words").toLocalIterator()] if symbols <= MOST_SYMBOLS else None
        found.unpersist()
        if got is not None:
            stop = (-top[n]["cnt"], top[n]["l"], top[n]["r"]) if n < len(top) else (1 - min_count, -1, -1)
            counts = {(r["l"], r["r"]): r["cnt"] for r in top[:n]}
            freqs, ids, sizes = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.empty(0, t) for t in (np.int64, np.int32, np.int64))
            del got
            return _merge_run(freqs, ids, sizes, counts, stop, first_new, accept)
        n //= 2
    return None


def train_bpe(
    texts: DataFrame,
    vocab_size: int,
    min_frequency: int = 2,
    special_tokens: list[str] | None = None,
    text_col: str = "text",
    max_samples: int | None = None,
    order_col: str | None = None,
    candidates: int = 256,
    checkpoint_every: int = 8,
    num_merges: int | None = None,
) -> BpeModel:
    """Learn a BPE vocabulary (exactly the one-merge-at-a-time result, see module doc).

    ``num_merges`` (optional) caps the vocabulary at specials + alphabet + that many
    merges instead of a fixed ``vocab_size`` (the smaller of the two applies)."""
    specials = list(DEFAULT_SPECIALS if special_tokens is None else special_tokens)
    src = texts
    if max_samples is not None:
        if not order_col:
            raise ValueError("max_samples needs order_col: without an order the rows are any")
        from .reshape import sample_cap

        src = sample_cap(src, max_samples, [order_col])
    # The word table is aggregated once and cached: the alphabet and the first round read it.
    freqs = word_frequencies(src, text_col).persist(StorageLevel.MEMORY_AND_DISK)
    alphabet = sorted(r["ch"] for r in char_alphabet(freqs).select("ch").collect())
    vocab = specials + [c for c in alphabet if c not in specials]
    tok2id: dict[str, int] = {}
    for i, t in enumerate(vocab):
        tok2id.setdefault(t, i)
    merges: list[tuple[str, str]] = []
    n_alphabet = len(vocab) - len(specials)
    if num_merges is not None:
        vocab_size = min(vocab_size, len(tok2id) + num_merges)
    if len(tok2id) >= vocab_size:
        freqs.unpersist()
        return BpeModel(vocab, merges, specials, 0, len(vocab) - len(specials))

    spark = texts.sparkSession
    ckpt_base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/bpe-{uuid.uuid4().hex}"
    char_ids = F.create_map(*[x for c in alphabet for x in (F.lit(c), F.lit(tok2id[c]))])
    ids = F.transform(code_points(F.col("word")), lambda ch: F.element_at(char_ids, ch))
    # Size the iterated table by its own row count, not by the session's shuffle setting:
    # every round runs over it, so hundreds of near-empty partitions would dominate.
    n_words = freqs.count()
    parts = max(spark.sparkContext.defaultParallelism, -(-n_words // WORDS_PER_PARTITION))
    words = (
        freqs.select("freq", ids.alias("ids"))
        .repartition(parts)
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    words.count()
    freqs.unpersist()
    min_count = max(min_frequency, 1)
    id2tok = dict(enumerate(vocab))
    rounds = 0

    def accept(a: int, b: int) -> int | None:
        if len(tok2id) >= vocab_size:
            return None
        new_tok = id2tok[a] + id2tok[b]
        new_id = tok2id.get(new_tok)
        if new_id is None:
            new_id = len(vocab)
            vocab.append(new_tok)
            tok2id[new_tok] = new_id
            id2tok[new_id] = new_tok
        merges.append((id2tok[a], id2tok[b]))
        return new_id

    while len(tok2id) < vocab_size:
        counts = _pair_counts(words).where(F.col("cnt") >= min_count)
        # As Arrow: ``collect`` would send the first rows of every partition to the driver.
        top = counts.orderBy(F.col("cnt").desc(), "l", "r").limit(MOST_PAIRS + 1).toArrow().to_pylist()
        if not top:
            break
        accepted = _collected_round(words, top, len(vocab), min_count, accept)
        if accepted is None:
            accepted = _wide_round(spark, words, top[:candidates], len(vocab), accept)
        rounds += 1
        nxt = _apply_merges(words, accepted)
        if rounds % checkpoint_every == 0:
            # Cut the lineage with a written table in the shared checkpoint folder. Two
            # slots alternate, so disk use stays at two copies of the table: the slot
            # overwritten now was read two cuts ago and nothing depends on it any more.
            slot = f"{ckpt_base}/slot-{(rounds // checkpoint_every) % 2}"
            nxt.write.mode("overwrite").parquet(slot)
            nxt = spark.read.parquet(slot)
        nxt = nxt.persist(StorageLevel.MEMORY_AND_DISK)
        # Filled before the table it is made from goes, or it would be made from the texts again.
        nxt.count()
        words.unpersist()
        words = nxt
    words.unpersist()
    _delete_path(spark, ckpt_base)
    return BpeModel(vocab, merges, specials, rounds, n_alphabet)


def _delete_path(spark, path: str) -> None:
    """Remove a scratch folder through the Hadoop FileSystem of the session."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # best effort: a leftover scratch folder is harmless
        pass


def build_vocab(spark, model: BpeModel) -> DataFrame:
    """Vocabulary table ``(token, id, kind)``: special, alphabet, merge."""
    # Counted when the alphabet was laid down: a merge may reuse a token, so the number of
    # merges says nothing about the number of tokens they added.
    n_alpha = len(model.specials) + model.n_alphabet
    rows = []
    for i, t in enumerate(model.vocab):
        kind = "special" if i < len(model.specials) else ("alphabet" if i < n_alpha else "merge")
        rows.append((t, i, kind))
    return spark.createDataFrame(rows, "token string, id int, kind string")


def merges_table(spark, model: BpeModel) -> DataFrame:
    return spark.createDataFrame(
        [(i, a, b) for i, (a, b) in enumerate(model.merges)], "rank int, left string, right string"
    )


# --- encoding ---------------------------------------------------------------------------

WORDS_KEPT = 200_000
_WORDS: dict[str, dict[str, bytes]] = {}


def _encode_word(word: str, tok2id: dict[str, int], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Merge a word's characters by lowest merge rank first (leftmost on ties); characters
    outside the vocabulary are dropped (no unknown token)."""
    syms = [c for c in word if c in tok2id]
    if len(syms) < 2 or not ranks:
        return syms
    heap = [(ranks[(syms[i], syms[i + 1])], i) for i in range(len(syms) - 1) if (syms[i], syms[i + 1]) in ranks]
    heapq.heapify(heap)
    alive = list(syms)
    nxt = list(range(1, len(syms))) + [-1]
    prv = [-1] + list(range(len(syms) - 1))
    while heap:
        rank, i = heapq.heappop(heap)
        j = nxt[i]
        if alive[i] is None or j == -1 or alive[j] is None or ranks.get((alive[i], alive[j])) != rank:
            continue
        alive[i] = alive[i] + alive[j]
        alive[j] = None
        nxt[i] = nxt[j]
        if nxt[j] != -1:
            prv[nxt[j]] = i
        p = prv[i]
        if p != -1 and (alive[p], alive[i]) in ranks:
            heapq.heappush(heap, (ranks[(alive[p], alive[i])], p))
        if nxt[i] != -1 and (alive[i], alive[nxt[i]]) in ranks:
            heapq.heappush(heap, (ranks[(alive[i], alive[nxt[i]])], i))
    return [s for s in alive if s is not None]


def _ids_of(rows: pa.ListArray, kept: dict[str, bytes], tok2id: dict[str, int], ranks: dict[tuple[str, str], int]) -> pa.ListArray:
    """The ids of rows of words; ``kept`` has those of words met before. The distinct words of a
    slice are looked up once, its ids are put together by Arrow."""
    out = []
    for some in slices(rows):
        # Null rows have no words here.
        coded = some.flatten().dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        found = []
        for w in coded.dictionary.to_pylist():
            got = kept.get(w)
            if got is None:
                got = np.array([tok2id[x] for x in _encode_word(w, tok2id, ranks)], np.int32).tobytes()
                if len(kept) >= WORDS_KEPT:
                    kept.clear()
                if len(w) <= LONG_WORD:
                    kept[w] = got
            found.append(got)
        ends = np.concatenate([[0], np.cumsum([len(x) >> 2 for x in found], dtype=np.int64)])
        distinct = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int32)))
        words = distinct.take(coded.indices)
        n_words = pc.fill_null(pc.list_value_length(some), 0).to_numpy(zero_copy_only=False)
        rows_at = np.concatenate([[0], np.cumsum(n_words, dtype=np.int64)])
        out.append(pa.ListArray.from_arrays(pa.array(words.offsets.to_numpy()[rows_at], pa.int32()), words.values))
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))


def encode_texts(df: DataFrame, model: BpeModel, text_col: str = "text", lower: bool = True) -> DataFrame:
    """Adds ``tokens ARRAY<STRING>`` and ``ids ARRAY<INT>`` (no truncation/padding).

    Lower-casing and pre-tokenizing are the same Spark expressions as in training; only the
    merging of a word runs in Python, over Arrow batches (``spark.sql.execution.arrow``'s rows
    and bytes). The model (bounded by ``vocab_size``) is broadcast; a worker keeps the ids of
    the words it has merged between batches and tasks (at most ``WORDS_KEPT``, none longer than
    ``LONG_WORD``), makes Python strings of the words of ``SLICE_BYTES`` at a time and writes the
    ids to one array. The tokens are looked up by the ids, and only if asked for. Nothing is
    shuffled: joining distinct words back would move every token of the corpus."""
    tok2id = model.token_to_id
    ranks: dict[tuple[str, str], int] = {}
    for i, pair in enumerate(model.merges):
        ranks.setdefault(pair, i)
    name = uuid.uuid4().hex
    bc = df.sparkSession.sparkContext.broadcast((tok2id, ranks, model.vocab))

    @F.arrow_udf(PT.ArrayType(PT.IntegerType()))
    def enc(rows: pa.Array) -> pa.Array:
        return _ids_of(rows, _WORDS.setdefault(name, {}), *bc.value[:2])

    @F.arrow_udf(PT.ArrayType(PT.StringType()))
    def tokens(rows: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(rows.offsets, pa.array(bc.value[2]).take(rows.values))

    from ..session import ensure_parallelism

    words = T.pretokenize(normalize_text(text_col) if lower else F.col(text_col))
    encoded = ensure_parallelism(df).withColumn("_ids", enc(words))
    return encoded.select("*", tokens("_ids").alias("tokens"), F.col("_ids").alias("ids")).drop("_ids")


def save_model(spark, model: BpeModel, path: str) -> None:
    """The model as two tables under ``path``: ``vocab`` (token, id, kind) and ``merges``."""
    build_vocab(spark, model).coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/vocab")
    merges_table(spark, model).coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/merges")


def load_model(spark, path: str) -> BpeModel:
    """What ``save_model`` wrote (both tables are bounded by the vocabulary's size)."""
    vocab = sorted(spark.read.parquet(f"{path.rstrip('/')}/vocab").collect(), key=lambda r: r.id)
    merges = sorted(spark.read.parquet(f"{path.rstrip('/')}/merges").collect(), key=lambda r: r["rank"])
    kinds = [r.kind for r in vocab]
    return BpeModel(
        [r.token for r in vocab], [(r.left, r.right) for r in merges], [r.token for r in vocab if r.kind == "special"], 0, kinds.count("alphabet")
    )


def truncate_pad(ids: Column | str, max_length: int, pad_id: int = 0) -> list[Column]:
    """``input_ids`` cut to ``max_length`` and right-padded with ``pad_id``;
    ``attention_mask`` 1 on real tokens, 0 on padding."""
    c = F.col(ids) if isinstance(ids, str) else ids
    cut = F.slice(c, 1, max_length)
    n = F.size(cut)
    padded = F.concat(cut, F.array_repeat(F.lit(pad_id), F.lit(max_length) - n))
    mask = F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(max_length) - n))
    return [padded.alias("input_ids"), mask.alias("attention_mask")]
