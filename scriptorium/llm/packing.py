"""Best-fit packing of documents into sequences of a fixed number of tokens.

Documents are encoded (one end id each) and only those longer than a sequence are cut, so
every piece has a length between 1 and the capacity. Which pieces share a sequence depends
on lengths alone: the number of pieces of each length, a table of at most ``capacity``
rows, is the whole instance. On it the driver

1. reduces by dominance (Martello and Toth): going down the lengths, a length is fixed
   together with the partner set that dominates every other set it could be in -- alone if
   nothing fits, with the largest partner if that fills the sequence, if no two pieces
   fit, or if it outweighs the best pair, or with a pair that no other pair can replace;
   all pieces of equal lengths are fixed at once;
2. packs what remains best-fit decreasing, again a whole class of equal open sequences at
   a time.

The plan is a list of patterns with multiplicities, its size bounded by the capacity, not
by the data. Pieces find their place by their rank among the pieces of their length: ranks
within a task are counted while encoding, the tasks' bases are prefix sums over the
(task, length) counts. No document text is shuffled."""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .token_files import batches_of
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long"


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece of every document: key, piece number, start in the document's ids,
    length, crc32 of its ids, and its place among the task's pieces of that length."""

    def cut(batches):
        from pyspark import TaskContext

        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        names = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("place", pa.int64())]
        names += [("ids", pa.list_(pa.int32()))] if with_ids else []
        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in batches_of(texts):
                rows = []
                for k, ids in zip(keys[lo:hi], enc.encode(texts[lo:hi]), strict=True):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        n = len(own) >> 2
                        rows.append((k, piece, at >> 2, n, zlib.crc32(own), task, int(seen[n])) + ((np.frombuffer(own, "<u4").astype("i4"),) if with_ids else ()))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(zip(*rows), names, strict=True)], schema=pa.schema(names))

    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return rows.mapInArrow(cut, PIECES + (", ids array<int>" if with_ids else ""))


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """(fixed patterns with multiplicities, what remains) of pieces counted by length."""
    left = {s: c for s, c in counts.items() if c}
    sizes = sorted(left)
    fixed: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...]) -> None:
        need = {s: pattern.count(s) for s in pattern}
        n = min(left[s] // k for s, k in need.items())
        fixed.append((pattern, n))
        for s, k in need.items():
            left[s] -= n * k
            if not left[s]:
                del left[s]
                sizes.remove(s)

    def largest(room: int, used: tuple[int, ...]) -> int | None:
        """The largest length up to ``room`` of which a piece is free beside ``used``."""
        i = bisect.bisect_right(sizes, room) - 1
        while i >= 0 and left[sizes[i]] <= used.count(sizes[i]):
            i -= 1
        return sizes[i] if i >= 0 else None

    def smallest_sum(n: int, used: tuple[int, ...]) -> float:
        """Sum of the ``n`` smallest free pieces beside ``used``."""
        total, need = 0, n
        for s in sizes:
            free = left[s] - used.count(s)
            k = min(max(free, 0), need)
            total, need = total + k * s, need - k
            if not need:
                return total
        return float("inf")

    def best_pair(room: int, used: tuple[int, ...]) -> int:
        most = 0
        for a in sizes:
            if a > room or left[a] <= used.count(a):
                continue
            b = largest(min(room - a, a), (*used, a))
            if b is not None:
                most = max(most, a + b)
        return most

    at = capacity
    while at > 0:
        j = largest(at, ())
        if j is None:
            break
        at = j - 1
        while left.get(j):
            room = capacity - j
            k = largest(room, (j,))
            if k is None:
                take((j,))
            elif k == room or smallest_sum(2, (j,)) > room:
                take((j, k))
            elif smallest_sum(3, (j,)) > room and best_pair(room, (j,)) <= k:
                take((j, k))
            elif smallest_sum(3, (j,)) > room and (s := largest(room - k, (j, k))) is not None and s <= k:
                # Every other pair must need a piece above s twice over; if two such do not fit, (k, s) dominates.
                above = next((x for x in sizes[bisect.bisect_right(sizes, s) :] if left[x] > (j, k).count(x)), None)
                if above is not None and 2 * above <= room:
                    break
                take((j, k, s))
            else:
                break
    return fixed, left


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over lengths with counts: a class of equal open sequences takes
    as many pieces as its sequences would one by one."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []
    done: list[tuple[tuple[int, ...], int]] = []

    def put(pattern: tuple[int, ...], n: int) -> None:
        room = capacity - sum(pattern)
        if not room:
            done.append((pattern, n))
        elif n:
            if room not in open_:
                bisect.insort(rooms, room)
                open_[room] = []
            open_[room].append((pattern, n))

    for s in sorted(left, reverse=True):
        c = left[s]
        while c:
            i = bisect.bisect_left(rooms, s)
            if i < len(rooms):
                room = rooms[i]
                pattern, n = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(i)
            else:
                pattern, n, room = (), c, capacity
            each = room // s
            full = min(n, c // each)
            rest = c - full * each if full < n else 0
            put(pattern + (s,) * each, full)
            if rest:
                put(pattern + (s,) * rest, 1)
            if pattern and (over := n - full - bool(rest)):
                put(pattern, over)
            c -= full * each + rest
    return done + [x for xs in open_.values() for x in xs]


def packing_plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, copies in a sequence, first sequence id, offset), ordered:
    piece ``r`` of a length lies in the last row that starts at or before it."""
    fixed, left = reduce_by_dominance(counts, capacity)
    rank = dict.fromkeys(counts, 0)
    rows, first = [], 0
    for pattern, n in fixed + best_fit(left, capacity):
        if not n:
            continue
        offset = 0
        for s in sorted(set(pattern), reverse=True):
            k = pattern.count(s)
            rows.append((s, rank[s], k, first, offset))
            rank[s] += n * k
            offset += s * k
        first += n
    assert rank == {s: c for s, c in counts.items()}, "every piece has a place"
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence and offset (module docstring); with ``with_ids`` also
    its ids. A null text is an empty document (its end id alone); null keys and repeated
    rows are documents like any other; an empty table gives an empty one; other columns
    are not read, whatever their names."""
    spark = docs.sparkSession
    pieces = written(cut_pieces(docs, tokenizer, capacity, end_id, key, text, with_ids), "pieces")
    by_task = written(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-counts")
    plan = packing_plan({int(r[0]): int(r[1]) for r in by_task.groupBy("length").agg(F.sum("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("base"))
    shared = spark.sparkContext.broadcast(plan)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        plan = shared.value
        firsts = plan[:, 0] * (1 << 42) + plan[:, 1]
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        p = plan[np.searchsorted(firsts, length * (1 << 42) + rank, "right") - 1]
        since = rank - p[:, 1]
        return pd.DataFrame({"sequence_id": p[:, 3] + since // p[:, 2], "offset": p[:, 4] + since % p[:, 2] * length})

    # A table that grows with the tasks: its compressed size on disk would let it be broadcast
    # when it is many times that in memory.
    out = pieces.join(bases.hint("merge"), ["task", "length"]).withColumn("at", place("length", F.col("place") + F.col("base")))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset", *(["ids"] if with_ids else []))
