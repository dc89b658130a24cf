"""Prefix trie of conversations as flat node tables behind minimal perfect hashes.

A node is a distinct sequence of first turns (role, text); a conversation is a member of
every node it starts with, the textless root among them.

Method. A turn is a digest of its position and its words, a prefix the sum of its turns'
digests (four sums modulo 2**32), so prefix digests are running sums and need neither the
texts nor a whole conversation in one place: conversations are cut into segments of
``SEGMENT`` turns whose sums are carried over. Rows (conversation, depth, prefix digest,
parent's digest) are dealt to shards by conversation and segment, ``SHARD_ROWS`` of them on
average. A shard enumerates its distinct digests and gives them slots by a minimal perfect
hash; a slot holds its digest, so a lookup that another digest hashed to is told apart.
Counts are scattered into flat numpy arrays by slot. Node partials are then added up over
shards, where a digest that stands for two different prefixes raises an error. A node is
owned by its smallest member; in the second pass the shard that holds the owner's row gives
the node its weight, and every shard adds its weights up through the array of parent slots,
deepest nodes first. As a node's whole path is in its owner's shard (or, for a long
conversation, in the shards of its segments, which pass on the sums of later ones), adding
the shards' sums of a node gives the sum over its subtree, each node counted once.

Skew: a turn that starts a third of all conversations is one partial row per shard; a
conversation with a third of all turns is many segments; the members that end at one node
are hashed in blocks (``ends_digests``). Nothing is collected but row counts.

Results. Turns are in ``turn`` order, nulls first, turns of one number by their digest, so
repeated rows follow each other as turns of their own. Null role or text is empty. Rows
without ``conv_id`` belong to no conversation. A conversation without turns (``convs`` may
list some) is a member of the root alone. An empty table has no nodes. Other columns are
not read, whatever their names."""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.numbering import number_rows
from .common import written

SEGMENT = 4096
SHARD_ROWS = 1 << 15
BLOCK_IDS = 1 << 13
LIMBS = ("l1", "l2", "l3", "l4")
LOW32 = (1 << 32) - 1
CLASH = "one digest stands for two prefixes"


class Trie(NamedTuple):
    """nodes: node1, node2 (the digest), conv_id, depth, parent_conv_id, n_convs, n_ends,
    n_children, n_leaves, saved_tokens. ends: node1, node2, conv_id, a row for each
    conversation, at the node of all its turns."""

    nodes: DataFrame
    ends: DataFrame


def conversation_turns(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(turns, convs): a row (conv, pos, said, other, size) for each turn, with its place from
    0, two digests of role and text, and the text's bytes; and (conv, n) for each conversation.
    Places come from running numbers over all rows, so no conversation is sorted in one task."""
    role_text = [F.coalesce(F.col(c), F.lit("")) for c in (role, text)]
    marked = F.concat(F.length(role_text[0]).cast("string"), F.lit(":"), *role_text)
    keyed = rows.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"),
        F.col(turn).alias("turn"),
        F.md5(marked.cast("binary")).alias("said"),
        F.xxhash64(*role_text).alias("other"),
        F.octet_length(role_text[1]).cast("long").alias("size"),
        F.monotonically_increasing_id().alias("row"),
    )
    numbered = number_rows(keyed, ["conv", "turn", "said", "row"], "number", 0)
    convs = written(numbered.groupBy("conv").agg(F.min("number").alias("first"), F.count("*").alias("n")), "trie-convs")
    turns = numbered.join(convs, "conv").select("conv", (F.col("number") - F.col("first")).alias("pos"), "said", "other", "size")
    return turns, convs.select("conv", "n")


def prefix_rows(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each (conversation, depth from 0): node and parent digests as two longs each,
    the last turn's size and second digest, whether it is the conversation's last, and seg."""
    mixed = F.md5(F.concat_ws(":", F.col("pos").cast("string"), "said").cast("binary"))
    limbs = [F.conv(F.substring("mixed", 8 * i + 1, 8), 16, 10).cast("long").alias(x) for i, x in enumerate(LIMBS)]
    seg = F.floor(F.col("pos") / SEGMENT).cast("long")
    t = turns.select("*", seg.alias("seg"), mixed.alias("mixed")).select("conv", "seg", "pos", "size", "other", *limbs)
    sums = t.join(convs.where(F.col("n") > SEGMENT).select("conv"), "conv", "left_semi").groupBy("conv", "seg").agg(*[F.sum(x).alias(x) for x in LIMBS])
    earlier = Window.partitionBy("conv").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("conv", "seg", *[F.coalesce(F.sum(F.col(x).bitwiseAND(LOW32)).over(earlier), F.lit(0)).alias(f"b{x}") for x in LIMBS])
    upto = Window.partitionBy("conv", "seg").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = t.select("*", *[F.sum(x).over(upto).alias(f"s{x}") for x in LIMBS]).join(before, ["conv", "seg"], "left")
    total = {x: (F.col(f"s{x}") + F.coalesce(F.col(f"b{x}"), F.lit(0))) for x in LIMBS}

    def pair(limb, a, b):
        return F.shiftleft(limb(a).bitwiseAND(LOW32), 32).bitwiseOR(limb(b).bitwiseAND(LOW32))

    now, gone = (lambda x: total[x]), (lambda x: total[x] - F.col(x))
    nodes = run.select(
        "conv", "seg", (F.col("pos") + 1).alias("depth"), "size", "other",
        pair(now, "l1", "l2").alias("d1"), pair(now, "l3", "l4").alias("d2"),
        pair(gone, "l1", "l2").alias("p1"), pair(gone, "l3", "l4").alias("p2"),
    )
    zero = F.lit(0).cast("long")
    roots = convs.select("conv", zero.alias("seg"), zero.alias("depth"), zero.alias("size"), zero.alias("other"), *[zero.alias(x) for x in ("d1", "d2", "p1", "p2")])
    return nodes.unionByName(roots).join(convs, "conv").select("*", (F.col("depth") == F.col("n")).alias("last")).drop("n")


class MinimalPerfectHash:
    """Slots 0 to n-1 for n distinct keys of three 64-bit words: in each level the keys that
    alone hash to a place keep it, the others go on to the next; slots are the kept places'
    ranks. ``slots`` compares the key held in the slot and gives -1 for any other key."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, base = np.arange(keys.shape[1]), 0
        self.keys = np.empty_like(keys)
        while len(left):
            if len(self.levels) == 64:
                raise ValueError("keys of a perfect hash must be distinct")
            at = self._place(keys[:, left], len(self.levels), 2 * len(left))
            alone = np.bincount(at, minlength=2 * len(left)) == 1
            rank = base + np.cumsum(alone) - 1
            self.levels.append((alone, rank))
            kept = alone[at]
            self.keys[:, rank[at[kept]]] = keys[:, left[kept]]
            base += int(alone.sum())
            left = left[~kept]

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        x = np.full(keys.shape[1], 0x9E3779B97F4A7C15 * (level + 1) % 2**64, np.uint64)
        for word in keys:
            x = (x ^ word) * np.uint64(0xFF51AFD7ED558CCD)
            x ^= x >> np.uint64(33)
            x *= np.uint64(0xC4CEB9FE1A85EC53)
            x ^= x >> np.uint64(29)
        return (x % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.full(keys.shape[1], -1, np.int64), np.arange(keys.shape[1])
        for level, (alone, rank) in enumerate(self.levels):
            at = self._place(keys[:, left], level, len(alone))
            hit = alone[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        held = np.flatnonzero(out >= 0)
        wrong = (self.keys[:, out[held]] != keys[:, held]).any(axis=0)
        out[held[wrong]] = -1
        return out


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy() for n in names]


def _key(seg: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    return np.stack([x.astype(np.int64).view(np.uint64) for x in (seg, d1, d2)])


NODE = "shard long, slot long, parent_slot long, seg long, echo boolean, d1 long, d2 long, p1 long, p2 long, depth long, size long, other long, n long, n_ends long, conv long"


def shard_nodes(table: pa.Table) -> pa.Table:
    """The nodes of one shard's rows with their slots and the counts scattered to them. An
    ``echo`` is the first node of the next segment, seen from this one: its link to its
    parent counts here, its members there."""
    shard, conv, seg, depth, d1, d2, p1, p2 = _columns(table, "shard", "conv", "seg", "depth", "d1", "d2", "p1", "p2")
    echo, last, size, other = _columns(table, "echo", "last", "size", "other")
    keys = _key(seg, d1, d2)
    order = np.lexsort(keys)
    new = np.concatenate([[True], (keys[:, order[1:]] != keys[:, order[:-1]]).any(axis=0)])
    one = order[new]  # a row of each distinct node
    table_of = MinimalPerfectHash(keys[:, one])
    slot, n = table_of.slots(keys), len(one)
    row = np.empty(n, np.int64)
    row[slot[one]] = one
    if any((x != x[row[slot]]).any() for x in (p1, p2, depth, size, other)):
        raise ValueError(CLASH)
    parent = np.where(depth[row] > 0, table_of.slots(_key(seg[row], p1[row], p2[row])), -1)
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, slot, conv)
    real = ~echo
    cols = {
        "shard": shard[row], "slot": np.arange(n), "parent_slot": parent, "seg": seg[row], "echo": echo[row], "d1": d1[row], "d2": d2[row],
        "p1": p1[row], "p2": p2[row], "depth": depth[row], "size": size[row], "other": other[row],
        "n": np.bincount(slot[real], minlength=n), "n_ends": np.bincount(slot[real & last], minlength=n), "conv": least,
    }
    return pa.table(cols)


SUMS = "d1 long, d2 long, conv_id long, depth long, parent_conv_id long, n_convs long, n_ends long, n_children long, n_leaves long, saved_tokens long"


def shard_sums(table: pa.Table) -> pa.Table:
    """Sums over the subtrees within one shard, through the parent slots, deepest first. Rows
    without a slot bring the sums of a conversation's later segments to its echo."""
    slot = table.column("slot").to_numpy()
    extra = table.filter(pa.array(slot < 0))
    table = table.filter(pa.array(slot >= 0)).sort_by("slot")
    slot, parent, seg, d1, d2, depth = _columns(table, "slot", "parent_slot", "seg", "d1", "d2", "depth")
    echo, conv, owner, n_all, ends_all, size = _columns(table, "echo", "conv", "owner", "n_all", "ends_all", "size")
    n = len(slot)
    owned, real = conv == owner, ~echo
    saved = np.where(owned & real, (n_all - 1) * size, 0).astype(np.int64)
    leaves = np.where(owned & real & (n_all == ends_all), 1, 0).astype(np.int64)
    if extra.num_rows:
        at = {k: i for i, k in enumerate(zip(seg.tolist(), d1.tolist(), d2.tolist(), strict=True)) if echo[i]}
        for k1, k2, k3, add, add_leaves in zip(*(extra.column(c).to_pylist() for c in ("seg", "d1", "d2", "add_saved", "add_leaves")), strict=True):
            saved[at[k1, k2, k3]] += add
            leaves[at[k1, k2, k3]] += add_leaves
    children = np.bincount(parent[owned & (parent >= 0)], minlength=n)
    down = np.argsort(-depth, kind="stable")
    down = down[parent[down] >= 0]
    for idx in np.split(down, np.flatnonzero(np.diff(depth[down])) + 1):
        np.add.at(saved, parent[idx], saved[idx])
        np.add.at(leaves, parent[idx], leaves[idx])
    linked = owned & (parent >= 0)
    mine = owned & real
    of = lambda x, known: pa.array(x, pa.int64(), mask=~known)
    cols = {
        "d1": d1, "d2": d2, "conv_id": of(owner, mine), "depth": of(depth, mine), "parent_conv_id": of(owner[parent], linked),
        "n_convs": of(n_all, mine), "n_ends": of(ends_all, mine), "n_children": np.where(real, children, 0),
        "n_leaves": np.where(real, leaves, 0), "saved_tokens": np.where(real, saved, 0),
    }
    return pa.table(cols)


def later_sums(nodes: DataFrame, convs: DataFrame, echoes: DataFrame) -> DataFrame:
    """For each echo of a conversation of several segments the weights of the nodes that the
    conversation owns in later segments: (shard, seg, d1, d2, add_saved, add_leaves)."""
    long_ones = convs.where(F.col("n") > SEGMENT).select(F.col("conv").alias("owner"))
    seg = F.floor((F.greatest("depth", F.lit(1)) - 1) / SEGMENT).cast("long").alias("seg")
    own = nodes.select("owner", seg, ((F.col("n_all") - 1) * F.col("size")).alias("w"), (F.col("n_all") == F.col("ends_all")).cast("long").alias("leaf"))
    totals = own.join(long_ones, "owner", "left_semi").groupBy("owner", "seg").agg(F.sum("w").alias("w"), F.sum("leaf").alias("leaf"))
    # The total of a segment counts for the echo of the one before it and of all earlier ones.
    moved = totals.select(F.col("owner").alias("conv"), (F.col("seg") - 1).alias("seg"), "w", "leaf")
    onward = Window.partitionBy("conv").orderBy(F.desc("seg")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    with_totals = echoes.select("conv", "seg", "shard", "d1", "d2").join(moved, ["conv", "seg"], "left")
    return with_totals.select(
        "shard", "seg", "d1", "d2", F.sum(F.coalesce("w", F.lit(0))).over(onward).alias("add_saved"), F.sum(F.coalesce("leaf", F.lit(0))).over(onward).alias("add_leaves")
    )


def prefix_trie(turns: DataFrame, convs: DataFrame, shard_rows: int = SHARD_ROWS) -> Trie:
    """The trie of ``turns`` (conv, pos, said, other, size) of the conversations ``convs``
    (conv, n: its number of turns); see ``Trie`` for the columns."""
    rows = written(prefix_rows(turns, convs), "trie-rows")
    shards = -(-rows.count() // shard_rows) or 1
    shard = F.pmod(F.xxhash64("conv", "seg"), F.lit(shards)).alias("shard")
    echoes = rows.where((F.col("depth") > 1) & ((F.col("depth") - 1) % SEGMENT == 0)).withColumn("seg", F.col("seg") - 1)
    both = rows.select("*", F.lit(False).alias("echo")).unionByName(echoes.select("*", F.lit(True).alias("echo"))).select("*", shard)
    local = written(both.groupBy("shard").applyInArrow(shard_nodes, NODE), "trie-shards")

    same = {x: (F.min(x), F.max(x)) for x in ("p1", "p2", "depth", "size", "other")}
    every = local.where("not echo").groupBy("d1", "d2").agg(
        F.sum("n").alias("n_all"), F.sum("n_ends").alias("ends_all"), F.min("conv").alias("owner"),
        *[a.alias(x) for x, (a, _) in same.items()], *[b.alias(f"{x}_most") for x, (_, b) in same.items()],
    )
    clash = F.lit(False)
    for x in same:
        clash = clash | (F.col(x) != F.col(f"{x}_most"))
    checked = F.when(clash, F.raise_error(F.lit(CLASH))).otherwise(F.col("owner"))
    nodes = written(every.select("d1", "d2", "n_all", "ends_all", checked.cast("long").alias("owner"), "depth", "size"), "trie-nodes")

    known = local.select("shard", "slot", "parent_slot", "seg", "echo", "d1", "d2", "depth", "size", "conv")
    known = known.join(nodes.select("d1", "d2", "n_all", "ends_all", "owner"), ["d1", "d2"])
    carried = later_sums(nodes, convs, echoes.select("*", shard)).withColumn("slot", F.lit(-1).cast("long"))
    weighted = known.unionByName(carried, allowMissingColumns=True)
    partial = weighted.groupBy("shard").applyInArrow(shard_sums, SUMS)
    once = [F.max(x).alias(x) for x in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_ends")]
    result = partial.groupBy("d1", "d2").agg(*once, *[F.sum(x).alias(x) for x in ("n_children", "n_leaves", "saved_tokens")])
    ends = rows.where("last").select(F.col("d1").alias("node1"), F.col("d2").alias("node2"), F.col("conv").alias("conv_id"))
    return Trie(result.withColumnsRenamed({"d1": "node1", "d2": "node2"}), ends)


def ends_digests(ends: DataFrame) -> DataFrame:
    """(node1, node2, ends_sha256) of the conversations that end at a node: SHA-256 of their
    decimal ids in ascending order, joined by commas. Ids are sorted over all tasks and sent
    on in blocks of text, so that the one task that must read them all in turn for a node,
    as its hash goes by the byte, reads a row for thousands of them and holds none."""

    def blocks(batches):
        at, ids, first = None, [], None
        done: list[tuple] = []
        for b in batches:
            for x, y, c in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if (x, y) != at or len(ids) >= BLOCK_IDS:
                    if ids:
                        done.append((*at, first, ",".join(ids)))
                    at, ids, first = (x, y), [], c
                ids.append(str(c))
                if len(done) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(list(z)) for z in zip(*done, strict=True)], names=["node1", "node2", "first", "ids"])
                    done = []
        if ids:
            done.append((*at, first, ",".join(ids)))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(z)) for z in zip(*done, strict=True)], names=["node1", "node2", "first", "ids"])

    def hashes(batches):
        at, sha, done = None, None, []
        for b in batches:
            for x, y, ids in zip(*(b.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if (x, y) != at:
                    if at is not None:
                        done.append((*at, sha.hexdigest()))
                    at, sha = (x, y), hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
            if len(done) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(list(z)) for z in zip(*done, strict=True)], names=["node1", "node2", "ends_sha256"])
                done = []
        if at is not None:
            done.append((*at, sha.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(list(z)) for z in zip(*done, strict=True)], names=["node1", "node2", "ends_sha256"])

    order = ["node1", "node2", "conv_id"]
    ranged = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    texts = ranged.mapInArrow(blocks, "node1 long, node2 long, first long, ids string")
    together = texts.repartition("node1", "node2").sortWithinPartitions("node1", "node2", "first")
    return together.mapInArrow(hashes, "node1 long, node2 long, ends_sha256 string")
