"""Prefix trie (op 13) against a trie of Python tuples."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from scriptorium.llm import prefix_trie as trie
from scriptorium.llm.queries import shared_heads, trie_rows

SCHEMA = "conv_id long, turn long, role string, text string, shard int, seg int, n int, node1 string"


def brute(convs):
    """{conv: turns} -> the rows of the trie."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[x] for x in below) if below else 1
        own = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        saved[node] = own + sum(saved[x] for x in below)
    return sorted(
        (
            min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), leaves[node], saved[node],
            hashlib.sha256(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(node)).encode()).hexdigest(),
        )
        for node, m in members.items()
    )


def conversations(rows):
    said = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            r, t = role or "", text or ""
            digest = hashlib.md5(f"{len(r)}:{r}{t}".encode()).hexdigest()
            said[c].append(((turn is not None, turn or 0), digest, r, t))
    return {c: [x[2:] for x in sorted(v)] for c, v in said.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - int(np.fmod(c, 5)), [])[:h] + own[h:]
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rows_of(df):
    return sorted(tuple(r) for r in df.select(COLUMNS).collect())


def made(rng, n, words=3, longest=9):
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, longest)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["", None, "é", *"abcdefgh"[:words]])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("shard_rows,segment", [(trie.SHARD_ROWS, trie.SEGMENT), (40, 3), (7, 2)])
def test_trie_of_random_conversations(spark, monkeypatch, shard_rows, segment):
    monkeypatch.setattr(trie, "SEGMENT", segment)
    rng = random.Random(shard_rows)
    rows = made(rng, 60) + [(100 + k, t, "user", f"same {t}") for k in range(15) for t in range(14)]
    turns, convs = trie.conversation_turns(frame(spark, rows))
    got = trie_rows(trie.prefix_trie(turns, convs, shard_rows))
    assert rows_of(got) == brute(conversations(rows))


def test_rebuilt_conversations_and_edges(spark):
    rows = made(random.Random(5), 40)
    rows += [(None, 1, "user", "no id"), (3, None, "user", "null turn"), (3, 0, "user", "again"), (3, 0, "user", "again"), (-7, 0, "user", "below zero")]
    rows += [(200 + 5 * k + 2, 0, "user", "short") for k in range(12)]  # bases are absent
    turns, convs = shared_heads(*trie.conversation_turns(frame(spark, rows)))
    want = brute(rebuilt(conversations(rows)))
    assert any(d == 0 and len(x) for d, x in ((r[1], r[7]) for r in want))
    assert rows_of(trie_rows(trie.prefix_trie(turns, convs))) == want


def test_registered_query(spark):
    from scriptorium.llm.queries import QUERIES

    from .conftest import SF001

    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/conversations.parquet").collect()]
    got = QUERIES["op13_prefix_trie"][0](spark, SF001)
    assert got.columns[:8] == COLUMNS and rows_of(got) == brute(rebuilt(conversations(rows)))


def test_empty_table(spark):
    turns, convs = shared_heads(*trie.conversation_turns(frame(spark, [(1, 1, "a", "b")]).limit(0)))
    assert trie_rows(trie.prefix_trie(turns, convs)).count() == 0


def test_digest_that_stands_for_two_prefixes_is_an_error(spark):
    turns, convs = trie.conversation_turns(frame(spark, [(1, 1, "a", "b"), (2, 1, "a", "c")]))
    alike = turns.selectExpr("conv", "pos", "'0' as said", "other", "size")
    with pytest.raises(Exception, match="two prefixes"):
        trie.prefix_trie(alike, convs).nodes.collect()


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 1000, 50_000):
        keys = rng.integers(0, 2**63, (3, n), dtype=np.uint64)
        table = trie.MinimalPerfectHash(keys)
        slots = table.slots(keys)
        assert sorted(slots.tolist()) == list(range(n)) and (table.keys[:, slots] == keys).all()
        assert (table.slots(keys + np.uint64(1)) == -1).all()
    with pytest.raises(ValueError):
        trie.MinimalPerfectHash(np.ones((3, 2), np.uint64))


def test_ends_of_one_node_in_many_blocks(spark, monkeypatch):
    ids = [1, 2, 10, 11, 100, *range(200, 20_000)]
    ends = spark.createDataFrame([(1, 2, c) for c in ids] + [(1, 3, 7)], "node1 long, node2 long, conv_id long").repartition(5)
    got = {(r.node1, r.node2): r.ends_sha256 for r in trie.ends_digests(ends).collect()}
    assert got == {(1, 2): hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), (1, 3): hashlib.sha256(b"7").hexdigest()}
