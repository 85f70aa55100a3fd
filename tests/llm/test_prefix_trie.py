"""Prefix tries against a plain trie, whatever the shards and segments."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from eventlens.llm import prefix_trie as pt


def rebuilt(rows, every=20, most=4):
    """{conv: [(role, text), ...]} by the contract; ties of a turn by its digest."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            sign = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(conv, []).append(((turn is not None, turn or 0, sign), (role, text)))
    own = {c: [said for _, said in sorted(turns)] for c, turns in own.items()}
    out = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % most
        base = conv - (conv % every if conv >= 0 else -(-conv % every))
        out[conv] = own.get(base, [])[:h] + turns[h:]
    return out


def plain(conversations):
    nodes = {}
    for conv, turns in conversations.items():
        for depth in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:depth]), []).append(conv)
    saved = {node: (len(members) - 1) * len((node[-1][1] if node else "").split()) for node, members in nodes.items()}
    kids = {}
    for node in nodes:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    totals = {}
    for node in sorted(nodes, key=len, reverse=True):
        below = [totals[k] for k in kids.get(node, [])]
        totals[node] = (sum(b[0] for b in below) or 1, saved[node] + sum(b[1] for b in below))
    out = []
    for node, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(conversations[c]) == len(node))
        parent = min(nodes[node[:-1]]) if node else None
        out.append((min(members), len(node), parent, len(members), len(kids.get(node, [])), *totals[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(spark, rows, **sizes):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit(1)).withColumn("pos", F.lit("x"))
    return sorted(map(tuple, pt.trie(pt.rebuilt(df.repartition(5)), **sizes).collect()), key=repr)


def some(seed, n):
    """Conversations of which many share turns, repeat turns, lack turns, or are very long."""
    rnd = random.Random(seed)
    rows = []
    for conv in rnd.sample(range(-30, 2 * n), n):
        length = rnd.choice([1, 2, 3, 4, 8]) if rnd.random() < 0.95 else 40
        common = rnd.random() < 0.4  # a third and more say the same
        for turn in range(length):
            text = f"all {turn}  say this" if common and (turn < 6 or length == 40) else rnd.choice(["a b", "c", None, "", "ä\tü ö"])
            rows.append((conv, None if rnd.random() < 0.05 else turn, rnd.choice(["user", None, "bot"]) if not common else "user", text))
    return rows + rows[:3] + [(None, 1, "user", "lost")]


@pytest.mark.parametrize(("seed", "n", "shard_turns", "segment_turns"), [(2, 120, 1, 1024), (3, 150, 10, 1024), (4, 80, 7, 3), (5, 60, 100_000, 5)])
def test_trie_is_the_plain_one(spark, seed, n, shard_turns, segment_turns):
    rows = some(seed, n)
    assert rows_of(spark, rows, shard_turns=shard_turns, segment_turns=segment_turns) == plain(rebuilt(rows))


def test_conversations_without_turns_are_members_of_the_root(spark):
    conv = next(c for c in range(1, 100) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(conv, 0, "user", "x"), (conv, 1, "user", "y")]
    assert rebuilt(rows) == {conv: []}
    assert rows_of(spark, rows) == plain({conv: []})


def test_no_conversations(spark):
    assert rows_of(spark, []) == []
    assert rows_of(spark, [(None, 0, "a", "b")]) == []


def test_long_text_and_many_members(spark):
    long = "word " * 400_000
    rows = [(20 * c, 0, "user", long) for c in range(300)] + [(20 * c, 1, "user", str(c % 2)) for c in range(300)]
    assert rows_of(spark, rows, shard_turns=50) == plain(rebuilt(rows))


def test_medians_come_first_and_every_place_once():
    assert list(pt._median_first(7))[0] == 3
    assert sorted(pt._median_first(1000)) == list(range(1000))
    trees = pt.TernaryTrees()
    for i in pt._median_first(1023):
        trees.insert([i])
    depth, level = 0, [trees.first[0]]
    while level:
        depth, level = depth + 1, [c for n in level for c in (trees.low[n], trees.high[n]) if c >= 0]
    assert depth == 10
