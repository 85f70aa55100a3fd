"""Merkle manifests against a plain tree."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from eventlens.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_levels(nodes, arity):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
    return levels


def plain(rows, arity):
    """{(group, place): (subroot, root, proof, folded)} of (group, key, leaf, replaced)."""
    groups = {}
    for group, key, leaf, replaced in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2])):
        groups.setdefault(group, []).append((key, leaf, replaced))
    trees = {g: plain_levels([leaf for _, leaf, _ in members], arity) for g, members in groups.items()}
    upper = plain_levels([t[-1][0] for t in trees.values()], arity)
    out = []
    for number, (g, members) in enumerate(groups.items()):
        for place, (key, leaf, replaced) in enumerate(members):
            now, siblings = replaced or leaf, []
            for levels, at in ((trees[g], place), (upper, number)):
                for nodes in levels[:-1]:
                    start = at - at % arity
                    run = nodes[start : start + arity]
                    siblings += run[: at - start] + run[at - start + 1 :]
                    run[at - start] = now
                    now, at = h(*run), at // arity
            out.append((g, key, leaf, trees[g][-1][0], upper[-1][0], h(*siblings), now))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("arity", "height", "n", "groups"), [(2, 12, 1, 1), (2, 1, 37, 3), (3, 1, 50, 4), (2, 3, 200, 12)])
def test_manifest_is_that_of_a_plain_tree(spark, arity, height, n, groups):
    rnd = random.Random(n)
    rows = []
    for i in range(n):
        # the first group has most rows, null is a group, a key and a replacement; keys repeat
        group = rnd.choice([None, "ä", "z", "é", *map(str, range(9))][:groups]) if rnd.random() < 0.4 else "z"
        rows.append((group, rnd.choice([None, *range(n)]), h(str(i // 2)), h("other", str(i)) if rnd.random() < 0.3 else None))
    df = spark.createDataFrame(rows, "g string, k long, d string, r string").withColumn("pos", F.lit(1)).withColumn("root", F.lit(2))
    got = merkle.manifest(df, "g", "k", "d", "r", arity=arity, height=height).collect()
    seen = sorted((tuple(r)[:6] for r in got), key=repr)
    want = plain(rows, arity)
    assert seen == sorted((w[:6] for w in want), key=repr)
    if len({(w[0], w[1], w[2]) for w in want}) == len(want):
        assert sorted(map(tuple, got), key=repr) == want


def test_only_replaced_leaves_fail(spark):
    rows = [("a", i, h(str(i)), h("x") if i == 5 else None) for i in range(20)]
    got = merkle.manifest(spark.createDataFrame(rows, "g string, k long, d string, r string"), "g", "k", "d", "r", height=2).collect()
    assert [r.key for r in got if r.folded_root != r.root] == [5]


def test_states_resume_where_the_child_stands():
    nodes = [h(str(i)).encode() for i in range(11)]
    tree = merkle.MidstateTree(nodes, 3)
    for i in range(11):
        assert tree.fold(i, nodes[i]) == tree.top
        other = merkle.MidstateTree([*nodes[:i], b"x", *nodes[i + 1 :]], 3)
        assert tree.fold(i, b"x") == other.top
    assert merkle.MidstateTree(nodes[:1]).top == nodes[0]
    assert merkle.MidstateTree(nodes[:1], 2, levels=2).top == h(h(nodes[0].decode())).encode()


def test_no_rows(spark):
    assert merkle.manifest(spark.createDataFrame([], "g string, k long, d string, r string"), "g", "k", "d", "r").count() == 0


def test_fields_are_told_apart(spark):
    df = spark.createDataFrame([(None, "ä"), ("1:a", "b"), ("", "")], "a string, b string")
    got = [r[0] for r in df.select(merkle.digest_of(F.col("a"), F.col("b"))).collect()]
    assert got == [h("-2:ä"), h("3:1:a1:b"), h("0:0:")]
