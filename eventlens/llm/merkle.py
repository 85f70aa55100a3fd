"""Merkle manifest of a dataset, as a tree of SHA-256 midstates.

A leaf is the digest of a row's fields. Within a group (a language, say) the leaves stand in order; every
``arity`` consecutive nodes become the digest of their concatenation, the last run with fewer, until one
remains, the group's subroot. Subroots, in order of their groups, become the root in the same way.

A parent keeps a copy of its hash state before each child slot. To fold a replaced child, the state before
its slot is resumed, the replacement follows, then the siblings to its right; what stands to the left is
never hashed again. A task holds one block of ``arity ** height`` nodes: blocks of a group are independent
of each other, so a group with most of the rows is spread like any other. The digests of blocks are the
nodes of the next tier, of which there are log(rows) / (height log(arity)). On the way down every block
gets the siblings above it, rebuilds the states of its few ancestors once, and folds its own leaves
through them, so no task sees more than a block and the path over it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from eventlens.llm.common import batches_of, columns_of, written
from eventlens.llm.ranks import numbered, placed

ARITY = 2
#: Levels in a block: 4,096 nodes and their states, some megabytes.
HEIGHT = 12

#: The siblings at one level, from the left and from the right of the way up.
_STEP = T.StructType([T.StructField("left", T.ArrayType(T.StringType())), T.StructField("right", T.ArrayType(T.StringType()))])
_PATH = T.ArrayType(_STEP)


def digest_of(*fields: Column) -> Column:
    """SHA-256 of the fields, each its length in bytes, a colon and its value, or ``-`` if it is null."""
    as_text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in as_text]), 256)


class MidstateTree:
    """Digests of some consecutive nodes, level by level, and for each parent its hash states before each child slot."""

    def __init__(self, nodes: list[bytes], arity: int = ARITY, levels: int | None = None) -> None:
        """``levels`` of parents, or as many as leave one node."""
        self.arity = arity
        self.levels = [nodes]
        self.states: list[list[list]] = []
        while len(self.levels[-1]) > 1 if levels is None else len(self.states) < levels:
            below, digests, kept = self.levels[-1], [], []
            for start in range(0, len(below), arity):
                before, state = [], hashlib.sha256()
                for child in below[start : start + arity]:
                    before.append(state.copy())
                    state.update(child)
                kept.append(before)
                digests.append(state.hexdigest().encode())
            self.levels.append(digests)
            self.states.append(kept)

    @property
    def top(self) -> bytes:
        return self.levels[-1][0]

    def path(self, index: int) -> list[tuple[list[bytes], list[bytes]]]:
        """The siblings to the left and to the right of the way up from a node, level by level."""
        steps = []
        for nodes in self.levels[:-1]:
            start = index - index % self.arity
            steps.append((nodes[start:index], nodes[index + 1 : start + self.arity]))
            index //= self.arity
        return steps

    def fold(self, index: int, digest: bytes) -> bytes:
        """The top as it would be with another digest at a node."""
        for nodes, states in zip(self.levels, self.states):
            parent, slot = divmod(index, self.arity)
            digest = _resumed(states[parent][slot], digest, nodes[index + 1 : (parent + 1) * self.arity])
            index = parent
        return digest


def _resumed(state, digest: bytes, right: Iterable[bytes]) -> bytes:
    state = state.copy()
    state.update(digest)
    for sibling in right:
        state.update(sibling)
    return state.hexdigest().encode()


class Ancestors:
    """The way from a block to the root: states before the slots on it, made once from the left siblings."""

    def __init__(self, path: list[dict]) -> None:
        self.steps = []
        for step in path:
            state = hashlib.sha256()
            for sibling in step["left"]:
                state.update(sibling.encode())
            self.steps.append((state, [s.encode() for s in step["right"]]))
        self.siblings = b"".join(s.encode() for step in path for side in ("left", "right") for s in step[side])

    def fold(self, digest: bytes) -> bytes:
        for state, right in self.steps:
            digest = _resumed(state, digest, right)
        return digest


def _blocks(batches: Iterable[pa.RecordBatch], columns: list[str]) -> Iterator[list[tuple]]:
    """Consecutive rows of the same group and block; (group, block) are the first two columns."""
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in columns)))
    for _, block in groupby(rows, key=lambda row: row[:2]):
        yield list(block)


def _levels(n: int, arity: int, height: int) -> int | None:
    """Levels that a block of a group of n nodes has: the whole height, if there are several blocks."""
    return height if n > arity**height else None


def _by_block(nodes: DataFrame, arity: int, height: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {arity**height}"))


def _up(nodes: DataFrame, arity: int, height: int) -> DataFrame:
    """The next tier of (group, pos, digest, n): one node for each block; n are the nodes that the group has in a tier."""
    schema = T.StructType([nodes.schema["group"], *(T.StructField(c, t) for c, t in (("pos", T.LongType()), ("digest", T.StringType()), ("n", T.LongType())))])

    def climb(batches):
        def made():
            for block in _blocks(batches, ["group", "block", "digest", "n"]):
                group, number, _, n = block[0]
                tree = MidstateTree([row[2].encode() for row in block], arity, _levels(n, arity, height))
                yield group, number, tree.top.decode(), -(-n // arity**height)

        yield from batches_of(made(), to_arrow_schema(schema))

    rows = _by_block(nodes.select("group", "pos", "digest", "n"), arity, height)
    return rows.repartition("group", "block").sortWithinPartitions("group", "block", "pos").mapInArrow(climb, schema)


def _climb(nodes: DataFrame, arity: int, height: int) -> list[DataFrame]:
    """All tiers, from the given nodes to one node for each group."""
    tiers = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while len(tiers) == 1 or most > 1:
        tiers.append(written(_up(tiers[-1], arity, height), "tier"))
        most = -(-most // arity**height)
    return tiers


def _with_paths(nodes: DataFrame, above: DataFrame, arity: int, height: int) -> DataFrame:
    """Rows of both, in blocks, with a block's row of ``above`` (group, pos of the block, path, subroot, root) first."""
    rows = _by_block(nodes, arity, height).withColumns({"path": F.lit(None).cast(_PATH), "subroot": F.lit(None).cast("string"), "root": F.lit(None).cast("string")})
    heads = above.withColumnRenamed("pos", "block").withColumn("pos", F.lit(-1).cast("long"))
    both = rows.unionByName(heads, allowMissingColumns=True)
    return both.repartition("group", "block").sortWithinPartitions("group", "block", "pos")


def _down(nodes: DataFrame, above: DataFrame, arity: int, height: int) -> DataFrame:
    """(group, pos, path, subroot, root) of every node of a tier, from those of the tier above."""
    schema = T.StructType([nodes.schema["group"], T.StructField("pos", T.LongType()), T.StructField("path", _PATH), T.StructField("subroot", T.StringType()), T.StructField("root", T.StringType())])

    def descend(batches):
        def made():
            for block in _blocks(batches, ["group", "block", "pos", "digest", "n", "path", "subroot", "root"]):
                (group, _, _, _, _, path, subroot, root), rows = block[0], block[1:]
                tree = MidstateTree([row[3].encode() for row in rows], arity, _levels(rows[0][4], arity, height))
                for index, row in enumerate(rows):
                    own = [{"left": [s.decode() for s in left], "right": [s.decode() for s in right]} for left, right in tree.path(index)]
                    yield group, row[2], own + path, subroot, root

        yield from batches_of(made(), to_arrow_schema(schema))

    return _with_paths(nodes.select("group", "pos", "digest", "n"), above, arity, height).mapInArrow(descend, schema)


def _folded(leaves: DataFrame, above: DataFrame, arity: int, height: int) -> DataFrame:
    """(group, key, digest, subroot, root, proof_sha256, folded_root) of every leaf."""
    texts = ("digest", "subroot", "root", "proof_sha256", "folded_root")
    schema = T.StructType([leaves.schema["group"], leaves.schema["key"], *(T.StructField(c, T.StringType()) for c in texts)])

    def fold(batches):
        def made():
            for block in _blocks(batches, ["group", "block", "key", "digest", "n", "replaced", "path", "subroot", "root"]):
                (group, _, _, _, _, _, path, subroot, root), rows = block[0], block[1:]
                tree = MidstateTree([row[3].encode() for row in rows], arity, _levels(rows[0][4], arity, height))
                ancestors = Ancestors(path)
                for index, row in enumerate(rows):
                    proof = b"".join(s for step in tree.path(index) for side in step for s in side) + ancestors.siblings
                    top = ancestors.fold(tree.fold(index, (row[5] or row[3]).encode()))
                    yield group, row[2], row[3], subroot, root, hashlib.sha256(proof).hexdigest(), top.decode()

        yield from batches_of(made(), to_arrow_schema(schema))

    return _with_paths(leaves, above, arity, height).mapInArrow(fold, schema)


def manifest(df: DataFrame, group: str, key: str, digest: str, replaced: str, arity: int = ARITY, height: int = HEIGHT) -> DataFrame:
    """One row per input row: group, key, digest, subroot (of its group), root, proof_sha256, folded_root.

    ``digest`` names the column of leaf digests (lowercase hex), ``replaced`` that of the digests to fold in
    their place, null for the leaf itself. proof_sha256 is the digest of all siblings on the way up, level by
    level, left to right; folded_root is the root that the replaced leaf and the other leaves' siblings give.

    Leaves of a group stand in order of key, nulls first, ties by digest; repeated rows are leaves of their own,
    and a null group is a group. Other columns are ignored; an empty table gives no rows.
    """
    packed = written(df.select(*columns_of(df, group=group, key=key, digest=digest, replaced=replaced)), "leaves")
    rows, runs = numbered(packed, ["group"], ["key", "digest"])
    leaves = placed(rows, runs.withColumnRenamed("total", "n"), ["group"])
    tiers = _climb(leaves, arity, height)

    groups = tiers[-1].select(F.lit(0).alias("group"), F.col("group").alias("key"), "digest")
    numbers, spans = numbered(groups, ["group"], ["key"])
    subroots = placed(numbers, spans.withColumnRenamed("total", "n"), ["group"])
    upper = _climb(subroots, arity, height)
    above = upper[-1].select("group", "pos", F.array().cast(_PATH).alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    for nodes in reversed(upper[:-1]):
        above = written(_down(nodes, above, arity, height), "paths")
    tops = subroots.select("pos", F.col("key").alias("name"), F.col("digest").alias("subroot"))
    above = tops.join(above.drop("subroot"), "pos").select(F.col("name").alias("group"), F.lit(0).cast("long").alias("pos"), "path", "subroot", "root")
    for nodes in reversed(tiers[1:-1]):
        above = written(_down(nodes, above, arity, height), "paths")
    return _folded(leaves, above, arity, height)
