"""Prefix trie of conversations, by ternary search trees over range shards.

A conversation is the sequence of its turns, each a symbol of fixed width, so sequences sort as bytes do. Sorted
by (sequence, conversation) and range-partitioned, a subtree of the trie is a stretch of rows, however many
conversations share its first turns. A shard is a run of rows of bounded size. Its symbols are encoded
by a dictionary of its own; its sequences go into ternary search trees, the median first so that the trees are
balanced; one iterative traversal, children before parents, sums members, leaves and savings.

Only nodes on the way to a shard's first and last sequence can be in other shards as well. What hangs below them is
final; they are handed on, one or two paths from each shard with what hangs at each node, and merged by
the same trees in groups of neighbouring shards, then of neighbouring groups, until one group holds all.
Ids of conversations that end at such a node travel beside the paths, in chunks.

A conversation longer than ``segment_turns`` is cut there, so that no row and no path grows without bound. Segments that follow
the same turns start at the same node; levels are done from the deepest up, and the totals of a start are those
of the node that ends the segment before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from eventlens.llm.common import batches_of, columns_of, written
from eventlens.llm.ranks import numbered, placed

#: Bytes of a symbol: the start of the turn's SHA-256, and the words of its text.
DIGEST_BYTES, COUNT_BYTES = 16, 4
WIDTH = DIGEST_BYTES + COUNT_BYTES
#: Turns (and conversations) of a shard, or of a group of paths: about 50 MB in a task.
SHARD_TURNS = 100_000
#: Turns of a conversation in one piece.
SEGMENT_TURNS = 1024
#: Conversation ids in one chunk.
CHUNK_IDS = 4096


def symbol(role: Column, text: Column) -> Column:
    """Role and text of a turn as ``WIDTH`` bytes; nulls are empty, words are what white space parts."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return F.unhex(F.concat(F.substring(digest, 1, 2 * DIGEST_BYTES), F.lpad(F.hex(words.cast("long")), 2 * COUNT_BYTES, "0")))


def rebuilt(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", every: int = 20, most: int = 4) -> DataFrame:
    """(conv, pos, symbol) of rebuilt conversations, and a row with pos -1 and an empty symbol for each of them.

    Conversation c is rebuilt from the first h turns of conversation c - c % every (all if it has fewer, none if there is
    none), and its own after its first h; h is the CRC-32 of c in decimal modulo ``most``. Turns stand in
    order of ``turn``, nulls first, ties by symbol; repeated rows are turns of their own. Rows without a conversation belong to
    none and are left out. Other columns are ignored; an empty table gives no rows.
    """
    packed = df.select(*columns_of(df, conv=conv_col, turn=turn_col, role=role_col, text=text_col)).where("conv is not null")
    turns = written(packed.select("conv", "turn", symbol(F.col("role"), F.col("text")).alias("symbol")), "symbols")
    rows, runs = numbered(turns, ["conv"], ["turn", "symbol"])
    base = F.col("conv") - F.col("conv") % every
    firsts = placed(rows.where(F.col("conv") == base), runs.where(F.col("conv") == base), ["conv"]).where(F.col("pos") < most - 1)
    heads = firsts.groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "symbol")))["symbol"].alias("head"))
    taken = (F.crc32(F.col("conv").cast("string")) % most).cast("int")
    convs = runs.select("conv").distinct().select("conv", base.alias("base"), taken.alias("h"))
    lead = F.slice(F.coalesce("head", F.array().cast("array<binary>")), F.lit(1), F.col("h"))
    convs = convs.join(heads, "base", "left").select("conv", "h", lead.alias("lead"))
    own = placed(rows, runs.join(convs, "conv").withColumn("given", F.size("lead")).drop("lead", "total"), ["conv"]).where("pos >= h")
    marks = convs.select("conv", F.lit(-1).cast("long").alias("pos"), F.lit(b"").alias("symbol"))
    given = convs.select("conv", F.posexplode("lead").alias("pos", "symbol"))
    return own.select("conv", (F.col("pos") - F.col("h") + F.col("given")).alias("pos"), "symbol").union(given).union(marks)


class TernaryTrees:
    """A trie: the children of each node are a binary search tree, all nodes in flat lists.

    Each node adds up what it has of its own: members that end here or that were handed on with it, the smallest of
    them, and children, leaves and savings below it that are in no other shard.
    """

    def __init__(self) -> None:
        self.first = [-1]
        self.symbol: list[int] = []
        self.low: list[int] = []
        self.high: list[int] = []
        self.children_tree: list[int] = []
        self.members: list[int] = []
        self.least: list = []
        self.children: list[int] = []
        self.leaves: list[int] = []
        self.saved: list[int] = []
        self.below: list = []

    def _new(self, symbol: int) -> int:
        self.symbol.append(symbol)
        for pointers in (self.low, self.high, self.children_tree):
            pointers.append(-1)
        for sums in (self.members, self.children, self.leaves, self.saved):
            sums.append(0)
        self.least.append(None)
        self.below.append(None)
        return len(self.symbol) - 1

    def insert(self, sequence: Iterable[int]) -> list[int]:
        """The nodes of a sequence, made where they are missing."""
        nodes, holder, at = [], self.first, 0
        for symbol in sequence:
            node = holder[at]
            while node >= 0 and self.symbol[node] != symbol:
                holder, at = (self.low if symbol < self.symbol[node] else self.high), node
                node = holder[at]
            if node < 0:
                node = holder[at] = self._new(symbol)
            nodes.append(node)
            holder, at = self.children_tree, node
        return nodes

    def add(self, node: int, members: int, least, children: int = 0, leaves: int = 0, saved: int = 0, below: tuple | None = None) -> None:
        self.members[node] += members
        if least is not None and (self.least[node] is None or least < self.least[node]):
            self.least[node] = least
        self.children[node] += children
        self.leaves[node] += leaves
        self.saved[node] += saved
        if below is not None:  # of one and the same node, so it counts once
            self.below[node] = below

    def total(self, words: list[int], shared: set[int]) -> list[int]:
        """Sum up, and give the nodes, parents first. ``words`` has the words of each symbol.

        Nodes of ``shared`` (with a node its ancestors) keep what isn't in another of them, and aren't counted.
        """
        self.parent, self.depth = [-1] * len(self.symbol), [0] * len(self.symbol)
        order, stack = [], [(self.first[0], -1, 0)]
        while stack:
            node, parent, depth = stack.pop()
            if node >= 0:
                order.append(node)
                self.parent[node], self.depth[node] = parent, depth
                stack += [(self.low[node], parent, depth), (self.high[node], parent, depth), (self.children_tree[node], node, depth + 1)]
        for node in reversed(order):
            if node in shared:
                continue
            if self.below[node]:
                children, leaves, saved = self.below[node]
                self.add(node, 0, None, children, leaves, saved)
            if not self.children[node]:
                self.leaves[node] += 1
            self.saved[node] += (self.members[node] - 1) * words[self.symbol[node]]
            if self.parent[node] >= 0:
                self.add(self.parent[node], self.members[node], self.least[node], 1, self.leaves[node], self.saved[node])
        return order


def _median_first(n: int) -> Iterator[int]:
    """0 to n-1: the middle, then the middles of both halves, and so on."""
    spans = [(0, n)]
    while spans:
        low, high = spans.pop()
        if low < high:
            middle = (low + high) // 2
            yield middle
            spans += [(middle + 1, high), (low, middle)]


def _cut(path: bytes) -> list[bytes]:
    return [path[i : i + WIDTH] for i in range(0, len(path), WIDTH)]


def _key(start: str, path: bytes) -> str:
    """Digest of a node by the start of its segment and the symbols after that; that of a whole segment is the next one's start."""
    return hashlib.sha256(f"{start}{hashlib.sha256(path).hexdigest()}".encode()).hexdigest()


class _Shard:
    """Sequences in ascending order, with what each has at its nodes; makes the rows of its nodes and paths."""

    def __init__(self, sequences: list[tuple[str, bytes]], base_depth: int) -> None:
        self.sequences, self.base_depth = sequences, base_depth
        symbols = [[start, *_cut(path)] for start, path in sequences]
        known = sorted({s for one in symbols for s in one[1:]})
        starts = sorted({one[0] for one in symbols})
        codes = {s: i for i, s in enumerate([*starts, *known])}
        self.words = [0] * len(starts) + [int.from_bytes(s[DIGEST_BYTES:], "big") for s in known]
        self.trees = TernaryTrees()
        self.nodes: list[list[int]] = [[]] * len(sequences)
        for i in _median_first(len(sequences)):
            self.nodes[i] = self.trees.insert([codes[s] for s in symbols[i]])

    def rows(self, ends: dict[int, list], shared_ends: set[int], last: bool, part: int, number: int) -> Iterator[dict]:
        """Nodes that are in no other shard, then the paths of the first and last sequence unless it is the ``last`` round.

        ``ends`` has the conversations that end at a node, ``shared_ends`` are the nodes whose ends are handed on.
        """
        trees = self.trees
        ways = [] if last else [0, len(self.sequences) - 1][: len({self.sequences[0], self.sequences[-1]})]
        shared = {node for i in ways for node in self.nodes[i]}
        keys = self._keys(shared | shared_ends)
        for node in trees.total(self.words, shared):
            if node not in shared:
                yield from self._final(node, keys, ends, shared, shared_ends)
            elif node not in shared_ends:
                for at in range(0, len(ends.get(node, ())), CHUNK_IDS):
                    chunk = ends[node][at : at + CHUNK_IDS]
                    yield {"kind": "ends", "node": keys[node], "conv": chunk[0], "text": ",".join(map(str, chunk))}
        given: set[int] = set()
        for which, i in enumerate(ways):
            own = [
                None if n in given else {"members": trees.members[n], "least": trees.least[n], "children": trees.children[n], "leaves": trees.leaves[n], "saved": trees.saved[n], "below": trees.below[n] and list(trees.below[n])}
                for n in self.nodes[i]
            ]
            given.update(self.nodes[i])
            start, path = self.sequences[i]
            yield {"kind": "path", "part": part, "number": 2 * number + which, "start": start, "path": path, "own": own}

    def _keys(self, wanted: set[int]) -> dict[int, str]:
        """Digests of nodes that are in other shards or have a segment below them."""
        keys: dict[int, str] = {}
        for (start, path), nodes in zip(self.sequences, self.nodes):
            for depth, node in enumerate(nodes):
                if node not in keys and (node in wanted or self.trees.below[node]):
                    keys[node] = _key(start, path[: depth * WIDTH])
        return keys

    def _final(self, node: int, keys: dict[int, str], ends: dict[int, list], shared: set[int], shared_ends: set[int]) -> Iterator[dict]:
        trees, depth, parent = self.trees, self.trees.depth[node], self.trees.parent[node]
        totals = {"n_children": trees.children[node], "n_leaves": trees.leaves[node], "saved_tokens": trees.saved[node]}
        if depth == 0 and self.base_depth:
            yield {"kind": "top", "start": self._start(node), **totals}
            return
        row = {"kind": "node", "node": keys.get(node), "conv": trees.least[node], "depth": self.base_depth + depth, "n_convs": trees.members[node], **totals}
        if depth == 1 and self.base_depth:
            row["parent_node"] = self._start(parent)
        elif parent in shared:
            row["parent_node"] = keys[parent]
        elif parent >= 0:
            row["parent_conv"] = trees.least[parent]
        if node not in shared_ends:
            row["ends_sha256"] = hashlib.sha256(",".join(map(str, ends.get(node, ()))).encode()).hexdigest()
        yield row

    def _start(self, node: int) -> str:
        return next(start for (start, _), nodes in zip(self.sequences, self.nodes) if nodes[0] == node)


def _schema(conv: T.DataType) -> T.StructType:
    long, text = T.LongType(), T.StringType()
    own = T.StructType([T.StructField("members", long), T.StructField("least", conv), *(T.StructField(c, long) for c in ("children", "leaves", "saved")), T.StructField("below", T.ArrayType(long))])
    kinds = {"kind": text, "node": text, "conv": conv, "depth": long, "parent_node": text, "parent_conv": conv, "n_convs": long, "n_children": long, "n_leaves": long, "saved_tokens": long, "ends_sha256": text}
    kinds |= {"text": text, "part": long, "number": long, "start": text, "path": T.BinaryType(), "own": T.ArrayType(own)}
    return T.StructType([T.StructField(c, kind) for c, kind in kinds.items()])


def _streamed(batches: Iterable[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


def _sharded(segments: DataFrame, base_depth: int, shard_turns: int) -> DataFrame:
    """Rows of all shards of a level: final nodes, chunks of ends, and paths to merge."""
    schema = _schema(segments.schema["conv"].dataType)

    def shards(batches):
        held, turns = [], 0
        for row in _streamed(batches, ["start", "path", "conv", "ended", "below"]):
            held.append(row)
            turns += 1 + len(row[1]) // WIDTH
            if turns >= shard_turns:
                yield held
                held, turns = [], 0
        if held:
            yield held

    def make(batches):
        part = TaskContext.get().partitionId()

        def made():
            for number, rows in enumerate(shards(batches)):
                grouped = [(sequence, list(members)) for sequence, members in groupby(rows, key=lambda r: (r[0], r[1]))]
                shard = _Shard([sequence for sequence, _ in grouped], base_depth)
                ends = {}
                for nodes, (_, members) in zip(shard.nodes, grouped):
                    for _, _, conv, ended, below in members:
                        shard.trees.add(nodes[-1], 1, conv, below=below and tuple(below))
                        if ended:
                            ends.setdefault(nodes[-1], []).append(conv)
                yield from shard.rows(ends, set(), False, part, number)

        yield from batches_of((tuple(row.get(c) for c in schema.names) for row in made()), to_arrow_schema(schema))

    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["start", "path", "conv"]
    return segments.repartitionByRange(parts, *key).sortWithinPartitions(*key).mapInArrow(make, schema)


def _merged(paths: DataFrame, base_depth: int, width: int, last: bool) -> DataFrame:
    """Rows of groups of ``width`` neighbouring parts: nodes that are in no other group, and its first and last path."""
    schema = _schema(paths.schema["conv"].dataType)

    def merge(batches):
        def made():
            for part, rows in groupby(_streamed(batches, ["group", "start", "path", "own"]), key=lambda r: r[0]):
                kept: dict[tuple[str, bytes], list] = {}
                for _, start, path, own in rows:
                    kept.setdefault((start, path), []).append(own)
                shard = _Shard(list(kept), base_depth)
                for nodes, owns in zip(shard.nodes, kept.values()):
                    for own in owns:
                        for node, values in zip(nodes, own):
                            if values is not None:
                                below = values.pop("below")
                                shard.trees.add(node, **values, below=below and tuple(below))
                everything = set(range(len(shard.trees.symbol)))
                yield from shard.rows({}, everything, last, part, 0)

        yield from batches_of((tuple(row.get(c) for c in schema.names) for row in made()), to_arrow_schema(schema))

    rows = paths.select(F.expr(f"part div {width}").alias("group"), "part", "number", "start", "path", "own")
    return rows.repartition("group").sortWithinPartitions("group", "part", "number").mapInArrow(merge, schema)


def _hashed_ends(chunks: DataFrame) -> DataFrame:
    """(node, ends_sha256) of chunks (node, conv, text) of ascending ids: streamed, so a node may have any number of them."""
    schema = T.StructType([T.StructField("node", T.StringType()), T.StructField("ends_sha256", T.StringType())])

    def fold(batches):
        def made():
            for node, rows in groupby(_streamed(batches, ["node", "text"]), key=lambda r: r[0]):
                state = hashlib.sha256(next(rows)[1].encode())
                for _, text in rows:
                    state.update(f",{text}".encode())
                yield node, state.hexdigest()

        yield from batches_of(made(), to_arrow_schema(schema))

    return chunks.select("node", "conv", "text").repartition("node").sortWithinPartitions("node", "conv").mapInArrow(fold, schema)


def _level(segments: DataFrame, base_depth: int, shard_turns: int) -> list[DataFrame]:
    """Written frames whose rows of kind node, top and ends are final."""
    frames = [written(_sharded(segments, base_depth, shard_turns), "shards")]
    paths = frames[0].where("kind = 'path'")
    turns, parts = paths.agg(F.sum(F.size("own")), F.max("part") + 1).first()
    while parts:
        groups = -(-turns // shard_turns)
        width = parts if groups <= 1 else max(2, -(-parts // groups))
        parts = -(-parts // width)
        frames.append(written(_merged(paths, base_depth, width, last=parts == 1), "merged"))
        paths = frames[-1].where("kind = 'path'")
        if parts == 1:
            break
        turns = paths.agg(F.sum(F.size("own"))).first()[0]
    return frames


def trie(turns: DataFrame, shard_turns: int = SHARD_TURNS, segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """One row for each distinct sequence of first turns: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` are (conv, pos, symbol) with pos from 0 in each conversation, and a row with pos -1 and an empty symbol for each
    conversation, so that one without turns is a member of the root. conv_id is a node's smallest member, parent_conv_id its
    parent's; saved_tokens sums (members - 1) times the words of the last turn over the subtree; ends_sha256 is
    the digest of the ids of members that end at the node. No rows give no nodes.
    """
    piece = F.greatest(F.expr(f"pos div {segment_turns}"), F.lit(0).cast("long"))
    parts = F.sort_array(F.collect_list(F.struct("pos", F.hex("symbol").alias("code"))))
    path = F.unhex(F.array_join(F.transform(parts, lambda p: p["code"]), ""))
    segments = turns.groupBy("conv", piece.alias("piece")).agg(path.alias("path"))
    segments = written(segments, "segments")
    levels = (segments.agg(F.max("piece")).first()[0] or 0) + 1
    start, following = F.lit(""), F.lit(None).cast("string")
    if levels > 1:
        ordered = Window.partitionBy("conv").orderBy("piece")
        chain = lambda digests: F.aggregate(digests, F.lit(""), lambda key, d: F.sha2(F.concat(key, d), 256))
        start = chain(F.collect_list(F.sha2("path", 256)).over(ordered.rowsBetween(Window.unboundedPreceding, -1)))
        segments = segments.withColumn("start", start).withColumn("next", F.lead("start").over(ordered))
        segments = written(segments, "segments")
    else:
        segments = segments.withColumn("start", start).withColumn("next", following)

    frames, tops = [], None
    for level in reversed(range(levels)):
        here = segments.where(F.col("piece") == level).select("conv", "path", "start", "next", F.col("next").isNull().alias("ended"))
        if tops is None:
            here = here.withColumn("below", F.lit(None).cast("array<bigint>"))
        else:
            here = here.join(tops, here["next"] == tops["top"], "left")
        made = _level(here, level * segment_turns, shard_turns)
        frames += made
        tops = _union(made).where("kind = 'top'").select(F.col("start").alias("top"), F.array("n_children", "n_leaves", "saved_tokens").alias("below"))
    return _assembled(frames)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.union(frame)
    return out


def _assembled(frames: list[DataFrame]) -> DataFrame:
    """The nodes, with the ends and parents that other shards have."""
    everything = _union(frames)
    nodes = everything.where("kind = 'node'").select("node", "conv", "depth", "parent_node", "parent_conv", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    ends = _hashed_ends(everything.where("kind = 'ends'")).select(F.col("node").alias("at"), F.col("ends_sha256").alias("found"))
    known = nodes.where("ends_sha256 is not null")
    open_ = nodes.where("ends_sha256 is null")
    open_ = open_.join(ends, open_["node"] == ends["at"], "left").withColumn("ends_sha256", F.coalesce("found", F.sha2(F.lit("").cast("binary"), 256))).drop("at", "found")
    nodes = known.union(open_)
    above = everything.where("kind = 'node' and node is not null").select(F.col("node").alias("at"), F.col("conv").alias("above"))
    linked = nodes.where("parent_node is not null")
    linked = linked.join(above, linked["parent_node"] == above["at"]).withColumn("parent_conv", F.col("above")).drop("at", "above")
    columns = (F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return nodes.where("parent_node is null").union(linked).select(*columns)
