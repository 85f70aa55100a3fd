"""Chat formatting into a prefix tree.

Conversations that share their first turns share the nodes of a tree; a node's key is the chained
digest of all turns up to it. Each node belongs to the smallest conversation that has it, so what a
conversation owns is the end of its path, one segment. Segments are laid out depth first, each next to
the part it continues: a node starts at a place of the stream, and carries its position
in the conversation and the intervals of the stream that it may attend to. Shared turns are emitted once.

Conversations are streamed, sorted by turn; only digests and lengths of theirs meet in joins. The
order of all segments comes from a range sort and two levels of running sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from eventlens.llm.common import batches_of, columns_of, written
from eventlens.session import durable


@dataclass(frozen=True)
class Template:
    """A turn is ``opens`` role ``divides`` text ``closes``.

    Control strings inside roles and texts are replaced by ``escape`` and a digit, and the escape
    character by itself and a minus, so every text comes back as it was.
    """

    opens: str = "[INST]"
    divides: str = "[/INST]"
    closes: str = "</s>"
    others: tuple[str, ...] = ("<s>",)
    escape: str = "\\"

    @property
    def codes(self) -> list[tuple[str, str]]:
        """Pairs to replace in this order; the escape character comes first."""
        controls = (self.opens, self.divides, self.closes, *self.others)
        return [(self.escape, f"{self.escape}-"), *((c, f"{self.escape}{i}") for i, c in enumerate(controls))]

    def shield(self, text: str) -> str:
        for plain, code in self.codes:
            text = text.replace(plain, code)
        return text

    def unshield(self, text: str) -> str:
        for plain, code in reversed(self.codes):
            text = text.replace(code, plain)
        return text

    def render(self, role: str, text: str) -> tuple[str, int, int]:
        """The turn, and where its text starts and ends in it."""
        head = f"{self.opens}{self.shield(role)}{self.divides}"
        body = self.shield(text)
        return f"{head}{body}{self.closes}", len(head), len(head) + len(body)

    def parse(self, turn: str) -> tuple[str, str]:
        """Role and text of a rendered turn; anything else is an error."""
        if not (turn.startswith(self.opens) and turn.endswith(self.closes)):
            raise ValueError("not a rendered turn")
        role, divider, body = turn[len(self.opens) : len(turn) - len(self.closes)].partition(self.divides)
        if not divider or any(c in role + "\0" + body for c in (self.opens, self.divides, self.closes)):
            raise ValueError("not a rendered turn")
        return self.unshield(role), self.unshield(body)


def _streamed(batches: Iterable[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


def _chained(df: DataFrame, template: Template, trained: frozenset[str]) -> DataFrame:
    """One row per turn (conv, turn, role, text): its node and parent, rendered text, position and loss span."""
    rows = df.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    schema = T.StructType(
        [
            df.schema["conv"],
            T.StructField("depth", T.IntegerType()),
            T.StructField("node", T.BinaryType()),
            T.StructField("rendered", T.StringType()),
            T.StructField("n_chars", T.IntegerType()),
            T.StructField("position", T.LongType()),
            T.StructField("loss_start", T.IntegerType()),
            T.StructField("loss_end", T.IntegerType()),
        ]
    )

    def chain(batches):
        def made():
            now, depth, position, node = object(), 0, 0, b""
            for conv, role, text in _streamed(batches, ["conv", "role", "text"]):
                if conv != now:
                    now, depth, position, node = conv, 0, 0, b""
                rendered, start, end = template.render(role or "", text or "")
                loss = (start, end) if (role or "") in trained else (0, 0)
                depth += 1
                node = hashlib.sha256(node + hashlib.sha256(rendered.encode()).digest()).digest()
                yield conv, depth, node, rendered, len(rendered), position, *loss
                position += len(rendered)

        yield from batches_of(made(), to_arrow_schema(schema))

    return rows.mapInArrow(chain, schema)


def prefix_tree(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    template: Template | None = None,
    trained: tuple[str, ...] = ("assistant",),
) -> tuple[DataFrame, DataFrame]:
    """(stream, paths) of the conversations; turns in order of ``turn``, then role and text, nulls first.

    stream, one row per node of the tree: segment (the conversation that owns it), depth, rendered,
    n_chars, start (in the whole stream), position (of its first character in the conversation; the
    following ones count on), loss_start, loss_end (within the turn; equal without loss), attends
    (ascending intervals [start, end) of its ancestors in the stream; its own segment's goes up to
    its end, each character seeing what stands before it).

    paths, one row per conversation: conv, and its parts from the root: segment, and depths from, to.

    Null roles and texts count as empty. Rows whose conversation is null are one conversation.
    Repeated rows are turns of their own. Other columns are ignored; an empty table gives none.
    """
    packed = df.select(*columns_of(df, conv=conv_col, turn=turn_col, role=role_col, text=text_col))
    turns = written(_chained(packed, template or Template(), frozenset(trained)), "turns")
    owners = turns.groupBy("node").agg(F.min("conv").alias("owner"))
    slim = turns.select("conv", "depth", "node", "n_chars", "position").join(owners, "node")
    part = F.struct(F.min("depth").alias("from"), F.col("owner").alias("segment"), F.max("depth").alias("to"), F.min("position").alias("begin"), F.sum("n_chars").alias("n_chars"))
    parts = slim.groupBy("conv", "owner").agg(part.alias("part"))
    paths = durable(parts.groupBy("conv").agg(F.sort_array(F.collect_list("part")).alias("parts")))

    last = F.element_at("parts", -1)
    key = F.transform("parts", lambda p: F.struct((-p["from"]).alias("d"), p["segment"].alias("s")))
    owned = paths.where(last["segment"].eqNullSafe(F.col("conv"))).select(F.col("conv").alias("segment"), key.alias("key"), last["begin"].alias("begin"), last["n_chars"].alias("n"), "parts")
    laid = _running(owned)

    above = laid.select(F.col("segment").alias("mine"), F.explode(F.slice("parts", 1, F.size("parts") - 1)).alias("p"))
    starts = laid.select("segment", F.col("at").alias("segment_at"))
    seen = above.join(starts, F.col("p.segment").eqNullSafe(starts["segment"]))
    interval = F.struct(F.col("segment_at").alias("start"), (F.col("segment_at") + F.col("p.n_chars")).alias("end"))
    ancestors = seen.groupBy("mine").agg(F.sort_array(F.collect_list(interval)).alias("above"))
    segments = laid.join(ancestors, F.col("segment").eqNullSafe(F.col("mine")), "left").select("segment", "begin", "at", "above")

    first = turns.join(owners.withColumnRenamed("node", "n"), (F.col("node") == F.col("n")) & F.col("conv").eqNullSafe(F.col("owner")))
    placed = first.join(segments, F.col("conv").eqNullSafe(F.col("segment")))
    start = F.col("at") + F.col("position") - F.col("begin")
    own = F.struct(F.col("at").alias("start"), (start + F.col("n_chars")).alias("end"))
    attends = F.concat(F.coalesce("above", F.array().cast("array<struct<start:bigint,end:bigint>>")), F.array(own))
    stream = placed.select("segment", "depth", "rendered", "n_chars", start.alias("start"), "position", "loss_start", "loss_end", attends.alias("attends"))
    return stream, paths.select("conv", F.transform("parts", lambda p: F.struct(p["segment"].alias("segment"), p["from"].alias("from"), p["to"].alias("to"))).alias("parts"))


def _running(owned: DataFrame) -> DataFrame:
    """Add ``at``, the sum of ``n`` of all rows before this one in the order of ``key``, in slices of a range sort."""
    parts = int(owned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = durable(owned.repartitionByRange(parts, "key").withColumn("slice", F.spark_partition_id()))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    # one row per slice
    offsets = sliced.groupBy("slice").agg(F.sum("n").alias("n")).select("slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("slice").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    local = sliced.withColumn("local", F.coalesce(F.sum("n").over(within), F.lit(0)))
    return durable(local.join(offsets, "slice").withColumn("at", F.col("offset") + F.col("local")).drop("slice", "local", "offset"))


def read_back(stream: DataFrame, paths: DataFrame) -> DataFrame:
    """(conv, depth, rendered, loss_start, loss_end): every conversation's turns, taken from the stream."""
    one = paths.select("conv", F.explode("parts").alias("p")).select("conv", F.col("p.segment").alias("own"), F.explode(F.sequence("p.from", "p.to")).alias("at"))
    nodes = stream.select("segment", "depth", "rendered", "loss_start", "loss_end")
    return one.join(nodes, F.col("own").eqNullSafe(F.col("segment")) & (F.col("at") == F.col("depth"))).select("conv", "depth", "rendered", "loss_start", "loss_end")


def digests(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of what ``read_back`` gives."""
    template = template or Template()
    schema = T.StructType(
        [
            T.StructField("conv_id", turns.schema["conv"].dataType),
            T.StructField("n_turns", T.LongType()),
            T.StructField("turns_sha256", T.StringType()),
            T.StructField("loss_chars", T.LongType()),
            T.StructField("loss_sha256", T.StringType()),
            T.StructField("formatted_chars", T.LongType()),
        ]
    )

    def fold(batches):
        def made():
            now, state = None, None
            for conv, rendered, start, end in _streamed(batches, ["conv", "rendered", "loss_start", "loss_end"]):
                if state is None or conv != now:
                    if state:
                        yield _folded(now, *state)
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = template.parse(rendered)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                loss = template.unshield(rendered[start:end])
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(rendered)
            if state:
                yield _folded(now, *state)

        yield from batches_of(made(), to_arrow_schema(schema))

    return turns.repartition("conv").sortWithinPartitions("conv", "depth").mapInArrow(fold, schema)


def _folded(conv, n, turns, loss_chars, loss, chars):
    return conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars
