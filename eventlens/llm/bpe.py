"""Byte-level BPE by a lazily determinised finite-state transducer.

Merging adjacent pairs in the order of their ranks leaves a sequence in which every two neighbours
stay apart when their bytes are merged alone, and only one segmentation has that property. A
non-deterministic transducer can therefore read bytes from left to right: after each prefix exactly
one token ends there that may follow the last token of what lies before it. Its configurations are
the places where a token could still be open, each with the last token before it and the tokens not
yet emitted. A set of configurations is a state of the deterministic transducer; states and moves
are made when a text first needs them. A token is emitted once all open places agree on it, which is
at most the length of the longest token later.

Ids decode through a table of bytes; `Utf8Stream` turns any cutting of those bytes into whole
characters.
"""

from __future__ import annotations

import base64
import binascii
import gc
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.llm.common import make_room

#: Pieces whose ids are remembered (twice as many at most), their greatest length in characters, and
#: the states of the transducer that are kept, in each Python worker: up to 40 MB of pieces and 150 MB of states.
#: All are made again when needed, which costs several times what keeping them does.
PIECES_KEPT = 100_000
PIECE_KEPT = 48
STATES_KEPT = 300_000
#: Columns of the table of moves. Column 0 stands for all bytes that have none of their own.
CLASSES = 64
#: Ids that are decoded at once.
CHUNK = 1 << 16
_UNMADE = array("i", [-1]) * CLASSES


def read_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    """Token bytes to ranks from lines of base64 and a number; blank lines are skipped."""
    ranks = {}
    for line in lines:
        if line.strip():
            token, rank = line.split()
            try:
                ranks[base64.b64decode(token, validate=True)] = int(rank)
            except binascii.Error as exc:
                raise ValueError(f"not base64: {token[:40]!r}") from exc
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"a byte-level vocabulary has all single bytes; {len(missing)} are missing")
    return ranks


def merge_by_rank(ranks: dict[bytes, int], piece: bytes, until: int = 1) -> list[bytes]:
    """Merge the adjacent pair of the lowest rank, the leftmost of equals, while one is in the vocabulary."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > until:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            break
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class Transducer:
    """Bytes of one piece in, token ids out."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, rank in ranks.items():
            self._add(token, rank)
        self.top = max(ranks.values())
        self.classes, self.next_class = bytearray(256), 1
        self.spines: dict[bool, dict[int, list[tuple[bytes, int]]]] = {True: {}, False: {}}
        self._reset()

    def _add(self, token: bytes, rank: int) -> None:
        node = 0
        for byte in token:
            if byte not in self.children[node]:
                self.children[node][byte] = len(self.children)
                self.children.append({})
                self.token_at.append(-1)
            node = self.children[node][byte]
        self.token_at[node] = rank

    def _reset(self) -> None:
        """Forget the determinised part; it is made again when needed.

        A state is flat: the last token and the tokens that wait where the prefix ends (their number
        first), then for each open place its node of the trie, the last token before it and what waits there.
        """
        start = (-1, 0)
        self.numbers = {start: 0}
        self.states = [start]
        self.table = array("i", [-1]) * CLASSES
        self.rare: dict[int, int] = {}
        self.emitted: dict[int, tuple[int, ...]] = {}
        self.apart: dict[tuple[int, int], bool] = {}

    def _renewed(self, state: int) -> int:
        """Forget all states but one, and give its new number."""
        flat = self.states[state]
        self._reset()
        return self._number(flat)

    def _number(self, flat: tuple[int, ...]) -> int:
        number = self.numbers.get(flat)
        if number is None:
            number = self.numbers[flat] = len(self.states)
            self.states.append(flat)
            self.table.extend(_UNMADE)
        return number

    def _spine(self, token: int, right: bool) -> list[tuple[bytes, int]]:
        """The parts of a token that touch its right (or left) end, from the single byte up, with their ranks."""
        spine = self.spines[right].get(token)
        if spine is None:
            content = self.bytes_of[token]
            spine = [(content, token)]
            while len(spine[-1][0]) > 1:
                parts = merge_by_rank(self.ranks, spine[-1][0], until=2)
                part = parts[-1] if right else parts[0]
                spine.append((part, self.ranks[part]))
            spine.reverse()
            self.spines[right][token] = spine
        return spine

    def _may_follow(self, before: int, token: int) -> bool:
        """Whether merging leaves the two tokens apart; without one before, whether it makes the token at all."""
        known = self.apart.get((before, token))
        if known is None:
            content = self.bytes_of[token]
            known = merge_by_rank(self.ranks, content) == [content] if before < 0 else self._may_follow(-1, token) and self._stay_apart(before, token)
            self.apart[before, token] = known
        return known

    def _stay_apart(self, before: int, token: int) -> bool:
        """Whether nothing merges across the border of two tokens.

        The parts that touch the border grow in the order of their ranks. Two of them would merge
        across it if their pair's rank is below that of what the left one grows into, and at most
        that of what the right one grows into, as the leftmost of equal pairs merges first.
        """
        left, right = self._spine(before, True), self._spine(token, False)
        never = len(self.ranks) + max(self.top, 1)
        i = j = 0
        while True:
            grown_left = left[i + 1][1] if i + 1 < len(left) else never
            grown_right = right[j + 1][1] if j + 1 < len(right) else never
            across = self.ranks.get(left[i][0] + right[j][0], never)
            if across < grown_left and across <= grown_right and across < never:
                return False
            if grown_left == grown_right == never:
                return True
            if grown_left <= grown_right:
                i += 1
            else:
                j += 1

    def _step(self, state: int, byte: int) -> int:
        """The move from a state by a byte: twice the next state, plus one if it emits. Made if it isn't there.

        The first bytes to turn up get a class each, a column of the table; the others' moves are kept aside.
        """
        kind = self.classes[byte]
        if not kind and self.next_class < CLASSES:
            kind = self.classes[byte] = self.next_class
            self.next_class += 1
        move = self.table[state * CLASSES + kind] if kind else self.rare.get(state << 8 | byte, -1)
        if move < 0:
            move = self._make(state, byte)
            if kind:
                self.table[state * CLASSES + kind] = move
            else:
                self.rare[state << 8 | byte] = move
        return move

    def _make(self, state: int, byte: int) -> int:
        children, apart, flat = self.children, self.apart, self.states[state]
        places, ended, size = [], None, len(flat)
        at = 2 + flat[1]
        node, last, waiting = 0, flat[0], flat[2:at]  # the place where the prefix ends
        while True:
            child = children[node].get(byte)
            if child is not None:
                if ended is None:
                    token = self.token_at[child]
                    if token >= 0:
                        follows = apart.get((last, token))
                        if follows or (follows is None and self._may_follow(last, token)):
                            ended = token, (*waiting, token)
                if children[child]:
                    places.append((child, last, waiting))
            if at >= size:
                break
            node, last, end = flat[at], flat[at + 1], at + 3 + flat[at + 2]
            waiting, at = flat[at + 3 : end], end
        if ended is None:
            raise AssertionError("no token ends here; the vocabulary has no single byte for it")
        token, ending = ended
        agreed = len(ending)
        for _, _, waiting in places:
            agreed = min(agreed, len(waiting))
            if ending[:agreed] != waiting[:agreed]:
                agreed = next(i for i, (x, y) in enumerate(zip(ending, waiting)) if x != y)
            if not agreed:
                break
        flat = [token, len(ending) - agreed, *ending[agreed:]]
        for node, last, waiting in places:
            flat += (node, last, len(waiting) - agreed, *waiting[agreed:])
        number = self._number(tuple(flat))
        if agreed:
            self.emitted[state << 8 | byte] = ending[:agreed]
        return 2 * number + bool(agreed)

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one piece; a piece that is a token is that token."""
        rank = self.ranks.get(piece)
        if rank is not None:
            return (rank,)
        table, emitted, state, out = self.table, self.emitted, 0, []
        for byte, kind in zip(piece, piece.translate(self.classes)):
            move = table[state * CLASSES + kind]
            if move < 0:
                if len(self.states) > STATES_KEPT:  # also in the middle of a piece, however long it is
                    state = self._renewed(state)
                    table, emitted = self.table, self.emitted
                move = self._step(state, byte)
            if move & 1:
                out += emitted[state << 8 | byte]
            state = move >> 1
        flat = self.states[state]
        out += flat[2 : 2 + flat[1]]
        return tuple(out)


class _Known(dict):
    """Ids of pieces as bytes, 32 bits each, learnt when first asked for; of two generations, the older one is dropped when the younger is full."""

    def __init__(self, learn) -> None:
        super().__init__()
        self.learn = learn
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = array("i", self.learn(piece.encode())).tobytes()
        if len(piece) <= PIECE_KEPT:
            if len(self) >= PIECES_KEPT:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Whole texts to ids: every match of the pattern is a piece of its own."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.pieces = regex.compile(pattern).findall
        self.known = _Known(Transducer(ranks).encode)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def packed(self, text: str) -> bytes:
        """The ids as bytes, 32 bits each."""
        return b"".join(map(self.known.__getitem__, self.pieces(text)))


class Decoder:
    """Ids to bytes, for whole Arrow columns of lists at once."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        top = max(ranks.values()) + 1
        tokens = [b""] * top
        for token, rank in ranks.items():
            tokens[rank] = token
        self.known = np.zeros(top, bool)
        self.known[list(ranks.values())] = True
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.content = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        places = np.arange(total) + np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.content[places].tobytes()


#: Of a first byte, how many continuation bytes follow, and the range of the first of them: the
#: well-formed byte sequences of Unicode's table 3-7 (fixed values).
_FIRST = (
    (0xC2, 0xDF, 1, 0x80, 0xBF),
    (0xE0, 0xE0, 2, 0xA0, 0xBF),
    (0xE1, 0xEC, 2, 0x80, 0xBF),
    (0xED, 0xED, 2, 0x80, 0x9F),
    (0xEE, 0xEF, 2, 0x80, 0xBF),
    (0xF0, 0xF0, 3, 0x90, 0xBF),
    (0xF1, 0xF3, 3, 0x80, 0xBF),
    (0xF4, 0xF4, 3, 0x80, 0x8F),
)
_LEADS = {b: (more, low, high) for first, last, more, low, high in _FIRST for b in range(first, last + 1)}


class Utf8Stream:
    """Incremental UTF-8: characters leave as soon as their last byte is there.

    The state is the open character: its bytes so far, how many are missing and the range of the
    next. Bytes that can't continue a character become U+FFFD, once for each maximal part of one.
    Runs that are well-formed as a whole are passed on at once; the machine steps through the rest.
    """

    def __init__(self) -> None:
        self.open, self.missing, self.low, self.high = b"", 0, 0x80, 0xBF

    def feed(self, chunk: bytes) -> str:
        out = []
        if not self.missing:
            tail = self._tail(chunk)
            try:
                out.append(chunk[:tail].decode())
                chunk = chunk[tail:]
            except UnicodeDecodeError:
                pass
        for byte in chunk:
            self._step(byte, out)
        return "".join(out)

    def _step(self, byte: int, out: list[str]) -> None:
        if self.missing:
            if self.low <= byte <= self.high:
                self.open += bytes([byte])
                self.missing, self.low, self.high = self.missing - 1, 0x80, 0xBF
                if not self.missing:
                    out.append(self.open.decode())
                return
            out.append("�")
            self.missing = 0
        if byte < 0x80:
            out.append(chr(byte))
        elif byte in _LEADS:
            self.open = bytes([byte])
            self.missing, self.low, self.high = _LEADS[byte]
        else:
            out.append("�")

    @staticmethod
    def _tail(chunk: bytes) -> int:
        """Where the last, perhaps unfinished character begins; the end if it is a single byte."""
        for back in range(1, min(3, len(chunk)) + 1):
            byte = chunk[-back]
            if byte in _LEADS:
                return len(chunk) - back if _LEADS[byte][0] >= back else len(chunk)
            if byte < 0x80:
                break
        return len(chunk)

    def finish(self) -> str:
        rest = "�" if self.missing else ""
        self.missing = 0
        return rest


def stream_text(chunks: Iterable[bytes]) -> Iterator[str]:
    """Decoded characters of a stream of byte chunks, cut anywhere."""
    stream = Utf8Stream()
    for chunk in chunks:
        if text := stream.feed(chunk):
            yield text
    if text := stream.finish():
        yield text


@cache
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return read_ranks(file)


@cache
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(_ranks(path), pattern)


@cache
def _decoder(path: str) -> Decoder:
    return Decoder(_ranks(path))


def _forget() -> None:
    for kept in (_encoder, _decoder, _ranks):
        kept.cache_clear()
    gc.unfreeze()
    gc.collect()


def _everywhere(df: DataFrame, ranks_path: str) -> str:
    """Give the rank file, a few MB of fixed size, to all executors; its name there."""
    df.sparkSession.sparkContext.addFile(ranks_path)
    return ranks_path.rpartition("/")[2]


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The frame, or the columns to ``keep``, with ``ids``, the tokens of every whole text; null counts as empty (no ids).

    A column called ``ids_col`` is replaced. Repeated rows stay; an empty table gives no rows.
    """
    name = _everywhere(df, ranks_path)
    return _with_columns(df, text_col, {ids_col: _IDS}, lambda: _encoding(_encoder(SparkFiles.get(name), pattern)), keep)


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded", chunk: int = CHUNK, keep: list[str] | None = None) -> DataFrame:
    """The frame, or the columns to ``keep``, with the text of its ids, streamed in chunks of ids; null counts as no ids.

    Ids outside the vocabulary are an error. A column called ``out_col`` is replaced.
    """
    name = _everywhere(df, ranks_path)
    return _with_columns(df, ids_col, {out_col: T.StringType()}, lambda: _decoding(_decoder(SparkFiles.get(name)), chunk), keep)


def encode_and_decode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", out_col: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """Both in one pass of the rows: ``ids`` of the text, and the text that these ids decode to."""
    name = _everywhere(df, ranks_path)

    def convert():
        path = SparkFiles.get(name)
        to_ids, to_text = _encoding(_encoder(path, pattern)), _decoding(_decoder(path), CHUNK)

        def step(texts: pa.Array) -> list[pa.Array]:
            ids = to_ids(texts)
            return [*ids, *to_text(*ids)]

        return step

    return _with_columns(df, text_col, {ids_col: _IDS, out_col: T.StringType()}, convert, keep)


_IDS = T.ArrayType(T.IntegerType())


def _encoding(encoder: Encoder):
    def step(texts: pa.Array) -> list[pa.Array]:
        gc.disable()  # hundreds of thousands of remembered states, and no cycles
        try:
            packed = [encoder.packed(t) if t else b"" for t in texts.to_pylist()]
            ends = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int32)
            return [pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(packed), np.int32)))]
        finally:
            gc.freeze()
            gc.enable()

    return step


def _decoding(decoder: Decoder, chunk: int):
    def text(ids: np.ndarray) -> str:
        return "".join(stream_text(decoder.decode(ids[at : at + chunk]) for at in range(0, len(ids), chunk)))

    def step(column: pa.Array) -> list[pa.Array]:
        flat = column.flatten().to_numpy(zero_copy_only=False)
        sizes = np.array(pc.fill_null(pc.list_value_length(column), 0).to_pylist(), np.int64)
        ends = np.cumsum(sizes)
        return [pa.array([text(flat[e - n : e]) for e, n in zip(ends, sizes)], pa.string())]

    return step


def _with_columns(df: DataFrame, source: str, made: dict[str, T.DataType], convert, keep: list[str] | None) -> DataFrame:
    """The kept columns and the made ones, by Arrow batch; columns of their names are replaced.

    A source that is kept travels to the Python worker once, as a field of the row.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in {m.lower() for m in made}]
    row = F.struct(F.lit(0).alias("_"), *[df[f"`{c}`"] for c in kept]).alias("row")
    field = 1 + kept.index(source) if source in kept else None
    packed = df.select(row, *([] if field else [F.col(f"`{source}`").alias("source")]))
    schema = T.StructType([packed.schema["row"], *(T.StructField(f"made{i}", kind) for i, kind in enumerate(made.values()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room("bpe", _forget)
        step = convert()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                row = part.column("row")
                new = step(pc.struct_field(row, [field]) if field else part.column("source"))
                yield pa.RecordBatch.from_arrays([row, *new], names=["row", *(f"made{i}" for i in range(len(new)))])

    out = packed.mapInArrow(run, schema)
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept], *[F.col(f"made{i}").alias(name) for i, name in enumerate(made)])
