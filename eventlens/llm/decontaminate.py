"""Benchmark decontamination with a generalised suffix automaton.

The words of the benchmark's items build one automaton of all their substrings. A text's words are
streamed through it; at each word it knows the longest run ending there that occurs in some item. A
run of ``window`` words or more is a leak, as is a whole item that is shorter. Words inside leaks are
hit; the spans that hold them can be cut out, and texts dropped that consist of them mostly.

The benchmark is read in blocks of bounded size: one automaton for each, one pass over the texts for
each, so neither the driver nor a task ever holds more than one block's items. Words that no item
has reset the automaton, so only stretches of known words that are long enough are streamed.
"""

from __future__ import annotations

import functools
import re
import uuid
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.llm.common import columns_of, utf8, whole_row, written

WINDOW = 10
#: Words of items in one block: an automaton takes about 1 kB for each.
BLOCK_WORDS = 60_000

_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))
#: A-Z to a-z; ASCII letters, digits and all bytes beyond ASCII stay, everything else is a blank.
_FOLD = bytes(b if b in _KEPT else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class SuffixAutomaton:
    """All word runs of some items; states are sets of end positions, linked to their longest suffix elsewhere."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        items = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for item, words in items if words]
        for _, ids in items:
            last = 0
            for word in ids:
                last = self._extend(last, word)
        self._mark(items)

    def _extend(self, last: int, word: int) -> int:
        """The state of the run ``last`` plus one word, made if there is none."""
        if word in self.next[last]:
            target = self.next[last][word]
            return target if self.length[target] == self.length[last] + 1 else self._split(last, word, target)
        new = self._state(self.length[last] + 1, {}, 0)
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            target = self.next[at][word]
            self.link[new] = target if self.length[target] == self.length[at] + 1 else self._split(at, word, target)
        return new

    def _split(self, at: int, word: int, target: int) -> int:
        """Give the shorter runs of a state, those that extend ``at``, a state of their own."""
        clone = self._state(self.length[at] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = clone
        while at >= 0 and self.next[at].get(word) == target:
            self.next[at][word] = clone
            at = self.link[at]
        return clone

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _mark(self, items: list[tuple[str, list[int]]]) -> None:
        """For each state, the state of the window that ends its runs and the shorter items that end them."""
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        self.window_state = [-1] * len(self.length)
        for state in order:
            if self.length[state] >= self.window:
                above = self.link[state]
                self.window_state[state] = state if self.length[above] < self.window else self.window_state[above]
        self.items_of: dict[int, set[str]] = {}
        whole: dict[tuple[int, int], set[str]] = {}
        for item, ids in items:
            for state, matched in self.run(ids):
                if matched >= self.window:
                    self.items_of.setdefault(self.window_state[state], set()).add(item)
            if len(ids) < self.window:
                whole.setdefault((self._holding(state, len(ids)), len(ids)), set()).add(item)
        own: dict[int, list[tuple[int, set[str]]]] = {}
        for (state, length), found in whole.items():
            own.setdefault(state, []).append((length, found))
        self.short: list[tuple] = [()] * len(self.length)
        if own:
            for state in order:
                self.short[state] = self.short[self.link[state]] + tuple(sorted(own.get(state, ()), key=lambda x: x[0]))
        self.shortest = min([self.window, *(len(ids) for _, ids in items)]) if items else 0

    def _holding(self, state: int, length: int) -> int:
        """The state on the way up from ``state`` whose runs include the last ``length`` words."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def run(self, ids: Iterable[int]) -> Iterator[tuple[int, int]]:
        """(state, longest match) after each word; the words are known to some item."""
        state = matched = 0
        for word in ids:
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                matched += 1
            yield state, matched

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Disjoint [from, to) spans of the words hit, ascending, and the items with windows in the text."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        if not self.vocabulary or len(words) < self.shortest:
            return spans, found
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int32, len(words))
        known = np.flatnonzero(np.diff(np.r_[False, ids >= 0, False]))
        for start, end in zip(known[::2].tolist(), known[1::2].tolist()):
            if end - start < self.shortest:
                continue
            for at, (state, matched) in enumerate(self.run(ids[start:end].tolist()), start + 1):
                if matched >= self.window:
                    found |= self.items_of[self.window_state[state]]
                    hit = matched
                else:
                    hit = 0
                for length, items in self.short[state]:
                    if length <= matched:
                        found |= items
                        hit = max(hit, length)
                if hit:
                    _add(spans, at - hit, at)
        return spans, found


def _add(spans: list[tuple[int, int]], start: int, end: int) -> None:
    """Join a span to those that it touches; ends ascend."""
    while spans and spans[-1][1] >= start:
        start = min(start, spans.pop()[0])
    spans.append((start, end))


def merge(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and out[-1][1] >= start:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items (id as text, words) in blocks of about ``block_words``, one at a time; items without words are left out.

    An item longer than that is a block of its own. Null ids are named ``null``.
    """
    held, size = [], 0
    items = benchmark.select(*columns_of(benchmark, item=item_col, text=text_col)).where(F.col("text").isNotNull())
    for row in items.toLocalIterator():
        words = words_of(row["text"].encode())
        if not words:
            continue
        if held and size + len(words) > block_words:
            yield held
            held, size = [], 0
        held.append(("null" if row["item"] is None else str(row["item"]), words))
        size += len(words)
    if held:
        yield held


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_automata: dict[str, SuffixAutomaton] = {}


def _automaton(name: str, items, window: int) -> SuffixAutomaton:
    """The automaton of a broadcast block, made once in each Python worker; only the last one is kept."""
    if name not in _automata:
        _automata.clear()
        _automata[name] = SuffixAutomaton(items.value, window)
    return _automata[name]


def leaks(packed: DataFrame, benchmark: DataFrame, item_text: str = "text", item_col: str = "item_id", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(row, n_words, spans, items) for the rows (row, text): the words of the text, the spans hit, and the items found.

    Spans are [start, end) word numbers. Texts that are null have no words. ``row`` is handed through.
    """
    sc = packed.sparkSession.sparkContext
    state = packed.withColumns({"spans": F.array().cast(_SPANS), "items": F.array().cast("array<string>")})
    passes = blocks(benchmark, item_col, item_text, block_words)
    block = next(passes, [])
    while True:
        following = next(passes, None)
        state = _one_pass(state, sc.broadcast(block), window, last=following is None)
        if following is None:
            return state
        state, block = written(state, "leaks"), following


def _one_pass(state: DataFrame, items, window: int, last: bool) -> DataFrame:
    """Add one block's spans and items; the last pass leaves the text behind and counts words."""
    name = uuid.uuid4().hex

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(name, items, window)
        for batch in batches:
            counts, spans, names = [], [], []
            for text, before, known in zip(utf8(batch.column("text")), batch.column("spans").to_pylist(), batch.column("items").to_pylist()):
                words = words_of(text)
                hit, found = automaton.find(words)
                if before:
                    hit = merge([*hit, *((s["start"], s["end"]) for s in before)])
                counts.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in hit])
                names.append(sorted(found.union(known)))
            columns = {"row": batch.column("row")} | ({"n_words": pa.array(counts, pa.int64())} if last else {"text": batch.column("text")})
            columns |= {"spans": pa.array(spans, _ARROW_SPANS), "items": pa.array(names, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    fields = [state.schema["row"], T.StructField("n_words", T.LongType()) if last else state.schema["text"]]
    return state.mapInArrow(find, T.StructType([*fields, T.StructField("spans", _SPANS), T.StructField("items", T.ArrayType(T.StringType()))]))


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them; a line break takes their place."""
    raw, out, at = text.encode(), [], 0
    bounds = [m.span() for m in _WORD.finditer(raw)]
    for start, end in spans:
        out.append(raw[at : bounds[start][0]])
        at = bounds[end - 1][1]
    out.append(raw[at:])
    return b"\n".join(out).decode()


def clean(
    df: DataFrame, benchmark: DataFrame, text_col: str = "text", count_col: str | None = None, max_coverage: float = 0.5, window: int = WINDOW, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """The frame without leaked spans, and without the rows of which more than ``max_coverage`` of the words are hit.

    Cutting repeats until nothing is left that the words on both sides of a cut form anew. Rows
    without leaks stay as they are, null texts too. ``count_col``, if given, gets the new number of
    characters where the text changed.
    """
    kinds, done = dict(df.dtypes), []
    todo = df
    while True:
        packed = todo.select(whole_row(todo).alias("row"), F.col(f"`{text_col}`").alias("text"))
        found = leaks(packed, benchmark, window=window, block_words=block_words).withColumn("hit", _n_hit())
        found = written(found.where((F.col("hit") == 0) | (F.col("hit") <= max_coverage * F.col("n_words"))).select("row", "spans", "hit"), "clean")
        done.append(found.where("hit = 0").select("row.*"))
        hit = found.where("hit > 0")
        if hit.isEmpty():
            break
        changed = hit.withColumn("text", F.col("row").getField(text_col)).mapInArrow(_cut_batches, T.StructType([hit.schema["row"], T.StructField("text", T.StringType())]))
        new = {text_col: F.col("text")}
        if count_col in kinds:
            new[count_col] = F.length("text").cast(kinds[count_col])
        todo = written(changed.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in df.columns]), "cut")
    return functools.reduce(DataFrame.union, done)


def _cut_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = batch.column("spans").to_pylist()
        texts = [cut(t, [(s["start"], s["end"]) for s in hit]) for t, hit in zip(batch.column("text").to_pylist(), spans)]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])


def _n_hit():
    return F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + (s["end"] - s["start"]).cast("long"))


def report(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per input row: id, n_words, n_hit, items (sorted as texts)."""
    packed = df.select(*columns_of(df, row=id_col, text=text_col))
    found = leaks(packed, benchmark, window=window, block_words=block_words)
    return found.select(F.col("row").alias("id"), "n_words", _n_hit().alias("n_hit"), "items")
