"""Licence scans with a generalised suffix automaton.

The words of all licence notices and phrases make one automaton of their runs. A text is streamed through it
once; after each word the automaton knows the longest run ending there that some notice has (the matching
statistic) and where in the notices that run ends. Runs of enough words are kept as diagonals (the same distance
between text and notice), and those of one notice that follow each other within a gap are chained to a span. A
span that covers enough of its notice gives the notice's label; changed names, years and a few changed words leave
gaps in the chain, not holes in the result. Phrases count where all their words stand next to each other.

Texts are independent of each other: one pass, no shuffle. A text is cut into slices of bounded size between words,
the automaton's state and open diagonals go on from one slice to the next.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from eventlens.llm.common import batches_of, columns_of

#: Words that a run needs to be part of a chain.
MIN_RUN = 5
#: Words of text or notice between two runs of a chain.
MAX_GAP = 30
#: Share of a notice's words that a span has to cover.
MIN_COVER = 0.6
#: Bytes of a text that are cut into words at once.
SLICE = 1 << 20

# Phrases and their labels.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

# The public notices of widely used licences.
NOTICES = [
    ("mit", "Released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
        permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright
        notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    ),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution.""",
    ),
    (
        "apache",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
    ),
    (
        "gpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details.""",
    ),
]

_WORD_BYTES = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))
#: A-Z become a-z; digits, letters and bytes beyond ASCII stay, all else parts words.
_FOLDED = bytes(b | 32 if 65 <= b <= 90 else b if b in _WORD_BYTES else 32 for b in range(256))


def words_in_slices(text: bytes, slice_bytes: int = SLICE) -> Iterator[list[bytes]]:
    """The words of a text, a list for each slice; a slice ends between words."""
    folded, start = text.translate(_FOLDED), 0
    while start < len(folded):
        end = folded.find(b" ", start + slice_bytes)
        end = len(folded) if end < 0 else end
        yield folded[start:end].split()
        start = end


@dataclass(frozen=True)
class Span:
    """Words [start, end) of a text; ``cover`` is the share of the notice's words that they hold."""

    label: str
    start: int
    end: int
    cover: float
    phrase: bool


class LicenceAutomaton:
    """Suffix automaton of some notices (label, words) and phrases (words to label)."""

    def __init__(self, notices: list[tuple[str, list[bytes]]], phrases: list[tuple[str, list[bytes]]], min_run: int = MIN_RUN, max_gap: int = MAX_GAP, min_cover: float = MIN_COVER) -> None:
        self.notices = [(label, words) for label, words in notices if words]
        phrases = [(label, words) for label, words in phrases if words]
        self.min_run, self.max_gap, self.min_cover = min_run, max_gap, min_cover
        self.ids: dict[bytes, int] = {}
        self.moves: list[dict[int, int]] = [{}]
        self.shorter = [0]  # the state of the longest suffix that occurs elsewhere too
        self.longest = [0]
        everything = [words for _, words in self.notices + phrases]
        ends: dict[int, list[tuple[int, int]]] = {}
        for number, words in enumerate(everything):
            at = 0
            for word in words:
                at = self._append(at, self.ids.setdefault(word, len(self.ids)))
        for number, (_, words) in enumerate(self.notices):
            for place, (state, _) in enumerate(self._walk(words)):
                ends.setdefault(state, []).append((number, place + 1))
        order = sorted(range(1, len(self.moves)), key=self.longest.__getitem__)
        self._mark_runs(order, ends)
        self._mark_phrases(order, phrases)
        self.least = min([min_run, *(len(words) for _, words in phrases)])

    def _append(self, at: int, word: int) -> int:
        """The state of run ``at`` and one more word."""
        found = self.moves[at].get(word)
        if found is not None:
            return found if self.longest[found] == self.longest[at] + 1 else self._parted(at, word, found)
        new = self._new(self.longest[at] + 1, {})
        while word not in self.moves[at]:
            self.moves[at][word] = new
            if at == 0:
                return new  # no suffix of it was known
            at = self.shorter[at]
        found = self.moves[at][word]
        self.shorter[new] = found if self.longest[found] == self.longest[at] + 1 else self._parted(at, word, found)
        return new

    def _parted(self, at: int, word: int, whole: int) -> int:
        """A state of its own for the runs of ``whole`` that are no longer than run ``at`` and the word."""
        part = self._new(self.longest[at] + 1, dict(self.moves[whole]))
        self.shorter[part], self.shorter[whole] = self.shorter[whole], part
        while self.moves[at].get(word) == whole:
            self.moves[at][word] = part
            if at == 0:
                break
            at = self.shorter[at]
        return part

    def _new(self, longest: int, moves: dict[int, int]) -> int:
        self.moves.append(moves)
        self.longest.append(longest)
        self.shorter.append(0)
        return len(self.moves) - 1

    def _step(self, state: int, matched: int, word: int) -> tuple[int, int]:
        """State and matching statistic after one more known word."""
        moves = self.moves
        while state and word not in moves[state]:
            state = self.shorter[state]
            matched = self.longest[state]
        if word in moves[state]:
            return moves[state][word], matched + 1
        return 0, 0

    def _walk(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        state = matched = 0
        for word in words:
            state, matched = self._step(state, matched, self.ids[word])
            yield state, matched

    def _mark_runs(self, order: list[int], ends: dict[int, list[tuple[int, int]]]) -> None:
        """For states of long enough runs: (notice, end in it, words) of all places; words caps the match there.

        A place belongs to the longest state that has it, so a shorter run of another notice isn't lost
        behind a longer one. States further down the tree of suffixes come first.
        """
        places: list[dict[tuple[int, int], None]] = [dict.fromkeys(ends.get(s, ())) for s in range(len(self.moves))]
        for state in reversed(order):
            if self.longest[state] >= self.min_run:
                places[self.shorter[state]] |= places[state]
        self.places: list[tuple] = [()] * len(self.moves)
        for state in order:
            if self.longest[state] >= self.min_run:
                own = tuple((n, end, self.longest[state]) for n, end in places[state])
                inherited = tuple(p for p in self.places[self.shorter[state]] if (p[0], p[1]) not in places[state])
                self.places[state] = own + inherited

    def _mark_phrases(self, order: list[int], phrases: list[tuple[str, list[bytes]]]) -> None:
        """For each state the (words, label) of phrases that end its runs, also by way of shorter ones."""
        own: dict[int, list[tuple[int, str]]] = {}
        for label, words in phrases:
            *_, (state, _) = self._walk(words)
            while self.longest[self.shorter[state]] >= len(words):
                state = self.shorter[state]
            own.setdefault(state, []).append((len(words), label))
        self.phrases: list[tuple] = [()] * len(self.moves)
        for state in order if own else ():
            self.phrases[state] = self.phrases[self.shorter[state]] + tuple(own.get(state, ()))

    def scan(self, slices: Iterable[list[bytes]]) -> tuple[int, list[Span]]:
        """Number of words, and the spans of phrases and notices, by start, end and label."""
        spans: list[Span] = []
        runs: list[list[tuple[int, int, int]]] = [[] for _ in self.notices]  # (start, end, end in the notice)
        open_: dict[tuple[int, int], list[int]] = {}
        state = matched = total = 0
        for words in filter(None, slices):
            ids = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int32, len(words))
            bounds = np.flatnonzero(np.diff(np.r_[False, ids >= 0, False]))
            if not len(bounds) or bounds[0]:
                state = matched = 0
            for start, end in zip(bounds[::2].tolist(), bounds[1::2].tolist()):
                if start:
                    state = matched = 0
                    if end - start < self.least and end < len(words):
                        continue
                for place, word in enumerate(ids[start:end].tolist(), total + start + 1):
                    state, matched = self._step(state, matched, word)
                    for n, label in self.phrases[state]:
                        if n <= matched:
                            spans.append(Span(label, place - n, place, 1.0, True))
                    if matched >= self.min_run:
                        self._extend(open_, runs, place, state, matched)
                    elif open_:
                        self._close(open_, runs, place)
            if not len(bounds) or bounds[-1] < len(words):
                state = matched = 0
            total += len(words)
        self._close(open_, runs, total + 1)
        for number, found in enumerate(runs):
            spans += self._chained(number, found)
        return total, sorted(spans, key=lambda s: (s.start, s.end, s.label, not s.phrase))

    def _extend(self, open_: dict, runs: list[list], place: int, state: int, matched: int) -> None:
        """Lengthen the diagonals of the places of a state, and close those that end before this word."""
        for notice, end, most in self.places[state]:
            run = open_.get((notice, end - place))
            if run and run[1] == place - 1:
                run[1] = place
            else:
                if run:
                    runs[notice].append((run[0], run[1], end - place + run[1]))
                open_[notice, end - place] = [place - min(matched, most), place]
        self._close(open_, runs, place)

    @staticmethod
    def _close(open_: dict, runs: list[list], place: int) -> None:
        for notice, shift in [key for key, run in open_.items() if run[1] < place]:
            start, end = open_.pop((notice, shift))
            runs[notice].append((start, end, end + shift))

    def _chained(self, number: int, runs: list[tuple[int, int, int]]) -> list[Span]:
        """Spans of one notice: its runs in order of text and notice, chained so that they cover the most words."""
        label, notice = self.notices[number]
        runs.sort()
        best, back = [], []
        recent: deque[int] = deque()  # runs that end late enough to go on from
        for i, (start, end, at) in enumerate(runs):
            while recent and runs[recent[0]][1] + self.max_gap < start:
                recent.popleft()
            covered, previous = end - start, -1
            for j in recent:
                start_j, end_j, at_j = runs[j]
                gain = min(end - start, end - end_j, at - at_j)
                near = start - end_j <= self.max_gap and (at - (end - start)) - at_j <= self.max_gap
                if gain > 0 and near and start_j < start and best[j] + gain > covered:
                    covered, previous = best[j] + gain, j
            best.append(covered)
            back.append(previous)
            recent.append(i)
        spans, used = [], [False] * len(runs)
        for i in sorted(range(len(runs)), key=lambda i: (-best[i], i)):
            if used[i]:
                continue
            at, first = i, i
            while at >= 0 and not used[at]:
                used[at] = True
                first, at = at, back[at]
            cover = (best[i] - (best[at] if at >= 0 else 0)) / len(notice)
            if cover >= self.min_cover:
                spans.append(Span(label, runs[first][0], runs[i][1], min(cover, 1.0), False))
        return spans


_automata: dict[str, LicenceAutomaton] = {}

SPAN = T.StructType(
    [
        T.StructField("label", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("cover", T.DoubleType()),
        T.StructField("phrase", T.BooleanType()),
    ]
)


def scan(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    notices: list[tuple[str, str]] = NOTICES,
    phrases: dict[str, str] = PHRASES,
    min_run: int = MIN_RUN,
    max_gap: int = MAX_GAP,
    min_cover: float = MIN_COVER,
) -> DataFrame:
    """(id, n_words, spans) for every row: spans of [start, end) words with label, cover and whether it is a phrase.

    A phrase has a span for every place where it stands; a notice has one for each chain that covers ``min_cover`` of
    its words. Spans are sorted by start, end and label. Null texts count as empty: no words, no spans. Repeated rows are
    scanned each; ids may be null; other columns are ignored; an empty table gives no rows.

    Notices and phrases are parameters that every task holds: about 1 kB a word for the automaton.
    """
    packed = df.select(*columns_of(df, id=id_col, text=text_col))
    schema = T.StructType([packed.schema["id"], T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(SPAN))])
    name = uuid.uuid4().hex

    def automaton() -> LicenceAutomaton:
        if name not in _automata:
            _automata.clear()
            cut = [[(label, [w for words in words_in_slices(text.encode()) for w in words]) for label, text in pairs] for pairs in (notices, [(label, p) for p, label in phrases.items()])]
            _automata[name] = LicenceAutomaton(*cut, min_run, max_gap, min_cover)
        return _automata[name]

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = automaton()

        def made():
            for batch in batches:
                texts = batch.column("text").cast(pa.large_binary())
                for row, text in zip(batch.column("id"), texts):
                    n_words, spans = scanner.scan(words_in_slices(text.as_py() or b""))
                    yield row.as_py(), n_words, [vars(s) for s in spans]

        yield from batches_of(made(), to_arrow_schema(schema))

    return packed.mapInArrow(find, schema)
