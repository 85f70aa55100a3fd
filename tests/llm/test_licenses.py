"""Licence scans against plain search, on random and on real notices."""

import random
import re

import pytest

from eventlens.llm import catalog, licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def automaton(notices=licenses.NOTICES, phrases=licenses.PHRASES, **more):
    cut = lambda text: [w.encode() for w in words(text)]
    return licenses.LicenceAutomaton([(label, cut(t)) for label, t in notices], [(label, cut(p)) for p, label in phrases.items()], **more)


def common_runs(doc, notice, least):
    """Longest equal stretches of both, by brute force: (start, end, end in the notice)."""
    found = []
    for i in range(len(doc)):
        for j in range(len(notice)):
            if doc[i] == notice[j] and (i == 0 or j == 0 or doc[i - 1] != notice[j - 1]):
                n = 0
                while i + n < len(doc) and j + n < len(notice) and doc[i + n] == notice[j + n]:
                    n += 1
                if n >= least:
                    found.append((i, i + n, j + n))
    return sorted(found)


@pytest.mark.parametrize("seed", range(300))
def test_runs_and_phrases_are_those_of_plain_search(seed):
    rnd = random.Random(seed)
    some = lambda most, extra=(): [rnd.choice([b"a", b"b", b"c", *extra]) for _ in range(rnd.randint(1, most))]
    notices, phrases, doc = [(f"n{i}", some(12)) for i in range(3)], [(f"p{i}", some(3)) for i in range(2)], some(25, [b"x"])
    made = licenses.LicenceAutomaton(notices, phrases, min_run=3, max_gap=2, min_cover=0.0)
    runs = {}
    made._chained = lambda number, found: runs.update({number: sorted(found)}) or []
    for cut in (len(doc), len(doc) // 2, 1):
        total, spans = made.scan([doc[i : i + cut] for i in range(0, len(doc), cut or 1)] if cut else [doc])
        assert total == len(doc)
        want = sorted((label, i, i + len(p)) for label, p in phrases for i in range(len(doc)) if doc[i : i + len(p)] == p)
        assert sorted((s.label, s.start, s.end) for s in spans) == want
        assert runs == {n: common_runs(doc, words, 3) for n, (_, words) in enumerate(notices)}


def best_chain(runs, max_gap):
    """Most notice words that one chain of runs covers, over all chains."""
    best = []
    for i, (start, end, at) in enumerate(runs):
        here = end - start
        for j, (start_j, end_j, at_j) in enumerate(runs[:i]):
            gain = min(end - start, end - end_j, at - at_j)
            if gain > 0 and start_j < start and start - end_j <= max_gap and at - (end - start) - at_j <= max_gap:
                here = max(here, best[j] + gain)
        best.append(here)
    return max(best, default=0)


@pytest.mark.parametrize("seed", range(100))
def test_chains_cover_as_much_as_any(seed):
    rnd = random.Random(seed)
    notice = [rnd.choice([b"a", b"b", b"c", b"d"]) for _ in range(20)]
    doc = [w if rnd.random() < 0.85 else b"x" for w in notice]
    doc[rnd.randrange(20) : 0] = [b"y"] * rnd.randint(0, 6)
    made = licenses.LicenceAutomaton([("n", notice)], [], min_run=2, max_gap=3, min_cover=0.0)
    _, spans = made.scan([doc])
    want = best_chain(common_runs(doc, notice, 2), 3)
    assert max((round(s.cover * 20) for s in spans), default=0) == want


def test_an_edited_notice_is_one_span():
    text = licenses.NOTICES[6][1].replace("Software", "Library")
    n, spans = automaton().scan(licenses.words_in_slices(f"Copyright 2020\n{text}\nThe end.".encode()))
    assert [(s.label, s.start, s.end, s.phrase) for s in spans] == [("mit", 2, n - 3, False)]  # its last word is changed, too
    assert 0.8 < spans[0].cover < 1


def test_a_chain_does_not_bridge_a_wide_gap():
    half = words(licenses.NOTICES[6][1])
    far = " ".join(half[:43]) + " x" * (licenses.MAX_GAP + 1) + " " + " ".join(half[43:])
    assert automaton().scan(licenses.words_in_slices(far.encode()))[1] == []
    near = far.replace(" x", "", 1)
    assert [s.label for s in automaton().scan(licenses.words_in_slices(near.encode()))[1]] == ["mit"]


def test_a_very_long_text_is_read_to_its_end():
    text = ("word " * 300_000 + "MIT\nLicense ") * 2 + licenses.NOTICES[9][1]
    n, spans = automaton().scan(licenses.words_in_slices(text.encode(), 1 << 16))
    assert n == 600_004 + len(words(licenses.NOTICES[9][1]))
    assert [s.start for s in spans if s.label == "mit"] == [300_000, 600_002]
    assert any(s.label == "apache" and not s.phrase for s in spans)


def test_cases_of_rows(spark):
    rows = [(1, None), (None, "the MIT license"), (2, ""), (3, "MIT  License, apache-license. MIT license"), (3, "MIT  License, apache-license. MIT license"), (4, "mitä license")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS spans", "3 AS n_words")
    out = sorted(((r.id, r.n_words, [(s.label, s.start, s.end) for s in r.spans]) for r in licenses.scan(df).collect()), key=repr)
    three = (3, 6, [("mit", 0, 2), ("apache", 2, 4), ("mit", 4, 6)])
    assert out == sorted([(1, 0, []), (2, 0, []), (None, 3, [("mit", 1, 3)]), three, three, (4, 2, [])], key=repr)
    assert licenses.scan(df.limit(0)).count() == 0


def test_op12_base_columns_are_those_of_plain_search(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in catalog.op12_license_scan(spark, sf).collect()}
    assert len(got) == len(docs)
    seen = set()
    for doc_id, text in docs:
        w = words(text)
        base = sorted((i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        r = got[doc_id]
        assert (r.n_words, r.n_base) == (len(w), len(base))
        assert (r.first_word, r.last_word) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in base}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
        seen |= {label for _, label in base}
    assert seen
