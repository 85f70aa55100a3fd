"""Near copies against exact all-pairs resemblance, for copies missed and for clean documents lost."""

import itertools
import random

import numpy as np
import pytest

from eventlens.llm import simhash

FORM = "doc_id long, text string"


def shingles(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def kept_ids(rows, threshold=0.8):
    """The smallest id of each component of pairs that resemble each other, by brute force."""
    sets = {i: shingles(t) for i, t in rows}
    group = {i: i for i, _ in rows}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        if sets[a] == sets[b] or shared >= threshold * (len(sets[a]) + len(sets[b]) - shared) > 0:
            a, b = sorted((root(a), root(b)))
            group[b] = a
    return sorted({root(i) for i in group})


def kept(spark, rows, **how):
    df = spark.createDataFrame(rows, FORM)
    return sorted(r.doc_id for r in simhash.keep_one_of_each(df, simhash.similar_linking(), **how).collect())


def words(rng, n):
    return [f"w{rng.getrandbits(40):x}" for _ in range(n)]


def alike(rng, n, resemblance, shared=200):
    """Documents that begin alike; every two have about the given resemblance."""
    start, own = words(rng, shared), round(shared * (1 / resemblance - 1) / 2)
    return [" ".join(start + words(rng, own)) for _ in range(n)]


def numbered(texts):
    return list(enumerate(texts, 1))


def test_documents_of_a_template_stay(spark):
    rng = random.Random(1)
    rows = numbered(alike(rng, 60, 0.7) + alike(rng, 60, 0.6) + alike(rng, 60, 0.5))
    assert kept_ids(rows) == [i for i, _ in rows]
    assert kept(spark, rows) == kept_ids(rows)


def test_a_repeated_line_is_no_resemblance(spark):
    rng = random.Random(2)
    line = words(rng, 8)
    rows = numbered([" ".join(line * 40 + words(rng, 200)) for _ in range(10)])
    assert kept(spark, rows) == kept_ids(rows) == [i for i, _ in rows]


@pytest.mark.parametrize("most", [1024, 7, 1])
def test_large_groups_are_compared_exactly(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "GROUP_ROWS", most)  # chunks, and with many of them block keys
    rng = random.Random(3)
    rows = numbered(alike(rng, 120, 0.7) + alike(rng, 60, 0.92))
    rng.shuffle(rows)
    assert kept(spark, rows) == kept_ids(rows)
    assert len(kept_ids(rows)) == 121


@pytest.mark.parametrize("n", [10**3, 10**5, 10**6, 10**8, 10**9])
def test_recall_at_the_threshold_holds_for_every_number(n):
    how = simhash.similar_linking()
    keys = np.array(how.keys(n))
    rng = np.random.default_rng(n)
    differ = rng.random((3000, how.bits)) < np.arccos(1.6 / 1.8) / np.pi
    shared = np.zeros(len(differ), bool)
    for key in keys:
        shared |= ~differ[:, key].any(axis=1)
    assert np.mean(shared & (differ.sum(axis=1) <= how.distance)) > 0.98


def test_edited_copies_are_found(spark):
    rng = random.Random(5)
    rows = numbered(t for _ in range(250) for t in alike(rng, 2, 0.81))
    want = kept_ids_of_pairs(rows)
    assert len(want) == 250
    assert len(kept(spark, rows)) <= 256  # an expected recall of 0.99 of 250 pairs


def kept_ids_of_pairs(rows):
    return [i for pair in zip(rows[::2], rows[1::2]) for i in kept_ids(pair)]


def test_set_links_span_what_is_alike():
    rng = np.random.default_rng(4)
    base = [np.unique(rng.integers(0, 1 << 62, 100, np.uint64)) for _ in range(3)]
    sets = [np.unique(np.r_[b[: 100 - cut], rng.integers(0, 1 << 62, 3, np.uint64)]) for b in base for cut in (0, 4, 30, 70)] + [np.empty(0, np.uint64)] * 2
    names = [str(i).encode() for i in range(len(sets))]
    want = {(i, j) for i in range(len(sets)) for j in range(i) if 0 < 0.8 * len(np.union1d(sets[i], sets[j])) <= len(np.intersect1d(sets[i], sets[j]))}
    got = {(max(int(a), int(b)), min(int(a), int(b))) for a, b in simhash._resembling(names, [s.tobytes() for s in sets], 0.8)}
    assert got == want and len(want) == 3


def chain(rng, n, shared=200):
    """Documents of which each resembles the next one by little more than 0.8, and no other."""
    step = 21
    all_words = words(rng, shared + step * n)
    return [" ".join(all_words[step * i : step * i + shared]) for i in range(n)]


def ruled(rows, how):
    """Kept ids by the stage's rule, by brute force: resemblance of 0.8 and a block key in common."""
    sets = [np.unique(np.concatenate([h for h in simhash.shingle_hashes(t.encode(), 5)])) for _, t in rows]
    prints = [bytes(p)[: how.bits // 8] for p in how.fingerprints([t.encode() for _, t in rows], how.words_each)]
    keys = how.keys(len(rows))
    bits = np.unpackbits(np.frombuffer(b"".join(prints), np.uint8).reshape(len(rows), -1), axis=1)
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(max(0, i - 3), i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) and any((bits[i, list(k)] == bits[j, list(k)]).all() for k in keys):
                a, b = sorted((root(i), root(j)))
                group[b] = a
    return sorted({rows[root(i)][0] for i in range(len(rows))})


@pytest.mark.parametrize("most", [2048, 1])
def test_a_chain_is_cut_at_the_same_places_whatever_the_size_of_groups(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "GROUP_ROWS", most)
    rows = numbered(chain(random.Random(8), 400))
    want = ruled(rows, simhash.similar_linking())
    assert kept(spark, rows) == want
    assert 1 <= len(want) <= 10


def test_buckets_of_the_same_fingerprints_give_the_same_links():
    rng = np.random.default_rng(7)
    bits = np.tile(rng.integers(0, 2, 256, dtype=np.uint8), (300, 1)) ^ (rng.random((300, 256)) < 0.03)
    prints = np.packbits(bits, axis=1).view(np.uint64)
    found = [set(simhash._linked(np.zeros(300, np.int64), prints[rng.permutation(300)], 59)) for _ in range(3)]
    assert len(found[0]) == 299
    assert found[0] == found[1] == found[2]
