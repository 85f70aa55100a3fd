"""The training-data queries against their SQL, or against brute force where there is none."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

import __spark_entry__ as entry
from eventlens.llm import bpe, catalog
from tests.oracle import compare


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def test_all_operators_and_the_pipeline_are_registered():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, sf, oracle, name):
    error, rows = compare(spark, oracle, name, catalog.QUERIES[name], catalog.ORACLES[name], sf)
    assert error is None, error
    assert rows > 0


def test_op2_is_what_tiktoken_gives(spark, sf, docs):
    ranks = bpe.read_ranks(open(catalog.RANKS, "rb"))
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in catalog.op2_byte_bpe(spark, sf).collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs:
        ids = want.encode_ordinary(text or "")
        assert got[doc_id].n_tokens == len(ids)
        assert got[doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def fingerprint(text, k=3):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest_reachable(ids, prints, distance):
    group = list(range(len(ids)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= distance):
            a, b = root(i), root(int(j))
            group[max(a, b)] = min(a, b)
    best = {}
    for i, doc_id in enumerate(ids):
        best[root(i)] = min(best.get(root(i), doc_id), doc_id)
    return [best[root(i)] for i in range(len(ids))]


def test_op5_is_all_pairs(spark, sf, docs):
    ids, prints = [d for d, _ in docs], [fingerprint(t) for _, t in docs]
    want = dict(zip(ids, zip((f"{p:016x}" for p in prints), smallest_reachable(ids, np.array(prints, np.uint64), 3))))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in catalog.op5_simhash_blocks(spark, sf).collect()}
    assert got == want


def test_op7_learns_the_languages(spark, sf):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = catalog.op7_language_id(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_op8_separates_labelled_documents(spark, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = {r.doc_id: r for r in catalog.op8_quality_bayes(spark, sf).collect()}
    assert np.mean([rows[d].accepted == (q == 1) for d, q in labels.items()]) > 0.97
    assert all(0 <= r.p_good <= 1 and 0 <= r.p_host <= 1 and 0 <= r.p_path <= 1 for r in rows.values())


def test_op9_shards_are_even_and_gapless(spark, sf, docs):
    rows = catalog.op9_sampled_splitters(spark, sf).collect()
    texts = dict(docs)
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    bytes_in, slots = {}, {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        bytes_in[r.shard] = bytes_in.get(r.shard, 0) + r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) <= set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(bytes_in.values()) - min(bytes_in.values()) <= 2 * max(r["size"] for r in rows)


def test_pipeline_stage_by_stage(spark, sf):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    benchmark = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        docs = pipeline.written(docs, "test")
        after = docs.count()
        assert 0 < after <= before, name
        before = after
    texts = [r.text for r in docs.select("text").collect()]
    assert len({" ".join(t.split()) for t in texts}) == len(texts)
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
    windows = {tuple(w[i : i + 10]) for w in map(words, benchmark) for i in range(max(1, len(w) - 9))}
    assert not any(tuple(w[i : i + 10]) in windows for w in map(words, texts) for i in range(max(1, len(w) - 9)))
    shingles = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    inverted = {}
    for i, s in enumerate(shingles):
        for x in s:
            inverted.setdefault(x, []).append(i)
    pairs = {(a, b) for v in inverted.values() if len(v) < 50 for a in v for b in v if a < b}
    assert not [p for p in pairs if len(shingles[p[0]] & shingles[p[1]]) >= 0.9 * len(shingles[p[0]] | shingles[p[1]])]
    out = pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len(out) == before
    assert all(r.intact and r.n_tokens == len(r.ids) for r in out)
