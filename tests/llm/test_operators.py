"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import collections
import random

import numpy as np
import pytest

from eventlens.llm import bpe, catalog, chat, decontaminate, exact_dedup, langid, quality, sharding, simhash, url_filter, warc
from eventlens.llm import components as stars
from eventlens.llm.common import written
from eventlens.llm.components import components

LONG = " ".join(f"word{i % 977}" for i in range(60_000))
#: Columns beside those that operators read, called as operators call theirs.
CLASH = "doc_id long, text string, lang string, source string, key string, row string, id string, fp string, hash string, bucket string, n string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, l, s, *"abcdefg"[:7]) for i, t, l, s in rows], CLASH)


ROWS = [
    (5, "a  b\tc", "en", "s1"),
    (2, "a b c", "en", "s1"),
    (9, " a b c", None, None),
    (3, None, "en", "s2"),
    (4, "", None, "s2"),
    (None, "a b c", "de", None),
    (7, "a b c", "en", "s1"),
    (7, "a b c", "en", "s1"),
    (8, LONG, "en", "s3"),
    (1, LONG + " ", "en", "s3"),
    (6, "!!! ???", "fr", "s1"),
]


def test_exact_dedup(spark):
    got = exact_dedup.duplicate_classes(documents(spark, ROWS)).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.text_sha256].append(r)
    assert len(got) == len(ROWS)
    for rows in by.values():
        assert sum(r.kept for r in rows) == 1
        assert {r.group_size for r in rows} == {len(rows)}
    abc = next(rows for rows in by.values() if any(r.id == 2 for r in rows))
    assert {r.id for r in abc} == {5, 2, None, 7} and {r.keep_id for r in abc} == {2}
    empty = next(rows for rows in by.values() if any(r.id == 3 for r in rows))
    assert {r.id for r in empty} == {3, 4}
    kept = exact_dedup.deduplicate(documents(spark, ROWS))
    assert kept.columns == documents(spark, ROWS).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.id for r in got if r.kept)


def test_exact_dedup_of_nothing(spark):
    empty = documents(spark, ROWS).where("false")
    assert exact_dedup.duplicate_classes(empty).collect() == [] == exact_dedup.deduplicate(empty).collect()


@pytest.mark.parametrize("bucket_bytes", [200, 5_000, 1 << 20])
def test_grace_spills_and_compares_contents(bucket_bytes):
    rng = random.Random(3)
    contents = [f"text {i}".encode() * rng.randint(1, 30) for i in range(300)]
    rows = [(rng.randrange(4) << 62 | i % 7, contents[i]) for i in (rng.randrange(300) for _ in range(3000))]  # hashes that collide
    fixed = {}
    records = []
    for key, (code, content) in enumerate(rows):
        member = exact_dedup._Members()
        member.add(key, key, 1)
        records.append((fixed.setdefault(content, code), content, member))
    found = list(exact_dedup.grace_classes(records, bucket_bytes))
    want = collections.Counter(c for _, c in rows)
    assert {c: m.size for c, m in found} == want and len(found) == len(want)
    assert all(m.best[1] == min(m.keys) for _, m in found)


def test_open_table_grows():
    table = exact_dedup.OpenTable(2)
    assert [table.number(1, b"%d" % i) for i in range(50)] == list(range(50))
    assert [table.number(1, b"%d" % i) for i in range(50)] == list(range(50))


def test_near_duplicates(spark):
    rows = simhash.near_duplicates(documents(spark, ROWS), simhash.hamming_linking()).collect()
    assert len(rows) == len(ROWS)
    component = {r.id: r.component_id for r in rows}
    assert component[5] == component[2] == component[9] == component[7] == component[None] == 2
    assert component[8] == component[1] == 1
    assert component[3] == component[4] == 3
    kept = simhash.keep_one_of_each(documents(spark, ROWS), simhash.similar_linking())
    assert kept.columns == documents(spark, ROWS).columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 6]
    empty = documents(spark, ROWS).where("false")
    assert simhash.near_duplicates(empty, simhash.hamming_linking()).collect() == []


def test_large_buckets_lose_no_link(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = np.concatenate([base ^ (np.uint64(1) << np.uint64(b)) for b in range(0, 60, 3)] + [base])
    df = spark.createDataFrame([(bytearray(int(p).to_bytes(8, "big")),) for p in prints], "fp binary").distinct()
    want = {frozenset(int(b) ^ (1 << bit) for bit in range(0, 60, 3)) | {int(b)} for b in base}
    for most in (4096, 8, 2):
        found = components(simhash.links(df, simhash.hamming_linking(), most)).collect()
        groups = collections.defaultdict(set)
        for r in found:
            groups[bytes(r.component)].add(int.from_bytes(bytes(r.node), "big"))
        assert {frozenset(g) for g in groups.values()} == want


def test_components_of_a_path_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(200, 200), (None, 3), (7, 7), (300, 301), (301, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}, 200: 200, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_make_their_edges_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 50)], "a long, b long").mapInArrow(counted, "a long, b long")
    found = components(edges)
    assert {r.node: r.component for r in found.collect()} == {**{i: 0 for i in range(21)}, 50: 50}
    assert found.count() == 22
    assert made.value == 21


def test_components_that_are_stars_take_one_round(spark, monkeypatch):
    rounds, large = [], stars._large
    monkeypatch.setattr(stars, "_large", lambda edges: rounds.append(edges) or large(edges))
    edges = [(0, i) for i in range(1, 9)] + [(20 + i, 20) for i in range(1, 9)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == {**{i: 0 for i in range(9)}, **{20 + i: 20 for i in range(9)}}
    assert len(rounds) == 1


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_against_union_find(spark, seed):
    drawn = random.Random(seed)
    edges = [(drawn.randrange(300), drawn.randrange(300)) for _ in range(230)]
    edges += [(999, drawn.randrange(300)) for _ in range(40)] + edges[:30] + [(b, a) for a, b in edges[:20]]
    top = {n: n for e in edges for n in e}

    def root(n):
        while top[n] != n:
            n = top[n]
        return n

    for a, b in edges:
        a, b = root(a), root(b)
        top[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r.node, r.component) for r in got) == sorted((n, root(n)) for n in top)


def test_bpe(spark):
    df = documents(spark, ROWS).withColumnRenamed("key", "ids")
    out = bpe.decode(bpe.encode(df, catalog.RANKS, catalog.public_tokenizers.PATTERN), catalog.RANKS)
    assert sorted(out.columns) == sorted([*df.columns, "decoded"])
    assert all(r.decoded == (r.text or "") for r in out.collect())
    assert bpe.encode(df.where("false"), catalog.RANKS, catalog.public_tokenizers.PATTERN).collect() == []


def test_transducer_forgets_and_merges_alike(monkeypatch):
    ranks = {bytes([b]): b for b in range(256)}
    rng = random.Random(5)
    while len(ranks) < 420:
        parts = [t for t in ranks if all(c in b"abc" for c in t)]
        ranks.setdefault(rng.choice(parts) + rng.choice(parts), len(ranks))
    monkeypatch.setattr(bpe, "STATES_KEPT", 30)
    machine = bpe.Transducer(ranks)
    reachable = [t for t in ranks if bpe.merge_by_rank(ranks, t) == [t]]
    usable = {t: ranks[t] for t in reachable}
    machine = bpe.Transducer(usable)
    for _ in range(3000):
        piece = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 40)))
        assert machine.encode(piece) == tuple(usable[t] for t in bpe.merge_by_rank(usable, piece)), piece
    many = bytes(range(256)) * 2
    assert machine.encode(many) == tuple(usable[t] for t in bpe.merge_by_rank(usable, many))


def test_utf8_stream_in_any_cutting():
    rng = random.Random(2)
    for _ in range(400):
        raw = "".join(rng.choice("aé日😀\n") for _ in range(20)).encode() if rng.random() < 0.5 else bytes(rng.choice([0x41, 0x80, 0xC3, 0xA9, 0xE2, 0xED, 0xA0, 0xF0, 0x9F, 0x98, 0x80, 0xFF]) for _ in range(20))
        chunks, at = [], 0
        while at < len(raw):
            step = rng.randint(1, 5)
            chunks.append(raw[at : at + step])
            at += step
        assert "".join(bpe.stream_text(chunks)) == raw.decode("utf-8", "replace")


def test_bad_vocabulary_and_ids():
    with pytest.raises(ValueError):
        bpe.read_ranks([b"YQ== 0"])
    with pytest.raises(ValueError):
        bpe.Decoder({bytes([b]): b for b in range(256)}).decode(np.array([300]))


def test_chat_template_is_reversible():
    template = chat.Template()
    pieces = [*(c for c, _ in template.codes), *(c for _, c in template.codes), "x", "[", "/", "\\0", "-"]
    rng = random.Random(4)
    for _ in range(2000):
        role, text = ("".join(rng.choice(pieces) for _ in range(rng.randint(0, 8))) for _ in range(2))
        turn, start, end = template.render(role, text)
        assert template.parse(turn) == (role, text)
        assert template.unshield(turn[start:end]) == text
    with pytest.raises(ValueError):
        template.parse("[INST]user[/INST]a</s>b</s>")


def test_prefix_tree_layout(spark):
    rng = random.Random(6)
    talks = {c: [rng.choice("ab") * rng.randint(1, 2) for _ in range(rng.randint(1, 6))] for c in range(60)}
    talks[60] = talks[7] + ["more"]
    talks[None] = talks[7]
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", x, "k") for c, turns in talks.items() for t, x in enumerate(turns)]
    rows += [(99, None, None, None, "k"), (99, 0, "assistant", "", "k"), (98, 1, "user", "same", "k"), (98, 1, "user", "same", "k")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv string")
    stream, paths = chat.prefix_tree(df)
    stream = written(stream, "stream")
    nodes = sorted(stream.collect(), key=lambda r: r.start)
    prefixes = {tuple(t[: i + 1]) for t in talks.values() for i in range(len(t))}
    assert len(nodes) == len(prefixes) + 4
    at, text = 0, "".join(n.rendered for n in nodes)
    for n in nodes:
        assert n.start == at
        at += n.n_chars
        seen = "".join(text[i.start : i.end] for i in n.attends)
        assert len(seen) == n.position + n.n_chars and seen.endswith(n.rendered)
    back = collections.defaultdict(list)
    for r in chat.read_back(stream, paths).collect():
        back[r.conv].append((r.depth, chat.Template().parse(r.rendered)[1]))
    assert {c: [x for _, x in sorted(v)] for c, v in back.items() if c not in (98, 99)} == talks
    assert sorted(back[99]) == [(1, ""), (2, "")] and sorted(back[98]) == [(1, "same"), (2, "same")]
    none = chat.prefix_tree(df.where("false"))
    assert none[0].collect() == [] == chat.digests(chat.read_back(*none)).collect()


def test_urls_and_rules(spark):
    pages = [
        (1, "https://WWW.Example.com/en/1?x=/fr/", None, "k"),
        (2, "http://a.example.com/en/", "", "k"),
        (3, "http://example.com/en", "", "k"),
        (4, "http://badexample.com/en/", "", "k"),
        (5, "ftp://x.net/fr/a#b", "", "k"),
        (6, "no address", "", "k"),
        (7, None, None, "k"),
        (8, "http://alias.org/1#top", '<html><LINK href="http://x.net/fr/a" rel="canonical"></html>', "k"),
        (9, "http://alias.org/2", "<meta http-equiv='refresh' content='0; url=http://alias.org/1'>", "k"),
        (10, "http://alias.org/3", '<link rel=canonical href="http://x.com/?a=1&amp;b=2">', "k"),
        (11, "http://mixed.org/", '<link rel="canonical" href="http://x.com/?a=1&b=2">', "k"),
        (12, "http://mixed.org/", '<link rel="canonical" href="http://y.net/es/">', "k"),
        (13, "://", "", "k"),
        (13, "://", "", "k"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, host string")
    got = {r.id: r for r in url_filter.judge(df, catalog.RULES).collect()}
    parts = {i: (r.host, r.path, r.rule) for i, r in got.items()}
    assert parts[1] == ("www.example.com", "/en/1", "www.example.com/en/")
    assert parts[2] == ("a.example.com", "/en/", "example.com/en/")
    assert parts[3] == ("example.com", "/en", "com/")
    assert parts[4] == ("badexample.com", "/en/", "com/")
    assert parts[5] == ("x.net", "/fr/a", "net/fr/")
    assert parts[6] == parts[7] == parts[13] == ("", "", None)
    assert {i: r.verdict for i, r in got.items()} == {1: "allow", 2: "block", 3: "allow", 4: "allow", 5: "block", 6: "allow", 7: "allow", 8: "block", 9: "block", 10: "allow", 11: "allow", 12: "allow", 13: "allow"}
    assert got[9].alias_rule == "net/fr/" and got[10].alias_rule == "com/"
    assert url_filter.judge(df.where("false"), catalog.RULES).collect() == []
    with pytest.raises(ValueError):
        url_filter.Rule.parse("block", "host-without-path")


def test_warc_round_trip(spark):
    big = "<p>" + "x" * 200 + "</p>"
    pages = [(3, "http://a/\r\nX: 1", big, "k"), (1, "http://b/", big, "k"), (2, None, big, "k"), (4, "u", None, "k"), (5, "u", "", "k"), (6, "u", "short", "k"), (7, "u", "short", "k"), (8, "u", "é" * 300_000, "k"), (8, "u", "é" * 300_000, "k"), (None, "u", "null id " * 20, "k")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, key string")
    got = warc.round_trip(df).collect()
    assert len(got) == len(pages) and not [r for r in got if r.error]
    by = {r.key: r for r in got}
    assert {k: (r.record_type, r.refers_to) for k, r in by.items()} == {"1": ("response", None), "2": ("revisit", "1"), "3": ("revisit", "1"), **{k: ("response", None) for k in ("4", "5", "6", "7", "8", None)}}
    assert by["2"].payload_bytes == len(big) and by["2"].payload_digest == by["1"].payload_digest and by["2"].payload is None
    assert bytes(by["8"].payload).decode() == "é" * 300_000
    assert warc.round_trip(df.where("false")).collect() == []


def test_warc_damage_is_reported():
    import hashlib

    import zstandard

    data = [warc.record(i, f"http://a/{i}", "response", b"payload %d" % i * 40, hashlib.sha256(b"payload %d" % i * 40).hexdigest()) for i in range(30)]
    content = warc.train(data)
    made = zstandard.ZstdCompressor(dict_data=warc._loaded(content))
    archive = warc.dictionary_frame(content) + b"".join(map(made.compress, data))
    assert [r[1] for r in warc._read_one("p", archive)] == ["response"] * 30
    bad = [data[0].replace(b"payload 0", b"payload X", 1), data[1].replace(b"WARC/1.1", b"HTTP/1.1", 1), data[2][:-2], data[3].replace(b"WARC-Date", b"WARC-Day"), data[4]]
    rows = list(warc._read_one("p", warc.dictionary_frame(content) + b"".join(map(made.compress, bad))))
    assert [r[-1] is None for r in rows] == [False, False, False, False, True]
    assert list(warc._read_one("p", archive[:-3]))[-1][-1].endswith("cut short")
    assert [r[-1] for r in warc._read_one("p", b"garbage that is no frame")][0]


def test_language_of_odd_texts(spark):
    df = documents(spark, ROWS)
    model = langid.fit(df)
    rows = langid.predict(df, model).collect()
    assert len(rows) == len(ROWS)
    assert {r.lang_pred for r in rows if r.id in (3, 4, 6)} == {"und"} and all(r.score == 0 for r in rows if r.id in (3, 4, 6))
    assert all(r.lang_pred in model.languages for r in rows if r.id in (2, 5, 8))
    assert langid.predict(df.where("false"), model).collect() == []
    none = langid.fit(df.where("false"))
    assert {r.lang_pred for r in langid.predict(df, none).collect()} == {"und"}


def test_subwords_of_slices_are_those_of_the_whole(monkeypatch):
    whole, n = langid.subword_counts("Ärger und viele weitere Wörter " * 50)
    monkeypatch.setattr(langid, "SLICE_BYTES", 37)
    sliced, m = langid.subword_counts("Ärger und viele weitere Wörter " * 50)
    assert n == m and (whole == sliced).all()


def test_quality_of_odd_texts(spark):
    labels = spark.createDataFrame([(2, 1), (5, 1), (7, 1), (6, 0), (6, 1), (4, 0), (4, None), (None, 1)], "doc_id long, quality int")
    df = documents(spark, ROWS)
    rows = quality.judged(df, labels).select("row.*", "p_good", "accepted").collect()
    assert len(rows) == len(ROWS) and all(0 <= r.p_good <= 1 for r in rows)
    free = quality.judged(df, labels.where("false")).collect()
    assert len(free) == len(ROWS) and all(r.accepted for r in free)
    assert quality.judged(df.where("false"), labels).collect() == []


def test_sparse_sites_shrink_toward_their_hosts(spark):
    rows = [("big", "a", 0.9)] * 60 + [("big", "b", 0.1)] + [("low", "a", 0.2)] * 60 + [("low", None, 0.2)] * 5
    found = quality.sites(spark.createDataFrame(rows, "host string, path string, evidence double"))
    at = {(r.host, r.path): r for r in found.table.collect()}
    assert at["big", "b"].n == 1 and at["big", "b"].hn == 61 and at["low", None].n == 5
    assert 0 < found.mean < 1 and found.host_strength > 0 and found.path_strength > 0


@pytest.mark.parametrize(("ranges", "cell"), [(16, 250_000), (1, 3)])
def test_sharding_of_odd_rows(spark, ranges, cell):
    df = documents(spark, ROWS + [(100 + i, "copy of a text", None, None) for i in range(120)])
    rows = sharding.shard_by_bytes(df, 4, ranges_per_shard=ranges, cell_rows=cell).collect()
    assert len(rows) == len(ROWS) + 120
    for s in range(4):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert {r["size"] for r in rows if r.id in (3, 4)} == {8} and {r.text_crc32 for r in rows if r.id in (3, 4)} == {0}
    totals = [sum(r["size"] for r in rows if r.shard == s) for s in range(4)]
    assert max(totals) - min(totals) <= 2 * max(r["size"] for r in rows)
    assert sharding.shard_by_bytes(df.where("false"), 4).collect() == []


def brute_leaks(texts, items, window):
    words = lambda t: decontaminate.words_of((t or "").encode())
    windows = collections.defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            windows[tuple(w[i : i + window])].add(str(item))
    out = {}
    for doc, text in texts:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if names := windows.get(tuple(w[i : i + size])):
                    found |= names
                    hit.update(range(i, i + size))
        out[doc] = (len(w), len(hit), tuple(sorted(found)))
    return out


@pytest.mark.parametrize("block_words", [10_000, 12])
def test_leaks_are_those_of_brute_force(spark, block_words):
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    items = [(i, say(rng.randint(1, 14))) for i in range(25)] + [(50, None), (51, "!!"), (52, "Ä é"), (None, "zz zz zz")]
    texts = [(i, say(rng.randint(0, 60))) for i in range(80)] + [(90, None), (91, ""), (92, "x Ä, é! y"), (93, "zz ZZ zz")]
    df = spark.createDataFrame([(i, t, "k") for i, t in texts], "doc_id long, text string, spans string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    named = [("null" if i is None else i, t) for i, t in items]
    for window in (4, 7):
        rows = decontaminate.report(df, benchmark, window=window, block_words=block_words).collect()
        assert {r.id: (r.n_words, r.n_hit, tuple(r["items"])) for r in rows} == brute_leaks(texts, named, window)
    left = decontaminate.clean(df, benchmark, window=7, max_coverage=0.9, block_words=block_words)
    assert left.columns == df.columns
    rows = left.collect()
    assert not any(n for _, n, _ in brute_leaks([(r.doc_id, r.text) for r in rows], named, 7).values())
    assert {90, 91} <= {r.doc_id for r in rows}
    assert decontaminate.report(df.where("false"), benchmark).collect() == []
    assert all(r.n_hit == 0 for r in decontaminate.report(df, benchmark.where("false")).collect())


def test_stages_of_the_pipeline_take_odd_documents(spark, sf):
    import corpus_pipeline as pipeline

    for rows in (documents(spark, ROWS), documents(spark, ROWS).where("false")):
        for name, stage in pipeline.STAGES:
            out = stage(spark, rows, sf)
            assert out.count() <= rows.count(), name
            if name != "bpe":
                assert out.columns == rows.columns, name
