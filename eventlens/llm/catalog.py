"""Registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm import bpe, chat, decontaminate, exact_dedup, langid, licenses, merkle, prefix_trie, quality, sharding, simhash, url_filter, warc
from eventlens.llm.common import table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SHARDS = 24
RULES = [
    url_filter.Rule.parse("allow", "com/"),
    url_filter.Rule.parse("block", "example.com/en/"),
    url_filter.Rule.parse("allow", "www.example.com/en/"),
    url_filter.Rule.parse("block", "net/es/"),
    url_filter.Rule.parse("block", "net/fr/"),
]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


_SHIELDED = r"""replace(replace(replace(replace(replace({0}, '\', '\-'), '[INST]', '\0'), '[/INST]', '\1'), '</s>', '\2'), '<s>', '\3')"""


@query(
    rf"""
    WITH turns AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
    )
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
      sum(length('[INST]' || {_SHIELDED.format('role')} || '[/INST]' || {_SHIELDED.format('text')} || '</s>'))::BIGINT AS formatted_chars
    FROM turns GROUP BY conv_id
    """
)
def op1_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    stream, paths = chat.prefix_tree(rows.union(extra))
    return chat.digests(chat.read_back(stream, paths))


@query()
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = bpe.encode_and_decode(docs, RANKS, public_tokenizers.PATTERN, keep=["doc_id"])
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


_HOST = r"translate(regexp_extract(coalesce({0}, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"regexp_extract(coalesce({0}, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1)"
_RULE = """CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END"""
_VERDICT = "CASE WHEN rule IS NULL THEN NULL WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' ELSE 'block' END"


@query(
    rf"""
    WITH RECURSIVE parsed AS (
      SELECT page_id, regexp_replace(url, '#(?s:.*)$', '') AS node, {_HOST.format('url')} AS host, {_PATH.format('url')} AS path, html FROM pages
    ), judged AS (SELECT *, {_RULE} AS rule FROM parsed),
    tags AS (
      SELECT node, unnest(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>')) AS tag FROM parsed
      UNION ALL SELECT node, unnest(regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>')) FROM parsed
    ), links AS (
      SELECT trim(replace(node, '&amp;', '&')) AS a, regexp_replace(trim(replace(
        regexp_extract(tag, '(?is)\b(?:href|url)\s*=\s*["'']?([^"''>\s]+)', 1), '&amp;', '&')), '#.*$', '') AS b FROM tags
    ), edges AS (SELECT a, b FROM links WHERE b LIKE '%://%' UNION SELECT b, a FROM links WHERE b LIKE '%://%'),
    reach AS (SELECT a AS node, a AS other FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.other = e.a),
    ends AS (SELECT node, {_HOST.format('other')} AS host, {_PATH.format('other')} AS path FROM reach),
    decided AS (SELECT *, {_VERDICT} AS v FROM (SELECT node, {_RULE} AS rule FROM ends)),
    alias AS (
      SELECT node, CASE WHEN bool_or(v = 'allow') THEN 'allow' ELSE 'block' END AS verdict,
        coalesce(min(rule) FILTER (WHERE v = 'allow'), min(rule)) AS rule
      FROM decided WHERE v IS NOT NULL GROUP BY node
    )
    SELECT page_id, host, path, j.rule AS rule, CASE WHEN j.rule IS NULL THEN a.rule END AS alias_rule,
      coalesce({_VERDICT.replace('rule', 'j.rule')}, a.verdict, 'allow') AS verdict
    FROM judged j LEFT JOIN alias a ON j.node = a.node
    """
)
def op3_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter.judge(table(spark, sf_dir, "pages"), RULES)
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "alias_rule", "verdict")


@query(
    r"""
    WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
    SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
    FROM n WINDOW w AS (PARTITION BY t)
    """
)
def op4_grace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.duplicate_classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


@query()
def op5_simhash_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), simhash.hamming_linking(words_each=3, distance=3))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


@query(
    """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
    d AS (
      SELECT page_id, octet_length(body) AS n, sha256(body) AS digest,
        min(page_id) OVER (PARTITION BY CASE WHEN octet_length(body) >= 100 THEN body ELSE encode('row ' || page_id) END) AS first
      FROM p
    )
    SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
      CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to
    FROM d
    """
)
def op6_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    read = warc.round_trip(pages)
    return read.select(F.col("key").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


@query()
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs)).withColumnRenamed("id", "doc_id")


@query()
def op8_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = quality.judged(docs, labels, row=F.col("doc_id"))
    return found.select(F.col("row").alias("doc_id"), "host", "path", "p_text", "p_host", "p_path", "p_good", "accepted")


@query()
def op9_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), SHARDS)
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", law, "shard", "slot", grown)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"


@query(
    rf"""
    WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    win AS (
      SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS run
      FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM (SELECT *, least(10, len(w)) AS size FROM item WHERE len(w) > 0))
    ), sizes AS (SELECT DISTINCT size FROM win),
    spot AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc, sizes WHERE len(w) >= size),
    found AS (SELECT a.doc_id, a.i, a.size, win.item_id FROM spot a JOIN win ON win.size = a.size AND win.run = array_to_string(a.w[a.i:a.i + a.size - 1], ' ')),
    hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY doc_id),
    items AS (
      SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
    )
    SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(s.n, 0)::BIGINT AS n_items,
      sha256(coalesce(s.names, '')) AS items_sha256, h.n IS NOT NULL AS contaminated
    FROM doc d LEFT JOIN hit h ON d.doc_id = h.doc_id LEFT JOIN items s ON d.doc_id = s.doc_id
    """
)
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen({0}::VARCHAR)), lambda i: ascii(substr({0}::VARCHAR, i + 1, 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda x, k: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""


@query(
    rf"""
    WITH said AS (
      SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS sign,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
      FROM conversations WHERE conv_id IS NOT NULL
    ), own AS (SELECT conv_id, list(sign ORDER BY turn NULLS FIRST, sign) AS signs, list(words ORDER BY turn NULLS FIRST, sign) AS words FROM said GROUP BY conv_id),
    taken AS (SELECT *, {_CRC32.format('conv_id')} % 4 AS h FROM own),
    whole AS (
      SELECT t.conv_id, list_concat(coalesce(b.signs[1:t.h], []), t.signs[t.h + 1:]) AS signs, list_concat(coalesce(b.words[1:t.h], []), t.words[t.h + 1:]) AS words
      FROM taken t LEFT JOIN own b ON b.conv_id = t.conv_id - t.conv_id % 20
    ), steps AS (SELECT conv_id, signs, words, unnest(range(0, len(signs) + 1)) AS depth FROM whole),
    nodes AS (
      SELECT signs[1:depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN depth > 0 THEN words[depth] ELSE 0 END) AS words,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(signs) = depth), '')) AS ends_sha256
      FROM steps GROUP BY ALL
    ), kids AS (SELECT node[1:depth - 1] AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
    up AS (
      SELECT n.node[1:d] AS node, sum((n.n_convs - 1) * n.words)::BIGINT AS saved_tokens, count(*) FILTER (WHERE k.n IS NULL) AS n_leaves
      FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM nodes) n LEFT JOIN kids k ON k.node = n.node GROUP BY ALL
    )
    SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, u.n_leaves, u.saved_tokens, n.ends_sha256
    FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.node = n.node[1:n.depth - 1] LEFT JOIN kids k ON k.node = n.node JOIN up u ON u.node = n.node
    """
)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


@query()
def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["phrase"])
    names = lambda spans: F.array_join(F.array_sort(F.array_distinct(spans["label"])), ",")
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base["start"]).alias("first_word"),
        F.array_max(base["start"]).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.col("spans")["cover"]), F.lit(0.0)).alias("score"),
    )


def _leaf_sql(n_chars: str) -> str:
    fields = ("doc_id", "source", "lang", n_chars, "text")
    return "sha256(" + " || ".join(f"coalesce(strlen({f}::VARCHAR) || ':' || {f}::VARCHAR, '-')" for f in fields) + ")"


@query(
    rf"""
    WITH RECURSIVE leaves AS (
      SELECT doc_id, lang, {_leaf_sql('n_chars')} AS leaf,
        CASE WHEN {_CRC32.format('doc_id')} % 7 = 0 THEN {_leaf_sql('(n_chars + 1)')} ELSE {_leaf_sql('n_chars')} END AS now,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos
      FROM documents
    ), tiers AS (
      SELECT lang, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM leaves GROUP BY lang
      UNION ALL
      SELECT lang, level + 1, list_transform(range(1, (len(nodes) + 3) // 2), lambda i: sha256(nodes[2 * i - 1] || coalesce(nodes[2 * i], ''))) FROM tiers WHERE len(nodes) > 1
    ), tops AS (SELECT lang, nodes[1] AS subroot, level AS height, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos FROM tiers WHERE len(nodes) = 1),
    upper AS (
      SELECT 0 AS level, (SELECT list(subroot ORDER BY pos) FROM tops) AS nodes
      UNION ALL
      SELECT level + 1, list_transform(range(1, (len(nodes) + 3) // 2), lambda i: sha256(nodes[2 * i - 1] || coalesce(nodes[2 * i], ''))) FROM upper WHERE len(nodes) > 1
    ), stacked AS (
      SELECT t.lang, t.level, t.nodes, NULL::BIGINT AS pos FROM tiers t WHERE len(t.nodes) > 1
      UNION ALL SELECT o.lang, o.height + u.level, u.nodes, o.pos >> u.level FROM tops o, upper u WHERE len(u.nodes) > 1
    ), climb AS (
      SELECT doc_id, lang, pos, 0 AS step, now AS digest, '' AS siblings FROM leaves
      UNION ALL
      SELECT c.doc_id, c.lang, c.pos, c.step + 1,
        sha256(CASE WHEN here % 2 = 0 THEN c.digest || coalesce(s.nodes[here + 2], '') ELSE s.nodes[here] || c.digest END),
        c.siblings || CASE WHEN here % 2 = 0 THEN coalesce(s.nodes[here + 2], '') ELSE s.nodes[here] END
      FROM climb c JOIN (SELECT * FROM stacked) s ON s.lang IS NOT DISTINCT FROM c.lang AND s.level = c.step, LATERAL (SELECT coalesce(s.pos, c.pos >> c.step) AS here)
    ), ends AS (SELECT doc_id, arg_max(digest, step) AS folded_root, arg_max(siblings, step) AS siblings FROM climb GROUP BY doc_id)
    SELECT l.doc_id, l.leaf, t.subroot, r.nodes[1] AS root, sha256(e.siblings) AS proof_sha256, e.folded_root, e.folded_root = r.nodes[1] AS verified
    FROM leaves l JOIN tops t ON t.lang IS NOT DISTINCT FROM l.lang JOIN ends e ON e.doc_id = l.doc_id JOIN upper r ON len(r.nodes) = 1
    """
)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    leaf, other = (merkle.digest_of(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text")) for n in (F.col("n_chars"), F.col("n_chars") + 1))
    leaves = docs.select("lang", "doc_id", leaf.alias("leaf"), F.when(tampered & F.col("n_chars").isNotNull(), other).alias("replaced"))
    found = merkle.manifest(leaves, group="lang", key="doc_id", digest="leaf", replaced="replaced")
    verified = (F.col("folded_root") == F.col("root")).alias("verified")
    return found.select(F.col("key").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", verified)
