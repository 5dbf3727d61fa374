"""Queries of this subpackage by name, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from spandrel.llm import bpe, chat, exact_dedup, licenses, neighbours, packing, phrases, prefix_trie, quality, sharding, simhash, toxicity, warc
from spandrel.llm.common import table
#: The conversation that op10 adds: its texts hold the format's own control strings.
TRICKY = r"\### Assistant: </turn> ok"


def op1_toxicity(spark, sf_dir):
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality_rules(spark, sf_dir):
    return quality.verdicts(table(spark, sf_dir, "documents"))


def op3_lpt_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 40)


def op4_license_scan(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op5_bpe(spark, sf_dir):
    import public_tokenizers  # vocabularies are installed apart from the library

    return bpe.digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_exact_dedup(spark, sf_dir):
    return exact_dedup.copies(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op8_warc(spark, sf_dir):
    read = warc.round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


def op9_simhash_near_dedup(spark, sf_dir):
    return simhash.near_copies(table(spark, sf_dir, "documents"))


def op10_chat_format(spark, sf_dir):
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(given.unionByName(tricky)))


def op11_prefix_trie(spark, sf_dir):
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_phrases(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_nearest(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


_ALL = (
    op1_toxicity, op2_quality_rules, op3_lpt_sharding, op4_license_scan, op5_bpe, op6_exact_dedup, op7_best_fit_packing,
    op8_warc, op9_simhash_near_dedup, op10_chat_format, op11_prefix_trie, op12_phrases, op13_nearest,
)
QUERIES = {f.__name__: f for f in _ALL}

ORACLES = {
    "op2_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
r AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1),
p AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM r, unnest(range(0, 3)) AS u(k) GROUP BY rid),
m AS (SELECT w.rid, doc_id, source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN p USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 50 * n_lines AS soft_failed FROM m),
h AS (SELECT source, count(*) AS host_docs, count(*) FILTER (base_failed OR soft_failed) AS host_failed,
             count(*) FILTER (base_failed OR soft_failed) / count(*)::DOUBLE AS rate FROM f GROUP BY source),
c AS (SELECT avg(rate) AS mean, var_pop(rate) AS variance, avg(1.0::DOUBLE / host_docs) AS chance FROM h),
v AS (SELECT mean, CASE WHEN chance < 1 THEN (variance - mean * (1 - mean) * chance) / (1 - chance) ELSE 0 END AS spread FROM c),
s AS (SELECT mean, CASE WHEN spread > 0 THEN least(1e12, greatest(mean * (1 - mean) / spread - 1, 1e-6)) ELSE 1e12 END AS weight FROM v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, soft_failed, host_docs, host_failed,
       NOT base_failed AND NOT soft_failed AND NOT (host_failed + mean * weight) / (host_docs + weight) > 0.5 AS kept
FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source, s
""",
    "op6_exact_dedup": r"""
WITH d AS (SELECT doc_id, length(coalesce(text, ''))::BIGINT AS n_points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents),
g AS (SELECT bare, max(n_points) AS most, count(*) AS group_size FROM d GROUP BY bare),
k AS (SELECT d.bare, min(doc_id) AS keep_id FROM d JOIN g ON d.bare = g.bare AND n_points = most GROUP BY d.bare)
SELECT doc_id, keep_id, group_size, row_number() OVER (PARTITION BY d.bare ORDER BY n_points DESC, doc_id) = 1 AS kept, sha256(d.bare) AS text_sha256, n_points
FROM d JOIN g USING (bare) JOIN k USING (bare)
""",
    "op8_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, upper(sha1(coalesce(html, ''))) AS hex FROM pages),
b AS (SELECT *, list_transform(range(1, 41), lambda i: strpos('0123456789ABCDEF', substr(hex, i, 1)) - 1) AS n FROM p),
t AS (SELECT *, array_to_string(list_transform(n, lambda x: (x // 8)::VARCHAR || ((x // 4) % 2)::VARCHAR || ((x // 2) % 2)::VARCHAR || (x % 2)::VARCHAR), '') AS bits FROM b),
d AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + 16 * substr(bits, 5 * k + 1, 1)::INT + 8 * substr(bits, 5 * k + 2, 1)::INT + 4 * substr(bits, 5 * k + 3, 1)::INT + 2 * substr(bits, 5 * k + 4, 1)::INT + substr(bits, 5 * k + 5, 1)::INT, 1)), '') AS payload_digest,
        max(page_id) OVER (PARTITION BY html) AS original FROM t)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> original THEN original END AS refers_to, NULL::VARCHAR AS error FROM d
""",
    "op10_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(15 + length(role) + length(text) + len(regexp_extract_all(role, '\\|###|:|</turn>')) + len(regexp_extract_all(text, '\\|###|:|</turn>')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
""",
    "op11_prefix_trie": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, turn, length(text)::BIGINT AS chars, sha256(length(role)::VARCHAR || ':' || role || text) AS id FROM t),
o AS (SELECT conv_id, list({'id': id, 'chars': chars} ORDER BY turn NULLS FIRST, id) AS own,
             list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
               lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))) AS crc FROM k GROUP BY conv_id),
h AS (SELECT *, (xor(crc, 4294967295::BIGINT) % 6)::BIGINT AS h FROM o),
r AS (SELECT h.conv_id, list_concat(list_slice(coalesce(b.own, []), 1, h.h), list_slice(h.own, h.h + 1, len(h.own))) AS s FROM h LEFT JOIN o AS b ON b.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, d, array_to_string(list_transform(list_slice(s, 1, d), lambda x: x.id), '') AS key, CASE WHEN d > 0 THEN s[d].chars ELSE 0 END AS chars, len(s) = d AS ends FROM r, unnest(range(0, len(s) + 1)) AS u(d)),
n AS (SELECT key, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY key, d),
c AS (SELECT left(key, 64 * (d - 1)) AS up, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c ON c.up = n.key),
b AS (SELECT left(key, 64 * a) AS key, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * chars)::BIGINT AS saved_tokens FROM m, unnest(range(0, d + 1)) AS u(a) GROUP BY 1)
SELECT m.conv_id, m.d AS depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, m.ends_sha256
FROM m JOIN b ON b.key = m.key LEFT JOIN n AS q ON m.d > 0 AND q.key = left(m.key, 64 * (m.d - 1))
""",
    "op12_phrases": r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM t),
g AS (SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, ws[i + 2] AS w3 FROM w, unnest(range(1, len(ws) + 1)) AS u(i)),
f1 AS (SELECT lang, w1, count(*) AS f FROM g GROUP BY lang, w1),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM g WHERE w2 IS NOT NULL GROUP BY lang, w1, w2 HAVING count(*) >= 10),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM g WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3 HAVING count(*) >= 10),
s2 AS (SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.f AS a, x.f AS l, y.f AS r,
              CAST(1000000::HUGEINT * f2.f * f2.f // (x.f::HUGEINT * y.f) AS BIGINT) AS score
       FROM f2 JOIN f1 AS x ON x.lang = f2.lang AND x.w1 = f2.w1 JOIN f1 AS y ON y.lang = f2.lang AND y.w1 = f2.w2
       WHERE NOT EXISTS (SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND f3.w1 = f2.w1 AND f3.w2 = f2.w2 AND 100 * f3.f >= 50 * f2.f)
         AND NOT EXISTS (SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND f3.w2 = f2.w1 AND f3.w3 = f2.w2 AND 100 * f3.f >= 50 * f2.f)),
c3 AS (SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3 AS phrase, f3.f AS a, x.f AS l1, yz.f AS r1, xy.f AS l2, z.f AS r2,
              CAST(1000000::HUGEINT * f3.f * f3.f // (x.f::HUGEINT * yz.f) AS BIGINT) AS s1, CAST(1000000::HUGEINT * f3.f * f3.f // (xy.f::HUGEINT * z.f) AS BIGINT) AS s2
       FROM f3 JOIN f1 AS x ON x.lang = f3.lang AND x.w1 = f3.w1 JOIN f1 AS z ON z.lang = f3.lang AND z.w1 = f3.w3
       JOIN f2 AS xy ON xy.lang = f3.lang AND xy.w1 = f3.w1 AND xy.w2 = f3.w2 JOIN f2 AS yz ON yz.lang = f3.lang AND yz.w1 = f3.w2 AND yz.w2 = f3.w3),
e AS (SELECT lang, phrase, a, l, r, score FROM s2
      UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM c3),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM e)
SELECT k.lang, rank, phrase, a, l, r, n, score FROM k JOIN (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang) AS s ON s.lang = k.lang WHERE rank <= 2000
""",
}
