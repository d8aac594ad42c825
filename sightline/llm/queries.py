"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from sightline.llm.decontaminate import op1_benchmark_decontamination
from sightline.llm.importance import op13_importance_resampling
from sightline.llm.jaccard import op6_ngram_jaccard_join
from sightline.llm.language import op8_language_id
from sightline.llm.language_model import op2_class_language_model
from sightline.llm.licenses import op10_license_scan
from sightline.llm.media import op5_media_columns
from sightline.llm.packing import op3_best_fit_packing
from sightline.llm.prefix_trie import op12_prefix_trie
from sightline.llm.records import op9_binary_records
from sightline.llm.substring import op4_substring_dedup
from sightline.llm.toxicity import op7_toxicity
from sightline.llm.warc import op11_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination,
        op2_class_language_model,
        op3_best_fit_packing,
        op4_substring_dedup,
        op5_media_columns,
        op6_ngram_jaccard_join,
        op7_toxicity,
        op8_language_id,
        op9_binary_records,
        op10_license_scan,
        op11_warc,
        op12_prefix_trie,
        op13_importance_resampling,
    )
}

#: crc32 of a text in SQL: the table of bytes as column `crc_table` of `crc_bytes`, and its use on an expression.
_CRC_BYTES = """crc_bytes AS (SELECT list(t ORDER BY i) AS crc_table FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t FROM range(256) AS r(i)))"""


def _crc(text: str) -> str:
    return f"xor(list_reduce(list_concat([4294967295], list_transform(range(octet_length(encode({text}))), lambda k: ('0x' || substr(hex(encode({text})), 2 * k + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, crc_table[1 + (xor(c, b) & 255)])), 4294967295)"


ORACLES: dict[str, str] = {
    "op4_substring_dedup": """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(words[i + 1 : i + 20], ' ') AS seq
  FROM (SELECT doc_id, words, unnest(range(0, greatest(0, len(words) - 19))) AS i FROM w)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY seq ORDER BY doc_id, i) AS r FROM windows) WHERE r > 1
), gone AS (
  SELECT DISTINCT doc_id, i + k AS p FROM again, range(0, 20) AS t(k)
), placed AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS p FROM w
), kept AS (
  SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.p) AS text, count(*) AS n FROM placed p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.p = g.p GROUP BY p.doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id""",
    "op6_ngram_jaccard_join": """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, CASE WHEN len(words) = 0 THEN 1 ELSE greatest(2, len(words) - 3) END)) AS i FROM w)
), n AS (
  SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY w.doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM pairs JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(reach.b) AS component_id FROM n JOIN reach ON n.doc_id = reach.a GROUP BY n.doc_id, n.n""",
    "op11_warc": """
WITH d AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), m AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM m""",
    "op12_prefix_trie": f"""
WITH {_CRC_BYTES}, t AS (
  SELECT conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS turn_, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, own, {_crc("conv_id::VARCHAR")} % 9 AS h FROM (SELECT conv_id, list(turn_ ORDER BY i) AS own FROM t GROUP BY conv_id), crc_bytes
), r AS (
  SELECT c.conv_id, list_concat(coalesce(p.own[1 : c.h], []), c.own[c.h + 1 :]) AS seq FROM c LEFT JOIN c p ON p.conv_id = c.conv_id - c.conv_id % 5
), paths AS (
  SELECT conv_id, depth, seq[1 : depth] AS key, len(seq) AS n FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS depth FROM r)
), nodes AS (
  SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = n) AS ends FROM paths GROUP BY depth, key
), kids AS (
  SELECT depth - 1 AS depth, key[1 : depth - 1] AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2
), full_ AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children, CASE WHEN nodes.depth > 0 THEN (n_convs - 1) * octet_length(encode(nodes.key[nodes.depth].text)) ELSE 0 END AS saved FROM nodes LEFT JOIN kids ON nodes.depth = kids.depth AND nodes.key = kids.key
), rolled AS (
  SELECT d AS depth, key[1 : d] AS key, sum((n_children = 0)::INT) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM full_) GROUP BY 1, 2
)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM full_ f JOIN rolled ON f.depth = rolled.depth AND f.key = rolled.key LEFT JOIN nodes p ON p.depth = f.depth - 1 AND p.key = f.key[1 : f.depth - 1]""",
    "op13_importance_resampling": f"""
WITH {_CRC_BYTES}, w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words FROM documents
), b AS (
  SELECT list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words FROM benchmark
), dw AS (SELECT doc_id, unnest(words) AS word FROM w), bw AS (SELECT unnest(words) AS word FROM b
), hashed AS MATERIALIZED (
  SELECT word, {_crc("word")} % 10000 AS bucket FROM (SELECT word FROM dw UNION SELECT word FROM bw), crc_bytes
), s AS (SELECT bucket, count(*) AS n FROM dw JOIN hashed USING (word) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM bw JOIN hashed USING (word) GROUP BY bucket
), gain AS (
  SELECT r.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE / ((coalesce(s.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS g
  FROM range(10000) AS r(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)
), sums AS (SELECT doc_id, count(*) AS n_features, sum(g) AS total FROM dw JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT w.doc_id, coalesce(n_features, 0) AS n_features, coalesce(floor(total / n_features::DOUBLE), 0)::BIGINT AS weight, ('0x' || substr(sha256('2024:' || w.doc_id), 1, 8))::BIGINT AS h FROM w LEFT JOIN sums USING (doc_id)
), final AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM scored
), ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM final WHERE n_features >= 20)
SELECT f.doc_id, f.n_features, f.weight, f.score, CASE WHEN rank <= 10 * (SELECT count(*) FROM ranked) // 100 THEN rank END AS rank FROM final f LEFT JOIN ranked USING (doc_id)""",
}
