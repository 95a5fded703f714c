"""One registered query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from veinstone.llm import (
    alignment, html, jaccard, merkle, mixing, neighbours, packing, quality, repeats, secrets, tokens, turns, urls)

#: Fixed values of the contract: verdict, host, path.
URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


def _table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_source_mix(spark, sf):
    mixed = mixing.mix_sources(_table(spark, sf, "documents"), weights=(3, 1, 2), share=1.5, most=2)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_secret_scan(spark, sf):
    found = secrets.scan_documents(_table(spark, sf, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op3_best_fit_packing(spark, sf):
    return packing.pack_documents(_table(spark, sf, "documents"), window=2048)


def op4_multi_index_hashing(spark, sf):
    return neighbours.nearest(_table(spark, sf, "embeddings"), k=5, every=50)


def op5_merkle_fingerprints(spark, sf):
    return merkle.fingerprint_documents(_table(spark, sf, "documents"))


def op6_jaccard_join(spark, sf):
    return jaccard.join_documents(_table(spark, sf, "documents"))


def op7_suffix_array_dedup(spark, sf):
    return repeats.remove_repeats(_table(spark, sf, "documents"))


def op8_url_filter(spark, sf):
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return urls.judge_urls(_table(spark, sf, "pages"), rules)


def op9_main_text(spark, sf):
    return html.extract(_table(spark, sf, "pages"))


def op10_cotrained_quality(spark, sf):
    return quality.score_documents(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op11_conversation_repair(spark, sf):
    damaged = turns.damage_turns(_table(spark, sf, "conversations"))
    return turns.summarize_repairs(turns.repair_conversations(damaged))


def op12_token_counts(spark, sf):
    return tokens.count_tokens(_table(spark, sf, "documents"), model="piece_bpe_32k.model", limit=4096)


def op13_tokenizer_alignment(spark, sf):
    scored = alignment.score_documents(_table(spark, sf, "documents"), "byte_bpe_50k.json", "piece_bpe_32k.model")
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


OP8_SQL = r"""
WITH rules(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
u AS (SELECT page_id, row_number() OVER () AS n,
  CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, n, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT n, arg_max(verdict, length(rhost || rpath)) AS verdict, arg_max(rhost || rpath, length(rhost || rpath)) AS rule
  FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (n)
"""

OP6_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3),
    lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
one AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y FROM one a JOIN one b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges AS MATERIALIZED (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(x, y) AS (SELECT doc_id, doc_id FROM sets UNION SELECT reach.x, edges.y FROM reach JOIN edges ON edges.x = reach.y)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least_id AS component_id
FROM sets JOIN (SELECT x, min(y) AS least_id FROM reach GROUP BY 1) ON x = doc_id
"""

OP7_SQL = r"""
WITH raw AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
windows AS (SELECT doc_id, unnest(range(1, octet_length(b) - 98)) AS i, b FROM raw WHERE octet_length(b) >= 100),
placed AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_slice(b, i, i + 99) ORDER BY doc_id, i) AS n FROM windows),
covered AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM placed WHERE n > 1),
marked AS (SELECT doc_id, i, sum((gap IS NULL OR gap > 100)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM covered),
runs AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS z FROM marked GROUP BY ALL),
kept AS (SELECT doc_id, lag(z, 1, 1) OVER w AS a, a AS z FROM runs WINDOW w AS (PARTITION BY doc_id ORDER BY a)
  UNION ALL SELECT doc_id, max(z), NULL FROM runs GROUP BY 1),
pieces AS (SELECT doc_id, string_agg(hex(array_slice(b, k.a, coalesce(k.z, octet_length(b) + 1) - 1)), '' ORDER BY k.a) AS h
  FROM kept k JOIN raw USING (doc_id) GROUP BY 1),
sums AS (SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY 1)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(coalesce(unhex(h), b)) AS kept_sha256
FROM raw LEFT JOIN sums USING (doc_id) LEFT JOIN pieces USING (doc_id)
"""

OP11_SQL = r"""
WITH RECURSIVE given AS (SELECT conv_id, coalesce(conv_id::VARCHAR, 'none') AS k, turn, coalesce(role, ' ') AS role,
    coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place FROM conversations),
kinds AS (SELECT *, xor(4294967295, list_reduce(list_transform(range(1, length(place) + 1),
    lambda i: ascii(substr(place, i, 1))::BIGINT), lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
    lambda x, y: xor(x >> 1, (x & 1) * 3988292384), xor(c, b)), 4294967295)) % 20 AS kind FROM given),
damaged AS (SELECT k, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds WHERE kind <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
judged AS MATERIALIZED (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
    substr(role, 1, 1) AS r, lag(substr(role, 1, 1)) OVER (PARTITION BY k ORDER BY i) AS before FROM numbered),
inserts(q, letters, paid, q1) AS (VALUES (0, '', 0, 0), (0, 'I', 3, 2), (0, 'II', 6, 3), (1, '', 0, 1), (1, 'I', 3, 2),
    (1, 'II', 6, 3), (2, '', 0, 2), (2, 'I', 3, 3), (3, '', 0, 3), (3, 'I', 3, 2)),
edits(q1, letter, role, paid, q2) AS (VALUES (0, 'D', NULL, 4, 0), (1, 'D', NULL, 4, 1), (2, 'D', NULL, 4, 2), (3, 'D', NULL, 4, 3),
    (0, 'K', 's', 0, 1), (0, 'K', 'u', 0, 2), (1, 'K', 'u', 0, 2), (2, 'K', 'a', 0, 3), (3, 'K', 'u', 0, 2),
    (0, 'R', NULL, 3, 2), (1, 'R', NULL, 3, 2), (2, 'R', NULL, 3, 3), (3, 'R', NULL, 3, 2)),
closing(q, letters, paid) AS (VALUES (0, '', 0), (1, 'II', 6), (2, 'I', 3), (3, '', 0)),
ways(k, i, q, label) AS (SELECT DISTINCT k, 0::BIGINT, 0, printf('%09d', 0) FROM given UNION ALL
  SELECT w.k, w.i + 1, e.q2, min(printf('%09d', substr(label, 1, 9)::INT + n.paid + e.paid
      + CASE WHEN fault = 'truncated' AND letter <> 'D' THEN 3 ELSE 0 END) || substr(label, 10) || letters || letter)
  FROM ways w JOIN judged j ON j.k = w.k AND j.i = w.i + 1 JOIN inserts n ON n.q = w.q
    JOIN edits e ON e.q1 = n.q1 AND (e.role IS NULL OR e.role = r) AND (letter = 'D' OR fault NOT IN ('blank', 'duplicate'))
  GROUP BY w.k, w.i, e.q2),
lengths AS (SELECT k, max(i) AS n FROM ways GROUP BY 1),
best AS (SELECT w.k, min(printf('%09d', substr(label, 1, 9)::INT + paid) || substr(label, 10) || letters) AS label
  FROM ways w JOIN lengths l ON l.k = w.k AND l.n = w.i JOIN closing c ON c.q = w.q GROUP BY 1),
letters AS (SELECT k, p, substr(label, p + 9, 1) AS letter FROM (SELECT k, label, unnest(range(1, length(label) - 8)) AS p FROM best)),
placed AS (SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY k ORDER BY p) AS i,
    count(*) FILTER (letter <> 'D') OVER (PARTITION BY k ORDER BY p) AS j,
    count(*) FILTER (letter <> 'D') OVER (PARTITION BY k) AS m FROM letters),
repaired AS (SELECT p.k, string_agg(CASE WHEN letter = 'K' THEN t.role WHEN (j + m) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN letter = 'I' THEN '' ELSE t.text END, chr(10) ORDER BY p) AS lines
  FROM placed p LEFT JOIN judged t ON t.k = p.k AND t.i = p.i WHERE letter <> 'D' GROUP BY 1),
counts AS (SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY 1)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, substr(label, 1, 9)::BIGINT AS cost,
  substr(label, 10) AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, k FROM given) JOIN best USING (k) LEFT JOIN counts USING (k) LEFT JOIN repaired USING (k)
"""

QUERIES = {f.__name__: f for f in (
    op1_source_mix, op2_secret_scan, op3_best_fit_packing, op4_multi_index_hashing, op5_merkle_fingerprints,
    op6_jaccard_join, op7_suffix_array_dedup, op8_url_filter, op9_main_text, op10_cotrained_quality,
    op11_conversation_repair, op12_token_counts, op13_tokenizer_alignment)}
SQL = {"op6_jaccard_join": OP6_SQL, "op7_suffix_array_dedup": OP7_SQL, "op8_url_filter": OP8_SQL,
       "op11_conversation_repair": OP11_SQL}
