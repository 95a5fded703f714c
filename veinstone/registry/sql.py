"""SQL of the knowledge-base views and text functions, for the checking engine.

Written independently of the Spark expressions, so that equal results mean
something.
"""

NOTES = """
notes AS (
  SELECT doc_id, lang, text, n_chars,
    'note-' || lpad(doc_id::VARCHAR, 8, '0') AS document_id, source AS project_id,
    'note-' || lpad(doc_id::VARCHAR, 8, '0') || '.txt' AS filename,
    CASE lang WHEN 'en' THEN 'requirement' WHEN 'fr' THEN 'mapping' WHEN 'de' THEN 'policy'
      ELSE 'change-notice' END AS document_type,
    CASE WHEN lang = 'de' THEN 'restricted' ELSE 'public' END AS visibility,
    n_chars < 60 AS is_deleted,
    'note-' || lpad(doc_id::VARCHAR, 8, '0') || '@1' AS version_id,
    CASE WHEN n_chars < 400 THEN 'draft' WHEN n_chars > 12000 THEN 'deprecated'
      ELSE 'approved' END AS lifecycle_status,
    CASE WHEN n_chars BETWEEN 11000 AND 12000 THEN 'index_pending' ELSE 'searchable' END
      AS technical_status,
    n_chars BETWEEN 400 AND 12000 AS is_current
  FROM documents),
note_lines AS (
  SELECT notes.* EXCLUDE (text), u.ordinal - 1 AS ordinal, u.content,
    version_id || ':' || lpad((u.ordinal - 1)::VARCHAR, 5, '0') AS chunk_id,
    project_id || ' > ' || lang AS heading_path
  FROM notes, LATERAL (
    SELECT unnest(string_split(text, chr(10))) AS content,
           unnest(range(1, len(string_split(text, chr(10))) + 1)) AS ordinal) u
  WHERE trim(u.content) <> '')"""

RECORDS = """
rec_documents AS (
  SELECT 'CUS-' || lpad(c_custkey::VARCHAR, 7, '0') AS document_id, n_name AS project_id,
    'CUS-' || lpad(c_custkey::VARCHAR, 7, '0') || '-' || lower(c_mktsegment) || '.md' AS filename,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'business-requirement' WHEN 'AUTOMOBILE' THEN 'mapping'
      ELSE 'parameter-matrix' END AS document_type,
    CASE WHEN c_acctbal < 0 THEN 'restricted' ELSE 'public' END AS visibility,
    c_acctbal >= 9500 AS is_deleted
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
rec_versions_raw AS (
  SELECT 'ORD-' || lpad(o_orderkey::VARCHAR, 7, '0') AS version_id,
    'CUS-' || lpad(o_custkey::VARCHAR, 7, '0') AS document_id,
    CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'draft' ELSE 'deprecated' END
      AS lifecycle_status,
    CASE WHEN o_orderpriority = '5-LOW' THEN 'index_pending' ELSE 'searchable' END AS technical_status,
    o_orderdate AS created_at
  FROM orders),
rec_versions AS (
  SELECT *, lifecycle_status = 'approved' AND row_number() OVER (
      PARTITION BY document_id ORDER BY (lifecycle_status = 'approved')::INT DESC,
      created_at DESC, version_id DESC) = 1 AS is_current
  FROM rec_versions_raw),
rec_content AS (
  SELECT 'ORD-' || lpad(l_orderkey::VARCHAR, 7, '0') AS version_id, l_linenumber AS ordinal,
    'Order lines' AS heading_path,
    'ORD-' || lpad(l_orderkey::VARCHAR, 7, '0') || ' line ' || l_linenumber || ' ships part PRT-'
    || lpad(l_partkey::VARCHAR, 7, '0') || ' from supplier SUP-' || lpad(l_suppkey::VARCHAR, 7, '0')
    || ' quantity ' || l_quantity::INT || ' price ' || round(l_extendedprice * 100)::BIGINT
    || ' on ' || strftime(l_shipdate, '%Y-%m-%d') || ' status ' || l_returnflag || '/' || l_linestatus
    AS content
  FROM lineitem),
rec_hashed AS (
  SELECT *, sha256(content) AS content_hash,
    sha256('{"cell_range":null,"content":"' || content || '","heading_path":"' || heading_path
      || '","page_number":null,"sheet_name":null}') AS record_hash
  FROM rec_content),
rec_chunks AS (
  SELECT *, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-'
      || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1)
      || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS chunk_id
  FROM (SELECT *, sha1(unhex('73ac24df296f45329dc8e5890e877564')
          || encode(version_id || ':' || ordinal || ':' || content_hash)) AS h FROM rec_hashed)),
rec_rows AS (
  SELECT rec_chunks.* EXCLUDE (h), document_id, lifecycle_status, technical_status, created_at,
    is_current, project_id, filename, document_type, visibility, is_deleted
  FROM rec_chunks JOIN rec_versions USING (version_id) JOIN rec_documents USING (document_id))"""

ELIGIBLE = """(technical_status = 'searchable' AND NOT is_deleted
  AND (lifecycle_status = 'draft' OR (lifecycle_status = 'approved' AND is_current)))"""
APPROVED_PUBLIC = """(technical_status = 'searchable' AND NOT is_deleted
  AND lifecycle_status = 'approved' AND is_current AND visibility = 'public')"""

OUTBOX = """
queue AS (
  SELECT event_id AS id, user_id AS aggregate_id,
    CASE event_type WHEN 'view' THEN 'published' WHEN 'error' THEN 'dead'
      WHEN 'click' THEN 'processing' ELSE 'pending' END AS status,
    CASE WHEN k < 80 THEN 'index_version' ELSE 'delete_version' END AS event_type,
    k // 15 AS attempts, ts AS created_at, ts + to_minutes(k) AS available_at,
    CASE WHEN event_type = 'click' THEN ts + to_days(k // 10) END AS lease_until
  FROM (SELECT *, (props::JSON ->> 'k')::INT AS k FROM events))"""

USAGE = """
usage AS (
  SELECT 'model-' || event_type AS model_id,
    CASE WHEN (props::JSON ->> 'k')::INT < 10 THEN 'failed' ELSE 'success' END AS result_status,
    round(value * 100)::BIGINT AS total_tokens, value AS latency_ms
  FROM events)"""


def fold(column: str) -> str:
    return f"replace(lower({column}), 'ß', 'ss')"


def normalize(column: str) -> str:
    return f"trim(regexp_replace({fold(column)}, '\\s+', ' ', 'g'))"


def tokens(normalized: str) -> str:
    """Distinct ASCII tokens (the tables hold no CJK text), first-seen order."""
    found = f"regexp_extract_all({normalized}, '[a-z0-9][a-z0-9_.:/-]*')"
    return f"list_transform(list_sort(list_transform(list_distinct({found}), lambda t: " \
           f"[lpad(list_position({found}, t)::VARCHAR, 6, '0'), t])), lambda p: p[2])"


def estimate(column: str) -> str:
    words = f"regexp_extract_all({column}, '[A-Za-z0-9_./:+#-]+')"
    return (f"greatest(1, floor(len({words}) * 1.3::DOUBLE)::INT + "
            f"(length(regexp_replace({column}, '[A-Za-z0-9_./:+#-]+', '', 'g')) // 4))")


def strip(column: str) -> str:
    return f"regexp_replace({column}, '^\\s+|\\s+$', '', 'g')"


def name_uuid(name: str) -> str:
    """Version-5 UUID of a name in the space of chunks."""
    h = f"sha1(unhex('73ac24df296f45329dc8e5890e877564') || encode({name}))"
    return (f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || "
            f"substr('89ab', (strpos('0123456789abcdef', substr({h}, 17, 1)) - 1) % 4 + 1, 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)")


def trigrams(normalized: str) -> str:
    return (f"list_distinct(flatten(list_transform(regexp_extract_all({normalized}, "
            "'[\\p{L}\\p{N}]+'), lambda w: list_transform(range(1, len(w) + 2), "
            "lambda i: substr('  ' || w || ' ', i, 3)))))")


def with_views(*views: str) -> str:
    return "WITH " + ",".join(views)
