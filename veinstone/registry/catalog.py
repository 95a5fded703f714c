"""Catalog, scope, publication and queue queries over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from veinstone import fixed_values as fv
from veinstone.cluster import in_parts, shared_folder
from veinstone.functions import hashing, text as tx
from veinstone.operators import catalog, queue, scope, sync, usage
from veinstone.plans import kb, reindex as rebuild
from veinstone.registry import sql as q
from veinstone.registry.base import Group
from veinstone.streaming import outbox, worker

group = Group()
RECORDS, NOTES = q.with_views(q.RECORDS), q.with_views(q.NOTES)


def now():
    return F.lit(kb.NOW).cast("timestamp")


def record_rows(spark, sf):
    versions = catalog.mark_current(kb.record_versions(spark, sf))
    return kb.as_chunks(catalog.catalog_rows(kb.lines_by_version(spark, sf), versions, kb.record_documents(spark, sf)))


def note_catalog(spark, sf):
    return kb.note_files(spark, sf).drop("text")


@group.add(f"""{RECORDS} SELECT project_id, lifecycle_status, count(*) AS n_chunks,
  count(DISTINCT version_id) AS n_versions FROM rec_rows WHERE {q.ELIGIBLE} GROUP BY ALL""",
  "J1 J2 P2 P3 A1 A4")
def eligible_chunks(spark, sf):
    return record_rows(spark, sf).filter(scope.eligible()).groupBy("project_id", "lifecycle_status").agg(
        F.count("*").alias("n_chunks"), F.count_distinct("version_id").alias("n_versions"))


@group.add(f"""{RECORDS} SELECT chunk_id, version_id, document_id, project_id, filename,
  lifecycle_status, document_type, visibility, is_current,
  technical_status = 'searchable' AND NOT is_deleted AS is_searchable, heading_path, ordinal,
  content, content_hash, record_hash FROM rec_rows""", "P1 J1 J4 J11")
def source_projection(spark, sf):
    return record_rows(spark, sf).select(
        "chunk_id", "version_id", "document_id", "project_id", "filename", "lifecycle_status",
        "document_type", "visibility", "is_current", "is_searchable", "heading_path", "ordinal",
        "content", "content_hash", "record_hash")


@group.add(f"""{NOTES} SELECT document_id, project_id FROM notes n
  WHERE technical_status = 'searchable' AND NOT is_deleted
    AND ((lifecycle_status = 'approved' AND is_current) OR lifecycle_status = 'draft')
    AND (visibility = 'public' OR EXISTS (SELECT 1 FROM labels l
      WHERE l.doc_id = n.doc_id AND l.quality = 1
        AND CASE WHEN l.toxic = 1 THEN 'reviewers' ELSE 'staff' END IN ('staff')))""", "P3 P4 J6")
def acl_visible_documents(spark, sf):
    return scope.in_scope(note_catalog(spark, sf), ["approved", "draft"], None, ["staff"],
                          kb.note_acl(spark, sf)).select("document_id", "project_id")


@group.add(f"""{NOTES} SELECT lifecycle_status, count(*) AS n FROM notes
  WHERE lifecycle_status IN ('draft', 'deprecated') OR (lifecycle_status = 'approved' AND is_current)
  GROUP BY ALL""", "P2")
def status_clause(spark, sf):
    clause = scope.status_clause(["approved", "draft", "deprecated"])
    return note_catalog(spark, sf).filter(clause).groupBy("lifecycle_status").agg(
        F.count("*").alias("n"))


@group.add(f"""{RECORDS} SELECT document_id, max_by(version_id, (created_at, version_id)) AS version_id
  FROM rec_versions_raw WHERE lifecycle_status = 'approved' GROUP BY document_id""", "W2 A10 S2")
def current_version(spark, sf):
    return catalog.latest_approved(kb.record_versions(spark, sf))


@group.add(f"""{RECORDS} SELECT document_id, count(*) AS n_current FROM rec_versions
  WHERE is_current GROUP BY 1 HAVING count(*) > 1""", "partial unique index")
def current_violations(spark, sf):
    return catalog.current_violations(catalog.mark_current(kb.record_versions(spark, sf)))


@group.add("""WITH d AS (SELECT doc_id, source, sha256(text) AS logical_key FROM documents),
  r AS (SELECT *, row_number() OVER (PARTITION BY source, logical_key ORDER BY doc_id) AS rn FROM d)
  SELECT doc_id AS document_id, source AS project_id,
    CASE WHEN rn > 1 THEN logical_key || '#' || doc_id ELSE logical_key END AS logical_key FROM r""", "W1")
def logical_key_dedupe(spark, sf):
    documents = kb.table(spark, sf, "documents").select(
        F.col("doc_id").alias("document_id"), F.col("source").alias("project_id"),
        F.sha2("text", 256).alias("logical_key"), F.lit(0).alias("created_at"))
    return catalog.unique_logical_keys(documents).drop("created_at")


def embedding_links(spark, sf):
    """Order lines of returned goods have a vector of the current space."""
    lines = kb.record_chunks(spark, sf)
    space = F.when(F.col("content").rlike("status R/"), "current").otherwise("old")
    return lines.select("chunk_id", space.alias("embedding_fingerprint"))


@group.add(f"""{RECORDS} SELECT project_id, count(*) AS n_missing FROM rec_rows r
  WHERE {q.ELIGIBLE} AND NOT EXISTS (SELECT 1 FROM rec_chunks e
    WHERE e.chunk_id = r.chunk_id AND e.content LIKE '%status R/%') GROUP BY ALL""", "P12")
def missing_embeddings(spark, sf):
    return catalog.missing_embeddings(record_rows(spark, sf), embedding_links(spark, sf), "current"
                                      ).groupBy("project_id").agg(F.count("*").alias("n_missing"))


@group.add(f"""{RECORDS} SELECT p.chunk_id FROM rec_chunks p WHERE NOT EXISTS (
  SELECT 1 FROM rec_rows r WHERE r.chunk_id = p.chunk_id AND {q.ELIGIBLE})""", "J7 IO17")
def prune_ineligible(spark, sf):
    projection = kb.record_chunks(spark, sf).select("chunk_id", "record_hash")
    return sync.orphans(record_rows(spark, sf), projection).select("chunk_id")


@group.add(f"""{RECORDS} SELECT chunk_id, version_id, record_hash FROM rec_chunks
  WHERE version_id NOT IN (SELECT version_id FROM rec_versions WHERE lifecycle_status = 'deprecated')""",
  "J9 C9")
def delete_versions(spark, sf):
    gone = kb.record_versions(spark, sf).filter("lifecycle_status = 'deprecated'").select("version_id")
    kept = kb.as_chunks(sync.delete_versions(kb.record_lines(spark, sf), gone))
    return kept.select("version_id", "chunk_id", "record_hash")


@group.add(f"""{RECORDS}, incoming AS (SELECT chunk_id, version_id, sha256(record_hash) AS record_hash
    FROM rec_chunks WHERE version_id IN (SELECT version_id FROM rec_versions
      WHERE lifecycle_status = 'draft') AND ordinal > 1)
  SELECT chunk_id, version_id, record_hash FROM incoming UNION ALL
  SELECT chunk_id, version_id, record_hash FROM rec_chunks
  WHERE version_id NOT IN (SELECT version_id FROM incoming)""", "IO17 J8 T6")
def projection_upsert(spark, sf):
    lines = kb.record_lines(spark, sf)
    drafts = kb.record_versions(spark, sf).filter("lifecycle_status = 'draft'").select("version_id")
    incoming = lines.join(drafts, "version_id", "left_semi").filter("ordinal > 1").withColumn("_incoming", F.lit(True))
    # rows are replaced by version, so the lines are merged before they get their ids and hashes
    merged = kb.as_chunks(sync.upsert(lines.withColumn("_incoming", F.lit(False)), incoming))
    changed = F.when(F.col("_incoming"), F.sha2("record_hash", 256)).otherwise(F.col("record_hash"))
    return merged.select("version_id", "chunk_id", changed.alias("record_hash"))


@group.add(f"""{RECORDS} SELECT version_id, count(*) AS n_chunks, sha256(string_agg(
    ordinal || ':' || chunk_id || ':' || record_hash || chr(10), '' ORDER BY ordinal, chunk_id))
    AS manifest_hash FROM rec_chunks GROUP BY 1""", "A9")
def version_manifest(spark, sf):
    return sync.version_manifest(kb.record_chunks(spark, sf))


def drifted_projection(spark, sf):
    """A projection whose returned lines are stale, open lines missing, fifth lines moved, and where
    each N/F line has left an extra chunk."""
    chunks = kb.as_chunks(kb.lines_by_version(spark, sf))
    stale = F.when(F.col("content").rlike("status R/"), F.sha2("record_hash", 256))
    moved = F.when(F.col("ordinal") == 5, F.lit(50)).otherwise(F.col("ordinal"))
    stored = chunks.filter(~F.col("content").rlike("status A/O")).select(
        "version_id", "chunk_id", moved.alias("ordinal"), F.coalesce(stale, F.col("record_hash")).alias("record_hash"))
    extra = chunks.filter(F.col("content").rlike("status N/F")).select(
        "version_id", F.concat("chunk_id", F.lit("+")).alias("chunk_id"), "ordinal", "record_hash")
    return stored.unionByName(extra)


@group.add(f"""{RECORDS}, p AS (SELECT version_id, chunk_id, CASE WHEN ordinal = 5 THEN 50 ELSE ordinal END AS place,
      CASE WHEN content LIKE '%status R/%' THEN sha256(record_hash) ELSE record_hash END AS stored
    FROM rec_chunks WHERE content NOT LIKE '%status A/O%'
    UNION ALL SELECT version_id, chunk_id || '+', ordinal, record_hash FROM rec_chunks WHERE content LIKE '%status N/F%'),
  mine AS (SELECT version_id, chunk_id, ordinal, record_hash FROM rec_rows WHERE {q.ELIGIBLE}),
  both_sides AS (SELECT version_id, place, ordinal, stored, record_hash
    FROM mine FULL JOIN (SELECT * FROM p WHERE version_id IN (SELECT version_id FROM mine)) USING (version_id, chunk_id))
  SELECT version_id, count(record_hash) AS expected_chunks, count(stored) AS indexed_chunks,
    bool_and(stored IS NOT DISTINCT FROM record_hash AND place IS NOT DISTINCT FROM ordinal) AS manifest_matches
  FROM both_sides GROUP BY 1 HAVING NOT manifest_matches""", "T9 J8")
def reconcile_differences(spark, sf):
    return sync.reconcile(record_rows(spark, sf), drifted_projection(spark, sf))


@group.add(f"""{RECORDS}, live AS (SELECT version_id FROM rec_versions WHERE technical_status = 'index_pending' AND version_id NOT IN (
      SELECT version_id FROM rec_chunks WHERE ordinal = 5 OR NOT (content LIKE '%status A/F%' OR content LIKE '%status N/O%'))),
  marked AS (SELECT v.*, l.version_id IS NOT NULL AS arrived FROM rec_versions v LEFT JOIN live l USING (version_id)),
  newest AS (SELECT document_id, max_by(version_id, (created_at, version_id)) AS w FROM marked
    WHERE lifecycle_status = 'approved' AND arrived GROUP BY 1),
  judged AS (SELECT *, w IS NOT NULL AND version_id <> w AND (is_current OR (lifecycle_status = 'approved' AND arrived)) AS loses
    FROM marked LEFT JOIN newest USING (document_id))
  SELECT version_id, document_id, CASE WHEN loses THEN 'deprecated' ELSE lifecycle_status END AS lifecycle_status,
    CASE WHEN loses THEN 'superseded' WHEN arrived THEN 'searchable' ELSE technical_status END AS technical_status,
    coalesce(version_id = w, FALSE) OR (is_current AND NOT loses AND NOT arrived) AS is_current FROM judged""", "T8 T7")
def publish_cutover(spark, sf):
    """Pending versions go live only if the projection, which has drifted, holds all their chunks."""
    versions = catalog.mark_current(kb.record_versions(spark, sf)).withColumns({
        "effective_to": F.lit(None).cast("timestamp"), "searchable_at": F.lit(None).cast("timestamp")})
    pending = versions.filter("technical_status = 'index_pending'").select("version_id")
    published = sync.verified(pending, kb.as_chunks(kb.lines_by_version(spark, sf)), drifted_projection(spark, sf))
    return sync.cut_over(versions, published, now()).select(
        "version_id", "document_id", "lifecycle_status", "technical_status", "is_current")


def lossy_projection(rows):
    """A projection writer that loses the lines of open returns."""
    return rows.filter(~F.col("content").rlike("status A/O")).select(*rebuild.PROJECTED)


@group.add(f"""{RECORDS} SELECT version_id, count(*) AS n_chunks, sha256(string_agg(
    ordinal || ':' || chunk_id || ':' || record_hash || chr(10), '' ORDER BY ordinal, chunk_id)) AS manifest_hash,
    bool_and(content NOT LIKE '%status A/O%') AS verified,
    CASE WHEN bool_and(content NOT LIKE '%status A/O%') THEN count(*) ELSE 0 END AS n_served
  FROM rec_chunks GROUP BY 1""", "T10 A9")
def reindex_verified(spark, sf):
    """A new generation of the projection: broken versions are left out of what is served."""
    folder = f"{shared_folder(spark)}/generations-{uuid.uuid4().hex}"
    judged = rebuild.reindex(kb.record_chunks(spark, sf), folder, 1, project=lossy_projection)
    served = rebuild.served(spark, folder).groupBy("version_id").agg(F.count("*").alias("n_served"))
    return judged.join(served, "version_id", "left").fillna(0, ["n_served"])


def file_requests(spark, sf):
    """Order lines ask for their customer's file as of the day they were shipped; the third lines for the
    newest file, and the fifth for the version they belong to."""
    lines, orders = kb.table(spark, sf, "lineitem"), kb.table(spark, sf, "orders")
    n = lines.count()
    rows = in_parts(lines.select("l_orderkey", "l_linenumber", "l_shipdate"), n, "l_orderkey").join(
        in_parts(orders.select("o_orderkey", "o_custkey"), n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    when = F.when(F.col("l_linenumber") != 3, F.col("l_shipdate").cast("timestamp"))
    return rows.select("l_orderkey", "l_linenumber", kb.code("CUS", F.col("o_custkey")).alias("document_id"), when.alias("as_of"),
                       F.when(F.col("l_linenumber") == 5, kb.code("ORD", F.col("l_orderkey"))).alias("version_id"))


@group.add(f"""{RECORDS}, asked AS (SELECT l_orderkey, l_linenumber, 'CUS-' || lpad(o_custkey::VARCHAR, 7, '0') AS document_id,
    CASE WHEN l_linenumber <> 3 THEN l_shipdate::TIMESTAMP ELSE TIMESTAMP '9999-12-31' END AS as_of FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  seen AS (SELECT document_id, created_at::TIMESTAMP AS created_at, max(version_id) AS version_id FROM rec_versions_raw GROUP BY ALL)
  SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 5 THEN 'ORD-' || lpad(l_orderkey::VARCHAR, 7, '0') ELSE version_id END AS found_version
  FROM asked ASOF LEFT JOIN seen ON asked.document_id = seen.document_id AND as_of >= created_at""", "C8")
def file_as_of(spark, sf):
    versions = kb.record_versions(spark, sf).withColumn("created_at", F.col("created_at").cast("timestamp"))
    return catalog.file_as_of(file_requests(spark, sf), versions).select("l_orderkey", "l_linenumber", "found_version")


@group.add(f"""{RECORDS}, {q.OUTBOX.strip()} SELECT * FROM
  (SELECT count(*) AS missing_embeddings FROM rec_rows WHERE {q.ELIGIBLE}
    AND content NOT LIKE '%status R/%'),
  (SELECT count(*) FILTER (WHERE status IN ('pending', 'processing')) AS pending_events,
    count(*) FILTER (WHERE status = 'dead') AS dead_events FROM queue),
  (SELECT count(*) FILTER (WHERE e <> i) AS sync_differences FROM (SELECT version_id, count(*) AS e,
    count(*) FILTER (WHERE content NOT LIKE '%status A/O%') AS i FROM rec_chunks GROUP BY 1))""",
  "C12 P13 A1")
def index_status(spark, sf):
    states = kb.record_chunks(spark, sf).groupBy("version_id").agg(
        F.lit("verified").alias("status"), F.count("*").alias("expected_chunks"),
        F.count_if(~F.col("content").rlike("status A/O")).alias("indexed_chunks"))
    return sync.index_status(record_rows(spark, sf), embedding_links(spark, sf),
                             kb.outbox(spark, sf), states, "current")


@group.add(f"""{RECORDS}, cited AS (SELECT chunk_id FROM rec_chunks WHERE content LIKE '%status R/F%')
  SELECT chunk_id FROM cited WHERE chunk_id NOT IN (SELECT chunk_id FROM rec_rows WHERE {q.ELIGIBLE})""",
  "P11 J10")
def stale_citations(spark, sf):
    cited = kb.record_chunks(spark, sf).filter(F.col("content").rlike("status R/F")).select("chunk_id")
    return catalog.live_citations(cited, record_rows(spark, sf))


@group.add(f"""{RECORDS} SELECT chunk_id, document_id, version_id, filename, content, heading_path,
  lifecycle_status FROM rec_rows WHERE NOT is_deleted""", "C7")
def source_lookup(spark, sf):
    return catalog.sources(record_rows(spark, sf)).select(
        "chunk_id", "document_id", "version_id", "filename", "content", "heading_path",
        "lifecycle_status")


@group.add(f"""{RECORDS} SELECT version_id, document_id, lifecycle_status, technical_status, created_at
  FROM rec_versions JOIN rec_documents USING (document_id) WHERE NOT is_deleted
  ORDER BY document_id, created_at DESC, version_id""", "C4")
def version_history(spark, sf):
    history = catalog.version_history(kb.record_versions(spark, sf), kb.record_documents(spark, sf))
    return history.select("version_id", "document_id", "lifecycle_status", "technical_status",
                          "created_at").orderBy("document_id", F.desc("created_at"), "version_id")


@group.add("SELECT DISTINCT n_name AS project_name FROM nation ORDER BY 1", "C1")
def list_projects(spark, sf):
    return kb.table(spark, sf, "nation").select(F.col("n_name").alias("project_name")).distinct(
    ).orderBy("project_name")


@group.add(f"""{NOTES} SELECT DISTINCT project_id AS project_name FROM notes WHERE project_id NOT IN
  (SELECT n_name FROM nation)""", "J15 SO4")
def unresolved_projects(spark, sf):
    wanted = note_catalog(spark, sf).select(F.col("project_id").alias("project_name"))
    known = kb.table(spark, sf, "nation").select(F.col("n_name").alias("project_name"))
    return catalog.resolve_projects(wanted, known)


def uploads(spark, sf):
    """Every note offered again, French ones with a changed text."""
    files = kb.note_files(spark, sf)
    text = F.when(F.col("lang") == "fr", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return files.select("project_id", F.lit(None).cast("string").alias("logical_key"),
                        F.concat(F.lit("inbox/"), F.col("filename")).alias("filename"),
                        F.sha2(text, 256).alias("sha256"))


@group.add(f"""{NOTES} SELECT filename, project_id,
    CASE WHEN lang = 'es' THEN 'new_document' WHEN lang = 'fr' THEN 'new_version'
      ELSE 'duplicate' END AS action,
    CASE WHEN lang = 'es' THEN FALSE ELSE is_deleted END AS restore,
    lang IN ('es', 'fr') OR n_chars < 1000 AS requeue
  FROM notes""", "C2 IO20 T12")
def register_uploads(spark, sf):
    files = kb.note_files(spark, sf).filter("lang <> 'es'")
    documents = files.select("project_id", F.col("filename").alias("logical_key"), "document_id",
                             "is_deleted")
    versions = files.select("document_id", F.sha2("text", 256).alias("sha256"), "version_id",
                            "technical_status")
    jobs = files.select("version_id", F.when(F.col("n_chars") < 1000, "failed").otherwise("succeeded")
                        .alias("status"), F.lit(kb.NOW).alias("created_at"))
    judged = catalog.register(uploads(spark, sf), documents, versions, jobs)
    return judged.select(F.regexp_extract("filename", r"([^/]*)$", 1).alias("filename"),
                         "project_id", "action", "restore", "requeue")


@group.add(f"""{RECORDS} SELECT version_id AS aggregate_id, 'index_version' AS event_type,
  'pending' AS status FROM rec_versions WHERE lifecycle_status = 'draft'
  AND technical_status = 'searchable'""", "C5")
def approve_versions(spark, sf):
    versions = kb.record_versions(spark, sf)
    return catalog.approve(versions, versions.filter("lifecycle_status = 'draft'").select("version_id"))[1]


@group.add(f"""{RECORDS} SELECT version_id, lifecycle, is_current, effective_to FROM (SELECT version_id,
  'deprecated' AS lifecycle, FALSE AS is_current, TIMESTAMP '{kb.NOW}' AS effective_to, created_at
  FROM rec_versions) WHERE created_at < TIMESTAMP '1996-01-01'""", "C6")
def deprecate_versions(spark, sf):
    versions = kb.record_versions(spark, sf)
    old = versions.filter("created_at < TIMESTAMP '1996-01-01'").select("version_id")
    changed, _ = catalog.deprecate(versions, old, now())
    return changed.select("version_id", F.col("lifecycle_status").alias("lifecycle"), "is_current",
                          "effective_to")


@group.add(f"""{RECORDS} SELECT version_id AS aggregate_id, 'delete_version' AS event_type,
  'pending' AS status FROM rec_versions JOIN rec_documents USING (document_id)
  WHERE visibility = 'restricted' AND NOT is_deleted""", "C9")
def soft_delete(spark, sf):
    documents = kb.record_documents(spark, sf)
    restricted = documents.filter("visibility = 'restricted'").select("document_id")
    return catalog.soft_delete(documents, kb.record_versions(spark, sf), restricted)[1]


@group.add("""WITH m AS (SELECT conv_id || ':' || turn AS message_id, role, length(text) AS n
    FROM conversations), f AS (SELECT message_id, CASE WHEN n < 200 THEN 'correct'
      WHEN n < 500 THEN 'missing_source' WHEN n < 800 THEN 'unsure' ELSE 'incorrect' END AS rating,
      role FROM m)
  SELECT message_id, rating FROM f WHERE role = 'assistant' AND rating <> 'unsure'""", "C11")
def accepted_feedback(spark, sf):
    n = F.length("text")
    messages = kb.table(spark, sf, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("message_id"), "role",
        F.when(n < 200, "correct").when(n < 500, "missing_source").when(n < 800, "unsure")
        .otherwise("incorrect").alias("rating"))
    return catalog.accept_feedback(messages.select("message_id", "rating"), messages,
                                   fv.FEEDBACK_RATINGS)


@group.add("""SELECT doc_id, substr(h, 1, 2) || '/' || substr(h, 3, 2) || '/' || h || '-'
    || regexp_replace(source || ' [' || lang || '].txt', '[^\\w.()\\- ]+', '_', 'g') AS path
  FROM (SELECT doc_id, source, lang, sha256(text) AS h FROM documents)""", "IO11 IO16 A1")
def storage_paths(spark, sf):
    return kb.table(spark, sf, "documents").select("doc_id", catalog.storage_path(
        F.sha2("text", 256), F.concat("source", F.lit(" ["), "lang", F.lit("].txt"))).alias("path"))


# ------------------------------------------------------------------- queues
@group.add(f"""{q.with_views(q.OUTBOX)} SELECT id, aggregate_id, 'processing' AS status,
    attempts + 1 AS attempts, TIMESTAMP '{kb.NOW}' + INTERVAL 5 MINUTE AS lease_until
  FROM queue WHERE status = 'pending' AND available_at <= TIMESTAMP '{kb.NOW}'
  ORDER BY created_at, id LIMIT 500""", "P14 T2 S5")
def claim_due_events(spark, sf):
    return queue.claim(kb.outbox(spark, sf), queue.due_events(now()), "processing", queue.EVENT_LEASE,
                       now(), 500).select("id", "aggregate_id", "status", "attempts", "lease_until")


@group.add(f"""{q.with_views(q.OUTBOX)}, jobs AS (SELECT id, created_at, attempts, lease_until,
    CASE status WHEN 'pending' THEN 'queued' WHEN 'processing' THEN 'running' ELSE status END AS status
    FROM queue)
  SELECT id, 'running' AS status, attempts + 1 AS attempts,
    TIMESTAMP '{kb.NOW}' + INTERVAL 15 MINUTE AS lease_until FROM jobs
  WHERE status = 'queued' OR (status = 'running' AND lease_until < TIMESTAMP '{kb.NOW}')
  ORDER BY created_at, id LIMIT 500""", "P15 T1 S5")
def claim_jobs(spark, sf):
    jobs = kb.outbox(spark, sf).withColumn("status", F.when(F.col("status") == "pending", "queued").when(
        F.col("status") == "processing", "running").otherwise(F.col("status")))
    return queue.claim(jobs, queue.claimable_jobs(now()), "running", queue.JOB_LEASE, now(), 500).select(
        "id", "status", "attempts", "lease_until")


@group.add(f"""{q.with_views(q.OUTBOX)} SELECT id, CASE WHEN lost THEN 'pending' ELSE status END AS status,
    CASE WHEN lost THEN NULL ELSE lease_until END AS lease_until
  FROM (SELECT *, status = 'processing' AND lease_until < TIMESTAMP '{kb.NOW}' AS lost FROM queue)""",
  "P16 T3")
def lease_expiry(spark, sf):
    return queue.recover(kb.outbox(spark, sf), now()).select("id", "status", "lease_until")


@group.add(f"""{q.with_views(q.OUTBOX)} SELECT id, attempts,
    CASE WHEN attempts >= 5 THEN 'dead' ELSE 'pending' END AS status,
    TIMESTAMP '{kb.NOW}' + to_seconds(least(300, 2 ** least(attempts, 8))::INT) AS available_at
  FROM queue WHERE status = 'processing'""", "T4")
def backoff_schedule(spark, sf):
    return queue.fail(kb.outbox(spark, sf).filter("status = 'processing'"), now()).select(
        "id", "attempts", "status", "available_at")


@group.add(f"""{q.with_views(q.OUTBOX)} SELECT id AS document_id, aggregate_id AS version_id,
    'queued' AS status, 0 AS attempts FROM queue WHERE status = 'dead'""", "C3")
def retry_jobs(spark, sf):
    jobs = kb.outbox(spark, sf).select(
        F.col("id").alias("document_id"), F.col("aggregate_id").alias("version_id"),
        F.when(F.col("status") == "dead", "failed").otherwise("running").alias("status"))
    return queue.retry_jobs(jobs)


@group.add(f"""{q.with_views(q.OUTBOX)} SELECT event_type, status, count(*) AS n,
  max(attempts) AS max_attempts FROM queue GROUP BY ALL""", "A4 A6")
def queue_counts(spark, sf):
    return kb.outbox(spark, sf).groupBy("event_type", "status").agg(
        F.count("*").alias("n"), F.max("attempts").alias("max_attempts"))


def as_job_events(events):
    """Events as facts about one job a user, in a hundredth of the time."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP '2024-01-01 00:00:00', ts) div 100")
    kind = F.when(F.col("event_type").isin("view", "click"), "claimed").when(F.col("event_type") == "error", "failed").when(
        F.col("event_type") == "purchase", "succeeded").otherwise("submitted")
    return events.select("event_id", F.col("user_id").alias("job_id"), kind.alias("kind"), F.timestamp_micros(micros).alias("at"))


@group.add("""WITH RECURSIVE e AS (SELECT user_id AS j, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i, t,
    CASE WHEN event_type IN ('view', 'click') THEN 'claimed' WHEN event_type = 'error' THEN 'failed'
      WHEN event_type = 'purchase' THEN 'succeeded' ELSE 'submitted' END AS kind
    FROM (SELECT *, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 100 AS t FROM events)),
  s(j, i, t, open, status, n, deadline, was, was_n, due, action, action_n) AS (
    SELECT DISTINCT j, 0::BIGINT, 0::BIGINT, FALSE, 'pending', 0, NULL::BIGINT, 'pending', 0, NULL::BIGINT, NULL::VARCHAR, 0 FROM e
    UNION ALL SELECT j, i, t,
      NOT (kind = 'succeeded' OR (kind = 'failed' AND n >= 5)),
      CASE WHEN kind = 'claimed' THEN 'processing' WHEN kind = 'submitted' THEN status ELSE 'pending' END,
      CASE WHEN kind = 'claimed' THEN n + 1 WHEN kind = 'succeeded' OR (kind = 'failed' AND n >= 5) THEN 0 ELSE n END,
      CASE WHEN kind = 'claimed' THEN t + 300000000 WHEN kind = 'failed' AND n < 5 THEN t + least(300, 2 ** least(n, 8))::BIGINT * 1000000
        WHEN kind = 'submitted' THEN deadline END,
      was, n, due,
      CASE WHEN kind = 'succeeded' THEN 'done' WHEN kind = 'failed' AND n >= 5 THEN 'dead' WHEN kind = 'submitted' AND NOT open THEN 'ready' END, n
    FROM (SELECT e.j, e.i, e.t, e.kind, s.open, s.n, s.status AS was, CASE WHEN s.deadline <= e.t THEN s.deadline END AS due,
        CASE WHEN s.deadline <= e.t THEN 'pending' ELSE s.status END AS status, CASE WHEN s.deadline > e.t THEN s.deadline END AS deadline
      FROM s JOIN e ON e.j = s.j AND e.i = s.i + 1)),
  ended AS (SELECT j, arg_max(status, i) AS was, arg_max(n, i) AS n, arg_max(deadline, i) FILTER (i = k) AS due FROM (
    SELECT *, max(i) OVER (PARTITION BY j) AS k FROM s) GROUP BY 1)
  SELECT j AS job_id, CASE WHEN was = 'processing' THEN 'lease_expired' ELSE 'ready' END AS action, was_n AS attempts, due AS at_us FROM s WHERE due IS NOT NULL
  UNION ALL SELECT j, action, action_n, t FROM s WHERE action IS NOT NULL
  UNION ALL SELECT j, CASE WHEN was = 'processing' THEN 'lease_expired' ELSE 'ready' END, n, due FROM ended
    WHERE due < (SELECT max(t) FROM e) - 600000000""", "T11 T3 T4")
def worker_loop(spark, sf):
    """What the worker loop does about the events, as a stateful stream with timers."""
    root = f"{shared_folder(spark)}/worker-{uuid.uuid4().hex}"
    schema = kb.table(spark, sf, "events").schema
    known = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", worker.STATE_STORE)
    try:
        actions = worker.worker_actions(as_job_events(outbox.read_events(spark, sf, schema, "events.parquet")))
        actions.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").trigger(
            availableNow=True).start(f"{root}/actions").awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", known)
    return spark.read.schema(worker.OUTPUT).parquet(f"{root}/actions")


# -------------------------------------------------------------------- usage
ROUTES = [("max-a", "max", 40_000, 1, True), ("max-b", "max", 30_000, 2, True), ("max-c", "max", 10_000, 3, False),
          ("plus-a", "plus", 60_000, 1, True), ("plus-b", "plus", 50_000, 2, True)]


@group.add("""WITH r AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN turn % 3 = 2 THEN 'max' ELSE 'plus' END AS tier,
    length(text) AS tokens FROM conversations),
  a1 AS (SELECT *, CASE tier WHEN 'max' THEN 'max-a' ELSE 'plus-a' END AS m, CASE tier WHEN 'max' THEN 36000 ELSE 54000 END AS room,
      id % 11 = 0 AS fails FROM r),
  t1 AS (SELECT *, coalesce(sum(CASE WHEN fails THEN 0 ELSE tokens END) OVER (PARTITION BY tier ORDER BY id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < room AS asked FROM a1),
  a2 AS (SELECT id, tier, tokens, 1 + asked::INT AS attempt, CASE tier WHEN 'max' THEN 'max-b' ELSE 'plus-b' END AS m,
      CASE tier WHEN 'max' THEN 27000 ELSE 45000 END AS room, FALSE AS fails FROM t1 WHERE NOT asked OR fails),
  t2 AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY tier ORDER BY id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < room AS asked FROM a2)
  SELECT id AS request_id, tier, 1 AS attempt, m AS model_id, CASE WHEN fails THEN 'failed' ELSE 'success' END AS result_status,
    CASE WHEN fails THEN 0 ELSE tokens END::BIGINT AS total_tokens FROM t1 WHERE asked
  UNION ALL SELECT id, tier, attempt, m, 'success', tokens::BIGINT FROM t2 WHERE asked
  UNION ALL SELECT id, tier, attempt, NULL, 'exhausted', 0 FROM t2 WHERE NOT asked""", "Z12 A2 A3")
def model_routing(spark, sf):
    """Turns of conversations as requests: served in order, by priority, until the quotas are met."""
    requests = kb.table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"),
        F.when(F.col("turn") % 3 == 2, "max").otherwise("plus").alias("tier"), F.length("text").cast("long").alias("tokens"))
    models = spark.createDataFrame(ROUTES, "model_id string, tier string, quota_tokens bigint, priority int, enabled boolean")
    nothing = spark.createDataFrame([], "model_id string, result_status string, total_tokens long")
    down = F.col("model_id").isin("max-a", "plus-a") & (F.col("request_id") % 11 == 0)
    return usage.allot_requests(requests, models, nothing, down)


MODELS = [("model-signup", "max", 400_000, 1, True), ("model-view", "plus", 9_000_000, 1, True),
          ("model-click", "plus", 450_000, 2, True), ("model-error", "plus", 0, 3, False),
          ("model-unused", "max", 1_000_000, 2, True)]


def registry(spark):
    return spark.createDataFrame(
        MODELS, "model_id string, tier string, quota_tokens bigint, priority int, enabled boolean")


@group.add(f"""{q.with_views(q.USAGE)}, models(model_id, tier, quota_tokens, priority, enabled) AS (VALUES
    ('model-signup', 'max', 400000, 1, TRUE), ('model-view', 'plus', 9000000, 1, TRUE),
    ('model-click', 'plus', 450000, 2, TRUE), ('model-error', 'plus', 0, 3, FALSE),
    ('model-unused', 'max', 1000000, 2, TRUE)),
  u AS (SELECT m.*, coalesce((SELECT sum(total_tokens) FROM usage s WHERE s.model_id = m.model_id
    AND result_status = 'success'), 0)::BIGINT AS used_tokens FROM models m)
  SELECT model_id, tier, quota_tokens::BIGINT AS quota_tokens, used_tokens,
    greatest(0, quota_tokens - used_tokens)::BIGINT AS remaining_tokens,
    round(CASE WHEN quota_tokens > 0 THEN used_tokens / quota_tokens ELSE 1.0 END::DOUBLE, 6) AS usage_ratio,
    enabled, used_tokens >= floor(quota_tokens * 0.8::DOUBLE) AS warning,
    enabled AND used_tokens < floor(quota_tokens * 0.9::DOUBLE) AS eligible FROM u""", "A2 A3 C13")
def model_usage(spark, sf):
    return usage.usage_rows(registry(spark), kb.model_usage(spark, sf)).select(
        "model_id", "tier", "quota_tokens", "used_tokens", "remaining_tokens",
        F.round("usage_ratio", 6).alias("usage_ratio"), "enabled", "warning", "eligible")


@group.add(f"""{q.with_views(q.USAGE)} SELECT model_id, count(*) AS n, round(avg(latency_ms), 3) AS mean,
  round(median(latency_ms), 3) AS p50,
  round(list_sort(list(latency_ms))[ceil(count(*) * 0.95::DOUBLE)::INT], 3) AS p95,
  round(max(latency_ms), 3) AS max FROM usage GROUP BY 1""", "A7")
def latency_stats(spark, sf):
    return usage.latency_stats(kb.model_usage(spark, sf), "model_id", "latency_ms")


@group.add("""WITH c AS (SELECT conv_id, count(DISTINCT role) AS n_documents,
      string_agg(text, chr(10) ORDER BY turn) AS question FROM conversations GROUP BY 1)
  SELECT conv_id, CASE WHEN n_documents >= 2 OR lower(question) LIKE '%compare%'
      OR lower(question) LIKE '%contrast%' OR lower(question) LIKE '%difference%'
      OR lower(question) LIKE '%summarize across%' THEN 'max' ELSE 'plus' END AS tier FROM c""", "Z3 A8")
def route_tier(spark, sf):
    turns = kb.table(spark, sf, "conversations").withColumn("folded", tx.casefold(F.col("text")))
    marked = turns.groupBy("conv_id").agg(
        F.count_distinct("role").alias("n_documents"),
        F.max(usage.route_tier(F.col("folded"), F.lit(1), F.lit(False)) == "max").alias("marked"))
    return marked.select("conv_id", usage.route_tier(
        F.lit(""), F.col("n_documents"), F.col("marked")).alias("tier"))


@group.add(f"""{RECORDS} SELECT document_id, count(DISTINCT version_id) > 1 AS conflict
  FROM rec_versions GROUP BY 1""", "A8")
def version_conflicts(spark, sf):
    return kb.record_versions(spark, sf).groupBy("document_id").agg(
        (F.count_distinct("version_id") > 1).alias("conflict"))


@group.add(f"""{RECORDS} SELECT version_id, ordinal, content_hash, chunk_id, record_hash
  FROM rec_chunks""", "content_hash record_hash chunk_id")
def chunk_identity(spark, sf):
    return kb.record_chunks(spark, sf).select("version_id", "ordinal", "content_hash", "chunk_id",
                                              "record_hash")
