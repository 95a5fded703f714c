"""Answer contract, evaluation, ingestion and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from veinstone.cluster import cut_lineage, shared_folder, spread
from veinstone.config import EngineConfig
from veinstone.functions import questions as qs
from veinstone.functions.quotes import repaired_quote
from veinstone.operators import answers, chunking, embedding, evaluation, queue
from veinstone.plans import kb
from veinstone.registry import sql as q
from veinstone.registry.base import Group
from veinstone.registry.catalog import record_rows
from veinstone.registry.retrieval import SUPPLIERS, slim, supplier_fused, supplier_rows, whole
from veinstone.sources import files
from veinstone.streaming import outbox

group = Group()
CONFIG = EngineConfig(embedding_dimensions=256)
NOTES, RECORDS = q.with_views(q.NOTES), q.with_views(q.RECORDS)


def supplier_evidence(spark, sf):
    """The eight best rows per supplier with all provenance columns."""
    rows = supplier_fused(supplier_rows(spark, sf)).filter("rank <= 8")
    none = F.lit(None)
    return rows.withColumns({"page_number": none.cast("int"), "sheet_name": none.cast("string"),
                             "cell_range": none.cast("string"), "version_label": F.col("version_id")})


def supplier_questions(spark, sf, evidence):
    """What each supplier's best row says; suppliers in debt are asked the unknown."""
    best = evidence.filter("rank = 1").select(
        "query_id", "part", F.col("price").cast("string").alias("price"), F.col("filename").alias("file"))
    suppliers = kb.table(spark, sf, "supplier").select(
        kb.code("SUP", F.col("s_suppkey")).alias("query_id"), (F.col("s_acctbal") < 0).alias("unknown"))
    none = F.array().cast("array<string>")
    return suppliers.join(best, "query_id").select(
        "query_id", F.concat(F.lit("Which part ships from "), "query_id", F.lit(" at which price?")).alias("question"),
        F.when(F.col("unknown"), "insufficient_evidence").otherwise("answered").alias("expected_status"),
        F.when(F.col("unknown"), none).otherwise(F.array("file")).alias("expected_files"),
        F.when(F.col("unknown"), none).otherwise(F.array("part", "price")).alias("facts"))


EVIDENCE = f"""{SUPPLIERS}, ev AS (SELECT * FROM frow WHERE rank <= 8),
  best AS (SELECT query_id, part AS bpart, price AS bprice, filename AS bfile, content AS bcontent,
      chunk_id AS bchunk FROM ev WHERE rank = 1),
  ask AS (SELECT 'SUP-' || lpad(s_suppkey::VARCHAR, 7, '0') AS query_id, s_acctbal < 0 AS unknown FROM supplier)"""


# ------------------------------------------------------------------ answers
@group.add(EVIDENCE + """, docs AS (SELECT query_id, count(DISTINCT document_id) AS nd FROM ev WHERE rank <= 6 GROUP BY 1)
  SELECT query_id, CASE WHEN unknown THEN 'insufficient_evidence' ELSE 'answered' END AS status,
    CASE WHEN unknown THEN 'The knowledge base does not contain sufficient evidence for a conclusion.'
      ELSE bpart || chr(10) || bprice END AS answer,
    CASE WHEN nd >= 2 THEN 'max' ELSE 'plus' END AS tier,
    CASE WHEN unknown THEN NULL ELSE bchunk || '|' || bcontent END AS source
  FROM ask JOIN best USING (query_id) JOIN docs USING (query_id)""", "Z4 Z11 Z9 E12 Z3")
def answer_pipeline(spark, sf):
    evidence = whole(cut_lineage(slim(supplier_evidence(spark, sf))))
    asked = cut_lineage(supplier_questions(spark, sf, evidence))
    model = answers.offline_model(asked.select("query_id", "expected_files", "facts"), evidence)
    responses = answers.respond(asked.select("query_id", "question"), evidence, model,
                                record_rows(spark, sf), CONFIG)
    return responses.select("query_id", "status", "answer", "tier", F.array_join(F.transform(
        "sources", lambda s: F.concat_ws("|", s["chunk_id"], s["quote"])), ";").alias("source"))


@group.add(EVIDENCE + """, told AS (SELECT *, substr(query_id, -1) AS d FROM ask JOIN best USING (query_id)),
  judged AS (SELECT NOT (d = '1' AND NOT unknown) AS status_ok, NOT (d IN ('1', '2') AND NOT unknown) AS citation_ok,
    unknown OR d NOT IN ('1', '2', '3') AS content_ok FROM told)
  SELECT count(*) AS n_questions, round(avg(status_ok::INT::DOUBLE), 4) AS status_accuracy,
    round(avg(citation_ok::INT::DOUBLE), 4) AS citation_accuracy, round(avg(content_ok::INT::DOUBLE), 4) AS content_accuracy FROM judged""", "E9")
def answer_accuracy(spark, sf):
    """A model that abstains for suppliers ending in 1, is expected to cite another file for those ending
    in 2, and leaves the price out for those ending in 3."""
    evidence = cut_lineage(supplier_evidence(spark, sf))
    asked = cut_lineage(supplier_questions(spark, sf, evidence))
    last, none = F.substring("query_id", -1, 1), F.array().cast("array<string>")
    known = F.size("facts") > 0
    told = asked.select("query_id", F.when(last == "1", none).otherwise(F.col("expected_files")).alias("expected_files"),
                        F.when(last == "1", none).when(last == "3", F.slice("facts", 1, 1)).otherwise(F.col("facts")).alias("facts"))
    expected = asked.withColumns({
        "expected_files": F.when(known & (last == "2"), F.array(F.lit("another.md"))).otherwise(F.col("expected_files")),
        "facts": F.when(known & (last == "2"), F.array(F.lit("another fact"))).otherwise(F.col("facts"))})
    model = answers.offline_model(told, evidence)
    responses = answers.respond(asked.select("query_id", "question"), evidence, model, None, CONFIG)
    cited = responses.withColumn("source_files", F.array_distinct(F.coalesce(
        F.transform("sources", lambda s: s["filename"]), F.array().cast("array<string>"))))
    checked = evaluation.answer_checks(cited, expected, exact_sources=True)
    return checked.agg(F.count("*").alias("n_questions"), *[
        evaluation.share(F.col(f"{name}_ok")).alias(f"{name}_accuracy")
        for name in ("status", "citation", "content")])


@group.add(EVIDENCE.replace("WITH ", "WITH RECURSIVE ", 1) + f""", cost AS (SELECT query_id, rank, chunk_id, {q.estimate('content')} + 40 AS c FROM ev),
  fold AS (SELECT query_id, rank, chunk_id, c AS used, TRUE AS kept FROM cost WHERE rank = 1
    UNION ALL SELECT cost.query_id, cost.rank, cost.chunk_id,
      CASE WHEN fold.used + c <= 300 THEN fold.used + c ELSE fold.used END, fold.used + c <= 300
    FROM fold JOIN cost ON cost.query_id = fold.query_id AND cost.rank = fold.rank + 1)
  SELECT query_id, rank, chunk_id FROM fold WHERE kept""", "Z2")
def evidence_budget(spark, sf):
    evidence = cut_lineage(supplier_evidence(spark, sf))
    return answers.fit_budget(evidence, F.lit(300)).select("query_id", "rank", "chunk_id")


@group.add(EVIDENCE + """ SELECT query_id, 'PROMPT_VERSION: grounded-qa-v1' || chr(10) || 'QUESTION:' || chr(10)
    || 'Which part ships from ' || query_id || ' at which price?' || chr(10) || chr(10) || 'REQUESTED_FACTS:'
    || chr(10) || '- derive directly from QUESTION' || chr(10) || chr(10) || 'EVIDENCE:' || chr(10)
    || string_agg('[EVIDENCE id=' || chunk_id || ']' || chr(10) || 'file=' || filename || chr(10)
      || 'status=approved' || chr(10) || 'version=' || version_id || chr(10) || 'location=Order lines'
      || chr(10) || content || chr(10) || '[/EVIDENCE]', chr(10) || chr(10) ORDER BY rank) AS prompt
  FROM ev GROUP BY 1""", "Z1")
def evidence_prompt(spark, sf):
    evidence = cut_lineage(supplier_evidence(spark, sf))
    asked = supplier_questions(spark, sf, evidence).select("query_id", "question")
    return answers.prompts(asked, evidence, CONFIG)


@group.add(f"""{RECORDS} SELECT chunk_id, CASE
    WHEN content LIKE '%status N/%' THEN NULL
    ELSE regexp_extract(content, 'ships part.*price [0-9]+') END AS quote FROM rec_chunks""", "Z6 Z7 Z8")
def quote_repair(spark, sf):
    """Quotes elided (R), with other punctuation (A) or with a changed code (N)."""
    chunks = kb.record_chunks(spark, sf)
    span = F.regexp_extract("content", r"ships part.*price \d+", 0)
    price = F.regexp_extract("content", r"price \d+", 0)
    elided = F.concat(F.regexp_extract("content", r"ships part \S+", 0), F.lit(" ... "), price)
    changed = F.concat(F.lit("part ZZZ-99 at "), price)
    quote = F.when(F.col("content").contains("status R/"), elided).when(
        F.col("content").contains("status A/"), F.regexp_replace(span, " ", " | ")).otherwise(changed)
    return chunks.select("chunk_id", repaired_quote(quote, F.col("content")).alias("quote"))


@group.add(EVIDENCE + """, given AS (SELECT e.query_id, e.chunk_id AS cited, o.content AS quote, e.content
    FROM ev e JOIN ev o ON e.query_id = o.query_id AND o.rank = 1 WHERE e.rank <= 3)
  SELECT query_id, cited AS chunk_id, contains(content, quote) AS exact FROM given""", "Z4 Z5")
def quote_validation(spark, sf):
    """Claims that cite the best three rows with the quote of the first."""
    evidence = cut_lineage(supplier_evidence(spark, sf))
    cited = evidence.filter("rank <= 3").groupBy("query_id").agg(
        F.sort_array(F.collect_list("chunk_id")).alias("ids"), F.min_by("content", "rank").alias("quote"))
    payload = F.struct(F.lit("answered").alias("status"), F.lit("").alias("answer"), F.array(F.struct(
        F.lit("claim").alias("text"), F.transform("ids", lambda i: F.struct(
            i.alias("id"), F.col("quote").alias("quote"))).alias("evidence"))).alias("claims"))
    replies = cited.select("query_id", payload.alias("reply"))
    return answers.check_citations(replies, evidence).select("query_id", "chunk_id", "exact")


@group.add(covers="Z10")
def bridge_claims(spark, sf):
    evidence = cut_lineage(supplier_evidence(spark, sf))
    asked = cut_lineage(supplier_questions(spark, sf, evidence))
    model = answers.offline_model(asked.select("query_id", "expected_files", "facts"), evidence)
    replies = model(asked.select("query_id"))
    validated = cut_lineage(answers.validate(replies, evidence))
    return answers.attach_bridges(validated, asked, evidence)


@group.add("""SELECT conv_id, turn, CASE
    WHEN role = 'user' THEN 'The knowledge base does not contain sufficient evidence for a conclusion.'
    WHEN role = 'assistant' THEN 'Relevant sources were found, but the model output failed citation validation; no conclusion was returned.'
    ELSE 'Relevant sources were found, but the generation model is currently unavailable; no conclusion was returned.'
    END AS refusal FROM conversations""", "Z9")
def refusal_texts(spark, sf):
    reason = F.when(F.col("role") == "user", "no_evidence").when(
        F.col("role") == "assistant", "validation").otherwise("provider")
    return kb.table(spark, sf, "conversations").select(
        "conv_id", "turn", answers.refusal(F.col("text"), reason).alias("refusal"))


@group.add(covers="U1 U2 U3 U7 L7 L8")
def query_plans(spark, sf):
    """Plans for all user turns: a model reply where one is given, else deterministic."""
    turns = kb.table(spark, sf, "conversations").filter("role = 'user'")
    reply = F.to_json(F.struct(
        F.lit("mixed").alias("language"), F.lit("compare").alias("intent"),
        F.slice(F.split("text", " "), 1, 9).alias("subjects"),
        F.slice(F.split("text", " "), 8, 3).alias("requested_facts"),
        F.array(F.col("text")).alias("retrieval_queries")))
    planned = turns.select("conv_id", "turn", qs.query_plan(
        F.col("text"), F.when(F.col("turn") > 0, reply)).alias("plan"))
    return planned.select("conv_id", "turn", "plan.*").select(
        "conv_id", "turn", "strategy", "language", "intent", F.array_join("subjects", "|").alias("subjects"),
        F.array_join("retrieval_queries", "|").alias("retrieval_queries"))


# --------------------------------------------------------------- evaluation
RANKED = EVIDENCE + """, files AS (SELECT query_id, list(filename ORDER BY rank) AS names,
    string_agg(content, chr(10) ORDER BY rank) AS body FROM ev GROUP BY 1),
  target AS (SELECT query_id, arg_max(filename, (quantity, ordinal, chunk_id)) AS f, arg_max(version_id, (quantity, ordinal, chunk_id)) AS v,
      arg_max(ordinal, (quantity, ordinal, chunk_id)) AS o, max(part) AS fact FROM ev GROUP BY 1),
  seen AS (SELECT query_id, arg_min(version_id, rank) FILTER (filename = f) = any_value(v) AS approved_first,
      count(*) FILTER (filename = f AND 'A' || ordinal = 'A' || o AND query_id NOT LIKE '%7') > 0 AS located FROM ev JOIN target USING (query_id) GROUP BY 1),
  out AS (SELECT query_id, unknown, list_position(names, f) AS r, contains(lower(body), lower(fact)) AS covered, approved_first, located
    FROM ask JOIN files USING (query_id) JOIN target USING (query_id) JOIN seen USING (query_id))"""


def ranked_outcomes(spark, sf):
    """Each supplier's largest shipment as the expected file, version and place, judged by rank; for
    suppliers ending in 7 the place is one that no row has."""
    cell = F.concat(F.lit("A"), F.col("ordinal").cast("string"))
    evidence = cut_lineage(supplier_evidence(spark, sf).withColumns({"sheet_name": F.col("heading_path"), "cell_range": cell}))
    target = evidence.groupBy("query_id").agg(
        F.max(F.struct("quantity", "ordinal", "chunk_id", "filename", "version_id", "cell_range")).alias("t"), F.max("part").alias("fact")).select(
        "query_id", "fact", F.col("t.filename").alias("f"), F.col("t.version_id").alias("expected_version"),
        F.when(~F.col("query_id").endswith("7"), F.col("t.cell_range")).otherwise("Z0").alias("expected_range"))
    suppliers = kb.table(spark, sf, "supplier").select(
        kb.code("SUP", F.col("s_suppkey")).alias("query_id"), (F.col("s_acctbal") < 0).alias("unknown"))
    none = F.array().cast("array<string>")
    questions = suppliers.join(target, "query_id").select(
        "query_id", F.when(F.col("unknown"), "insufficient_evidence").otherwise("answered").alias("expected_status"),
        F.when(F.col("unknown"), none).otherwise(F.array("f")).alias("expected_files"), F.array("fact").alias("facts"),
        F.when(~F.col("unknown"), F.col("expected_version")).alias("expected_version"),
        F.when(~F.col("unknown"), "Order lines").alias("expected_sheet"), "expected_range")
    return evaluation.outcomes(questions, evidence)


@group.add(RANKED + """, m AS (SELECT *, r FROM out)
  SELECT count(*) AS n_questions,
    round(count(*) FILTER (WHERE NOT unknown AND r <= 1) / count(*) FILTER (WHERE NOT unknown), 4) AS recall_at_1,
    round(count(*) FILTER (WHERE NOT unknown AND r <= 5) / count(*) FILTER (WHERE NOT unknown), 4) AS recall_at_5,
    round(count(*) FILTER (WHERE NOT unknown AND r <= 10) / count(*) FILTER (WHERE NOT unknown), 4) AS recall_at_10,
    round(avg(CASE WHEN NOT unknown THEN coalesce(1.0::DOUBLE / r, 0.0) END), 4) AS mrr,
    round(avg(CASE WHEN unknown THEN 0.0::DOUBLE END), 4) AS abstention_rate,
    round(avg(CASE WHEN NOT unknown THEN covered::INT::DOUBLE END), 4) AS fact_coverage FROM m""", "E1 E2 E3 E6 A5")
def recall_at_k(spark, sf):
    return evaluation.recall_report(ranked_outcomes(spark, sf)).drop("approved_precedence", "location_accuracy")


@group.add(RANKED + """ SELECT substr(query_id, -1) AS kind, count(*) AS n_questions,
    round(avg(CASE WHEN NOT unknown THEN approved_first::INT::DOUBLE END), 4) AS approved_precedence,
    round(avg(CASE WHEN NOT unknown THEN located::INT::DOUBLE END), 4) AS location_accuracy FROM out GROUP BY 1""", "E4 E5 A5")
def source_accuracy(spark, sf):
    """By kind of question (the supplier's last digit): is the expected version first, and the place found?"""
    rows = ranked_outcomes(spark, sf).withColumn("kind", F.substring("query_id", -1, 1))
    return evaluation.recall_report(rows, "kind").select("kind", "n_questions", "approved_precedence", "location_accuracy")


@group.add(RANKED + """, g AS (SELECT round(count(*) FILTER (WHERE NOT unknown AND r <= 10) / count(*) FILTER (WHERE NOT unknown), 4) >= 0.9 AS recall_ok,
    coalesce(round(avg(CASE WHEN unknown THEN 0.0::DOUBLE END), 4) >= 0.9, TRUE) AS abstention_ok,
    coalesce(round(avg(CASE WHEN NOT unknown THEN located::INT::DOUBLE END), 4) >= 0.9, TRUE) AS location_ok,
    round(avg(CASE WHEN NOT unknown THEN covered::INT::DOUBLE END), 4) >= 0.95 AS facts_ok FROM out)
  SELECT recall_ok, abstention_ok, location_ok, facts_ok, recall_ok AND abstention_ok AND location_ok AND facts_ok AS passed FROM g""", "E7")
def acceptance_gates(spark, sf):
    report = evaluation.gates(evaluation.recall_report(ranked_outcomes(spark, sf)))
    return report.select("recall_ok", "abstention_ok", "location_ok", "facts_ok", "passed")


@group.add(EVIDENCE + """, own AS (SELECT 'SUP-' || lpad(s_suppkey::VARCHAR, 7, '0') AS query_id, n_name AS project
    FROM supplier JOIN nation ON s_nationkey = n_nationkey)
  SELECT query_id, count(*) AS n_evidence, min((project_id = project)::INT) = 1 AS isolated
  FROM ev JOIN own USING (query_id) GROUP BY 1""", "E8")
def project_isolation(spark, sf):
    found = supplier_evidence(spark, sf).join(
        record_rows(spark, sf).select("chunk_id", "project_id"), "chunk_id")
    own = kb.table(spark, sf, "supplier").join(
        kb.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        kb.code("SUP", F.col("s_suppkey")).alias("query_id"), F.col("n_name").alias("project_id"))
    return evaluation.isolation(found, own)


@group.add(EVIDENCE + """, c AS (SELECT query_id, list(DISTINCT document_id) FILTER (WHERE rank <= 2) AS cited,
    list(DISTINCT document_id) FILTER (WHERE quantity >= 48) AS expected FROM ev GROUP BY 1)
  SELECT count(*) AS n_questions, round(avg(list_has_any(cited, expected)::INT::DOUBLE), 4) AS hit_rate
  FROM c WHERE len(expected) > 0""", "E10")
def business_hit_rate(spark, sf):
    evidence = supplier_evidence(spark, sf)
    lists = evidence.groupBy("query_id").agg(
        F.collect_set(F.when(F.col("rank") <= 2, F.col("document_id"))).alias("cited_documents"),
        F.collect_set(F.when(F.col("quantity") >= 48, F.col("document_id"))).alias("expected_documents"))
    return evaluation.document_hits(lists.select("query_id", "cited_documents"),
                                    lists.select("query_id", "expected_documents"))


@group.add(EVIDENCE + """, t AS (SELECT query_id, string_agg(lower(content), chr(10)) AS body FROM ev GROUP BY 1)
  SELECT query_id, CASE WHEN unknown THEN body IS NULL ELSE contains(body, 'status r/') AND contains(body, lower(query_id)) END AS passed
  FROM ask JOIN t USING (query_id)""", "E13")
def phrasing_checks(spark, sf):
    evidence = cut_lineage(supplier_evidence(spark, sf).select("query_id", "content"))  # read twice
    cases = kb.table(spark, sf, "supplier").select(
        kb.code("SUP", F.col("s_suppkey")).alias("query_id"), (F.col("s_acctbal") >= 0).alias("expect_evidence"),
        F.array(F.lit("status R/"), kb.code("SUP", F.col("s_suppkey"))).alias("required_terms"))
    judged = evaluation.phrasing_checks(cases, evidence)
    return judged.join(evidence.select("query_id").distinct(), "query_id", "left_semi").select("query_id", "passed")


@group.add(EVIDENCE + """ SELECT query_id, bool_and(lifecycle_status = 'approved') AS approved_only
  FROM ev GROUP BY 1""", "")
def approved_only(spark, sf):
    return supplier_evidence(spark, sf).groupBy("query_id").agg(
        F.min(F.col("lifecycle_status") == "approved").alias("approved_only"))


# ---------------------------------------------------------------- ingestion
@group.add("""SELECT doc_id, source || ' > ' || lang AS heading_path, text FROM documents
  WHERE trim(regexp_replace(text, '\\s+', '', 'g')) <> ''""", "IO3 IO2 IO10")
def markdown_source(spark, sf):
    """Every note under two headings, the second one skipping a level."""
    page = F.concat(F.lit("# "), "source", F.lit("\n### "), "lang", F.lit("\n"), "text")
    units = spread(kb.table(spark, sf, "documents"), "doc_id").select(
        "doc_id", F.explode(chunking.markdown_units(page)).alias("u"))
    return units.select("doc_id", "u.heading_path", "u.text")


@group.add(covers="IO4 IO1 IO10")
def parse_pages(spark, sf):
    pages = spread(kb.table(spark, sf, "pages"), "page_id")
    return files.parse_html(pages, "page_id", "html").select(
        "page_id", F.posexplode("units").alias("unit", "u")).select(
        "page_id", "unit", "u.heading_path", "u.text", "u.is_table")


#: A fold over the pieces of a text: paragraphs, or sentences of those over 650 tokens, packed greedily; then
#: every part is opened by the last 60 words of the one before, where that fits.
CHUNKS = f"""WITH RECURSIVE para AS MATERIALIZED (SELECT doc_id, i, t, {q.estimate('t')} AS size FROM (
    SELECT doc_id, u.i, {q.strip('u.t')} AS t FROM documents, LATERAL (SELECT unnest(regexp_split_to_array(text, '\\n\\s*\\n')) AS t,
      generate_subscripts(regexp_split_to_array(text, '\\n\\s*\\n'), 1) AS i) u) WHERE t <> ''),
  piece AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS n, t, size FROM (
    SELECT doc_id, i, 0 AS j, t, size FROM para WHERE size <= 650
    UNION ALL SELECT doc_id, i, j, t, {q.estimate('t')} FROM (SELECT doc_id, i, v.j, {q.strip('v.t')} AS t FROM para, LATERAL (
      SELECT unnest(string_split(regexp_replace(para.t, '([。！？.!?；;])\\s*', '\\1' || chr(1), 'g'), chr(1))) AS t,
        generate_subscripts(string_split(regexp_replace(para.t, '([。！？.!?；;])\\s*', '\\1' || chr(1), 'g'), chr(1)), 1) AS j) v
      WHERE size > 650) WHERE t <> '')),
  fold(doc_id, n, part, sub, room) AS (SELECT DISTINCT doc_id, 0::BIGINT, 0::BIGINT, FALSE, 0::BIGINT FROM piece UNION ALL
    SELECT p.doc_id, p.n, CASE WHEN p.size > 650 OR f.sub OR p.size > f.room THEN f.part + 1 ELSE f.part END, p.size > 650,
      CASE WHEN p.size > 650 THEN 0 WHEN f.sub OR p.size > f.room THEN 650 - p.size ELSE f.room - p.size END
    FROM fold f JOIN piece p ON p.doc_id = f.doc_id AND p.n = f.n + 1),
  packed AS (SELECT doc_id, part, bool_or(sub) AS sub, string_agg(t, chr(10) || chr(10) ORDER BY n) AS t, max(size) AS size
    FROM fold JOIN piece USING (doc_id, n) GROUP BY 1, 2),
  parts AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, k) AS n, t FROM (
    SELECT doc_id, part, 0 AS k, t FROM packed WHERE NOT sub
    UNION ALL SELECT doc_id, part, k, {q.strip('substr(t, k + 1, width)')} FROM (SELECT *, unnest(range(0, length(t), width)) AS k FROM (
      SELECT *, greatest(200, 650 * greatest(1, length(t) // size)) AS width FROM packed WHERE sub))) WHERE t <> ''),
  opened AS (SELECT doc_id, n, t, array_to_string(words[greatest(1, len(words) - 59):], ' ') || chr(10) || chr(10) || t AS joined FROM (
    SELECT doc_id, n, t, list_filter(regexp_split_to_array(lag(t) OVER (PARTITION BY doc_id ORDER BY n), '\\s+'), lambda w: w <> '') AS words FROM parts)),
  chunk AS (SELECT 'note-' || lpad(doc_id::VARCHAR, 8, '0') || '@1' AS version_id, n - 1 AS ordinal,
    CASE WHEN joined IS NOT NULL AND {q.estimate('joined')} <= 650 THEN joined ELSE t END AS content FROM opened),
  named AS (SELECT *, sha256(content) AS content_hash, {q.estimate('content')} AS token_count FROM chunk),
  ids AS (SELECT *, {q.name_uuid("version_id || ':' || ordinal || ':' || content_hash")} AS chunk_id FROM named)"""


@group.add(CHUNKS + """ SELECT version_id, ordinal::INT AS ordinal, chunk_id, content_hash, token_count, lag(chunk_id) OVER w AS previous_chunk_id,
    lead(chunk_id) OVER w AS next_chunk_id FROM ids WINDOW w AS (PARTITION BY version_id ORDER BY ordinal)""", "K2 K3 K4 K5 K6")
def chunk_documents(spark, sf):
    notes = kb.note_files(spark, sf).select("version_id", F.array(chunking.unit(F.col("text"))).alias("units"))
    return chunking.chunk_documents(notes, CONFIG).select(
        "version_id", "ordinal", "chunk_id", "content_hash", "token_count", "previous_chunk_id",
        "next_chunk_id")


@group.add(f"""{NOTES} SELECT sha256(content) AS content_hash, 256 AS dimensions FROM note_lines
  WHERE sha256(content) NOT IN (SELECT sha256(content) FROM note_lines WHERE lang = 'en') GROUP BY 1""", "V5 IO15")
def embed_missing(spark, sf):
    """Distinct line contents, English ones are in the cache already."""
    chunks = kb.note_chunks(spark, sf)
    cache = chunks.filter(F.col("heading_path").endswith("en")).select(
        "content_hash", F.lit(CONFIG.embedding_fingerprint).alias("embedding_fingerprint")).distinct()
    return embedding.embed_missing(chunks, cache, CONFIG).select("content_hash", "dimensions")


@group.add("""SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text)) AS byte_size FROM documents
  WHERE lang <> 'en'""", "IO13 IO11")
def store_objects(spark, sf):
    notes = kb.table(spark, sf, "documents").select(
        F.col("doc_id").alias("object_key"), F.encode("text", "UTF-8").alias("data"), "lang")
    known = notes.filter("lang = 'en'").select("object_key", F.sha2("data", 256).alias("sha256"))
    return files.store_objects(known, notes.drop("lang")).select(
        F.col("object_key").alias("doc_id"), "sha256", F.octet_length("data").alias("byte_size"))


# ---------------------------------------------------------------- streaming
def event_stream(spark, sf):
    schema = kb.table(spark, sf, "events").schema
    return outbox.read_events(spark, sf, schema, "events.parquet")


def run_stream(spark, start):
    """Run a stream over the files present and read what it wrote."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    start(f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@group.add(f"""{q.with_views(q.OUTBOX)} SELECT event_type, status, count(*) AS n,
  max(attempts) AS max_attempts FROM queue GROUP BY ALL""", "T11 A4")
def stream_status_counts(spark, sf):
    rows = kb.as_outbox(event_stream(spark, sf))
    out = run_stream(spark, lambda target, state: outbox.status_counts_stream(rows, target, state))
    last = out.agg(F.max("batch")).first()[0]
    return out.filter(F.col("batch") == last).drop("batch")


def _tried(source: str, moment: str) -> str:
    """SQL: the due rows of ``source`` after an attempt at ``moment``, and all others as they are."""
    due = f"(status = 'pending' AND available_at <= TIMESTAMP '{moment}')"
    done = f"({due} AND event_type = 'index_version')"
    return f"""SELECT id, event_type, attempts + {due}::INT AS attempts,
      CASE WHEN {done} THEN 'published' WHEN {due} AND attempts + 1 >= 5 THEN 'dead' ELSE status END AS status,
      CASE WHEN {due} AND NOT {done} THEN TIMESTAMP '{moment}' + to_seconds(least(300, pow(2, least(attempts + 1, 8)))::INT)
        ELSE available_at END AS available_at FROM {source}"""


LATER = "2026-01-01 00:00:00"


@group.add(f"""{q.with_views(q.OUTBOX)}, first_try AS ({_tried('queue', kb.NOW)}), second_try AS ({_tried('first_try', LATER)})
  SELECT id, attempts, status FROM second_try""", "T2 T4 T7 T12")
def stream_publish(spark, sf):
    """Two triggers: due events are published once, delete events fail and back off, and what waited
    is tried at the later trigger."""
    def publish(now):
        def attempt(due):
            done = due.filter("event_type = 'index_version'").withColumn("status", F.lit("published"))
            return done.unionByName(queue.fail(due.filter("event_type = 'delete_version'"), now).select(*done.columns))

        return attempt

    rows = kb.as_outbox(event_stream(spark, sf))
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    first, later = (F.lit(t).cast("timestamp") for t in (kb.NOW, LATER))
    outbox.publish_stream(rows, publish(first), f"{folder}/out", f"{folder}/state", first).awaitTermination()
    nothing_new = spark.createDataFrame([], rows.schema)
    outbox.publish_step(nothing_new, publish(later), f"{folder}/out", later)
    return outbox.outcomes(spark, f"{folder}/out", rows.schema).select("id", "attempts", "status")
