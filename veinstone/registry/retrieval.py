"""Text, lexical, vector, fusion and selection queries over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from veinstone.cluster import cut_lineage, shared_folder
from veinstone.config import EngineConfig
from veinstone.functions import text as tx
from veinstone.functions.hashing import content_hash
from veinstone.functions.vectors import embedding_or_error, feature_hash_embedding
from veinstone.operators import fusion, lexical, postings, scope, selection, vector, vector_index
from veinstone.operators.lexical import top_per_query
from veinstone.plans import kb, retrieve
from veinstone.registry import sql as q
from veinstone.registry.base import Group
from veinstone.registry.catalog import record_rows
from veinstone.sources import vector_blocks

group = Group()
NOTES, RECORDS = q.with_views(q.NOTES), q.with_views(q.RECORDS)
CONFIG = EngineConfig(embedding_dimensions=256)


# --------------------------------------------------------------------- text
@group.add(f"SELECT doc_id, {q.normalize('text')} AS normalized FROM documents", "L2")
def normalized_text(spark, sf):
    return kb.note_files(spark, sf).select(
        "doc_id", tx.normalize_search_text(F.col("text")).alias("normalized"))


@group.add(f"""WITH n AS (SELECT doc_id, {q.normalize('text')} AS t FROM documents),
  k AS (SELECT doc_id, regexp_extract_all(t, '[a-z0-9][a-z0-9_.:/-]*') AS found FROM n),
  e AS (SELECT doc_id, unnest(found) AS token, generate_subscripts(found, 1) AS pos FROM k),
  d AS (SELECT doc_id, token, min(pos) AS pos FROM e GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM d)
  SELECT doc_id, string_agg(token, ' ' ORDER BY pos) AS tokens, count(*) AS n_tokens
  FROM r GROUP BY 1""", "L3 SO1")
def lexical_tokens(spark, sf):
    tokens = tx.lexical_tokens(tx.normalize_search_text(F.col("text")))
    return kb.note_files(spark, sf).select("doc_id", tokens.alias("t")).filter(F.size("t") > 0).select(
        "doc_id", F.array_join("t", " ").alias("tokens"), F.size("t").cast("long").alias("n_tokens"))


@group.add(f"{NOTES} SELECT chunk_id, {q.estimate('content')} AS tokens FROM note_lines", "K1")
def token_estimate(spark, sf):
    return kb.note_chunks(spark, sf).select(
        "chunk_id", tx.estimate_tokens(F.col("content")).alias("tokens"))


@group.add(f"""{RECORDS} SELECT chunk_id, array_to_string(regexp_extract_all(' ' || filename || ' '
    || content, '[^A-Za-z0-9]([A-Za-z][A-Za-z0-9]{{1,12}}-[0-9]{{2,}}(?:-[A-Za-z0-9]+)*)', 1), ' ') AS codes
  FROM rec_rows""", "L5")
def exact_identifiers(spark, sf):
    text = F.concat_ws(" ", "filename", "content")
    return record_rows(spark, sf).select("chunk_id", F.array_join(tx.identifiers(text), " ").alias("codes"))


@group.add(f"""{RECORDS}, p AS (SELECT chunk_id, filename, heading_path,
    lower(filename || ' ' || heading_path || ' ' || content) AS raw_text,
    list_distinct(regexp_extract_all(lower(filename), '[a-z0-9][a-z0-9_.:/-]*')) AS f,
    list_distinct(regexp_extract_all(lower(heading_path), '[a-z0-9][a-z0-9_.:/-]*')) AS h,
    list_distinct(regexp_extract_all(lower(content), '[a-z0-9][a-z0-9_.:/-]*')) AS c FROM rec_rows)
  SELECT chunk_id, raw_text, 4 * len(f) + 3 * len(h) + len(c) AS total_weight,
    array_to_string(list_sort(list_distinct(regexp_extract_all(' ' || raw_text,
      '[^a-z0-9]([a-z][a-z0-9]{{1,12}}-[0-9]{{2,}}(?:-[a-z0-9]+)*)', 1))), ' ') AS exact_terms FROM p""", "L4")
def search_projection(spark, sf):
    weight = F.aggregate("postings", F.lit(0), lambda acc, p: acc + p["weight"])
    # chunks are stored before they are projected, with what is projected
    chunks = cut_lineage(record_rows(spark, sf).select("chunk_id", "filename", "heading_path", "content"))
    return lexical.search_projection(chunks).select(
        "chunk_id", "raw_text", weight.cast("long").alias("total_weight"),
        F.array_join("exact_terms", " ").alias("exact_terms"))


@group.add("""SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS folded,
    regexp_replace(regexp_replace(text, '([0-9])[,_\\s]([0-9])', '\\1\\2', 'g'),
      '([0-9])[,_\\s]([0-9])', '\\1\\2', 'g') AS plain_numbers FROM conversations""", "Z5 Z15")
def quote_folding(spark, sf):
    return kb.table(spark, sf, "conversations").select(
        "conv_id", "turn", tx.fold_quote(F.col("text")).alias("folded"),
        tx.drop_thousands(F.col("text")).alias("plain_numbers"))


@group.add(f"""{NOTES} SELECT chunk_id, lag(chunk_id) OVER w AS previous_chunk_id,
    lead(chunk_id) OVER w AS next_chunk_id FROM note_lines
  WINDOW w AS (PARTITION BY version_id ORDER BY ordinal)""", "K6 W4 K5")
def chunk_links(spark, sf):
    files = kb.note_files(spark, sf)
    lines = F.filter(F.transform(F.split("text", "\n"), lambda t, i: F.when(
        F.trim(t) != "", F.concat_ws(":", "version_id", F.lpad(i.cast("string"), 5, "0")))),
        lambda c: c.isNotNull())
    listed = files.select(lines.alias("ids")).select("ids", F.posexplode("ids").alias("i", "chunk_id"))
    return listed.select("chunk_id", F.get("ids", F.col("i") - 1).alias("previous_chunk_id"),
                         F.get("ids", F.col("i") + 1).alias("next_chunk_id"))


# ------------------------------------------------------------------ lexical
def note_index(spark, sf):
    """The stored search projection of the notes."""
    return cut_lineage(lexical.search_projection(kb.note_chunks(spark, sf)))


LEXICAL_SQL = f"""{NOTES}, line AS MATERIALIZED (
    SELECT chunk_id, {q.normalize('filename')} AS f, {q.normalize('heading_path')} AS h,
      {q.normalize('content')} AS c FROM note_lines WHERE {q.APPROVED_PUBLIC}),
  post AS (SELECT chunk_id, token, sum(w) AS w FROM (
      SELECT chunk_id, unnest(list_distinct(regexp_extract_all(f, '[a-z0-9][a-z0-9_.:/-]*'))) AS token, 4 AS w FROM line
      UNION ALL SELECT chunk_id, unnest(list_distinct(regexp_extract_all(h, '[a-z0-9][a-z0-9_.:/-]*'))), 3 FROM line
      UNION ALL SELECT chunk_id, unnest(list_distinct(regexp_extract_all(c, '[a-z0-9][a-z0-9_.:/-]*'))), 1 FROM line)
    GROUP BY ALL),
  raw AS MATERIALIZED (SELECT chunk_id, trim(f || ' ' || h || ' ' || c) AS raw_text FROM line),
  tri AS MATERIALIZED (SELECT chunk_id, {q.trigrams('raw_text')} AS t FROM raw),
  ask AS MATERIALIZED (SELECT item_id AS query_id, {q.normalize('text')} AS n FROM benchmark),
  asked AS (SELECT query_id, unnest(k) AS token, generate_subscripts(k, 1) AS pos FROM (
      SELECT query_id, regexp_extract_all(n, '[a-z0-9][a-z0-9_.:/-]*') AS k FROM ask)),
  placed AS (SELECT query_id, token, row_number() OVER (PARTITION BY query_id ORDER BY min(pos)) AS pos
    FROM asked GROUP BY query_id, token),
  hit AS (SELECT query_id, chunk_id, sum(w) AS w FROM post JOIN placed USING (token)
    WHERE pos <= 64 GROUP BY ALL),
  sig AS (SELECT query_id, chunk_id, count(*) AS n FROM raw JOIN placed
    ON pos <= 12 AND length(token) >= 2 AND contains(raw_text, token) GROUP BY ALL),
  cand AS (SELECT query_id, chunk_id, coalesce(w, 0) AS w, coalesce(n, 0) AS s
    FROM hit FULL JOIN sig USING (query_id, chunk_id)),
  asktri AS MATERIALIZED (SELECT query_id, {q.trigrams('n')} AS qt FROM ask),
  scored AS (SELECT query_id, chunk_id, 0.1::DOUBLE * w / (0.1::DOUBLE * w + 1.0) * 20.0 + 8.0::DOUBLE * s
      + len(list_intersect(t, qt))::DOUBLE / (len(t) + len(qt) - len(list_intersect(t, qt))) AS score
    FROM cand JOIN tri USING (chunk_id) JOIN asktri USING (query_id)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank
    FROM scored)"""


def own_folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@group.add(LEXICAL_SQL + """ SELECT query_id, rank, chunk_id, round(score, 6) AS score
  FROM ranked WHERE rank <= 50""", "L11 L12 P8 P9 P10 S1 J5")
def lexical_topk(spark, sf):
    """All questions by one scan of the projection."""
    index = scope.in_scope(note_index(spark, sf), ["approved"])
    asked = kb.questions(spark, sf).withColumnRenamed("question", "text")
    return lexical.lexical_search(index, asked, 50).select(
        "query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


@group.add(LEXICAL_SQL + """ SELECT query_id, rank, chunk_id, round(score, 6) AS score
  FROM ranked WHERE rank <= 50""", "L11 P8 P9 P10")
def stored_lexical_topk(spark, sf):
    """The same answers from the stored inverted index of the chunks in scope."""
    rows = scope.in_scope(kb.note_chunks(spark, sf), ["approved"])
    index = postings.write_index(lexical.search_projection(rows), own_folder(spark, "lists"))
    asked = kb.questions(spark, sf).withColumnRenamed("question", "text")
    return postings.postings_search(index, asked, 50).select(
        "query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


@group.add(f"""{RECORDS}, f AS (SELECT DISTINCT lower(substr('PRT-' || lpad(p_partkey::VARCHAR, 7, '0'), 3, 8)) AS fragment FROM part)
  SELECT fragment, chunk_id FROM f JOIN rec_content_ids ON contains(text, fragment)""".replace(
    "rec_content_ids", "(SELECT chunk_id, lower(content) AS text FROM rec_chunks)"), "P8")
def code_fragments(spark, sf):
    """Which order lines contain a part of a part code: substrings by trigram lists."""
    none = F.array().cast("array<string>")
    rows = kb.record_chunks(spark, sf).select(
        "chunk_id", F.lower("content").alias("raw_text"), none.alias("exact_terms"),
        F.array().cast("array<struct<token: string, weight: int>>").alias("postings"))
    index = postings.write_index(rows, own_folder(spark, "fragments"))
    fragments = kb.table(spark, sf, "part").select(
        F.lower(F.substring(kb.code("PRT", F.col("p_partkey")), 3, 8)).alias("signal")).distinct()
    return postings.signal_chunks(index, fragments).withColumnRenamed("signal", "fragment")


# ------------------------------------------------------------------- vector
VECTORS = """
vec AS (SELECT 'v' || lpad(vec_id::VARCHAR, 8, '0') AS chunk_id, 'p' || label AS project_id,
    embedding::DOUBLE[] AS e FROM embeddings),
cell AS (SELECT project_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM vec),
proto AS (SELECT project_id AS query_id, list(round(x, 6) ORDER BY i) AS v FROM (
    SELECT project_id, i, avg(x) AS x FROM cell GROUP BY ALL) GROUP BY 1),
sim AS (SELECT query_id, chunk_id, project_id, round(list_cosine_similarity(e, v), 6) AS score
  FROM vec, proto)"""


def vectors(spark, sf):
    return kb.table(spark, sf, "embeddings").select(
        F.concat(F.lit("v"), F.lpad(F.col("vec_id").cast("string"), 8, "0")).alias("chunk_id"),
        F.concat(F.lit("p"), F.col("label")).alias("project_id"), "embedding")


def prototypes(rows):
    """The mean vector of each project, asked as a question."""
    cells = rows.select("project_id", F.posexplode("embedding").alias("i", "x"))
    means = cells.groupBy("project_id", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
    listed = means.groupBy(F.col("project_id").alias("query_id")).agg(
        F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c"))
    return listed.select("query_id", F.transform("c", lambda s: s["x"]).alias("vector"))


@group.add(f"""{q.with_views(VECTORS)} SELECT query_id, rank, chunk_id, project_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sim
    WHERE score >= 0.25) WHERE rank <= 50""", "V2 V3 P6")
def cosine_topk(spark, sf):
    rows = vectors(spark, sf)
    return vector.vector_search(rows, prototypes(rows), 50, 0.25).select(
        "query_id", "rank", "chunk_id", "project_id", "score")


@group.add(f"""{q.with_views(VECTORS)} SELECT query_id, rank, chunk_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sim
    WHERE score >= 0.25) WHERE rank <= 50""", "V2 V3 P6")
def indexed_topk(spark, sf):
    """The answers of ``cosine_topk`` from the stored vector index."""
    rows, folder = vectors(spark, sf), own_folder(spark, "vectors")
    vector_index.write_vectors(rows.select("chunk_id", "embedding"), folder)
    index = vector_index.VectorIndex(spark, folder)
    return vector_index.index_search(index, prototypes(rows), 50, 0.25)[0].select("query_id", "rank", "chunk_id", "score")


@group.add("""SELECT 'v' || lpad(vec_id::VARCHAR, 8, '0') AS chunk_id, len(embedding)::BIGINT AS dimensions,
  embedding FROM embeddings""", "IO15")
def stored_vectors(spark, sf):
    """Vectors written as checksummed blocks and read back."""
    folder = own_folder(spark, "blocks")
    vector_blocks.register(spark)
    vectors(spark, sf).select("chunk_id", "embedding").write.format("vector_blocks").mode("append").save(folder)
    return spark.read.format("vector_blocks").load(folder).select(
        "chunk_id", F.size("embedding").cast("long").alias("dimensions"), "embedding")


def vowel_counts(text, dimensions):
    """A model of five dimensions that fails on every seventh length."""
    if len(text) % 7 == 0:
        raise TimeoutError("no answer from the model")
    return [text.count(v) for v in "aeiou"]


VOWELS = "[" + ", ".join(f"length({{0}}) - length(replace({{0}}, '{v}', ''))" for v in "aeiou") + "]::DOUBLE[]"


@group.add(LEXICAL_SQL + f""", kept AS (SELECT chunk_id, e FROM (SELECT chunk_id, {VOWELS.format("content")} AS e FROM note_lines
      WHERE {q.APPROVED_PUBLIC} AND length(content) % 7 <> 0) WHERE list_sum(e) > 0),
  tried AS (SELECT query_id, length(t) % 7 <> 0 AS able, {VOWELS.format("t")} AS v FROM (
    SELECT item_id AS query_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM benchmark)),
  near AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM (
    SELECT query_id, chunk_id, round(list_cosine_similarity(e, v), 6) AS s FROM tried, kept WHERE able AND list_sum(v) > 0) WHERE s >= 0.25),
  l AS (SELECT query_id, chunk_id, rank AS r FROM ranked WHERE rank <= 50), n AS (SELECT query_id, chunk_id, rank AS r FROM near WHERE rank <= 50),
  fused AS (SELECT query_id, chunk_id, (coalesce(1.0::DOUBLE / (60 + l.r), 0) + coalesce(1.0::DOUBLE / (60 + n.r), 0)) * 1.08::DOUBLE AS score,
      CASE WHEN l.r IS NOT NULL THEN l.r ELSE 1000 + n.r END AS first FROM l FULL JOIN n USING (query_id, chunk_id))
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS rank, chunk_id, round(score, 9) AS score,
    CASE WHEN able THEN 'hybrid' ELSE 'lexical_only' END AS mode FROM fused JOIN tried USING (query_id)""", "R19")
def degraded_search(spark, sf):
    """Both channels, and the lexical one alone for the questions that the model fails on."""
    config = EngineConfig(embedding_model="vowels", embedding_dimensions=5)
    rows = scope.in_scope(kb.note_chunks(spark, sf), ["approved"]).withColumn(
        "_e", embedding_or_error(F.col("content"), 5, vowel_counts)).withColumns({
            "embedding": F.col("_e.vector"), "embedding_fingerprint": F.lit(config.embedding_fingerprint)}).drop("_e")
    index = cut_lineage(lexical.search_projection(rows))
    asked = kb.questions(spark, sf).withColumnRenamed("question", "text")
    found = retrieve.two_channels(index, asked, config, vowel_counts)
    return found.select("query_id", "rank", "chunk_id", F.round("score", 9).alias("score"), "mode")


@group.add(f"""{q.with_views(VECTORS)}, mean AS (SELECT list(round(x, 6) ORDER BY i) AS v FROM (
    SELECT i, avg(x) AS x FROM cell GROUP BY 1))
  SELECT chunk_id, round(list_cosine_similarity(e, v), 6) AS score FROM vec, mean
  ORDER BY 2 DESC, 1 LIMIT 50""", "V1 V2 S1")
def cosine_single(spark, sf):
    rows = vectors(spark, sf)
    means = rows.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(
        F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
    mean = [r.x for r in means.orderBy("i").collect()]
    return vector.cosine_topk(rows, mean, 50).select("chunk_id", "score")


@group.add(covers="V6 V9")
def feature_hash(spark, sf):
    return kb.note_chunks(spark, sf).select("chunk_id", feature_hash_embedding(
        F.col("content"), CONFIG.embedding_dimensions).alias("embedding"))


# -------------------------------------------------------- fusion, selection
def supplier_rows(spark, sf):
    """Current approved order lines, each an answer to "what does its supplier ship?"."""
    rows = scope.in_scope(record_rows(spark, sf), ["approved"])

    def number(label):
        return F.regexp_extract("content", label + r" (\d+)", 1).cast("long")

    return rows.select(
        F.regexp_extract("content", r"SUP-\d+", 0).alias("query_id"),
        F.regexp_extract("content", r"PRT-\d+", 0).alias("part"),
        number("price").alias("price"), number("quantity").alias("quantity"), "chunk_id",
        "document_id", "version_id", "filename", "lifecycle_status", "document_type", "heading_path",
        "content", "content_hash", "ordinal").withColumn("text", whole_text())


def whole_text():
    return tx.searchable(F.col("filename"), F.col("heading_path"), F.lit(""), F.col("content"))


def slim(rows):
    """Rows as they are shuffled and stored: without the columns that ``whole`` makes of the others."""
    return rows.drop("text", "content_hash")


def whole(rows):
    return rows.withColumns({"content_hash": content_hash(F.col("content")), "text": whole_text()})


def supplier_channel(rows, channel, order):
    return top_per_query(rows, 50, F.desc(order), F.asc("chunk_id")).withColumn("channel", F.lit(channel))


def supplier_fused(rows):
    rows = slim(rows)
    return whole(fusion.rrf(supplier_channel(rows, 0, "price").unionByName(
        supplier_channel(rows, 1, "quantity"))))


SUPPLIERS = f"""{RECORDS}, sup AS MATERIALIZED (SELECT *, regexp_extract(content, 'SUP-[0-9]+') AS query_id,
    regexp_extract(content, 'PRT-[0-9]+') AS part,
    regexp_extract(content, 'price ([0-9]+)', 1)::BIGINT AS price,
    regexp_extract(content, 'quantity ([0-9]+)', 1)::BIGINT AS quantity,
    lower(filename || ' ' || heading_path || '  ' || content) AS text FROM rec_rows WHERE {q.APPROVED_PUBLIC}),
  c0 AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY price DESC, chunk_id) AS r FROM sup QUALIFY r <= 50),
  c1 AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY quantity DESC, chunk_id) AS r FROM sup QUALIFY r <= 50),
  fs AS (SELECT query_id, chunk_id, (coalesce(1.0::DOUBLE / (60 + c0.r), 0) + coalesce(1.0::DOUBLE / (60 + c1.r), 0)) * 1.08::DOUBLE AS score,
      CASE WHEN c0.r IS NOT NULL THEN c0.r ELSE 1000 + c1.r END AS first FROM c0 FULL JOIN c1 USING (query_id, chunk_id)),
  fused AS MATERIALIZED (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS rank FROM fs),
  frow AS MATERIALIZED (SELECT fused.*, sup.* EXCLUDE (query_id, chunk_id) FROM fused JOIN sup USING (query_id, chunk_id))"""
SHOWN = ["query_id", "rank", "chunk_id"]


def shown(rows):
    return rows.select(*SHOWN, F.round("score", 9).alias("score"))


@group.add(f"{SUPPLIERS} SELECT query_id, rank, chunk_id, round(score, 9) AS score FROM fused", "R1 R19 W3")
def rrf_hybrid(spark, sf):
    return shown(supplier_fused(supplier_rows(spark, sf)))


@group.add(f"""{SUPPLIERS}, c2 AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id
      ORDER BY ordinal DESC, chunk_id) AS r FROM sup QUALIFY r <= 50),
  s2 AS (SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + r) * 1.08::DOUBLE AS score, r AS rank FROM c2),
  m AS (SELECT query_id, chunk_id, coalesce(fused.score, 0) + coalesce(s2.score * 0.92::DOUBLE, 0) AS score,
      CASE WHEN fused.rank IS NOT NULL THEN fused.rank ELSE 1000 + s2.rank END AS first
    FROM fused FULL JOIN s2 USING (query_id, chunk_id))
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS rank, chunk_id,
    round(score, 9) AS score FROM m""", "R2 SO2")
def weighted_merge(spark, sf):
    rows = supplier_rows(spark, sf)
    third = fusion.rrf(supplier_channel(rows, 0, "ordinal"))
    return shown(fusion.weighted_merge(supplier_fused(rows), third))


@group.add(f"""{SUPPLIERS}, b AS (SELECT *, CASE WHEN contains(text, 'status r/') OR contains(text, 'building')
      THEN score * 1.35::DOUBLE ELSE score END AS s FROM frow)
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank) AS rank, chunk_id,
    round(s, 9) AS score FROM b""", "R4 R18")
def anchor_boost(spark, sf):
    fused = supplier_fused(supplier_rows(spark, sf))
    anchors = F.array(F.lit("status r/"), F.lit("building"))
    return shown(fusion.boost_anchors(fused.withColumn("anchors", anchors)))


@group.add(f"""{SUPPLIERS}, g AS (SELECT *, max(contains(text, 'quantity 50 price')::INT)
      OVER (PARTITION BY query_id) AS ok FROM frow)
  SELECT query_id, rank, chunk_id, round(score, 9) AS score FROM g WHERE ok = 1""", "R5")
def grounded_subject(spark, sf):
    rows = supplier_fused(supplier_rows(spark, sf))
    signals = F.array(F.lit("quantity 50 price"))
    return shown(fusion.grounded_only(rows.withColumn("wanted", signals), "wanted"))


@group.add(f"""{SUPPLIERS}, u AS (SELECT *, row_number() OVER (PARTITION BY query_id, part ORDER BY rank) AS n FROM frow)
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, chunk_id,
    round(score, 9) AS score FROM u WHERE n = 1""", "R6")
def content_dedupe(spark, sf):
    rows = supplier_fused(supplier_rows(spark, sf))
    return shown(fusion.dedupe_content(rows.withColumn("content_hash", F.col("part"))))


def supplier_codes(spark, sf, rows):
    """Wanted codes per supplier; indebted suppliers also ask for an unknown one."""
    suppliers = kb.table(spark, sf, "supplier").select(
        kb.code("SUP", F.col("s_suppkey")).alias("query_id"), (F.col("s_acctbal") < 0).alias("unknown"))
    first = rows.groupBy("query_id").agg(
        F.lower(F.min_by("part", "rank")).alias("a"),
        F.lower(F.max_by("document_id", "rank")).alias("b"),
        F.lower(F.min_by("version_id", "rank")).alias("c"))
    return rows.join(suppliers.join(first, "query_id"), "query_id").withColumns({
        "query_codes": F.when(F.col("unknown"), F.array("a", F.lit("xyz-9999"))).otherwise(F.array("a", "b")),
        "linked": F.array("c")})


@group.add(f"""{SUPPLIERS}, f AS (SELECT query_id, lower(min_by(part, rank)) AS a, lower(max_by(document_id, rank)) AS b,
      lower(min_by(version_id, rank)) AS c FROM frow GROUP BY 1)
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, chunk_id,
    round(score, 9) AS score FROM frow JOIN f USING (query_id)
  JOIN supplier ON query_id = 'SUP-' || lpad(s_suppkey::VARCHAR, 7, '0')
  WHERE s_acctbal >= 0 AND (contains(text, a) OR contains(text, b) OR contains(text, c))""", "R7")
def identifier_gate(spark, sf):
    rows = supplier_codes(spark, sf, supplier_fused(supplier_rows(spark, sf)))
    return shown(fusion.identifier_gate(rows))


@group.add(f"""{SUPPLIERS}, f AS (SELECT query_id, lower(min_by(part, rank)) AS a,
      lower(min_by(version_id, rank)) AS c FROM frow GROUP BY 1)
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, chunk_id,
    round(score, 9) AS score FROM frow JOIN f USING (query_id)
  WHERE contains(text, a) OR contains(text, c)""", "R8")
def entity_preference(spark, sf):
    rows = supplier_codes(spark, sf, supplier_fused(supplier_rows(spark, sf)))
    return shown(fusion.entity_preference(rows.withColumn("subjects", F.array("a"))))


@group.add(f"""{SUPPLIERS}, f AS (SELECT query_id, lower(min_by(part, rank)) AS a, lower(max_by(document_id, rank)) AS b FROM frow GROUP BY 1),
  anc AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM frow WHERE contains(text, 'status r/')),
  code AS (SELECT query_id, n, unnest(k) AS v, generate_subscripts(k, 1) AS pos FROM (SELECT query_id, n,
      regexp_extract_all(' ' || text, '[^a-z0-9]([a-z][a-z0-9]{{1,12}}-[0-9]{{2,}}(?:-[a-z0-9]+)*)', 1) AS k FROM anc WHERE n <= 8)),
  new AS (SELECT query_id, v, min(n * 100 + pos) AS place FROM code JOIN f USING (query_id)
    WHERE v NOT IN (a, b) GROUP BY ALL),
  top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS r FROM new)
  SELECT query_id, string_agg(upper(v), ' ' ORDER BY r) AS linked FROM top WHERE r <= 12 GROUP BY 1""", "R9 J12")
def linked_identifiers(spark, sf):
    fused = supplier_fused(supplier_rows(spark, sf))
    own = fusion.per_query()  # rows of a question lie together already
    rows = fused.withColumns({
        "query_codes": F.array(F.lower(F.min_by("part", "rank").over(own)), F.lower(F.max_by("document_id", "rank").over(own))),
        "signals": F.array(F.lit("status r/"))})
    return fusion.linked_references(rows).select("query_id", F.array_join("linked", " ").alias("linked"))


# expansion: the chunks of the documents a supplier's best rows come from
RELATED = """, reldoc AS (SELECT query_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS p
    FROM frow GROUP BY query_id, document_id QUALIFY p <= 16),
  rel AS MATERIALIZED (SELECT d.query_id, s.* EXCLUDE (query_id), row_number() OVER (
      PARTITION BY d.query_id ORDER BY document_id, ordinal, s.chunk_id) AS pos FROM sup s JOIN reldoc d USING (document_id) QUALIFY pos <= 192)"""


def supplier_related(rows, fused):
    documents = fused.groupBy("query_id", "document_id").agg(F.min("rank").alias("p"))
    first = fusion.rerank_by(documents, "p").filter("rank <= 16").select("query_id", "document_id")
    chunks = slim(rows).drop("query_id").join(first, "document_id")
    return whole(top_per_query(chunks, 192, "document_id", "ordinal", "chunk_id")).withColumn("score", F.lit(0.0))


@group.add(f"{SUPPLIERS}{RELATED} SELECT query_id, pos AS rank, chunk_id FROM rel", "L13 S4 J14")
def document_expansion(spark, sf):
    rows = cut_lineage(supplier_rows(spark, sf))
    return supplier_related(rows, supplier_fused(rows)).select(*SHOWN)


AUTHORITY = """(2 * (contains(text, 'approved')::INT + contains(text, 'current')::INT + contains(text, 'signed')::INT)
  - 3 * (contains(text, 'retired')::INT + contains(text, 'draft')::INT))"""


def asked_text(rows):
    return rows.withColumn("question_folded", F.lit("what does the supplier ship"))


@group.add(f"""{SUPPLIERS}{RELATED}, base AS (SELECT * FROM frow WHERE rank <= 22),
  org AS (SELECT query_id, document_id, list(DISTINCT ordinal) AS o, min(rank) AS place FROM base GROUP BY ALL),
  opt AS (SELECT rel.*, place, list_min(list_transform(o, lambda x: abs(rel.ordinal - x))) AS dist
    FROM rel JOIN org USING (query_id, document_id)
    WHERE (query_id, chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM base)),
  pick AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY dist, -{AUTHORITY}, ordinal, pos) AS n FROM opt),
  ext AS (SELECT query_id, chunk_id, content_hash, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank FROM pick WHERE n = 1 QUALIFY rank <= 8),
  al AS (SELECT query_id, chunk_id, content_hash, score, 0 AS part_no, rank FROM base
    UNION ALL SELECT query_id, chunk_id, content_hash, 0.0, 1, rank FROM ext
    UNION ALL SELECT query_id, chunk_id, content_hash, score, 2, rank FROM frow WHERE rank > 22
      AND (query_id, chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM ext)),
  ded AS (SELECT *, row_number() OVER (PARTITION BY query_id, content_hash ORDER BY part_no, rank) AS n FROM al),
  fin AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY part_no, rank) AS rank FROM ded WHERE n = 1)
  SELECT query_id, rank, chunk_id, round(score, 9) AS score FROM fin WHERE rank <= 30""", "R10 R11")
def candidate_pool(spark, sf):
    rows = cut_lineage(slim(asked_text(supplier_rows(spark, sf))))
    fused = whole(cut_lineage(slim(supplier_fused(rows))))
    related = supplier_related(rows, fused).select(*fused.columns)
    return shown(selection.candidate_pool(fused, related, 30, 8))


@group.add(f"""{SUPPLIERS}, d AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id
      ORDER BY {AUTHORITY} DESC, (length(trim(content)) >= 100) DESC, rank) AS n,
    min(rank) OVER (PARTITION BY query_id, document_id) AS place FROM frow)
  SELECT query_id, r AS rank, chunk_id, round(score, 9) AS score FROM (SELECT *, row_number() OVER (
    PARTITION BY query_id ORDER BY n = 1 DESC, CASE WHEN n = 1 THEN place ELSE rank END) AS r FROM d)
  WHERE r <= 40""", "R13")
def diversify_documents(spark, sf):
    rows = asked_text(supplier_fused(supplier_rows(spark, sf)))
    return shown(selection.diversify_documents(rows, 40))


def bridge_columns(rows):
    return rows.withColumns({
        "query_codes": F.array().cast("array<string>"),
        "bridge_signals": F.array(F.lit("building"), F.lit("automobile")),
        "linked": F.array().cast("array<string>")})


@group.add(f"""{SUPPLIERS}{RELATED}, sel AS (SELECT * FROM frow WHERE rank <= 8),
  down AS (SELECT query_id, list(DISTINCT c) AS ids FROM (SELECT query_id, unnest(regexp_extract_all(' ' || text,
      '[^a-z0-9]([a-z][a-z0-9]{{1,12}}-[0-9]{{2,}}(?:-[a-z0-9]+)*)', 1)) AS c FROM sel) GROUP BY 1),
  opt AS (SELECT rel.*, contains(text, 'building')::INT + contains(text, 'automobile')::INT AS subj,
      len(list_filter(ids, lambda i: contains(text, i))) AS links,
      (document_type IN ('business-requirement', 'mapping'))::INT AS pref
    FROM rel JOIN down USING (query_id) WHERE (query_id, chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM sel)),
  ext AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pref DESC, subj DESC, links DESC, pos) AS n
    FROM opt WHERE subj > 0 AND links > 0 QUALIFY n <= 2),
  al AS (SELECT query_id, chunk_id, content_hash, score, rank FROM sel
    UNION ALL SELECT query_id, chunk_id, content_hash, 0.0, 1000 + n FROM ext),
  ded AS (SELECT *, row_number() OVER (PARTITION BY query_id, content_hash ORDER BY rank) AS k FROM al)
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, chunk_id,
    round(score, 9) AS score FROM ded WHERE k = 1""", "R15 J13")
def provenance_bridge(spark, sf):
    rows = cut_lineage(bridge_columns(supplier_rows(spark, sf)))
    fused = cut_lineage(supplier_fused(rows))
    selected = fused.filter("rank <= 8")
    related = supplier_related(rows, fused).select(*fused.columns)
    return shown(selection.attach_bridges(selected, related))


@group.add(f"""{SUPPLIERS.replace("WITH ", "WITH RECURSIVE ", 1)}{RELATED}, sel AS MATERIALIZED (SELECT * FROM frow WHERE rank <= 8),
  free AS MATERIALIZED (SELECT * FROM rel WHERE (query_id, chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM sel)),
  fold(query_id, r, taken, pick, score) AS (SELECT DISTINCT query_id, 0::BIGINT, []::VARCHAR[], NULL::VARCHAR, 0.0::DOUBLE FROM sel UNION ALL
    SELECT f.query_id, f.r + 1, CASE WHEN p IS NULL THEN any_value(f.taken) ELSE list_append(any_value(f.taken), p) END, p, any_value(f.s) * 0.99::DOUBLE
    FROM (SELECT f.query_id, f.r, any_value(f.taken) AS taken, any_value(s.score) AS s,
        arg_min(c.chunk_id, (abs(c.ordinal - s.ordinal), c.ordinal < s.ordinal, c.pos)) AS p
      FROM fold f JOIN sel s ON s.query_id = f.query_id AND s.rank = f.r + 1 LEFT JOIN free c ON c.query_id = s.query_id
        AND c.document_id = s.document_id AND NOT list_contains(f.taken, c.chunk_id) AND length(trim(s.content)) < 180 AND len(f.taken) < 4
      GROUP BY f.query_id, f.r) f GROUP BY f.query_id, f.r, p),
  al AS (SELECT query_id, chunk_id, content_hash, score, rank FROM sel UNION ALL SELECT d.query_id, pick, content_hash, d.score, 1000 + r
    FROM fold d JOIN free c ON c.query_id = d.query_id AND c.chunk_id = pick),
  ded AS (SELECT *, row_number() OVER (PARTITION BY query_id, content_hash ORDER BY rank) AS k FROM al)
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, chunk_id, round(score, 9) AS score FROM ded WHERE k = 1""", "R14 J14")
def neighbor_attach(spark, sf):
    rows = cut_lineage(supplier_rows(spark, sf))
    fused = cut_lineage(supplier_fused(rows))
    related = cut_lineage(supplier_related(rows, fused).select(*fused.columns))  # read twice
    return shown(selection.attach_neighbors(fused.filter("rank <= 8"), related, 4))


@group.add(f"""{SUPPLIERS}, pool AS MATERIALIZED (SELECT * FROM frow WHERE rank <= 30),
  o AS (SELECT query_id, chunk_id, price::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY price DESC, chunk_id) AS n FROM pool QUALIFY n <= 24),
  hit AS (SELECT query_id, min(rank) FILTER (contains(text, 'status r/')) AS a, min(rank) FILTER (contains(text, 'building')) AS b,
      min(rank) FILTER (contains(text, 'quantity 50 ')) AS c FROM pool GROUP BY 1),
  two AS (SELECT hit.*, coalesce(x.text, '') AS ta, CASE WHEN NOT contains(coalesce(x.text, ''), 'building') THEN b END AS b2
    FROM hit LEFT JOIN pool x ON x.query_id = hit.query_id AND x.rank = a),
  three AS (SELECT two.*, CASE WHEN NOT contains(ta || ' | ' || coalesce(y.text, ''), 'quantity 50 ') THEN c END AS c2
    FROM two LEFT JOIN pool y ON y.query_id = two.query_id AND y.rank = b2),
  forced AS (SELECT query_id, rank, place FROM (SELECT query_id, a AS rank, 1 AS place FROM three UNION ALL SELECT query_id, b2, 2 FROM three
    UNION ALL SELECT query_id, c2, 3 FROM three) WHERE rank IS NOT NULL),
  al AS (SELECT query_id, chunk_id, score, place FROM forced JOIN pool USING (query_id, rank)
    UNION ALL SELECT o.query_id, o.chunk_id, o.score, 10 + n FROM o WHERE (query_id, chunk_id) NOT IN (
      SELECT (pool.query_id, chunk_id) FROM forced JOIN pool USING (query_id, rank)))
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank, chunk_id, round(score, 9) AS score FROM al
  QUALIFY rank <= 24""", "R12")
def signal_coverage(spark, sf):
    pool = supplier_fused(supplier_rows(spark, sf)).filter("rank <= 30").withColumn(
        "cover_signals", F.array(F.lit("status r/"), F.lit("building"), F.lit("quantity 50 ")))
    pool = cut_lineage(pool)
    ranked = fusion.rerank_by(pool, F.desc("price"), "chunk_id").filter("rank <= 24").select(
        "query_id", "chunk_id", F.col("price").cast("double").alias("score"), "rank")
    return shown(selection.cover_signals(pool, ranked, 24))


@group.add(f"""{SUPPLIERS}, b AS (SELECT query_id, chunk_id, rank FROM fused WHERE rank <= 12),
  p AS (SELECT query_id, chunk_id, r AS rank FROM c1 WHERE r <= 12),
  u AS (SELECT query_id, chunk_id, min(place) AS place FROM (SELECT query_id, chunk_id, rank AS place FROM b
    UNION ALL SELECT query_id, chunk_id, 100 + rank FROM p) GROUP BY ALL)
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank, chunk_id FROM u
  QUALIFY rank <= 16""", "R3 R21")
def evidence_channels(spark, sf):
    rows = supplier_rows(spark, sf)
    planned = supplier_channel(rows, 0, "quantity").filter("rank <= 12").withColumn("score", F.lit(0.0))
    baseline = supplier_fused(rows).filter("rank <= 12")
    return fusion.merge_channels(baseline, planned.select(*baseline.columns), 16).select(*SHOWN)


@group.add(f"""{SUPPLIERS}, b AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank
    FROM frow WHERE contains(text, 'status r/') AND quantity >= 44),
  thin AS (SELECT query_id FROM (SELECT DISTINCT query_id FROM sup) LEFT JOIN b USING (query_id) GROUP BY 1 HAVING count(chunk_id) < 3),
  f AS (SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + r) * 1.08::DOUBLE AS score, r AS rank FROM c1 JOIN thin USING (query_id)),
  u AS (SELECT *, 0 AS side FROM b UNION ALL SELECT f.*, 1 FROM f
    WHERE (query_id, chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM b))
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, side, rank) AS rank, chunk_id,
    round(score, 9) AS score FROM u""", "R16")
def draft_fallback(spark, sf):
    """Suppliers with fewer than three large returns also get their other rows."""
    rows = cut_lineage(supplier_rows(spark, sf))
    strict = fusion.rerank_by(supplier_fused(rows).filter(F.contains("text", F.lit("status r/")) & (F.col("quantity") >= 44)), "rank")
    thin = fusion.thin_questions(rows.select("query_id").distinct(), strict)
    fallback = fusion.rrf(supplier_channel(rows.join(thin, "query_id", "left_semi"), 0, "quantity"))
    return shown(fusion.union_keep_first(strict, fallback.select(*strict.columns)))


@group.add(covers="R20 R17 R22 U1 U3 V5 V7 V8 L7 L8")
def evidence_search(spark, sf):
    """The whole retrieval plan for all questions at once."""
    index = cut_lineage(retrieve.embed_index(lexical.search_projection(
        retrieve.with_source_columns(kb.note_chunks(spark, sf))), CONFIG))
    found = retrieve.search(index, kb.questions(spark, sf), CONFIG)
    return found.select("query_id", "rank", "chunk_id", "document_id", "filename", "lifecycle_status",
                        F.round("score", 6).alias("score"))
