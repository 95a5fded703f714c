"""The retrieval plan: from a batch of questions to ranked evidence.

All questions run together.  Each wave of searches is one pass over the stored
index, whatever the number of questions and sub-queries; after a wave only the
bounded hit lists (at most a few hundred rows per question) move on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veinstone import fixed_values as fv
from veinstone.cluster import cut_lineage, join_small
from veinstone.config import EngineConfig
from veinstone.functions import questions as qs
from veinstone.functions import text as tx
from veinstone.functions.vectors import embedding_or_error, feature_hash, feature_hash_embedding
from veinstone.operators import fusion, selection
from veinstone.operators.lexical import lexical_search, top_per_query
from veinstone.operators.rerank import rerank
from veinstone.operators.scope import in_scope
from veinstone.operators.vector import fingerprint_gate, vector_search

SOURCE = ["document_id", "version_id", "project_id", "filename", "lifecycle_status",
          "document_type", "version_label", "heading_path", "page_number", "sheet_name",
          "cell_range", "content", "content_hash", "ordinal"]
EVIDENCE = ["query_id", "rank", "chunk_id", "document_id", "version_id", "project_id", "filename",
            "lifecycle_status", "document_type", "content", "heading_path", "page_number",
            "sheet_name", "cell_range", "version_label", "score"]
Scope = Callable[[list[str]], DataFrame]


def embed_index(index: DataFrame, config: EngineConfig) -> DataFrame:
    """Add the content vector and the space it belongs to."""
    return index.withColumns({
        "embedding": feature_hash_embedding(F.col("content"), config.embedding_dimensions),
        "embedding_fingerprint": F.lit(config.embedding_fingerprint)})


def with_source_columns(index: DataFrame) -> DataFrame:
    """Add provenance columns a simple base does not have."""
    types = {"page_number": "int", "sheet_name": "string", "cell_range": "string",
             "version_label": "string"}
    return index.withColumns({c: F.lit(None).cast(t) for c, t in types.items()
                              if c not in index.columns})


def search(index: DataFrame, asked: DataFrame, config: EngineConfig = EngineConfig(),
           acl: DataFrame | None = None, principals: list[str] | None = None,
           replies: str | None = None, planned: bool = False) -> DataFrame:
    """Evidence rows for ``asked`` (query_id, question[, project_ids]).

    With ``planned`` each question is also searched by its retrieval plan
    (``replies`` names a column of model replies; without one the plan is
    deterministic) and the plan's evidence follows the baseline's.
    """
    def scope(statuses: list[str]) -> DataFrame:
        return in_scope(index, statuses, None, principals, acl)

    baseline = search_once(scope, asked, config)
    if not planned:
        return baseline
    reply = F.col(replies) if replies else None
    with_plan = asked.withColumn("plan", qs.query_plan(F.col("question"), reply))
    extra = search_once(scope, with_plan, config)
    k = config.evidence_top_k
    return fusion.merge_channels(baseline, extra, max(2 * k, k + 4))


def search_once(scope: Scope, asked: DataFrame, config: EngineConfig) -> DataFrame:
    asked = cut_lineage(_analyse(asked))
    approved = scope(["approved"])
    fused = _first_wave(approved, asked, config)
    if "plan" in asked.columns:
        fused = _ask(fused, asked, ["anchors", "subject_anchors"])
        fused = fusion.grounded_only(fusion.boost_anchors(fused), "subject_anchors")
        fused = fused.drop("anchors", "subject_anchors")
    fused = cut_lineage(fused)
    linked = fusion.linked_references(_ask(fused, asked, ["signals", "query_codes"]))
    asked = cut_lineage(asked.join(linked, "query_id", "left").withColumns({
        "linked_shown": F.coalesce("linked", F.array()),
        "linked": qs.fold_all(F.coalesce("linked", F.array()))}))
    fused = _second_wave(approved, fused, asked, config)
    fused = cut_lineage(_fallback(scope, fused, asked, config))

    fused = fusion.dedupe_content(_ask(fused, asked, QUESTION_COLUMNS))
    fused = fusion.entity_preference(fusion.identifier_gate(fused))
    fused = cut_lineage(fused)
    related = cut_lineage(_ask(_related(approved, fused, config), asked, QUESTION_COLUMNS))
    pool = cut_lineage(selection.candidate_pool(
        fused, related.select(*fused.columns), config.rerank_candidates, config.evidence_top_k))
    return _select(pool, related, asked, config).select(*EVIDENCE)


QUESTION_COLUMNS = ["question_folded", "query_codes", "subjects", "signals", "bridge_signals",
                    "cover_signals", "linked"]


def _analyse(asked: DataFrame) -> DataFrame:
    """Everything derived from the question alone, once per question."""
    question = tx.normalize_query(F.col("question"))
    keep = [c for c in ("project_ids", "plan") if c in asked.columns]
    found = asked.select("query_id", *keep, question.alias("question")).withColumns({
        "about": qs.question_subjects(F.col("question")),
        "named": qs.question_signals(F.col("question")),
        "question_folded": tx.casefold(F.col("question"))})
    codes = F.concat(tx.identifiers(F.col("question")), tx.acronyms(F.col("question")))

    def folded(values):
        return F.array_distinct(qs.fold_all(values))

    if "plan" in asked.columns:
        found = found.withColumns({"_all": qs.anchor_signals(F.col("plan"), "all"),
                                   "_of_subjects": qs.anchor_signals(F.col("plan"), "subjects")})
        anchors, of_subjects = folded(F.col("_all")), folded(F.col("_of_subjects"))
        focus, context = F.slice(F.col("plan.retrieval_queries"), 1, 4), qs.plan_context(F.col("plan"))
    else:
        anchors = of_subjects = F.array().cast("array<string>")
        focus = F.filter(F.array(F.array_join("about", " ")), lambda v: v != "")
        context = F.lit("")
    return found.withColumns({
        "query_codes": folded(codes), "subjects": folded(F.col("about")),
        "anchors": anchors, "subject_anchors": of_subjects,
        "signals": F.when(F.size(anchors) > 0, anchors).otherwise(folded(F.col("named"))),
        "own_signals": folded(F.col("named")),
        "bridge_signals": F.filter(folded(F.concat("about", "named")), lambda v: F.length(v) >= 2),
        "cover_signals": folded(F.concat(F.col("named"), anchors)),
        "focus": focus, "context": context,
    }).drop("about", "named", "_all", "_of_subjects")


def _ask(rows: DataFrame, asked: DataFrame, columns: list[str]) -> DataFrame:
    return join_small(rows, asked.select("query_id", *columns), "query_id")


def _sub_queries(asked: DataFrame, texts) -> DataFrame:
    """(query_id = "parent#step", parent, step, text) for the non-empty texts."""
    scope = [c for c in asked.columns if c == "project_ids"]
    listed = asked.select(F.col("query_id").alias("parent"), *scope,
                          F.posexplode(texts).alias("step", "text")).filter(F.col("text") != "")
    return listed.withColumn("query_id", F.concat_ws("#", "parent", "step"))


def _channels(index: DataFrame, sub: DataFrame, config: EngineConfig, with_vector=None) -> DataFrame:
    """Hits of both channels: (query_id, channel, rank, chunk_id, source columns)."""
    scope = [c for c in sub.columns if c == "project_ids"]
    k, columns = config.retrieval_top_k, ["query_id", "channel", "rank", "chunk_id", *SOURCE]
    narrow = sub.select("query_id", *scope, "text")
    lexical = lexical_search(index.drop("embedding"), narrow, k).withColumn("channel", F.lit(0))
    hits = lexical.select(*columns)
    if config.vector_enabled:
        asked = narrow if with_vector is None else narrow.join(with_vector, "query_id", "left_semi")
        vectors = asked.withColumn("vector", feature_hash_embedding(
            tx.normalize_query(F.col("text")), config.embedding_dimensions)).drop("text")
        space = fingerprint_gate(index, config.embedding_fingerprint)
        found = vector_search(space.select("chunk_id", "embedding", *SOURCE), cut_lineage(vectors), k,
                              config.vector_min_similarity)
        hits = hits.unionByName(found.withColumn("channel", F.lit(1)).select(*columns))
    return hits


def two_channels(index: DataFrame, asked: DataFrame, config: EngineConfig, embed=feature_hash, k: int | None = None) -> DataFrame:
    """Fused hits of ``asked`` (query_id, text) with the mode each question was answered in.

    Columns: query_id, rank, chunk_id, score, mode, error. A question whose embedding fails is an error
    row of its batch: it goes on with the lexical channel alone (mode ``lexical_only``), the others and
    the job are not touched. ``index`` is in scope and holds the vectors of the same model.
    """
    k = k or config.retrieval_top_k
    tried = cut_lineage(asked.select("query_id", "text", embedding_or_error(
        tx.normalize_query(F.col("text")), config.embedding_dimensions, embed).alias("e")))
    columns = ["rank", "chunk_id", "lifecycle_status"]
    lexical = lexical_search(index.drop("embedding"), tried.select("query_id", "text"), k)
    hits = lexical.select("query_id", F.lit(0).alias("channel"), *columns)
    able = tried.filter(F.col("e.error").isNull() & F.col("e.vector").isNotNull()).select("query_id", F.col("e.vector").alias("vector"))
    found = vector_search(fingerprint_gate(index, config.embedding_fingerprint).select(
        "chunk_id", "lifecycle_status", "embedding"), able, k, config.vector_min_similarity)
    hits = hits.unionByName(found.select("query_id", F.lit(1).alias("channel"), *columns))
    mode = tried.select("query_id", F.when(F.col("e.error").isNull(), "hybrid").otherwise("lexical_only").alias("mode"),
                        F.col("e.error").alias("error"))
    return join_small(fusion.rrf(hits), mode, "query_id")


def _parent(rows: DataFrame, sub: DataFrame) -> DataFrame:
    return join_small(rows, sub.select("query_id", "parent", "step"), "query_id").drop(
        "query_id").withColumnRenamed("parent", "query_id")


def _with_text(rows: DataFrame) -> DataFrame:
    return rows.withColumn("text", tx.searchable(
        F.col("filename"), F.col("heading_path"), F.lit(""), F.col("content")))


def _first_wave(index, asked, config) -> DataFrame:
    """Question and focus queries in one pass; focus lists merge in order."""
    spelled = F.arrays_zip(F.col("focus").alias("f"), qs.fold_all(F.col("focus")).alias("g"))
    usable = F.transform(F.filter(spelled, lambda z: z["g"] != F.col("question_folded")), lambda z: z["f"])
    texts = F.concat(F.array("question"), usable)
    sub = cut_lineage(_sub_queries(asked, texts))
    fused = cut_lineage(_with_text(_parent(fusion.rrf(_channels(index, sub, config)), sub)))
    merged = fused.filter(F.col("step") == 0).drop("step")
    steps = sub.agg(F.max("step")).first()[0] or 0
    for step in range(1, steps + 1):  # at most four focus queries
        merged = fusion.weighted_merge(merged, fused.filter(F.col("step") == step).drop("step"))
    return merged


def _second_wave(index, fused, asked, config) -> DataFrame:
    """Each linked code alone, and the question extended by all of them."""
    linked = asked.filter(F.size("linked") > 0)
    if linked.isEmpty():
        return fused
    exact = F.array_distinct(F.filter(F.transform("linked_shown", lambda v: F.upper(v)),
                                      lambda v: v.rlike("(?i)^" + fv.IDENTIFIER + "$")))
    expanded = F.concat_ws("\n", "question", F.nullif("context", F.lit("")), F.concat(
        F.lit(fv.LINKED_PREFIX), F.array_join("linked_shown", " ")))
    sub = cut_lineage(_sub_queries(linked, F.concat(F.array(expanded), exact)))
    hits = cut_lineage(_parent(_channels(
        index, sub, config, sub.filter(F.col("step") == 0).select("query_id")), sub))
    per_code = hits.filter((F.col("step") > 0) & (F.col("channel") == 0)
                           & (F.col("rank") <= max(4, config.evidence_top_k)))
    order = Window.partitionBy("query_id").orderBy("step")
    per_code = per_code.withColumn("channel", F.dense_rank().over(order)).filter(
        F.col("channel") <= fv.MAX_ID_CHANNELS)
    merged = fusion.weighted_merge(fused, _with_text(fusion.rrf(per_code.drop("step"))))
    whole = fusion.rrf(hits.filter(F.col("step") == 0).drop("step"))
    return fusion.weighted_merge(merged, _with_text(whole))


def _fallback(scope, fused, asked, config) -> DataFrame:
    """Questions with fewer than three rows may also use drafts."""
    fused = cut_lineage(fused)
    thin = cut_lineage(fusion.thin_questions(asked, fused))
    if "plan" in asked.columns:  # ungrounded questions stay empty
        thin = thin.join(fused.select("query_id").distinct(), "query_id", "left_semi").unionByName(
            thin.filter(F.size("plan.subjects") == 0)).dropDuplicates(["query_id"])
    if thin.isEmpty():
        return fused
    sub = cut_lineage(_sub_queries(thin, F.array("question")))
    drafts = _parent(fusion.rrf(_channels(scope(["approved", "draft"]), sub, config)), sub)
    return fusion.union_keep_first(fused, _with_text(drafts.drop("step")))


def _related(index, fused, config) -> DataFrame:
    """Chunks of the first documents found, in (document, ordinal) order."""
    k = config.evidence_top_k
    documents = fused.groupBy("query_id", "document_id").agg(F.min("rank").alias("_place"))
    first = fusion.rerank_by(documents, "_place").filter(F.col("rank") <= 2 * k)
    counted = first.withColumn("_n", F.count("*").over(fusion.per_query())).select(
        "query_id", "document_id", "_n")
    chunks = join_small(index.select("chunk_id", *SOURCE), cut_lineage(counted), "document_id")
    most = max(4 * config.rerank_candidates, 24 * k)
    listed = top_per_query(chunks, most, "document_id", "ordinal", "chunk_id")
    allowed = F.greatest(F.lit(4 * config.rerank_candidates), 12 * F.col("_n"))
    kept = listed.filter(F.col("rank") <= allowed).drop("_n")
    return _with_text(kept.withColumn("score", F.lit(0.0)))


def _select(pool, related, asked, config) -> DataFrame:
    k = config.evidence_top_k
    if config.rerank_enabled:
        shown = F.when(F.size("linked_shown") > 0, F.concat(
            F.lit(fv.LINKED_PREFIX), F.array_join("linked_shown", " ")))
        line = asked.select("query_id", "own_signals", F.concat_ws(
            "\n", "question", F.nullif("context", F.lit("")), shown).alias("rerank_query"))
        signals = line.withColumn("rerank_signals", qs.fold_all(qs.question_signals(F.col("rerank_query"))))
        ranked = rerank(join_small(pool, signals, "query_id"), "rerank_query", "rerank_signals",
                        3 * k, config.embedding_dimensions)
        ranked = selection.cover_signals(pool, cut_lineage(
            ranked.select("query_id", "chunk_id", "score", "rank")), 3 * k)
        chosen = selection.diversify_documents(ranked, k)
    else:
        chosen = pool.filter(F.col("rank") <= k)
    chosen = cut_lineage(chosen.select(*pool.columns))
    near = selection.attach_neighbors(chosen, related.select(*pool.columns), max(1, k // 2))
    return selection.attach_bridges(cut_lineage(near), related.select(*pool.columns))
