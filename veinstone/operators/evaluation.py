"""Retrieval and answer metrics.

A question's evidence is bounded by the retrieval limits, so per-question
lists are small; everything above them is an ordinary aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinstone.functions import text as tx


def outcomes(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per question with its rank and checks.

    ``questions``: query_id, expected_status, expected_files, facts and
    optionally expected_version, expected_sheet, expected_range.
    ``evidence``: query_id, rank, filename, content, version_label,
    sheet_name, cell_range.
    """
    listed = evidence.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(
        "rank", "filename", "content", "version_label", "sheet_name", "cell_range"))).alias("_seen"))
    joined = questions.join(listed, "query_id", "left").withColumn(
        "_seen", F.coalesce("_seen", F.expr("array()").cast(listed.schema["_seen"].dataType)))
    files = joined.withColumn("_files", F.transform("_seen", lambda e: e["filename"]))
    place = F.transform("expected_files", lambda f: F.array_position("_files", f))
    found = (F.size("expected_files") > 0) & ~F.exists(place, lambda p: p == 0)
    text = F.array_join(F.transform("_seen", lambda e: e["content"]), "\n")
    ranked = files.withColumns({
        "file_rank": F.when(found, F.array_max(place)),
        "n_evidence": F.size("_seen"), "_text": tx.casefold(text),
        "_facts": tx.casefold(F.array_join("facts", "\x00"))})
    answerable = F.col("expected_status") == "answered"
    first = F.get(F.filter("_seen", lambda e: e["filename"] == F.get("expected_files", F.lit(0))), F.lit(0))
    checks = {
        "abstained": F.when(F.col("expected_status") == "insufficient_evidence", F.size("_seen") == 0),
        "facts_covered": F.when(answerable, F.forall(
            F.split("_facts", "\x00"), lambda f: tx.contains_fact(F.col("_text"), f))),
    }
    if "expected_version" in questions.columns:
        checks["approved_first"] = F.when(
            F.col("expected_version").isNotNull() & first.isNotNull(),
            first["version_label"].eqNullSafe(F.col("expected_version")))
    if "expected_sheet" in questions.columns:
        checks["located"] = F.when(F.col("expected_sheet").isNotNull(), F.exists("_seen", lambda e: (
            F.array_contains("expected_files", e["filename"])
            & e["sheet_name"].eqNullSafe(F.col("expected_sheet"))
            & e["cell_range"].eqNullSafe(F.col("expected_range")))))
    return ranked.withColumns(checks).drop("_seen", "_files", "_text", "_facts")


def share(flag: Column) -> Column:
    """Mean of a flag over its non-null rows, four digits."""
    return F.round(F.avg(flag.cast("double")), 4)


def recall_report(rows: DataFrame, *by: str) -> DataFrame:
    """recall@1/5/10 over answerable questions, MRR (0 for misses) and the rates."""
    answerable = F.col("expected_status") == "answered"
    within = [F.round(F.count_if(F.col("file_rank") <= k) / F.count_if(answerable), 4)
              .alias(f"recall_at_{k}") for k in (1, 5, 10)]
    expected = F.size("expected_files") > 0
    rates = [share(F.col(c)).alias(name) for c, name in (
        ("abstained", "abstention_rate"), ("facts_covered", "fact_coverage"),
        ("approved_first", "approved_precedence"), ("located", "location_accuracy"))
        if c in rows.columns]
    return rows.groupBy(*by).agg(
        F.count("*").alias("n_questions"), *within,
        F.round(F.avg(F.when(expected, F.coalesce(1 / F.col("file_rank"), F.lit(0.0)))), 4).alias("mrr"),
        *rates)


def gates(report: DataFrame) -> DataFrame:
    """Acceptance checks; a rate that does not apply passes."""
    def least(column: str, bound: float) -> Column:
        return F.coalesce(F.col(column) >= bound, F.lit(True)) if column in report.columns else F.lit(True)

    checks = {"recall_ok": least("recall_at_10", 0.90), "abstention_ok": least("abstention_rate", 0.90),
              "location_ok": least("location_accuracy", 0.90), "facts_ok": least("fact_coverage", 0.95)}
    if "p95" in report.columns:
        checks["latency_ok"] = F.col("p95") <= 2000
    checked = report.withColumns(checks)
    passed = F.lit(True)
    for name in checks:
        passed = passed & F.col(name)
    return checked.withColumn("passed", passed)


def isolation(evidence: DataFrame, questions: DataFrame) -> DataFrame:
    """Per question: does all of its evidence lie in its own project?"""
    judged = evidence.join(questions.select("query_id", F.col("project_id").alias("_own")), "query_id")
    return judged.groupBy("query_id").agg(
        F.count("*").alias("n_evidence"),
        F.min(F.col("project_id") == F.col("_own")).alias("isolated"))


def answer_checks(responses: DataFrame, questions: DataFrame, exact_sources: bool = False) -> DataFrame:
    """status, citation and content flags of answers (one row per question).

    ``responses``: query_id, status, answer, source_files.  With
    ``exact_sources`` no other file may be cited.
    """
    joined = questions.join(responses, "query_id")
    missing = F.size(F.array_except("expected_files", "source_files"))
    other = F.size(F.array_except("source_files", "expected_files"))
    cited = (missing == 0) & (other == 0) if exact_sources else missing == 0
    answer, facts = tx.casefold(F.col("answer")), tx.casefold(F.array_join("facts", "\x00"))
    prepared = joined.withColumns({"_answer": answer, "_facts": facts})
    return prepared.withColumns({
        "status_ok": F.col("status") == F.col("expected_status"),
        "citation_ok": F.when(F.size("expected_files") > 0, cited).otherwise(F.size("source_files") == 0),
        "content_ok": (F.size("facts") == 0) | F.forall(
            F.split("_facts", "\x00"), lambda f: tx.contains_fact(F.col("_answer"), f)),
    }).drop("_answer", "_facts")


def document_hits(responses: DataFrame, questions: DataFrame) -> DataFrame:
    """Share of questions whose cited documents overlap the expected ones."""
    joined = questions.filter(F.size("expected_documents") > 0).join(responses, "query_id")
    return joined.agg(F.count("*").alias("n_questions"), share(
        F.arrays_overlap("expected_documents", "cited_documents")).alias("hit_rate"))


def phrasing_checks(cases: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per phrasing: required terms in the evidence, or none where none is expected."""
    joined = evidence.groupBy("query_id").agg(
        F.array_join(F.array_sort(F.collect_list("content")), "\n").alias("_text"))
    judged = cases.join(joined, "query_id", "left")
    text = tx.casefold(F.coalesce("_text", F.lit("")))
    wanted = tx.casefold(F.array_join("required_terms", "\x00"))
    prepared = judged.withColumns({"_folded": text, "_wanted": wanted})
    return prepared.withColumn("passed", F.when(F.col("expect_evidence"), F.col("_text").isNotNull() & F.forall(
        F.split("_wanted", "\x00"), lambda t: F.contains(F.col("_folded"), t))).otherwise(
            F.col("_text").isNull())).drop("_text", "_folded", "_wanted")
