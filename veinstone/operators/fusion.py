"""Fusing ranked channels and gating what they return.

Rows are (query_id, chunk_id, score, rank, ...source columns).  Every order is
explicit: score, then the place where a row was first seen.  The rows of one
question are bounded by the channel limits, so windows per question are small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veinstone import fixed_values as fv
from veinstone.functions import text as tx

def per_query():
    return Window.partitionBy("query_id")


def rerank_by(rows: DataFrame, *order) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(per_query().orderBy(*order)))


def _sources(rows: DataFrame, *keys: str) -> list[str]:
    return [c for c in rows.columns if c not in {*keys, "score", "rank", "channel"}]


def rrf(hits: DataFrame) -> DataFrame:
    """Reciprocal rank fusion of (query_id, channel, rank, chunk_id, ...) hits.

    Terms are added in channel order; approved chunks are boosted once.
    """
    sources = _sources(hits, "query_id", "chunk_id")
    fused = hits.groupBy("query_id", "chunk_id").agg(
        F.array_sort(F.collect_list(F.struct("channel", "rank"))).alias("_seen"),
        *[F.any_value(c).alias(c) for c in sources])
    total = F.aggregate("_seen", F.lit(0.0), lambda acc, s: acc + 1.0 / (fv.RRF_K + s["rank"]))
    boost = F.when(F.col("lifecycle_status") == "approved", fv.APPROVED_BOOST).otherwise(1.0)
    scored = fused.withColumn("score", total * boost).withColumn("_first", F.col("_seen")[0])
    return rerank_by(scored, F.desc("score"), "_first").drop("_seen", "_first")


def weighted_merge(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Add secondary scores at weight 0.92; rows keep their first-seen place in ties."""
    sides = primary.withColumn("_side", F.lit(0)).unionByName(
        secondary.withColumn("_side", F.lit(1)).withColumn("score", F.col("score") * fv.SECONDARY_WEIGHT))
    sources = _sources(primary, "query_id", "chunk_id")
    merged = sides.groupBy("query_id", "chunk_id").agg(
        (F.coalesce(F.sum(F.when(F.col("_side") == 0, F.col("score"))), F.lit(0.0))
         + F.coalesce(F.sum(F.when(F.col("_side") == 1, F.col("score"))), F.lit(0.0))).alias("score"),
        F.min(F.struct("_side", "rank")).alias("_first"),
        *[F.any_value(c).alias(c) for c in sources])
    return rerank_by(merged, F.desc("score"), "_first").drop("_first")


def merge_channels(baseline: DataFrame, planned: DataFrame, limit: int) -> DataFrame:
    """Baseline evidence first, then what planning adds; one row per chunk, capped."""
    both = baseline.withColumn("_side", F.lit(0)).unionByName(planned.withColumn("_side", F.lit(1)))
    first = Window.partitionBy("query_id", "chunk_id").orderBy("_side", "rank")
    unique = both.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") == 1)
    return rerank_by(unique, "_side", "rank").filter(F.col("rank") <= limit).drop("_side", "_n")


def thin_questions(asked: DataFrame, rows: DataFrame, least: int = fv.FALLBACK_BELOW) -> DataFrame:
    """Questions with fewer than ``least`` rows; one without any row is one of them."""
    enough = rows.groupBy("query_id").count().filter(F.col("count") >= least).select("query_id")
    return asked.join(enough, "query_id", "left_anti")


def union_keep_first(rows: DataFrame, fallback: DataFrame) -> DataFrame:
    """Rows plus fallback rows of unseen chunks, by score."""
    both = rows.withColumn("_side", F.lit(0)).unionByName(fallback.withColumn("_side", F.lit(1)))
    first = Window.partitionBy("query_id", "chunk_id").orderBy("_side")
    unique = both.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") == 1)
    return rerank_by(unique, F.desc("score"), "_side", F.col("rank")).drop("_side", "_n")


def boost_anchors(rows: DataFrame, anchors: str = "anchors", text: str = "text") -> DataFrame:
    """Chunks that contain an anchor count 1.35 times."""
    hit = tx.contains_any(F.col(text), F.col(anchors))
    boosted = rows.withColumn("score", F.when(hit, F.col("score") * fv.ANCHOR_BOOST).otherwise(F.col("score")))
    return rerank_by(boosted, F.desc("score"), F.col("rank"))


def grounded_only(rows: DataFrame, signals: str, text: str = "text") -> DataFrame:
    """Drop every row of a question none of whose subject signals occurs anywhere."""
    hit = F.max(tx.contains_any(F.col(text), F.col(signals))).over(per_query())
    return rows.withColumn("_grounded", hit).filter(
        (F.size(signals) == 0) | F.col("_grounded")).drop("_grounded")


def dedupe_content(rows: DataFrame) -> DataFrame:
    """Best-ranked row per content; rows without a hash fall back to their id."""
    same = Window.partitionBy("query_id", F.coalesce("content_hash", "chunk_id")).orderBy("rank")
    unique = rows.withColumn("_n", F.row_number().over(same)).filter(F.col("_n") == 1).drop("_n")
    return rerank_by(unique, "rank")


def identifier_gate(rows: DataFrame, wanted: str = "query_codes", linked: str = "linked",
                    text: str = "text") -> DataFrame:
    """Questions that name codes keep rows with one of them or a linked one, and
    keep nothing unless every named code is covered."""
    found = F.filter(wanted, lambda c: F.contains(F.col(text), c))
    covered = F.size(F.array_distinct(F.flatten(F.collect_list(found).over(per_query()))))
    checked = rows.withColumn("_found", found).withColumn("_covered", covered)
    free = F.size(wanted) == 0
    kept = checked.filter(free | (
        (F.col("_covered") == F.size(wanted))
        & ((F.size("_found") > 0) | tx.contains_any(F.col(text), F.col(linked)))))
    return rerank_by(kept.drop("_found", "_covered"), "rank")


def entity_preference(rows: DataFrame, subjects: str = "subjects", linked: str = "linked",
                      text: str = "text") -> DataFrame:
    """One specific subject: only rows that contain it or a linked code."""
    subject = F.get(subjects, 0)
    free = (F.size(subjects) != 1) | subject.isin(*fv.GENERIC_SUBJECTS)
    kept = rows.filter(free | F.contains(F.col(text), subject)
                       | tx.contains_any(F.col(text), F.col(linked)))
    return rerank_by(kept, "rank")


def linked_references(rows: DataFrame, signals: str = "signals", wanted: str = "query_codes",
                      text: str = "text", limit: int = fv.MAX_LINKED) -> DataFrame:
    """(query_id, linked): codes and controlled aliases found in the subject's rows.

    The first 8 rows containing a signal are read in rank order, codes before
    aliases; the question's own codes are left out.
    """
    anchors = rerank_by(rows.filter(tx.contains_any(F.col(text), F.col(signals))), "rank").filter(
        F.col("rank") <= fv.MAX_ANCHOR_ROWS)
    named = F.transform(tx.identifiers(F.col(text)), lambda v: F.upper(v))
    aliases = tx.controlled_aliases(F.concat_ws("\n", "heading_path", "content"))
    listed = anchors.select("query_id", "rank", wanted,
                            F.posexplode(F.concat(named, aliases)).alias("_pos", "value"))
    fresh = listed.withColumn("_key", tx.casefold(F.col("value"))).filter(
        (F.col("value") != "") & ~F.array_contains(wanted, F.col("_key")))
    first = fresh.groupBy("query_id", "_key").agg(
        F.min(F.struct("rank", "_pos", "value")).alias("_first"))
    kept = first.withColumn("_n", F.row_number().over(per_query().orderBy("_first"))).filter(
        F.col("_n") <= limit)
    return kept.groupBy("query_id").agg(F.transform(
        F.array_sort(F.collect_list("_first")), lambda f: f["value"]).alias("linked"))
