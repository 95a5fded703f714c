"""Visibility rules: who may see which chunk, written once and used everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinstone.cluster import join_small


def status_clause(statuses: list[str]) -> Column:
    """Approved rows must also be current; no status at all matches nothing."""
    clause = F.lit(False)
    if "approved" in statuses:
        clause = (F.col("lifecycle_status") == "approved") & F.col("is_current")
    others = sorted({s for s in statuses if s != "approved"})
    if others:
        clause = clause | F.col("lifecycle_status").isin(others)
    return clause


def is_searchable() -> Column:
    return (F.col("technical_status") == "searchable") & ~F.col("is_deleted")


def eligible() -> Column:
    """Searchable, not deleted, and a draft or the current approved version."""
    return is_searchable() & status_clause(["approved", "draft"])


def visible(rows: DataFrame, principals: list[str] | None = None,
            acl: DataFrame | None = None) -> DataFrame:
    """Public documents, plus those a principal may read."""
    public = F.col("visibility") == "public"
    if not principals or acl is None:
        return rows.filter(public)
    readable = acl.filter(
        (F.col("permission") == "read") & F.col("principal_id").isin(sorted(set(principals)))
    ).select("document_id").distinct().withColumn("_readable", F.lit(True))
    return join_small(rows, readable, "document_id", "left").filter(
        public | F.coalesce("_readable", F.lit(False))).drop("_readable")


def in_scope(rows: DataFrame, statuses: list[str], project_ids: list[str] | None = None,
             principals: list[str] | None = None, acl: DataFrame | None = None) -> DataFrame:
    """Rows a search may return.  Applied below every rank and limit."""
    kept = rows.filter(status_clause(statuses) & is_searchable())
    if project_ids:
        kept = kept.filter(F.col("project_id").isin(sorted(set(project_ids))))
    return visible(kept, principals, acl)
