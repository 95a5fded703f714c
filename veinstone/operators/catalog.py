"""Documents, versions and their lifecycle as set operations.

State changes return the new rows (and the events they emit); storing them is
the caller's single write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinstone.cluster import in_parts, join_small
from veinstone.functions import text as tx
from veinstone.operators.scope import eligible, is_searchable


# ------------------------------------------------------------ registration
def file_suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1))


def register(uploads: DataFrame, documents: DataFrame, versions: DataFrame,
             jobs: DataFrame) -> DataFrame:
    """Classify uploads (project_id, logical_key?, filename, sha256) against the catalog.

    ``action``: new_document, new_version, or duplicate of (document, sha256);
    ``restore`` undeletes the document, ``requeue`` asks for a fresh job.
    """
    key = F.btrim(F.coalesce("logical_key", F.regexp_extract("filename", r"([^/]*)$", 1)))
    asked = uploads.withColumn("logical_key", key)
    known = asked.join(documents.select("project_id", "logical_key", "document_id", "is_deleted"),
                       ["project_id", "logical_key"], "left")
    with_version = known.join(
        versions.select("document_id", "sha256", "version_id", "technical_status"),
        ["document_id", "sha256"], "left")
    last_job = jobs.groupBy("version_id").agg(F.max_by("status", "created_at").alias("last_job"))
    judged = with_version.join(last_job, "version_id", "left")
    duplicate = F.col("version_id").isNotNull()
    return judged.withColumns({
        "action": F.when(duplicate, "duplicate").when(
            F.col("document_id").isNotNull(), "new_version").otherwise("new_document"),
        "restore": F.coalesce("is_deleted", F.lit(False)),
        "requeue": ~duplicate | F.col("last_job").isNull() | (F.col("last_job") == "failed")
        | F.col("technical_status").isin("deleted", "failed_final")})


def unique_logical_keys(documents: DataFrame) -> DataFrame:
    """Suffix every logical key but the oldest of its project with ``#id``.

    The oldest row is an aggregate, so no project's rows meet in one task.
    """
    first = documents.groupBy("project_id", "logical_key").agg(
        F.min(F.struct("created_at", "document_id"))["document_id"].alias("_first"),
        F.count("*").alias("_n")).filter(F.col("_n") > 1).drop("_n")
    marked = join_small(documents, first, ["project_id", "logical_key"], "left")
    later = F.col("_first").isNotNull() & (F.col("_first") != F.col("document_id"))
    return marked.withColumn("logical_key", F.when(
        later, F.concat_ws("#", "logical_key", "document_id")).otherwise(F.col("logical_key"))
    ).drop("_first")


# ------------------------------------------------------------------ versions
def latest_approved(versions: DataFrame) -> DataFrame:
    """(document_id, version_id) of each document's newest approved version."""
    return versions.filter(F.col("lifecycle_status") == "approved").groupBy("document_id").agg(
        F.max(F.struct("created_at", "version_id"))["version_id"].alias("version_id"))


def mark_current(versions: DataFrame) -> DataFrame:
    """``is_current`` on exactly the newest approved version of a document."""
    current = latest_approved(versions).select("version_id", F.lit(True).alias("_current"))
    return versions.join(current, "version_id", "left").withColumn(
        "is_current", F.coalesce("_current", F.lit(False))).drop("_current")


def current_violations(versions: DataFrame) -> DataFrame:
    """Documents with more than one current approved version; must be empty."""
    return versions.filter(F.col("is_current") & (F.col("lifecycle_status") == "approved")).groupBy(
        "document_id").agg(F.count("*").alias("n_current")).filter(F.col("n_current") > 1)


def approve(versions: DataFrame, version_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Searchable versions become approved; the indexer makes them current later."""
    chosen = versions.join(version_ids, "version_id", "left_semi").filter(
        F.col("technical_status") == "searchable")
    changed = chosen.withColumns({"lifecycle_status": F.lit("approved"), "is_current": F.lit(False)})
    return changed, _events(changed, "index_version")


def deprecate(versions: DataFrame, version_ids: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    changed = versions.join(version_ids, "version_id", "left_semi").withColumns({
        "lifecycle_status": F.lit("deprecated"), "is_current": F.lit(False), "effective_to": now})
    return changed, _events(changed, "delete_version")


def soft_delete(documents: DataFrame, versions: DataFrame,
                document_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flag documents and emit one delete event for each of their versions."""
    gone = documents.join(document_ids, "document_id", "left_semi").filter(~F.col("is_deleted"))
    flagged = gone.withColumn("is_deleted", F.lit(True))
    return flagged, _events(versions.join(gone, "document_id", "left_semi"), "delete_version")


def _events(versions: DataFrame, event_type: str) -> DataFrame:
    return versions.select(F.col("version_id").alias("aggregate_id"),
                           F.lit(event_type).alias("event_type"), F.lit("pending").alias("status"))


def version_history(versions: DataFrame, documents: DataFrame) -> DataFrame:
    """Versions of documents that are not deleted; callers order by created_at."""
    alive = documents.filter(~F.col("is_deleted")).select("document_id")
    return versions.join(alive, "document_id", "left_semi")


# ------------------------------------------------------------------- lookups
def catalog_rows(chunks: DataFrame, versions: DataFrame, documents: DataFrame) -> DataFrame:
    """chunks x versions x documents: the rows a search result is made of.

    The catalog side is joined first; both joins are on keys.
    """
    owned = versions.join(documents, "document_id")
    return chunks.join(owned, "version_id").withColumn("is_searchable", is_searchable())


def sources(rows: DataFrame) -> DataFrame:
    """What a citation link opens; nothing of deleted documents."""
    return rows.filter(~F.col("is_deleted"))


def file_as_of(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """``requests`` with the version whose file answers them, and nothing where there is none.

    A request (document_id, as_of, version_id) with a version gets that version of the document; one
    without gets the newest that was created up to ``as_of``, and the newest of all where that is null.
    Equal times are ordered by version id. Versions and requests are put in one order of time per
    document, and the last version seen is carried on: one shuffle, no range join. Both sides are counted
    first, so the documents of a task do not grow with the input. The rows of one document are sorted by
    one task, which spills.
    """
    far = F.lit("9999-12-31 00:00:00").cast("timestamp")
    known = versions.select("document_id", F.col("created_at").alias("_at"), F.lit(0).alias("_kind"), F.col("version_id").alias("_v"),
                            F.lit(None).cast("string").alias("_wanted"), F.lit(None).cast(requests.schema).alias("_request"))
    asked = requests.select("document_id", F.coalesce("as_of", far).alias("_at"), F.lit(1).alias("_kind"),
                            F.lit(None).cast("string").alias("_v"), F.col("version_id").alias("_wanted"),
                            F.struct(*requests.columns).alias("_request"))
    upto = Window.partitionBy("document_id").orderBy("_at", "_kind", "_v")
    whole = Window.partitionBy("document_id", F.coalesce("_v", "_wanted"))
    lines = in_parts(known.unionByName(asked), versions.count() + requests.count(), "document_id")
    lines = lines.withColumn("_newest", F.last("_v", ignorenulls=True).over(upto))
    # a named version answers only for its own document; its rows share the document's partition
    lines = lines.withColumn("_given", F.max("_v").over(whole))
    found = F.when(F.col("_wanted").isNotNull(), F.col("_given")).otherwise(F.col("_newest"))
    return lines.filter(F.col("_kind") == 1).select("_request.*", found.alias("found_version"))


def live_citations(cited: DataFrame, rows: DataFrame) -> DataFrame:
    """Cited chunks that may no longer be cited; must be empty."""
    live = rows.filter(eligible()).select("chunk_id")
    return cited.join(live, "chunk_id", "left_anti")


def missing_embeddings(rows: DataFrame, links: DataFrame, fingerprint: str) -> DataFrame:
    """Eligible chunks without a vector of the current space."""
    present = links.filter(F.col("embedding_fingerprint") == fingerprint).select("chunk_id")
    return rows.filter(eligible()).join(present, "chunk_id", "left_anti")


def resolve_projects(wanted: DataFrame, projects: DataFrame) -> DataFrame:
    """Project names a question uses that do not exist; must be empty."""
    return wanted.select("project_name").distinct().join(projects, "project_name", "left_anti")


def chat_scope(requested: list[str], projects: DataFrame) -> list[str]:
    """Projects of a chat request; several projects and no choice is an error."""
    chosen = list(dict.fromkeys(requested))
    if chosen:
        return chosen
    found = [r.project_id for r in projects.orderBy("project_name").limit(2).collect()]
    if len(found) > 1:
        raise ValueError("choose at least one project")
    return found


def accept_feedback(feedback: DataFrame, messages: DataFrame, ratings) -> DataFrame:
    """Feedback with a known rating on an existing assistant message."""
    answers = messages.filter(F.col("role") == "assistant").select("message_id")
    return feedback.filter(F.col("rating").isin(*ratings)).join(answers, "message_id", "left_semi")


def storage_path(sha256: Column, filename: Column) -> Column:
    """Content-addressed location of an uploaded file."""
    return F.concat_ws("/", F.substring(sha256, 1, 2), F.substring(sha256, 3, 2),
                       F.concat_ws("-", sha256, tx.safe_filename(filename)))
