"""Knowledge-base views over the given tables.

Two bases share one relational model (documents -> versions -> chunks):

* *notes*: every row of ``documents`` is a file, every line of it a chunk;
* *records*: every customer is a document, each of its orders a version and
  each order line a chunk whose text cites customer, part and supplier codes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.cluster import spread
from veinstone.functions.hashing import chunk_id, content_hash, record_hash


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code(prefix: str, key: Column, width: int = 7) -> Column:
    return F.concat(F.lit(prefix + "-"), F.lpad(key.cast("string"), width, "0"))


# ------------------------------------------------------------------- notes
def note_files(spark, sf_dir) -> DataFrame:
    """Document and version attributes together with the whole text."""
    size = F.col("n_chars")
    return spread(table(spark, sf_dir, "documents"), "doc_id").select(
        "doc_id", "lang", "text", size,
        code("note", F.col("doc_id"), 8).alias("document_id"),
        F.col("source").alias("project_id"),
        F.concat(code("note", F.col("doc_id"), 8), F.lit(".txt")).alias("filename"),
        F.when(F.col("lang") == "en", "requirement").when(F.col("lang") == "fr", "mapping")
        .when(F.col("lang") == "de", "policy").otherwise("change-notice").alias("document_type"),
        F.when(F.col("lang") == "de", "restricted").otherwise("public").alias("visibility"),
        (size < 60).alias("is_deleted"),
        F.concat(code("note", F.col("doc_id"), 8), F.lit("@1")).alias("version_id"),
        F.when(size < 400, "draft").when(size > 12000, "deprecated").otherwise("approved")
        .alias("lifecycle_status"),
        F.when(size.between(11000, 12000), "index_pending").otherwise("searchable")
        .alias("technical_status"),
        size.between(400, 12000).alias("is_current"),
        F.lit("1").alias("version_label"),
    )


NOTE_DOCUMENT = ["document_id", "project_id", "filename", "document_type", "visibility",
                 "is_deleted"]
NOTE_VERSION = ["version_id", "document_id", "lifecycle_status", "technical_status",
                "is_current", "version_label"]


def note_chunks(spark, sf_dir) -> DataFrame:
    """One chunk per line, with the version and document columns it belongs to."""
    files = note_files(spark, sf_dir)
    lines = files.select("*", F.posexplode(F.split("text", "\n")).alias("ordinal", "content"))
    return lines.filter(F.trim("content") != "").select(
        *NOTE_DOCUMENT, *NOTE_VERSION[:1], *NOTE_VERSION[2:], "ordinal", "content",
        F.concat_ws(":", "version_id", F.lpad(F.col("ordinal").cast("string"), 5, "0"))
        .alias("chunk_id"),
        F.concat_ws(" > ", F.col("project_id"), F.col("lang")).alias("heading_path"),
        content_hash(F.col("content")).alias("content_hash"),
    )


def note_acl(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        code("note", F.col("doc_id"), 8).alias("document_id"),
        F.when(F.col("toxic") == 1, "reviewers").otherwise("staff").alias("principal_id"),
        F.when(F.col("quality") == 1, "read").otherwise("write").alias("permission"))


# ----------------------------------------------------------------- records
def record_documents(spark, sf_dir) -> DataFrame:
    customers, nations = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    named = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return named.select(
        code("CUS", F.col("c_custkey")).alias("document_id"),
        F.col("n_name").alias("project_id"),
        F.concat(code("CUS", F.col("c_custkey")), F.lit("-"), F.lower("c_mktsegment"),
                 F.lit(".md")).alias("filename"),
        F.when(F.col("c_mktsegment") == "BUILDING", "business-requirement")
        .when(F.col("c_mktsegment") == "AUTOMOBILE", "mapping")
        .otherwise("parameter-matrix").alias("document_type"),
        F.when(F.col("c_acctbal") < 0, "restricted").otherwise("public").alias("visibility"),
        (F.col("c_acctbal") >= 9500).alias("is_deleted"))


def record_versions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        code("ORD", F.col("o_orderkey")).alias("version_id"),
        code("CUS", F.col("o_custkey")).alias("document_id"),
        F.when(F.col("o_orderstatus") == "F", "approved")
        .when(F.col("o_orderstatus") == "O", "draft").otherwise("deprecated")
        .alias("lifecycle_status"),
        F.when(F.col("o_orderpriority") == "5-LOW", "index_pending").otherwise("searchable")
        .alias("technical_status"),
        F.col("o_orderdate").alias("created_at"))


LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag", "l_linestatus"]


def record_lines(spark, sf_dir) -> DataFrame:
    """The order lines as they are given, with the version and place of the chunk each is.

    Texts and hashes of a chunk are several times wider than its line: a join or filter by version goes
    over the lines, and ``as_chunks`` gives the rows it keeps their texts.
    """
    lines = spread(table(spark, sf_dir, "lineitem"), "l_orderkey")
    return lines.select(code("ORD", F.col("l_orderkey")).alias("version_id"), F.col("l_linenumber").alias("ordinal"), *LINE)


def lines_by_version(spark, sf_dir) -> DataFrame:
    """The order lines dealt by their version, once: what joins or groups by version then leaves them there.

    Only what their texts are made of is shuffled; the version is named again behind it.
    """
    version = code("ORD", F.col("l_orderkey"))
    lines = record_lines(spark, sf_dir).drop("version_id").withColumn("l_shipdate", F.col("l_shipdate").cast("date"))
    return lines.repartition(version).select(version.alias("version_id"), "ordinal", *LINE)


def record_chunks(spark, sf_dir) -> DataFrame:
    return as_chunks(record_lines(spark, sf_dir))


def as_chunks(lines: DataFrame) -> DataFrame:
    """Order lines as chunks; other columns stay behind those of the chunk."""
    others = [c for c in lines.columns if c not in ("version_id", "ordinal", *LINE)]
    content = F.concat_ws(
        " ", code("ORD", F.col("l_orderkey")), F.lit("line"), F.col("ordinal"),
        F.lit("ships part"), code("PRT", F.col("l_partkey")), F.lit("from supplier"),
        code("SUP", F.col("l_suppkey")), F.lit("quantity"), F.col("l_quantity").cast("int"),
        F.lit("price"), F.round(F.col("l_extendedprice") * 100).cast("long"), F.lit("on"),
        F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("status"),
        F.concat_ws("/", "l_returnflag", "l_linestatus"))
    chunks = lines.select(
        "version_id", "ordinal", F.lit("Order lines").alias("heading_path"), content.alias("content"), *others)
    hashed = chunks.withColumn("content_hash", content_hash(F.col("content")))
    none = F.lit(None).cast("string")
    return hashed.withColumn(
        "chunk_id", chunk_id(F.col("version_id"), F.col("ordinal"), F.col("content_hash"))
    ).withColumn(
        "record_hash", record_hash(F.col("content"), F.col("heading_path"),
                                   F.lit(None).cast("int"), none, none))


# -------------------------------------------------------------- queue facts
NOW = "2024-01-20 00:00:00"


def outbox(spark, sf_dir) -> DataFrame:
    """Events read as outbox rows of a queue observed at ``NOW``."""
    return as_outbox(table(spark, sf_dir, "events"))


def as_outbox(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("aggregate_id"),
        F.when(F.col("event_type") == "view", "published")
        .when(F.col("event_type") == "error", "dead")
        .when(F.col("event_type") == "click", "processing").otherwise("pending").alias("status"),
        F.when(k < 80, "index_version").otherwise("delete_version").alias("event_type"),
        F.floor(k / 15).cast("int").alias("attempts"),
        F.col("ts").alias("created_at"),
        (F.col("ts") + F.make_dt_interval(mins=k)).alias("available_at"),
        F.when(F.col("event_type") == "click", F.col("ts") + F.make_dt_interval(days=k / 10))
        .alias("lease_until"))


def model_usage(spark, sf_dir) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("model-"), F.col("event_type")).alias("model_id"),
        F.when(k < 10, "failed").otherwise("success").alias("result_status"),
        (F.round(F.col("value") * 100)).cast("long").alias("total_tokens"),
        F.col("value").alias("latency_ms"), F.col("ts").alias("created_at"))


def questions(spark, sf_dir) -> DataFrame:
    """The passages of ``benchmark`` asked as retrieval questions."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question"))
