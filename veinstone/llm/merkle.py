"""Document fingerprints: a Merkle tree over sections, paragraphs and sentences, in column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinstone.llm.common import Cuts

#: Hexadecimal digits of a leaf in the written tree, of inner nodes, and paragraphs a section about has.
LEAF, NODE = 8, 16
DOCUMENTS_PER_RANGE, MAX_RANGES = 1000, 4096


def fingerprint(text: Column) -> Column:
    """The written tree of a text: ``root|section/section``; null counts as the empty text.

    A leaf is a sentence with its end mark and white space before the next; leaves cover the text
    without gaps, so equal texts have equal trees and the other way round (up to SHA-256). Leaves of
    a paragraph (a line) are joined by ``.``, paragraphs by ``,``; a paragraph whose own hash starts
    with 0 or 1, or that is blank, ends a section, so an insertion moves no later section. The hash of
    a section is that of its part, and the root is the hash of the sections' hashes.
    """
    leaves = F.split(F.coalesce(text, F.lit("")), r"(?<=\n)|(?<=[.!?])(?=[ \t])")
    hashed = F.transform(leaves, lambda x: F.concat(
        F.substring(F.sha2(x, 256), 1, LEAF), F.when(x.endswith("\n"), F.lit(",")).otherwise(F.lit("."))))
    paragraphs = F.split(F.array_join(hashed, ""), "(?<=,)")
    ended = F.transform(F.filter(paragraphs, lambda x: x != ""), lambda x: F.concat(
        x, F.when(F.substring(F.sha2(x, 256), 1, 1).isin("0", "1"), F.lit("/")).otherwise(F.lit(""))))
    tree = F.array_join(ended, "")
    sections = F.transform(F.split(tree, "/"), lambda x: F.substring(F.sha2(x, 256), 1, NODE))
    whole = F.transform(leaves, lambda x: F.sha2(x, 256))
    root = F.sha2(F.concat(F.array_join(sections, "/"), F.lit("|"), F.sha2(F.array_join(whole, ""), 256)), 256)
    return F.concat(root, F.lit("|"), tree)


def root(print_: Column) -> Column:
    return F.substring_index(print_, "|", 1)


def leaves(print_: Column) -> Column:
    return F.filter(F.split(F.substring_index(print_, "|", -1), "[.,/]+"), lambda x: x != "")


def likeness(one: Column, other: Column) -> Column:
    """Shared distinct leaves over all distinct leaves: 1 for equal trees, 0 without a common leaf."""
    a, b = leaves(one), leaves(other)
    alike = F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))
    return F.when(root(one) == root(other), F.lit(1.0)).otherwise(alike)


def edits(one: Column, other: Column) -> Column:
    """Places (section, paragraph, leaf, from 0) of ``one`` whose branch ``other`` does not have.

    Sections that both trees have are passed by whole; inside the others, paragraphs; then leaves.
    """
    def parts(x: Column, mark: str) -> Column:
        return F.filter(F.split(x, mark), lambda y: y != "")

    tree = lambda x: F.substring_index(x, "|", -1)
    sections, paragraphs, known = parts(tree(other), "/"), parts(tree(other), "[,/]+"), leaves(other)
    found = F.transform(parts(tree(one), "/"), lambda s, i: F.when(
        F.array_contains(sections, s), F.array().cast("array<struct<section:int,paragraph:int,leaf:int>>")).otherwise(
        F.flatten(F.transform(parts(s, ","), lambda p, j: F.when(
            F.array_contains(paragraphs, p), F.array().cast("array<struct<section:int,paragraph:int,leaf:int>>")).otherwise(
            F.filter(F.transform(parts(p, r"\."), lambda x, k: F.when(
                ~F.array_contains(known, x),
                F.struct(i.alias("section"), j.alias("paragraph"), k.alias("leaf")))),
                lambda x: x.isNotNull()))))))
    return F.flatten(found)


def _range_of(bounds: list[int], value: Column) -> Column:
    """How many of the sorted ``bounds`` are at most ``value``: binary search in a fixed number of steps."""
    sorted_bounds = F.array(*[F.lit(b).cast("long") for b in bounds])
    steps, step = [], 1
    while step <= len(bounds):
        steps.insert(0, step)
        step *= 2
    if not steps:
        return F.lit(0)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: F.when(
        (at + s <= len(bounds)) & (F.get(sorted_bounds, at + s - 1) <= value), at + s).otherwise(at))


def with_next_text(cuts: Cuts, documents: DataFrame) -> DataFrame:
    """doc_id, text, next_text: the text of the next document by descending doc_id, the first's after the last.

    Rows of the same doc_id follow each other by text; null ids come last. Texts are shuffled once,
    into ranges of ids between quantiles of all ids; the first row of each range is also sent to the
    range before it, which needs its text.
    """
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = documents.count()
    ranges = max(1, min(MAX_RANGES, n // DOCUMENTS_PER_RANGE))
    at = [i / ranges for i in range(1, ranges)]
    found = documents.agg(F.percentile_approx("doc_id", at, 20 * ranges)).first()[0] if at else None
    bounds = sorted({int(b) for b in found or []})
    # range 0 has the largest ids; null ids have a range of their own behind all others
    where = F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1)).otherwise(
        F.lit(len(bounds)) - _range_of(bounds, F.col("doc_id")))
    placed = docs.withColumn("_range", where)
    heads = placed.groupBy("_range").agg(F.max("doc_id").alias("doc_id")).collect()  # at most MAX_RANGES + 1 rows
    order = sorted(h["_range"] for h in heads)
    before = {r: order[i - 1] for i, r in enumerate(order)}  # the first range's head closes the circle
    lead = documents.sparkSession.createDataFrame(
        [(h["_range"], h["doc_id"], before[h["_range"]]) for h in heads], "_range int, doc_id long, _to int")
    first = placed.join(F.broadcast(lead), (placed["_range"] == lead["_range"]) & placed.doc_id.eqNullSafe(lead.doc_id))
    first = first.groupBy(placed.doc_id, F.col("_to").alias("_range")).agg(F.min("text").alias("text"))
    rows = placed.withColumn("_lent", F.lit(0)).unionByName(
        first.select("doc_id", "text", "_range", F.lit(1).alias("_lent")))
    following = Window.partitionBy("_range").orderBy("_lent", F.col("doc_id").desc_nulls_last(), "text")
    return rows.withColumn("next_text", F.lead("text").over(following)).filter("_lent = 0").select(
        "doc_id", "text", "next_text")


def edited(text: Column, next_text: Column) -> Column:
    """The last half (rounded down) of the code points replaced by as many first ones of the next text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(next_text, F.lit(1), half))


def fingerprint_documents(documents: DataFrame, cuts: Cuts | None = None) -> DataFrame:
    """Fingerprints of every document, of its edited text and of its next document, and their likeness.

    Null texts count as empty. Empty tables give no rows; one document is its own next one.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    cuts = cuts or Cuts(documents.sparkSession)
    rows = with_next_text(cuts, documents).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"),
                       F.sha2("edited", 256).alias("edited_sha256"),
                       fingerprint(F.col("text")).alias("fingerprint"),
                       fingerprint(F.col("edited")).alias("edited_fingerprint"),
                       fingerprint(F.col("next_text")).alias("_next"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_next")).alias("near_next"))
