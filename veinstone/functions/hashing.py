"""Content identities: all deterministic, all built-in expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from veinstone import fixed_values as fv


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def record_hash(content, heading_path, page_number, sheet_name, cell_range) -> Column:
    """sha256 of the compact key-sorted JSON of a chunk and its provenance."""
    record = F.struct(
        cell_range.alias("cell_range"), content.alias("content"),
        heading_path.alias("heading_path"), page_number.alias("page_number"),
        sheet_name.alias("sheet_name"))
    return F.sha2(F.to_json(record, {"ignoreNullFields": "false"}), 256)


def name_uuid(namespace: str, name: Column) -> Column:
    """Version-5 UUID of ``name``."""
    space = F.unhex(F.lit(uuid.UUID(namespace).hex))
    digest = F.sha1(F.concat(space, F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(
        F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws(
        "-", F.substring(digest, 1, 8), F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def chunk_id(version_id: Column, ordinal: Column, hash_of_content: Column) -> Column:
    return name_uuid(fv.CHUNK_NAMESPACE, F.concat_ws(
        ":", version_id, ordinal.cast("string"), hash_of_content))
