"""Vectors in checksummed binary blocks, as a Spark data source (``format("vector_blocks")``).

A block file is a length-prefixed JSON header (rows, dimensions, sizes, checksum) and one compressed
body: ids, then the components as little-endian 32-bit floats. Every task writes its own blocks and
reads its own files; a block whose length or checksum differs fails the read with its path.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

SCHEMA = "chunk_id string, embedding array<float>"
MAGIC, BLOCK_ROWS, SUFFIX = b"VB01", 4096, ".vblock"
_ARROW = pa.schema([("chunk_id", pa.string()), ("embedding", pa.list_(pa.float32()))])


class BrokenBlock(ValueError):
    """A block that is not what was written."""


def encode_block(ids: list[str], vectors: np.ndarray) -> bytes:
    names = json.dumps(ids, ensure_ascii=False).encode()
    body = zlib.compress(len(names).to_bytes(8, "little") + names + np.ascontiguousarray(vectors, "<f4").tobytes(), 1)
    header = json.dumps({"rows": len(ids), "dimensions": int(vectors.shape[1]), "bytes": len(body),
                         "sha256": hashlib.sha256(body).hexdigest()}).encode()
    return MAGIC + len(header).to_bytes(4, "little") + header + body


def decode_block(data: bytes, path: str) -> tuple[list[str], np.ndarray]:
    """(ids, vectors) of a block; ``BrokenBlock`` names the path of one that is damaged."""
    try:
        if data[:4] != MAGIC:
            raise BrokenBlock(f"{path}: no vector block")
        size = int.from_bytes(data[4:8], "little")
        header, body = json.loads(data[8:8 + size]), data[8 + size:]
        if len(body) != header["bytes"]:
            raise BrokenBlock(f"{path}: {len(body)} bytes where {header['bytes']} were written")
        if hashlib.sha256(body).hexdigest() != header["sha256"]:
            raise BrokenBlock(f"{path}: checksum mismatch")
        plain = zlib.decompress(body)
        n = int.from_bytes(plain[:8], "little")
        vectors = np.frombuffer(plain[8 + n:], "<f4")
        if len(vectors) != header["rows"] * header["dimensions"]:
            raise BrokenBlock(f"{path}: {len(vectors)} components for {header['rows']} rows")
        return json.loads(plain[8:8 + n]), vectors.reshape(header["rows"], header["dimensions"])
    except (ValueError, KeyError) as problem:
        if isinstance(problem, BrokenBlock):
            raise
        raise BrokenBlock(f"{path}: unreadable header") from problem


def _file_system(path: str):
    """The store of a path: any that Arrow knows by its address, or the local one."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class _BlockPartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = _file_system(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=False, allow_not_found=True))
        return [_BlockPartition(f.path) for f in sorted(found, key=lambda f: f.path) if f.path.endswith(SUFFIX)]

    def read(self, partition: _BlockPartition) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no files
            return
        store, _ = _file_system(self.path)
        with store.open_input_stream(partition.path) as f:
            ids, vectors = decode_block(f.read(), partition.path)
        offsets = pa.array(np.arange(0, vectors.size + 1, vectors.shape[1], dtype=np.int32))
        listed = pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), listed], schema=_ARROW)


class _Writer(DataSourceArrowWriter):
    """Blocks get names of their own; those of a failed job are removed, those of a lost task are not
    listed by any commit and removed, too."""

    def __init__(self, path: str, rows: int, overwrite: bool):
        self.path, self.rows, self.overwrite, self.job = path, rows, overwrite, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = _file_system(self.path)
        store.create_dir(root, recursive=True)
        written = []
        for batch in batches:
            for at in range(0, batch.num_rows, self.rows):
                part = batch.slice(at, self.rows)
                vectors = part.column("embedding")
                sizes = set(vectors.value_lengths().to_pylist())
                if len(sizes) != 1 or None in sizes or vectors.flatten().null_count:
                    raise ValueError("a block holds vectors of one length, without nulls")
                matrix = vectors.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                name = posixpath.join(root, f"{self.job}-{uuid.uuid4().hex}")
                with store.open_output_stream(name) as f:
                    f.write(encode_block(part.column("chunk_id").to_pylist(), matrix))
                written.append(name)
        return _Written(written)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Only now do the blocks get the suffix that readers look for."""
        from pyarrow import fs

        store, root = _file_system(self.path)
        store.create_dir(root, recursive=True)
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(root)):
                if f.path.endswith(SUFFIX):
                    store.delete_file(f.path)
        for name in (n for m in messages if m for n in m.names):
            store.move(name, name + SUFFIX)
        self.abort([])

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        store, root = _file_system(self.path)
        for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if posixpath.basename(f.path).startswith(self.job) and not f.path.endswith(SUFFIX):
                store.delete_file(f.path)


class _Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class VectorBlocks(DataSource):
    """Options: ``path``, and ``rows`` of a block when writing."""

    @classmethod
    def name(cls) -> str:
        return "vector_blocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], int(self.options.get("rows", BLOCK_ROWS)), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(VectorBlocks)
