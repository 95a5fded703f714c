"""Packing token sequences into windows by best-fit decreasing."""

from __future__ import annotations

import base64
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veinstone.functions.batches import slices
from veinstone.llm.common import Cuts

#: Fixed value of the contract: the id after every document.
END_ID = 1
SHARD_ROWS = 1024
#: Characters of stable Unicode classes, on which both tokenizer libraries cut words alike.
_LATIN = re.compile("[^\x00-ɏ]")
_encoders: dict = {}


def encoder(json_name: str = "byte_bpe_50k.json"):
    """text -> numpy ids of the vocabulary in ``json_name`` of the public tokenizers, once per worker.

    The same vocabulary's ranks in the faster library give the same ids for Latin text without special
    tokens (tested); every other text goes through the tokenizer file itself.
    """
    if json_name not in _encoders:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        exact = Tokenizer.from_file(public_tokenizers.path(json_name))
        special = [t.content for t in exact.get_added_tokens_decoder().values()]
        with open(public_tokenizers.path(json_name.replace(".json", ".tiktoken")), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> np.ndarray:
            if any(s in text for s in special) or not text.isascii() and _LATIN.search(text):
                return np.asarray(exact.encode(text, add_special_tokens=False).ids, np.uint32)
            return np.asarray(quick.encode_to_numpy(text, disallowed_special=()), np.uint32)

        _encoders[json_name] = encode
    return _encoders[json_name]


class CapacityTree:
    """A segment tree over remaining capacities: which capacities have an open window."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.open = np.zeros(2 * self.leaves, np.int64)

    def add(self, capacity: int, windows: int) -> None:
        at = capacity + self.leaves
        while at:
            self.open[at] += windows
            at >>= 1

    def tightest(self, size: int) -> int | None:
        """The smallest capacity of at least ``size`` with an open window."""
        at = size + self.leaves
        while not self.open[at]:
            while at & 1:  # a right child: the next leaves are above
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at + (0 if self.open[2 * at] else 1)
        return at - self.leaves


def best_fit_decreasing(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over all pieces, given how many there are of each size.

    Equal pieces fall into equal windows one after the other, so a step places all that a range of
    equally filled windows takes. Returns (size, first rank, pieces, first window, pieces a window,
    offset): the piece of rank r goes to window first + (r - first rank) // pieces a window. The work
    depends on ``window``, not on the number of pieces.
    """
    tree, ranges, plan, opened = CapacityTree(window), {}, [], 0
    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            capacity = tree.tightest(size)
            if capacity is None:
                capacity, each = window, window // size
                start, number = opened, -(-left // each)
                opened += number
            else:
                start, number = ranges[capacity].pop()
                tree.add(capacity, -number)
                each = capacity // size
            whole = min(number, left // each)
            if not whole:
                each, whole = left, 1
            placed = whole * each
            plan.append((size, rank, placed, start, each, window - capacity))
            for rest, first, n in ((capacity - each * size, start, whole), (capacity, start + whole, number - whole)):
                if n and rest:
                    if rest == window:  # opened for a shorter last window: still unused
                        opened -= n
                        continue
                    ranges.setdefault(rest, []).append((first, n))
                    tree.add(rest, n)
            rank, left = rank + placed, left - placed
    return plan


_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                    ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
_PIECE_SQL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_pieces(documents: DataFrame, window: int, tokenizer: str, keep_ids: bool = False) -> DataFrame:
    """Token pieces of every document: full windows first, then what is left."""
    schema = _PIECE.append(pa.field("ids", pa.list_(pa.int32()))) if keep_ids else _PIECE

    def run(batches):
        encode = encoder(tokenizer)
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                for start in range(0, len(ids), window):
                    part = ids[start:start + window]
                    row = (doc_id, start, len(part), zlib.crc32(part.tobytes()), len(ids))
                    rows.append((*row, part.astype(np.int32)) if keep_ids else row)
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, _PIECE_SQL + (", ids array<int>" if keep_ids else ""))


def pack_documents(documents: DataFrame, window: int = 2048, tokenizer: str = "byte_bpe_50k.json",
                   keep_ids: bool = False, cuts: Cuts | None = None) -> DataFrame:
    """Pieces of all documents with the sequence and the offset they are packed at.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids). A null or
    empty text is the end id alone. Repeated rows are packed as documents of their own; an empty table
    gives no pieces. Sequences are gapless from 0, each id lies in one piece.

    The fit needs only how many pieces there are of each size: at most ``window`` numbers reach the
    driver, at any input. A piece finds its place by its rank among pieces of its size, counted in
    shards of about a thousand rows, so equal sizes meet in no single task.
    """
    cuts = cuts or Cuts(documents.sparkSession)
    pieces = cuts.keep(cut_pieces(documents, window, tokenizer, keep_ids))
    counts = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = best_fit_decreasing(counts, window)
    table = {size: [] for size in counts}
    for size, rank, _, start, each, offset in plan:
        table[size].append((rank, start, each, offset))
    places = {size: np.array(rows, np.int64).T for size, rows in table.items()}

    shards = F.from_json(F.lit(json.dumps([-(-counts.get(n, 1) // SHARD_ROWS) for n in range(window + 1)])), "array<int>")
    sharded = pieces.withColumn("_shard", F.pmod(
        F.xxhash64("doc_id", "start", "ids_crc32", F.lit("shard")), F.get(shards, F.col("length").cast("int"))))
    ahead = Window.partitionBy("length").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sharded.groupBy("length", "_shard").count().select(
        "length", "_shard", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_shard").orderBy(F.xxhash64("doc_id", "start"), "doc_id", "start", "ids_crc32")
    ranked = sharded.join(starts, ["length", "_shard"]).withColumn(
        "_rank", F.row_number().over(inside) + F.col("_before") - 1).select(*pieces.columns, "_rank")

    def place(frames):
        for frame in frames:
            sequence, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
            ranks, lengths = frame["_rank"].to_numpy(), frame["length"].to_numpy()
            for size in np.unique(lengths):
                rows = np.flatnonzero(lengths == size)
                first, start, each, at = places[int(size)]
                step = np.searchsorted(first, ranks[rows], side="right") - 1
                turn = ranks[rows] - first[step]
                sequence[rows] = start[step] + turn // each[step]
                offset[rows] = at[step] + turn % each[step] * size
            yield frame.drop(columns="_rank").assign(sequence_id=sequence, offset=offset)

    return ranked.mapInPandas(place, _PIECE_SQL + (", ids array<int>" if keep_ids else "") + ", sequence_id long, offset long")
