"""Token counts of whole texts; huge texts are encoded in overlapping chunks and spliced.

A place in a text is a *stable boundary* when no token of the vocabulary can cover it, whatever stands
around it: then the encodings of any two chunks that hold the place agree from there on.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veinstone.llm.common import Cuts

#: Characters of a chunk, of the first overlap, and how much wider an overlap gets when two chunks do not align.
CHUNK, OVERLAP, WIDER = 1 << 16, 256, 16
#: Characters that are encoded by one call.
CALL = 1 << 20
_SPACE_AHEAD = re.compile(r"(?<=\S)[ \t\r\n]")
_libraries: dict = {}


def path(name: str) -> str:
    import public_tokenizers

    return name if "/" in name else public_tokenizers.path(name)


class PieceModel:
    """A sentencepiece model. A merge makes a piece, so two characters that stand side by side in no
    piece are never joined, and what lies left and right of them is merged independently."""

    def __init__(self, file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=file)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(file, "rb") as f:
            proto.ParseFromString(f.read())
        rules, trainer = proto.normalizer_spec, proto.trainer_spec
        self.splits = (not rules.precompiled_charsmap and not rules.remove_extra_whitespaces and rules.escape_whitespaces
                       and trainer.model_type == trainer.BPE)
        self.inside = {p.piece[i:i + 2].replace("▁", " ") for p in proto.pieces if p.type != p.BYTE
                       for i in range(len(p.piece) - 1)}

    def counts(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1, return_type="numpy")]

    def begins(self, text: str) -> np.ndarray:
        """Where each token begins, in characters."""
        return np.array([b for b, _ in self.model.encode(text, return_type="offset_mapping")["offsets"]], np.int64)

    def stable(self, text: str, start: int, end: int) -> int | None:
        """The first stable boundary in [start, end); start is at least 1."""
        inside = self.inside
        return next((p for p in range(start, min(end, len(text))) if text[p - 1:p + 1].replace("▁", " ") not in inside), None)


class FileTokenizer:
    """A tokenizers file. Where words are cut by the byte-level pattern, white space after another
    character always begins a word; other files are encoded whole."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer.from_file(file)
        self.model.no_truncation()
        self.model.no_padding()
        added = self.model.get_added_tokens_decoder().values()
        self.splits = (isinstance(self.model.pre_tokenizer, pre_tokenizers.ByteLevel) and self.model.normalizer is None
                       and not self.model.pre_tokenizer.add_prefix_space
                       and not any(t.lstrip or t.rstrip or re.search(r"\s", t.content) for t in added))

    def counts(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.model.encode_batch(texts, add_special_tokens=False)]

    def begins(self, text: str) -> np.ndarray:
        return np.array([b for b, _ in self.model.encode(text, add_special_tokens=False).offsets], np.int64)

    def stable(self, text: str, start: int, end: int) -> int | None:
        found = _SPACE_AHEAD.search(text, start, min(end, len(text)))
        return found.start() if found else None


def library(name: str) -> PieceModel | FileTokenizer:
    """The tokenizer of a file, loaded once in a worker; ``.model`` is sentencepiece, ``.json`` tokenizers."""
    if name not in _libraries:
        _libraries[name] = PieceModel(path(name)) if name.endswith(".model") else FileTokenizer(path(name))
    return _libraries[name]


def in_calls(texts: list[str]):
    """Slices of ``texts`` of at most ``CALL`` characters (or one text)."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > CALL:
            yield texts[first:i]
            first, size = i, 0
        size += len(text)
    if texts:
        yield texts[first:]


def _count_whole(name: str):
    def run(batches):
        tokenizer = library(name)
        for batch in batches:
            counts = [n for part in in_calls(batch.column(2).to_pylist()) for n in tokenizer.counts(part)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())],
                                             names=["doc_id", "n_bytes", "n_tokens"])

    return run


def splice_counts(tokenizer, text: str, no: int, last: bool, overlap: int) -> tuple[int | None, int | None, int]:
    """One chunk: its seams (the first stable boundaries in the overlaps with its neighbours, None where
    there is none that begins a token) and its tokens between them. ``text`` ends with the overlap."""
    begins = tokenizer.begins(text)
    ends = len(text) if last else len(text) - overlap

    def seam(start: int) -> int | None:
        # the chunk's own first place is no seam: its encoding does not see what stands before
        place = tokenizer.stable(text, start + 1, start + overlap)
        return place if place is not None and place in begins else None

    left = seam(0) if no else 0
    right = len(text) if last else seam(ends)
    if left is None or right is None:
        return left, right, 0
    return left, right, int(np.count_nonzero((begins >= left) & (begins < right)))


def _cut(chunk: int, overlap: int):
    def run(batches):
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                n = -(-len(text) // chunk)
                for first in range(0, n, 16):
                    some = range(first, min(n, first + 16))
                    yield pa.RecordBatch.from_pylist([{
                        "row": row, "no": i, "last": (i + 1) * chunk + overlap >= len(text),
                        "text": text[i * chunk:(i + 1) * chunk + overlap]} for i in some
                        if not i or i * chunk + overlap < len(text)], schema=_CHUNK)

    return run


_CHUNK = pa.schema([("row", pa.int64()), ("no", pa.int64()), ("last", pa.bool_()), ("text", pa.string())])


def _count_chunks(name: str, chunk: int, overlap: int):
    def run(batches):
        tokenizer = library(name)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                left, right, n = splice_counts(tokenizer, r["text"], r["no"], r["last"], overlap)
                at = r["no"] * chunk
                rows.append((r["row"], r["no"], r["last"], None if left is None else at + left,
                             None if right is None else at + right, n))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                    zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()),
                    strict=True)], names=["row", "no", "last", "left", "right", "n"])

    return run


def spread_chunks(chunks: DataFrame, *keys: str) -> DataFrame:
    """The chunks of one document go to all tasks."""
    return chunks.repartition(*keys)


def count_tokens(documents: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096, chunk: int = CHUNK,
                 overlap: int = OVERLAP, cuts: Cuts | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, as the model's library counts whole texts.

    Texts of at most ``chunk`` characters are encoded where they lie. A longer text becomes chunks that
    overlap, dealt to all tasks; neighbours are spliced at the first stable boundary inside their
    overlap, which both must find at one place. Documents with a pair that does not align are cut again
    with an overlap ``WIDER`` times as long, at last into one chunk, so every count is exact (a text
    that has no stable boundary at all, such as one endless word, is one task's work).

    A null or empty text has no tokens; repeated rows and null ids are rows of their own; an empty table
    gives no rows; other columns are not read.
    """
    cuts = cuts or Cuts(documents.sparkSession)
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    ids = dict(documents.dtypes)["doc_id"]
    out_schema = f"doc_id {ids}, n_bytes long, n_tokens long"
    size = F.length("text")
    if not library(model).splits:
        out = rows.mapInArrow(_count_whole(model), out_schema)
        return out.withColumn("over_limit", F.col("n_tokens") > limit)
    done = rows.filter(size <= chunk).mapInArrow(_count_whole(model), out_schema)
    # row numbers are given once and written, so a lost executor changes none
    left = cuts.keep(rows.filter(size > chunk).withColumn("row", F.monotonically_increasing_id()))
    while not left.isEmpty():
        cut = left.select("row", "text").mapInArrow(_cut(chunk, overlap), "row long, no long, last boolean, text string")
        counted = spread_chunks(cut, "row", "no").mapInArrow(
            _count_chunks(model, chunk, overlap), "row long, no long, last boolean, left long, right long, n long")
        next_left = F.lead("left").over(Window.partitionBy("row").orderBy("no"))
        aligned = F.col("left").isNotNull() & F.col("right").isNotNull() & (F.col("last") | F.col("right").eqNullSafe(next_left))
        sums = cuts.keep(counted.withColumn("aligned", aligned).groupBy("row").agg(
            F.sum("n").alias("n_tokens"), F.every("aligned").alias("aligned")))
        done = done.unionByName(left.drop("text").join(sums.filter("aligned"), "row").select("doc_id", "n_bytes", "n_tokens"))
        left = cuts.keep(left.join(sums.filter("not aligned").select("row"), "row"))
        overlap *= WIDER
        if overlap > chunk:
            chunk = 1 << 31
    return done.withColumn("over_limit", F.col("n_tokens") > limit)
