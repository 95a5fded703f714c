"""Which tokens of two tokenizers cover the same bytes, and how often such pairs are linked corpus-wide.

A byte range of a document yields a *fragment*: the open prefix (tokens up to the first place where a
token of each side ends), the groups closed inside, and the open suffix. Fragments of neighbouring
ranges compose, and composing is associative, so a very long document is cut into ranges, and its
fragments are reduced as a tree by Spark.
"""

from __future__ import annotations

import functools
import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinstone.llm.common import Cuts
from veinstone.llm.tokens import PieceModel, in_calls, library

#: Characters above which a document is cut, bytes of a range, fragments composed by one task of a round.
LONG, RANGE, FAN = 1 << 16, 1 << 15, 16
#: Links of a group above which its pairs are counted over distinct ids.
WIDE = 4096
#: Ids of the second side are below 2 ** 15, those of the first below 2 ** 16: a pair is one integer.
SHIFT = 15
#: Most pairs that are broadcast with their counts; rarer ones are joined by a shuffle.
HEAD = 500_000
_NONE = np.zeros(0, np.int32)


# ----------------------------------------------------------------------------- the two sides
class _Spelled:
    """The bytes of a vocabulary, end to end."""

    def __init__(self, entries: list[bytes]):
        self.joined = np.frombuffer(b"".join(entries), np.uint8)
        self.length = np.array([len(b) for b in entries], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """Where each token ends, in bytes."""
        return np.cumsum(self.length[ids])

    def gives(self, ids: np.ndarray, ends: np.ndarray, want: bytes) -> bool:
        """Whether the tokens' bytes, joined, are ``want``."""
        size = int(ends[-1]) if len(ends) else 0
        if size != len(want):
            return False
        n = self.length[ids]
        at = np.arange(size) + np.repeat(self.start[ids] - ends + n, n)
        return self.joined[at].tobytes() == want


class _ByteSide:
    """The byte-level tokenizer: its entries spelled in stand-ins for bytes."""

    def __init__(self, name: str):
        from tokenizers import Tokenizer

        from veinstone.llm.packing import _LATIN, encoder

        self.lib = library(name)
        exact = Tokenizer.from_str(self.lib.model.to_str())
        exact.encode_special_tokens = True
        special = [t.content for t in exact.get_added_tokens_decoder().values()]
        quick = encoder(name)  # the same ids for Latin text without special strings, faster

        def encode(text: str) -> np.ndarray:
            if any(s in text for s in special) or not text.isascii() and _LATIN.search(text):
                return np.asarray(exact.encode(text, add_special_tokens=False).ids, np.int32)
            return quick(text).astype(np.int32)

        self.encode = encode
        stand_in = byte_stand_ins()
        vocabulary = exact.get_vocab(with_added_tokens=False)
        self.bytes = [b""] * (max(exact.get_vocab().values()) + 1)
        for entry, i in vocabulary.items():
            self.bytes[i] = bytes(stand_in[c] for c in entry)
        self.spelled = _Spelled(self.bytes)

    def whole(self, text: str) -> np.ndarray:
        return self.encode(" " + text)

    def part(self, text: str, at: int, end: int) -> np.ndarray:
        """Ids of text[at:end] inside the text; both are stable boundaries."""
        return self.encode(text[at:end] if at else " " + text[:end])


class _PieceSide:
    """The sentencepiece model: it adds the leading space itself."""

    def __init__(self, name: str):
        self.lib: PieceModel = library(name)
        model = self.lib.model
        self.bytes = [bytes([int(model.id_to_piece(i)[1:-1], 16)]) if model.is_byte(i)
                      else model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.vocab_size())]
        self.spelled = _Spelled(self.bytes)

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.lib.model.encode(text, return_type="numpy"), np.int32)

    def part(self, text: str, at: int, end: int) -> np.ndarray:
        if not at:
            return self.whole(text[:end])
        # one character more on the left takes the added space; nothing reaches over the boundary
        found = self.lib.model.encode(text[at - 1:end], return_type="offset_mapping")
        begins = np.array([b for b, _ in found["offsets"]], np.int64)
        return np.asarray(found["ids"], np.int32)[begins >= 1]


def byte_stand_ins() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin ones for
    themselves, all others for the code points from 256 on, in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(other)}


_sides: dict = {}


def side(name: str):
    if name not in _sides:
        _sides[name] = _PieceSide(name) if name.endswith(".model") else _ByteSide(name)
    return _sides[name]


# ----------------------------------------------------------------------------- the monoid
@dataclass
class Fragment:
    """Tokens that end in a byte range. Without a common end all of them are prefix (``closed`` False)."""

    prefix: tuple[np.ndarray, np.ndarray] = (_NONE, _NONE)
    closed: bool = False
    ids: tuple[np.ndarray, np.ndarray] = (_NONE, _NONE)
    sizes: tuple[np.ndarray, np.ndarray] = (_NONE, _NONE)
    suffix: tuple[np.ndarray, np.ndarray] = (_NONE, _NONE)
    whole: bool = field(default=True)  # the tokens' bytes are the text's


def fragment(ids: tuple, ends: tuple) -> Fragment:
    """The fragment of the tokens of one range, given where they end."""
    if not len(ends[0]) or not len(ends[1]):
        return Fragment(prefix=ids)
    # ends ascend and lie in one range, so a mark a byte tells which of them the other side has, too
    first = min(e[0] for e in ends)
    marks = np.zeros((2, max(e[-1] for e in ends) - first + 1), bool)
    for mark, e in zip(marks, ends, strict=True):
        mark[e - first] = True
    cuts = [np.flatnonzero(other[e - first]) + 1 for other, e in zip(marks[::-1], ends, strict=True)]
    if not len(cuts[0]):
        return Fragment(prefix=ids)
    return Fragment(
        tuple(i[:c[0]] for i, c in zip(ids, cuts, strict=True)), True,
        tuple(i[c[0]:c[-1]] for i, c in zip(ids, cuts, strict=True)),
        tuple(np.diff(c).astype(np.int32) for c in cuts),
        tuple(i[c[-1]:] for i, c in zip(ids, cuts, strict=True)))


def compose(fragments: list[Fragment]) -> Fragment:
    """The fragment of neighbouring ranges; an empty fragment changes nothing."""
    prefix, ids, sizes, open_, closed = ([], []), ([], []), ([], []), ([], []), False
    for f in fragments:
        for s in (0, 1):
            if not closed:
                prefix[s].append(f.prefix[s])
            else:
                open_[s].append(f.prefix[s])
        if not f.closed:
            continue
        for s in (0, 1):
            if closed:  # what was open ends with the other's prefix: one more group
                middle = np.concatenate(open_[s])
                ids[s].append(middle)
                sizes[s].append(np.array([len(middle)], np.int32))
            ids[s].append(f.ids[s])
            sizes[s].append(f.sizes[s])
            open_[s][:] = [f.suffix[s]]
        closed = True

    def joined(parts):
        return tuple(np.concatenate(p) if p else _NONE for p in parts)

    return Fragment(joined(prefix), closed, joined(ids), joined(sizes), joined(open_), all(f.whole for f in fragments))


def groups_of(f: Fragment) -> tuple[tuple, tuple]:
    """(ids, group sizes) of both sides of a whole document: its prefix is a group too."""
    return (tuple(np.concatenate([f.prefix[s], f.ids[s]]) for s in (0, 1)),
            tuple(np.concatenate([[len(f.prefix[s])], f.sizes[s]]) for s in (0, 1)))


@functools.cache
def _marked() -> np.ndarray:
    """Decimal ids with the mark behind them, ``,`` or that of a group's last id: two entries an id, the
    first side's ids before the second's. Shorter entries are filled with zero bytes."""
    return np.array([f"{i}{mark}" for last, n in (("|", 1 << 16), (";", 1 << SHIFT)) for i in range(n) for mark in (",", last)], "S")


def spelled(ids: tuple, sizes: tuple) -> str:
    """``a1,a2|b1;a3|b2,b3``: the groups in order."""
    ends = [np.cumsum(n, dtype=np.int64) for n in sizes]
    codes = np.empty(len(ids[0]) + len(ids[1]), np.int64)
    # before a token stand the tokens of its own side and those of the other side's earlier groups
    before = ends[1] - sizes[1], ends[0]
    for s, shift in ((0, 0), (1, 2 << 16)):
        code = 2 * ids[s].astype(np.int64) + shift
        code[ends[s] - 1] += 1
        codes[np.arange(len(code)) + np.repeat(before[s], sizes[s])] = code
    filled = _marked()[codes].view(np.uint8)
    return filled[filled != 0].tobytes()[:-1].decode()


def linked_pairs(ids: tuple, sizes: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of ids that share a group, with how many occurrences are linked."""
    a, b = (i.astype(np.int32) for i in ids)  # a pair has 31 bits
    na, nb = (n.astype(np.int64) for n in sizes)
    start_a, start_b = np.cumsum(na) - na, np.cumsum(nb) - nb
    narrow = na * nb <= WIDE
    # each first-side token of a narrow group, as often as the group has second-side tokens
    group = np.repeat(np.arange(len(na)), na)
    kept = narrow[group]
    times = nb[group][kept]
    first = np.repeat(a[kept], times)
    place = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    keys, counts = [first << SHIFT | b[np.repeat(start_b[group][kept], times) + place]], [np.ones(len(first), np.int64)]
    for g in np.flatnonzero(~narrow):
        of_a, n_a = np.unique(a[start_a[g]:start_a[g] + na[g]], return_counts=True)
        of_b, n_b = np.unique(b[start_b[g]:start_b[g] + nb[g]], return_counts=True)
        keys.append((of_a[:, None] << SHIFT | of_b[None, :]).ravel())
        counts.append((n_a[:, None] * n_b[None, :]).ravel())
    if len(keys) == 1:
        return np.unique(keys[0], return_counts=True)
    distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, where, np.concatenate(counts))
    return distinct, total


# ----------------------------------------------------------------------------- rows
_ROW = pa.schema([("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
                  ("groups_sha256", pa.string()), ("groups", pa.string()), ("pairs", pa.list_(pa.int32())),
                  ("times", pa.list_(pa.int64()))])
_ROW_SQL = ("n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, "
            "pairs array<int>, times array<long>")
_EMPTY = (0, 0, 0, 0, "", "", [], [])


def _document_row(f: Fragment | None, keep_groups: bool) -> tuple:
    if f is None or not f.whole or not f.closed:
        return _EMPTY
    ids, sizes = groups_of(f)
    text = spelled(ids, sizes)
    pairs, times = linked_pairs(ids, sizes)
    return (len(ids[0]), len(ids[1]), len(sizes[0]), int((sizes[0].astype(np.int64) * sizes[1]).sum()),
            hashlib.sha256(text.encode()).hexdigest(), text if keep_groups else "", pairs.astype(np.int32), times)


def align_text(text: str, names: tuple) -> Fragment | None:
    """The one fragment of a text; None where it has no tokens."""
    if not text:
        return None
    want = b" " + text.encode()
    ids, ends = [], []
    for tokenizer in map(side, names):
        ids.append(tokenizer.whole(text))
        ends.append(tokenizer.spelled.ends(ids[-1]))
        if not tokenizer.spelled.gives(ids[-1], ends[-1], want):
            return None
    return fragment(tuple(ids), tuple(ends))


def _batch(head: list, heads: pa.Schema, rows: list) -> pa.RecordBatch:
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROW, strict=True)]
    return pa.RecordBatch.from_arrays([*head, *columns], names=[*heads.names, *_ROW.names])


def _align_short(names: tuple, keep_groups: bool):
    def run(batches):
        for batch in batches:
            at = 0
            for part in in_calls(batch.column(1).to_pylist()):
                rows = [_document_row(align_text(t, names), keep_groups) for t in part]
                yield _batch([batch.column(0).slice(at, len(part))], pa.schema([batch.schema.field(0)]), rows)
                at += len(part)

    return run


# ----------------------------------------------------------------------------- very long documents
def _segments(names: tuple, step: int):
    """Segments of a document for each side, cut at its stable boundaries; with a character more on the left."""
    def run(batches):
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                for s, name in enumerate(names):
                    at = byte = 0
                    while at < len(text):
                        end = side(name).lib.stable(text, at + step, len(text)) if at + step < len(text) else None
                        end = len(text) if end is None else end
                        yield pa.RecordBatch.from_pylist([{
                            "row": row, "side": s, "at": at, "byte": byte, "text": text[max(0, at - 1):end]}], schema=_SEGMENT)
                        byte += len(text[at:end].encode()) + (at == 0)
                        at = end

    return run


_SEGMENT = pa.schema([("row", pa.int64()), ("side", pa.int32()), ("at", pa.int64()), ("byte", pa.int64()), ("text", pa.string())])
_ENCODED = pa.schema([("row", pa.int64()), ("no", pa.int64()), ("side", pa.int32()), ("byte", pa.int64()),
                      ("ids", pa.list_(pa.int32())), ("ends", pa.list_(pa.int64())), ("whole", pa.bool_())])


def _encode_segments(names: tuple, width: int):
    """The tokens of a segment, dealt to the byte ranges they end in."""
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                tokenizer, head = side(names[r["side"]]), min(1, r["at"])
                ids = tokenizer.part(r["text"], head, len(r["text"]))
                want = (r["text"][1:] if head else " " + r["text"]).encode()
                ends = tokenizer.spelled.ends(ids)
                whole = tokenizer.spelled.gives(ids, ends, want)
                ends += r["byte"]
                number = (ends - 1) // width
                rows = [(r["row"], int(n), r["side"], r["byte"], ids[number == n], ends[number == n], whole)
                        for n in np.unique(number)] or [(r["row"], 0, r["side"], r["byte"], _NONE, np.zeros(0, np.int64), whole)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ENCODED, strict=True)], schema=_ENCODED)

    return run


_FRAGMENT = pa.schema([("row", pa.int64()), ("no", pa.int64()), ("closed", pa.bool_()), ("whole", pa.bool_()), *[
    (f"{part}_{s}", pa.list_(pa.int32())) for part in ("prefix", "ids", "sizes", "suffix") for s in "ab"]])
_FRAGMENT_SQL = "row long, no long, closed boolean, whole boolean, " + ", ".join(
    f"{f.name} array<int>" for f in list(_FRAGMENT)[4:])


def _fragment_table(row: int, no: int, f: Fragment) -> pa.Table:
    arrays = [x for part in (f.prefix, f.ids, f.sizes, f.suffix) for x in part]
    return pa.Table.from_arrays([pa.array([row]), pa.array([no]), pa.array([f.closed]), pa.array([f.whole]),
                                 *[pa.array([x], pa.list_(pa.int32())) for x in arrays]], schema=_FRAGMENT)


def _read_fragment(r: dict) -> Fragment:
    def both(part):
        return tuple(np.asarray(r[f"{part}_{s}"], np.int32) for s in "ab")

    return Fragment(both("prefix"), r["closed"], both("ids"), both("sizes"), both("suffix"), r["whole"])


def _range_fragment(key, table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: (r["side"], r["byte"]))
    ids, ends = [], []
    for s in (0, 1):
        mine = [r for r in rows if r["side"] == s]
        ids.append(np.concatenate([_NONE, *[np.asarray(r["ids"], np.int32) for r in mine]]))
        ends.append(np.concatenate([np.zeros(0, np.int64), *[np.asarray(r["ends"], np.int64) for r in mine]]))
    whole = all(r["whole"] for r in rows)
    # where bytes differ the ends of both sides mean nothing, and the document has no tokens
    f = fragment(tuple(ids), tuple(ends)) if whole else Fragment()
    f.whole = whole
    return _fragment_table(key[0].as_py(), key[1].as_py(), f)


def _compose_group(key, table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["no"])
    return _fragment_table(key[0].as_py(), key[1].as_py(), compose([_read_fragment(r) for r in rows]))


def _finish(keep_groups: bool):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                row = _document_row(_read_fragment(r), keep_groups)
                yield _batch([pa.array([r["row"]], pa.int64())], pa.schema([("row", pa.int64())]), [row])

    return run


def _next_level(level: DataFrame) -> DataFrame:
    """``FAN`` neighbouring fragments become one; they keep their numbers, which order them in their group."""
    return level.groupBy("row", F.floor(F.col("no") / FAN).alias("up")).applyInArrow(
        lambda key, table: _compose_group(key, table), _FRAGMENT_SQL)


def _align_long(cuts: Cuts, rows: DataFrame, names: tuple, width: int, keep_groups: bool) -> DataFrame:
    """(row, ...) of long documents: segments encoded, ranges made, and fragments reduced by all tasks."""
    segments = rows.mapInArrow(_segments(names, width), "row long, side int, at long, byte long, text string")
    encoded = segments.repartition("row", "side", "at").mapInArrow(
        _encode_segments(names, width),
        "row long, no long, side int, byte long, ids array<int>, ends array<long>, whole boolean")
    level = cuts.keep(encoded.groupBy("row", "no").applyInArrow(
        lambda key, table: _range_fragment(key, table), _FRAGMENT_SQL))
    while level.agg(F.max("no")).first()[0]:
        above = cuts.keep(_next_level(level))
        cuts.drop(level)
        level = above
    return level.mapInArrow(_finish(keep_groups), "row long, " + _ROW_SQL)


# ----------------------------------------------------------------------------- the operator
def align_documents(documents: DataFrame, first: str = "byte_bpe_50k.json", second: str = "piece_bpe_32k.model",
                    keep_groups: bool = False, long: int = LONG, width: int = RANGE, cuts: Cuts | None = None) -> DataFrame:
    """One row a document: how its two token sequences align.

    Columns: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs and times (distinct linked id
    pairs as ``a << 15 | b``, and their occurrences), and groups (the spelled groups if ``keep_groups``).
    A null or empty text and one that a tokenizer does not give back byte by byte have no tokens.
    Repeated rows and null ids are rows of their own; an empty table gives no rows; other columns are
    not read. A document longer than ``long`` characters is cut at places where no token can reach
    over, its segments are encoded by all tasks, and its byte ranges' fragments reduced as a tree; its
    row, like its text, is held whole by one task at the end.
    """
    cuts = cuts or Cuts(documents.sparkSession)
    names, ids = (first, second), dict(documents.dtypes)["doc_id"]
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    short = rows.filter(F.length("text") <= long).mapInArrow(_align_short(names, keep_groups), f"doc_id {ids}, {_ROW_SQL}")
    # row numbers are given once and written, so a lost executor changes none
    far = cuts.keep(rows.filter(F.length("text") > long).withColumn("row", F.monotonically_increasing_id()))
    if far.isEmpty():
        return short
    done = _align_long(cuts, far.select("row", "text"), names, width, keep_groups)
    return short.unionByName(far.select("doc_id", "row").join(done, "row").drop("row"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best): in how many documents a pair is linked, and whether no other pair of its
    first id is in more. Counted in each task before the shuffle."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count"))
    first = F.shiftright("pair", SHIFT)
    most = counts.groupBy(first.alias("_a")).agg(F.max("count").alias("_most"))
    return counts.join(most, first == F.col("_a")).select("pair", "count", (F.col("count") == F.col("_most")).alias("best"))


def score_documents(documents: DataFrame, first: str = "byte_bpe_50k.json", second: str = "piece_bpe_32k.model",
                    head: int = HEAD, cuts: Cuts | None = None, **options) -> DataFrame:
    """``align_documents`` with each document's links weighed by the corpus: n_best and count_sum.

    Links need their pair's count. The most frequent pairs, at most ``head`` of them, are broadcast, so
    that the bulk of all links is summed where it lies and no frequent pair is a hot key; links of the
    rarer pairs are shuffled to their counts. Ties at the edge of the head go to the shuffled side.
    """
    cuts = cuts or Cuts(documents.sparkSession)
    aligned = cuts.keep(align_documents(documents, first, second, cuts=cuts, **options).withColumn(
        "_row", F.monotonically_increasing_id()))
    counts = cuts.keep(pair_counts(aligned))
    edge = least_count(counts, head)
    links = aligned.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("_l")).select(
        "_row", F.col("_l.pairs").alias("pair"), F.col("_l.times").alias("times"))
    sums = (F.sum("times").alias("_known"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
            F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    frequent = F.broadcast(counts.filter(F.col("count") >= edge))
    weighed = links.join(frequent, "pair").groupBy("_row").agg(*sums)
    if not counts.filter(F.col("count") < edge).isEmpty():
        rest = links.join(frequent.select("pair"), "pair", "left_anti").join(
            counts.filter(F.col("count") < edge), "pair").groupBy("_row").agg(*sums)
        weighed = weighed.unionByName(rest).groupBy("_row").agg(
            *[F.sum(c).alias(c) for c in ("_known", "n_best", "count_sum")])
    none = F.lit(0).cast("long")
    return aligned.drop("pairs", "times").join(weighed, "_row", "left").drop("_row", "_known").withColumns(
        {c: F.coalesce(c, none) for c in ("n_best", "count_sum")})


def least_count(counts: DataFrame, head: int) -> int:
    """The least count such that at most ``head`` pairs have it or a greater one: counts in 64 bins,
    then in 64 bins of the bin that holds the edge, and so on."""
    low, high, above = 1, (counts.agg(F.max("count")).first()[0] or 0) + 1, 0
    while True:
        width = -(-(high - low) // 64) or 1
        inside = counts.filter((F.col("count") >= low) & (F.col("count") < high))
        bins = {r.bin: r.n for r in inside.groupBy(F.expr(f"(count - {low}) div {width}").alias("bin")).agg(
            F.count("*").alias("n")).collect()}
        for b in range(63, -1, -1):
            if above + bins.get(b, 0) > head:
                break
            above += bins.get(b, 0)
        else:
            return low
        if width == 1:
            return low + b + 1
        low, high = low + b * width, min(low + (b + 1) * width, high)
