"""Removal of repeated byte strings: suffix arrays over shards that hold every repeat of a string."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinstone.llm.common import Cuts, with_position
from veinstone.llm.jaccard import mix
from veinstone.llm.suffixes import common_prefixes, suffix_array

LENGTH = 100
GRAM = 24
#: Window starts of one strip: any string of LENGTH bytes has its smallest gram at one of these places.
STRIP = LENGTH - GRAM + 1
SLICE = 1 << 20
#: Bytes of one suffix array, about; strips under one gram stay together up to HOT of them.
SHARD, HOT = 1 << 19, 4096
NO_ID = -(1 << 63)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all GRAM-byte strings: strings of 1, 2, 4, ... bytes, put together."""
    with np.errstate(over="ignore"):
        part, have, total, done = mix(data.astype(np.uint64) + _FACTOR), 1, None, 0
        power = _FACTOR
        while True:
            if GRAM & have:
                total = part if total is None else total[: len(part) - done] * power + part[done:][: len(total)]
                n = min(len(total), len(part))
                total, done = total[:n], done + have
            if done == GRAM:
                return mix(total)
            part = part[:-have] * power + part[have:]
            power = power * power
            have *= 2


def _smallest(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` numbers."""
    have = 1
    while 2 * have <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    rest = width - have
    return np.minimum(h[:-rest], h[rest:]) if rest else h


def _runs(data: np.ndarray, of: np.ndarray | None = None, inside: np.ndarray | None = None):
    """(gram, digest, start, windows, again) of the strips of some bytes.

    A strip is a run of windows whose smallest gram hash is the same, of at most STRIP windows; its digest
    is over all its gram hashes. ``again``: the gram occurs again in the run, as it goes on behind the
    gram it starts with.
    """
    h = gram_hashes(data)
    least = _smallest(h, STRIP)
    new = np.r_[True, least[1:] != least[:-1]]
    if of is not None:
        new[1:] |= (of[1:] != of[:-1]) | (inside[1:] != inside[:-1])
    passed = np.cumsum((h[:len(least)] == least) & np.append(~new[1:], False))
    new = np.flatnonzero(new)
    end = np.append(new[1:], len(least))
    if of is not None:
        new, end = new[inside[new]], end[inside[new]]
    again = passed[end - 1] > np.where(new > 0, passed[new - 1], 0)
    pieces = -(-(end - new) // STRIP)
    turn = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(new, pieces) + STRIP * turn
    windows = np.minimum(STRIP, np.repeat(end, pieces) - start)
    power, inverse = _powers(len(h))
    sums = np.append(np.uint64(0), np.cumsum(h * power))
    digest = mix((sums[start + windows + STRIP - 1] - sums[start]) * inverse[start] + windows.astype(np.uint64))
    return least[start], digest, start, windows, np.repeat(again, pieces)


_held_powers: list = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a factor and of its inverse modulo 2**64, made once per worker."""
    if not _held_powers or len(_held_powers[0]) < n:
        size = max(n, SLICE + 2 * LENGTH)
        back = np.uint64(pow(int(_FACTOR), -1, 1 << 64))
        _held_powers[:] = [np.cumprod(np.append(np.uint64(1), np.full(size, f, np.uint64))) for f in (_FACTOR, back)]
    return _held_powers[0][:n], _held_powers[1][:n]


def _strips(raws: list[bytes]):
    """(text number, gram, digest, start, windows, again) of all texts; short ones share the array work."""
    held, size = [], 0
    for i, raw in enumerate([*raws, None]):
        if held and (raw is None or size + len(raw) > SLICE):
            offsets = np.cumsum([0] + [len(r) for _, r in held])
            data = np.frombuffer(b"".join(r for _, r in held), np.uint8)
            of = np.repeat(np.arange(len(held)), np.diff(offsets))[:len(data) - LENGTH + 1]
            inside = offsets[of + 1] - np.arange(len(of)) >= LENGTH
            gram, digest, start, windows, again = _runs(data, of, inside)
            yield np.array([j for j, _ in held])[of[start]], gram, digest, start - offsets[of[start]], windows, again
            held, size = [], 0
        if raw is None or len(raw) < LENGTH:
            continue
        if len(raw) <= SLICE:
            held.append((i, raw))
            size += len(raw)
            continue
        data, n = np.frombuffer(raw, np.uint8), len(raw) - LENGTH + 1
        for at in range(0, n, SLICE):  # a run cut here counts as two strips
            gram, digest, start, windows, again = _runs(data[at:min(n, at + SLICE) + LENGTH - 1])
            yield np.full(len(gram), i), gram, digest, start + at, windows, again


def _bytes(column) -> list[bytes]:
    return [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in column]


# A span: the first window, whether the strip repeats its gram, and the number of windows.
START, AGAIN = 8, 7
WINDOWS_MASK = 127


def _batch(rows, schema):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_PLACE = "key long, digest long, doc long, span long"
_PLACE_NAMES = ["key", "digest", "doc", "span"]


def _firsts(key, digest, doc, span):
    """Of rows sorted by key, digest and place: which are the first of their strip, which are at the same place."""
    new = np.r_[True, (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])]
    lead = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    return new, (doc == doc[lead]) & (span == span[lead])


def _places(batches):
    """(gram, digest, document, span) of the strips of a task: of equal ones the earliest under their gram.

    The others are repeats for sure; they pass with a key of their own and a negative span. So a frequent
    strip sends its gram's task one row from each task.
    """
    held, size = [], 0

    def flush():
        nonlocal held, size
        gram, digest, doc, span = (np.concatenate(c) for c in zip(*held, strict=True))
        held, size = [], 0
        order = np.lexsort((span, doc, digest, gram))
        gram, digest, doc, span = gram[order].view(np.int64), digest[order].view(np.int64), doc[order], span[order]
        new, same = _firsts(gram, digest, doc, span)
        take = new | ~same
        key = np.where(new, gram, mix((doc ^ span).view(np.uint64)).view(np.int64))
        span = np.where(new, span, -1 - span)
        for at in range(0, len(key), 100_000):
            part = np.flatnonzero(take[at:at + 100_000]) + at
            yield pa.RecordBatch.from_arrays([pa.array(c[part]) for c in (key, digest, doc, span)], names=_PLACE_NAMES)

    for batch in batches:
        ids = np.asarray(batch.column(0))
        for text, gram, digest, start, windows, again in _strips(_bytes(batch.column(1))):
            span = (start << START) | (again.astype(np.int64) << AGAIN) | windows
            held.append((gram, digest, ids[text], span))
            size += len(gram)
        if size > 1_000_000:
            yield from flush()
    if held:
        yield from flush()


_JUDGED = "gram long, doc long, span long"


def _judged(batches):
    """Strips that occur earlier as a whole (gram null), and strips that must be compared with others.

    Rows come sorted by gram, digest and place. The first of equal strips is compared when its gram has
    other strips, too, or when it repeats its gram; later ones are covered. Only the last gram's rows
    wait for the next batch, and no more than LONG of them.
    """
    held = None
    before = None  # key, digest, doc, span: the first of the strip that a cut gram ended with

    def work(key, digest, doc, span, cut):
        nonlocal before
        if not len(key):
            return
        new, same = _firsts(key, digest, doc, span)
        several = np.r_[True, key[1:] != key[:-1]]
        group = np.cumsum(several) - 1
        compared = new & ((np.bincount(group, new) > 1)[group] | ((span >> AGAIN) & 1 > 0))
        if cut:
            compared |= new & (key == key[-1])
        if before is not None and key[0] == before[0]:
            compared |= new & (key == key[0])
            if digest[0] == before[1]:  # goes on with the strip of the part before
                run = (key == key[0]) & (digest == digest[0])
                compared &= ~run
                new = new & ~run
                same = np.where(run, (doc == before[2]) & (span == before[3]), same)
        covered = ~new & ~same
        if cut:
            first = np.flatnonzero(new)
            before = (key[-1], digest[-1], doc[first[-1]], span[first[-1]]) if len(first) and digest[first[-1]] == digest[-1] else before
        for rows, gram in ((compared, key), (covered, None)):
            n = int(rows.sum())
            if n:
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()) if gram is None else pa.array(gram[rows]), pa.array(doc[rows]),
                                                  pa.array(span[rows])], names=["gram", "doc", "span"])

    for batch in batches:
        rows = [np.asarray(c) for c in batch.columns]
        passed = rows[3] < 0
        if passed.any():
            n = int(passed.sum())
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(rows[2][passed]), pa.array(-1 - rows[3][passed])],
                                             names=["gram", "doc", "span"])
            rows = [c[~passed] for c in rows]
        if held is not None:
            rows = [np.concatenate(c) for c in zip(held, rows, strict=True)]
        if not len(rows[0]):
            continue
        last = int(np.searchsorted(rows[0], rows[0][-1]))
        yield from work(*(c[:last] for c in rows), False)
        held = [c[last:] for c in rows]
        if len(held[0]) > LONG:
            yield from work(*held, True)
            held = None
    if held is not None:
        yield from work(*held, False)


LONG = 100_000
_STRIP_SQL = "gram long, doc long, span long, content binary"
_STRIP_ROW = pa.schema([("gram", pa.int64()), ("doc", pa.int64()), ("span", pa.int64()), ("content", pa.binary())])


def _contents(batches):
    """The bytes of the strips that are compared."""
    for batch in batches:
        rows = []
        for doc, raw, strips in zip(batch.column(0).to_pylist(), _bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            for strip in strips:
                a = strip["span"] >> START
                rows.append((strip["gram"], doc, strip["span"], raw[a:a + (strip["span"] & WINDOWS_MASK) + LENGTH - 1]))
        for at in range(0, len(rows), 20_000):
            yield _batch(rows[at:at + 20_000], _STRIP_ROW)


_COVER_SQL = "doc long, span long, covered array<int>"
_COVER = pa.schema([("doc", pa.int64()), ("span", pa.int64()), ("covered", pa.list_(pa.int32()))])


def covered_windows(contents: list[bytes], doc: np.ndarray, span: np.ndarray) -> list[np.ndarray]:
    """Which windows of each strip occur earlier, in this or another of the strips (at their places).

    The strips become one text for the suffix array; windows are equal where neighbours in the array
    share LENGTH bytes, and the earliest of equal windows stays uncovered.
    """
    lengths = np.array([len(c) for c in contents])
    starts = np.cumsum(lengths + 1) - lengths - 1
    joined = np.frombuffer(b"\0".join(contents) + b"\0\0", np.uint8).astype(np.int64) + 2
    joined[starts[1:] - 1] = 1
    joined[-2:] = 1, 0
    array = suffix_array(joined)
    shared = common_prefixes(joined, array, starts, lengths, 1)
    head = np.flatnonzero(shared[array] < LENGTH)
    number = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(array))))
    several = np.repeat(np.diff(np.append(head, len(array))) > 1, np.diff(np.append(head, len(array))))
    at, group = array[several], number[several]
    piece = np.searchsorted(starts, at, side="right") - 1
    offset = at - starts[piece]
    place = (span[piece] >> START) + offset
    order = np.lexsort((place, doc[piece], group))
    group, at = group[order], at[order]
    # equal places are one window (rows that repeat a document)
    first = np.r_[True, group[1:] != group[:-1]] if len(group) else np.zeros(0, bool)
    doc_o, place_o = doc[piece][order], place[order]
    lead = np.maximum.accumulate(np.where(first, np.arange(len(group)), 0)) if len(group) else np.zeros(0, np.int64)
    later = (doc_o != doc_o[lead]) | (place_o != place_o[lead])
    piece, offset = piece[order][later], offset[order][later]
    by = np.argsort(piece, kind="stable")
    parts = np.searchsorted(piece[by], np.arange(len(contents) + 1))
    return [np.sort(offset[by[a:b]]) for a, b in zip(parts[:-1], parts[1:], strict=True)]


def _ranges(windows: np.ndarray) -> list[int]:
    """from, to (exclusive), from, to, ... of sorted numbers."""
    if not len(windows):
        return []
    gap = np.flatnonzero(windows[1:] != windows[:-1] + 1)
    return np.stack([windows[np.r_[0, gap + 1]], windows[np.r_[gap, len(windows) - 1]] + 1], 1).ravel().tolist()


def _shards(batches):
    """The covered windows of each strip. Rows come sorted by gram; grams are gathered until their strips
    fill a shard, and each shard gets a suffix array."""
    gathered: list[tuple] = []
    size, current = 0, None

    def flush():
        nonlocal gathered, size
        if gathered:
            doc, span = (np.array([g[i] for g in gathered], np.int64) for i in (0, 1))
            found = [(d, s, _ranges(w)) for (d, s, _), w in
                     zip(gathered, covered_windows([g[2] for g in gathered], doc, span), strict=True) if len(w)]
            if found:
                yield _batch(found, _COVER)
        gathered, size = [], 0

    for batch in batches:
        for gram, doc, span, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if gram != current:
                if size > SHARD:
                    yield from flush()
                current = gram
            gathered.append((doc, span, content))
            size += len(content) + 1
    yield from flush()


def _windows(batches):
    """The windows of strips whose gram is too frequent for one shard, by digest."""
    for batch in batches:
        rows = []
        for doc, span, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for t in range(len(content) - LENGTH + 1):
                rows.append((hashlib.blake2b(content[t:t + LENGTH], digest_size=16).digest(), doc, span, t))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["window", "doc", "span", "t"])


def _frequent(hot: DataFrame) -> DataFrame:
    """The same covers by grouping equal windows; used for grams with more than HOT different strips."""
    windows = hot.select("doc", "span", "content").mapInArrow(_windows, "window binary, doc long, span long, t long")
    place = windows.withColumn("place", F.shiftright("span", START) + F.col("t"))
    least = place.groupBy("window").agg(F.min("doc").alias("least_doc"))
    least = place.join(least, "window").filter("doc = least_doc").groupBy("window", "least_doc").agg(F.min("place").alias("least_place"))
    later = place.join(least, "window").filter("doc <> least_doc OR place <> least_place")
    return later.groupBy("doc", "span").agg(F.sort_array(F.collect_set(F.col("t").cast("int"))).alias("w")).select(
        "doc", "span", F.flatten(F.transform("w", lambda t: F.array(t, t + 1))).alias("covered"))


def _kept(batches):
    """Removed bytes, runs and the digest of what stays, from the ranges of covered windows."""
    for batch in batches:
        rows = []
        for doc, raw, covered in zip(batch.column(0).to_pylist(), _bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            kept, at, removed, runs, end = hashlib.sha256(), 0, 0, 0, -1
            for a, b in sorted((r["a"], r["b"]) for r in covered):
                b += LENGTH - 1
                if a > end:
                    runs += 1
                    kept.update(raw[at:a])
                    removed -= a
                    if end >= 0:
                        removed += end
                    end = b
                else:
                    end = max(end, b)
                at = end
            removed += end if end >= 0 else 0
            kept.update(raw[at:])
            rows.append((doc, removed, runs, kept.hexdigest()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)],
                                             names=["doc", "n_removed", "n_spans", "kept_sha256"])


def _numbered(documents: DataFrame, cuts: Cuts) -> tuple[DataFrame, bool]:
    """(doc, doc_id, text): ``doc`` names one text and has the order of the documents.

    It is the doc_id itself unless an id (a missing one counts as one) has several texts: then every
    distinct pair of id and text (128 bits of it) gets its place in their order, which is written once.
    """
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    text = F.coalesce("text", F.lit(""))
    docs = documents.select(doc.alias("doc"), text.alias("text"))
    digest = F.md5(F.col("text").cast("binary"))
    marked = docs.select("doc", digest.alias("digest"))
    several = marked.groupBy("doc").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).filter("a <> b")
    if several.isEmpty():
        return docs.select("doc", F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "text"), False
    places = cuts.keep(with_position(cuts, marked.distinct(), F.col("doc"), F.col("digest")))
    found = docs.withColumn("digest", digest).join(places, ["doc", "digest"])
    return cuts.keep(found.select(F.col("position").alias("doc"), F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "text")), True


def remove_repeats(documents: DataFrame, cuts: Cuts | None = None) -> DataFrame:
    """Bytes covered by a LENGTH-byte string that also starts earlier: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Earlier is a smaller doc_id or the same document before. Null texts count as empty; shorter texts
    than LENGTH lose nothing. A null doc_id counts as smaller than all others. Rows with equal doc_id and
    text are one document (all get its result); rows with equal doc_id and other texts, or without id,
    are documents of their own and follow each other by the MD5 digest of the text. An empty table gives
    no rows; other columns are not read.

    All repeats of a string lie under one gram (its smallest by hash), so shards are dealt by gram: first
    only places with a digest are shuffled. Strips equal to an earlier one are settled there (equal gram and
    digest, 128 bits); different strips under one gram, and those that repeat themselves, are compared byte
    by byte: their shards get suffix arrays by induced sorting with permuted common prefixes.
    """
    spark = documents.sparkSession
    cuts = cuts or Cuts(spark)
    docs, renumbered = _numbered(documents, cuts)
    texts = docs.select("doc", "text")
    if renumbered:  # rows that repeat id and text are one document
        texts = texts.dropDuplicates(["doc"])

    places = texts.filter(F.octet_length("text") >= LENGTH).mapInArrow(_places, _PLACE)
    judged = cuts.keep(places.repartition("key").sortWithinPartitions(*_PLACE_NAMES).mapInArrow(_judged, _JUDGED))

    compared = judged.filter("gram IS NOT NULL")
    hot = cuts.keep(compared.groupBy("gram").count().filter(F.col("count") > HOT).select("gram"))
    wanted = compared.groupBy("doc").agg(F.collect_list(F.struct("gram", "span")).alias("strips"))
    contents = texts.join(wanted, "doc").select("doc", "text", "strips").mapInArrow(_contents, _STRIP_SQL)
    some_hot = not hot.isEmpty()
    if some_hot:
        contents = cuts.keep(contents)
    shards = (contents.join(hot, "gram", "left_anti") if some_hot else contents).repartition("gram").sortWithinPartitions("gram")
    covers = shards.mapInArrow(_shards, _COVER_SQL)  # not written: the text shuffle above serves the next join, too
    if some_hot:
        covers = covers.unionByName(_frequent(contents.join(hot, "gram", "left_semi")))

    start = F.shiftright("span", START)
    parts = F.transform(F.expr("filter(sequence(0, size(covered)), i -> i % 2 = 0 AND i < size(covered))"), lambda i: F.struct(
        (start + F.get("covered", i)).alias("a"), (start + F.get("covered", i + 1)).alias("b")))
    whole = F.array(F.struct(start.alias("a"), (start + F.col("span").bitwiseAND(F.lit(WINDOWS_MASK))).alias("b")))
    ranges = (judged.filter("gram IS NULL").select("doc", whole.alias("ranges"))
              .unionByName(covers.select("doc", parts.alias("ranges")))
              .groupBy("doc").agg(F.flatten(F.collect_list("ranges")).alias("ranges")))
    removed = (texts.join(ranges, "doc").select("doc", "text", "ranges")
               .mapInArrow(_kept, "doc long, n_removed long, n_spans long, kept_sha256 string")
               .dropDuplicates(["doc"]))
    plain = docs.select("doc", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    none = F.lit(0).cast("long")
    return plain.join(removed, "doc", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"),
        F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
