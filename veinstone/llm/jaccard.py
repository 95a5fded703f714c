"""N-gram Jaccard join: fixed-size subsets for small sets, inverted lists for large ones."""

from __future__ import annotations

import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinstone.functions.batches import slices
from veinstone.llm.common import Cuts, components

WORDS = 5
SLICE = 1 << 19
#: Lists of at most so many sets are joined pair by pair where they are met, longer ones by pivots.
SHORT = 32
#: Shingles that are put last in the common order: any choice gives the same links, so it is bounded.
FREQUENT, FREQUENT_PER_FLUSH, FLUSH = 100_000, 20_000, 1 << 22
#: All shingles are counted under so many leading bits of theirs, handed over in parts of this many counters.
CROWD_BITS, CROWD_PART = 20, 1 << 14
LARGEST_BOUNDARY = 12
NO_ID = -(1 << 63)

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(max(1, n), _FACTOR, np.uint64))


def _word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of some text."""
    data = np.frombuffer(raw, np.uint8)
    blank = _SPACE[data]
    edge = np.flatnonzero(np.diff(blank.view(np.int8), prepend=1, append=1))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    length = ends - starts
    within = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data)))) if starts[0] == 0 else None
    if within is None:
        data, blank = data[starts[0]:], blank[starts[0]:]
        shifted = starts - starts[0]
        within = np.arange(len(data)) - np.repeat(shifted, np.diff(np.append(shifted, len(data))))
    else:
        shifted = starts
    longest = int(length.max())
    value = (data.astype(np.uint64) + np.uint64(1)) * _powers(longest + 1)[np.minimum(within, longest)]
    value[blank] = 0
    return mix(np.add.reduceat(value, shifted) + length.astype(np.uint64)), starts


def _shingles(words: np.ndarray) -> np.ndarray:
    """The distinct shingles of a document's word hashes, sorted."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    k = min(WORDS, n)
    total = np.full(n - k + 1, np.uint64(k))
    for j, factor in enumerate(_powers(k)):
        total = total + words[j:n - k + 1 + j] * factor
    return np.unique(mix(total))


def _sliced(raw: bytes):
    """Pieces of at most about ``SLICE`` bytes, cut at white space."""
    at = 0
    while at < len(raw):
        end = at + SLICE
        if end < len(raw):
            while end < len(raw) and not _SPACE[raw[end]]:
                end += 1
        yield raw[at:end]
        at = end


def shingle_sets(texts) -> list[np.ndarray]:
    """The set of each text (None: empty). Short texts share the array work of one slice."""
    sets: list = [None] * len(texts)
    held: list[tuple[int, bytes]] = []
    size = 0

    def work():
        nonlocal held, size
        offsets = np.cumsum([0] + [len(r) + 1 for _, r in held])
        words, starts = _word_hashes(b" ".join(r for _, r in held))
        cuts = np.searchsorted(starts, offsets)
        for (i, _), a, b in zip(held, cuts[:-1], cuts[1:], strict=True):
            sets[i] = _shingles(words[a:b])
        held, size = [], 0

    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "replace").lower()
        if len(raw) > SLICE:
            sets[i] = _shingles(np.concatenate([_word_hashes(part)[0] for part in _sliced(raw)]))
            continue
        held.append((i, raw))
        size += len(raw)
        if size > SLICE:
            work()
    if held:
        work()
    return sets


def set_id(shingles: np.ndarray) -> int:
    """A 64-bit name of a set; equal sets have equal names."""
    return int(mix(np.add.reduce(mix(shingles ^ _FACTOR), keepdims=True) + np.uint64(len(shingles)))[0].view(np.int64))


def _pa(array) -> pa.Array:
    return pa.array(array.view(np.int64) if array.dtype == np.uint64 else array)


def _documents(documents: DataFrame) -> DataFrame:
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), "text")


_SCAN = "frequent boolean, id long, n long, set_id long, digest string, crowd binary"
_SCANNED = ["frequent", "id", "n", "set_id", "digest", "crowd"]


def _repeated(values: np.ndarray, least: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The values that occur ``least`` times or more, rising, and how often; sorts ``values`` in place."""
    values.sort()
    if len(values) < least:
        return values[:0], np.zeros(0, np.int64)
    first = values[least - 1:] == values[:len(values) - least + 1]
    first[1:] &= values[1:len(first)] != values[:len(first) - 1]
    at = np.flatnonzero(first)
    return values[at], np.searchsorted(values, values[at], "right") - at


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - CROWD_BITS)).astype(np.int64)


def _scan(batches):
    """A row for each document, the shingles that many documents of a task share, and how crowded each bucket
    of shingles is.

    What is rare in every task may still be common in all of them: the buckets, summed over the tasks, tell
    such shingles from those of one document. There ``frequent`` is null and ``id`` the place of the part.
    """
    pool, size = np.empty(FLUSH, np.uint64), 0  # the only copy of the shingles met since the last flush
    crowd = np.zeros(1 << CROWD_BITS, np.uint32)

    def frequent():
        nonlocal size
        for at in range(0, size, CROWD_PART):
            np.add.at(crowd, _bucket(pool[at:min(size, at + CROWD_PART)]), 1)
        shingle, count = _repeated(pool[:size])
        size = 0
        often = np.argsort(-count, kind="stable")[:FREQUENT_PER_FLUSH]
        n = len(often)
        return pa.RecordBatch.from_arrays([pa.array(np.ones(n, bool)), _pa(shingle[often]), pa.array(count[often].astype(np.int64)),
                                           pa.array(np.zeros(n, np.int64)), pa.nulls(n, pa.string()), pa.nulls(n, pa.binary())],
                                          names=_SCANNED)

    for batch in slices(batches, 2 * SLICE):
        sets = shingle_sets(batch.column(1).to_pylist())
        n = len(sets)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(n, bool)), batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([set_id(s) for s in sets], pa.int64()), batch.column(2), pa.nulls(n, pa.binary())], names=_SCANNED)
        for s in sets:
            while len(s):
                part, s = s[:FLUSH - size], s[FLUSH - size:]
                pool[size:size + len(part)] = part
                size += len(part)
                if size == FLUSH:
                    yield frequent()
    if size:
        yield frequent()
    for at in range(0, len(crowd), CROWD_PART):
        part = crowd[at:at + CROWD_PART]
        if part.any():
            packed = zlib.compress(np.minimum(part, 0xFFFF).astype(np.uint16).tobytes(), 1)
            none = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.bool_()), pa.array([at], pa.int64()), none, none, pa.nulls(1, pa.string()),
                                              pa.array([packed], pa.binary())], names=_SCANNED)


def _crowds(batches):
    """The sum of each part (id, crowd) of the counters over all tasks."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            part = np.frombuffer(zlib.decompress(packed), np.uint16)
            sums[at] = sums[at] + part if at in sums else part.astype(np.int64)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([
            np.minimum(part, 0xFFFFFFFF).astype(np.uint32).tobytes() for part in sums.values()], pa.binary())], names=["id", "crowd"])


def _crowded(scanned: DataFrame) -> np.ndarray:
    """How often shingles of each bucket occur in all documents."""
    crowd = np.zeros(1 << CROWD_BITS, np.uint32)
    parts = scanned.filter("frequent IS NULL").select("id", "crowd").repartition("id")
    for r in parts.mapInArrow(_crowds, "id long, crowd binary").collect():
        part = np.frombuffer(r.crowd, np.uint32)
        crowd[r.id:r.id + len(part)] = part
    return crowd


def prefix(n: int) -> int:
    """Shingles a set of n shows: with less in common, no partner reaches a Jaccard of 0.8."""
    return n // 5 + 1


def subset_sizes(n: int, boundary: int) -> list[int]:
    """Sizes of the subsets that a small set of n enumerates: the least overlaps with its partners."""
    return sorted({-(-4 * (n + t) // 9) for t in range(-(-4 * n // 5), min(5 * n // 4, boundary) + 1)})


def boundary_by_cost(sizes: dict[int, int], per_list: float) -> int:
    """The largest small size: the one with the least rows of subsets plus rows read in lists.

    ``sizes``: how many sets there are of each size up to where lists can begin; ``per_list``: what a
    row of a list costs against a row of a subset, as short lists are scanned for pairs and verified.
    """
    def cost(x: int) -> float:
        subsets = sum(m * sum(math.comb(n, c) for c in subset_sizes(n, x)) for n, m in sizes.items() if 0 < n <= x)
        return subsets + per_list * sum(m * prefix(n) for n, m in sizes.items() if 5 * n >= 4 * (x + 1))

    return min(range(LARGEST_BOUNDARY + 1), key=cost)


_KEYS = "key long, set_id long, n int, pos int"


def _keys(boundary: int, frequent, crowded=None):
    """Of each set that a task meets for the first time, the keys it shares with every partner.

    Large sets show their rarest shingles: by how often one occurs where that is known, then by how crowded
    its bucket is.
    """
    def run(batches):
        often, weight = frequent.value
        crowd = crowded.value if crowded else np.zeros(1 << CROWD_BITS, np.uint32)
        met: set[int] = set()
        for batch in slices(batches, 2 * SLICE):
            key, owner, size, pos = [], [], [], []

            def emit(keys, name, n, places):
                key.append(keys)
                owner.append(np.full(len(keys), name))
                size.append(np.full(len(keys), n, np.int32))
                pos.append(places)

            for shingles in shingle_sets(batch.column(1).to_pylist()):
                n = len(shingles)
                if not n or (name := set_id(shingles)) in met:
                    continue
                met.add(name)
                if n <= boundary:
                    mixed = mix(shingles ^ np.uint64(0x5555))
                    for c in subset_sizes(n, boundary):
                        picks = np.array(list(itertools.combinations(range(n), c)))
                        keys = mix(mixed[picks].sum(1, dtype=np.uint64) + np.uint64(c))
                        emit(keys, name, n, np.full(len(keys), -1, np.int32))
                if 5 * n >= 4 * (boundary + 1):
                    common = crowd[_bucket(shingles)].astype(np.int64)
                    if len(often):
                        at = np.minimum(np.searchsorted(often, shingles), len(often) - 1)
                        known = often[at] == shingles
                        common[known] += weight[at[known]] << 32
                    order = shingles[np.argsort(common, kind="stable")]
                    emit(order[:prefix(n)], name, n, np.arange(prefix(n), dtype=np.int32))
            if key:
                yield pa.RecordBatch.from_arrays([_pa(np.concatenate(c)) for c in (key, owner, size, pos)],
                                                 names=["key", "set_id", "n", "pos"])
    return run


_FOUND = "key long, a long, b long, n_a int, n_b int, shared int"


def _lists(batches):
    """Pairs (a, b) of short lists, with how many lists of the task they share; members (key, a) of long ones.

    Rows come sorted by key, so only the list at the end of a batch is held, and of a long one nothing.
    Subsets of small sets count as ENOUGH lists.
    """
    held, long_key = None, None

    def found(key, a, b=None, n_a=None, n_b=None, shared=None):
        n = len(a)
        columns = [pa.nulls(n, f.type) if c is None else pa.array(c, f.type)
                   for c, f in zip((key, a, b, n_a, n_b, shared), _FOUND_ARROW, strict=True)]
        return pa.RecordBatch.from_arrays(columns, schema=_FOUND_ARROW)

    def work(key, name, n, pos):
        new = np.r_[True, (key[1:] != key[:-1]) | (name[1:] != name[:-1])] if len(key) else np.zeros(0, bool)
        key, name, n, pos = key[new], name[new], n[new].astype(np.int64), pos[new]
        if not len(key):
            return
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        length = np.diff(np.append(edge, len(key)))
        of = np.repeat(length, length)
        long_row = (of > SHORT) | (key == long_key if long_key is not None else False)
        if long_row.any():
            yield found(key[long_row], name[long_row])
        pairs = []
        short = np.flatnonzero((of > 1) & ~long_row)
        for apart in range(1, SHORT):
            i = short[short + apart < len(key)]
            i = i[key[i] == key[i + apart]]
            if not len(i):
                break
            j = i + apart  # names rise inside a list
            i, j = (x[5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j])] for x in (i, j))
            pairs.append(np.stack([name[i], name[j], n[i], n[j], np.where(pos[i] < 0, ENOUGH, 1)], 1))
        if pairs and sum(map(len, pairs)):
            rows = np.concatenate(pairs)
            rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
            first = np.flatnonzero(np.r_[True, (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])])
            yield found(None, *rows[first, :4].T, np.minimum(np.add.reduceat(rows[:, 4], first), ENOUGH))

    for batch in batches:
        rows = [np.asarray(c) for c in batch.columns]
        if not len(rows[0]):
            continue
        if held is not None:
            rows = [np.concatenate(c) for c in zip(held, rows, strict=True)]
        last = int(np.searchsorted(rows[0], rows[0][-1]))
        if last:
            yield from work(*(c[:last] for c in rows))
        held = [c[last:] for c in rows]
        if len(held[0]) > 50_000:  # one list: pass its members on, hold none
            long_key = int(held[0][-1])
            yield from work(*held)
            held = None
    if held is not None:
        yield from work(*held)


ENOUGH = 1 << 20


def _possible(found: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (a, b) that can have a Jaccard similarity of 0.8 by the shingles they show.

    All that two sets share among what both show was counted in short lists, or lies in long ones. Of the
    set whose shown part ends first, everything shown that is shared is shown by the other, too; so the
    sets share no more than that and the rest of one of them.
    """
    pairs = found.filter("b IS NOT NULL").groupBy("a", "b").agg(
        F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"), F.sum(F.col("shared").cast("long")).alias("shared"))
    uncounted = members.groupBy("a").agg(F.count("*").alias("u"))
    pairs = pairs.join(uncounted, "a", "left").withColumnRenamed("u", "u_a").join(
        uncounted.withColumnRenamed("a", "b"), "b", "left").withColumnRenamed("u", "u_b")
    rest = lambda n: F.col(n) - (F.floor(F.col(n) / 5) + 1)
    most = F.col("shared") + F.least(F.coalesce("u_a", F.lit(0)), F.coalesce("u_b", F.lit(0))) + F.greatest(rest("n_a"), rest("n_b"))
    return pairs.filter(9 * most >= 4 * (F.col("n_a") + F.col("n_b"))).select("a", "b")


_FOUND_ARROW = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("n_a", pa.int32()), ("n_b", pa.int32()),
                          ("shared", pa.int32())])


_COMPARED = "a long, b long, far double, linked boolean"


def _compare(batches):
    """Exact Jaccard distance of pairs, from both texts; a text that is not the named set is passed over."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            a, b, x, y = (c.to_pylist() for c in batch.slice(at, 512).columns)
            texts = {}
            for name, text in zip([*a, *b], [*x, *y], strict=True):
                texts.setdefault((name, text), None)
            made = shingle_sets([text for _, text in texts])
            sets = {key: s if set_id(s) == key[0] else None for key, s in zip(texts, made, strict=True)}
            rows = []
            for one, two, s, t in zip(a, b, x, y, strict=True):
                s, t = sets[one, s], sets[two, t]
                if s is None or t is None:
                    continue
                both = len(np.intersect1d(s, t, assume_unique=True))
                total = len(s) + len(t) - both
                rows.append((one, two, 1 - both / total, 100 * both >= 80 * total))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["a", "b", "far", "linked"])


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) with their Jaccard distance and whether they are linked.

    Texts are shuffled, not their shingles: they take less than half of the bytes.
    """
    one = texts.select(F.col("set_id").alias("a"), F.col("text").alias("x"))
    two = texts.select(F.col("set_id").alias("b"), F.col("text").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(_compare, _COMPARED)


def _long_lists(cuts: Cuts, members: DataFrame, docs: DataFrame, readers: DataFrame, links: DataFrame) -> DataFrame:
    """``links`` (a, b) and those that connect whatever the long lists connect.

    Only links between different components matter. At first all members of a list are compared with a
    pivot outside its largest component, which connects most of a list of near-copies. The pivot is done
    with then, and so is a member linked to it and too near to it for a link with any member that is not
    (Jaccard distance is a metric). Whoever is still outside the largest component of a list is compared
    with the members of its lists in blocks, where only links that connect something come out.
    """
    if members.isEmpty():
        return links
    own = cuts.keep(readers.join(members.select(F.col("a").alias("set_id")).distinct(), "set_id", "left_semi"))
    texts = cuts.keep(docs.join(own, "id").select("set_id", "text", "id"))
    chosen = cuts.keep(_pivots(_outside(cuts, members, links)))
    if chosen.isEmpty():
        return links
    against = cuts.keep(members.join(chosen, "key").filter("a <> b"))
    pairs = against.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    known = cuts.keep(_verified(pairs, texts))
    links = links.union(known.filter("linked").select("a", "b"))
    away = cuts.keep(against.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")}).join(
        known.select(F.col("a").alias("lo"), F.col("b").alias("hi"), "far", "linked"), ["lo", "hi"])
        .select("key", "a", "b", "far", "linked"))
    edge = away.filter("NOT linked").groupBy("key", "b").agg(F.min("far").alias("edge"))
    done = (away.filter("linked").join(edge, ["key", "b"], "left")
            .filter(F.col("edge").isNull() | (F.col("far") + 0.2 + 1e-9 < F.col("edge"))).select("key", "a"))
    done = done.unionByName(chosen.select("key", F.col("b").alias("a"))).distinct()
    members = cuts.keep(members.join(chosen.select("key").distinct(), "key", "left_semi").join(done, ["key", "a"], "left_anti"))
    outside = cuts.keep(_outside(cuts, members, links))
    if outside.isEmpty():
        return links
    members = cuts.keep(members.join(outside.select("key").distinct(), "key", "left_semi"))
    least = members.groupBy("key").agg(F.min("a").alias("b"))
    together = components(cuts, members.join(least, "key").select("a", "b")).withColumnRenamed("node", "set_id")
    flagged = outside.select(F.col("a").alias("set_id")).distinct().withColumn("flag", F.lit(True))
    groups = together.join(flagged, "set_id", "left").withColumn("flag", F.coalesce("flag", F.lit(False)))
    groups = groups.withColumn("id", F.col("set_id"))
    return links.union(cuts.keep(_in_blocks(cuts, groups, texts.select(F.col("set_id").alias("id"), "text"))))


def _outside(cuts: Cuts, members: DataFrame, links: DataFrame) -> DataFrame:
    """(key, a): the members of each list that are not in its largest component."""
    label = components(cuts, links).withColumnRenamed("node", "a")
    placed = members.join(label, "a", "left").select("key", "a", F.coalesce("component", "a").alias("component"))
    largest = placed.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(
        F.max_by("component", F.struct("n", "component")).alias("largest"))
    return placed.join(largest, "key").filter("component <> largest").select("key", "a")


def _in_blocks(cuts: Cuts, groups: DataFrame, docs: DataFrame) -> DataFrame:
    """Links inside groups (component, set_id, id, flag) that connect something, between flagged sets and all.

    A group is cut into blocks and each pair of blocks is a task; small groups share a task. ``docs``
    holds the text of each id: it is shuffled to the places of its set, not to its pairs.
    """
    sizes = cuts.keep(groups.groupBy("component").agg(F.count("*").alias("c"), F.count_if("flag").alias("f")).filter("f > 0"))
    shared = sizes.filter(F.col("c") <= BLOCK).agg(F.ceil(F.sum("c") / BLOCK)).first()[0] or 1
    small = F.col("c") <= BLOCK
    placed = cuts.keep(groups.join(sizes, "component").withColumns({
        "small": small, "task": F.when(small, F.pmod(F.xxhash64("component"), F.lit(shared))).otherwise(F.col("component")),
        "n": F.ceil(F.col("c") / BLOCK).cast("int"), "m": F.ceil(F.col("f") / BLOCK).cast("int")}))
    block = lambda n: F.pmod(F.xxhash64("set_id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    zero, kept = F.lit(0), ("set_id", "id")
    both, large = placed.filter("small"), placed.filter("NOT small")
    rows = both.select("task", zero.alias("i"), zero.alias("j"), F.col("flag").alias("asks"), F.lit(True).alias("answers"), *kept)
    rows = rows.unionByName(large.filter("flag").select(
        "task", block("m").alias("i"), each("n").alias("j"), F.lit(True).alias("asks"), F.lit(False).alias("answers"), *kept))
    rows = rows.unionByName(large.select(
        "task", each("m").alias("i"), block("n").alias("j"), F.lit(False).alias("asks"), F.lit(True).alias("answers"), *kept))
    # by shuffle at every size: how many sets are candidates is not bounded
    return docs.join(rows.hint("merge"), "id").select("task", "i", "j", "asks", "answers", "set_id", "text").groupBy(
        "task", "i", "j").applyInArrow(_connect, "a long, b long")


#: Sets in a block: a task compares two blocks.
BLOCK = 512


def _connect(table: pa.Table) -> pa.Table:
    """Links between the asking sets and the others that join different parts, and no more than that."""
    asks, answers = np.asarray(table.column("asks")), np.asarray(table.column("answers"))
    names = np.asarray(table.column("set_id"))
    sets = shingle_sets(table.column("text").to_pylist())
    right = [i for i, s in enumerate(sets) if set_id(s) == names[i]]
    ours, others = [i for i in right if asks[i]], [i for i in right if answers[i]]
    parent: dict[int, int] = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    links = []
    if ours and others:
        size = np.array([len(sets[i]) for i in others])
        pool, owner = np.concatenate([sets[i] for i in others]), np.repeat(np.arange(len(others)), size)
        order = np.argsort(pool, kind="stable")
        pool, owner = pool[order], owner[order]
        for i in ours:
            low, high = np.searchsorted(pool, sets[i], "left"), np.searchsorted(pool, sets[i], "right")
            n = high - low
            at = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
            both = np.bincount(owner[at], minlength=len(others))
            for j in np.flatnonzero((both > 0) & (100 * both >= 80 * (size + len(sets[i]) - both))):
                a, b = int(names[i]), int(names[others[j]])
                if a != b and top(a) != top(b):
                    parent[top(a)] = top(b)
                    links.append((a, b))
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def _pivots(members: DataFrame) -> DataFrame:
    """(key, b): of each list the member with the smallest hash, found with partial aggregates."""
    return members.groupBy("key").agg(F.min_by("a", F.xxhash64("a", F.lit("pivot"))).alias("b"))


def _text_digest() -> Column:
    return F.coalesce(F.md5(F.col("text").cast("binary")), F.lit(""))


def _classes(documents: DataFrame, cuts: Cuts, digest: Column) -> DataFrame:
    """(id, n, digest, component) of every row of ``documents``; a missing doc_id is NO_ID."""
    spark = documents.sparkSession
    docs = _documents(documents)
    scanned = cuts.keep(docs.withColumn("digest", digest).mapInArrow(_scan, _SCAN))
    owners = scanned.filter("NOT frequent").select("id", "n", "set_id", "digest")
    top = (scanned.filter("frequent").groupBy("id").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "id").limit(FREQUENT).collect())
    often = np.array([r.id for r in top], np.int64).view(np.uint64)
    order = np.argsort(often)
    frequent = spark.sparkContext.broadcast((often[order], np.array([r.n for r in top], np.int64)[order]))
    small = owners.filter(F.col("n").between(1, 2 * LARGEST_BOUNDARY)).groupBy("n").agg(F.countDistinct("set_id").alias("m"))
    boundary = boundary_by_cost({r.n: r.m for r in small.collect()}, per_list=8.0)

    crowded = spark.sparkContext.broadcast(_crowded(scanned))
    keys = docs.mapInArrow(_keys(boundary, frequent, crowded), _KEYS)
    found = cuts.keep(keys.repartition("key").sortWithinPartitions("key", "set_id").mapInArrow(_lists, _FOUND))
    members = found.filter("b IS NULL").select("key", "a")
    pairs = cuts.keep(_possible(found, members))
    needed = members.select("a").union(pairs.select("a")).union(pairs.select("b")).distinct().withColumnRenamed("a", "set_id")
    wanted = owners.join(needed, "set_id")
    if owners.groupBy("id").count().filter("count > 1").isEmpty():
        readers = cuts.keep(wanted.groupBy("set_id").agg(F.min("id").alias("id")))
    else:  # an id (or its lack) stands for several rows: one text for each set, by the set's own name
        own = wanted.groupBy("set_id").agg(F.min(F.struct("id", "digest")).alias("of")).select("set_id", "of.id", "of.digest")
        docs = cuts.keep(docs.withColumn("digest", digest).dropDuplicates(["id", "digest"]).join(own, ["id", "digest"]).select(
            F.col("set_id").alias("id"), "text"))
        readers = own.select("set_id", F.col("set_id").alias("id"))
    together = components(cuts, pairs).withColumnRenamed("node", "set_id").withColumn("flag", F.lit(True))
    links = cuts.keep(_in_blocks(cuts, together.join(readers, "set_id"), docs))
    label = components(cuts, cuts.keep(_long_lists(cuts, members, docs, readers, links)))

    return owners.join(label.withColumnRenamed("node", "set_id"), "set_id", "left").select(
        "id", "n", "digest", F.coalesce("component", "set_id").alias("component"))


def join_documents(documents: DataFrame, cuts: Cuts | None = None) -> DataFrame:
    """Documents whose five-word shingle sets have a Jaccard similarity of at least 0.8, as classes.

    Returns doc_id, n_shingles, component_id per row: the smallest doc_id reachable by links, itself
    included. Null and empty texts, and texts without words, have an empty set and are linked with
    nothing. Rows with equal texts are linked. Rows with a null doc_id take part; the component of such
    rows alone is null. An empty table gives no rows; other columns are not read.

    Equal sets are one set from the start. Each set then shows keys: a small set all its subsets of the
    sizes that a partner must share, a large set the rarest fifth of its shingles. Sets under one key
    are candidates, verified on whole sets; the boundary between small and large is chosen by cost.
    """
    classes = _classes(documents, cuts or Cuts(documents.sparkSession), _text_digest())
    full = classes.filter("n > 0")
    least = full.groupBy("component").agg(F.min(F.when(F.col("id") != NO_ID, F.col("id"))).alias("component_id"))
    doc_id = F.when(F.col("id") != NO_ID, F.col("id"))
    return full.join(least, "component").select(doc_id.alias("doc_id"), F.col("n").alias("n_shingles"), "component_id").unionByName(
        classes.filter("n = 0").select(doc_id.alias("doc_id"), F.col("n").alias("n_shingles"), doc_id.alias("component_id")))


def keep_one(documents: DataFrame, cuts: Cuts | None = None) -> DataFrame:
    """``documents`` with one row for each group of linked documents: the one with the smallest doc_id.

    Rows without doc_id come last, and rows of a group that share its doc_id, or have none, are told apart
    by the digest of their text. Documents without words are in no group and stay. Of rows that repeat
    doc_id and text one stays.
    """
    cuts = cuts or Cuts(documents.sparkSession)
    digest = _text_digest()
    classes = cuts.keep(_classes(documents, cuts, digest))
    least = classes.filter("n > 0").groupBy("component").agg(
        F.min(F.struct(F.col("id") == NO_ID, F.col("id").alias("id"), F.col("digest").alias("digest"))).alias("least"))
    kept = least.select("least.id", "least.digest").union(classes.filter("n = 0").select("id", "digest").distinct())
    rows = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), digest.alias("digest"), F.struct("*").alias("row"))
    # copies are left out before the shuffle, so many of one row do not meet in a task
    return rows.dropDuplicates(["id", "digest"]).join(kept, ["id", "digest"], "left_semi").select("row.*")
