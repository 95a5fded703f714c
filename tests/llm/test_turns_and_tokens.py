"""Conversation repair, token counts and tokenizer alignment against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veinstone.llm import alignment, tokens, turns

SCHEMA = "conv_id long, turn long, role string, text string"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


# ------------------------------------------------------------------------------------------- op 11
def brute_repair(rows):
    """(cost, audit) by trying all edits, turn after turn, with at most three inserts in a row."""
    def inserted(labels):
        for _ in range(3):
            for state, (cost, audit) in list(labels.items()):
                for role in "ua":
                    to = NEXT.get((state, role))
                    if to:
                        labels[to] = min(labels.get(to, (1 << 60, "")), (cost + 3, audit + "I"))
        return labels

    labels = {"": (0, "")}
    for initial, must_go, truncated in rows:
        after = {}
        for state, (cost, audit) in inserted(labels).items():
            ways = [(state, 4, "D")]
            if not must_go:
                ways += [(NEXT[state, initial], 3 * truncated, "K")] if (state, initial) in NEXT else []
                ways += [(NEXT[state, r], 3 + 3 * truncated, "R") for r in "ua" if (state, r) in NEXT]
            for to, paid, letter in ways:
                after[to] = min(after.get(to, (1 << 60, "")), (cost + paid, audit + letter))
        labels = after
    return min(label for state, label in inserted(labels).items() if state in ("", "a"))


def expected(rows):
    """The contract's columns for all conversations, in plain Python."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        mine = groups[conv]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        mine += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, mine in groups.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, judged, faults = set(), [], Counter()
        for _, role, text in mine:
            shown = text.rstrip(" \t\n\v\f\r")
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "" if shown[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faults[fault] += 1
            judged.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit = brute_repair(judged)
        at, state, lines = iter(mine), "", []
        for letter in audit:
            role, text = ("", "") if letter == "I" else next(at)[1:]
            if letter != "D":
                role = role if letter == "K" else "assistant" if state == "u" else "user"
                state = NEXT[state, role[:1]]
                lines.append(f"{role}:{text}")
        known = [t for t, *_ in mine if t is not None]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:], strict=False))
        out[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, faults["blank"], faults["duplicate"],
                     faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations(seed, hot):
    rng = random.Random(seed)
    roles, ends = ["system", "user", "assistant", "user", "assistant", "tool", None, ""], [".", "!", "?", "", " \n", ". "]
    rows = []
    for conv in [*range(60), None]:
        n = hot if conv == 7 else rng.randrange(1, 9)
        for t in range(n):
            role = rng.choice(roles) if rng.random() < 0.2 else ["user", "assistant"][t % 2]
            text = rng.choice(["hello", "so be it", "", " ", None, f"turn {rng.randrange(20 * n)}", "é" * 40]) or ""
            rows.append((conv, rng.choice([None, t]) if conv == 3 else t + rng.randrange(2) * (conv == 5), role,
                         None if text == " " and rng.random() < 0.3 else text + rng.choice(ends)))
    return rows + rows[-2:]  # repeated rows


@pytest.mark.parametrize(("seed", "hot", "piece"), [(1, 9, 256), (2, 400, 7), (3, 1200, 16)])
def test_repairs_are_cheapest_and_audits_least(spark, monkeypatch, seed, hot, piece):
    monkeypatch.setattr(turns, "PIECE", piece)
    rows = conversations(seed, hot)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({c: F.lit(1) for c in ("part", "no", "key", "present_")})
    repaired = turns.repair_conversations(turns.damage_turns(df))
    got = turns.summarize_repairs(repaired).collect()
    want = expected(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                                    "repaired_sha256")) == want[r.conv_id], r.conv_id


def test_long_conversation_is_spread_and_whole(spark, monkeypatch):
    """One conversation of nearly all rows lies in several ranges; equal turns meet across them."""
    monkeypatch.setattr(turns, "PIECE", 64)
    rng = random.Random(4)
    rows = [(1, t, ["user", "assistant"][t % 2], f"t{rng.randrange(900)}.") for t in range(3000)] + [(2, 0, "user", "a.")]
    got = turns.repair_conversations(spark.createDataFrame(rows, SCHEMA))
    assert got.filter("conv_id = 1").agg(F.max("piece")).first()[0] >= 3000 // 64
    seen, judged = set(), []
    for _, _, role, text in rows[:3000]:
        judged.append((role[0], (role, text) in seen, False))
        seen.add((role, text))
    total = turns.summarize_repairs(got).filter("conv_id = 1").first()
    assert (total.cost, total.audit) == brute_repair(judged)
    assert total.duplicate == sum(j[1] for j in judged)


def test_random_lattices(spark):
    rng = random.Random(9)
    for _ in range(800):
        rows = [(rng.choice("suuaaax"), rng.random() < 0.2, rng.random() < 0.2) for _ in range(rng.randrange(12))]
        want = brute_repair(rows)
        assert turns.cheapest_edits(rows, turns.NOTHING, turns._CLOSING) == want
        at = rng.randrange(len(rows) + 1)
        parts = [p for p in (rows[:at], rows[at:]) if p]
        cost, states, closing = turns.join_pieces([turns.piece_ways(p) for p in parts])
        audit = "".join(turns.cheapest_edits(p, a, {b: ""})[1] for p, (a, b) in zip(parts, states, strict=True)) + closing
        assert (cost, audit) == want


def test_no_conversations(spark):
    empty = turns.damage_turns(spark.createDataFrame([], SCHEMA))
    assert turns.summarize_repairs(turns.repair_conversations(empty)).count() == 0


# ------------------------------------------------------------------------------------------- op 12
def texts():
    rng = random.Random(6)
    strange = ["".join(rng.choice("ab  \n\t漢字é😀▁<s>0x") for _ in range(n)) for n in (3, 700, 5000)]
    return [None, "", " ", "one", "x" * 9000, "ab " * 4000, "漢字" * 900, "<s></s><|endoftext|>", "a\x00b", "▁▁", "<0x41>",
            " ".join(rng.choice(["alpha", "béta", "12", "so-so"]) for _ in range(6000)), *strange]


@pytest.fixture(scope="module")
def some(spark):
    rows = [(i if i % 5 else None, t) for i, t in enumerate(texts())] * 2
    return rows, spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit(1) for c in ("row", "no", "n", "n_bytes", "last", "side", "pair", "count", "_row")}).repartition(3)


@pytest.mark.parametrize("model", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize(("chunk", "overlap"), [(1 << 16, 256), (300, 4)])
def test_counts_are_the_librarys(some, model, chunk, overlap):
    rows, df = some
    got = tokens.count_tokens(df, model, limit=2000, chunk=chunk, overlap=overlap)
    library = tokens.library(model)
    want = Counter((i, len((t or "").encode()), n, n > 2000) for i, t in rows for n in library.counts([t or ""]))
    assert Counter(tuple(r) for r in got.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()) == want


def test_megabyte_without_boundaries(spark):
    df = spark.createDataFrame([(1, "x" * 1_000_000), (2, "ab " * 350_000)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(df).collect()}
    assert got == {i: tokens.library("piece_bpe_32k.model").counts([t])[0] for i, t in ((1, "x" * 1_000_000), (2, "ab " * 350_000))}


# ------------------------------------------------------------------------------------------- op 13
def brute_alignment(rows):
    """The contract's columns by walking both token lists of every document."""
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    spell = {c: bytes([b]) for c, b in alignment.byte_stand_ins().items()}
    docs, held = [], Counter()
    for doc_id, text in rows:
        want = (" " + (text or "")).encode()
        a = [(i, b"".join(spell[c] for c in first.id_to_token(i))) for i in first.encode(" " + (text or ""), add_special_tokens=False).ids]
        b = [(i, bytes([int(p[3:-1], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode())
             for i in second.encode(text or "") for p in [second.id_to_piece(i)]]
        if not text or any(b"".join(x for _, x in side) != want for side in (a, b)):
            docs.append((doc_id, 0, 0, [], Counter()))
            continue
        ends = [set(), set()]
        for s, side in enumerate((a, b)):
            at = 0
            for _, x in side:
                at += len(x)
                ends[s].add(at)
        common, groups = ends[0] & ends[1], []
        for s, side in enumerate((a, b)):
            at, group, mine = 0, [], []
            for i, x in side:
                at += len(x)
                group.append(i)
                if at in common:
                    mine.append(group)
                    group = []
            groups.append(mine)
        groups = list(zip(*groups, strict=True))
        links = Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        held.update(links.keys())
        docs.append((doc_id, len(a), len(b), groups, links))
    top = Counter()
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    return Counter((d, na, nb, len(g), sum(links.values()), sum(n for p, n in links.items() if held[p] == top[p[0]]),
                    sum(n * held[p] for p, n in links.items()),
                    hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g).encode()).hexdigest()
                    if g else "") for d, na, nb, g, links in docs)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize(("long", "width", "head", "wide"), [(1 << 16, 1 << 15, 500_000, 4096), (200, 64, 40, 2)])
def test_alignment_is_that_of_both_lists(some, monkeypatch, long, width, head, wide):
    rows, df = some
    monkeypatch.setattr(alignment, "FAN", 3)
    monkeypatch.setattr(alignment, "WIDE", wide)
    got = alignment.score_documents(df, head=head, long=long, width=width).select(*COLUMNS).collect()
    assert Counter(map(tuple, got)) == brute_alignment(rows)


def test_composing_is_associative():
    rng = random.Random(2)
    import numpy as np

    for _ in range(200):
        ends = [np.array(sorted(rng.sample(range(1, 60), rng.randrange(1, 30))) + [60]) for _ in range(2)]
        ids = [np.arange(len(e), dtype=np.int32) + 100 * s for s, e in enumerate(ends)]
        whole = alignment.fragment(tuple(ids), tuple(ends))
        edges = sorted(rng.sample(range(60), 4))
        parts = [alignment.fragment(tuple(i[(e > x) & (e <= y)] for i, e in zip(ids, ends, strict=True)),
                                    tuple(e[(e > x) & (e <= y)] for e in ends))
                 for x, y in zip([0, *edges], [*edges, 60], strict=True)]
        left = parts[0]
        for p in parts[1:]:
            left = alignment.compose([left, p])
        right = parts[-1]
        for p in parts[-2::-1]:
            right = alignment.compose([p, right])
        for made in (alignment.compose(parts), left, right):
            assert [x.tolist() for part in alignment.groups_of(made) for x in part] == [
                x.tolist() for part in alignment.groups_of(whole) for x in part]


def test_ranges_are_composed_in_their_order(spark):
    names = ("byte_bpe_50k.json", "piece_bpe_32k.model")
    parts = [alignment.align_text(t, names) for t in ("one two", "three 1234", "größer als", "fünf", "six")]
    tables = [alignment._fragment_table(1, n, p) for n, p in enumerate(parts)]
    rows = [r for t in reversed(tables) for r in t.to_pylist()]
    level = spark.createDataFrame(rows, alignment._FRAGMENT_SQL).coalesce(1)
    made = alignment._read_fragment(alignment._next_level(level).collect()[0].asDict())
    assert [x.tolist() for part in alignment.groups_of(made) for x in part] == [
        x.tolist() for part in alignment.groups_of(alignment.compose(parts)) for x in part]


def test_least_count(spark):
    rng = random.Random(1)
    values = [int(rng.paretovariate(0.7)) for _ in range(500)]
    counts = spark.createDataFrame([(v,) for v in values], "count long")
    for head in (0, 1, 50, 499, 500):
        edge = alignment.least_count(counts, head)
        assert sum(v >= edge for v in values) <= head
        assert edge == 1 or sum(v >= edge - 1 for v in values) > head


def test_empty_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.count_tokens(empty).count() == 0
    assert alignment.score_documents(empty).count() == 0


def test_bytes_of_tokens_are_compared_without_a_list():
    known = alignment._Spelled([b"ab", b"", b"c", b"\xc3\xa4"])
    ids = np.array([2, 0, 3, 1, 2], np.int32)
    ends = known.ends(ids)
    assert ends.tolist() == [1, 3, 5, 5, 6]
    assert known.gives(ids, ends, "cabäc".encode())
    assert not known.gives(ids, ends, "cabäb".encode()) and not known.gives(ids, ends, b"cab")
    assert known.gives(ids[:0], ends[:0], b"") and not known.gives(ids[:0], ends[:0], b"a")
