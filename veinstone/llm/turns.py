"""Repair of conversations whose turns break the order of roles, with the fewest and cheapest edits.

The edits of a conversation are paths through a lattice: a node is (turns read, state of the role
pattern ``(s?(ua)+)?``). A bidirectional Dijkstra search finds the cheapest path and, of equally cheap
ones, the one whose audit (the edits' initials) is least.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinstone.llm.common import Cuts, group_key

#: Fixed values of the contract: what an edit costs, and what an undeleted truncated turn adds.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States of the role pattern: nothing yet, after s, after u, after a; and where a role leads.
NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
_NEXT = [{"s": AFTER_S, "u": AFTER_U}, {"u": AFTER_U}, {"a": AFTER_A}, {"u": AFTER_U}]
#: The role that may follow by an edit, and the inserts that end the pattern after the last turn.
_EDITED = ["u", "u", "a", "u"]
_CLOSING = {NOTHING: "", AFTER_A: "", AFTER_U: "I", AFTER_S: "II"}
_ROLE = {"u": "user", "a": "assistant"}
#: Turns of a piece: what one search takes at a time of a long conversation.
PIECE = 256
_BLANK = " \t\n\v\f\r"
_FAR = 1 << 60


# ----------------------------------------------------------------------------- one piece
def _steps(turn: tuple[str, bool, bool], state: int) -> list[tuple[int, int, str]]:
    """(next state, cost, initial) of the edits of a turn (initial of its role, must go, truncated)."""
    role, must_go, truncated = turn
    out = [(state, DELETE, "D")]
    if not must_go:
        more = TRUNCATED * truncated
        if role in _NEXT[state]:
            out.append((_NEXT[state][role], more, "K"))
        out.append((_NEXT[state][_EDITED[state]], REROLE + more, "R"))
    return out


def cheapest_edits(turns: list[tuple[str, bool, bool]], entry: int, ends: dict[int, str]) -> tuple[int, str] | None:
    """(cost, audit) of the best edits from state ``entry`` to one of the states ``ends``, whose inserts
    follow the last turn; None where there is no way.

    Two heaps grow towards each other, the cheaper one first. A node's label is (cost, audit): at equal
    cost no audit of a node is the beginning of another, so the least audit of a path consists of the
    least audits of its halves. The search ends when no new crossing can be as cheap as the best one, so
    all equally cheap crossings are known, and the least joined audit is taken. At one cost nodes are
    settled along the turns, because keeping a turn is free.
    """
    n = len(turns)
    back: list[list[list]] = [[[] for _ in range(4)] for _ in range(n + 1)]
    for i, turn in enumerate(turns):
        for state in range(4):
            for to, cost, initial in _steps(turn, state):
                back[i + 1][to].append((i, state, cost, initial))
    inserted = [[] for _ in range(4)]
    for state in range(4):
        inserted[_NEXT[state][_EDITED[state]]].append(state)

    labels = ({(0, entry): (0, "")}, {(n, s): (INSERT * len(e), e) for s, e in ends.items()})
    heaps = ([(0, 0, entry)], sorted((INSERT * len(e), -n, s) for s, e in ends.items()))
    settled = (set(), set())

    def reach(side: int, node: tuple[int, int], cost: int, audit: str) -> None:
        known = labels[side].get(node)
        if known is None or (cost, audit) < known:
            labels[side][node] = (cost, audit)
            if known is None or cost < known[0]:
                heapq.heappush(heaps[side], (cost, -node[0] if side else node[0], node[1]))
            other = labels[1 - side].get(node)
            if other is not None:
                nonlocal best
                best = min(best, cost + other[0])

    best = min((labels[0][x][0] + labels[1][x][0] for x in labels[0].keys() & labels[1].keys()), default=_FAR)
    while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] <= best:
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        cost, place, state = heapq.heappop(heaps[side])
        i = -place if side else place
        if (i, state) in settled[side]:
            continue
        settled[side].add((i, state))
        audit = labels[side][i, state][1]
        if side:
            for j, before, c, initial in back[i][state]:
                reach(1, (j, before), cost + c, initial + audit)
            if i < n:  # inserts stand before a turn; those after the last one are in ``ends``
                for before in inserted[state]:
                    reach(1, (i, before), cost + INSERT, "I" + audit)
        else:
            if i < n:
                for to, c, initial in _steps(turns[i], state):
                    reach(0, (i + 1, to), cost + c, audit + initial)
                reach(0, (i, _NEXT[state][_EDITED[state]]), cost + INSERT, audit + "I")
    if best == _FAR:
        return None
    return best, min(labels[0][x][1] + labels[1][x][1] for x in labels[0].keys() & labels[1].keys()
                     if labels[0][x][0] + labels[1][x][0] == best)


def apply_audit(audit: str, turns: list[tuple[str, str]], state: int) -> list[tuple[str, str]]:
    """The repaired (role, text) list: the audit names the edits, the pattern the new roles."""
    out, at = [], iter(turns)
    for edit in audit:
        if edit == "I":
            role, text = _ROLE[_EDITED[state]], ""
        else:
            role, text = next(at)
            if edit == "D":
                continue
            if edit == "R":
                role = _ROLE[_EDITED[state]]
        out.append((role, text))
        state = _NEXT[state][role[:1]]
    return out


# ----------------------------------------------------------------------------- a conversation
def judge_turns(turns: list[tuple[str, str]], repeated) -> list[tuple[str, bool, bool, str]]:
    """(initial, must go, truncated, first fault) of each turn; ``repeated(i)`` tells later copies."""
    out = []
    for i, (role, text) in enumerate(turns):
        shown = text.rstrip(_BLANK)
        fault = "blank" if not shown else "duplicate" if repeated(i) else "" if shown[-1] in ".!?" else "truncated"
        out.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated", fault))
    return out


def _stats(numbers: list, judged: list) -> dict:
    known = [t for t in numbers if t is not None]
    pairs = [a[0] + b[0] for a, b in zip(judged, judged[1:], strict=False)]
    count = {f: sum(j[3] == f for j in judged) for f in ("blank", "duplicate", "truncated")}
    return count | {"illegal": sum(p not in ("su", "ua", "au") for p in pairs), "turns": len(judged),
                    "low": min(known, default=None), "high": max(known, default=None), "distinct": len(set(known)),
                    "first": judged[0][0] if judged else None, "last": judged[-1][0] if judged else None}


def piece_ways(turns: list[tuple[str, bool, bool]]) -> tuple[list[int], list[int]]:
    """What a piece costs between each two states (entry * 4 + exit), and its audits as ranks."""
    found = [cheapest_edits(turns, entry, {leave: ""}) for entry in range(4) for leave in range(4)]
    rank = {a: i for i, a in enumerate(sorted({f[1] for f in found if f}))}
    return [f[0] if f else _FAR for f in found], [rank[f[1]] if f else -1 for f in found]


def join_pieces(ways: list[tuple[list[int], list[int]]]) -> tuple[int, list[tuple[int, int]], str]:
    """(cost, entry and exit state of each piece, closing inserts) of the best way through all pieces.

    Inserts stand before a turn, so every audit up to the end of a piece ends with an edit of its last
    turn: of two such audits none begins the other unless they are equal, and comparing the ranks piece
    by piece compares the whole audits.
    """
    labels = {NOTHING: (0, 0)}  # state: (cost, rank among the audits so far)
    back = []
    for costs, ranks in ways:
        reached: dict = {}
        for entry, (cost, rank) in labels.items():
            for leave in range(4):
                if costs[entry * 4 + leave] < _FAR:
                    label = (cost + costs[entry * 4 + leave], rank, ranks[entry * 4 + leave])
                    if leave not in reached or label < reached[leave][0]:
                        reached[leave] = (label, entry)
        order = {r: i for i, r in enumerate(sorted({label[1:] for label, _ in reached.values()}))}
        labels = {s: (label[0], order[label[1:]]) for s, (label, _) in reached.items()}
        back.append({s: entry for s, (_, entry) in reached.items()})
    state = min(labels, key=lambda s: (labels[s][0] + INSERT * len(_CLOSING[s]), labels[s][1], _CLOSING[s]))
    cost, closing, states = labels[state][0] + INSERT * len(_CLOSING[state]), _CLOSING[state], []
    for entries in reversed(back):
        states.append((entries[state], state))
        state = entries[state]
    return cost, states[::-1], closing


def repair_turns(turns: list[tuple[str, str]], judged: list) -> tuple[int, str, list[tuple[str, str]]]:
    """(cost, audit, repaired turns) of a whole conversation."""
    plain = [j[:3] for j in judged]
    if len(plain) <= PIECE:
        cost, audit = cheapest_edits(plain, NOTHING, _CLOSING)
        return cost, audit, apply_audit(audit, turns, NOTHING)
    parts = [plain[i:i + PIECE] for i in range(0, len(plain), PIECE)]
    cost, states, closing = join_pieces([piece_ways(p) for p in parts])
    audits = [cheapest_edits(p, entry, {leave: ""})[1] for p, (entry, leave) in zip(parts, states, strict=True)]
    audit = "".join(audits) + closing
    return cost, audit, apply_audit(audit, turns, NOTHING)


# ----------------------------------------------------------------------------- Spark
def damage_turns(conversations: DataFrame) -> DataFrame:
    """Every row of (conv_id, turn, role, text) with the damage that the checksum of its place names.

    Nulls of role and text become one space, as they do in the checksum's input. A dropped row stays as
    a mark (``present`` false, without text); a repeated one comes twice.
    """
    place = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(place) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select("conv_id", "turn", kind.alias("kind"), role.alias("role"), text.alias("text"))
    text = (F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text")))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("kind") != 0).alias("present"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_READ = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))
_NUMBERS = [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
_NUMBERS_SQL = ", ".join(f"{c} long" for c, _ in _NUMBERS)


def _gaps(low, high, distinct) -> int:
    return 0 if low is None else high - low + 1 - distinct


def _closed_row(rows: list) -> dict:
    turns = [(r[1], r[2]) for r in rows]
    first: dict = {}
    for i, t in enumerate(turns):
        first.setdefault(t, i)
    judged = judge_turns(turns, lambda i: first[turns[i]] != i)
    s = _stats([r[0] for r in rows], judged)
    cost, audit, repaired = repair_turns(turns, judged)
    return {c: s[c] for c in ("blank", "duplicate", "truncated", "illegal")} | {
        "gaps": _gaps(s["low"], s["high"], s["distinct"]), "cost": cost, "audit": audit,
        "repaired": [{"role": r, "text": t} for r, t in repaired], "open": False, "part": 0, "no": 0, "read": None}


def _open_rows(rows: list) -> Iterator[dict]:
    for no, i in enumerate(range(0, len(rows), PIECE)):
        yield {"open": True, "no": no, "read": [{"turn": t, "role": r, "text": x} for t, r, x in rows[i:i + PIECE]]}
    if not rows:
        yield {"open": True, "no": 0, "read": []}


def _first_pass(schema: pa.Schema):
    """A task reads a range of the order of all turns. Conversations inside it are repaired; the first and
    the last one may go on in a neighbour's range, so their turns are given on in pieces."""
    def run(batches):
        from pyspark import TaskContext

        part, key, rows, seen, out, size = TaskContext.get().partitionId(), None, [], 0, [], 0
        none = object()
        key = none

        def close(last: bool):
            made = _open_rows(rows) if seen == 1 or last else [_closed_row(rows)]
            return [m | {"conv_id": key, "part": part} for m in made]

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(5)]
            for conv, turn, role, text, present in zip(*columns, strict=True):
                if conv != key or key is none:
                    if key is not none:
                        out += close(False)
                        if size > 1 << 20 or len(out) > 2000:
                            yield pa.RecordBatch.from_pylist(out, schema=schema)
                            out, size = [], 0
                    key, rows, seen = conv, [], seen + 1
                if present:
                    rows.append((turn, role, text))
                    size += len(text)
        if key is not none:
            yield pa.RecordBatch.from_pylist(out + close(True), schema=schema)

    return run


def _piece_rows(schema: pa.Schema):
    """What a piece costs between all states, and its share of the counts."""
    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                judged = _judged_piece(r)
                costs, ranks = piece_ways([j[:3] for j in judged])
                s = _stats([t["turn"] for t in r["read"]], judged)
                out.append({k: r[k] for k in ("key", "part", "no")} | s | {"costs": costs, "ranks": ranks})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _judged_piece(r: dict) -> list:
    fresh = set(r["fresh"] or ())
    return judge_turns([(t["role"], t["text"]) for t in r["read"]], lambda i: i not in fresh)


def _join_conversation(frame: pd.DataFrame) -> pd.DataFrame:
    """The states of all pieces of one conversation, and its sums on its first piece."""
    frame = frame.sort_values(["part", "no"]).reset_index(drop=True)
    cost, states, closing = join_pieces(list(zip(frame["costs"], frame["ranks"], strict=True)))
    out = frame[["key", "part", "no"]].copy()
    out["entry"], out["leave"] = [s[0] for s in states], [s[1] for s in states]
    out["closing"] = [""] * (len(out) - 1) + [closing]
    filled = frame[frame["turns"] > 0]
    first, last = filled["first"].tolist()[1:], filled["last"].tolist()[:-1]
    illegal = int(filled["illegal"].sum()) + sum(a + b not in ("su", "ua", "au") for a, b in zip(last, first, strict=True))
    known = frame[frame["high"].notna()]
    low, high = known["low"].to_numpy(dtype=object), known["high"].to_numpy(dtype=object)
    # the order is by turn, so only the last number of a piece can come again in the next
    distinct = int(known["distinct"].sum()) - sum(int(a) == int(b) for a, b in zip(high[:-1], low[1:], strict=True))
    sums = {"gaps": _gaps(int(low[0]), int(high[-1]), distinct) if len(known) else 0, "illegal": illegal, "cost": cost,
            **{c: int(frame[c].sum()) for c in ("blank", "duplicate", "truncated")}}
    for c, _ in _NUMBERS:
        out[c] = [sums[c]] + [0] * (len(out) - 1)
    return out


def _apply_rows(schema: pa.Schema):
    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                judged = _judged_piece(r)
                audit = cheapest_edits([j[:3] for j in judged], r["entry"], {r["leave"]: ""})[1] + r["closing"]
                turns = [(t["role"], t["text"]) for t in r["read"]]
                repaired = [{"role": x, "text": t} for x, t in apply_audit(audit, turns, r["entry"])]
                out.append({k: r[k] for k in schema.names if k in r} | {"audit": audit, "repaired": repaired})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def repair_conversations(rows: DataFrame, cuts: Cuts | None = None) -> DataFrame:
    """Pieces of repaired conversations: (conv_id, piece, pieces, counts, audit, repaired turns).

    ``rows`` has conv_id, turn, role, text and, as ``damage_turns`` gives it, ``present`` (a row that is
    not present only says that its conversation exists). A conversation's turns are taken by turn (nulls
    first), then role, then text. Nearly every conversation is one piece; gaps, blank, duplicate,
    truncated, illegal and cost stand on the first piece, audit and ``repaired`` (array of role and text)
    are each piece's own, to be read in order. Nulls of role and text are taken as one space; a role
    without letters can only be reroled or deleted; a null conv_id is a conversation; repeated rows are
    duplicates; a conversation without turns has an empty audit; an empty table gives no rows.

    The turns are sorted once over the cluster, in ranges of equal size, so a conversation that holds a
    third of all rows lies in a third of the ranges. It becomes pieces of ``PIECE`` turns: each is searched
    between all pairs of states, 32 numbers a piece are joined in order, and the chosen ways are applied
    where the pieces are. (Only equal beginnings of 64 characters of one role and turn share a range.)
    """
    cuts = cuts or Cuts(rows.sparkSession)
    present = F.col("present") if "present" in rows.columns else F.lit(True)
    space = F.lit(" ")
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"),
                       F.coalesce("text", space).alias("text"), present.alias("present"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role")]
    ranged = rows.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
    ids = rows.schema["conv_id"].dataType
    id_type = pa.int64() if ids.simpleString() == "bigint" else pa.int32() if ids.simpleString() == "int" else pa.string()
    schema = pa.schema([("conv_id", id_type), ("open", pa.bool_()), ("part", pa.int32()), ("no", pa.int64()), *_NUMBERS,
                        ("audit", pa.string()), ("repaired", _TURNS), ("read", _READ)])
    conv = f"conv_id {ids.simpleString()}"
    repaired_sql = "audit string, repaired array<struct<role: string, text: string>>"
    first = cuts.keep(ranged.mapInArrow(
        _first_pass(schema), f"{conv}, open boolean, part int, no long, {_NUMBERS_SQL}, {repaired_sql}, "
        "read array<struct<turn: long, role: string, text: string>>"))
    numbers = [c for c, _ in _NUMBERS]
    one = F.lit(1).cast("long")
    closed = first.filter("not open").select("conv_id", one.alias("piece"), one.alias("pieces"), *numbers, "audit", "repaired")

    pieces = first.filter("open").select(group_key(F.col("conv_id")).alias("key"), "conv_id", "part", "no", "read")
    turns = pieces.select("key", "part", "no", F.posexplode("read").alias("at", "t"))
    digest = F.sha2(F.concat(F.length("t.role").cast("string"), F.lit(":"), F.col("t.role"), F.col("t.text")), 256)
    # the first of equal turns: found by digests, counted together before they are shuffled
    fresh = turns.groupBy("key", digest.alias("digest")).agg(F.min(F.struct("part", "no", "at")).alias("f")).groupBy(
        "key", F.col("f.part").alias("part"), F.col("f.no").alias("no")).agg(F.collect_list("f.at").alias("fresh"))
    place = ["key", "part", "no"]
    pieces = cuts.keep(pieces.join(fresh, place, "left"))
    stat = [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "distinct")]
    way_schema = pa.schema([("key", pa.string()), ("part", pa.int32()), ("no", pa.int64()), *stat, ("first", pa.string()),
                            ("last", pa.string()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32()))])
    ways = pieces.select("key", "part", "no", "read", "fresh").mapInArrow(
        _piece_rows(way_schema), "key string, part int, no long, " + ", ".join(f"{c} long" for c, _ in stat)
        + ", first string, last string, costs array<long>, ranks array<int>")
    joined = ways.groupBy("key").applyInPandas(
        _join_conversation, f"key string, part int, no long, entry int, leave int, closing string, {_NUMBERS_SQL}")
    apply_schema = pa.schema([("conv_id", id_type), ("key", pa.string()), ("part", pa.int32()), ("no", pa.int64()), *_NUMBERS,
                              ("audit", pa.string()), ("repaired", _TURNS)])
    done = cuts.keep(pieces.join(joined, place).mapInArrow(
        _apply_rows(apply_schema), f"{conv}, key string, part int, no long, {_NUMBERS_SQL}, {repaired_sql}"))
    order = Window.partitionBy("key").orderBy("part", "no")
    numbered = done.select(*place, F.row_number().over(order).cast("long").alias("piece"),
                           F.count("*").over(Window.partitionBy("key")).alias("pieces"))
    return closed.unionByName(done.join(numbered, place).select(
        "conv_id", "piece", "pieces", *numbers, "audit", "repaired"))


def _lines(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"]))


def _digest_pieces(schema: pa.Schema):
    """Reads pieces in order; a conversation's digest takes one piece after the other."""
    def run(batches):
        key = row = digest = None
        for batch in batches:
            for r in batch.to_pylist():
                if row is None or r["key"] != key:
                    if row is not None:
                        yield pa.RecordBatch.from_pylist([_digested(row, digest, audits)], schema=schema)
                    key, row, digest, audits, empty = r["key"], r, hashlib.sha256(), [], True
                for line in r["lines"]:
                    digest.update(line.encode() if empty else b"\n" + line.encode())
                    empty = False
                audits.append(r["audit"])
        if row is not None:
            yield pa.RecordBatch.from_pylist([_digested(row, digest, audits)], schema=schema)

    return run


def _digested(row: dict, digest, audits: list[str]) -> dict:
    return {c: row[c] for c, _ in [("conv_id", 0), *_NUMBERS]} | {
        "audit": "".join(audits), "repaired_sha256": digest.hexdigest()}


def summarize_repairs(pieces: DataFrame) -> DataFrame:
    """One row a conversation: its counts, cost, whole audit and the digest of its repaired lines.

    Conversations of one piece are summed where they lie. The digest of a longer one is sequential by
    nature: its pieces are read in order by one task, which holds a batch of them at a time.
    """
    numbers = [c for c, _ in _NUMBERS]
    plain = pieces.filter("pieces = 1").select("conv_id", *numbers, "audit", F.sha2(
        F.array_join(_lines(F.col("repaired")), "\n"), 256).alias("repaired_sha256"))
    long = pieces.filter("pieces > 1").select(group_key(F.col("conv_id")).alias("key"), "piece", "conv_id", *numbers, "audit",
                                              _lines(F.col("repaired")).alias("lines"))
    ids = pieces.schema["conv_id"].dataType.simpleString()
    id_type = pa.int64() if ids == "bigint" else pa.int32() if ids == "int" else pa.string()
    schema = pa.schema([("conv_id", id_type), *_NUMBERS, ("audit", pa.string()), ("repaired_sha256", pa.string())])
    read = long.repartition("key").sortWithinPartitions("key", "piece").mapInArrow(
        _digest_pieces(schema), f"conv_id {ids}, {_NUMBERS_SQL}, audit string, repaired_sha256 string")
    return plain.unionByName(read)
