"""Secret scans: base patterns plus assignment-aware lexing with constant propagation."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinstone.functions.batches import slices

#: Fixed values of the contract: base patterns and the least length of what they must hold.
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so short ones can be left out at once
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
KINDS = ("assign", "access", "hex", "literal")

KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_HEX_TABLE = bytes(120 if chr(i) in "0123456789abcdef" else 32 for i in range(256))

#: How much a word inside a target name speaks for a secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9,
    "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "bearer": 0.8, "auth": 0.6, "key": 0.5,
    "private": 0.5, "access": 0.4, "api": 0.4, "signature": 0.5, "pass": 0.8}
PLACEHOLDERS = ("example", "changeme", "placeholder", "your", "dummy", "xxxx", "none", "null", "true", "false")
LEAST_SCORE = 0.75

_WORDS_OF_NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_QUOTED = {'"': r'''"(?:[^"\\\n]|\\.)*"''', "'": r"""'(?:[^'\\\n]|\\.)*'"""}
_OTHER = (r"""(?P<name>[A-Za-z_][A-Za-z0-9_.\-]*)|(?P<assign>:=|=>|==|!=|\+=|[=:])|(?P<plus>\+)"""
          r"""|(?P<bare>[^\s"'=:+,;(){}\[\]<>]+)|(?P<stop>[,;(){}\[\]<>\n])""")


def _tokens(quotes: str) -> re.Pattern:
    strings = "|".join(_QUOTED[q] for q in quotes)
    return re.compile(f"(?P<string>{strings})|{_OTHER}" if quotes else _OTHER, re.ASCII)


#: Tokens, by the quotes that are not known to stay open until the line ends.
_TOKENS = {(a, b): _tokens("\"" * (not a) + "'" * (not b)) for a in (False, True) for b in (False, True)}
#: A type between ``:`` and the sign that the value follows: its first name, and what no type holds.
_TYPE_NAME = re.compile(r"[ \t]*(?:[&*?]|dyn |mut |const )*([A-Za-z_][A-Za-z0-9_.]*)", re.ASCII)
_NOT_IN_TYPE = re.compile(r"[^\[\]<>()|*?,.:\w \t'\"]", re.ASCII)
_ENDS_TYPE = re.compile(r"[\]>)|*?\w'\"]", re.ASCII)
_ALTERNATIVE = frozenset(("or", "and", "if", "else", "||", "&&", "??", "?", "|"))
_SIGNS = frozenset(("=", ":", ":=", "=>", "+="))
#: Names of arguments that stand for the value of the whole call.
_STANDS_IN = frozenset(("default", "fallback", "value", "val", "otherwise"))
_PAIRS = {")": "(", "]": "[", "}": "{"}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns that hold enough, leftmost and non-overlapping per kind."""
    found = []
    lowered = text.lower()
    if any(word in lowered for word in KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text)
                  if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if b"x" * LEAST_HEX in text.encode("ascii", "replace").translate(_HEX_TABLE):
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def name_weight(name: str) -> float:
    """The strongest sensitive word of a target name, raised a little by a second one."""
    words = [w.lower() for w in _WORDS_OF_NAME.findall(name)]
    words += [a + b for a, b in zip(words, words[1:], strict=False)]
    weights = sorted((SENSITIVE.get(w, 0.0) for w in words), reverse=True)
    return min(1.0, weights[0] + 0.5 * sum(weights[1:2])) if weights else 0.0


_EDGE = max(map(len, PLACEHOLDERS)) - 1


class Literal:
    """A value without its text: what its weight needs, and its parts. Joined values share their parts,
    so constants of any length propagate without copies."""

    __slots__ = ("size", "counts", "head", "tail", "placeholder", "span", "parts")

    def __init__(self, value: str, start: int, end: int):
        lowered = value.lower()
        self.size, self.counts, self.span, self.parts = len(value), Counter(value), (start, end), ()
        self.head, self.tail = lowered[:_EDGE], lowered[-_EDGE:]
        self.placeholder = any(p in lowered for p in PLACEHOLDERS)

    @classmethod
    def joined(cls, one: Literal | None, two: Literal) -> Literal:
        if one is None:
            return two
        out = cls.__new__(cls)
        out.size, out.counts, out.span, out.parts = one.size + two.size, one.counts + two.counts, None, (one, two)
        out.head, out.tail = (one.head + two.head)[:_EDGE], (one.tail + two.tail)[-_EDGE:]
        out.placeholder = one.placeholder or two.placeholder or any(p in one.tail + two.head for p in PLACEHOLDERS)
        return out

    def weight(self) -> float:
        """How random a literal looks, from 0 to 1: length, entropy of its characters, kinds of characters."""
        if self.size < 8 or self.placeholder:
            return 0.0
        entropy = -sum(c / self.size * math.log2(c / self.size) for c in self.counts.values())
        blank = any(c.isspace() for c in self.counts)
        kinds = sum((any(c.isdigit() for c in self.counts), any(c.islower() for c in self.counts),
                     any(c.isupper() for c in self.counts), any(not c.isalnum() and not c.isspace() for c in self.counts)))
        # words with blanks speak for a secret only under the strongest names, unless characters of three kinds are mixed
        return min(1.0, entropy / 4.0) * ((1.0 if kinds >= 3 else 0.65) if blank else 1.0 if kinds >= 2 else 0.4)

    def spans(self, done: set[int]):
        """The spans of all parts, without parts that are in ``done``."""
        todo = [self]
        while todo:
            part = todo.pop()
            if id(part) in done:
                continue
            done.add(id(part))
            if part.span:
                yield part.span
            todo += reversed(part.parts)


def literal_weight(value: str) -> float:
    return Literal(value, 0, len(value)).weight()


class _Place:
    """An open bracket (or the text itself) of the lexer: whose value is being read, and how far."""

    __slots__ = ("opener", "base", "targets", "value", "waits", "grows")

    def __init__(self, opener: str, base: tuple[str, ...]):
        self.opener, self.base, self.targets, self.value = opener, base, base, None
        self.waits, self.grows = bool(base), False  # a value may start here; += keeps the old one


class _Finder:
    """The next token from a place on. A quote that nothing closes on its line leaves all later quotes of
    its kind on that line open, too (between them all are escaped), so they are not tried again."""

    def __init__(self, text: str):
        self.text, self.open = text, {'"': 0, "'": 0}

    def __call__(self, at: int) -> re.Match | None:
        text, open_ = self.text, self.open
        m = _TOKENS[at < open_['"'], at < open_["'"]].search(text, at)
        end = m.start() if m else len(text)
        if end > at:
            for quote in open_:
                if at >= open_[quote] and (place := text.find(quote, at, end)) >= 0:
                    line = text.find("\n", place)
                    open_[quote] = len(text) if line < 0 else line
        return m


class _NextSign:
    """The first ``=`` or ``:`` from a place on; each is looked for again only once it is passed."""

    def __init__(self, text: str):
        self.text, self.known = text, {"=": -1, ":": -1}

    def __call__(self, at: int) -> int | None:
        for sign, place in self.known.items():
            if place < at:
                found = self.text.find(sign, at)
                self.known[sign] = len(self.text) if found < 0 else found
        first = min(self.known.values())
        return first if first < len(self.text) else None


class _Types:
    """(first name of the type, where the value's sign ends) if a type and ``=`` follow a ``:``.

    Whether a run of what types are written with ends at an ``=`` does not depend on where in the run a
    type begins, so a run is read once.
    """

    def __init__(self, text: str):
        self.text, self.stop, self.end, self.good = text, -1, 0, False

    def __call__(self, at: int) -> tuple[str, int] | None:
        name = _TYPE_NAME.match(self.text, at)
        if name is None:
            return None
        if self.stop < name.end():
            self._read(name.end())
        text, stop = self.text, self.stop
        if not self.good or self.end > name.end() and not _ENDS_TYPE.match(text, self.end - 1):
            return None
        return name[1], stop + 1

    def _read(self, at: int) -> None:
        text = self.text
        found = _NOT_IN_TYPE.search(text, at)
        self.stop = stop = found.start() if found else len(text)
        self.good = text[stop:stop + 1] == "=" and text[stop + 1:stop + 2] not in ("=", ">")
        if self.good:  # the type itself ends before blanks and the colon of ``:=``
            end = stop - (text[stop - 1] == ":")
            while end > at and text[end - 1] in " \t":
                end -= 1
            self.end = end


def assigned_literals(text: str):
    """(name, Literal) of every assignment in ``text``, constants propagated.

    An assignment is a name (or a quoted key) before ``=``, ``:``, ``:=``, ``=>`` or ``+=``, with or without a
    type between; its value is one literal, a name assigned before, or several of these joined by ``+`` or
    put side by side. The value may start on a following line and lie in brackets or be an argument of a
    call; each element counts for the name. Unquoted words count as literals outside of parentheses. The
    tokens of the whole text are one stream; lines without a sign are passed over between assignments.
    """
    known: dict[str, Literal] = {}
    place = _Place("", ())
    stack, open_ = [place], Counter()
    at, size = 0, len(text)
    last, fresh = None, True  # the token before, and whether a line ended since
    find, sign_after, type_at = _Finder(text), _NextSign(text), _Types(text)

    def settle(done: bool):
        """The value read so far, for every name that it is assigned to."""
        value = place.value
        place.value = None
        names = place.targets
        if value is not None:
            for name in names:
                if place.grows and name in known:
                    value = Literal.joined(known[name], value)
                yield name, value
                # an unquoted name that is a type must not become a constant
                if name in names[:1] or name_weight(name):
                    known[name] = value
        if done:
            place.targets, place.waits, place.grows = place.base, False, False

    def reset():
        nonlocal place
        del stack[1:]
        open_.clear()
        place = stack[0]

    while at < size:
        if fresh and len(stack) == 1 and not place.targets:
            sign = sign_after(at)
            if sign is None:
                break
            at = max(at, text.rfind("\n", at, sign) + 1)
        m = find(at)
        if m is None:
            break
        at, kind, token = m.end(), m.lastgroup, m[0]
        if token == "\n":
            if last == "\\":
                last = None
                continue
            fresh = True
            if len(stack) > 1 and not any(p.base or p.targets for p in stack):
                reset()
            if len(stack) == 1 and place.value is None and not place.waits:
                place.targets = ()
            # a value that is complete waits for a sign of going on, see below
            if len(stack) == 1 and place.value is not None and not place.waits:
                following = find(_ahead(text, at))
                if following is None or following.lastgroup != "plus":
                    yield from settle(True)
            continue
        after = fresh
        fresh = False
        if kind in ("string", "name", "bare"):
            if (after and len(stack) > 1 and not place.waits and last not in (None, ",", "(", "[", "{", "+", "\\")
                    and last not in _ALTERNATIVE and token not in _ALTERNATIVE and not (kind == "string" and last == "string")):
                # no comma before a new line: in braces the next statement, else a bracket that is not closed
                yield from settle(True)
                if place.opener == "{":
                    place.base = place.targets = ()
                else:
                    reset()
                    yield from settle(True)
                    place.targets, place.waits = (), False
            following = find(at)
            sign = following if following is not None and following.lastgroup == "assign" and following[0] not in ("==", "!=") else None
            if sign is not None and kind != "bare":
                if kind == "string" and place.waits and last in _SIGNS:  # a value, whatever follows
                    place.value = Literal.joined(place.value, Literal(token[1:-1], m.start() + 1, m.end() - 1))
                yield from settle(True)
                at = sign.end()
                name = token.strip("\"'")
                names = (name,)
                typed = type_at(at) if sign[0] == ":" else None
                if typed:
                    names += (typed[0],)
                    at = typed[1]
                # arguments that stand in for the value count for the name outside, too
                outside = place.base if name.lower() in _STANDS_IN else ()
                place.targets, place.waits, place.grows = names + outside, True, sign[0] == "+="
                if sign[0] == "=" and (again := _CHAINED.match(text, at)):
                    place.targets += (again[1],)
                    at = again.end()
                last = sign[0]
                continue
            if token in _ALTERNATIVE and kind != "string" and place.targets and last is not None and last not in _SIGNS:
                yield from settle(False)
                place.waits, last = True, token
                continue
            if token == "\\":
                last = token
                continue
            joins = kind == "string" and last == "string" and place.value is not None
            if place.targets and (place.waits or joins):
                if kind == "string":
                    part = Literal(token[1:-1], m.start() + 1, m.end() - 1)
                    if part.size or last != "string":
                        place.value = Literal.joined(place.value, part)
                    # an empty string right before another quote opens a text of several lines
                    place.waits = not part.size and text[at:at + 2] == token[0] + "\n"
                elif token in known:
                    place.value, place.waits = Literal.joined(place.value, known[token]), False
                elif text[at:at + 1] in ("(", "[") and not any(c.isdigit() for c in token):
                    pass  # the value is what stands in the brackets
                elif place.opener == "(" and last not in _SIGNS:
                    place.waits = False
                else:
                    while (more := find(at)) and more.start() == at and more.lastgroup in ("name", "bare"):
                        at = more.end()
                    place.value = Literal.joined(place.value, Literal(text[m.start():at], m.start(), at))
                    place.waits = text[at:at + 1] == "("
                    if place.waits:
                        yield from settle(False)
            last = "string" if kind == "string" else token
            continue
        if kind == "plus":
            place.waits = bool(place.targets) and place.value is not None or place.waits
        elif token in ("(", "[", "{"):
            inner = _Place(token, place.targets if place.waits else ())
            if token == "[" and last is not None and place.waits and text[m.start() - 1:m.start()].isalnum():
                inner = _Place(token, ())  # a subscript
            place.waits = False
            stack.append(inner)
            open_[token] += 1
            place = inner
        elif token in _PAIRS:
            if open_[_PAIRS[token]]:
                while True:
                    opener, value, single = place.opener, place.value, place.targets == place.base
                    if not (opener == "(" and single and value is not None):
                        yield from settle(True)
                    stack.pop()
                    open_[opener] -= 1
                    place = stack[-1]
                    if opener == "(" and single and value is not None:
                        place.value = Literal.joined(place.value, value)
                    if opener == _PAIRS[token]:
                        break
            elif len(stack) == 1:
                yield from settle(True)
        elif token == ",":
            yield from settle(True)
            place.waits = bool(place.base)
        elif token in (";", "<", ">"):
            yield from settle(True)
            if token == ";" and len(stack) > 1:
                if place.opener == "{":
                    place.base = place.targets = ()
                else:
                    reset()
                    yield from settle(True)
        last = token
    while stack:
        yield from settle(True)
        stack.pop()
        place = stack[-1] if stack else place


_CHAINED = re.compile(r"[ \t]*([A-Za-z_][A-Za-z0-9_.]*)[ \t]*=(?![=>])", re.ASCII)
_BLANKS = re.compile(r"\s*")


def _ahead(text: str, at: int) -> int:
    return _BLANKS.match(text, at).end()


def scan(text: str) -> list[tuple[int, int, str]]:
    """All spans of a text by start, then kind as listed: the base spans, and the literals of sensitive
    assignments that no base span covers."""
    found = base_spans(text)
    if "=" in text or ":" in text:
        starts = sorted((s, e) for s, e, _ in found)
        reach = list(accumulate((e for _, e in starts), max))  # how far the spans up to each one go
        starts = [s for s, _ in starts]

        def covered(s, e):
            n = bisect_right(starts, s)
            return n > 0 and reach[n - 1] >= e

        extra, done, held = set(), set(), []
        for name, value in assigned_literals(text):
            if (weight := name_weight(name)) and 0.5 * weight + 0.5 * value.weight() >= LEAST_SCORE:
                held.append(value)  # parts are told apart by id while they live
                extra |= {(s, e, "literal") for s, e in value.spans(done)
                          if e > s and not covered(s, e)}
        found += extra
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def digest_text(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redact(text: str, spans, mark: str = "<secret>") -> str:
    out, at = [], 0
    for start, end, _ in spans:
        if end <= at:
            continue
        out += [text[at:max(at, start)], mark] if start >= at else []
        at = end
    return "".join([*out, text[at:]])


_SCHEMA = ("doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
           "secrets array<struct<start:int,end:int,kind:string>>")


def scan_documents(documents: DataFrame) -> DataFrame:
    """Secrets of every document: counts, the digest of the base spans, all spans (code points).

    A null text counts as empty: no spans, the digest of the empty string. Repeated rows are scanned
    alike; a null doc_id stays null; an empty table gives no rows; other columns are not read. Texts
    are scanned whole, in one stream of tokens; nothing is shuffled.
    """
    def run(batches):
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                spans = scan(text.as_py() or "")
                base = [s for s in spans if s[2] != "literal"]
                count = Counter(kind for _, _, kind in base)
                rows.append((doc_id, count["assign"], count["access"], count["hex"],
                             hashlib.sha256(digest_text(base).encode()).hexdigest(), digest_text(spans),
                             [{"start": s, "end": e, "kind": k} for s, e, k in spans]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True), _ARROW, strict=True)]
                if rows else [pa.array([], field.type) for field in _ARROW], schema=_ARROW)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _SCHEMA)


_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
    ("base_sha256", pa.string()), ("spans", pa.string()),
    ("secrets", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])))])


def redact_documents(documents: DataFrame) -> DataFrame:
    """``documents`` with every span replaced by a mark and ``n_chars`` counted anew where it was known.

    All rows and columns stay; null texts stay null.
    """
    names = documents.columns
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for batch in slices(batches):
            texts, touched = [], []
            for value in batch.column(at):
                text = value.as_py()
                spans = scan(text) if text else []
                texts.append(redact(text, spans) if spans else text)
                touched.append(bool(spans))
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            if size is not None:
                columns[size] = pa.array(
                    [len(t) if hit and n is not None else n for t, hit, n in
                     zip(texts, touched, columns[size].to_pylist(), strict=True)], columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return documents.mapInArrow(run, documents.schema)
