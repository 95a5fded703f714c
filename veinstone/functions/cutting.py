"""Cutting one unit of text into parts of bounded token size.

The greedy fold over sentences runs in Arrow batches: as nested array
expressions it is interpreted and orders of magnitude slower.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veinstone import fixed_values as fv
from veinstone.config import EngineConfig
from veinstone.functions.batches import pieces

_CJK = re.compile(f"[{fv.CJK_WITH_COMPAT}]")
_WORD = re.compile(fv.ESTIMATE_WORD)
_AFTER_SENTENCE = re.compile(f"(?<=[{fv.SENTENCE_END}])\\s*")
_BLANK_LINE = re.compile(r"\n\s*\n")


def token_estimate(text: str) -> int:
    words = _WORD.findall(text)
    cjk = 0 if text.isascii() else len(_CJK.findall(text))
    other = len(text) - cjk - sum(map(len, words))
    return max(1, cjk + int(len(words) * 1.3) + max(0, other) // 4)


def _stripped(pieces) -> list[str]:
    return [p for p in map(str.strip, pieces) if p]


def _pieces(text: str, top: int) -> Iterator[tuple[str, int]]:
    """Paragraphs, or the sentences of a paragraph over the limit, with their tokens."""
    for paragraph in _stripped(_BLANK_LINE.split(text)):
        size = token_estimate(paragraph)
        if size <= top:
            yield paragraph, size
        else:
            yield from ((s, token_estimate(s)) for s in _stripped(_AFTER_SENTENCE.split(paragraph)))


def parts(text: str, top: int) -> list[str]:
    done, pending, room = [], [], top
    for piece, size in _pieces(text, top):
        if pending and size > room:
            done.append("\n\n".join(pending))
            pending, room = [], top
        if size > top:  # no sentence end to use: equal lengths of characters
            width = max(200, top * max(1, len(piece) // size))
            done += _stripped(piece[i:i + width] for i in range(0, len(piece), width))
        else:
            pending.append(piece)
            room -= size
    return [*done, "\n\n".join(pending)] if pending else done


def overlapping(cut: list[str], top: int, n_words: int) -> list[str]:
    """Each part opened by the last words of the one before, where that still fits."""
    out = cut[:1]
    for before, part in zip(cut, cut[1:]):
        tail = before.split()
        joined = " ".join(tail[-n_words:] if n_words else tail) + "\n\n" + part
        out.append(joined if tail and token_estimate(joined) <= top else part)
    return _stripped(out)


def unit_contents(texts: Column, tables: Column, config: EngineConfig) -> Column:
    """array<array<string>>: the chunk contents of every unit of a document."""
    top, n_words = config.chunk_max_tokens, config.chunk_overlap_tokens

    def contents(text: str, is_table: bool) -> list[str]:
        cut = parts(text, top)
        return _stripped(cut) if is_table else overlapping(cut, top, n_words)

    @F.arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in batches:
            for part, flags in pieces(*batch):
                yield pa.array([[contents(t or "", bool(f)) for t, f in zip(row, flag)]
                                for row, flag in zip(part.to_pylist(), flags.to_pylist())], pa.list_(pa.list_(pa.string())))

    return run(texts, tables)
