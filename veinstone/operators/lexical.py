"""The search projection and field-weighted lexical retrieval for many questions.

The score of a chunk is the cover-density rank of an OR of the question's
tokens (closed form for single-token covers), a bonus for shared exact terms,
a bonus per contained signal and the trigram similarity of the two texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinstone import fixed_values as fv
from veinstone.cluster import cut_lineage, join_small
from veinstone.functions import text as tx

#: Questions that one pass over the index answers, the questions and rows scored at a time in a task,
#: and the words whose signals a task remembers: bounds of memory, the results do not depend on them.
QUERY_BLOCK, QUERY_STEP, ROW_STEP, KNOWN_WORDS = 4096, 256, 2048, 200_000
_WORD = re.compile(r"[^\W_]+")


def postings(filename: Column, title: Column, content: Column) -> Column:
    """``array<struct<token, weight>>`` of three normalized fields.

    A token weighs 4 for the file name, 3 for the title and 1 for the content,
    each field counted once however often the token occurs in it.
    """
    def weighted(field: Column, weight: int) -> Column:
        return F.transform(tx.lexical_tokens(field), lambda t: F.struct(
            t.alias("token"), F.lit(weight).alias("weight")))

    return F.concat(weighted(filename, fv.FILENAME_WEIGHT), weighted(title, fv.TITLE_WEIGHT),
                    weighted(content, fv.CONTENT_WEIGHT))


def search_projection(chunks: DataFrame) -> DataFrame:
    """Add the search columns to chunk rows; map-only, rebuildable at any time.

    Rows whose texts are ASCII never meet a Python worker: they are projected by built-in expressions
    alone, the others fold their texts in Arrow batches. ``chunks`` should be stored, as each kind of row
    reads it.
    """
    fields = [F.coalesce(c, F.lit("")) for c in ("filename", "heading_path", "content")]
    plain = tx.is_ascii(F.concat(*fields))
    return _projected(chunks.filter(plain), fields, lambda text: tx.collapse_space(F.lower(text))).unionByName(
        _projected(chunks.filter(~plain), fields, tx.normalize_search_text))


def _projected(chunks: DataFrame, fields: list[Column], normalize) -> DataFrame:
    names = ["_filename", "_title", "_content"]
    normalized = chunks.withColumns({name: normalize(text) for name, text in zip(names, fields, strict=True)})
    # the fields have single blanks already, so only empty ones could leave two
    raw_text = F.concat_ws(" ", *[F.when(F.col(name) != "", F.col(name)) for name in names])
    return normalized.withColumns({"raw_text": raw_text, "postings": postings(*map(F.col, names))}).withColumn(
        "exact_terms", tx.exact_terms(F.col("raw_text"))).drop(*names)


def question_terms(queries: DataFrame, text: str = "text", token_limit: int = fv.QUERY_TOKEN_LIMIT,
                   signal_limit: int = fv.SIGNAL_LIMIT) -> DataFrame:
    """(query_id, tokens, exact, signals, grams) of each question, with ``project_ids`` where it has them.

    The limits are those of the published question side; they may be raised.
    """
    scope = [c for c in queries.columns if c == "project_ids"]
    n = F.col("_n")
    return queries.select("query_id", *scope, tx.normalize_search_text(F.col(text)).alias("_n")).select(
        "query_id", *scope, tx.lexical_tokens(n, token_limit).alias("tokens"), tx.exact_terms(n).alias("exact"),
        tx.query_signals(n, signal_limit).alias("signals"), tx.trigrams(n).alias("grams"))


@dataclass
class _Side:
    """One kind of term of some questions: the terms, and the questions of each as ranges of ``of``."""

    terms: list = field(default_factory=list)
    starts: np.ndarray = None
    of: np.ndarray = None

    @classmethod
    def read(cls, lists: list[list[str]]) -> _Side:
        where: dict[str, list[int]] = {}
        for i, terms in enumerate(lists):
            for term in terms or ():
                where.setdefault(term, []).append(i)
        counts = [len(v) for v in where.values()]
        return cls(list(where), np.cumsum([0, *counts]), np.array([i for v in where.values() for i in v], np.int64))

    def totals(self, rows: np.ndarray, term: np.ndarray, weight: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
        """The sum of the weights of a row's terms, for each row and question."""
        n = self.starts[term + 1] - self.starts[term]
        at = np.arange(n.sum()) + np.repeat(self.starts[term] - (np.cumsum(n) - n), n)
        cell = np.repeat(rows, n) * shape[1] + self.of[at]
        return np.bincount(cell, np.repeat(weight, n), shape[0] * shape[1]).reshape(shape)


class SignalsInside:
    """Finds the signals inside a word by equality of substrings.

    A place of the word is cut only into the lengths of the signals that begin with its (at most three)
    characters, so most places cost one look.
    """

    def __init__(self, number_of: dict[str, int], head: int = 3):
        self.number_of = number_of
        lengths: dict[int, dict[str, set[int]]] = {}
        for signal in number_of:
            size = min(head, len(signal))
            lengths.setdefault(size, {}).setdefault(signal[:size], set()).add(len(signal))
        self.lengths = list(lengths.items())

    def __call__(self, word: str) -> tuple[int, ...]:
        number_of = self.number_of
        return tuple({number_of[part] for size, of in self.lengths for i in range(len(word) - size + 1)
                      for n in of.get(word[i:i + size], ()) if (part := word[i:i + n]) in number_of})


class _Questions:
    """A step of questions: what their terms are, and the best chunks so far."""

    def __init__(self, rows: list, k: int):
        self.k = k
        self.tokens, self.exact, self.signals = (_Side.read([r[c] for r in rows]) for c in ("tokens", "exact", "signals"))
        self.vocabulary = {c: pa.array(side.terms, pa.string()) for c, side in (("tokens", self.tokens), ("exact", self.exact))}
        self.signal_no = {s: i for i, s in enumerate(self.signals.terms)}
        self.find = SignalsInside(self.signal_no)
        self.grams = [frozenset(r["grams"]) for r in rows]
        self.projects = [frozenset(r["project_ids"] or ()) if "project_ids" in r else frozenset() for r in rows]
        self.best: list[list[tuple[float, str]]] = [[] for _ in rows]
        self.known: dict[str, tuple[int, ...]] = {}

    def signals_of(self, word: str) -> tuple[int, ...]:
        """Signals inside a word (a signal holds no space)."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) > KNOWN_WORDS:
                self.known.clear()
            found = self.known[word] = self.find(word)
        return found

    def inside(self, raw: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, signal) once for each signal inside a word of a text; each distinct word is looked at once."""
        words = pc.split_pattern(raw, " ")
        row = np.repeat(np.arange(len(raw)), np.asarray(pc.fill_null(words.value_lengths(), 0)))
        coded = pc.dictionary_encode(words.flatten())
        found, code = [self.signals_of(w) for w in coded.dictionary.to_pylist()], np.asarray(coded.indices, np.int64)
        held = np.array([s for of in found for s in of], np.int64)
        n = np.array([len(of) for of in found], np.int64)
        start, n = (np.cumsum(n) - n)[code], n[code]
        term = held[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        return np.divmod(np.unique(np.repeat(row, n) * len(self.signal_no) + term), len(self.signal_no))

    def score(self, chunk_ids, raw, postings, exact, projects) -> None:
        shape = (len(chunk_ids), len(self.best))
        weight = self._matched("tokens", self.tokens, postings.flatten().field("token"), postings,
                               np.asarray(postings.flatten().field("weight"), float), shape)
        hits = self._matched("exact", self.exact, exact.flatten(), exact, None, shape) > 0
        rows, term = self.inside(raw) if self.signal_no else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        signals = self.signals.totals(rows, term, np.ones(len(term)), shape) if len(term) else np.zeros(shape)
        x = fv.RANK_UNIT * weight
        base = x / (x + 1.0) * fv.RANK_SCALE + fv.EXACT_TERM_SCORE * hits + fv.SIGNAL_SCORE * signals
        grams: dict[int, set] = {}
        for q in range(shape[1]):
            column = base[:, q]
            rows = np.flatnonzero(column > 0)
            if self.projects[q] and len(rows):
                rows = rows[[projects[i] in self.projects[q] for i in rows]]
            if not len(rows):
                continue
            # the similarity lies in [0, 1]: nobody more than 1 below the k-th best can still get in
            edge = self.best[q][-1][0] * -1 if len(self.best[q]) >= self.k else -np.inf
            if len(rows) > self.k:
                edge = max(edge, np.partition(column[rows], -self.k)[-self.k])
            asked = self.grams[q]
            for i in rows[column[rows] >= edge - 1.0 - 1e-9]:
                own = grams.get(i)
                if own is None:
                    own = grams[i] = _trigrams(raw[i].as_py())
                shared = len(own & asked)
                total = len(own) + len(asked) - shared
                self.best[q].append((-round(column[i] + (shared / total if total else 0.0), 12), chunk_ids[i]))
            self.best[q] = sorted(self.best[q])[:self.k]

    def _matched(self, kind, side, values, lists, weight, shape):
        term = pc.index_in(values, value_set=self.vocabulary[kind])
        valid = np.asarray(pc.is_valid(term))
        rows = np.repeat(np.arange(shape[0]), np.asarray(pc.fill_null(lists.value_lengths(), 0)))[valid]
        number = np.asarray(term.drop_null(), np.int64)
        return side.totals(rows, number, np.ones(len(number)) if weight is None else weight[valid], shape)


def _trigrams(text: str) -> set[str]:
    return {f"  {word} "[i:i + 3] for word in _WORD.findall(text) for i in range(len(word) + 1)}


def _search(questions, k: int, scoped: bool):
    """A task: score its chunks against all questions, keep the best k of each."""
    def run(batches):
        rows = questions.value
        steps = [_Questions(rows[i:i + QUERY_STEP], k) for i in range(0, len(rows), QUERY_STEP)]
        for batch in batches:
            for at in range(0, batch.num_rows, ROW_STEP):
                part = batch.slice(at, ROW_STEP)
                columns = part.column(0).to_pylist(), part.column(1), part.column(2), part.column(3)
                places = part.column(4).to_pylist() if scoped else None
                for step in steps:
                    step.score(*columns, places)
        best = [(n * QUERY_STEP + q, chunk, -score) for n, step in enumerate(steps)
                for q, found in enumerate(step.best) for score, chunk in found]
        if best:
            numbers, chunks, scores = zip(*best, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(chunks, pa.string()), pa.array(scores, pa.float64())],
                                             names=["_no", "chunk_id", "score"])

    return run


def top_per_query(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """First ``k`` rows of each question; each task keeps only its own best ``k``
    rows per question before they are shuffled."""
    window = Window.partitionBy("query_id").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def lexical_search(index: DataFrame, queries: DataFrame, k: int, text: str = "text",
                   query_block: int = QUERY_BLOCK) -> DataFrame:
    """Best ``k`` chunks per question with rank and score; ``index`` is in scope already.

    A chunk is one row, so it is scored where it lies: each task holds the questions' terms (at most
    ``query_block`` questions at a time, a bound on what is broadcast) and keeps its own best ``k``
    for each question.  Only ids and scores of those are shuffled and ranked; the other columns are
    joined to the final hits.
    """
    spark, scoped = index.sparkSession, "project_ids" in queries.columns
    terms = cut_lineage(question_terms(queries, text).withColumn("_block", F.xxhash64("query_id")))
    blocks = -(-terms.count() // query_block)
    columns = ["chunk_id", "raw_text", "postings", "exact_terms", *(["project_id"] if scoped else [])]
    hits = None
    for b in range(blocks):
        rows = terms.filter(F.pmod("_block", F.lit(blocks)) == b).drop("_block").collect()
        questions = spark.sparkContext.broadcast([r.asDict() for r in rows])
        numbered = spark.createDataFrame([(i, r.query_id) for i, r in enumerate(rows)],
                                         f"_no int, query_id {dict(queries.dtypes)['query_id']}")
        found = index.select(*columns).mapInArrow(_search(questions, k, scoped), "_no int, chunk_id string, score double")
        found = found.join(numbered, "_no").drop("_no")
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = queries.select("query_id", F.lit(None).cast("string").alias("chunk_id"), F.lit(0.0).alias("score")).limit(0)
    ranked = cut_lineage(top_per_query(hits, k, F.desc("score"), F.asc("chunk_id")))
    return join_small(index, ranked, "chunk_id").select("query_id", *index.columns, "score", "rank")
