"""Text functions as Spark column expressions.

Everything is a built-in expression except Unicode NFKC and full case folding,
which Spark does not have; those go through one Arrow UDF that only receives
the texts containing non-ASCII characters.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veinstone import fixed_values as fv


def java(pattern: str) -> str:
    """The same pattern with Unicode character classes for the JVM.

    The costly Unicode mode is only switched on where a class needs it.
    """
    if any(c in pattern for c in (r"\s", r"\w", r"\b")):
        return "(?U)" + pattern
    return pattern.replace(r"\d", r"\p{Nd}")


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(fv.SPACE))


def collapse_space(text: Column) -> Column:
    """Single blanks between words; texts that have nothing else are passed as they are."""
    other = fv.SPACE.replace(" ", "")
    untidy = text.rlike(f"[{other}]|  |^ | $")
    return F.when(untidy, F.btrim(F.regexp_replace(text, f"[{fv.SPACE}]+", " "), F.lit(" "))).otherwise(text)


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{fv.SPACE}]+"), lambda w: w != "")


@F.pandas_udf(T.StringType())
def _fold(text: pd.Series) -> pd.Series:
    return text.map(str.casefold, na_action="ignore")


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(T.StringType())
def _nfkc_fold(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t).casefold(), na_action="ignore")


def _ascii_or(udf, native: Column, text: Column) -> Column:
    ascii_only = is_ascii(text)
    return F.coalesce(F.when(ascii_only, native), udf(F.when(~ascii_only, text)))


def casefold(text: Column) -> Column:
    return _ascii_or(_fold, F.lower(text), text)


def normalize_query(text: Column) -> Column:
    """NFKC with collapsed white space; letter case is kept."""
    return collapse_space(_ascii_or(_nfkc, text, text))


def normalize_search_text(text: Column) -> Column:
    """NFKC, full case folding, collapsed white space."""
    return collapse_space(_ascii_or(_nfkc_fold, F.lower(text), text))


def lexical_tokens(normalized: Column, limit: int | None = None) -> Column:
    """Distinct search tokens of an already normalized text, in first-seen order, all or the first ``limit``.

    ASCII words come first, then for each CJK span the span itself (2-24
    characters) and its overlapping bigrams; lone characters stand alone.
    """
    ascii_tokens = F.regexp_extract_all(normalized, F.lit(fv.ASCII_TOKEN), F.lit(0))
    spans = F.when(is_ascii(normalized), F.array().cast("array<string>")).otherwise(
        F.regexp_extract_all(normalized, F.lit(f"[{fv.CJK}]+"), F.lit(0)))

    def span_tokens(span: Column) -> Column:
        n = F.length(span)
        bigrams = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(span, i, F.lit(2)))
        return F.when(n == 1, F.array(span)).when(
            n <= 24, F.concat(F.array(span), bigrams)).otherwise(bigrams)

    cjk_tokens = F.flatten(F.transform(spans, span_tokens))
    found = F.array_distinct(F.concat(ascii_tokens, cjk_tokens))
    return found if limit is None else F.slice(found, 1, limit)


def identifiers(text: Column) -> Column:
    """All ``CTL-4616``-style identifiers in order of appearance."""
    return F.regexp_extract_all(text, F.lit(java(fv.IDENTIFIER)), F.lit(1))


def acronyms(text: Column) -> Column:
    """All ``BKR0831``-style codes in order of appearance."""
    return F.regexp_extract_all(text, F.lit(java(fv.ACRONYM)), F.lit(1))


def exact_terms(normalized: Column) -> Column:
    """Sorted distinct identifiers and codes of an already case-folded text.

    Each has two digits side by side, so most lines of prose never meet the two patterns.
    """
    found = F.array_sort(F.array_distinct(F.concat(identifiers(normalized), acronyms(normalized))))
    return F.when(~normalized.rlike(java(r"\d\d")), F.array().cast("array<string>")).otherwise(found)


def controlled_aliases(text: Column) -> Column:
    return F.transform(
        F.regexp_extract_all(text, F.lit(java(fv.CONTROLLED_ALIAS)), F.lit(1)), strip)


def query_signals(normalized: Column, limit: int = fv.SIGNAL_LIMIT) -> Column:
    """Substrings that earn a bonus: exact terms, then the first lexical tokens."""
    leading = F.concat(exact_terms(normalized), lexical_tokens(normalized, limit))
    long_enough = F.filter(leading, lambda s: F.length(s) >= 2)
    return F.array_distinct(F.slice(long_enough, 1, limit))


def estimate_tokens(text: Column) -> Column:
    """CJK characters + 1.3 per word + a quarter of everything else, at least 1."""
    cjk = F.regexp_count(text, F.lit(f"[{fv.CJK_WITH_COMPAT}]"))
    n_words = F.regexp_count(text, F.lit(fv.ESTIMATE_WORD))
    no_words = F.length(F.regexp_replace(text, fv.ESTIMATE_WORD, ""))
    return F.greatest(
        F.lit(1),
        cjk + F.floor(n_words * F.lit(1.3)).cast("int") + F.floor((no_words - cjk) / 4).cast("int"),
    )


def trigrams(text: Column) -> Column:
    """Distinct padded character trigrams of the words of ``text``."""
    found = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.array_distinct(F.flatten(F.transform(found, lambda w: F.transform(
        F.sequence(F.lit(1), F.length(w) + 1),
        lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))))


def trigram_similarity(left: Column, right: Column) -> Column:
    """Shared trigrams over all trigrams of two trigram arrays."""
    shared = F.size(F.array_intersect(left, right))
    total = F.size(left) + F.size(right) - shared
    return F.when(total > 0, shared / total).otherwise(F.lit(0.0))


def fold_quote(text: Column) -> Column:
    """White-space folding used when quotes are compared with their source."""
    return collapse_space(text)


def drop_thousands(text: Column) -> Column:
    return F.regexp_replace(text, java(r"(?<=\d)[,_\s](?=\d)"), "")


def answer_contains(answer: Column, expected: Column) -> Column:
    """Case-folded containment that ignores thousands separators."""
    return contains_fact(casefold(answer), casefold(expected))


def contains_fact(folded_answer: Column, folded_expected: Column) -> Column:
    return F.contains(folded_answer, folded_expected) | F.contains(
        drop_thousands(folded_answer), drop_thousands(folded_expected))


def rejoin_wrapped_identifier(text: Column) -> Column:
    """Join an identifier that a visual line break has split."""
    return F.regexp_replace(text, java(fv.WRAPPED_IDENTIFIER), "$1")


def safe_filename(name: Column) -> Column:
    base = F.regexp_extract(name, r"([^/]*)/*$", 1)
    clean = strip(F.regexp_replace(base, r"(?U)[^\w.()\-一-鿿 ]+", "_"))
    cut = F.substring(clean, 1, 240)
    return F.when(cut == "", F.lit("document")).otherwise(cut)


def searchable(*fields: Column) -> Column:
    """File name, heading and content as one case-folded text."""
    return casefold(F.concat_ws(" ", *[F.coalesce(f, F.lit("")) for f in fields]))


def contains_any(text: Column, signals: Column) -> Column:
    return F.exists(signals, lambda s: F.contains(text, s))


def count_contained(text: Column, signals: Column) -> Column:
    return F.size(F.filter(signals, lambda s: F.contains(text, s)))


def authority_quality(query: Column, text: Column) -> Column:
    """How current and approved a text reads, or how historical if that was asked."""
    def hits(terms):
        return sum((F.contains(text, F.lit(t)).cast("int") for t in terms), F.lit(0))

    asks_history = F.lit(False)
    for term in fv.HISTORY_QUESTION_TERMS:
        asks_history = asks_history | F.contains(query, F.lit(term))
    asks_history = asks_history | query.rlike(java(fv.HISTORY_QUESTION_WORDS))
    good, old = hits(fv.AUTHORITATIVE_TERMS), hits(fv.HISTORICAL_TERMS)
    return F.when(asks_history, 2 * old - 2 * good).otherwise(2 * good - 3 * old)
