"""Text expressions: lexemes, excerpts and headlines."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A lexeme is a run of letters and digits of the lower-cased text; no stemming, no stop words.
LEXEME = r"[\p{L}\p{N}]+"
EXCERPT, LEAD = 200, 60


def lexemes(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(LEXEME), F.lit(0))


def excerpt(text: Column) -> Column:
    return F.substring(text, 1, EXCERPT)


def query_lexemes(query: str) -> list[str]:
    """Distinct lexemes of a query in the order of their first use, as `lexemes` finds them."""
    words = re.findall(r"[^\W_]+", query.lower())
    return list(dict.fromkeys(words))


def marked(text: Column, words: list[str] | tuple[str, ...]) -> Column:
    """A text with every query word in <mark>."""
    return F.regexp_replace(text, F.lit(_pattern(words)), F.lit("<mark>$1</mark>"))


def _pattern(words: list[str] | tuple[str, ...]) -> str:
    any_ = "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))
    return rf"(?iu)(?<![\p{{L}}\p{{N}}])({any_})(?![\p{{L}}\p{{N}}])"


def headline(text: Column, words: list[str] | tuple[str, ...]) -> Column:
    """The part of a text around its first query word, wherever that is: up to LEAD characters before it and EXCERPT -
    LEAD from it on, without what the cuts leave of a word, and every query word in <mark>.  A text with no query word
    gives its excerpt, unmarked."""
    if not words:
        return excerpt(text)
    at = F.regexp_instr(text, F.lit(_pattern(words)))
    tail = EXCERPT - LEAD
    before = F.when(at > LEAD + 1, F.regexp_replace(F.substring(text, at - LEAD, F.lit(LEAD)), r"^[\p{L}\p{N}]+", "")).otherwise(F.substring(text, F.lit(1), at - 1))
    after = F.substring(text, at, F.lit(tail))
    after = F.when(F.length(text) >= at + tail, F.regexp_replace(after, r"[\p{L}\p{N}]+$", "")).otherwise(after)
    return F.when(at > 0, marked(F.concat(before, after), words)).otherwise(excerpt(text))


def plain(html: Column) -> Column:
    """Text of a page: tags become spaces."""
    return F.regexp_replace(html, r"<[^>]*>", " ")


def vector_literal(vector: Column) -> Column:
    """A vector as text, [a,b,...]: what a source takes that hands queries on to another system."""
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: x.cast("string")), ","), F.lit("]"))
