"""Which rankers found a hit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes of ranker names; the second of each pair is a name from earlier data.
LEXICAL_PREFIXES = ("lexical", "bm25")
SEMANTIC_PREFIXES = ("embedding", "semantic")


def is_lexical_ranker(name: str) -> bool:
    return name.startswith(LEXICAL_PREFIXES)


def is_semantic_ranker(name: str) -> bool:
    return name.startswith(SEMANTIC_PREFIXES)


def _any_prefix(name: Column, prefixes: tuple[str, ...]) -> Column:
    out = name.startswith(prefixes[0])
    for p in prefixes[1:]:
        out = out | name.startswith(p)
    return out


def lexical_name(name: Column) -> Column:
    return _any_prefix(name, LEXICAL_PREFIXES)


def semantic_name(name: Column) -> Column:
    return _any_prefix(name, SEMANTIC_PREFIXES)


def provenance(rankers: Column, scores: Column) -> dict[str, Column]:
    """matched_by ('lexical', 'semantic', 'both', 'unknown'), lexical_score (the greatest of the lexical legs) and
    semantic_score (the last one seen), from an array of names and a map of native scores; either may be null."""
    names = F.array_union(F.coalesce(rankers, F.array().cast("array<string>")), F.coalesce(F.map_keys(scores), F.array().cast("array<string>")))
    lexical, semantic = F.exists(names, lexical_name), F.exists(names, semantic_name)
    which = F.when(lexical & semantic, "both").when(lexical, "lexical").when(semantic, "semantic").otherwise("unknown")
    return {
        "matched_by": which,
        "lexical_score": F.array_max(F.map_values(F.map_filter(scores, lambda k, _: lexical_name(k)))),
        "semantic_score": F.get(F.reverse(F.map_values(F.map_filter(scores, lambda k, _: semantic_name(k)))), F.lit(0)),
    }


def is_vector_only(rankers: Column, scores: Column) -> Column:
    return provenance(rankers, scores)["matched_by"] == "semantic"
