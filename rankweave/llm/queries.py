"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import oracles
from .decontam import op2_benchmark_decontamination
from .knn import op9_exact_top_k
from .langid import op1_language_id
from .lm import op10_lm_scoring
from .packing import op7_best_fit_packing
from .repeats import op4_suffix_array_dedup, op5_substring_dedup
from .simhash import op8_simhash_near_dedup
from .tokens import op3_token_counts
from .warc import op6_warc

_ALL = (
    op1_language_id, op2_benchmark_decontamination, op3_token_counts, op4_suffix_array_dedup, op5_substring_dedup,
    op6_warc, op7_best_fit_packing, op8_simhash_near_dedup, op9_exact_top_k, op10_lm_scoring,
)
QUERIES = {f.__name__: f for f in _ALL}

#: The others need a tokenizer (op3, op7), a classifier (op1) or a hash that SQL lacks (op8): tests hold them against
#: brute force or, op1, against held-out documents.
ORACLES: dict[str, str] = {
    "op2_benchmark_decontamination": oracles.DECONTAMINATION,
    "op4_suffix_array_dedup": oracles.SUFFIXES,
    "op5_substring_dedup": oracles.SUBSTRINGS,
    "op6_warc": oracles.ARCHIVES,
    "op9_exact_top_k": oracles.TOP_K,
    "op10_lm_scoring": oracles.SCORES,
}
