"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from metrosift.llm import (
    fingerprints, importance_resampling, language_id, lexical_search, minhash, mixing, packing, pitman_yor, simhash,
    suffix_dedup, token_counts, topk_search, url_filter,
)

_MODULES = (suffix_dedup, packing, simhash, url_filter, mixing, pitman_yor, token_counts, fingerprints, topk_search, language_id,
            lexical_search, importance_resampling, minhash)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
