"""The registered queries of the training-data operators."""

from __future__ import annotations

from . import bpe, collocations, jaccard, knn, lm_score, packing, quality, spelling, substring, suffix_array, token_files, toxicity, url_filter

MODULES = [bpe, toxicity, url_filter, packing, quality, jaccard, substring, knn, suffix_array, lm_score, collocations, token_files, spelling]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in MODULES for k, s in m.ORACLE.items()}
