"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from lexora.llm import ann, bpe, dedup, jaccard, language, mixing, pii, quality, sharding, tokens

_MODULES = [dedup, tokens, sharding, quality, jaccard, ann, pii, language, bpe, mixing]

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
