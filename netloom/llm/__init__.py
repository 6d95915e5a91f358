"""Operators for training-data pipelines; nothing else in the library imports this subpackage.

``QUERIES`` and ``ORACLES`` gather what the modules register.
"""

from __future__ import annotations

from netloom.llm import audit, embeddings, licenses, lm, manifest, mixing, ordinal, packing, quality, secrets, simhash, substrings, toxicity

_MODULES = (lm, simhash, packing, substrings, secrets, mixing, embeddings, quality, ordinal, licenses, manifest, toxicity, audit)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
