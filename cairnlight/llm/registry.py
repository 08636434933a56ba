"""Queries of this subpackage by name, with their SQL twins where there is one."""

from __future__ import annotations

from cairnlight.llm import centroids, decontaminate, html_text, language, ngram_join, pieces, pii, quality, search, secrets, sharding, simhash

_MODULES = (sharding, simhash, html_text, language, pieces, decontaminate, secrets, pii, quality, ngram_join, search, centroids)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
