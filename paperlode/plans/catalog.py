"""All queries of the core and the SQL that checks them."""

from __future__ import annotations

from paperlode.plans import cleaning, documents, pages, records, search, statements

_MODULES = (cleaning, statements, documents, pages, search, records)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
FLAGSHIP = "bm25_topk"
