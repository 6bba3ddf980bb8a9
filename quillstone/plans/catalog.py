"""The registered queries and their SQL, gathered from the modules of this package."""

from __future__ import annotations

from quillstone.plans import figures, retrieval, service

QUERIES = {**retrieval.QUERIES, **figures.QUERIES, **service.QUERIES}
ORACLES = {**retrieval.ORACLES, **figures.ORACLES, **service.ORACLES}
FLAGSHIP = "q16_find_passages"
