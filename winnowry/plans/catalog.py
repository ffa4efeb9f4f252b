"""Every registered query of the engine with its SQL twin."""

from __future__ import annotations

from . import linework, metrics, pages, postings, scores, screening, studies, texts

MODULES = (screening, texts, scores, metrics, postings, pages, linework, studies)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
