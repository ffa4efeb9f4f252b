"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import decontaminate, language, line_dedup, packing, quality, secrets, simhash_dedup, substring_dedup, suffix_dedup, token_store

MODULES = (quality, suffix_dedup, token_store, simhash_dedup, language, secrets, decontaminate, packing, line_dedup, substring_dedup)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in getattr(m, "ORACLES", {}).items()}
