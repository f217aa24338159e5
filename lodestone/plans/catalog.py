"""All queries of the library and their oracles."""

from __future__ import annotations

from lodestone.plans import comparisons, composition, corpus, diagnostics, evidence, learned, policies, ranking, retrieval, scalars

MODULES = (scalars, retrieval, evidence, corpus, comparisons, composition, learned, ranking, policies, diagnostics)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
