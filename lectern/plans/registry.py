"""Queries of the library and their SQL, gathered from the modules that define them."""

from __future__ import annotations

from . import analysis, diagnostics, experiments, planning, policies, present, provenance, records, retrieval

MODULES = (retrieval, analysis, records, diagnostics, planning, experiments, policies, present, provenance)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in MODULES for k, v in m.ORACLE.items()}
