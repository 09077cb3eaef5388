"""All queries of the reference's own operators."""

from __future__ import annotations

from . import array_jobs, check_jobs, control_jobs, equation_jobs, evidence_jobs, gate_jobs, layout_jobs, manifest_jobs, pointer_jobs, rule_jobs, search_jobs, source_jobs

_MODULES = (array_jobs, search_jobs, check_jobs, source_jobs, layout_jobs, pointer_jobs, rule_jobs, gate_jobs, equation_jobs, evidence_jobs, control_jobs, manifest_jobs)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
