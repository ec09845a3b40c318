"""All registered queries and their SQL checks."""

from __future__ import annotations

from repovigil.plans import analysis_rules, cleaning, full_scan, ingest, job_log, job_stream, model_calls, navigation, reporting

_FAMILIES = [cleaning, navigation, reporting, job_log, analysis_rules, model_calls, ingest, job_stream, full_scan]

QUERIES = {name: run for family in _FAMILIES for name, run in family.QUERIES.items()}
SQL = {name: text for family in _FAMILIES for name, text in family.SQL.items()}
