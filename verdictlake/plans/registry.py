"""Names of all queries, with the SQL that gives the same rows."""

from __future__ import annotations

from verdictlake.plans import code, evaluation, flow, offline, reports, scalars

_PARTS = (evaluation, scalars, offline, flow, code, reports)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL = {name: text for part in _PARTS for name, text in part.ORACLE_SQL.items()}
FLAGSHIP = "metrics_rates"
