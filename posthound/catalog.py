"""Registry of the engine's queries and their SQL."""

from __future__ import annotations

from posthound.functions import hosts, text, urls
from posthound.operators import ancestors, anchors, authresults, claims, deception, dml, documents, evidence, files, lookalike, messages, reputation, scripts, services, upkeep, urlgroups
from posthound.plans import alerts, analysis, metrics, render, reports, scoring
from posthound.sources import mail
from posthound.streaming import ingest, jobs

_MODULES = (reports, scoring, dml, text, hosts, urls, messages, authresults, lookalike, deception, claims, anchors, services, urlgroups, ancestors, upkeep, files, documents, scripts, evidence, reputation, mail, ingest, jobs, alerts, render, metrics, analysis)

QUERIES: dict = {k: f for m in _MODULES for k, f in m.R.queries.items()}
ORACLE_SQL: dict[str, str] = {k: s for m in _MODULES for k, s in m.R.sql.items()}
