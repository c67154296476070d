"""Queries of the engine by name, with the SQL that each must match."""

from __future__ import annotations

from tidemark.plans.register import QUERIES, SQL
from tidemark.operators import aggregates, cards, composites, dictionary, dual, estimate, filters, joins, ledger, machines, model, money, ranking, sellers, signals, study, titles, watch  # noqa: F401  they register their queries
from tidemark.sources import feed, parsers, scans, sinks  # noqa: F401
from tidemark.streaming import notices, presence, windows  # noqa: F401

FLAGSHIP = "score_signals"

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
