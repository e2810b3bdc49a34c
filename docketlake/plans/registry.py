"""Registered queries and their oracle SQL."""

from __future__ import annotations

from . import queries_pipeline, queries_ranking, queries_text

QUERIES: dict = {**queries_ranking.QUERIES, **queries_text.QUERIES, **queries_pipeline.QUERIES}
ORACLES: dict[str, str] = {**queries_ranking.ORACLES, **queries_text.ORACLES, **queries_pipeline.ORACLES}
