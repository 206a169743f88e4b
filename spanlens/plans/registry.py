"""All registered queries of the engine, with their SQL counterparts."""

from __future__ import annotations

from spanlens.plans import oracles, queries

QUERIES: dict = queries.QUERIES
ORACLES: dict[str, str] = oracles.ORACLES
