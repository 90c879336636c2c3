"""All registered queries and their SQL equivalents."""

from __future__ import annotations

from veinstone.plans import checks, clones, context, events, graph, joins, metrics, ranking, records, sources, streams, vectors  # noqa: F401
from veinstone.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
