"""All queries over the driver's tables and their SQL counterparts."""

from __future__ import annotations

from tidemark.plans import q_clean, q_features, q_graph, q_models, q_series, q_sources, q_stats, q_streams, q_udfs  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "e8_hourly_features"
