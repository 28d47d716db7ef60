"""The registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from attestor.plans import case_queries, label_queries, metric_queries, text_queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (text_queries, case_queries, label_queries, metric_queries):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
