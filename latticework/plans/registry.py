"""All core queries and their SQL, gathered from the modules of this package."""

from __future__ import annotations

from latticework.plans import advantage_queries, batch_queries, grading_queries, graph_queries, loss_queries, metric_queries, prepare_queries, retrieval_queries, skew_queries, stream_queries, text_queries

MODULES = [skew_queries, advantage_queries, loss_queries, batch_queries, metric_queries, retrieval_queries, graph_queries, text_queries, grading_queries, prepare_queries, stream_queries]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def sql() -> dict:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
