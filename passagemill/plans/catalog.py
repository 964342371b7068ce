"""Every registered query of the core, by name, with the SQL that checks it."""

from __future__ import annotations

from passagemill.plans import corpus_queries, evaluation_queries, graph_queries, judging_queries, sampling_queries, text_queries  # noqa: F401  (they register)
from passagemill.plans.registry import ORACLES, QUERIES, Query

FLAGSHIP: Query = QUERIES["retrieve_graph"]


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
