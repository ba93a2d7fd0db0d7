"""Named queries over the engine's operators, each with the SQL that it is compared with."""

from __future__ import annotations


def load() -> tuple[dict, dict]:
    """All queries and their SQL."""
    from parlance.plans import corpus_queries, dialogue_queries, judge_queries, pipeline_queries, storage_queries, stream_queries, training_queries  # noqa: F401
    from parlance.plans.registry import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
