"""Registered queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veritrail.plans import bundle_queries, citation_queries, context_queries, doctrine_queries, domain_queries, evidence_queries, form_queries, identity_queries, registry_queries, reprocess_queries, stage_queries, state_queries, text_queries

_MODULES = (text_queries, domain_queries, registry_queries, citation_queries, form_queries, state_queries, bundle_queries, context_queries, identity_queries, reprocess_queries, doctrine_queries, evidence_queries, stage_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best segments of each benchmark question, copies collapsed and spread over documents."""
    return text_queries.q_diversified_topk(spark, sf_dir)
