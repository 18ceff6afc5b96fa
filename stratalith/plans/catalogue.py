"""Every registered query and its SQL."""

from __future__ import annotations

from . import features_queries, graph_queries, model_queries, resolve_queries, sequence_queries, source_queries, stats_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]

_MODULES = (features_queries, graph_queries, model_queries, resolve_queries, sequence_queries, source_queries, stats_queries)


def flagship(spark, sf_dir):
    """Undated suppliers, dated from the graph of suppliers that share an order."""
    return graph_queries.harmonic_propagation(spark, sf_dir)
