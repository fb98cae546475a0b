"""Every registered query; importing a family registers it."""

from boxloom.queries import functions_q, geometry_q, ladders_q, relations_q, matching_q, greedy_q, catalog_q, tree_q, plan_q, cluster_q, layout_q, ingest_q, evaluation_q, stream_q, context_q, claims_q, structural_q, evidence_q  # noqa: F401
from boxloom.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
