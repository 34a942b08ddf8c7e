"""Queries over the test tables, by family; importing this package registers them all."""

from tessella.plans import component_queries, compose_queries, graph_queries, incremental_queries, knowledge_queries, matching_queries, more_queries, page_plan_queries, plan_queries, project_queries, site_queries, structure_queries, symbol_queries, text_queries  # noqa: F401
from tessella.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
