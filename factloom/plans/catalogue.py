"""All named queries over the driver tables, each with the same rows in DuckDB's SQL."""

from factloom.plans import date_queries, extraction_queries, filter_queries, fold_queries, gate_queries, graph_queries, language_queries, lifecycle_queries, matching_queries, ontology_queries, prose_queries, question_queries, scope_queries, store_queries, temporal_queries, text_queries  # noqa: F401  they register themselves
from factloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
