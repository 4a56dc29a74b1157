"""Registered queries: importing this package fills the registry."""

from . import bin_queries, genotype_queries, interval_queries, knowledge_queries, source_queries, test_queries  # noqa: F401
