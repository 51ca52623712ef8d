"""Imports every module that registers queries."""

from . import catalogue_queries, file_queries, dataset_queries, graph_queries, knowledge_queries, log_queries, record_queries, search_queries, segment_queries, text_queries, thread_queries  # noqa: F401
