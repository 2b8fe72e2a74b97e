"""Named queries over the test tables, each with its SQL."""

from . import graph_queries, model_queries, packing_queries, planning_queries, qc_queries, sampling_queries, sparse_queries
from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "graph_queries", "model_queries", "packing_queries", "planning_queries", "qc_queries", "sampling_queries", "sparse_queries"]
