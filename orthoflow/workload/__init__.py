"""Registered queries over the given tables."""

from orthoflow.workload import card_queries, graph_queries, intake_queries, io_queries, module_queries, relation_queries  # noqa: F401
from orthoflow.workload.registry import ORACLES, QUERIES  # noqa: F401
