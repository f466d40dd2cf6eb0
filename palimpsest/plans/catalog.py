"""All queries of the library; importing this registers them."""

from . import align_queries, graph_queries, run_queries, store_queries, text_queries, vector_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
