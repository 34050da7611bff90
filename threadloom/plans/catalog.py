"""All named queries."""

from threadloom.plans import catalog_chains, catalog_chat, catalog_stream, catalog_text  # noqa: F401
from threadloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
