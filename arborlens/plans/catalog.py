"""All queries of the engine: the registry with every catalogue loaded."""

from arborlens.plans import catalog_code, catalog_graph, catalog_more  # noqa: F401  (they add their queries)
from arborlens.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
