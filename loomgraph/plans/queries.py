"""All registered queries and their SQL."""

from loomgraph.plans import registry_code, registry_sources, registry_tables, registry_walks  # noqa: F401
from loomgraph.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
