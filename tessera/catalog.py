"""All registered queries and their SQL."""

from .plans import bindings, graphs, imports, readers, retrieval, rules  # noqa: F401 - importing a module registers its queries

QUERIES = bindings.QUERIES
ORACLES = bindings.ORACLES
