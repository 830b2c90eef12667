"""All registered queries: importing the modules registers them."""

from quillstone.plans import queries_catalog, queries_files, queries_sources, queries_text, queries_vector  # noqa: F401
from quillstone.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
