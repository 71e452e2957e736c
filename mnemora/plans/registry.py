"""All registered queries over the driver's tables, with the SQL that DuckDB checks them by."""

from . import checks, metrics, prompts, records, relations, sources, streams, texts, vectors  # noqa: F401
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
