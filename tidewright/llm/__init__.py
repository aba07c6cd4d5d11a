"""Training-data operators: text quality, de-duplication, mixing and tokens.

Nothing outside this package imports it; ``queries()`` and ``oracle_sql()`` are what
the repository's entry module picks up when the package is present.
"""

from tidewright.llm.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
