"""Queries over the reference operators, with the SQL they are checked against."""

from roundweave.plans import conversation, edges, files, packing, sampling, scores, tables, training  # noqa: F401  all but conversation register their queries with those of tables

QUERIES: dict = conversation.QUERIES | tables.QUERIES


def _recursive(sql: str) -> str:
    """SQL may use recursion only if it says so in front."""
    return sql.replace("WITH ", "WITH RECURSIVE ", 1) if sql.lstrip().startswith("WITH ") and "reach(" in sql and "RECURSIVE" not in sql[:20] else sql


ORACLES: dict[str, str] = {name: _recursive(sql) for name, sql in (conversation.ORACLES | tables.ORACLES).items()}
