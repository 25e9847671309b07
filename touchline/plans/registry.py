"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import CORPUS, SIDES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, corpus: bool = False, sides: bool = False, recursive: bool = False) -> Callable[[Query], Query]:
    """Register a query under its function's name.

    ``corpus`` puts the match corpus ``m`` in front of ``sql``, ``sides`` also its two
    views ``t``; ``sql`` may go on with more common table expressions, after a comma.
    """

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            head = "WITH " + ("RECURSIVE " if recursive else "")
            parts = ([CORPUS] if corpus or sides else []) + ([SIDES] if sides else [])
            body = sql.strip()
            if parts:
                SQL[f.__name__] = head + ",".join(parts) + ("," + body[1:] if body.startswith(",") else "\n" + body)
            else:
                SQL[f.__name__] = body
        return f

    return register
