"""All registered queries and their SQL."""

from . import form, keys, league_tables, leagues, metrics, models, mutations, relational, scalars, simulation, validation  # noqa: F401  they register their queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
