"""Registered queries over the driver's tables, each with its DuckDB twin."""

from . import artifacts, bundles, evaluation, files, more, relational, scores, scoring, sequence, stores, training, vectors  # noqa: F401
from .base import QUERIES, SQL, Query

FLAGSHIP = "leaderboard"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
