"""All registered queries of the engine."""

from __future__ import annotations

from kifu_spark.plans import arrays, corpora, games, hygiene, reports, sampling, sequences, statistics, streams, texts  # noqa: F401  they register their queries
from kifu_spark.registry import ORACLES, QUERIES, Query

FLAGSHIP = "move_stats"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
