"""Joins on keys of which one may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1 / 512


def join_counted(left: DataFrame, right: DataFrame, key: str, rows: int, count: str = "copies", hot_share: float = HOT_SHARE) -> DataFrame:
    """left joined with right, which has one row a key; its column ``count`` says how many of left's ``rows`` have that key.

    Keys with more than hot_share of the rows, of which there are fewer than 1 / hot_share, are broadcast; the others
    go by a join in which no key is larger than that share. Neither side may hold null keys that should match.
    """
    least = int(rows * hot_share)
    hot = F.broadcast(right.filter(F.col(count) > least))
    rest = left.join(hot.select(key), key, "left_anti").join(right.filter(F.col(count) <= least), key)
    return left.join(hot, key).unionByName(rest)
