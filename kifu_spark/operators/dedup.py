"""First-in-order deduplication by a key, and walk order of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """df with first_id (smallest ``order`` of the key) and duplicate; one row for each key is aggregated before the join."""
    firsts = df.groupBy(key).agg(F.min(order).alias("first_id"))
    return df.join(firsts, key).withColumn("duplicate", F.col(order) != F.col("first_id"))


def walk_key(parts: Column) -> Column:
    """A sortable key of path parts in which a folder's files precede its folders."""
    return F.array_join(
        F.transform(parts, lambda part, i: F.concat(F.when(i == F.size(parts) - 1, "0").otherwise("1"), part)), "/"
    )
