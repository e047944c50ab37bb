"""Ranks, running sums and percentiles that never gather a large group in one task.

A global rank or running sum over a hash order is cut by the first hex digits of the hash: sums per slice are small,
their running totals are broadcast, and only inside a slice a window runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DoubleType, FloatType, IntegerType, ShortType

from kifu_spark.session import stored

SLICE_DIGITS = 3


def join_on_equal(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys where two nulls are equal; the keys stay once."""
    other = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    same = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(other, same).drop(*[f"__r_{k}" for k in keys])


def seeded_key(seed: int, *parts: Column) -> Column:
    """A hex digest of the seed and the parts that any engine with MD5 can repeat; null parts count as empty."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def running_before(
    df: DataFrame, key: str, amount: Column, out: str, groups: list[str] = [], digits: int = SLICE_DIGITS, ties: list[str] = []  # noqa: B006
) -> DataFrame:
    """df with the sum of amount over the rows before each, in order of the hex digest ``key`` (then ties), inside its groups."""
    sliced = df.withColumn("__slice", F.substring(key, 1, digits)).withColumn("__amount", amount)
    by_group = Window.partitionBy(*groups).orderBy("__slice")
    totals = (
        sliced.groupBy(*groups, "__slice")
        .agg(F.sum("__amount").alias("__total"))
        .withColumn("__first", F.sum("__total").over(by_group) - F.col("__total"))
        .drop("__total")
    )
    # at most 16 ** digits rows for each group; broadcast where there is one group
    inside = Window.partitionBy(*groups, "__slice").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, 0)
    return (
        join_on_equal(sliced, totals if groups else F.broadcast(totals), [*groups, "__slice"])
        .withColumn(out, F.col("__first") + F.sum("__amount").over(inside) - F.col("__amount"))
        .drop("__slice", "__amount", "__first")
    )


def rank_before(df: DataFrame, key: str, out: str, groups: list[str] = [], ties: list[str] = []) -> DataFrame:  # noqa: B006
    """df with each row's place, from 0, in order of the hex digest ``key`` inside its groups."""
    return running_before(df, key, F.lit(1).cast("long"), out, groups, ties=ties)


def range_parts(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """df stored in ranges of its whole order, with the number of each row's range; only equal rows share one for sure."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(parts, *order).withColumn(out, F.spark_partition_id()))


def rank_in_order(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """df with each row's place, from 1, in a total order of the whole table."""
    parted = range_parts(df, order, "__part")
    whole = Window.orderBy("__part")  # one row for each range
    before = parted.groupBy("__part").agg(F.count("*").alias("__here")).select("__part", (F.sum("__here").over(whole) - F.col("__here")).alias("__first"))
    nth = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return parted.join(F.broadcast(before), "__part").withColumn(out, F.col("__first") + nth).drop("__part", "__first")


def _splitters(value: str, slices: int) -> Column:
    """Aggregate: the values at which a group's distinct values fall into about equal slices; rank errors are a tenth of one."""
    return F.array_distinct(F.percentile_approx(value, [i / slices for i in range(1, slices)], 10 * slices))


def value_counts(df: DataFrame, groups: list[str], value: str, slices: int = 256, near: list[float] | None = None) -> DataFrame:
    """groups, value, n, upto (rows at or below the value) and total: the base of every exact percentile.

    With ``near``, only the values around those quantiles are given, in one more pass and next to no shuffle. Without it
    a group's distinct values are cut into slices at their approximate quantiles, so that slices hold about as many
    whatever the values are, and one far from the others moves no edge but its own; running totals over the slices, at
    most ``slices`` rows a group, and a window inside each slice give the exact ranks. Edges are stored before they are
    used, as approximate quantiles hang on the order in which partial results come and differ if they are made twice.
    """
    keys = [*groups, "__all"]
    known = df.filter(F.col(value).isNotNull())
    if near and isinstance(df.schema[value].dataType, EXACT_IN_DOUBLE):
        return _counts_near(known.select(*groups, value).withColumn("__all", F.lit(0)), keys, value, sorted(set(near))).select(*groups, value, "n", "upto", "total")
    counted = known.groupBy(*groups, value).agg(F.count("*").alias("n")).withColumn("__all", F.lit(0))
    spans = stored(counted.groupBy(*keys).agg(_splitters(value, slices).alias("__edges"), F.sum("n").alias("total")))
    below = F.size(F.filter("__edges", lambda edge: edge < F.col(value)))
    sliced = join_on_equal(counted, spans, keys).withColumn("__slice", below).drop("__edges")
    before = (
        sliced.groupBy(*keys, "__slice")
        .agg(F.sum("n").alias("__here"))
        .withColumn("__first", F.sum("__here").over(Window.partitionBy(*keys).orderBy("__slice")) - F.col("__here"))
    )
    inside = F.sum("n").over(Window.partitionBy(*keys, "__slice").orderBy(value))
    placed = join_on_equal(sliced, before, [*keys, "__slice"]).withColumn("upto", F.col("__first") + inside)
    return placed.select(*groups, value, "n", "upto", "total")


#: Types whose values a sketch gives back as they are.
EXACT_IN_DOUBLE = (DoubleType, FloatType, IntegerType, ShortType, ByteType)
#: A sketch's ranks are off by a share of 1 / SKETCH of the rows at most; brackets reach four times as far.
SKETCH = 5000


def _counts_near(known: DataFrame, keys: list[str], value: str, near: list[float]) -> DataFrame:
    """keys, value, n, upto, total of the values in a bracket around each quantile, exact.

    A sketch gives each bracket's ends, about 8 / SKETCH of a group's rows apart; groups of fewer than 4 x SKETCH rows are
    one bracket. What lies between two brackets is only counted, so that a group's window holds its brackets and no more.
    """
    reach = 4 / SKETCH
    at = F.percentile_approx(value, [max(q - reach, 0.0) for q in near] + [min(q + reach, 1.0) for q in near], SKETCH)
    ends = known.groupBy(*keys).agg(at.alias("at"), F.min(value).alias("least"), F.max(value).alias("most"), F.count("*").alias("rows"))
    whole = F.col("rows") < 4 * SKETCH
    low = [F.when(whole | F.lit(q <= reach), F.col("least")).otherwise(F.get("at", F.lit(i))).alias(f"__low{i}") for i, q in enumerate(near)]
    high = [F.when(whole | F.lit(q + reach >= 1), F.col("most")).otherwise(F.get("at", F.lit(len(near) + i))).alias(f"__high{i}") for i, q in enumerate(near)]
    brackets = stored(ends.select(*keys, *low, *high))
    # a value's place among the brackets: how many end below it, and whether it lies in the next one
    ended = sum((F.when(F.col(f"__high{i}") < F.col(value), 1).otherwise(0) for i in range(len(near))), F.lit(0))
    inside = F.lit(False)
    for i in range(len(near)):
        inside = inside | ((F.col(value) >= F.col(f"__low{i}")) & (F.col(value) <= F.col(f"__high{i}")))
    placed = join_on_equal(known, brackets, keys).select(*keys, ended.alias("__ended"), F.when(inside, F.col(value)).alias(value))
    counted = placed.groupBy(*keys, "__ended", value).agg(F.count("*").alias("n"))
    # between two brackets there is one row, null, before those of the next bracket
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("__ended", F.col(value).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumns({"upto": upto, "total": F.sum("n").over(Window.partitionBy(*keys))})
    missed = F.lit(False)
    for q in near:
        place = F.floor(F.lit(q) * (F.col("total") - 1))
        missed = missed | ((F.col("upto") - F.col("n") <= place + 2) & (F.col("upto") > place - 1))
    lost = F.when(F.col(value).isNull() & missed, F.raise_error(F.lit("a sketch of quantiles is less exact than it says")).cast("boolean"))
    return ranked.filter(F.coalesce(lost, F.col(value).isNotNull()))


def at_index(value: str, index: Column) -> Column:
    """Aggregate over value_counts: the value at a 0-based place of the sorted rows."""
    return F.min(F.when(F.col("upto") > index, F.col(value)))


def lower_index(value: str, q: float) -> Column:
    """The value at floor(q * (n - 1)): no interpolation, never above the exact quantile."""
    return at_index(value, F.floor(F.lit(q) * (F.col("total") - 1)))


def rounded_index(value: str, q: float) -> Column:
    """The value at q * (n - 1) rounded half to even."""
    return at_index(value, F.bround(F.lit(q) * (F.col("total") - 1), 0))


def upper_median(value: str) -> Column:
    """The value at n // 2: of two middle values the larger."""
    return at_index(value, F.floor(F.col("total") / 2))


def exclusive_quartile(value: str, i: int) -> Column:
    """Quartile i by the exclusive method: interpolated at (n + 1) * i / 4, ends clamped."""
    place = (F.col("total") + 1) * i
    whole, rest = F.floor(place / 4), F.pmod(place, F.lit(4))
    clamp = lambda x: F.least(F.greatest(x, F.lit(0)), F.col("total") - 1)
    low, high = at_index(value, clamp(whole - 1)), at_index(value, clamp(whole))
    part = F.max(rest) / 4.0
    return low + (high - low) * part


def linear_percentile(value: str, q: float) -> Column:
    """The linearly interpolated percentile as a plain aggregate, which holds a group's distinct values: for small groups."""
    return F.percentile(value, q)


def linear_index(value: str, q: float) -> Column:
    """Aggregate over value_counts: the linearly interpolated percentile, at q * (n - 1)."""
    at = F.lit(q) * (F.col("total") - 1)
    low, high = at_index(value, F.floor(at)), at_index(value, F.least(F.floor(at) + 1, F.col("total") - 1))
    return low.cast("double") + (high - low).cast("double") * F.max(at - F.floor(at))


def linear_percentiles(df: DataFrame, groups: list[str], value: str, named: dict[str, float]) -> DataFrame:
    """groups and, by name, exact interpolated percentiles of the values that are not null."""
    return value_counts(df, groups, value, near=list(named.values())).groupBy(*groups).agg(*[linear_index(value, q).alias(name) for name, q in named.items()])


def with_percentiles(sums: DataFrame, df: DataFrame, groups: list[str], value: str, named: dict[str, float]) -> DataFrame:
    """sums, one row a group, with df's percentiles beside them; null groups match, groups without values get nulls."""
    found = linear_percentiles(df, groups, value, named)
    other = found.select(*[F.col(c).alias(f"__r_{c}") if c in groups else F.col(c) for c in found.columns])
    same = [F.col(g).eqNullSafe(F.col(f"__r_{g}")) for g in groups]
    return sums.join(other, same, "left").drop(*[f"__r_{g}" for g in groups])


def top_by_group(df: DataFrame, groups: list[str], order: list[Column], n: int, out: str = "nth") -> DataFrame:
    """The first n rows of each group in a total order; the engine limits groups before it shuffles them."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).filter(F.col(out) <= n)
