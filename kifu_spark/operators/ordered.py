"""Operators over rows in order: losses, sessions, pairs, batches, patterns and prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def in_order(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def loss_to_next(value: Column, w: WindowSpec) -> Column:
    """How far the next known value lies below this one; null without a value or a next one."""
    following = F.first(value, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return value - following


def session_number(is_marker: Column, w: WindowSpec) -> Column:
    """0 before the first marker, then one more at each."""
    return F.sum(F.when(is_marker, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))


def carried(value: Column, w: WindowSpec) -> Column:
    """The last known value up to here."""
    return F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def request_pairs(df: DataFrame, keys: list[str], order: list[str], is_request: Column, is_reply: Column) -> DataFrame:
    """Requests with the place of their reply: the next row, if it is a reply; a new request orphans the pending one."""
    w = in_order(keys, order)
    follows = F.lead(F.when(is_reply, F.struct(*order)), 1).over(w)
    return df.withColumn("reply", follows).filter(is_request)


def gap_count_batches(df: DataFrame, keys: list[str], order: list[str], gap: Column, most: int) -> DataFrame:
    """df with burst and batch: a burst ends where gap (over the same window) holds, and is cut every ``most`` rows."""
    w = in_order(keys, order)
    bursts = df.withColumn("burst", F.sum(F.when(gap, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    nth = F.row_number().over(in_order([*keys, "burst"], order))
    return bursts.withColumn("nth", nth).withColumn("batch", F.floor((F.col("nth") - 1) / most).cast("int"))


def padded_size(n: Column, most: int) -> Column:
    """The smallest power of two, up to most, that holds n."""
    sizes = [1 << k for k in range(most.bit_length()) if 1 << k < most] + [most]
    return F.coalesce(*[F.when(n <= s, F.lit(s)) for s in sizes], F.lit(most))


def prefixes(steps: Column, longest: int) -> Column:
    """array<struct<len, key>>: every prefix of an array of strings up to a length, joined by blanks."""
    lengths = F.sequence(F.lit(1), F.least(F.size(steps), F.lit(longest)))
    return F.transform(
        F.when(F.size(steps) > 0, lengths).otherwise(F.array().cast("array<int>")),
        lambda n: F.struct(n.alias("len"), F.array_join(F.slice(steps, 1, n), " ").alias("key")),
    )


def prefix_keys(steps: Column, longest: int) -> Column:
    """array<struct<len, key>>: of every prefix up to a length a key of fixed size, by one fold over the steps.

    A key is two 64-bit hashes, each of the key before it and the step (and whether it is null), so a sequence of n steps
    takes n keys and not n texts. Two different prefixes share a key with a chance of 2^-128.
    """
    one = lambda seed, before, step: F.xxhash64(F.lit(seed), before, step.isNull(), step)
    start = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.array().cast("array<struct<len:int,key:struct<a:bigint,b:bigint>>>").alias("out"))

    def longer(state: Column, step: Column) -> Column:
        a, b = one(1, state["a"], step), one(2, state["b"], step)
        entry = F.struct((F.size(state["out"]) + 1).alias("len"), F.struct(a.alias("a"), b.alias("b")).alias("key"))
        return F.struct(a.alias("a"), b.alias("b"), F.array_append(state["out"], entry).alias("out"))

    return F.aggregate(F.slice(steps, 1, longest), start, longer, lambda state: state["out"])


def ordered_list(order: list[str], value: str) -> Column:
    """Aggregate: the values of a group in order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__v")))), lambda x: x["__v"])


def plateau(epochs: Column, patience: int, cooldown: int, min_rate: float, min_delta: float = 1e-4) -> Column:
    """struct<best, waited, cooling, cuts> after a run's epochs (structs of loss and rate, in order).

    A loss counts as better by more than min_delta. After ``patience`` epochs without a better one the rate is cut, if
    it is above min_rate, both as 32-bit numbers, and none is waited for during the cooldown. Epochs without a loss or rate
    are passed over. An array holds one run: a run has few epochs.
    """
    state = lambda best, waited, cooling, cuts: F.struct(best.alias("best"), waited.alias("waited"), cooling.alias("cooling"), cuts.alias("cuts"))

    def step(s: Column, e: Column) -> Column:
        cool = F.greatest(s["cooling"] - 1, F.lit(0))
        waited = F.when(s["cooling"] > 0, 0).otherwise(s["waited"])
        better = e["loss"] < s["best"] - min_delta
        late = ~better & (cool == 0)
        cut = late & (waited + 1 >= patience) & (e["rate"].cast("float") > F.lit(min_rate).cast("float"))
        return state(
            F.when(better, e["loss"]).otherwise(s["best"]), F.when(better | cut, 0).when(late, waited + 1).otherwise(waited),
            F.when(cut, cooldown).otherwise(cool), F.when(cut, s["cuts"] + 1).otherwise(s["cuts"]),
        )

    known = F.filter(epochs, lambda e: e["loss"].isNotNull() & e["rate"].isNotNull())
    return F.aggregate(known, state(F.lit(1e300), F.lit(0), F.lit(0), F.lit(0)), step)
