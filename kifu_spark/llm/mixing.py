"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

Every source gets a share of the whole size by weight; a share stops at ``most_repeats`` times the source, and the
excess goes to the others by weight until none is above. In closed form a target is ``least(cap, level * weight)``,
and the level follows from running sums over the sources in order of cap / weight.

Documents are dealt by a seeded hash to shards, so that a source, however large, is spread over all of them. In a
cell (source, shard) the documents stand in seeded order and form one line of words, cut into blocks of equal size.
Sources get whole blocks by highest quotients votes / (2 k + 1), then each source's quota is dealt the same way to
its cells: one integer quota for each source in each shard. A cell takes all of its blocks as often as the quota
allows and, of the rest, an arc of blocks from a seeded start; a word is taken as often as its block is.

Words are counted once and written without their texts; only these sizes are shuffled. Orders over all sources (their
places, ratios and quotients) are taken in ranges with running sums over the ranges, so that neither a window nor a
broadcast grows with the number of sources; joins on a source are left to the engine's own size check. The window over
a source's cells sees at most ``most_shards`` cells times a few quotients.

Cases: null texts have no words and are never taken. The null source is a source and comes last. Sources without
words have target 0. Repeated rows stand side by side on the line, and each has its own words. A text of any length is
counted whole. Further columns never matter, whatever their names. An empty table gives an empty result. Reruns give
the same rows, as every choice is a function of the seed and the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kifu_spark.llm.text import word_count
from kifu_spark.operators.ranking import range_parts, rank_in_order
from kifu_spark.session import stored

WEIGHTS = (5.0, 2.0, 1.0)
BLOCK_WORDS = 64
SHARD_WORDS = 50_000
MOST_SHARDS = 1 << 20
SEED = 17


def running_in_order(df: DataFrame, order: list, amounts: dict[str, str]) -> DataFrame:
    """df with, for each new name, the sum of a column over the rows before in a total order of the whole table."""
    parted = range_parts(df, order, "part")
    ends = parted.groupBy("part").agg(*[F.sum(column).alias(f"{name}_here") for name, column in amounts.items()])
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    firsts = ends.select("part", *[F.coalesce(F.sum(f"{name}_here").over(before), F.lit(0)).alias(f"{name}_first") for name in amounts])
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = {name: F.col(f"{name}_first") + F.coalesce(F.sum(column).over(inside), F.lit(0)) for name, column in amounts.items()}
    return parted.join(F.broadcast(firsts), "part").withColumns(sums).drop("part", *[f"{name}_first" for name in amounts])


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most_repeats: int = 3) -> DataFrame:
    """source, place (from 0, by code point, null last), source_size, target: from rows of (source, size)."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = rank_in_order(by_source, [F.col("source").asc_nulls_last()], "place").withColumn("place", (F.col("place") - 1).cast("int"))
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int")
    )
    weighed = (
        placed.withColumn("weight", weight)
        .withColumn("cap", F.lit(most_repeats) * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    before = running_in_order(weighed, ["ratio", "place"], {"capped_before": "cap", "weight_before": "weight"})
    total, all_weight = before.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(total).cast("long") - F.col("capped_before")) / (F.lit(all_weight).cast("double") - F.col("weight_before"))
    # the first level that its own source's ratio reaches holds for all from there on; those before stop at their caps
    chosen = before.withColumn("level", level).filter("level <= ratio").agg(F.min_by("level", F.struct("ratio", "place"))).first()[0]
    target = F.least(F.col("cap").cast("double"), F.lit(chosen).cast("double") * F.col("weight"))
    return before.select("source", "place", "source_size", F.coalesce(target, F.col("cap").cast("double")).alias("target"))


def sainte_lague(parties: DataFrame, group: list[str], party: list[str], seats: Column, out: str) -> DataFrame:
    """Deal each group's seats to its parties by highest quotients votes / (2 k + 1), none above its ``most`` seats.

    parties has the columns of group and party, votes (double) and most (long). Only quotients near the cut are
    listed: a party's seats lie within share +- (2 + share * parties / seats), and those below are certain. ``most``
    may cut a share by its rounding, not by more. Without a group the quotients are ranked in ranges of their order.
    """

    def over_group(df: DataFrame, value: Column) -> Column:
        return value.over(Window.partitionBy(*group)) if group else F.lit(df.agg(value).first()[0])

    shared = parties.withColumn("dealt", seats)
    share = F.col("votes") * F.col("dealt") / F.greatest(over_group(shared, F.sum("votes")), F.lit(1e-9))
    near = (
        shared.withColumn("share", share)
        .withColumn("slack", 2 + F.col("share") * over_group(shared, F.count("*")) / F.greatest(F.col("dealt"), F.lit(1)))
        .withColumn("certain", F.least(F.col("most"), F.greatest(F.lit(0), F.floor(F.col("share") - F.col("slack")))).cast("long"))
        .withColumn("upto", F.least(F.col("most"), F.ceil(F.col("share") + F.col("slack"))).cast("long"))
    )
    listed = stored(near.withColumn("open", F.col("dealt") - F.coalesce(over_group(near, F.sum("certain")), F.lit(0))))
    quotients = (
        listed.filter("upto > certain and votes > 0")
        .withColumn("k", F.explode(F.sequence(F.col("certain"), F.col("upto") - 1)))
        .withColumn("quotient", F.col("votes") / (2 * F.col("k") + 1))
    )
    if group:
        numbered = quotients.withColumn("nth", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("quotient"), *party)))
    else:
        numbered = rank_in_order(quotients, [F.desc("quotient"), *party, "k"], "nth")
    won = numbered.filter("nth <= open").groupBy(*group, *party).agg(F.count("*").alias("won"))
    keys = [*group, *party]
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"w.{k}")) for k in keys]
    return (
        listed.alias("l")
        .join(won.alias("w"), same, "left")
        .select(*[F.col(f"l.{c}") for c in parties.columns], (F.col("l.certain") + F.coalesce(F.col("w.won"), F.lit(0))).alias(out))
    )


def seeded(seed: int, *parts: Column) -> Column:
    """A hex digest of the seed and the parts; the same in any engine that has MD5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))


def hash32(digest: Column) -> Column:
    """The first 32 bits of a hex digest as a long."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    most_repeats: int = 3,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    most_shards: int = MOST_SHARDS,
    seed: int = SEED,
    row_col: str | None = None,
) -> DataFrame:
    """doc_id, size, source, source_size, target, taken, shard for every row, and ``row`` where a column numbers the rows."""
    sized = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            seeded(seed, F.col(id_col)).alias("digest"),
            *([F.col(row_col).alias("row")] if row_col else []),
        )
    )
    total = sized.agg(F.sum("size")).first()[0] or 0
    shards = min(most_shards, max(1, -(-total // shard_words)))
    sized = sized.withColumn("shard", F.pmod(hash32(F.col("digest")), F.lit(shards)))

    # one row for each source and shard
    cells = (
        sized.groupBy("source", "shard")
        .agg(F.sum("size").alias("cell_size"))
        .withColumn("blocks", F.greatest(F.lit(1), F.floor(F.col("cell_size") / block_words + 0.5)).cast("long"))
    )
    cells = stored(cells)
    targets = stored(source_targets(cells.select("source", F.col("cell_size").alias("size")), weights, most_repeats))
    cells = cells.filter("cell_size > 0")
    voters = stored(
        cells.groupBy("source")
        .agg(F.sum("blocks").alias("source_blocks"))
        .alias("c")
        .join(targets.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source")))
        .select(
            "t.source",
            "place",
            "source_blocks",
            (F.col("target") * F.col("source_blocks") / F.col("source_size")).alias("votes"),
            (F.lit(most_repeats) * F.col("source_blocks")).alias("most"),
        )
    )
    seats = F.round(F.lit(voters.agg(F.sum("votes")).first()[0])).cast("long")
    quotas = sainte_lague(voters, [], ["place"], seats, "source_quota")
    cell_voters = (
        cells.alias("c")
        .join(quotas.alias("q"), F.col("c.source").eqNullSafe(F.col("q.source")))
        .select(
            "place",
            "shard",
            "cell_size",
            "blocks",
            "source_quota",
            (F.col("votes") * F.col("blocks") / F.col("source_blocks")).alias("votes"),
            (F.lit(most_repeats) * F.col("blocks")).alias("most"),
        )
    )
    cell_quotas = sainte_lague(cell_voters, ["place"], ["shard"], F.col("source_quota"), "quota").withColumn(
        "first_block", F.pmod(hash32(seeded(seed + 1, F.col("place"), F.col("shard"))), F.col("blocks"))
    )
    cell_quotas = stored(cell_quotas.select("place", "shard", "cell_size", "blocks", "quota", "first_block"))

    line = Window.partitionBy("source", "shard").orderBy("digest", "doc_id", "size", *(["row"] if row_col else []))
    on_line = sized.withColumn("stop", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    placed = (
        on_line.alias("d")
        .join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
        .select("d.*", "place", "source_size", "target")
        .join(cell_quotas, ["place", "shard"], "left")
    )
    rest = F.pmod(F.col("quota"), F.col("blocks"))
    arc_end = F.col("first_block") + rest
    edge = lambda block: F.floor(block * F.col("cell_size") / F.col("blocks"))
    start = F.col("stop") - F.col("size")
    common = lambda low, high: F.greatest(F.lit(0), F.least(F.col("stop"), high) - F.greatest(start, low))
    arc = common(edge(F.col("first_block")), edge(F.least(arc_end, F.col("blocks")))) + common(
        F.lit(0), edge(F.greatest(F.lit(0), arc_end - F.col("blocks")))
    )
    taken = F.floor(F.col("quota") / F.col("blocks")) * F.col("size") + arc
    return placed.select(
        "doc_id",
        "size",
        "source",
        "source_size",
        "target",
        F.coalesce(taken, F.lit(0)).cast("long").alias("taken"),
        "shard",
        *(["row"] if row_col else []),
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix as whole documents with the columns of docs: each as often as its taken words fill it, to the nearest.

    The rows are numbered and written once; sizes are dealt without texts and come back to the rows by their numbers.
    """
    numbered = stored(docs.select(F.struct("*").alias("whole"), F.monotonically_increasing_id().alias("row")))
    rows = numbered.select("row", *[F.col("whole").getField(n).alias(a) for n, a in ((id_col, "doc_id"), (text_col, "text"), (source_col, "source"))])
    times = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    mixed = mix_sources(rows, row_col="row", **how).filter(F.col("size") > 0).select("row", times.alias("times")).filter("times > 0")
    repeated = numbered.join(mixed, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return repeated.select(*[F.col("whole").getField(name).alias(name) for name in docs.columns])
