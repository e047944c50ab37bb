"""Histograms, totals and flags of a corpus of records, and what games against each opponent amount to.

Every report is one pass: a row becomes a short array of counted entries, and equal entries are summed where the rows
are before they are shuffled. What arrives grows with the distinct values, never with the rows of one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kifu_spark.functions.classify import bin_labels, in_bins
from kifu_spark.functions.games import leading_run
from kifu_spark.functions.records import VISIT_EDGES, WEIGHT_EDGES
from kifu_spark.functions.trees import property_text, root_properties
from kifu_spark.operators.record_trees import played_moves, record_nodes, straight_moves
from kifu_spark.session import stored

# Fixed values of the report: edges of the bins of moves, and where counts are capped.
MOVE_EDGES = [50, 100, 200, 300, 400, 600]
MOST_PASSES, MOST_STONES = 20, 40

HEADER_COUNTERS = "size gtype komi ko score tax sui rules_extra handicap start_turn_idx".split()
TOTALS = {
    "moves": "n_moves", "passes": "n_passes", "annotated": "n_annotated", "weighted": "n_weighted", "reanalyzed": "n_reanalyzed",
    "weight_zero": "n_weight_zero", "weight_pos": "n_weight_pos", "moveless_nodes": "n_moveless_nodes",
}


def _entry(section: str, counter: Column | str, value: Column, n: Column | int = 1) -> Column:
    counted = n if isinstance(n, Column) else F.lit(n)
    counter = counter if isinstance(counter, Column) else F.lit(counter)
    return F.struct(F.lit(section).alias("section"), counter.alias("counter"), value.cast("string").alias("value"), counted.cast("long").alias("n"))


def _summed(rows: DataFrame, keys: list[str], entries: Column) -> DataFrame:
    """keys, section, counter, value, n of all entries that are not zero."""
    one = rows.select(*keys, F.explode(entries).alias("e")).filter("e.n <> 0").select(*keys, "e.*")
    return one.groupBy(*keys, "section", "counter", "value").agg(F.sum("n").alias("n"))


def manifest_report(manifest: DataFrame) -> DataFrame:
    """section, counter, value, n of a manifest scanned with_bins: 16 histograms, totals and flags.

    A histogram's n are records, of visits and weights annotations. A record on another board counts under null, with
    no moves, passes or stones. Where the manifest has them, ``replay`` is one more histogram whose values but ok are
    flags, and ``replay_declared`` and ``replay_ok`` are totals. An empty manifest has no rows, and no entry is zero.
    """
    none = lambda name: F.coalesce(F.col(name), F.lit(0))
    values = {c: F.col(c) for c in HEADER_COUNTERS} | {
        "n_moves": in_bins(none("n_moves"), MOVE_EDGES),
        "n_passes": F.least(none("n_passes"), F.lit(MOST_PASSES)),
        **{c: F.least(none(c), F.lit(MOST_STONES)) for c in ("n_ab", "n_aw")},
    }
    sums = {("total", "files", None): F.lit(1)} | {("total", name, None): none(c) for name, c in TOTALS.items()}
    sums["total", "setup_stones", None] = none("n_ab") + none("n_aw")
    for name, edges in (("visits", VISIT_EDGES), ("weights", WEIGHT_EDGES)):
        sums |= {("histogram", name, label): F.get(f"{name[:-1]}_bins", F.lit(i)) for i, label in enumerate(bin_labels(edges))}
    if "replay" in manifest.columns:
        values["replay"] = F.col("replay")
        sums |= {("total", c, None): none(c) for c in ("replay_declared", "replay_ok")}
    # a record's values and flags become a row each; its numbers are added up beside the first of them
    names, numbers = list(values), [f"sum{i}" for i in range(len(sums))]
    listed = F.concat(F.array(*[v.cast("string") for v in values.values()]), F.coalesce("reasons", F.array().cast("array<string>")))
    each = manifest.select(F.posexplode(listed).alias("place", "value"), *[v.cast("long").alias(c) for v, c in zip(sums.values(), numbers)])
    place = F.least("place", F.lit(len(names)))
    counted = each.groupBy(place.alias("place"), "value").agg(F.count("*").alias("n"), *[F.sum(F.when(F.col("place") == 0, F.col(c))).alias(c) for c in numbers])
    counter = F.get(F.array(*map(F.lit, names)), F.col("place"))
    once = F.when((counter == "replay") & F.col("value").isNull(), 0).otherwise(F.col("n"))
    parts = [
        F.when(counter.isNotNull(), _entry("histogram", counter, F.col("value"), once)).otherwise(_entry("flag", "reason", F.col("value"), F.col("n"))),
        F.when((counter == "replay") & (F.col("value") != "ok"), _entry("flag", "reason", F.concat(F.lit("replay:"), "value"), F.col("n"))),
        *[_entry(section, name, F.lit(label), F.col(c)) for (section, name, label), c in zip(sums, numbers)],
    ]
    return _summed(counted, [], F.array(*parts))


def with_shares(report: DataFrame, most: int = 12) -> DataFrame:
    """The ``most`` largest values of each histogram: counter, value, n, percent, nth, more (how many others there are).

    Shares are of all records, those of visits and weights of all annotations; equal counts go by value, null first.
    """
    report = stored(report)  # small, and read three times: a corpus must not be
    counts = report.filter("section = 'histogram'")
    base = report.filter("section = 'total' and counter in ('files', 'annotated')").agg(
        F.max(F.when(F.col("counter") == "files", F.col("n"))).alias("files"), F.max(F.when(F.col("counter") == "annotated", F.col("n"))).alias("annotated")
    )  # one row
    ranked = counts.withColumn("nth", F.row_number().over(Window.partitionBy("counter").orderBy(F.desc("n"), "value"))).filter(F.col("nth") <= most)
    kinds = counts.groupBy("counter").agg(F.count("*").alias("kinds"))  # a row for each histogram
    of = F.when(F.col("counter").isin("visits", "weights"), F.col("annotated")).otherwise(F.col("files"))
    return ranked.join(F.broadcast(kinds), "counter").crossJoin(F.broadcast(base)).select(
        "counter", "value", "n", F.round(100.0 * F.col("n") / of, 6).alias("percent"), "nth", F.greatest(F.col("kinds") - most, F.lit(0)).alias("more")
    )


def ending(result: Column, side: Column) -> dict[str, Column]:
    """won, how and score, from the side's view, of a result as W+12.5: score, resign, time, forfeit, or what stands there.

    A result without a winner has nulls; a win by nothing that is said has an empty how.
    """
    winner = F.when(result.rlike(r"(?s)^[BW]\+"), F.substring(result, 1, 1))
    tail = F.regexp_replace(F.substring(result, F.lit(3), F.length(result)), r"^\s+|\s+$", "")
    points = F.when(tail.rlike(r"^[\d.]+$"), tail.try_cast("double"))
    letter = F.lower(F.substring(tail, 1, 1))
    named = F.when(letter == "r", "resign").when(letter == "t", "time").when(letter == "f", "forfeit").otherwise(tail)
    won = winner == side
    return {"won": won, "how": F.when(winner.isNotNull(), F.when(points.isNotNull(), "score").otherwise(named)), "score": F.when(won, points).otherwise(-points)}


def account_games(records: DataFrame, prefix: str) -> DataFrame:
    """Games of the accounts whose name starts with the prefix, from path and text: who, against whom, how it went, the played line.

    path, date, side, account, opponent, opp_rank, handicap, komi, rules, result, won, how, score, setup, line,
    handicap_moves. Black counts where both sides are such accounts; games of others are left out. A handicap or komi
    that is none, or no number, is 0, and rules that are not stated are Chinese. Paths must differ.
    """
    prop = lambda name: property_text(F.col("text"), name)
    black, white = prop("PB").startswith(prefix), prop("PW").startswith(prefix)
    sided = records.select("path", "text").withColumn("side", F.when(black, "B").when(white, "W")).filter("side is not null")
    on_black = F.col("side") == "B"
    of_side = lambda mine, other: F.when(on_black, prop(mine)).otherwise(prop(other))
    stones = F.try_element_at(root_properties(F.col("text")), F.lit("AB"))
    facts = lambda rows, *more: rows.select(
        "path", F.substring(prop("DT"), 1, 10).alias("date"), "side", of_side("PB", "PW").alias("account"), of_side("PW", "PB").alias("opponent"), of_side("WR", "BR").alias("opp_rank"),
        F.coalesce(prop("HA").try_cast("int"), F.lit(0)).alias("handicap"), F.coalesce(prop("KM").try_cast("double"), F.lit(0.0)).alias("komi"),
        F.coalesce(F.nullif(F.lower(prop("RU")), F.lit("")), F.lit("chinese")).alias("rules"), prop("RE").alias("result"),
        F.coalesce(F.filter(stones, lambda p: p.rlike("^[a-s]{2}$")), F.array().cast("array<string>")).alias("setup"), *more,
    )
    # a record without variations is its played line; only the others take the windows over their tokens
    straight = straight_moves(F.col("text"))
    plain = facts(sided.withColumn("line", straight).filter("line is not null"), F.col("line"))
    forked = sided.filter(straight.isNull())
    lines = played_moves(record_nodes(forked)).withColumnRenamed("moves", "line")
    none = F.array().cast("array<struct<color:string,point:string>>")
    branched = facts(forked).join(lines, "path", "left").withColumn("line", F.coalesce("line", none))
    joined = plain.unionByName(branched).withColumns(ending(F.col("result"), F.col("side")))
    return joined.withColumn("handicap_moves", leading_run(F.col("line"), "B", F.col("handicap"), F.size("setup") > 0))


def opponent_report(games: DataFrame, least: int = 50) -> DataFrame:
    """opponent, section, counter, value, n of games as ``account_games`` gives them.

    record: finished games by handicap and komi and who won them; margin: points by who won; ending: how by who won;
    pass: move numbers where the opponent passed before a game's last move; rank and account: of all games. A game is
    finished if someone won it after ``least`` moves or more.
    """
    who = F.when(F.col("won"), "account won").otherwise("opponent won")
    done = F.col("won").isNotNull() & (F.size("line") >= least)
    once = F.when(done, 1).otherwise(0)
    named = lambda section, value, n: F.struct(F.lit(section).alias("section"), who.alias("counter"), value.cast("string").alias("value"), n.cast("long").alias("n"))
    parts = F.array(
        named("record", F.concat(F.lit("HA"), "handicap", F.lit(" komi "), "komi"), once),
        named("margin", F.abs("score"), F.when(done & F.col("score").isNotNull(), 1).otherwise(0)),
        named("ending", F.coalesce(F.nullif("how", F.lit("")), F.lit("?")), once),
        _entry("rank", "", F.coalesce(F.nullif("opp_rank", F.lit("")), F.lit("-"))),
        _entry("account", "", F.col("account")),
    )
    other = F.when(F.col("side") == "B", "W").otherwise("B")
    turns = F.transform("line", lambda m, i: F.when((m["color"] == other) & (m["point"] == "") & (i + 1 < F.size("line")), i + 1))
    passes = F.transform(F.filter(F.when(done, turns).otherwise(F.array().cast("array<int>")), lambda t: t.isNotNull()), lambda t: _entry("pass", "", t))
    return _summed(games, ["opponent"], F.concat(parts, passes))


def sample_positions(games: DataFrame, turns: list[int], most: int, order: str = "path", least: int = 150) -> DataFrame:
    """id, move_number, moves, to_move: positions of the first games in an order that are long enough, before each of the given moves.

    ``games`` has the order's column, each value once, and line; moves are those before the numbered one, whose color
    is to move. Games without any of the moves count as none of the first.
    """
    fit = games.filter((F.size("line") >= least) & (F.size("line") > min(turns))).orderBy(order).limit(most)
    at = fit.select("*", F.explode(F.array(*[F.lit(t) for t in sorted(turns)])).alias("move_number")).filter(F.col("move_number") < F.size("line"))
    return at.select(
        F.concat(F.col(order).cast("string"), F.lit("@"), "move_number").alias("id"), "move_number",
        F.slice("line", F.lit(1), F.col("move_number") - 1).alias("moves"), F.get("line", F.col("move_number") - 1)["color"].alias("to_move"),
    )
