"""What reports say of a game: sides, results, runs of moves, and labels of lost points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kifu_spark.operators.ranking import top_by_group

CONTESTED_LOW, CONTESTED_HIGH = 0.3, 0.9


def side_of(player: Column, black: Column, white: Column) -> Column:
    """B or W where the player is named as that side, ignoring case; null for a game of others."""
    same = lambda a, b: F.lower(F.trim(a)) == F.lower(F.trim(b))
    return F.when(same(player, black), "B").when(same(player, white), "W")


def result_parts(result: Column, side: Column) -> dict[str, Column]:
    """winner, how (score, resign, time, forfeit), margin and won and score from the side's view, of a result like W+12.5."""
    winner = F.when(result.rlike("^[BW][+]"), F.substring(result, 1, 1))
    tail = F.upper(F.substring(result, 3, 20))
    margin = tail.try_cast("double")
    how = F.when(margin.isNotNull(), "score").when(tail.startswith("R"), "resign").when(tail.startswith("T"), "time").when(tail.startswith("F"), "forfeit")
    won = winner == side
    return {"winner": winner, "how": F.when(winner.isNotNull(), how), "won": won, "score": F.when(won, margin).otherwise(-margin)}


def finished(winner: Column, line: Column, least: int = 50) -> Column:
    """Whether a game has a winner and enough moves to count."""
    return winner.isNotNull() & (F.size(line) >= least)


def leading_run(line: Column, color: str, most: Column, has_setup: Column | None = None) -> Column:
    """How many moves at the start are the color's, all of ``most`` or none: handicap stones placed as moves.

    A handicap of one is no stones, and where a record sets stones up none are placed as moves.
    """
    first = F.slice(line, F.lit(1), F.greatest(most, F.lit(1)))
    whole = (F.size(first) == most) & F.forall(first, lambda m: m["color"] == color)
    placed = (most > 1) & whole & ~F.coalesce(F.lit(False) if has_setup is None else has_setup, F.lit(False))
    return F.when(placed, most).otherwise(0)


def last_board_turn(line: Column) -> Column:
    """Moves up to the last that is not a pass."""
    return F.coalesce(F.array_max(F.transform(line, lambda m, i: F.when(~m["point"].isin("", "tt"), i + 1))), F.lit(0))


def longest_common_prefix(a: Column, b: Column) -> Column:
    """How many first elements two arrays share."""
    pairs = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))
    step = lambda s, same: F.struct((s["n"] + (s["on"] & same).cast("int")).alias("n"), (s["on"] & same).alias("on"))
    return F.aggregate(pairs, start, step, lambda s: s["n"])


def contested(ownership: Column) -> Column:
    """Points whose ownership is in doubt."""
    return F.size(F.filter(ownership, lambda o: (F.abs(o) >= CONTESTED_LOW) & (F.abs(o) < CONTESTED_HIGH)))


def dead_stones(stones: Column, ownership: Column, least: float = 0.0) -> Column:
    """Stones (structs of color and place) on points that the other side owns by more than ``least``."""
    own = lambda s: F.element_at(ownership, s["place"] + 1)
    return F.filter(stones, lambda s: F.when(s["color"] == "B", own(s) < -least).otherwise(own(s) > least))


def score_flag(stated: Column, judged: Column, most: float = 10.0) -> Column:
    """Whether a judged score names another winner, or differs by more than ``most``."""
    return (F.signum(stated) != F.signum(judged)) | (F.abs(stated - judged) > most)


def with_drops(leads: DataFrame, keys: list[str], order: str, lead: str, least: float) -> DataFrame:
    """leads with lost (fall to the next row) and its label: fight where most of it is handed back at once, else blunder."""
    w = Window.partitionBy(*keys).orderBy(order)
    after, later = F.lead(lead, 1).over(w), F.lead(lead, 2).over(w)
    lost = F.col(lead) - after
    label = F.when(later - after >= 0.7 * lost, "fight").otherwise("blunder")
    return leads.withColumns({"lost": lost, "label": F.when(lost >= least, label)})


def winrate_kept(win: Column, loss: Column) -> Column:
    """A win rate among decided outcomes; null where there are none."""
    return F.when(win + loss > 0, win / (win + loss))


def normalised(shares: Column, allowed: Column) -> Column:
    """Shares of the allowed places (0-based), made to sum to one; empty where they sum to nothing."""
    some = F.transform(allowed, lambda i: F.element_at(shares, i + 1))
    total = F.aggregate(some, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.transform(some, lambda x: x / total)).otherwise(F.array().cast("array<double>"))


def drawn(shares: Column, uniform: Column) -> Column:
    """The place that a uniform number picks from a distribution, by its running sum."""
    state = lambda n, left: F.struct(n.alias("n"), left.alias("left"))
    step = lambda s, p: state(F.when(s["left"] >= p, s["n"] + 1).otherwise(s["n"]), F.when(s["left"] >= p, s["left"] - p).otherwise(F.lit(-1.0)))
    return F.least(F.aggregate(shares, state(F.lit(0), uniform), step, lambda s: s["n"]), F.size(shares) - 1)


def joined_replies(asked: DataFrame, replies: DataFrame) -> DataFrame:
    """Positions with their analysis by (id, turn); a position without one fails when its row is read."""
    found = asked.join(replies.withColumn("__found", F.lit(True)), ["id", "turn"], "left")
    missing = F.raise_error(F.concat(F.lit("no reply for "), "id", F.lit(" at "), F.col("turn").cast("string")))
    return found.withColumn("__found", F.coalesce(F.col("__found"), missing.cast("boolean"))).filter("__found").drop("__found")


def record_text(header: Column, line: Column) -> Column:
    """A record written from its header properties and its moves (structs of color and point)."""
    return F.concat(F.lit("(;"), header, F.array_join(F.transform(line, lambda m: F.concat(F.lit(";"), m["color"], F.lit("["), m["point"], F.lit("]"))), ""), F.lit(")"))


def tactics_set(
    drops: DataFrame, replies: DataFrame, keys: list[str], lost: str, per_game: int = 2, tolerance: float = 3.0, most_accepted: int = 5, least_visits: int = 5
) -> DataFrame:
    """Positions where a game was given away and few moves were right: keys, turn, lost, played, accepted, nth.

    `drops` has keys, turn, lost and played; twice `per_game` of each game are looked at, the largest first, ties to the
    earlier turn. `replies` has keys, turn, move, visits and lead, as seen by the side to move. Accepted are the moves
    within the tolerance of the best; a position without replies, with more of them, or where the played move is one
    of them does not count. The first `per_game` that count stay.
    """
    looked = top_by_group(drops, keys, [F.desc(lost), F.col("turn")], 2 * per_game, "by_loss")
    seen = replies.filter((F.col("visits") >= least_visits) & F.col("lead").isNotNull() & (F.col("move") != "pass"))
    answers = seen.join(looked.select(*keys, "turn"), [*keys, "turn"], "left_semi").groupBy(*keys, "turn").agg(F.collect_list(F.struct("lead", "move")).alias("answers"))
    best = F.array_max("answers")["lead"]
    accepted = F.array_sort(F.transform(F.filter("answers", lambda a: a["lead"] >= best - tolerance), lambda a: a["move"]))
    judged = looked.join(answers, [*keys, "turn"]).withColumn("accepted", accepted)
    fit = judged.filter((F.size("accepted") <= most_accepted) & ~F.coalesce(F.array_contains("accepted", F.col("played")), F.lit(False)))
    return top_by_group(fit, keys, [F.col("by_loss")], per_game).select(*keys, "turn", lost, "played", "accepted", "nth")


def scored_tactics(positions: DataFrame, policy: DataFrame, keys: list[str]) -> DataFrame:
    """keys, turn, top_right, best_rank: whether a policy's first move is accepted, and the rank of the first that is.

    `policy` has keys, turn, move and share, each move once; ties in share go to the smaller move. Without a policy for
    a position top_right is false; without an accepted move in it best_rank is null.
    """
    asked = positions.select(*keys, "turn", "accepted")
    moves = policy.join(asked.select(*keys, "turn"), [*keys, "turn"], "left_semi")
    order = moves.groupBy(*keys, "turn").agg(F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("less"), "move")))["move"].alias("order"))
    place = F.array_min(F.filter(F.transform("accepted", lambda m: F.array_position("order", m)), lambda at: at > 0))
    ranked = asked.join(order, [*keys, "turn"], "left").withColumn("best_rank", place)
    return ranked.select(*keys, "turn", F.coalesce(F.col("best_rank") == 1, F.lit(False)).alias("top_right"), "best_rank")
