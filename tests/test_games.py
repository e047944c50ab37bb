"""Replay and report functions on worked examples."""

import random

from pyspark.sql import functions as F

from kifu_spark.functions import games
from kifu_spark.operators.replay import Board, replay_game
from kifu_spark.plans.games import SIZE, _moves
from kifu_spark.operators.replay import replay



def test_ko_is_refused_at_once_and_allowed_later():
    board = Board(5)
    for color, place in [("B", 1), ("W", 2), ("B", 5), ("W", 8), ("B", 11), ("W", 12), ("B", 7)]:
        assert board.play(color, place)[0] is None
    assert board.play("W", 6)[:2] == (None, 1) and board.ko == 7
    assert board.play("B", 7)[0] == "illegal_ko"
    assert board.play("B", 24)[0] is None and board.play("W", 23)[0] is None
    assert board.play("B", 7)[:2] == (None, 1)


def test_occupied_suicide_and_prefix():
    moves = [(1, "B", 1), (2, "W", 20), (3, "B", 5), (4, "W", 0), (5, "B", 9)]
    rows = replay_game(moves, 5)
    assert [r[3] for r in rows] == [None, None, None, "illegal_suicide"]
    assert replay_game([(1, "B", 3), (2, "W", 3)], 5)[-1][3] == "illegal_occupied"


def test_capture_counts_and_liberties():
    rows = replay_game([(1, "W", 0), (2, "B", 1), (3, "W", 24), (4, "B", 5)], 5)
    assert rows[-1][4:7] == (1, 1, 3) and rows[-1][8:] == (2, 1)


def slow_legal(stones, ko, color, p, size):
    """Copies the board and floods from every stone."""
    if p in stones:
        return "illegal_occupied", stones
    if p == ko:
        return "illegal_ko", stones
    after = dict(stones) | {p: color}

    def alive(q):
        seen, todo = {q}, [q]
        while todo:
            x = todo.pop()
            r, c = divmod(x, size)
            for y in [z for z, ok in ((x - size, r > 0), (x + size, r < size - 1), (x - 1, c > 0), (x + 1, c < size - 1)) if ok]:
                if y not in after:
                    return True
                if after[y] == after[q] and y not in seen:
                    seen.add(y)
                    todo.append(y)
        return False

    dead = [q for q in after if after[q] != color and not alive(q)]
    for q in dead:
        del after[q]
    return ("illegal_suicide", stones) if not alive(p) else (None, after)


def test_random_games_against_a_plain_board():
    rng = random.Random(2)
    for _ in range(30):
        board, stones = Board(5), {}
        for n in range(60):
            color, p = "BW"[n % 2], rng.randrange(25)
            want, stones = slow_legal(stones, board.ko, color, p, 5)
            assert board.play(color, p)[0] == want and board.stones == stones


def test_replay_deals_whole_games(spark, sf_dir):
    moves = _moves(spark, sf_dir)
    by_hand = {}
    for r in moves.orderBy("game", "move_no").collect():
        by_hand.setdefault(r.game, []).append((r.move_no, r.color, r.place))
    got = {}
    for r in replay(moves, SIZE).collect():
        got.setdefault(r.game, []).append(tuple(r)[1:])
    assert {g: sorted(rows) for g, rows in got.items()} == {g: replay_game(rows, SIZE) for g, rows in by_hand.items()}


def test_results_and_sides(spark):
    df = spark.createDataFrame([("bot", "x", "W+12.5"), ("x", "BOT", "W+R"), ("x", "y", "B+T"), ("bot", "x", "0")], "b string, w string, re string")
    side = games.side_of(F.lit("Bot"), F.col("b"), F.col("w"))
    parts = games.result_parts(F.col("re"), side)
    rows = df.select(side.alias("side"), *[c.alias(n) for n, c in parts.items()]).collect()
    assert (rows[0].won, rows[0].how, rows[0].score) == (False, "score", -12.5)
    assert (rows[1].side, rows[1].won, rows[1].how) == ("W", True, "resign") and rows[2].side is None and rows[3].winner is None


def test_lines(spark):
    line = [("B", "dd"), ("B", "pp"), ("W", "dp"), ("B", ""), ("W", "tt")]
    df = spark.createDataFrame([(line, 2), (line[2:], 2)], "line array<struct<color:string,point:string>>, ha int")
    rows = df.select(games.leading_run(F.col("line"), "B", F.col("ha")).alias("run"), games.last_board_turn(F.col("line")).alias("last"), games.record_text(F.lit("SZ[19]"), F.col("line")).alias("text")).collect()
    assert [(r.run, r["last"]) for r in rows] == [(2, 3), (0, 1)] and rows[1].text == "(;SZ[19];W[dp];B[];W[tt])"
    stones = spark.createDataFrame([(line, n, setup) for n, setup in ((0, False), (1, False), (2, False), (2, True), (3, False), (2, None))], "line array<struct<color:string,point:string>>, ha int, setup boolean")
    placed = [r[0] for r in stones.select(games.leading_run(F.col("line"), "B", F.col("ha"), F.col("setup"))).collect()]
    assert placed == [0, 0, 2, 0, 0, 2]
    pair = spark.createDataFrame([(["a", "b", "c", "d"], ["a", "b", "x", "d"])], "a array<string>, b array<string>")
    assert pair.select(games.longest_common_prefix(F.col("a"), F.col("b"))).first()[0] == 2


def test_drops_and_replies(spark):
    df = spark.createDataFrame([(1, t, float(x)) for t, x in enumerate((50, 10, 45, 0, 1))], "game int, turn int, lead double")
    rows = {r.turn: r.label for r in games.with_drops(df, ["game"], "turn", "lead", 30).collect()}
    assert rows == {0: "fight", 1: None, 2: "blunder", 3: None, 4: None}
    asked = spark.createDataFrame([("g", 1), ("g", 2)], "id string, turn int")
    replies = spark.createDataFrame([("g", 1, 0.5), ("g", 2, 0.7)], "id string, turn int, lead double")
    assert games.joined_replies(asked, replies).count() == 2
    try:
        games.joined_replies(asked, replies.limit(1)).collect()
        raise AssertionError("a missing reply must fail")
    except Exception as error:
        assert "no reply for g" in str(error)


def test_games_are_dealt_in_batches_and_not_one_by_one(spark):
    rng = random.Random(5)
    by_hand = {g: [(n, "BW"[n % 2], rng.randrange(-1, 19 * 19)) for n in range(1, rng.randrange(2, 60))] for g in [None, *range(300)]}
    rows = [(g, *m) for g, game in by_hand.items() for m in game]
    rng.shuffle(rows)
    played = replay(spark.createDataFrame(rows, "game long, move_no int, color string, place int"), 19, rows=50)
    assert "Pandas" not in played._jdf.queryExecution().optimizedPlan().toString()  # a call for each game took a millisecond and more
    got = {}
    for r in played.collect():
        got.setdefault(r.game, []).append(tuple(r)[1:])
    assert {g: sorted(found) for g, found in got.items()} == {g: replay_game(game, 19) for g, game in by_hand.items()}
