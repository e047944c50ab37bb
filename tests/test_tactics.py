"""Tactics sets worked by hand."""

from kifu_spark.functions.games import scored_tactics, tactics_set

REPLY = "game string, turn int, move string, visits int, lead double"
POLICY = "game string, turn int, move string, share double"


def test_set_and_scores(spark):
    drops = spark.createDataFrame(
        [("a", 5, 30.0, "C3"), ("a", 9, 30.0, "D4"), ("a", 7, 50.0, "E5"), ("a", 8, 40.0, "F6"), ("a", 1, 20.0, "G7"), ("b", 2, 25.0, None)],
        "game string, turn int, lost double, played string",
    )
    replies = spark.createDataFrame(
        [
            ("a", 7, "E5", 9, 10.0), ("a", 7, "D4", 9, 9.0),  # the played move is right
            ("a", 8, "D4", 9, 12.0), ("a", 8, "C3", 9, 9.0), ("a", 8, "B2", 9, 8.9), ("a", 8, "pass", 9, 40.0), ("a", 8, "A1", 4, 50.0),
            ("a", 5, "K9", 9, 3.0), ("a", 5, "J9", 9, None),
            ("a", 9, "K1", 9, 3.0), ("a", 1, "K1", 9, 3.0),  # turn 1 is fifth by loss
            ("b", 2, "H8", 9, 1.0),
        ],
        REPLY,
    )
    found = tactics_set(drops, replies, ["game"], "lost")
    rows = sorted((r.game, r.nth, r.turn, r.played, tuple(r.accepted)) for r in found.collect())
    assert rows == [("a", 1, 8, "F6", ("C3", "D4")), ("a", 2, 5, "C3", ("K9",)), ("b", 1, 2, None, ("H8",))]
    few = tactics_set(drops, replies, ["game"], "lost", most_accepted=1)
    assert sorted((r.game, r.turn) for r in few.collect()) == [("a", 5), ("a", 9), ("b", 2)]
    policy = spark.createDataFrame([("a", 8, "Q9", 0.6), ("a", 8, "D4", 0.3), ("a", 8, "C3", 0.3), ("a", 5, "K9", 0.1)], POLICY)
    scores = {(r.game, r.turn): (r.top_right, r.best_rank) for r in scored_tactics(found, policy, ["game"]).collect()}
    assert scores == {("a", 8): (False, 2), ("a", 5): (True, 1), ("b", 2): (False, None)}


def test_empty_tables(spark):
    drops = spark.createDataFrame([], "game string, turn int, lost double, played string")
    found = tactics_set(drops, spark.createDataFrame([], REPLY), ["game"], "lost")
    assert found.count() == 0
    assert scored_tactics(found, spark.createDataFrame([], POLICY), ["game"]).count() == 0
