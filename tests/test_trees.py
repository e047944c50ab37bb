"""Record trees, points, labels, log summaries, shards and judged results by hand."""

import pytest
from pyspark.sql import functions as F

from kifu_spark.functions import trees
from kifu_spark.functions.text import quoted, unquoted
from kifu_spark.operators import ranking
from kifu_spark.sources import records as sources


def column(spark, values, made, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", made(F.col("v")).alias("x")).orderBy("i").collect()]


def test_first_nodes(spark):
    texts = ["(;KM[6.5]C[a\\]b \\\\ (;KM[0\\])]AB[aa] [bb]\n;B[cc])", " ( ; SZ[9]SZ[13]XKM[1])", "no tree", "(;)", "(;C[" + "x\\]" * 100_000 + "]KM[7])"]
    got = column(spark, texts, trees.root_properties)
    assert got[0] == {"KM": ["6.5"], "C": ["a]b \\ (;KM[0])"], "AB": ["aa", "bb"]} and got[1] == {"SZ": ["9"], "XKM": ["1"]}
    assert got[2] is None and got[3] == {} and got[4]["KM"] == ["7"] and len(got[4]["C"][0]) == 200_000
    assert column(spark, ["(;XKM[1]KM[ 5\\] ])", "(;B[aa])", "(;C[]])KM[2"], lambda t: trees.property_text(t, "KM")) == ["5\\]", "", ""]
    assert column(spark, ["(;KM[\n6.5\t]", "(;RE[ \r\n]"], lambda t: trees.property_text(t, "KM")) == ["6.5", ""]
    assert column(spark, texts, trees.root_length)[0] == texts[0].index("\n") + 1


def test_points_labels_rules_and_ends(spark):
    assert column(spark, ["aa", "SC", "tt", "", "zz", "a"], lambda c: trees.place_of_point(c, 19)) == [0, 2 * 19 + 18, None, None, None, None]
    assert column(spark, [0, 56, None], lambda c: trees.point(c, 19), "int") == ["aa", "sc", ""]
    assert column(spark, [40.44, 1.0, 0.553, 0.01, 0.00032, 0.0097, 0.0], trees.short_percent, "double") == ["40.4", "1.0", "0.55", "0.01", "3e-4", "1e-2", "0e0"]
    assert column(spark, ["Japanese", "KOR", "nz", None], trees.ruleset_name) == ["japanese", "korean", "chinese", "chinese"]
    assert column(spark, ["(;B[aa])", "(;B[aa]) \n", "(;B[aa]", "(;B[a)", "(;W[)"], trees.cut_off) == [False, False, True, True, True]
    assert column(spark, [0.2, 3.14, -12.06], trees.score_text, "double") == ["0", "B+3.1", "W+12.1"]


def test_written_records_read_back(spark):
    df = spark.createDataFrame([("a]b\\", ["aa", "bb"], "x]")], "name string, black array<string>, note string")
    line = F.array(F.struct(F.lit("B").alias("color"), F.lit("dd").alias("point")), F.struct(F.lit("W").alias("color"), F.lit("").alias("point")))
    nodes = trees.commented_moves(line, F.array("note", F.lit(None).cast("string")))
    record = trees.written_record(F.create_map(F.lit("PB"), F.col("name")), F.col("black"), F.array().cast("array<string>"), nodes)
    row = df.select(record.alias("r"), trees.root_properties(record).alias("p")).first()
    assert row.r == "(;PB[a\\]b\\\\]AB[aa][bb]\n;B[dd]C[x\\]]\n;W[])\n" and row.p == {"PB": ["a]b\\"], "AB": ["aa", "bb"]}


def test_literals(spark):
    texts = ["it's", 'say "x"', "both ' and \"", "a\\n\nb\\", "\\\\'", "", "tab\t\r"]
    assert column(spark, texts, lambda t: unquoted(quoted(t))) == texts
    assert column(spark, ["it's", "a\n"], quoted) == ['"it\'s"', "'a\\n'"]


def test_log_with_unanswered_commands(spark, tmp_path):
    rows = [(0, 1, ">", "clear_board"), (1, 1, "<", "= "), (2, 1, ">", "genmove b"), (3, 2, ">", "name"), (9, 1, "<", "= D4"), (10, 2, ">", "play x"), (11, 2, "<", "? it's bad"), (12, 1, ">", "genmove w")]
    (tmp_path / "a.log").write_text("\n".join(f"2026-01-01T00:00:{s:02d}.000 pid={p} {d} {t!r}" for s, p, d, t in rows))
    pairs = sources.exchanges(sources.read_log(spark, str(tmp_path / "a.log")))
    got = {(r.pid, r.command): (r.raw, r.ms) for r in pairs.collect()}
    assert got == {
        ("1", "clear_board"): ("= ", 1000.0), ("1", "genmove b"): ("= D4", 7000.0), ("1", "genmove w"): (None, None),
        ("2", "name"): (None, None), ("2", "play x"): ("? it's bad", 1000.0),
    }
    one = sources.log_summary(pairs).first()
    assert (one.games, one.ended, one.timed, one.slow, one.longest_ms, one.unanswered, one.errors) == (1, 0, 1, 1, 7000.0, 2, {"play": 1})


def test_selection_ranges(spark):
    rows = [("a", 9, "0.7", "9.0", "normal"), ("b", 9, "0.3", "5.0", "normal"), ("c", 9, "0.71", "7", "normal"), ("d", 9, "0.5", "9.5", "normal")]
    df = spark.createDataFrame(rows, "path string, n_moves int, first_searched_winrate string, komi string, gtype string")
    assert {r.path for r in sources.selection_pools(df).collect()} == {"a", "b"}


def test_judged_results_must_be_answered(spark, tmp_path):
    games = spark.createDataFrame([(0, "x", "y", 1.0, "B", "x", "0.sgf")], "game_index int, black_model string, white_model string, score double, winner_color string, winner_model string, sgf_file string")
    none = spark.createDataFrame([], "sgf_file string, lead double")
    with pytest.raises(Exception, match="no answer for 0.sgf"):
        sources.decided(games, none, must_answer=True).collect()
    leads = spark.createDataFrame([("0.sgf", -2.26)], "sgf_file string, lead double")
    sources.write_decided(sources.decided(games, leads, must_answer=True), str(tmp_path / "out"))
    row = spark.read.json(str(tmp_path / "out")).first()
    assert (row.winner_model, row.recorded_winner_model, row.flipped, row.black_lead) == ("y", "x", True, -2.3)


def test_split_shards(spark, tmp_path):
    rows = spark.createDataFrame([("train", "g1", "FF", 3), ("train", "g1", "0F", 4), ("val", "g2", "00", 5)], "split string, game string, packed string, action int")
    path = str(tmp_path / "shards")
    sources.write_split_shards(rows, path, ["board", "ones"], 19, rows_per_file=1)
    train = sources.read_split_shards(spark, path, "train")
    assert train.count() == 2 and {(r.features, r["size"]) for r in train.collect()} == {("board,ones", 19)}
    assert spark.read.csv(f"{path}_games", sep="\t", header=True).count() == 2
    with pytest.raises(ValueError, match="no shards of test"):
        sources.read_split_shards(spark, path, "test")
    rows.filter("split = 'train'").withColumns({"features": F.lit("board"), "size": F.lit(19)}).write.partitionBy("split").mode("append").parquet(path)
    with pytest.raises(ValueError, match="differ"):
        sources.read_split_shards(spark, path, "train")


def test_percentiles_beside_groups_without_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), (None, 3.0), ("b", None)], "k string, v double")
    sums = df.groupBy("k").agg(F.count("*").alias("n"))
    got = {r.k: (r.n, r.p) for r in ranking.with_percentiles(sums, df, ["k"], "v", {"p": 0.75}).collect()}
    assert got == {"a": (3, 3.0), None: (1, 3.0), "b": (1, None)}


def test_packing_and_unpacking_take_each_row_once(spark):
    import time

    from kifu_spark.operators.grids import packed_bits

    rows = spark.range(20_000).select("id", F.transform(F.sequence(F.lit(0), F.lit(60)), lambda i: F.pmod(F.xxhash64("id", i), F.lit(2)).cast("int")).alias("f")).cache()
    assert rows.count() == 20_000
    began = time.monotonic()
    back = rows.select("f", trees.unpacked_bits(packed_bits(F.col("f"), 61), 61).alias("back"))
    assert back.filter("f = back").count() == 20_000
    assert time.monotonic() - began < 20  # all bytes were packed again for each flag
