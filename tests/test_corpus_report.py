"""Corpus reports, games of accounts and readers against worked examples and plain versions."""

import random
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kifu_spark.functions.records import manifest
from kifu_spark.operators import corpus_report as report
from kifu_spark.operators.ordered import plateau
from kifu_spark.sources import records as sources

HEAD = "GM[1]SZ[19]KM[6.5]RU[koSIMPLEscoreAREAtaxNONEsui0]C[startTurnIdx=0,gtype=normal]"


def rows_of(df):
    return {(r.section, r.counter, r.value): r.n for r in df.collect()}


def scanned(spark, *texts):
    return manifest(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string"), with_bins=True)


def test_bins_are_half_open(spark):
    values = [99, 100, 199, 200, 3999, 4000, 9000]
    found = spark.range(1).select(report_counts(values).alias("n")).first().n
    assert found == [1, 2, 1, 0, 0, 0, 1, 2]


def report_counts(values):
    from kifu_spark.functions.classify import bin_counts

    return bin_counts(F.array(*map(F.lit, values)), [100, 200, 300, 500, 1000, 2000, 4000])


def test_report_of_moves_and_annotations(spark):
    moves = "".join(f";{'BW'[i % 2]}[aa]C[0.1 0.9 0.0 1.0 v={v}{w}]" for i, (v, w) in enumerate([(50, " weight=0.00"), (100, " weight=1.0"), (4000, " rv=90 weight=2.5"), (350, "")]))
    long = f"(;{HEAD}" + ";B[dd]" * 120 + ")"
    found = rows_of(report.manifest_report(scanned(spark, f"(;{HEAD}{moves};W[tt])", long, "(;SZ[9];B[aa])")))
    hist = {k[1:]: n for k, n in found.items() if k[0] == "histogram"}
    assert {v: n for (c, v), n in hist.items() if c == "visits"} == {"<100": 1, "100-200": 1, ">=4000": 1, "300-500": 1}
    assert {v: n for (c, v), n in hist.items() if c == "weights"} == {"<0.001": 1, "1.0-2.0": 1, ">=2.0": 1}
    assert {v: n for (c, v), n in hist.items() if c == "n_moves"} == {"<50": 2, "100-200": 1}
    assert (hist["gtype", None], hist["gtype", "normal"], hist["size", "9"]) == (1, 2, 1)
    totals = {k[1]: n for k, n in found.items() if k[0] == "total"}
    assert totals == {"files": 3, "moves": 125, "passes": 1, "annotated": 4, "weighted": 3, "reanalyzed": 1, "weight_zero": 1, "weight_pos": 2}
    assert {k[2]: n for k, n in found.items() if k[0] == "flag"} == {"not_19x19": 1, "no_move_annotations": 1}


def test_caps_replay_and_empty(spark):
    stones = "".join(f"[{a}{b}]" for a in "abcde" for b in "abcdefghij")
    one = scanned(spark, f"(;{HEAD}AB{stones}" + ";B[]" * 30 + ")")
    found = rows_of(report.manifest_report(one.withColumns({"replay": F.lit("illegal"), "replay_declared": F.lit(30), "replay_ok": F.lit(12)})))
    assert found["histogram", "n_ab", "40"] == 1 and found["histogram", "n_passes", "20"] == 1 and found["total", "setup_stones", None] == 50
    assert found["flag", "reason", "replay:illegal"] == 1 and found["total", "replay_ok", None] == 12 and found["histogram", "replay", "illegal"] == 1
    assert report.manifest_report(one.limit(0)).count() == 0
    assert report.with_shares(report.manifest_report(one.limit(0))).count() == 0


def test_shares(spark):
    kinds = ["a"] * 5 + ["b"] * 3 + ["c"] * 3 + ["d"]
    texts = [f"(;SZ[19]C[startTurnIdx=0,gtype={k}];B[aa])" for k in kinds]
    found = report.with_shares(report.manifest_report(scanned(spark, *texts)), 2).filter("counter = 'gtype'").orderBy("nth").collect()
    assert [(r.value, r.n, r.percent, r.more) for r in found] == [("a", 5, 41.666667, 2), ("b", 3, 25.0, 2)]


def games(spark, *texts):
    frame = spark.createDataFrame([(f"{i}.sgf", t) for i, t in enumerate(texts)], "path string, text string")
    return {r.path: r.asDict() for r in report.account_games(frame, "Kifu").collect()}


def test_account_games(spark):
    found = games(
        spark,
        "(;PB[Kifu01]PW[ann]WR[3d]HA[2]KM[0.5]RE[B+12.5]RU[Japanese]DT[2026-10-06 12:00];B[dd];B[pp];W[dp](;B[aa];W[])(;B[bb]))",
        "(;PB[bob]PW[Kifu02]BR[1k]RE[B+Resign]AB[dd][pp]HA[2];W[qq];B[cc])",
        "(;PB[ann]PW[bob]RE[B+1];B[aa])",
        "(;PB[Kifu01]PW[Kifu02]RE[W+];B[aa])",
        "(;PW[Kifu9]PB[x]RE[Void])",
        "(;PB[Kifu1]PW[y]RE[W+Forfeit by absence]HA[x])",
    )
    assert set(found) == {"0.sgf", "1.sgf", "3.sgf", "4.sgf", "5.sgf"}
    one, two = found["0.sgf"], found["1.sgf"]
    assert (one["side"], one["opponent"], one["opp_rank"], one["handicap"], one["komi"], one["rules"], one["date"]) == ("B", "ann", "3d", 2, 0.5, "japanese", "2026-10-06")
    assert (one["won"], one["how"], one["score"], one["handicap_moves"]) == (True, "score", 12.5, 2)
    assert [(m.color, m.point) for m in one["line"]] == [("B", "dd"), ("B", "pp"), ("W", "dp"), ("B", "aa"), ("W", "")]
    assert (two["side"], two["won"], two["how"], two["score"], two["setup"], two["handicap_moves"], two["rules"]) == ("W", False, "resign", None, ["dd", "pp"], 0, "chinese")
    assert (found["3.sgf"]["side"], found["3.sgf"]["won"], found["3.sgf"]["how"]) == ("B", False, "")
    assert (found["4.sgf"]["won"], found["4.sgf"]["how"], found["4.sgf"]["line"]) == (None, None, [])
    assert (found["5.sgf"]["how"], found["5.sgf"]["handicap"]) == ("forfeit", 0)


def test_opponent_report(spark):
    moves = ";B[dd];W[];B[pp];W[qq]"
    texts = [f"(;PB[Kifu1]PW[ann]WR[3d]KM[6.5]RE[{r}]{moves})" for r in ("B+2.5", "W+3.5", "B+2.5", "B+R", "Void")] + ["(;PB[Kifu1]PW[ann]RE[B+T];B[aa])"]
    frame = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")
    found = {(r.section, r.counter, r.value): r.n for r in report.opponent_report(report.account_games(frame, "Kifu"), least=3).collect()}
    assert found == {
        ("record", "account won", "HA0 komi 6.5"): 3, ("record", "opponent won", "HA0 komi 6.5"): 1, ("margin", "account won", "2.5"): 2, ("margin", "opponent won", "3.5"): 1,
        ("ending", "account won", "score"): 2, ("ending", "account won", "resign"): 1, ("ending", "opponent won", "score"): 1, ("pass", "", "2"): 4,
        ("rank", "", "3d"): 5, ("rank", "", "-"): 1, ("account", "", "Kifu1"): 6,
    }


def plain_plateau(epochs, patience, cooldown, min_rate, min_delta):
    best, waited, cooling, cuts = 1e300, 0, 0, 0
    for loss, rate in epochs:
        if loss is None or rate is None:
            continue
        if cooling:
            cooling, waited = cooling - 1, 0
        if loss < best - min_delta:
            best, waited = loss, 0
        elif not cooling:
            waited += 1
            if waited >= patience and rate > min_rate:
                cooling, waited, cuts = cooldown, 0, cuts + 1
    return best, waited, cooling, cuts


@pytest.mark.parametrize("patience,cooldown", [(1, 0), (2, 3), (3, 1)])
def test_plateau(spark, patience, cooldown):
    rng = random.Random(patience * 10 + cooldown)
    runs = [[(rng.choice([None, *[round(rng.random(), 2)] * 9]), rng.choice([0.01, 0.001, 0.1])) for _ in range(n)] for n in range(25)]
    frame = spark.createDataFrame(list(enumerate(runs)), "i int, e array<struct<loss:double,rate:double>>")
    found = {r.i: tuple(r.s) for r in frame.select("i", plateau(F.col("e"), patience, cooldown, 0.001, 0.05).alias("s")).collect()}
    assert found == {i: plain_plateau(run, patience, cooldown, 0.001, 0.05) for i, run in enumerate(runs)}


def test_plateau_reads_rates_as_32_bits(spark):
    frame = spark.createDataFrame([([(1.0, 0.01), (1.0, 0.0010000000474974513)],)], "e array<struct<loss:double,rate:double>>")
    assert tuple(frame.select(plateau(F.col("e"), 1, 2, 0.001).alias("s")).first().s) == (1.0, 1, 0, 0)


def test_sample_positions(spark):
    lines = {f"g{i}": n for i, n in enumerate([10, 3, 7, 10, 12])}
    frame = spark.createDataFrame([(k, [("BW"[i % 2], f"p{i}") for i in range(n)]) for k, n in lines.items()], "path string, line array<struct<color:string,point:string>>")
    found = {r.id: ([m.point for m in r.moves], r.to_move) for r in report.sample_positions(frame, [5, 8], 3, least=6).collect()}
    assert set(found) == {"g0@5", "g0@8", "g2@5", "g3@5", "g3@8"}
    assert found["g2@5"] == (["p0", "p1", "p2", "p3"], "B") and found["g0@8"][1] == "W"


def test_readers_take_any_case_text_files_and_archives(spark, tmp_path):
    day = tmp_path / "2026" / "03" / "07"
    day.mkdir(parents=True)
    for name in ("b.SGF", "a.sgf", "c.Txt", "d.png"):
        (day / name).write_text(f"(;N[{name}])")
    (tmp_path / "z.sgf").write_text("(;N[z])")
    with zipfile.ZipFile(tmp_path / "m.ZIP", "w") as archive:
        archive.writestr("x/2025/11/02/e.Sgf", "(;N[e])")
        archive.writestr("x/readme.md", "no")
    (tmp_path / "bad.zip").write_bytes(b"PK nothing")
    rows = sources.read_games(spark, str(tmp_path), (".sgf", ".txt")).orderBy("walk").collect()
    assert [(r.name, r.error is None) for r in rows] == [("bad.zip", False), ("2025/11/2/e.Sgf", True), ("z.sgf", True), ("2026/3/7/a.sgf", True), ("2026/3/7/b.SGF", True), ("2026/3/7/c.Txt", True)]
    assert Counter(r.path.rsplit("/", 1)[1] for r in sources.read_records(spark, str(tmp_path)).collect()) == Counter(["a.sgf", "b.SGF", "z.sgf"])
    assert [r.path.rsplit("/", 1)[1] for r in sources.first_in_walk(sources.read_records(spark, str(tmp_path)), 2).collect()] == ["z.sgf", "a.sgf"]


def test_shares_read_the_report_once(spark):
    entry = F.struct(F.lit("histogram").alias("section"), F.lit("size").alias("counter"), F.lit("19").alias("value"), F.lit(3).cast("long").alias("n"))
    total = F.struct(F.lit("total").alias("section"), F.lit("files").alias("counter"), F.lit(None).cast("string").alias("value"), F.lit(3).cast("long").alias("n"))
    made = spark.range(1).repartition(1).select(F.explode(F.array(entry, total, F.when(F.rand(1) < 0, entry))).alias("e")).filter("e is not null").select("e.*")
    shares = report.with_shares(made, 4)
    assert "Generate" not in shares._jdf.queryExecution().optimizedPlan().toString()  # the corpus was scanned three times
    assert [tuple(r) for r in shares.collect()] == [("size", "19", 3, 100.0, 1, 0)]


def test_straight_records_are_read_without_windows(spark):
    from kifu_spark.operators.record_trees import played_moves, record_nodes, straight_moves

    texts = [
        "(;SZ[19];B[dd];W[tt]C[a;b(c)])", "(;SZ[9];B[dd]", "(;B[aa];W[])", "( ;SZ[19]\n; B[ab];C[x];W[zz];AB[aa][bb];B[cc]) tail", "()", "(", "", "no record", ";B[aa]",
        "(;A[1];B[dd](;W[aa];B[ab])(;W[bb]))", "(;A[1];B[dd])(;A[2];B[ee])", "(;A[1];B[dd]);W[aa]", "(;A[1];B[d\\]d];W[ab];B[q", "((;A[1];B[dd]))", "(;A[1])", "(;A[1];B[dd]))",
    ]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")
    want = {r.path: r.moves for r in played_moves(record_nodes(rows)).collect()}
    got = {r.path: r.moves for r in rows.select("path", straight_moves(F.col("text")).alias("moves")).collect()}
    straight = {path: moves for path, moves in got.items() if moves is not None}
    assert {"0", "1", "2", "3", "14"} <= set(straight) and not {"9", "10", "11", "13"} & set(straight)
    assert all(moves == want.get(path, []) for path, moves in straight.items())


def test_report_rows_of_a_record_do_not_grow_with_its_numbers(spark):
    text = f"(;{HEAD};B[tt]C[0.1 0.9 0.0 1.0 v=50 weight=0.0];W[aa])"
    made = report.manifest_report(scanned(spark, text, text).withColumn("replay", F.when(F.col("path") == "0", "illegal")).withColumns({"replay_declared": F.lit(2), "replay_ok": F.lit(1)}))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" in plan  # a row for each value and flag; each bin and total had one too
    found = rows_of(made)
    assert found["histogram", "visits", "<100"] == found["histogram", "weights", "<0.001"] == found["total", "passes", None] == 2
    assert found["flag", "reason", "replay:illegal"] == found["histogram", "replay", "illegal"] == 1 and ("histogram", "replay", None) not in found
    assert found["total", "replay_declared", None] == 4 and found["total", "files", None] == 2


def test_records_of_a_corpus_pass_no_broadcast(spark, sf_dir):
    from kifu_spark.plans.corpora import _records

    assert "BroadcastHashJoin" not in _records(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
