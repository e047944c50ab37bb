"""Sources and sinks of records, manifests, keep-lists and protocol logs."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kifu_spark.functions.text import parsed_or_damaged, unquoted
from kifu_spark.operators.dedup import walk_key

KEEP_LIST = "path string, n_moves int, gtype string"


SUFFIXES = (".sgf",)


def any_case(suffixes: tuple[str, ...]) -> str:
    """A file pattern of names that end in one of the suffixes, in capitals or not."""
    cased = ["".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s.lower()) for s in suffixes]
    return f"*{{{','.join(cased)}}}" if len(cased) > 1 else f"*{cased[0]}"


def _files(spark: SparkSession, roots: str | list[str], suffixes: tuple[str, ...]) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", any_case(suffixes)).load(roots)


def read_records(spark: SparkSession, root: str | list[str], suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """path, text, bytes of every record below one or more folders, whatever the case of its suffix.

    Every byte decodes, so each file is a row (Spark lists none of no bytes).
    """
    return _files(spark, root, suffixes).select("path", F.decode("content", "ISO-8859-1").alias("text"), F.col("length").alias("bytes"))


def short_name(path: Column) -> Column:
    """year/month/day/file where a path ends in these, numbers without leading zeros; else the file's name."""
    dated = r"(?:^|[\\/])((?:19|20)\d\d)[\\/](\d+)[\\/](\d+)[\\/]([^\\/]+)$"
    part = lambda i: F.regexp_extract(path, dated, i)
    number = lambda i: F.regexp_replace(part(i), r"^0+(?=\d)", "")
    return F.when(path.rlike(dated), F.concat_ws("/", part(1), number(2), number(3), part(4))).otherwise(F.regexp_extract(path, r"([^\\/]*)$", 1))


def walk_place(path: Column, member: Column | None = None) -> Column:
    """A key that sorts paths as a walk meets them, a folder's files before its folders; members of an archive follow one another."""
    key = walk_key(F.split(path, "/"))
    return key if member is None else F.concat(key, F.coalesce(F.concat(F.lit("\u0001"), member), F.lit("")))


def read_games(spark: SparkSession, roots: str | list[str], suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """path, member, name, walk, text, error of the records in folders and in the zip archives among them.

    member is null outside archives; name is the short name of the file or member; walk sorts as folders are walked. A
    damaged archive is one row with an error and no text. Records of one name stay apart: keep the first by walk.
    """
    loose = read_records(spark, roots, suffixes).select("path", F.lit(None).cast("string").alias("member"), "text", F.lit(None).cast("string").alias("error"))
    packed = read_archives(spark, roots, suffixes).select("path", F.col("name").alias("member"), "text", "error")
    games = loose.unionByName(packed)
    return games.select("path", "member", short_name(F.coalesce("member", "path")).alias("name"), walk_place(F.col("path"), F.col("member")).alias("walk"), "text", "error")


def first_in_walk(records: DataFrame, most: int) -> DataFrame:
    """The first records in the order of a walk, by their path: of each partition only so many are kept before they meet."""
    return records.orderBy(walk_place(F.col("path"))).limit(most)


def read_manifest(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """A JSON-lines manifest (plain or gzip) as struct ``value`` and ``damaged``; blank lines are no rows."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(parsed_or_damaged(F.col("value"), schema).alias("row")).select("row.*")


def not_yet_recorded(records: DataFrame, manifest: DataFrame, key: str = "path") -> DataFrame:
    """Records that the manifest does not list: what a resumed run still has to do."""
    return records.join(manifest.select(key), key, "left_anti")


def pools(manifest: DataFrame, komi: tuple[float, float] = (5.0, 9.0), winrate: tuple[float, float] = (0.3, 0.7)) -> DataFrame:
    """Rows fit for training with their pool: moves, a first win rate in range, and for normal games a komi in range."""
    rate, points = F.col("first_searched_winrate").try_cast("double"), F.col("komi").try_cast("double")
    pool = F.when((F.col("gtype") == "normal") & points.between(*komi), "normal").when(F.col("gtype") == "handicap", "handicap")
    fit = (F.col("n_moves") > 0) & rate.between(*winrate)
    return manifest.filter(fit).withColumn("pool", pool).filter("pool is not null").withColumn("path", F.translate("path", "\\", "/"))


def selection_pools(manifest: DataFrame) -> DataFrame:
    """The pools at the ranges that a selection takes where none are given: komi 5 to 9, first win rate 0.3 to 0.7."""
    return pools(manifest)


def write_keep_lists(rows: DataFrame, path: str) -> None:
    """Tab-separated lists, one folder a split; refuses to overwrite."""
    rows.select("split", "path", "n_moves", "gtype").write.partitionBy("split").option("sep", "\t").csv(path, mode="errorifexists")


def read_keep_lists(spark: SparkSession, path: str) -> DataFrame:
    """Keep-lists read back; missing columns are null."""
    return spark.read.schema(f"{KEEP_LIST}, split string").option("sep", "\t").option("mode", "PERMISSIVE").csv(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """line_no, ts, pid, direction, text of a protocol log: whole files, so that lines keep their numbers."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    lines = files.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    pattern = r"""^(\S+) pid=(\S+) ([<>]) ('.*'|".*")\s*$"""
    part = lambda i: F.regexp_extract("line", pattern, i)
    return lines.filter(F.col("line").rlike(pattern)).select(
        "file", "line_no", part(1).try_cast("timestamp_ntz").alias("ts"), part(2).alias("pid"), part(3).alias("direction"), unquoted(part(4)).alias("text")
    )


def exchanges(log: DataFrame) -> DataFrame:
    """Commands with their replies, by process; a command that another follows, or the log's end, has a null reply.

    ``raw`` is the reply as sent, with its status sign; ``done_at`` of an unanswered command is its own line.
    """
    w = Window.partitionBy("file", "pid").orderBy("line_no")
    reply = F.lead(F.struct("direction", "text", "ts", "line_no")).over(w)
    paired = log.withColumn("next", reply).filter("direction = '>'").withColumn("reply", F.when(F.col("next.direction") == "<", F.col("next")))
    value = F.trim(F.regexp_replace("reply.text", "^=+", ""))
    return paired.select(
        "file", "pid", F.col("text").alias("command"), value.alias("reply"), F.col("reply.text").alias("raw"), F.col("ts").alias("sent"), F.col("reply.ts").alias("answered"),
        F.coalesce("reply.line_no", "line_no").alias("done_at"), (F.timestamp_diff("MICROSECOND", F.col("ts"), F.col("reply.ts")) / 1000.0).alias("ms"),
    )


def log_summary(pairs: DataFrame, marker: str = "clear_board", over: str = "kgs-game_over", timed: str = "genmove", slow_ms: float = 5000.0) -> DataFrame:
    """One row a log: games, games that ended, errors by command, timed commands with their slow ones, and unanswered commands."""
    verb = F.substring_index("command", " ", 1)
    failed = F.coalesce(F.col("raw").startswith("?"), F.lit(False))
    by_verb = pairs.filter(failed).groupBy("file", verb.alias("verb")).agg(F.count("*").alias("n"))
    errors = by_verb.groupBy("file").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("verb", "n")))).alias("errors"))  # one entry a command word
    ms = F.when(verb == timed, F.col("ms"))
    sums = pairs.groupBy("file").agg(
        F.count_if(verb == marker).alias("games"), F.count_if(verb == over).alias("ended"), F.count(ms).alias("timed"), F.count_if(ms > slow_ms).alias("slow"),
        F.max(ms).alias("longest_ms"), F.count_if(F.col("raw").isNull()).alias("unanswered"),
    )
    return sums.join(errors, "file", "left")


def log_games(pairs: DataFrame, marker: str = "clear_board") -> DataFrame:
    """Exchanges with the game they belong to and the komi in force: games run from one marker to the next, per file.

    Games are numbered over a file's exchanges in the order of completion, whichever process made them.
    """
    w = Window.partitionBy("file").orderBy("done_at").rowsBetween(Window.unboundedPreceding, 0)
    setting = lambda name: F.last(F.when(F.col("command").startswith(f"{name} "), F.substring_index("command", " ", -1)), ignorenulls=True).over(w)
    game = F.sum(F.when(F.col("command") == marker, 1).otherwise(0)).over(w)
    return pairs.withColumns({"game": game, "komi": setting("komi").try_cast("double"), "rules": setting("kgs-rules")})


def played_moves(games: DataFrame) -> DataFrame:
    """file, game, moves: a game's moves after undos, by a fold over its exchanges in order; a game is short."""
    play = F.split(F.col("command"), " ")
    one = lambda color, at: F.struct(color.alias("color"), F.upper(at).alias("vertex"))
    added = (
        F.when(play[0] == "play", F.array(one(F.upper(F.substring(play[1], 1, 1)), play[2])))
        .when((play[0] == "genmove") & F.col("reply").isNotNull(), F.array(one(F.upper(F.substring(play[1], 1, 1)), F.col("reply"))))
        .when(play[0] == "set_free_handicap", F.transform(F.slice(play, 2, F.size(play)), lambda v: one(F.lit("B"), v)))
    )
    step = F.struct("done_at", F.coalesce(added, F.array().cast("array<struct<color:string,vertex:string>>")).alias("added"), (play[0] == "undo").alias("undo"))
    steps = games.filter("game > 0").groupBy("file", "game").agg(F.array_sort(F.collect_list(step)).alias("steps"))

    def apply(line: Column, s: Column) -> Column:
        shorter = F.slice(line, F.lit(1), F.greatest(F.size(line) - 1, F.lit(0)))
        return F.when(s["undo"], shorter).otherwise(F.concat(line, s["added"]))

    empty = F.array().cast("array<struct<color:string,vertex:string>>")
    return steps.select("file", "game", F.aggregate("steps", empty, apply).alias("moves"))


def read_archives(spark: SparkSession, root: str | list[str], suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """path, name, text of every record inside the zip archives below a folder; an archive that cannot be read has one row with ``error``."""
    files = _files(spark, root, (".zip",))

    def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        names = [n for n in sorted(archive.namelist()) if n.lower().endswith(suffixes)]
                        for n in names:  # one frame a record: an archive is never held unpacked as a whole
                            yield pd.DataFrame({"path": [path], "name": [n], "text": [archive.read(n).decode("latin-1")], "error": [None]})
                except (zipfile.BadZipFile, zlib.error, OSError) as error:
                    yield pd.DataFrame({"path": [path], "name": [None], "text": [None], "error": [str(error)]})

    return files.select("path", "content").mapInPandas(unpacked, "path string, name string, text string, error string")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """One row a game of match documents: JSON files with an array of games; a file without one has no rows."""
    schema = (
        "games array<struct<game_index:int,black_model:string,white_model:string,moves_played:int,ended_naturally:boolean,"
        "score:double,winner_color:string,winner_model:string,sgf_file:string>>"
    )
    documents = spark.read.schema(schema).option("multiLine", True).json(path)
    return documents.select(F.input_file_name().alias("file"), F.explode("games").alias("game")).select("file", "game.*")


def decided(results: DataFrame, leads: DataFrame, must_answer: bool = True) -> DataFrame:
    """Results with winners by a judge's lead (positive for Black), and whether that differs from the one stated.

    A game that the judge gave no lead fails when its row is read or, without must_answer, has nulls.
    """
    judged = results.join(leads, "sgf_file", "left")
    if must_answer:
        missing = F.raise_error(F.concat(F.lit("no answer for "), F.col("sgf_file"))).cast("double")
        judged = judged.withColumn("lead", F.coalesce("lead", missing))
    color = F.when(F.col("lead") > 0, "B").when(F.col("lead").isNotNull(), "W")
    model = F.when(color == "B", F.col("black_model")).when(color == "W", F.col("white_model"))
    return judged.withColumns({"judged_color": color, "judged_model": model, "flipped": color != F.col("winner_color")})


def write_decided(games: DataFrame, path: str) -> None:
    """One JSON line a game, with its lead to a tenth, the judge's winner and the recorded one; refuses to overwrite."""
    games.select(
        "game_index", "sgf_file", "black_model", "white_model", F.round("lead", 1).alias("black_lead"), F.col("judged_model").alias("winner_model"),
        F.col("score").alias("recorded_score"), F.col("winner_model").alias("recorded_winner_model"), "flipped",
    ).write.json(path, mode="errorifexists")


def write_split_shards(positions: DataFrame, path: str, features: list[str], size: int, rows_per_file: int = 4096) -> None:
    """Packed positions (split, game, packed, action) as Parquet folders by split, with the features and board size in each row's file."""
    described = positions.withColumns({"features": F.lit(",".join(features)), "size": F.lit(size)})
    described.write.partitionBy("split").option("maxRecordsPerFile", rows_per_file).parquet(path, mode="errorifexists")
    games = positions.groupBy("split", "game").agg(F.count("*").alias("positions"))
    games.write.option("sep", "\t").option("header", True).csv(f"{path}_games", mode="errorifexists")


def read_split_shards(spark: SparkSession, path: str, split: str) -> DataFrame:
    """The rows of one split, after a check that all its files agree on features and board size, and that there are any."""
    rows = spark.read.parquet(path).filter(F.col("split") == split)
    kinds = rows.select("features", "size").distinct().limit(2).collect()
    if len(kinds) != 1:
        raise ValueError(f"{path}: no shards of {split}" if not kinds else f"{path}: features or board size differ")
    return rows
