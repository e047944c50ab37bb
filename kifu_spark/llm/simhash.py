"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits; a bit is 1 where more than half of the hashes of the text's word shingles have it.
For a radius r, every bit position gets a nonzero vector of r + 1 bits, and each of the 2^(r+1) - 1 nonzero vectors is
a table: its mask keeps the positions whose vector has an odd product with it. Two fingerprints within r bits differ
in at most r positions, whose vectors leave a nonzero vector orthogonal to all of them, so that table's mask hides
every difference: the pair is sure to share a bucket.

Inside a bucket no pairs are listed, however large it is. Members differ only in hidden bits, so each member of a
bucket with two or more emits itself with at most ``r // 2`` hidden bits flipped (and, for an odd r, the far side with
one more): two members are within r bits exactly if they share such a point. Members at one point number at most one
more than the hidden bits, and each is linked to the smallest. Work is linear in the members of the buckets, all links
are exact, and components over them are those of the full graph.

Copies never multiply: tables hold distinct fingerprints, made by a pre-aggregated minimum identifier, and prints with
many copies get their component by a broadcast.

Cases: null and empty texts, and texts of white space, have fingerprint zero and link like any other. Repeated rows
share a fingerprint. A null identifier gets a component by its fingerprint's links, and is never the smallest unless
all are null. Rows that share an identifier are rows of their own, with their own texts. A text of any length is read
whole; its shingles are counted in blocks of bounded size. Further columns never matter, whatever their names. An empty
table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from kifu_spark.llm.components import components
from kifu_spark.llm.skew import join_counted
from kifu_spark.session import cut, expect_long_texts, stored

BITS = 64
RADIUS = 2
SHINGLE = 3
SEED = 42
_UPPER = bytes(range(65, 91))
_LOWERED = bytes.maketrans(_UPPER, _UPPER.lower())


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWERED).split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(gram, seed) for gram in grams], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65536):  # a bit matrix of bounded size, however long the text
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, shingle: int = SHINGLE, seed: int = SEED) -> Column:
    """The fingerprint's bits as a long."""

    @F.pandas_udf(LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle, seed) for t in texts], dtype=np.uint64).view(np.int64))

    return of(text)


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The masks of the 2^(radius+1) - 1 tables."""
    vectors = 2 ** (radius + 1) - 1
    return [
        sum(1 << i for i in range(bits) if ((i % vectors + 1) & table).bit_count() % 2) for table in range(1, vectors + 1)
    ]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _flips(hidden: int, most: int) -> list[int]:
    """All patterns of at most so many hidden bits."""
    places = [1 << i for i in range(BITS) if hidden >> i & 1]
    return [_signed(sum(c)) for k in range(most + 1) for c in combinations(places, k)]


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) of distinct fingerprints (column ``fp``): each at most radius bits apart, with the full graph's components."""
    masks = covering_masks(radius)
    table_of = F.posexplode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("table", "mask")
    bucketed = prints.select("fp", table_of).select("fp", "table", F.col("fp").bitwiseAND(F.col("mask")).alias("bucket"))
    shared = bucketed.groupBy("table", "bucket").agg(F.count("*").alias("members")).filter("members > 1").drop("members")
    members = bucketed.join(shared, ["table", "bucket"])
    full = (1 << BITS) - 1
    near, far = radius // 2, radius - radius // 2
    lists = lambda most: F.element_at(
        F.array(*[F.array(*[F.lit(x) for x in _flips(full & ~m, most)]) for m in masks]), F.col("table") + 1
    )
    at = members.select("fp", F.explode(lists(near)).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    if far == near:
        hub = at.groupBy("point").agg(F.min("fp").alias("least"), F.count("*").alias("members")).filter("members > 1")
        return at.join(hub, "point").filter("fp != least").select(F.col("fp").alias("u"), F.col("least").alias("v")).distinct()
    # an odd radius: a point within near bits of one and far bits of the other
    other = members.select("fp", F.explode(lists(far)).alias("flip")).select(
        F.col("fp").alias("fp2"), F.col("fp").bitwiseXOR(F.col("flip")).alias("point")
    )
    return at.join(other, "point").filter("fp < fp2").select(F.col("fp2").alias("u"), F.col("fp").alias("v")).distinct()


def _grouped(rows: DataFrame, radius: int, shingle: int, seed: int) -> DataFrame:
    """fp, component_id, group_fp beside the columns of rows (doc_id, text and others), without the text."""
    expect_long_texts(rows.sparkSession)
    printed = cut(rows.withColumn("fp", fingerprint_column(F.col("text"), shingle, seed)).drop("text"))
    firsts = cut(printed.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")))
    rooted = components(links(firsts.select("fp"), radius))
    linked = firsts.join(rooted, F.col("fp") == F.col("node"))
    least = cut(linked.groupBy("root").agg(F.min("first_id").alias("least_id"), F.count("*").alias("prints")))
    named = join_counted(linked, least, "root", linked.count(), "prints").select(F.col("fp").alias("linked_fp"), "least_id", "root")
    by_print = stored(
        firsts.join(named, F.col("fp") == F.col("linked_fp"), "left").select(
            "fp", "copies", F.coalesce("least_id", "first_id").alias("component_id"), F.coalesce("root", "fp").alias("group_fp")
        )
    )
    return join_counted(printed, by_print, "fp", printed.count()).drop("copies")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = RADIUS,
    shingle: int = SHINGLE,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, fp, fingerprint, component_id (smallest identifier reachable over links), group_fp (its smallest print) for every row."""
    found = _grouped(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), radius, shingle, seed)
    return found.select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group_fp")


def keep_one_of_each(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = RADIUS,
    shingle: int = SHINGLE,
    seed: int = SEED,
) -> DataFrame:
    """The rows of docs that stay, one of each component.

    It is the row of the smallest identifier (a null one last), then of the smallest fingerprint, then of the smallest
    hash over all columns but maps; rows that are equal in all of these are one. Rows of different components both
    stay, whether they share an identifier or not.
    """
    hashed = F.xxhash64(*[F.col(f"`{name}`") for name, kind in docs.dtypes if "map<" not in kind])
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), hashed.alias("row"))
    found = _grouped(rows, radius, shingle, seed)
    one = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "fp", "row"))
    chosen = found.groupBy("group_fp").agg(one.alias("one")).select("one.doc_id", "one.row")
    times = found.groupBy("doc_id", "row").agg(F.count("*").alias("times")).filter("times > 1")
    same = F.col("chosen.doc_id").eqNullSafe(F.col("times.doc_id")) & (F.col("chosen.row") == F.col("times.row"))
    marked = chosen.alias("chosen").join(times.alias("times"), same, "left").select(
        F.col("chosen.doc_id").alias("__id"), F.col("chosen.row").alias("__row"), F.col("times").isNotNull().alias("__repeated")
    )
    marked = stored(marked.distinct())
    whole = docs.select(F.struct("*").alias("whole"), F.col(id_col).alias("doc_id"), hashed.alias("row"))
    kept = whole.join(marked, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("row") == F.col("__row")))
    # only equal rows still come more than once, and only those are gathered by their key
    alone = kept.filter(~F.col("__repeated")).select("whole")
    repeated = kept.filter("__repeated").dropDuplicates(["doc_id", "row"]).select("whole")
    return alone.unionByName(repeated).select(*[F.col("whole").getField(name).alias(name) for name in docs.columns])
