"""Removal of repeated passages by line hashing.

A text is cut into units that together are the whole text: a unit ends with a run of line ends or sentence marks, so
each line and each sentence of a longer line is one. A unit is normalised (ASCII letters in lower case, white space
to single blanks, none at the ends); units of at least ``least_words`` words are hashed to 128 bits and grouped over
the whole corpus. The first occurrence by (identifier, place) stays, and all others are marked for removal with their
original character offsets. A passage that several texts share is a row of such units.

The grouping aggregates per digest before the shuffle, so a line that a third of all texts share is a handful of rows.
Digests with more than ``HOT_SHARE`` of all occurrences, of which there are fewer than 1 / HOT_SHARE, come back to
their occurrences by a broadcast; the others by a join in which no key is larger than that share.

Cases: null and empty texts have no units. A unit repeated inside one text stays once there. Occurrences are those of
rows, not of identifiers: of two identical rows one keeps its units and the other loses them, and rows that share an
identifier are ranked by place, start and end, then by row. Null identifiers rank last. A text of any length is cut
whole, in one call. Further columns never matter, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kifu_spark.llm.skew import HOT_SHARE, join_counted
from kifu_spark.session import expect_long_texts, stored

LEAST_WORDS = 5
#: Unit pattern; every character of a text is in exactly one unit. Python and RE2 read it alike.
UNIT = r"[^\n.!?]*[\n.!?]+|[^\n.!?]+"
_UNIT = re.compile(UNIT)
_UPPER = bytes(range(65, 91))
_LOWERED = bytes.maketrans(_UPPER, _UPPER.lower())


def units_of(text: str | None, least_words: int = LEAST_WORDS) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(place, start, end, words, digest) of the units that have enough words."""
    for place, found in enumerate(_UNIT.finditer(text or "")):
        words = found.group().encode("utf-8", "surrogatepass").translate(_LOWERED).split()
        if len(words) >= least_words:
            yield place, found.start(), found.end(), len(words), xxhash.xxh3_128_digest(b" ".join(words))


def _listed(rows: DataFrame, least_words: int) -> DataFrame:
    """The units of rows (doc_id, text, row)."""

    @F.pandas_udf("array<struct<unit:int,start:long,end:long,words:int,digest:binary>>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[dict(zip(("unit", "start", "end", "words", "digest"), u)) for u in units_of(t, least_words)] for t in texts])

    listed = rows.select("doc_id", "row", of(F.col("text")).alias("all"))
    return listed.select("doc_id", "row", F.explode("all").alias("one")).select("doc_id", "row", "one.*")


def _repeated(rows: DataFrame, least_words: int, hot_share: float = HOT_SHARE) -> DataFrame:
    """The occurrences to remove, with their row, of rows (doc_id, text, row)."""
    found = stored(_listed(rows, least_words))  # the numbers of rows are fixed from here on
    place = ("doc_id", "unit", "start", "end", "row")
    groups = found.groupBy("digest").agg(
        F.count("*").alias("copies"), F.min(F.struct(F.col("doc_id").isNull().alias("last"), *place)).alias("keep")
    )
    groups = stored(groups.filter("copies > 1"))
    both = join_counted(found, groups, "digest", found.count(), hot_share=hot_share)
    return both.filter(~((F.col("row") == F.col("keep.row")) & (F.col("unit") == F.col("keep.unit"))))


def repeated_units(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, hot_share: float = HOT_SHARE
) -> DataFrame:
    """doc_id, unit, start, end, words, copies, keep_doc_id, keep_unit: one row for each occurrence to remove."""
    expect_long_texts(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    return _repeated(rows, least_words, hot_share).select(
        "doc_id", "unit", "start", "end", "words", "copies", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.unit").alias("keep_unit")
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """docs with the repeated units cut out of the texts, each row's own."""
    expect_long_texts(docs.sparkSession)
    # the rows are written once, so that both sides of the join number them alike
    numbered = stored(docs.select(F.struct("*").alias("whole"), F.monotonically_increasing_id().alias("row")))
    rows = numbered.select(F.col("whole").getField(id_col).alias("doc_id"), F.col("whole").getField(text_col).alias("text"), "row")
    spans = _repeated(rows, least_words).groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))

    @F.pandas_udf("string")
    def cut_out(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, cuts in zip(texts, spans):
            if text is not None and cuts is not None:
                edges = [0, *(e for c in cuts for e in (c["start"], c["end"])), len(text)]
                text = "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
            out.append(text)
        return pd.Series(out, dtype=object)

    joined = numbered.join(spans, "row", "left").select("whole", cut_out(F.col("whole").getField(text_col), F.col("spans")).alias("left"))
    return joined.select(*[F.col("left").alias(c) if c == text_col else F.col("whole").getField(c).alias(c) for c in docs.columns])
