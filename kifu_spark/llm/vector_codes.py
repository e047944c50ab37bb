"""Vector code compression: product codes from exact codebooks, found by equal-average search.

Components become integers floor(scale * x) and a vector is cut into equal consecutive parts. Every part position has a
codebook that starts as that part of the vectors with the smallest identifiers; each round assigns every part to its
nearest entry and replaces each entry by the componentwise floor of its parts' mean. Ties go to the lower index, and an
entry without parts stays.

Equal-average search: the squared distance of two parts of d components is at least the square of the difference of
their component sums, over d. Entries are sorted by their sum. Parts, in blocks of near sums, start at their place in
that order and look outwards on both sides, in steps of a few entries; a part leaves a side when the squared gap to the
side's next sum, over d, strictly exceeds its best distance, so that no nearer entry and no tie is ever missed.

A round is one pass over the stored vectors. The driver holds the codebooks and their sums, ``entries`` vectors for each
length that occurs; sums are exact integers added up in Spark, so a lost executor costs a repeated task.

Cases: vectors that are null or hold a null or a non-finite component take no part and are not returned. Vectors of
different lengths have codebooks of their own. A vector whose length is no multiple of the parts cannot be cut: it is
returned with null code and error. Empty vectors have four empty parts, each equal to entry 0. Every row is a vector of
its own, also where identifiers repeat (then smaller components come first); null identifiers come last. With fewer
vectors than entries the codebooks are smaller. An empty table gives an empty result. Components of any finite size are
exact; errors above the range of a long are null. Null labels are one label. Further columns never matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from kifu_spark.llm.integers import DIGITS_SCHEMA, MOST_LONG, as_longs, as_numbers, by_length, digits, floors, is_finite, summed
from kifu_spark.llm.skew import join_counted
from kifu_spark.session import stored

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
BLOCK, STEP = 1024, 16

#: Codebooks of one length: by part and entry, integer components.
Books = list[list[list[int]]]


@dataclass(frozen=True)
class SortedBook:
    """Entries in the order of their sums."""

    sums: np.ndarray
    entries: np.ndarray
    squares: np.ndarray
    order: np.ndarray

    @classmethod
    def of(cls, book: list[list[int]], size: int) -> SortedBook:
        numbers = as_numbers(book, size)
        sums = numbers.sum(axis=1)
        order = np.argsort(sums, kind="stable")
        return cls(sums[order], numbers[order], (numbers * numbers).sum(axis=1)[order], order)


def nearest_entries(parts: np.ndarray, book: SortedBook) -> tuple[np.ndarray, np.ndarray, int]:
    """Index and exact squared distance of each part's nearest entry, and how many distances were computed."""
    kind = object if object in (parts.dtype, book.entries.dtype) else np.float64
    best, chosen = np.full(len(parts), np.inf, dtype=kind), np.full(len(parts), len(book.order))
    sums, own, dims, compared = parts.sum(axis=1), (parts * parts).sum(axis=1), max(parts.shape[1], 1), 0
    by_sum = np.argsort(sums, kind="stable")

    def look(rows: np.ndarray, low: int, high: int) -> None:
        nonlocal compared
        compared += len(rows) * (high - low)
        # products of ordinary integers stay exact, so this is the squared distance to the last digit
        found = own[rows, None] - 2 * (parts[rows] @ book.entries[low:high].T) + book.squares[low:high]
        least = found.min(axis=1)
        near = np.flatnonzero((least <= best[rows]).astype(bool))
        rows, least = rows[near], least[near]
        index = np.where(found[near] == least[:, None], book.order[low:high], len(book.order)).min(axis=1)
        better = ((least < best[rows]) | (index < chosen[rows])).astype(bool)
        best[rows[better]], chosen[rows[better]] = least[better], index[better]

    for at in range(0, len(parts), BLOCK):
        rows = by_sum[at : at + BLOCK]
        low = high = int(np.searchsorted(book.sums, sums[rows[len(rows) // 2]]))
        up = down = rows
        while len(up) or len(down):
            if high < len(book.order) and len(up):
                gap = np.maximum(book.sums[high] - sums[up], 0)
                up = up[(gap * gap <= dims * best[up]).astype(bool)]
            else:
                up = rows[:0]
            if len(up):
                look(up, high, min(high + STEP, len(book.order)))
                high += STEP
            if low > 0 and len(down):
                gap = np.maximum(sums[down] - book.sums[low - 1], 0)
                down = down[(gap * gap <= dims * best[down]).astype(bool)]
            else:
                down = rows[:0]
            if len(down):
                look(down, max(low - STEP, 0), low)
                low -= STEP
    return chosen, best, compared


def _assigned(batch: pa.RecordBatch, books: dict[int, Books], sorted_books: dict[int, list[SortedBook]], scale: int) -> Iterator[tuple]:
    """Length, row numbers, integer parts, and by part the chosen entries and distances, where there are codebooks."""
    for size, rows, vectors in by_length(batch["vec"]):
        if size in books:
            known = sorted_books[size]
            for at, numbers in floors(vectors, scale, all(b.entries.dtype != object for b in known)):
                parts = numbers.reshape(len(at), len(known), -1) if size else numbers.reshape(len(at), len(known), 0)
                yield size, rows[at], parts, [nearest_entries(parts[:, p], book)[:2] for p, book in enumerate(known)]


def _sorted(books: dict[int, Books]) -> dict[int, list[SortedBook]]:
    return {size: [SortedBook.of(book, size // len(found)) for book in found] for size, found in books.items()}


def _sums(books: dict[int, Books], scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _sorted(books)
        totals = {s: np.zeros((len(b), len(b[0]), s // len(b) + 1), dtype=object) for s, b in books.items()}  # the last column counts
        for batch in batches:
            for size, _, parts, found in _assigned(batch, books, known, scale):
                whole = parts.astype(np.int64) if parts.dtype != object else parts
                for p, (chosen, _) in enumerate(found):
                    here = np.zeros(totals[size][p].shape, dtype=whole.dtype)
                    np.add.at(here[:, :-1], chosen, whole[:, p])
                    np.add.at(here[:, -1], chosen, 1)
                    totals[size][p] += here.astype(object)
        for size, total in totals.items():
            yield digits(size, total.ravel())

    return run


def _codes(books: dict[int, Books], scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _sorted(books)
        for batch in batches:
            codes, errors = [None] * batch.num_rows, np.full(batch.num_rows, -1, dtype=object)
            for _, rows, _, found in _assigned(batch, books, known, scale):
                indexes = np.stack([chosen for chosen, _ in found], axis=1).astype(np.uint8)
                for row, code in zip(rows.tolist(), indexes):
                    codes[row] = code.tobytes()
                errors[rows] = sum(best for _, best in found).astype(object)
            error = as_longs(np.where(errors < 0, np.inf, errors))
            sizes = batch["vec"].value_lengths()
            yield pa.record_batch([batch["id"], batch["label"], sizes, pa.array(codes, pa.binary()), error], ["id", "label", "size", "code", "error"])

    return run


@dataclass(frozen=True)
class Codes:
    """Coded vectors (id, label, size, code of one byte a part, error) and the codebooks by length."""

    coded: DataFrame
    books: dict[int, Books]


def fit_codebooks(placed: DataFrame, scale: int, parts: int, entries: int, rounds: int) -> dict[int, Books]:
    """Codebooks for each length among the rows (id, vec) that the parts divide."""
    sized = placed.withColumn("size", F.size("vec")).filter(F.col("size") % parts == 0)
    by_id = Window.partitionBy("size").orderBy(F.col("id").asc_nulls_last(), "vec")
    first = sized.withColumn("nth", F.row_number().over(by_id)).filter(F.col("nth") <= entries)
    books: dict[int, Books] = {}
    for row in first.select("size", "nth", "vec").orderBy("size", "nth").collect():  # at most ``entries`` rows a length
        whole = [int(x) for _, numbers in floors(np.array([row.vec], dtype=np.float64).reshape(1, -1), scale) for x in numbers[0]]
        width = row["size"] // parts
        for p, book in enumerate(books.setdefault(row["size"], [[] for _ in range(parts)])):
            book.append(whole[p * width : (p + 1) * width])
    for _ in range(rounds if books else 0):
        totals = summed(placed.mapInArrow(_sums(books, scale), DIGITS_SCHEMA))
        for size, found in books.items():
            cells, width, many = totals.get(size, {}), size // parts, len(found[0])
            for p, book in enumerate(found):
                for e in range(many):
                    at = (p * many + e) * (width + 1)
                    if count := cells.get(at + width, 0):
                        book[e] = [cells.get(at + i, 0) // count for i in range(width)]
    return books


def code_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str | None = None,
    scale: int = SCALE,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> Codes:
    """Fit codebooks to the vectors and code each of them; at most 256 entries, as a code has one byte a part."""
    label = F.col(label_col) if label_col else F.lit(None).cast("string")
    kept = vectors.select(F.col(id_col).alias("id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("vec"))
    placed = stored(kept.filter(is_finite(F.col("vec"))))
    books = fit_codebooks(placed, scale, parts, entries, rounds)
    out = StructType([placed.schema["id"], placed.schema["label"], *StructType.fromDDL("size int, code binary, error long").fields])
    return Codes(placed.mapInArrow(_codes(books, scale), out), books)


def decoded(codes: Codes, scale: int = SCALE) -> DataFrame:
    """id and the vector that each code stands for: the middle of the cells its entries name."""
    books = codes.books

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [
                None if code is None else [(x + 0.5) / scale for p, e in enumerate(code) for x in books[size][p][e]]
                for code, size in zip(batch["code"].to_pylist(), batch["size"].to_pylist())
            ]
            yield pa.record_batch([batch["id"], pa.array(vectors, pa.list_(pa.float64()))], ["id", "vec"])

    return codes.coded.mapInArrow(run, StructType([codes.coded.schema["id"], StructField("vec", ArrayType(DoubleType()))]))


def with_label_error(found: Codes, id_col: str = "vec_id") -> DataFrame:
    """id, code in hex, error, label_error, codebooks_sha256 (of the codebooks for the vector's length)."""
    label = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null"))
    coded = stored(found.coded.select("id", label.alias("label"), "code", "error", "size"))
    sums = coded.groupBy("label").agg(
        F.count("*").alias("copies"),
        F.sum(F.col("error").cast("decimal(19,0)")).alias("total"),
        F.count_if(F.col("code").isNotNull() & F.col("error").isNull()).alias("beyond"),
    )
    total = F.when((F.col("beyond") == 0) & (F.col("total") <= MOST_LONG), F.col("total").cast("long"))
    rows = coded.count()
    joined = join_counted(coded, sums.select("label", "copies", total.alias("label_error")), "label", rows)
    digest = lambda books: hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    digests = [(size, digest(books)) for size, books in found.books.items()]
    report = coded.sparkSession.createDataFrame(digests, "size int, codebooks_sha256 string")  # a row for each length
    return joined.join(F.broadcast(report), "size", "left").select(
        F.col("id").alias(id_col), F.lower(F.hex("code")).alias("code"), "error", "label_error", "codebooks_sha256"
    )
