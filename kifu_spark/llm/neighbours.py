"""Approximate nearest neighbours by cosine over several shifted Hilbert orderings.

Each curve projects unit vectors to a few seeded orthogonal directions, shifts them by a seeded offset, and orders them
along a Hilbert curve. Every vector gets its exact rank on each curve, ranges of about equal counts follow from the
ranks, and a query looks at the ranges that hold the ``window`` of ranks around its own (moved inwards at the ends).
Inside a range vectors are one byte a component; the best of all curves are merged and ranked anew by the exact
cosine, in double precision, of the original vectors.

How wide a window must be is a property of the vectors. Where all directions carry the same variance no ordering tells
much about nearness, and a recall of 0.9 takes about nine tenths of a scan; the defaults are set for that case. With
vectors that lie near a few dimensions, much narrower windows or fewer curves do.

Equal vectors are searched once: they are represented by their smallest identifier and their k + 1 smallest, kept by a
limit that acts before the shuffle, so that a vector that many rows share costs no more than any other. Its queries
all get the same list, each without its own row. Ranks come from windows over slices of a curve of at most about
``SLICE_ROWS`` rows, with running sums over the slices. Queries of a range meet it in chunks, so a task holds one
range and one chunk, both of bounded size.

Cases: vectors that are null, empty, zero, or hold a null or a non-finite component take no part. Vectors of another
length than the query's are never candidates; each length has orderings of its own. Ties go to the smaller identifier.
Repeated rows (same identifier and vector) are one row. A window holds at least ``LEAST_WINDOW`` vectors, so that with
no more of them than that all candidates are found, and with fewer than k all are returned. Very long vectors are
searched like others, and so are components of any finite size, the smallest included. Further columns never matter, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kifu_spark.llm.hilbert import hilbert_keys
from kifu_spark.session import cut, stored

CURVES = 24
WINDOW, LEAST_WINDOW = 0.03, 256
DIMENSIONS, BITS = 8, 5
LEAST_RANGE, MOST_RANGE = 64, 4096
SLICE_ROWS = 1 << 16
QUERY_CHUNK = 4096
SEED = 11


def curve_keys(vectors: np.ndarray, curves: int, seed: int = SEED) -> np.ndarray:
    """Key of each unit vector (rows, all of one length) on each curve."""
    size = vectors.shape[1]
    dims = min(DIMENSIONS, size)
    keys = np.empty((len(vectors), curves), dtype=np.int64)
    for curve in range(curves):
        rng = np.random.default_rng([seed, curve, size])
        directions = np.linalg.qr(rng.standard_normal((size, dims)))[0]
        # unit vectors of no preferred direction have coordinates of deviation 1 / sqrt(size): two deviations either way
        placed = (vectors @ directions * np.sqrt(size) + 2 + rng.random(dims)) / 5
        cells = (np.clip(placed, 0, 1 - 1e-9) * (1 << BITS)).astype(np.int64)
        keys[:, curve] = hilbert_keys(cells, BITS)
    return keys


def codes(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors as one byte a component, after four bytes of the vector's own scale."""
    scale = (np.abs(vectors).max(axis=1, keepdims=True) / 127).astype("<f4")
    return np.hstack([scale.view(np.uint8), np.rint(vectors / scale).astype(np.int8).view(np.uint8)])


def decoded(found: pa.ChunkedArray) -> np.ndarray:
    """The vectors of codes, all of one length."""
    table = np.frombuffer(b"".join(found.to_pylist()), np.uint8).reshape(len(found), -1)
    return np.ascontiguousarray(table[:, 4:]).view(np.int8).astype(np.float32) * np.ascontiguousarray(table[:, :4]).view("<f4")


def _coded_column(vec: Column, curves: int, seed: int) -> Column:
    @F.pandas_udf("keys array<long>, code binary")
    def of(vectors: pd.Series) -> pd.DataFrame:
        keys, code = [None] * len(vectors), [None] * len(vectors)
        for size, rows in vectors.groupby(vectors.map(len)).groups.items():
            at = vectors.index.get_indexer(rows)
            units = np.array(vectors.iloc[at].tolist(), dtype=np.float64).reshape(-1, size)
            units = units / np.abs(units).max(axis=1, keepdims=True)  # so that no norm overflows
            units = units / np.linalg.norm(units, axis=1, keepdims=True)
            for i, key, one in zip(at, curve_keys(units, curves, seed), codes(units)):
                keys[i], code[i] = key, one.tobytes()
        return pd.DataFrame({"keys": keys, "code": code})

    return of(vec)


def _slice_column(size: Column, keys: Column, splitters: dict[int, list[list[int]]]) -> Column:
    """Of each curve's key, the number of splitters of that length at or below it; none where a length has no splitters."""

    @F.pandas_udf("array<int>")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        edges = {n: [np.array(s, dtype=np.int64) for s in found] for n, found in splitters.items()}
        for sizes, series in batches:
            yield pd.Series(
                [
                    np.array([e.searchsorted(k, side="right") for e, k in zip(edges[n], key)] if n in edges else [0] * len(key), np.int32)
                    for n, key in zip(sizes, series)
                ]
            )

    return of(size, keys)


def ranked(keyed: DataFrame, curves: int) -> DataFrame:
    """size, curve, rep, code, asked, rank (from 0) and total, for each vector on each curve."""
    by_size = keyed.groupBy("size").count().filter(F.col("count") > SLICE_ROWS)
    splitters = {}
    for size, count in by_size.collect():  # lengths of more than SLICE_ROWS vectors only
        slices = min(4096, -(-count // SLICE_ROWS))
        parts = [i / slices for i in range(1, slices)]
        cuts = [F.percentile_approx(F.element_at("keys", c + 1), parts, 100 * slices) for c in range(curves)]
        splitters[size] = [list(s) for s in keyed.filter(F.col("size") == size).agg(*cuts).first()]
    sliced = keyed.withColumn("both", F.arrays_zip("keys", _slice_column(F.col("size"), F.col("keys"), splitters).alias("slices")))
    dealt = sliced.select("size", "rep", "code", "asked", F.posexplode("both").alias("curve", "one")).select(
        "size", "rep", "code", "asked", "curve", F.col("one.keys").alias("key"), F.col("one.slices").alias("slice")
    )
    one_slice = Window.partitionBy("size", "curve", "slice")
    line = Window.partitionBy("size", "curve")
    cells = (
        dealt.groupBy("size", "curve", "slice")
        .agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(line.orderBy("slice")) - F.col("n"))
        .withColumn("total", F.sum("n").over(line))
        .drop("n")
    )
    numbered = dealt.withColumn("nth", F.row_number().over(one_slice.orderBy("key", "rep")))
    return numbered.join(cells, ["size", "curve", "slice"]).select(
        "size", "curve", "rep", "code", "asked", (F.col("before") + F.col("nth") - 1).alias("rank"), "total"
    )


def _best(data: pa.Table, asked: pa.Table, count: int) -> pa.Table:
    """The best candidates of one range for one chunk of queries, by their codes."""
    queries, reps, nears = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
    if len(data) and len(asked):
        x, q, ids, mine = decoded(data["code"]), decoded(asked["code"]), data["rep"].to_numpy(), asked["rep"].to_numpy()
        some = min(count, len(ids))
        for at in range(0, len(q), 512):
            scores = q[at : at + 512] @ x.T
            near = np.argpartition(scores, -some, axis=1)[:, -some:]
            queries.append(np.repeat(mine[at : at + 512], some))
            reps.append(ids[near].ravel())
            nears.append(np.take_along_axis(scores, near, 1).ravel().astype(np.float64))
    return pa.table({"query": np.concatenate(queries), "rep": np.concatenate(reps), "near": np.concatenate(nears)})


def _scaled(vec: Column) -> Column:
    """vec, or where squares of its components could leave the range of a double, vec over its largest component."""
    top = F.array_max(F.transform(vec, lambda x: F.abs(x)))
    return F.when(top.between(1e-100, 1e100), vec).otherwise(F.transform(vec, lambda x: x / top))


def _cosine(a: Column, b: Column) -> Column:
    """The cosine of two scaled vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 5,
    curves: int = CURVES,
    window: float = WINDOW,
    least_window: int = LEAST_WINDOW,
    seed: int = SEED,
) -> DataFrame:
    """query_id, rank, vec_id, score: for the rows where is_query (over column vec_id) holds, against all rows."""
    clean = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec")).filter(
        F.col("vec_id").isNotNull()
        & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vec", lambda x: x != 0)
    )
    least_ids = Window.partitionBy("vec").orderBy("vec_id")
    few = clean.distinct().withColumn("nth", F.row_number().over(least_ids)).filter(F.col("nth") <= k + 1)
    reps = few.groupBy("vec").agg(F.min("vec_id").alias("rep"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    queries = clean.filter(is_query).select(F.col("vec_id").alias("query_id"), "vec").distinct()
    asked = queries.select("vec", F.lit(True).alias("asked")).distinct()
    coded = reps.join(asked, "vec", "left").withColumn("coded", _coded_column(F.col("vec"), curves, seed))
    keyed = cut(coded.select("rep", "ids", "vec", F.size("vec").alias("size"), F.col("asked").isNotNull().alias("asked"), "coded.keys", "coded.code"))

    wide = F.least(F.col("total"), F.greatest(F.lit(least_window), F.ceil(F.col("total") * window)))
    rows = F.least(F.lit(MOST_RANGE), F.greatest(F.lit(LEAST_RANGE), F.floor(wide / 4)))
    placed = stored(ranked(keyed, curves).withColumns({"wide": wide, "rows": rows}))
    range_of = lambda rank: F.floor(rank / F.col("rows")).cast("int")
    low = F.greatest(F.lit(0), F.least(F.col("total") - F.col("wide"), F.col("rank") - F.floor(F.col("wide") / 2)))
    sought = placed.filter("asked").select(
        "size", "curve", "rep", "code", F.explode(F.sequence(range_of(low), range_of(low + F.col("wide") - 1))).alias("range")
    )
    by_range = ["size", "curve", "range"]
    chunks = sought.groupBy(*by_range).agg(F.ceil(F.count("*") / QUERY_CHUNK).cast("int").alias("chunks"))
    dealt = placed.select("size", "curve", range_of(F.col("rank")).alias("range"), "rep", "code").join(chunks, by_range)
    held = dealt.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    sent = sought.join(chunks, by_range).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")).drop("chunks")
    by, most = [*by_range, "chunk"], 4 * (k + 1)
    columns = [*by, "rep", "code"]
    sent = sent.select(*[F.col(c).alias(c) for c in columns])  # names of its own, for the cogroup
    found = (
        held.groupBy(*by)
        .cogroup(sent.groupBy(*by))
        .applyInArrow(lambda a, b: _best(a, b, most), "query long, rep long, near double")
        .groupBy("query", "rep")
        .agg(F.max("near").alias("near"))
    )
    short = Window.partitionBy("query").orderBy(F.desc("near"), "rep")
    candidates = found.withColumn("nth", F.row_number().over(short)).filter(F.col("nth") <= most).select("query", "rep")
    scored = (
        candidates.join(keyed.select("rep", "ids", _scaled(F.col("vec")).alias("theirs")), "rep")
        .join(keyed.filter("asked").select(F.col("rep").alias("query"), _scaled(F.col("vec")).alias("own")), "query")
        .select("query", "rep", "ids", _cosine(F.col("own"), F.col("theirs")).alias("score"))
    )
    best = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    top = scored.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k + 1)
    listed = (
        top.select("query", F.explode("ids").alias("vec_id"), "score")
        .groupBy("query")
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id"))).alias("list"))
    )  # at most (k + 1) squared entries each
    return (
        queries.join(keyed.select("vec", F.col("rep").alias("query")), "vec")
        .join(listed, "query")
        .select("query_id", F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("list"))
        .select("query_id", F.posexplode("list").alias("at", "one"))
        .select("query_id", (F.col("at") + 1).alias("rank"), F.col("one.vec_id").alias("vec_id"), (-F.col("one.less")).alias("score"))
    )
