"""Grids, distributions, candidate sets and tolerances over array columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kifu_spark.operators.grids import COLUMN_LETTERS, SYMMETRIES, entropy, packed_bits, place_of_vertex, softmax, source_index, turned, turned_place, vertex
from kifu_spark.operators.planes import decode_planes, pack_planes, seeded_view
from kifu_spark.registry import query
from kifu_spark.sources.tables import table

SIZE = 8
VALUES = "list_transform(embedding, lambda x: x::DOUBLE)"


def _grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding's 64 values as an 8 x 8 board."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("grid"))


def _mapped_back(view: Column, symmetry: int) -> Column:
    """The board of which this is the turned view."""
    source = source_index(symmetry, SIZE)
    return F.transform(F.array(*[F.lit(source.index(p)) for p in range(SIZE * SIZE)]), lambda at: F.element_at(view, at + 1))


ROTATED = "list_transform(range(0, 64), lambda j: grid[(j % 8) * 8 + 7 - j // 8 + 1])"


@query(f"WITH g AS (SELECT vec_id, {VALUES} AS grid FROM embeddings) SELECT vec_id, round(list_sum(list_transform(range(0, 64), lambda j: (j + 1) * grid[(j % 8) * 8 + 7 - j // 8 + 1])), 6) AS checksum, round(grid[8], 6) AS corner FROM g")
def grid_symmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The board turned by a quarter, as a place-weighted checksum and its first corner."""
    spun = turned(F.col("grid"), 1, SIZE)
    weighted = F.aggregate(F.transform(spun, lambda x, j: x * (j + 1)), F.lit(0.0), lambda a, x: a + x)
    return _grids(spark, sf_dir).select("vec_id", F.round(weighted, 6).alias("checksum"), F.round(spun[0], 6).alias("corner"))


@query(f"WITH g AS (SELECT vec_id, {VALUES} AS grid FROM embeddings), t AS (SELECT vec_id, list_position(grid, list_max(grid)) - 1 AS place, grid FROM g) SELECT vec_id, place::INTEGER AS place, list_position({ROTATED}, list_max(grid))::INTEGER - 1 AS moved FROM t")
def symmetry_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top point and where it goes when the board is turned: label and board move together."""
    place = (F.array_position("grid", F.array_max("grid")) - 1).cast("int")
    return _grids(spark, sf_dir).withColumn("place", place).select("vec_id", "place", turned_place(F.col("place"), 1, SIZE).alias("moved"))


@query(f"WITH g AS (SELECT vec_id, {VALUES} AS grid FROM embeddings) SELECT vec_id, round(grid[1], 6) AS first, round(list_sum(grid) / 64, 6) AS mean, 8 AS views FROM g")
def view_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eight views mapped back and averaged: the mean over views is the board itself."""
    views = _grids(spark, sf_dir).select("vec_id", *[turned(F.col("grid"), k, SIZE).alias(f"view{k}") for k in range(SYMMETRIES)])
    mean = None
    for k in range(SYMMETRIES):
        back = _mapped_back(F.col(f"view{k}"), k)
        mean = back if mean is None else F.zip_with(mean, back, lambda a, b: a + b)
    mean = F.transform(mean, lambda x: x / SYMMETRIES)
    averaged = views.select("vec_id", mean.alias("mean_view"))
    total = F.aggregate("mean_view", F.lit(0.0), lambda a, x: a + x)
    return averaged.select("vec_id", F.round(F.col("mean_view")[0], 6).alias("first"), F.round(total / 64, 6).alias("mean"), F.lit(SYMMETRIES).alias("views"))


@query(
    f"""WITH g AS (SELECT vec_id, list_transform({VALUES}, lambda x: (x > 0)::INT) AS b FROM embeddings)
    SELECT vec_id, array_to_string(list_transform(range(0, 8), lambda k: printf('%02X', b[k*8+1]*128 + b[k*8+2]*64 + b[k*8+3]*32 + b[k*8+4]*16 + b[k*8+5]*8 + b[k*8+6]*4 + b[k*8+7]*2 + b[k*8+8])), '') AS packed FROM g"""
)
def bit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign bits packed to bytes, the first in the highest bit."""
    flags = F.transform("grid", lambda x: F.when(x > 0, 1).otherwise(0))
    return _grids(spark, sf_dir).select("vec_id", packed_bits(flags, SIZE * SIZE).alias("packed"))


@query(
    f"""WITH g AS (SELECT vec_id, list_position({VALUES}, list_max({VALUES})) - 1 AS place FROM embeddings)
    SELECT vec_id, place::INTEGER AS place, substr('{COLUMN_LETTERS}', (place % 8 + 1)::INTEGER, 1) || (8 - place // 8) AS vertex, place::INTEGER AS back FROM g"""
)
def vertex_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top point's name, and the place read back from the name."""
    place = (F.array_position("grid", F.array_max("grid")) - 1).cast("int")
    named = _grids(spark, sf_dir).select("vec_id", place.alias("place")).withColumn("vertex", vertex(F.col("place"), SIZE))
    return named.withColumn("back", place_of_vertex(F.col("vertex"), SIZE).cast("int"))


@query(
    f"""WITH RECURSIVE c AS (SELECT vec_id, unnest(range(0, 64)) AS p, unnest(list_transform({VALUES}, lambda x: x > 0)) AS s FROM embeddings WHERE vec_id < 1000000),
    e AS (SELECT a.vec_id, a.p AS p, b.p AS q FROM c a JOIN c b ON a.vec_id = b.vec_id AND a.s = b.s AND ((b.p = a.p + 1 AND a.p % 8 < 7) OR (b.p = a.p - 1 AND a.p % 8 > 0) OR b.p = a.p + 8 OR b.p = a.p - 8)),
    r AS (SELECT vec_id, p, p AS root FROM c UNION SELECT e.vec_id, e.q, r.root FROM r JOIN e ON e.vec_id = r.vec_id AND e.p = r.p WHERE e.q > r.root),
    m AS (SELECT vec_id, p, min(root) AS root FROM r GROUP BY ALL), z AS (SELECT m.vec_id, m.root, s, count(*) AS n FROM m JOIN c ON c.vec_id = m.vec_id AND c.p = m.p GROUP BY ALL)
    SELECT vec_id, count(*) AS regions, count(*) FILTER (s) AS positive, max(n) AS largest FROM z GROUP BY ALL"""
)
def grid_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected regions of equal sign on the board, by flood fill over a batch of boards at a time."""

    @F.pandas_udf("regions long, positive long, largest long")
    def census(grids: pd.Series) -> pd.DataFrame:
        return regions_of(np.array(grids.tolist(), dtype=float).reshape(-1, SIZE, SIZE) > 0)

    return _grids(spark, sf_dir).select("vec_id", census("grid").alias("c")).select("vec_id", "c.*")


def regions_of(signs: np.ndarray) -> pd.DataFrame:
    """Region counts and the largest size of boards (n x size x size booleans): roots spread to equal neighbours until settled."""
    n, size = len(signs), signs.shape[1]
    root = np.broadcast_to(np.arange(size * size).reshape(size, size), signs.shape).copy()
    while True:
        before = root.copy()
        for axis in (1, 2):
            lower, upper = [slice(None)] * 3, [slice(None)] * 3
            lower[axis], upper[axis] = slice(0, -1), slice(1, None)
            lower, upper = tuple(lower), tuple(upper)
            same = signs[lower] == signs[upper]
            least = np.where(same, np.minimum(root[lower], root[upper]), root[lower])
            root[lower] = least
            root[upper] = np.where(same, np.minimum(least, root[upper]), root[upper])
        if (root == before).all():
            break
    flat, at = root.reshape(n, size * size), np.arange(size * size)
    is_root = flat == at
    sizes = np.zeros((n, size * size), dtype=np.int64)
    np.add.at(sizes, (np.arange(n)[:, None], flat), 1)
    return pd.DataFrame({"regions": is_root.sum(1), "positive": (is_root & signs.reshape(n, size * size)).sum(1), "largest": sizes.max(1, initial=0)})


@query(
    f"""WITH g AS (SELECT vec_id, list_transform({VALUES}[1:10], lambda x: 4 * x) AS v FROM embeddings), e AS (SELECT vec_id, list_transform(v, lambda x: exp(x - list_max(v))) AS p FROM g),
    d AS (SELECT vec_id, list_transform(p, lambda x: x / list_sum(p)) AS p FROM e)
    SELECT vec_id, round(list_max(p), 6) AS top, round(-list_sum(list_transform(p, lambda x: x * ln(greatest(x, 1e-12)))), 6) AS entropy,
      len(list_filter(p, lambda x: x >= 0.5 * list_max(p))) AS n_close FROM d"""
)
def close_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A temperature softmax over candidates: its top, its entropy, and the candidates within half of the top."""
    shares = softmax(F.slice("grid", 1, 10), 0.25)
    rows = _grids(spark, sf_dir).select("vec_id", shares.alias("p"))
    close = F.size(F.filter("p", lambda x: x >= F.lit(0.5) * F.array_max("p")))
    return rows.select("vec_id", F.round(F.array_max("p"), 6).alias("top"), F.round(entropy(F.col("p")), 6).alias("entropy"), close.cast("long").alias("n_close"))


@query(
    f"""WITH g AS (SELECT vec_id, {VALUES}[1:10] AS v FROM embeddings), c AS (SELECT vec_id, unnest(v) AS x, unnest(range(1, 11)) AS i, list_max(v) AS best FROM g),
    t AS (SELECT vec_id, exp(x - best) AS w, best - x AS loss, i FROM c) SELECT vec_id, round(sum(w * loss) / sum(w), 6) AS cost FROM t GROUP BY ALL"""
)
def expected_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loss to expect when a candidate is drawn by its weight."""
    some = F.slice("grid", 1, 10)
    shares = softmax(some)
    cost = F.aggregate(F.zip_with(shares, some, lambda p, x: p * (F.array_max(some) - x)), F.lit(0.0), lambda a, x: a + x)
    return _grids(spark, sf_dir).select("vec_id", F.round(cost, 6).alias("cost"))


@query(
    f"""WITH g AS (SELECT vec_id, label, {VALUES}[1:10] AS v FROM embeddings), r AS (SELECT vec_id, label, v[label + 1] AS own, v, len(list_filter(v, lambda x: x > v[label + 1])) + 1 AS rank FROM g)
    SELECT label, count(*) AS n, round(avg((rank = 1)::INT), 6) AS top1, round(avg((rank <= 5)::INT), 6) AS top5, round(avg(own), 6) AS mean_value FROM r GROUP BY ALL"""
)
def rank_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the labelled candidate ranks first, or among five, and its mean value."""
    some = F.slice("grid", 1, 10)
    own = F.element_at(some, F.col("label") + 1)
    rows = _grids(spark, sf_dir).withColumn("own", own).withColumn("rank", F.size(F.filter(some, lambda x: x > F.col("own"))) + 1)
    return rows.groupBy("label").agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("rank") == 1).cast("int")), 6).alias("top1"), F.round(F.avg((F.col("rank") <= 5).cast("int")), 6).alias("top5"), F.round(F.avg("own"), 6).alias("mean_value")
    )


@query(
    """WITH b AS (SELECT l_orderkey, l_partkey, l_extendedprice AS price, max(l_extendedprice) OVER (PARTITION BY l_orderkey) AS best FROM lineitem),
    a AS (SELECT l_orderkey, count(*) FILTER (price >= best - 5000) AS accepted, count(*) AS n, any_value(best) AS best FROM b GROUP BY ALL)
    SELECT l_orderkey, n, accepted, round(best, 2) AS best FROM a WHERE accepted <= 2 AND n > accepted"""
)
def tolerance_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates within a tolerance of the best, where they are few and not all."""
    prices = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_extendedprice").alias("p"))
    best = F.array_max("p")
    rows = prices.select("l_orderkey", F.size("p").cast("long").alias("n"), F.size(F.filter("p", lambda x: x >= best - 5000)).cast("long").alias("accepted"), F.round(best, 2).alias("best"))
    return rows.filter("accepted <= 2 and n > accepted")


@query(
    f"""WITH g AS (SELECT vec_id, label, {VALUES} AS v FROM embeddings), f AS (SELECT label, arg_min(v, vec_id) AS v FROM g GROUP BY ALL), p AS (SELECT g.vec_id, g.v AS a, f.v AS b FROM g JOIN f USING (label))
    SELECT vec_id, round(list_max(list_transform(range(1, 65), lambda i: abs(a[i] - b[i]))), 6) AS largest, round(list_sum(list_transform(range(1, 65), lambda i: abs(a[i] - b[i]))) / 64, 6) AS mean,
      list_position(a, list_max(a)) = list_position(b, list_max(b)) AS same_top FROM p"""
)
def output_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each output against its label's reference: largest and mean difference, and whether the top agrees."""
    grids = _grids(spark, sf_dir)
    reference = grids.groupBy("label").agg(F.min_by("grid", "vec_id").alias("ref"))
    diff = F.zip_with("grid", "ref", lambda a, b: F.abs(a - b))
    top = lambda c: F.array_position(c, F.array_max(c))
    return grids.join(F.broadcast(reference), "label").select(  # one row a label
        "vec_id", F.round(F.array_max(diff), 6).alias("largest"), F.round(F.aggregate(diff, F.lit(0.0), lambda a, x: a + x) / 64, 6).alias("mean"), (top("grid") == top("ref")).alias("same_top")
    )


@query(f"SELECT vec_id, len(list_filter({VALUES}, lambda x: abs(x) >= 0.1 AND abs(x) < 0.2)) AS contested, len(list_filter({VALUES}, lambda x: abs(x) >= 0.2)) AS settled FROM embeddings")
def contested_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points whose ownership is in doubt, and those whose is not."""
    doubt = F.filter("grid", lambda x: (F.abs(x) >= 0.1) & (F.abs(x) < 0.2))
    return _grids(spark, sf_dir).select("vec_id", F.size(doubt).cast("long").alias("contested"), F.size(F.filter("grid", lambda x: F.abs(x) >= 0.2)).cast("long").alias("settled"))


@query(
    f"""WITH g AS (SELECT vec_id, label, ('0x' || substr(md5('5|' || vec_id), 1, 8))::BIGINT % 8 AS view,
      list_transform({VALUES}, lambda x: (x > 0)::INT) AS b FROM embeddings),
    p AS (SELECT vec_id, label, view, b, unnest(range(64)) AS j FROM g),
    q AS (SELECT *, j // 8 AS r, j % 8 AS c FROM p),
    m AS (SELECT *, CASE WHEN view >= 4 THEN 7 - c ELSE c END AS mc FROM q),
    s AS (SELECT vec_id, label, view, b, j, CASE view % 4 WHEN 0 THEN r * 8 + mc WHEN 1 THEN mc * 8 + 7 - r WHEN 2 THEN (7 - r) * 8 + 7 - mc ELSE (7 - mc) * 8 + r END AS source FROM m)
    SELECT vec_id, view, string_agg(b[source + 1]::VARCHAR || (1 - b[source + 1])::VARCHAR, '' ORDER BY j) AS planes, max(CASE WHEN source = label THEN j END)::INTEGER AS view_label
    FROM s GROUP BY vec_id, label, view, b"""
)
def packed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards of two planes packed to bytes, then decoded as batches, each under the view that its place gives, with its label."""
    flags = F.flatten(F.transform("grid", lambda x: F.when(x > 0, F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    packed = pack_planes(_grids(spark, sf_dir).select("vec_id", "label", flags.alias("flags")), "flags", SIZE, 2)
    viewed = packed.withColumn("view", seeded_view(5, F.col("vec_id")))
    decoded = decode_planes(viewed, "packed", "view", SIZE, 2, "label")
    return decoded.select("vec_id", "view", F.array_join(F.col("planes").cast("array<string>"), "").alias("planes"), "view_label")
