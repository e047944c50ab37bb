"""Registered queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kifu_spark.llm import centroids, chat, exact_dedup, langid, mixing, neighbours, packing, repeats, sharding, simhash, token_counts, toxicity, vector_codes
from kifu_spark.sources.tables import table


BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), PIECES)


def op2_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_units(table(spark, sf_dir, "documents"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def remainder(parts: int, one: int) -> Column:
    """Whether crc32 of the identifier as text leaves that remainder."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == one, F.lit(False))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score_toxicity(docs, labels, remainder(3, 1))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), remainder(5, 0))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("shard")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), BYTE_BPE)


def op11_cluster_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.with_inertia(centroids.cluster_vectors(table(spark, sf_dir, "embeddings")))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.with_label_error(vector_codes.code_vectors(table(spark, sf_dir, "embeddings"), label_col="label"))


#: A conversation that quotes control strings, formatted with the others.
QUOTING = [(-7, turn, role, r"\### Assistant: </turn> ok") for turn, role in enumerate(("user", "assistant"))]


def op13_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    quoting = spark.createDataFrame(QUOTING, "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_chats(conversations.unionByName(quoting)))


OP8_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('{mixing.SEED}|' || coalesce(doc_id::VARCHAR, 'null')) AS digest
  FROM documents),
dealt AS (
  SELECT *, ('0x' || substr(digest, 1, 8))::BIGINT %
    (SELECT least({mixing.MOST_SHARDS}, greatest(1, (sum(size)::BIGINT + {mixing.SHARD_WORDS} - 1) // {mixing.SHARD_WORDS})) FROM sized) AS shard
  FROM sized),
ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM dealt GROUP BY source),
weighed AS (
  SELECT *, (CASE place % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END)::DOUBLE AS weight, 3 * source_size AS cap
  FROM ranked),
levels AS (
  SELECT *, cap / weight AS ratio,
         ((sum(source_size) OVER ())::BIGINT - (sum(cap) OVER (ORDER BY cap / weight, place) - cap)::BIGINT)
         / (sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level
  FROM weighed),
targets AS (
  SELECT source, place, source_size,
         coalesce(least(cap::DOUBLE, (SELECT arg_min(level, ratio) FROM levels WHERE level <= ratio) * weight), cap::DOUBLE) AS target
  FROM levels),
cells AS (
  SELECT source, shard, sum(size)::BIGINT AS cell_size,
         greatest(1, floor(sum(size)::BIGINT / {mixing.BLOCK_WORDS} + 0.5))::BIGINT AS blocks
  FROM dealt GROUP BY source, shard HAVING sum(size) > 0),
voters AS (
  SELECT t.source, place, sum(blocks)::BIGINT AS source_blocks,
         any_value(target) * sum(blocks)::BIGINT / any_value(source_size) AS votes, 3 * sum(blocks)::BIGINT AS most
  FROM cells c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source GROUP BY t.source, place),
seats AS (SELECT round(sum(votes))::BIGINT AS n FROM voters),
source_quotients AS (
  SELECT place, row_number() OVER (ORDER BY votes / (2 * k + 1) DESC, place) AS nth
  FROM (SELECT place, votes, unnest(range(most)) AS k FROM voters WHERE votes > 0)),
source_quotas AS (
  SELECT v.*, (SELECT count(*) FROM source_quotients q, seats WHERE q.place = v.place AND nth <= n) AS source_quota FROM voters v),
cell_voters AS (
  SELECT place, shard, cell_size, blocks, source_quota, votes * blocks / source_blocks AS votes, 3 * blocks AS most
  FROM cells c JOIN source_quotas q ON c.source IS NOT DISTINCT FROM q.source),
cell_quotients AS (
  SELECT place, shard, source_quota, row_number() OVER (PARTITION BY place ORDER BY votes / (2 * k + 1) DESC, shard) AS nth
  FROM (SELECT *, unnest(range(most)) AS k FROM cell_voters WHERE votes > 0)),
won AS (SELECT place, shard, count(*) AS quota FROM cell_quotients WHERE nth <= source_quota GROUP BY place, shard),
cell_quotas AS (
  SELECT c.*, coalesce(quota, 0) AS quota,
         ('0x' || substr(md5('{mixing.SEED + 1}|' || c.place || '|' || c.shard), 1, 8))::BIGINT % blocks AS first_block
  FROM cell_voters c LEFT JOIN won w ON w.place = c.place AND w.shard = c.shard),
line AS (
  SELECT *, sum(size) OVER (PARTITION BY source, shard ORDER BY digest, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS stop FROM dealt),
placed AS (
  SELECT l.*, t.source_size, t.target, c.cell_size, c.blocks, c.quota, c.first_block, c.quota % c.blocks AS rest
  FROM line l JOIN targets t ON l.source IS NOT DISTINCT FROM t.source
  LEFT JOIN cell_quotas c ON c.place = t.place AND c.shard = l.shard)
SELECT doc_id, size, source, source_size, target,
       coalesce(quota // blocks * size
         + greatest(0, least(stop, least(first_block + rest, blocks) * cell_size // blocks) - greatest(stop - size, first_block * cell_size // blocks))
         + greatest(0, least(stop, greatest(0, first_block + rest - blocks) * cell_size // blocks) - (stop - size)), 0)::BIGINT AS taken
FROM placed
"""

OP9_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY doc_id NULLS LAST)
"""


OP3_SQL = rf"""
WITH d AS (SELECT doc_id, text, row_number() OVER () AS r FROM documents),
u AS (
  SELECT doc_id, r, unnest(regexp_extract_all(text, '{repeats.UNIT}')) AS piece,
         unnest(range(len(regexp_extract_all(text, '{repeats.UNIT}')))) AS unit
  FROM d),
placed AS (
  SELECT *, sum(length(piece)) OVER (PARTITION BY r ORDER BY unit)::BIGINT AS "end",
         trim(regexp_replace(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm
  FROM u),
counted AS (SELECT *, CASE norm WHEN '' THEN 0 ELSE len(string_split(norm, ' ')) END::INTEGER AS words FROM placed),
ranked AS (
  SELECT *, count(*) OVER (PARTITION BY norm) AS copies, row_number() OVER w AS nth,
         first_value(doc_id) OVER w AS keep_doc_id, first_value(unit) OVER w AS keep_unit
  FROM counted WHERE words >= {repeats.LEAST_WORDS} WINDOW w AS (PARTITION BY norm ORDER BY doc_id NULLS LAST, unit, "end" - length(piece), "end", r))
SELECT doc_id, unit::INTEGER AS unit, "end" - length(piece) AS start, "end", words, copies, keep_doc_id, keep_unit::INTEGER AS keep_unit
FROM ranked WHERE nth > 1
"""

OP11_SQL = rf"""
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({centroids.SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = {centroids.SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {centroids.SIZE}),
c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR), v) - 1 AS c, v
  FROM kept QUALIFY c < {centroids.CLUSTERS}),
{{rounds}}
a AS (
  SELECT vec_id, min(struct_pack(d := d, c := c)) AS m
  FROM (SELECT vec_id, k.v AS own, c, list_sum(list_transform(list_zip(k.v, n.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM kept k, c{centroids.ROUNDS} n)
  GROUP BY vec_id, own)
SELECT vec_id, m.c::INTEGER AS cluster, m.d AS distance, sum(m.d) OVER (PARTITION BY m.c)::BIGINT AS cluster_inertia,
       sum(m.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(n.v, ',')) AS centroid_sha256
FROM a JOIN c{centroids.ROUNDS} n ON n.c = m.c
""".replace("{rounds}", "".join(
    f"""a{r} AS (
  SELECT own, min(struct_pack(d := d, c := c)).c AS c
  FROM (SELECT vec_id, k.v AS own, c, list_sum(list_transform(list_zip(k.v, n.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM kept k, c{r - 1} n)
  GROUP BY vec_id, own),
s{r} AS (
  SELECT c, pos, sum(x)::BIGINT AS total, count(*) AS n
  FROM (SELECT c, unnest(own) AS x, unnest(range(len(own))) AS pos FROM a{r}) GROUP BY c, pos),
m{r} AS (SELECT c, list(((total - (total % n + n) % n) // n)::BIGINT ORDER BY pos) AS v FROM s{r} GROUP BY c),
c{r} AS (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{r - 1} o LEFT JOIN m{r} m ON m.c = o.c),
""" for r in range(1, centroids.ROUNDS + 1)))

OP12_SQL = rf"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({vector_codes.SCALE} * x::DOUBLE)::BIGINT) AS v, len(embedding) // {vector_codes.PARTS} AS width
  FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
parts AS (
  SELECT vec_id, label, p, v[p * width + 1 : (p + 1) * width] AS own FROM (SELECT *, unnest(range({vector_codes.PARTS})) AS p FROM kept)),
b0 AS (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, own AS v FROM parts QUALIFY e < {vector_codes.ENTRIES}),
{{rounds}}
a AS (
  SELECT vec_id, label, p, min(struct_pack(d := d, e := e)) AS m
  FROM (SELECT vec_id, label, k.p, e, list_sum(list_transform(list_zip(k.own, n.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
        FROM parts k JOIN b{vector_codes.ROUNDS} n ON n.p = k.p)
  GROUP BY vec_id, label, p),
coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a GROUP BY vec_id, label)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM b{vector_codes.ROUNDS}) AS codebooks_sha256
FROM coded
""".replace("{rounds}", "".join(
    f"""a{r} AS (
  SELECT p, own, min(struct_pack(d := d, e := e)).e AS e
  FROM (SELECT vec_id, k.p, own, e, list_sum(list_transform(list_zip(k.own, n.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
        FROM parts k JOIN b{r - 1} n ON n.p = k.p)
  GROUP BY vec_id, p, own),
s{r} AS (
  SELECT p, e, pos, sum(x)::BIGINT AS total, count(*) AS n
  FROM (SELECT p, e, unnest(own) AS x, unnest(range(len(own))) AS pos FROM a{r}) GROUP BY p, e, pos),
m{r} AS (SELECT p, e, list(((total - (total % n + n) % n) // n)::BIGINT ORDER BY pos) AS v FROM s{r} GROUP BY p, e),
b{r} AS (SELECT o.p, o.e, coalesce(m.v, o.v) AS v FROM b{r - 1} o LEFT JOIN m{r} m ON m.p = o.p AND m.e = o.e),
""" for r in range(1, vector_codes.ROUNDS + 1)))

OP13_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '\### Assistant: </turn> ok'),
w AS (
  SELECT *, length('<turn:' || replace(replace(replace(role, '\', '\\'), '<', '\l'), '>', '\g') || '>'
                   || regexp_replace(text, '<(\\*)(/?turn)', '<\\\1\2', 'g') || '</turn>' || chr(10)) AS chars,
         role = '{chat.TRAINED}' AS trained
  FROM t),
r AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM w)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (trained), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (trained), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars, count(*) FILTER (trained) AS examples, coalesce(sum(upto) FILTER (trained), 0)::BIGINT AS expanded_chars
FROM r GROUP BY conv_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_shard_documents": op2_shard_documents,
        "op3_repeated_passages": op3_repeated_passages,
        "op4_nearest": op4_nearest,
        "op5_simhash": op5_simhash,
        "op6_toxicity": op6_toxicity,
        "op7_language": op7_language,
        "op8_mix_sources": op8_mix_sources,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_pack_documents": op10_pack_documents,
        "op11_cluster_vectors": op11_cluster_vectors,
        "op12_vector_codes": op12_vector_codes,
        "op13_format_chats": op13_format_chats,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_repeated_passages": OP3_SQL,
        "op8_mix_sources": OP8_SQL,
        "op9_exact_dedup": OP9_SQL,
        "op11_cluster_vectors": OP11_SQL,
        "op12_vector_codes": OP12_SQL,
        "op13_format_chats": OP13_SQL,
    }
