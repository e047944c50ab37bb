"""Sharding, SimHash and packing against brute force."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kifu_spark.llm import components, packing, sharding, simhash

BPE = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    (1, "a b c", "s"), (2, "A  b\tC", "t"), (3, None, None), (4, "", "s"), (5, " \n", "s"), (6, "one two", "s"),
    (7, "x y " * 6000, "s"), (7, "x y " * 6000, "s"), (None, "a b c", "s"), (9, "ß é 日本 a<|endoftext|>b", "u"), (10, "w" * 30000, "s"),
]
SCHEMA = "doc_id long, text string, size string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def test_shards(spark, sf_dir, odd):
    for df in (odd, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        rows = sharding.shard_documents(df, shards=4).collect()
        assert len(rows) == df.count()
        homes = {}
        for r in rows:
            homes.setdefault(r.text_sha256, set()).add(r.shard)
        assert all(len(h) == 1 for h in homes.values())
        for shard in range(4):
            assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    sizes = {r.doc_id: (r["size"], r.text_crc32) for r in sharding.shard_documents(odd).collect()}
    assert sizes[3] == (1, 0) and sizes[1] == (6, zlib.crc32(b"a b c"))


def test_shards_are_even_and_the_hot_group_is_whole(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 5 == 0, "hot").otherwise(F.repeat(F.col("id").cast("string"), 5)).alias("text"))
    by = sharding.shard_documents(df, shards=4, cells=64).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    assert max(r.b for r in by) - min(r.b for r in by) < 0.02 * sum(r.b for r in by) and all(r.m == r.n - 1 for r in by)


def test_longest_first_by_hand():
    assert longest({1: 7, 2: 5, 3: 4, 4: 3, 5: 3}, 2) == [10, 12]


def longest(items, shards):
    placed = sharding.longest_first(items.items(), shards)
    return sorted(sum(items[i] for i, s in placed.items() if s == shard) for shard in range(shards))


def slow_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprints_match_spark_and_by_hand(spark):
    for text in ["a b c d", "A B c D e", "x", "", None, "one two", "é ß 日本 a b"]:
        assert simhash.fingerprint(text) == slow_print(text)
    got = spark.createDataFrame([("a b c",)], "t string").select(F.xxhash64("t")).first()[0]
    assert got % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_pair_within_the_radius(radius):
    masks, rng = simhash.covering_masks(radius), random.Random(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for _ in range(2000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius)))
        assert any(diff & m == 0 for m in masks)


def near_prints(n, seed):
    rng, out = random.Random(seed), []
    for _ in range(n):
        base = rng.choice(out) if out and rng.random() < 0.7 else rng.getrandbits(64)
        for b in rng.sample(range(64), rng.randint(0, 3)):
            base ^= 1 << b
        out.append(base)
    return list(dict.fromkeys(out))


def slow_components(prints, radius):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {frozenset(q for q in prints if find(q) == find(p)) for p in prints}


@pytest.mark.parametrize("radius", [1, 2])
def test_links_have_the_components_of_brute_force(spark, radius):
    prints = near_prints(250, radius)
    df = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "fp long")
    edges = simhash.links(df, radius)
    assert all(((e.u ^ e.v) % 2**64).bit_count() <= radius for e in edges.collect())
    groups = {}
    for r in components.components(edges).collect():
        groups.setdefault(r.root, set()).add(r.node % 2**64)
    linked = {frozenset(g) for g in groups.values()}
    assert linked == {c for c in slow_components(prints, radius) if len(c) > 1}


def test_near_duplicates_cases(odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[2].component_id == 1 and by[None].component_id == 1 and by[4].component_id == by[5].component_id == 3
    assert by[3].fingerprint == "0" * 16 and all(r.fingerprint == f"{slow_print(t):016x}" for d, t, _ in ODD for r in [by[d]])
    kept = simhash.keep_one_of_each(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in rows})
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
    bare = odd.withColumn("doc_id", F.lit(None).cast("long"))
    groups = {r.group_fp for r in simhash.near_duplicates(bare).collect()}
    assert simhash.keep_one_of_each(bare).count() == len(groups) > 3


def test_components_of_a_path_and_a_star(spark):
    path = [(i + 1, i) for i in range(40)] + [(100, k) for k in range(101, 140)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 140))
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_encoder_matches_the_tokenizer():
    plain, ours, rng = Tokenizer.from_file(BPE), packing.Encoder(BPE), random.Random(3)
    assert ours.fast is not None
    letters = "ab Z9.,!'\n\t\r  éßñ日本ケ́½²٣­'s'll_-–“…\x0b\x1c　​😀"
    for text in ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(1500)] + [t for _, t, _ in ODD if t]:
        ids = plain.encode(text, add_special_tokens=False).ids
        assert ours.ids(text) == np.array(ids, dtype="<u4").tobytes()


def test_packing_cases(spark, odd, sf_dir):
    plain = Tokenizer.from_file(BPE)
    for df in (odd, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        rows = packing.pack_documents(df, BPE, group_pieces=64).collect()
        sequences = {}
        for r in rows:
            assert 1 <= r.length <= 2048 and (r.piece == 0 or r.length == 2048)
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 2048
        total = 0
        texts = {}
        for d in df.collect():
            texts.setdefault(d.doc_id, d.text or "")
        for r in rows:
            ids = plain.encode(texts[r.doc_id], add_special_tokens=False).ids + [0]
            assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
            total += r.length
        assert len(sequences) <= 1.15 * -(-total // 2048) + 2
    assert packing.pack_documents(odd.limit(0), BPE).count() == 0


def test_sum_of_squares_against_a_plain_version():
    rng = random.Random(5)
    lengths = [rng.randint(1, 20) for _ in range(300)]
    gaps, used = {}, []
    for n in lengths:
        best = None
        for gap in sorted(g for g in gaps if g >= n and gaps[g]) + [20]:
            after = dict(gaps)
            if gap < 20:
                after[gap] -= 1
            if gap - n:
                after[gap - n] = after.get(gap - n, 0) + 1
            cost = sum(v * v for v in after.values())
            if best is None or cost < best[0]:
                best = (cost, after, gap)
        gaps = best[1]
        used.append(20 - best[2])
    _, offset = packing.sum_of_squares(np.array(lengths), 20)
    assert offset.tolist() == used


def test_pieces():
    assert packing.piece_bounds(5) == [(0, 5)] and packing.piece_bounds(2048) == [(0, 2048)]
    assert packing.piece_bounds(4100) == [(0, 4), (4, 2048), (2052, 2048)]
