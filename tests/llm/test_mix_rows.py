"""Mixing of repeated rows, clashing names and many sources; targets and quotas against plain versions."""

import random

from pyspark.sql import functions as F

from kifu_spark.llm import mixing


def plain_targets(sizes, weights=(5.0, 2.0, 1.0)):
    """Water level by hand: cap what is above, share the rest again until nothing is."""
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        level = left / sum(weight[s] for s in free) if free else 0
        above = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not above:
            return {s: 3.0 * sizes[s] if s in capped else level * weight[s] for s in names}
        capped |= set(above)


def test_targets_of_many_sources(spark):
    rng = random.Random(8)
    sizes = {f"host{k}": int(rng.paretovariate(0.7) * 10) for k in range(700)} | {None: 5000, "zero": 0}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r for r in mixing.source_targets(df).collect()}
    want = plain_targets(sizes)
    assert [got[s].place for s in want] == list(range(len(sizes)))
    assert all(abs(got[s].target - want[s]) < 1e-6 * max(1.0, want[s]) for s in want)


def test_quotas_of_many_parties(spark):
    rng = random.Random(9)
    votes = [(k, rng.random() ** 4 * 100) for k in range(300)]
    df = spark.createDataFrame([(k, v, 10**6) for k, v in votes], "party long, votes double, most long")
    got = {r.party: r.seats for r in mixing.sainte_lague(df, [], ["party"], F.lit(500), "seats").collect()}
    quotients = sorted(((-v / (2 * k + 1), p) for p, v in votes for k in range(500)))[:500]
    want = {p: 0 for p, _ in votes}
    for _, p in quotients:
        want[p] += 1
    assert got == want


def test_repeated_rows_and_clashing_names(spark):
    rows = [(k % 5 if k % 3 else None, "one two three " * (k % 4), "s" if k % 2 else None, k) for k in range(60)] * 2 + [(1, "w " * 60_000, "long", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long").selectExpr("*", "'x' as taken", "1 as row", "2 as target")
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    counts = {}
    for r in mixed.collect():
        counts[r.doc_id, r.text, r.source] = counts.get((r.doc_id, r.text, r.source), 0) + 1
    given = {}
    for doc_id, text, source, _ in rows:
        given[doc_id, text, source] = given.get((doc_id, text, source), 0) + 1
    assert all(n <= 3 * given[key] and key[1] for key, n in counts.items())
    sized = mixing.mix_sources(df).collect()
    assert len(sized) == len(rows) and sum(r["size"] for r in sized) == sum(len((t or "").split()) for _, t, _, _ in rows)
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mixed_documents(df).collect()))


def test_plan_is_native(spark):
    df = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    plan = mixing.mix_sources(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
