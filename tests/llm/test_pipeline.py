"""The pipeline against its stages done by hand on a small table."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kifu_spark.llm import mixing, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("kept", F.lit("clash"))
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def test_columns_and_order(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "SimHash near-dedup", "source mixing", "best-fit packing"]
    assert all(df.columns == stages[0].columns for df in stages[1:5])


def test_each_stage_by_hand(stages):
    rows = [df.collect() for df in stages]
    letters = [r for r in rows[0] if re.search(r"[^\W\d_]", r.text or "")]
    assert {r.doc_id for r in rows[1]} <= {r.doc_id for r in letters} and len(rows[1]) >= 0.99 * len(letters)
    firsts = {}
    for r in sorted(rows[1], key=lambda r: r.doc_id):
        firsts.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text), r.doc_id)
    assert sorted(r.doc_id for r in rows[2]) == sorted(firsts.values())
    prints = {r.doc_id: simhash.fingerprint(r.text) for r in rows[2]}
    root = {d: d for d in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and root[b] > root[a]:
                    root[b], changed = root[a], True
    assert sorted(r.doc_id for r in rows[3]) == sorted(d for d in prints if root[d] == d)
    taken = {r.doc_id: (r.taken, r["size"]) for r in mixing.mix_sources(stages[3]).collect()}
    times = {d: int(t / s + 0.5) for d, (t, s) in taken.items() if s}
    counts = {}
    for r in rows[4]:
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert counts == {d: n for d, n in times.items() if n}
    assert {r.doc_id for r in rows[5]} == set(counts) and sum(r.piece == 0 for r in rows[5]) == sum(counts.values())


def test_odd_rows_and_empty_tables(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "the of and", "en", None, 3), (4, "the of and", "en", "s", 3), (4, "the of and", "en", "s", 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, SF).count() <= 3 * len(rows), name


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages[5].count()
