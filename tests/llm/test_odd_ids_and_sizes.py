"""Language models of rows with odd identifiers and many labels; neighbours among very small and very large components."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kifu_spark.llm import langid, neighbours
from tests.llm.test_scorers import plain_language

SCHEMA = "doc_id long, text string, lang string"


@pytest.mark.parametrize("ids", [lambda k: None, lambda k: 7, lambda k: k % 3])
def test_rows_are_sampled_whatever_their_ids(spark, ids):
    rows = [(ids(k), f"alpha beta w{k}", "a") for k in range(900)] + [(ids(k), f"gamma delta v{k}", "b") for k in range(40)] + [(None, "same words", "c")] * 300
    known = spark.createDataFrame(rows, SCHEMA).repartition(6)
    counts = {r.lang: r["count"] for r in langid.sampled(known, 50).groupBy("lang").count().collect()}
    assert counts == {"a": 50, "b": 40, "c": 50}
    found = langid.identify(known.withColumn("found", F.lit("clash")), F.lit(False), rows_per_lang=50)
    right = known.select("text", "lang").distinct().count()
    joined = found.withColumn("nth", F.monotonically_increasing_id())
    assert joined.count() == len(rows) and right == 941
    scorer = langid.Scorer(langid.fit(known, rows_per_lang=50))
    assert all(scorer.score(text)[0] == lang for _, text, lang in rows)


def test_many_labels(spark):
    rows = [(None, f"w{chr(97 + k % 26)}{'x' * (k % 7)} {format(k, 'b').translate(str.maketrans('01', 'pq'))}", f"l{k:05d}") for k in range(20_000)]
    model = langid.fit(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert model.sparse and len(model.langs) == 20_000
    scorer = langid.Scorer(model)
    for _, text, lang in random.Random(1).sample(rows, 60):
        own = text.split()[1]
        assert scorer.score(" ".join([own] * 3)) [0] == lang


def test_sparse_scores_equal_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(langid, "DENSE_LANGS", 1)
    rng = random.Random(6)
    labelled = [("xyz"[k % 3], "".join(rng.choice("abcdef "[k % 3 :]) for _ in range(50))) for k in range(15)]
    docs = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(labelled)], SCHEMA)
    scorer = langid.Scorer(langid.fit(docs))
    assert scorer.model.sparse
    for text in ["".join(rng.choice("abcdeé日 1'") for _ in range(rng.randint(0, 40))) for _ in range(150)] + [None, "", "日本"]:
        (got, share), (want, right) = scorer.score(text), plain_language(text, labelled)
        assert got == want and share == pytest.approx(right, abs=1e-9), text


@pytest.mark.parametrize("scale", [1e-200, 1e200, 5e-324, 1e-310, 1.0])
def test_components_of_any_size(spark, scale):
    rng = random.Random(9)
    rows = [(i, [rng.randint(-9, 9) * scale for _ in range(6)]) for i in range(60)]
    rows = [(i, v) for i, v in rows if any(v)] + [(100, [scale] * 6), (150, [rng.randint(1, 9) * 1.0 for _ in range(6)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q, v in rows:
        if q % 50 == 0:
            unit = lambda w: [x / max(map(abs, w)) for x in w]
            cosine = lambda w: sum(a * b for a, b in zip(unit(v), unit(w))) / math.sqrt(sum(a * a for a in unit(v)) * sum(b * b for b in unit(w)))  # noqa: B023, E731
            best = sorted(((-cosine(w), j) for j, w in rows if j != q))[:5]
            found = sorted(got[q])
            assert [s for _, _, s in found] == pytest.approx([-c for c, _ in best], abs=1e-12)
