"""Language ID, toxicity, token counts, repeats and neighbours: held-out accuracy, brute force and stated cases."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from kifu_spark.llm import grammar, hilbert, langid, neighbours, queries, repeats, token_counts, toxicity

PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [(1, "Hello there, one two three four five six seven eight."), (2, None), (3, ""), (4, "123 ... 456"), (5, "word " * 20000), (5, "word " * 20000), (None, "é ß 日本")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumn("lang", F.lit(None).cast("string")).withColumn("score", F.lit("x"))


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op7_language(spark, sf)
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").filter("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_language_cases(spark, odd):
    docs = spark.createDataFrame([(10 + i, t, lang) for i, (t, lang) in enumerate([("der die das und nicht", "de"), ("the and of with that", "en")] * 20)], "doc_id long, text string, lang string")
    both = docs.unionByName(odd.select("doc_id", "text", "lang"))
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(both, F.lit(False)).collect()}
    assert {(2, "und"), (3, "und"), (4, "und")} <= got and (10, "de") in got and (11, "en") in got
    assert {r.lang_pred for r in langid.identify(odd, F.lit(False)).collect()} == {"und"}
    kept = langid.keep_known_languages(both, F.lit(False))
    assert kept.columns == both.columns and not {2, 3, 4} & {r.doc_id for r in kept.collect()}
    assert langid.identify(odd.limit(0), F.lit(False)).count() == 0


def test_backoff_reads_unseen_words_by_their_longest_known_grams():
    words = [("a", "hund", 5), ("b", "dog", 5)]
    grams = [(lang, g, n) for lang, w, n in words for g in langid.grams_of(w)]
    model = langid.Model(["a", "b"], words, grams)
    scorer = langid.Scorer(model)
    assert scorer.score("hund")[0] == "a" and scorer.score("hunde")[0] == "a" and scorer.score("doggy")[0] == "b"
    assert langid.Scorer(model, kept=1).score("hunde doggy dogs dogged") == scorer.score("hunde doggy dogs dogged")


def test_composed_grammar_equals_its_parts_in_turn():
    composed = toxicity.grammar()
    soft, plain, aimed = composed.weight("NI"), composed.weight("I"), composed.weight("TI")
    assert soft < plain < aimed and composed.weight("RooI") < plain and composed.weight("K") == 0 < composed.weight("KT")
    assert composed.weight("NoooI") == plain and composed.weight("oooo") == 0

    def swap(a, b):
        return grammar.Transducer({(0, a): (1, b, 1.0), (1, a): (0, a, 2.0)})

    parts, rng = [swap("x", "y"), swap("y", "x")], random.Random(0)
    both = grammar.Composed(parts, "xyz")
    for _ in range(50):
        line = [rng.choice("xyz") for _ in range(12)]
        states, total = [0, 0], 0.0
        for symbol in line:
            for k, part in enumerate(parts):
                states[k], symbol, weight = part.step(states[k], symbol)
                total += weight
        assert both.weight(line) == total


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op6_toxicity(spark, sf).join(labels, "doc_id").filter("held_out").collect()
    toxic, clean = [r for r in rows if r.toxic == 1], [r for r in rows if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= 0.8 * len(toxic) and sum(r.predicted for r in clean) <= 0.01 * len(clean)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and (r.predicted == 1) == (r.score >= 0.7) for r in rows)


def test_toxicity_cases(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(odd, none, F.lit(False)).collect()
    assert len(rows) == len(ODD) and {r.predicted for r in rows} == {0}
    assert toxicity.score_toxicity(odd.limit(0), none, F.lit(False)).count() == 0


def slow_tokens(word, scores, byte_score):
    text = token_counts.MARK + word
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        size = len(text[end - 1].encode())
        options = [(best[end - 1][0] + size * byte_score, best[end - 1][1] - size)]
        options += [(best[s][0] + scores[text[s:end]], best[s][1] - 1) for s in range(max(0, end - 40), end) if text[s:end] in scores]
        best.append(max(options))
    return -best[-1][1]


def test_token_counts_against_plain_dynamic_programming(spark, sf_dir):
    scores = token_counts.zipf_scores(PIECES)
    trie, rng = token_counts.Trie(scores), random.Random(1)
    words = ["".join(rng.choice("abcdehilnorst日é😀▁1") for _ in range(rng.randint(1, 14))) for _ in range(400)] + ["a" * 500]
    small = token_counts.Trie(scores, most_nodes=50)
    for word in words:
        assert trie.insert(word) == small.insert(word) == slow_tokens(word, scores, trie.byte_score)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known = {r.doc_id: r.text for r in docs.collect()}
    for r in queries.op1_token_counts(spark, sf_dir).collect()[:20]:
        words = known[r.doc_id].split()
        assert (r.pre_tokens, r.tokens) == (len(words), sum(slow_tokens(w, scores, trie.byte_score) for w in words))


def test_token_count_cases(spark, odd):
    got = {(r.doc_id, r.pre_tokens) for r in token_counts.count_tokens(odd, PIECES).collect()}
    assert {(2, 0), (3, 0), (4, 3), (5, 20000), (None, 3)} <= got
    assert token_counts.count_tokens(odd.limit(0), PIECES).count() == 0


def test_repeats_cut_passages_at_their_places(spark):
    passage = "This passage has rather more than eight words in it. And so does the sentence that comes right after it."
    docs = spark.createDataFrame([(1, f"Intro. {passage} End."), (2, f"Other words\n{passage.upper()}\nmore"), (3, "Alone here."), (4, None), (5, ""), (None, passage)], "doc_id long, text string")
    rows = repeats.repeated_units(docs).collect()
    assert {(r.doc_id, r.keep_doc_id, r.copies) for r in rows} == {(2, 1, 3), (None, 1, 3)} and len(rows) == 4
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(len(texts[r.doc_id][r.start : r.end].split()) == r.words for r in rows)
    left = {r.doc_id: r.text for r in repeats.without_repeats(docs).collect()}
    assert left[1] == texts[1] and left[2] == "Other words\nmore" and left[4] is None and left[5] == ""
    assert repeats.repeated_units(docs.limit(0)).count() == 0


def test_hilbert_curve_visits_neighbours():
    grid = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    keys = hilbert.hilbert_keys(grid, 3)
    assert sorted(keys) == list(range(512))
    assert np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1).max() == 1


def slow_nearest(rows, k=5):
    clean = {i: np.array(v, float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, q in clean.items():
        if i % 50 == 0:
            scored = sorted((-round(float(q @ v / np.linalg.norm(q) / np.linalg.norm(v)), 12), j) for j, v in clean.items() if j != i and len(v) == len(q))
            out[i] = [j for _, j in scored[:k]]
    return out


def test_neighbours_recall_and_scores(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    truth, got = slow_nearest(rows), {}
    vectors = {i: np.array(v, float) for i, v in rows}
    for r in queries.op4_nearest(spark, sf).collect():
        got.setdefault(r.query_id, []).append(r)
        a, b = vectors[r.query_id], vectors[r.vec_id]
        assert abs(r.score - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12
    hits = sum(len({r.vec_id for r in got[q]} & set(t)) for q, t in truth.items())
    assert hits >= 0.9 * sum(map(len, truth.values()))
    assert all([r.rank for r in sorted(rs, key=lambda r: (-r.score, r.vec_id))] == [1, 2, 3, 4, 5] for rs in got.values())


def test_neighbour_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, [0.0, 1.0]), (8, [1.0, 0.0, 0.0]), (50, [1.0, 1.0]), (100, None)]
    rows += [(200 + i, [2.0, 0.5]) for i in range(60)] + [(7, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got[0] == [200, 201, 202, 203, 204] and got[200] == [201, 202, 203, 204, 205] and got[50][0] in (200, 0, 7)
    assert set(got) == {0, 50, 200, 250}
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
