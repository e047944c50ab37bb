"""Token counts of whole tables and of very long pre-tokens against plain dynamic programming."""

import random
from functools import cache

from kifu_spark.llm import queries, token_counts
from tests.llm.test_models import PIECES, slow_tokens


def test_every_row_equals_plain_dynamic_programming(spark, sf_dir):
    scores = token_counts.zipf_scores(PIECES)
    byte_score = token_counts.Trie(scores).byte_score
    slow = cache(lambda word: slow_tokens(word, scores, byte_score))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op1_token_counts(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = token_counts._WORD.findall(texts[r.doc_id] or "")
        assert (r.pre_tokens, r.tokens) == (len(words), sum(map(slow, words)))


def test_long_pre_tokens_share_the_trie():
    scores, rng = token_counts.zipf_scores(PIECES), random.Random(6)
    trie, small = token_counts.Trie(scores), token_counts.Trie(scores, most_nodes=300)
    stem = "".join(rng.choice("日本語のabcdeth") for _ in range(1500))
    nodes = len(trie.forward)
    for word in [stem, stem[:900], stem + "end", stem[:400] + "日" * 300]:
        assert trie.insert(word) == small.insert(word) == slow_tokens(word, scores, trie.byte_score)
    assert len(trie.forward) - nodes == 1500 + 3 + sum(1 for _ in "日" * 300) - (stem[400] == "日") * (len(stem[400:]) - len(stem[400:].lstrip("日")))
    long = "".join(rng.choice("etaoin日") for _ in range(300_000))
    assert trie.insert(long) == small.insert(long) > 0


def test_clashing_names_and_empty_rows(spark):
    df = spark.createDataFrame([(1, "a b", "x", 1), (1, "a b", "x", 1), (None, None, "x", 2)], "doc_id long, text string, n string, tokens int")
    got = token_counts.count_tokens(df, PIECES)
    assert got.columns == ["doc_id", "pre_tokens", "tokens"]
    assert sorted((r.doc_id or 0, r.pre_tokens, r.tokens) for r in got.collect()) == [(0, 0, 0), (1, 2, 2), (1, 2, 2)]
