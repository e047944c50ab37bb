"""A language with few rows keeps its words beside large ones."""

from kifu_spark.llm import langid


def test_a_rare_language_keeps_its_words(spark):
    rows = [(k, " ".join(["alpha", "beta", "gamma", "delta"] * 5), "big") for k in range(50)] + [(100, "uno dos tres", "rare")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_words=3, most_grams=3)
    assert {"uno", "dos", "tres", "alpha"} <= set(model.words[0])
    assert "u" in model.grams[0]
