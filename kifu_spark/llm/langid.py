"""Language identification by words first, backing off to shorter character n-grams.

A known word adds its log frequency in each language, less the log of their sum, so that it speaks only about the
language. An unseen word is read by its character n-grams with word marks at both ends: at each position the longest
known n-gram counts, from four characters down to one, and the word adds their mean. A document's scores are summed
over its words, and the answer is the most likely language with its share of the likelihood.

The model is fitted on a bounded sample of labelled rows: for each language the ``rows_per_lang`` rows of the smallest
hashes of identifier and text, so that rows are chosen whatever their identifiers are. It keeps every word and every
n-gram of these rows, and only the counts that are not zero where languages are many, so that its size, which the driver
and each worker hold, is bounded by that parameter times the number of languages. Every whole text is scored.

Cases: identifiers may be null or shared, also by all rows of a language; equal rows are drawn one by one. words are runs of letters (Unicode categories L*). A null text or one without a letter is ``und`` with score 0,
number signs such as a half or a circled one being none, as is every text where no row teaches a language. Labels that
are null teach nothing. Repeated rows are scored alike; ties go to the language first in code point order. A text of
any length is read whole, its words at once. Further columns never matter, whatever their names. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kifu_spark.session import expect_long_texts, stored

ROWS_PER_LANG = 600
LONGEST_GRAM = 4
#: Unseen words whose evidence a worker keeps; forgetting them changes no score.
WORDS_KEPT = 50_000
#: Up to so many languages every count has a place; beyond, only those that are not zero. The answers are the same.
DENSE_LANGS = 64
TASK_GROUPS = 64
UNDETERMINED = "und"
_WORD = regex.compile(r"\p{L}+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def grams_of(word: str, longest: int = LONGEST_GRAM) -> Iterator[str]:
    marked = f"<{word}>"
    for n in range(1, longest + 1):
        for at in range(len(marked) - n + 1):
            yield marked[at : at + n]


class SparseEvidence:
    """Log counts of keys by language, for many languages: a base for each language and what is above it where a count is.

    A row's log share is the base, plus what is above it, less a term that all languages share, which decides nothing.
    """

    def __init__(self, listed: list[tuple[int, int, int]], rows: int, langs: int):
        totals = np.full(langs, 0.5 * rows)
        for _, lang, n in listed:
            totals[lang] += n
        self.base = np.log(0.5 / np.maximum(totals, 0.5))
        order = sorted(listed)
        self.starts = np.searchsorted([row for row, _, _ in order], np.arange(rows + 1))
        self.langs = np.array([lang for _, lang, _ in order], dtype=np.int64)
        self.above = np.log1p(2.0 * np.array([n for _, _, n in order], dtype=np.float64))

    def add(self, total: np.ndarray, rows: Iterable[int], share: float) -> None:
        """Add share times the evidence of some rows."""
        for row in rows:
            part = slice(self.starts[row], self.starts[row + 1])
            total[self.langs[part]] += share * self.above[part]
            total += share * self.base


class Model:
    """Per-language evidence of words and n-grams."""

    def __init__(self, langs: Iterable[str], words: Iterable[tuple], grams: Iterable[tuple], longest: int = LONGEST_GRAM):
        self.langs, self.longest = sorted(set(langs)), longest
        self.sparse = len(self.langs) > DENSE_LANGS
        self.words, (rows, table) = self._evidence(words), self._evidence(grams)
        self.grams = rows, table if self.sparse else np.vstack([table, np.zeros((1, len(self.langs)))])

    def _evidence(self, counts: Iterable[tuple]) -> tuple[dict[str, int], np.ndarray | SparseEvidence]:
        """Key to row, and each row's log share by language, from (lang, key, n)."""
        place = {lang: k for k, lang in enumerate(self.langs)}
        rows: dict[str, int] = {}
        listed = [(rows.setdefault(key, len(rows)), place[lang], n) for lang, key, n in counts]
        if self.sparse:
            return rows, SparseEvidence(listed, len(rows), len(self.langs))
        table = np.full((len(rows), len(self.langs)), 0.5)
        for row, lang, n in listed:
            table[row, lang] += n
        if not len(table):
            return rows, table
        logs = np.log(table / table.sum(axis=0))
        top = logs.max(axis=1, keepdims=True)
        return rows, logs - top - np.log(np.exp(logs - top).sum(axis=1, keepdims=True))

    def known_grams(self, word: str) -> list[int]:
        """At each position of a word, the row of the longest known n-gram, where one is."""
        marked, found = f"<{word}>", []
        known = self.grams[0].get
        for at in range(len(marked)):
            for n in range(min(self.longest, len(marked) - at), 0, -1):
                row = known(marked[at : at + n])
                if row is not None:
                    found.append(row)
                    break
        return found

    def backoff(self, words: list[str]) -> np.ndarray:
        """Evidence of unseen words: of each, the mean over its positions of the longest known n-gram."""
        rows, table = self.grams
        found, starts = [], []
        for word in words:
            starts.append(len(found))
            found += self.known_grams(word) or [len(rows)]  # nothing is known: the last line of the table, without evidence
        lengths = np.diff([*starts, len(found)])
        return np.add.reduceat(table[found], starts, axis=0) / lengths[:, None]

    def sparse_total(self, words: list[str]) -> np.ndarray:
        """The evidence of all words, where only counts that are not zero are held."""
        total, (rows, table) = np.zeros(len(self.langs)), self.words
        for word, times in Counter(words).items():
            if word in rows:
                table.add(total, [rows[word]], times)
            elif found := self.known_grams(word):
                self.grams[1].add(total, found, times / len(found))
        return total


class Scorer:
    """Scores texts, keeping the evidence of unseen words up to a bound."""

    def __init__(self, model: Model, kept: int = WORDS_KEPT):
        self.model, self.kept = model, kept
        self._reset()

    def _reset(self) -> None:
        if self.model.sparse:
            return
        rows, table = self.model.words
        self.rows, self.used = dict(rows), len(rows)
        self.table = np.vstack([table, np.zeros((4096, len(self.model.langs)))])

    def _learn(self, words: list[str]) -> None:
        if self.used > len(self.model.words[0]) + self.kept:
            self._reset()
        fresh = [word for word in dict.fromkeys(words) if word not in self.rows]
        last = self.used + len(fresh)
        if last > len(self.table):
            self.table = np.vstack([self.table, np.zeros((last - len(self.table) + 16384, len(self.model.langs)))])
        self.table[self.used : last] = self.model.backoff(fresh)
        self.rows.update(zip(fresh, range(self.used, last)))
        self.used = last

    def _total(self, words: list[str]) -> np.ndarray:
        try:
            rows = [*map(self.rows.__getitem__, words)]
        except KeyError:
            self._learn(words)
            rows = [*map(self.rows.__getitem__, words)]
        return self.table[rows].sum(axis=0)

    def score(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.model.langs:
            return UNDETERMINED, 0.0
        total = self.model.sparse_total(words) if self.model.sparse else self._total(words)
        best = int(total.argmax())
        return self.model.langs[best], float(1 / np.exp(total - total[best]).sum())


def _most_frequent(counts: DataFrame, key: str, most: int | None, least_each: int) -> list:
    """Rows lang, key, n: all of them, or the most frequent of all and of each language."""
    if most is not None:
        order = [F.desc("n"), F.col(key)]
        of_all = counts.orderBy(F.desc("n"), "lang", key).limit(most).select("lang", key, "n")
        of_each = counts.select("lang", key, "n", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).alias("nth"))
        counts = of_all.union(of_each.filter(F.col("nth") <= least_each).drop("nth")).distinct()
    return counts.orderBy(F.desc("n"), "lang", key).collect()


def sampled(known: DataFrame, rows_per_lang: int) -> DataFrame:
    """lang and text of each language's rows with the smallest hashes, at most so many, of rows (doc_id, text, lang).

    Only hashes are ranked over all rows; whole texts are ranked where they are at most as large as the last of these, so
    that equal rows cannot pass the bound.
    """
    hashed = known.withColumn("hash", F.xxhash64("doc_id", "text"))
    by_hash = Window.partitionBy("lang").orderBy("hash")
    # first among the rows of some tasks, so that no task meets the smallest hashes of all of them
    by_tasks = Window.partitionBy("lang", "tasks").orderBy("hash")
    some = hashed.select("lang", "hash", F.pmod(F.spark_partition_id(), F.lit(TASK_GROUPS)).alias("tasks"))
    some = some.withColumn("nth", F.row_number().over(by_tasks)).filter(F.col("nth") <= rows_per_lang)
    few = some.withColumn("nth", F.row_number().over(by_hash)).filter(F.col("nth") <= rows_per_lang)
    last = few.groupBy("lang").agg(F.max("hash").alias("last"))  # one row a language, as in the model
    near = hashed.join(F.broadcast(last), "lang").filter(F.col("hash") <= F.col("last"))
    whole = Window.partitionBy("lang").orderBy("hash", "doc_id", "text")
    return near.withColumn("nth", F.row_number().over(whole)).filter(F.col("nth") <= rows_per_lang).select("lang", "text")


def fit(
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    rows_per_lang: int = ROWS_PER_LANG,
    most_words: int | None = None,
    most_grams: int | None = None,
    least_each: int = 10_000,
) -> Model:
    """A model of the rows whose language is known; of fewer words or n-grams than they have only where asked for."""
    expect_long_texts(labelled.sparkSession)
    known = labelled.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(
        "lang is not null and text is not null"
    )
    sample = sampled(known, rows_per_lang)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                n = Counter(word for text in texts for word in words_of(text))
                if n:
                    yield pd.DataFrame({"lang": lang, "word": [*n.keys()], "n": [*n.values()]})

    words = sample.select("lang", "text").mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = stored(words)
    marked = F.concat(F.lit("<"), "word", F.lit(">"))

    def of_length(n: int) -> Column:
        places = F.when(F.length(marked) >= n, F.sequence(F.lit(1), F.length(marked) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda at: F.substring(marked, at, F.lit(n)))

    grams = F.flatten(F.array(*[of_length(n) for n in range(1, LONGEST_GRAM + 1)]))
    gram_counts = words.select("lang", "n", F.explode(grams).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top_words = _most_frequent(words, "word", most_words, least_each)
    top_grams = _most_frequent(gram_counts, "gram", most_grams, least_each)
    langs = [r.lang for r in words.select("lang").distinct().collect()]  # those that have a word
    return Model(langs, ((r.lang, r.word, r.n) for r in top_words), ((r.lang, r.gram, r.n) for r in top_grams))


def language_column(text: Column, model: Model, df: DataFrame) -> Column:
    """struct<lang_pred, score> of each text."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # bounded by rows_per_lang

    @F.pandas_udf("lang_pred string, score double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = sent.value  # a worker keeps it between tasks, and its scorer with it
        scorer = model.scorer = getattr(model, "scorer", None) or Scorer(model)
        for texts in batches:
            yield pd.DataFrame([scorer.score(text) for text in texts], columns=["lang_pred", "score"])

    return of(text)


def identify(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **how
) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; the model learns from the rows that are not held out."""
    model = fit(docs.filter(~held_out), id_col, text_col, lang_col, **how)
    found = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), language_column(F.col(text_col), model, docs).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


def keep_known_languages(docs: DataFrame, held_out: Column, least_score: float = 0.4, **how) -> DataFrame:
    """The rows of docs whose language is found with at least that score, with the columns of docs."""
    text_col = how.get("text_col", "text")
    model = fit(docs.filter(~held_out), **how)
    row = docs.select(F.struct("*").alias("row"), language_column(F.col(text_col), model, docs).alias("found"))
    kept = row.filter((F.col("found.lang_pred") != UNDETERMINED) & (F.col("found.score") >= least_score))
    return kept.select(*[F.col("row").getField(name).alias(name) for name in docs.columns])
