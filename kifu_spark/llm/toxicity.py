"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult, threat, target, negation, reporting, or other. Four transducers read a clause one
after the other: negation softens an insult or threat that follows within a few words; reported speech softens those
after a reporting word; the target transducer adds weight where a person is addressed in the same clause; the last
one weighs what is left. They are composed into one table, and each clause that holds an insult or a threat is scored
by its path. A document's evidence is the sum over its clauses; words outside such clauses add nothing.

Insults are a short fixed list and stems learned from labelled rows: beginnings of words whose document counts in toxic
rows stand out from those in others (likelihood ratio and odds), each stem as long as it stays as frequent. Threat,
target, negation and reporting words are fixed lists too. A logistic curve over the saturating evidence, fitted on the
same rows, gives the score.

The model is fitted on a bounded sample: about ``labelled_rows`` labelled rows at most, chosen by a hash of the
identifier, one of each group of copies (else their words would stand out as insults do). All stems of these rows are
counted in Spark; only those whose odds stand out reach the driver. Every whole text is scored.

Cases: null and empty texts have no clauses and get the base score. Where no row is toxic, or none is not, the curve
is flat and low. Repeated rows are scored alike. Labels that are null teach nothing. A text of any length is read
whole; its evidence is a sum over clauses and takes no memory. Further columns never matter, whatever their names. An
empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kifu_spark.llm.grammar import Composed, Transducer
from kifu_spark.session import cut, expect_long_texts

LABELLED_ROWS = 20_000
SHORTEST, LONGEST = 4, 12
LEAST_ROWS = 3
LEAST_RATIO, LEAST_ODDS = 25.0, 20.0
THRESHOLD = 0.7

INSULTS = (
    "idiot moron stupid dumb imbecile loser scum pathetic worthless disgusting trash clown coward "
    "trottel dummkopf idiota imbécil estúpido tonto imbécile crétin stupide"
).split()
THREATS = "kill hurt destroy attack beat töten schlagen verletzen matar golpear herir tuer frapper blesser".split()
TARGETS = "you your yours yourself they them he she du dich dir ihr euch tú usted ustedes te toi tu vous ils elles".split()
NEGATIONS = "not never no isn't aren't don't nicht kein keine nie nunca jamás pas jamais".split()
REPORTING = "said says called claimed quoted reported wrote sagte nannte schrieb dijo llamó escribió dit appelé écrit".split()

INSULT, THREAT, SOFT, SOFT_THREAT, TARGET, NEGATION, REPORT, OTHER = "I", "K", "i", "k", "T", "N", "R", "o"
ALPHABET = (INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER)
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE_END = re.compile(r"[.!?;\n]")


def grammar() -> Composed:
    """Negation, reported speech, target and weight, composed."""
    soften = {INSULT: SOFT, THREAT: SOFT_THREAT}
    negated = {(state, NEGATION): (3, NEGATION, 0.0) for state in range(4)}
    negated |= {(state, s): (0, soft, 0.0) for state in (1, 2, 3) for s, soft in soften.items()}
    negation = Transducer(negated, default={3: 2, 2: 1, 1: 0})  # three words far
    reported = {(state, REPORT): (1, REPORT, 0.0) for state in (0, 1)}
    reported |= {(1, s): (1, soft, 0.0) for s, soft in soften.items()}
    harmful = (INSULT, THREAT, SOFT, SOFT_THREAT)
    # states: nothing yet, a target, harm without a target, both
    aimed = {(0, TARGET): (1, TARGET, 0.0), (2, TARGET): (3, TARGET, 0.5)}
    aimed |= {(0, s): (2, s, 0.0) for s in harmful} | {(1, s): (3, s, 0.5) for s in harmful}
    weights = Transducer(
        {(0, INSULT): (0, INSULT, 1.0), (0, SOFT): (0, SOFT, 0.5), (0, THREAT): (1, THREAT, 0.0), (0, SOFT_THREAT): (0, SOFT_THREAT, 0.0)}
        | {(1, TARGET): (0, TARGET, 1.5), (1, INSULT): (1, INSULT, 1.0), (1, SOFT): (1, SOFT, 0.5)}
    )  # a threat weighs only with a target after it
    return Composed([negation, Transducer(reported), Transducer(aimed), weights], ALPHABET)


class Scorer:
    """Evidence of a text under a learned lexicon of insult prefixes."""

    def __init__(self, prefixes: Iterable[str]):
        self.prefixes = set(prefixes)
        self.lengths = sorted({len(p) for p in self.prefixes})
        self.fixed = {w: s for words, s in ((INSULTS, INSULT), (THREATS, THREAT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTING, REPORT)) for w in words}
        self.grammar = grammar()
        self.kept: dict[str, str] = {}
        harmful = sorted(self.prefixes) + [w + r"\b" for w in INSULTS + THREATS]
        self.harmful = re.compile(r"\b(?:" + "|".join(p if p.endswith(r"\b") else re.escape(p) for p in harmful) + ")")

    def symbol(self, word: str) -> str:
        if (found := self.fixed.get(word)) is None:
            found = INSULT if any(word[:n] in self.prefixes for n in self.lengths) else OTHER
        return found

    def evidence(self, text: str | None) -> float:
        low, total, done = (text or "").lower(), 0.0, 0
        for hit in self.harmful.finditer(low):
            if hit.start() < done:
                continue
            start = max((low.rfind(mark, done, hit.start()) for mark in ".!?;\n"), default=-1)
            end = _CLAUSE_END.search(low, hit.end())
            start, done = max(start + 1, done), end.start() if end else len(low)
            total += self.grammar.weight(map(self.symbol, _WORD.findall(low, start, done)))
        return total


def stems_of(text: str | None) -> set[str]:
    """The distinct word stems of a text, of every length between the shortest and the longest."""
    words = set(_WORD.findall((text or "").lower()))
    return {w[:n] for w in words for n in range(SHORTEST, min(LONGEST, len(w)) + 1)}


def sketch_of(text: str | None, shingle: int = 3) -> int:
    """The smallest hash of a text's word shingles; copies and near copies mostly share it."""
    words = _WORD.findall((text or "").lower())
    grams = zip(*(words[k:] for k in range(shingle))) if len(words) >= shingle else [words]
    return min(xxhash.xxh64_intdigest(" ".join(g)) for g in grams) >> 1


def sketch_column(text: Column) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([sketch_of(t) for t in texts], dtype="int64")

    return of(text)


def select_insults(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> list[str]:
    """Prefixes that stand out, without those that a longer one replaces or a shorter one covers."""

    def stands_out(f: str) -> bool:
        a, b = toxic[f], clean.get(f, 0)
        if (a + 0.5) / (n_toxic + 1) < LEAST_ODDS * (b + 0.5) / (n_clean + 1):
            return False
        share = n_toxic / (n_toxic + n_clean)
        ratio = 2 * (a * math.log(a / ((a + b) * share)) + (b * math.log(b / ((a + b) * (1 - share))) if b else 0))
        return ratio >= LEAST_RATIO

    good = {f for f in toxic if stands_out(f)}
    replaced = {f[:-1] for f in good if len(f) > SHORTEST and toxic[f] >= 0.95 * toxic.get(f[:-1], 0)}
    chosen: list[str] = []
    for f in sorted(good - replaced, key=lambda f: (len(f), f)):
        if not any(f[:n] in chosen for n in range(SHORTEST, len(f))):
            chosen.append(f)
    return chosen


def fit_curve(counts: Iterable[tuple[float, int, int]], rounds: int = 50, ridge: float = 0.02) -> tuple[float, float]:
    """(intercept, slope) of a logistic curve over x / (x + 1) from (evidence x, label, count), by ridged Newton steps."""
    data = np.array([(x / (x + 1), y, n) for x, y, n in counts], dtype=float).reshape(-1, 3)
    both = len(set(data[data[:, 2] > 0, 1])) == 2
    if not both:
        return -4.0, 0.0
    x, y, n = np.c_[np.ones(len(data)), data[:, 0]], data[:, 1], data[:, 2]
    beta = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ beta))
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(2)
        beta = beta + np.linalg.solve(hessian, x.T @ (n * (y - p)) - ridge * beta)
    return float(beta[0]), float(beta[1])


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    labelled_rows: int = LABELLED_ROWS,
) -> tuple[list[str], float, float]:
    """(insult prefixes, intercept, slope) from labelled rows."""
    expect_long_texts(docs.sparkSession)
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("y")).filter("y is not null and doc_id is not null")
    total = marked.count()
    parts = 1 << 20
    picked = marked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < min(parts, parts * labelled_rows // max(1, total)))
    # about labelled_rows rows of two numbers
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "doc_id")
    sketched = read.select("text", "y", sketch_column(F.col("text")).alias("sketch"))
    sample = cut(sketched.groupBy("sketch", "y").agg(F.min("text").alias("text")).select("text", "y"))
    sizes = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return [], *fit_curve([])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for y, texts in batch.groupby("y")["text"]:
                n = Counter(f for text in texts for f in stems_of(text))
                if n:
                    yield pd.DataFrame({"f": [*n.keys()], "y": y, "n": [*n.values()]})

    stems = sample.filter("y in (0, 1)").select("text", F.col("y").cast("int").alias("y")).mapInPandas(count, "f string, y int, n long")
    counts = stems.groupBy("f").agg(*[F.coalesce(F.sum(F.when(F.col("y") == y, F.col("n"))), F.lit(0)).alias(name) for y, name in ((1, "a"), (0, "b"))])
    odds = (F.col("a") + 0.5) / (n_toxic + 1) >= LEAST_ODDS * (F.col("b") + 0.5) / (n_clean + 1)
    likely = counts.filter((F.col("a") >= LEAST_ROWS) & odds).collect()
    toxic, clean = {r.f: r.a for r in likely}, {r.f: r.b for r in likely}
    insults = select_insults(toxic, clean, n_toxic, n_clean)
    seen = sample.select("y", F.round(evidence_column(F.col("text"), insults), 1).alias("x")).groupBy("x", "y").count().collect()
    return insults, *fit_curve((r.x, r.y, r["count"]) for r in seen)


def evidence_column(text: Column, insults: list[str]) -> Column:
    """Each text's evidence under the grammar."""

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(insults)
        for texts in batches:
            yield pd.Series([scorer.evidence(text) for text in texts], dtype="float64")

    return of(text)


def score_toxicity(
    docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **how
) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence for every row; labels of held-out rows are never read."""
    insults, intercept, slope = fit(docs.filter(~held_out), labels.filter(~held_out), id_col, text_col, **how)
    scored = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), evidence_column(F.col(text_col), insults).alias("evidence"))
    score = 1 / (1 + F.exp(-(F.lit(intercept) + F.lit(slope) * F.col("evidence") / (F.col("evidence") + 1))))
    return scored.withColumn("score", score).select(
        "doc_id", "held_out", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "evidence"
    )
