"""Language and toxicity scores against plain versions of their rules."""

import math
import random
import re
import unicodedata

import pytest

from kifu_spark.llm import langid, toxicity


def plain_language(text, labelled):
    """Language and share of the likelihood, one word and one n-gram at a time."""
    letters = lambda c: unicodedata.category(c).startswith("L")

    def words(t):
        return "".join(c if letters(c) else " " for c in (t or "").lower()).split(" ")

    langs = sorted({lang for lang, _ in labelled})
    counts = {"word": {}, "gram": {}}
    for lang, t in labelled:
        for w in filter(None, words(t)):
            counts["word"].setdefault(w, dict.fromkeys(langs, 0.5))[lang] += 1
            marked = f"<{w}>"
            for n in range(1, 5):
                for at in range(len(marked) - n + 1):
                    counts["gram"].setdefault(marked[at : at + n], dict.fromkeys(langs, 0.5))[lang] += 1
    whole = {kind: {lang: sum(c[lang] for c in table.values()) for lang in langs} for kind, table in counts.items()}

    def evidence(kind, key):
        logs = [math.log(counts[kind][key][lang] / whole[kind][lang]) for lang in langs]
        total = math.log(sum(math.exp(x - max(logs)) for x in logs)) + max(logs)
        return [x - total for x in logs]

    found = [0.0] * len(langs)
    said = [w for w in words(text) if w]
    for w in said:
        if w in counts["word"]:
            parts = [evidence("word", w)]
        else:
            marked, parts = f"<{w}>", []
            for at in range(len(marked)):
                known = [marked[at : at + n] for n in (4, 3, 2, 1) if at + n <= len(marked) and marked[at : at + n] in counts["gram"]]
                if known:
                    parts.append(evidence("gram", known[0]))
        for k in range(len(langs)):
            found[k] += sum(p[k] for p in parts) / max(1, len(parts))
    if not said:
        return "und", 0.0
    best = max(range(len(langs)), key=lambda k: (found[k], -k))
    return langs[best], 1 / sum(math.exp(x - found[best]) for x in found)


def test_language_scores_equal_a_plain_version(spark):
    rng, letters = random.Random(2), "abcdeé日½² 1_'"
    labelled = [("xy"[k % 2], "".join(rng.choice("abcde "[k % 2 :]) for _ in range(60))) for k in range(12)]
    docs = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(labelled)], "doc_id long, text string, lang string")
    scorer = langid.Scorer(langid.fit(docs), kept=3)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(200)] + ["½ ²", "①", "Ⅷ ⅷ", None, "", "日本", labelled[0][1] * 2000]
    for text in texts:
        (got, share), (want, right) = scorer.score(text), plain_language(text, labelled)
        assert got == want and share == pytest.approx(right, abs=1e-9), text


def plain_evidence(text, insults):
    """The four rules read in turn over each clause that holds an insult or a threat."""
    word = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
    fixed = {w: s for words, s in ((toxicity.INSULTS, "I"), (toxicity.THREATS, "K"), (toxicity.TARGETS, "T"), (toxicity.NEGATIONS, "N"), (toxicity.REPORTING, "R")) for w in words}
    total = 0.0
    for clause in re.split(r"[.!?;\n]", (text or "").lower()):
        line = [fixed.get(w) or ("I" if any(w.startswith(p) for p in insults) else "o") for w in word.findall(clause)]
        if not {"I", "K"} & {*line}:
            continue
        negated = told = aimed = harmed = threatened = 0
        for s in line:
            if s == "N":
                negated = 3
            elif s in "IK":
                soft = negated > 0 or told
                aim = (0.5 if aimed and not harmed else 0.0)
                harmed, negated = 1, 0
                total += aim + (0 if s == "K" else 0.5 if soft else 1.0)
                threatened = threatened or (s == "K" and not soft)
            else:
                if s == "T":
                    total += (0.5 if harmed and not aimed else 0.0) + (1.5 if threatened else 0.0)
                    aimed, threatened = 1, 0
                told = told or s == "R"
                negated = max(0, negated - 1)
    return total


def test_evidence_equals_a_plain_version():
    rng, insults = random.Random(4), ["zorp", "blarg"]
    words = ["you", "not", "said", "idiot", "kill", "zorping", "blargs", "tree", "walks", "isn't", "blar", ".", "!", ";", "\n", "du", "nicht", "Idiot", "stupidity"]
    scorer = toxicity.Scorer(insults)
    for _ in range(3000):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 25)))
        assert scorer.evidence(text) == pytest.approx(plain_evidence(text, insults)), text
    long = "the tree walks. " * 60_000 + "you idiot"
    assert scorer.evidence(long) == plain_evidence("you idiot", insults) and scorer.evidence(None) == 0
