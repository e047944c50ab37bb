"""Token counts of whole texts under a unigram vocabulary, by dynamic programming over a shared trie.

A text is cut into pre-tokens at white space; each is marked at its start and split into pieces so that the sum of
piece scores is largest. The best score of a prefix depends on the prefix alone, so distinct pre-tokens are inserted
in one trie and the forward score is computed once for each node, however many pre-tokens run through it; every node
also holds its best split's number of pieces, which is the count where a pre-token ends. Counts of a text are then
lookups. Characters that no piece covers count one token for each UTF-8 byte.

The trie lives in a worker and is bounded: past ``most_nodes`` it is dropped before the next text with an unseen
pre-token and begun anew, which changes no count. Nothing is shuffled.

The public vocabularies here have no unigram probabilities, so a piece's score is the log frequency that its rank has
under Zipf's law; user-defined scores can be given instead.

Cases: null and empty texts have no pre-tokens and no tokens. Ties between splits of equal score go to fewer pieces.
Repeated rows are counted alike. A text of any length is counted whole, and a pre-token of any length goes through the
trie, one node a character. Further columns never matter, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kifu_spark.session import expect_long_texts

MOST_NODES = 1_200_000
MARK = "▁"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: What str.split() takes for white space besides blank and the controls 9 to 13.
_RARE_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_tries: dict[str, Trie] = {}


def zipf_scores(path: str) -> dict[str, float]:
    """Scores of the ordinary pieces of a sentencepiece file, by rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
    total = math.log(sum(1 / (k + 10) for k in range(len(plain))))
    return {piece: -math.log(k + 10) - total for k, piece in enumerate(plain)}


class Trie:
    """The trie of inserted pre-tokens: a node for each prefix, with its forward score and the pieces of its best split.

    A node is found by its parent's number and its character; ``known`` holds the count of each whole pre-token.
    """

    def __init__(self, scores: dict[str, float], most_nodes: int = MOST_NODES):
        self.scores, self.most_nodes = scores, most_nodes
        self.byte_score = min(scores.values(), default=-10.0) - 10.0
        lengths: dict[str, set[int]] = {}
        for piece in scores:
            if len(piece) > 1:
                lengths.setdefault(piece[-2:], set()).add(len(piece))
        self.ending = {tail: tuple(sorted(found)) for tail, found in lengths.items()}  # piece lengths by last two characters
        self.clear()

    def clear(self) -> None:
        """Only the node of the mark alone."""
        self.node: dict[int, int] = {}
        self.known: dict[str, int] = {}
        score, pieces = self._best(MARK, 1, lambda n: (0.0, 0))
        self.forward, self.pieces = array("d", [score]), array("L", [pieces])

    def _best(self, text: str, end: int, at) -> tuple[float, int]:
        """The best (score, pieces) of text[:end]; at gives those of a shorter prefix by its length."""
        char = text[end - 1]
        score, pieces = at(end - 1)
        own = self.scores.get(char)
        if own is None:
            size = len(char.encode("utf-8", "surrogatepass"))
            best, least = score + size * self.byte_score, pieces + size
        else:
            best, least = score + own, pieces + 1
        for n in self.ending.get(text[end - 2 : end], ()) if end > 1 else ():
            if n > end:
                break
            own = self.scores.get(text[end - n : end])
            if own is not None:
                score, pieces = at(end - n)
                score += own
                if score > best or (score == best and pieces < least):
                    best, least = score, pieces + 1
        return best, least

    def _grow(self, word: str) -> int:
        """Insert one pre-token and give its count."""
        text, at_node, forward, pieces = MARK + word, 0, self.forward, self.pieces
        path = [0]  # the nodes of the prefixes, from the mark on

        def at(n: int) -> tuple[float, int]:
            return (forward[path[n - 1]], pieces[path[n - 1]]) if n else (0.0, 0)

        for end, char in enumerate(word, 2):
            key = at_node << 21 | ord(char)
            found = self.node.get(key)
            if found is None:
                score, count = self._best(text, end, at)
                found = self.node[key] = len(forward)
                forward.append(score)
                pieces.append(count)
            path.append(found)
            at_node = found
        self.known[word] = pieces[at_node]
        return pieces[at_node]

    def insert(self, word: str) -> int:
        """Tokens of one pre-token."""
        return self.tokens([word])

    def tokens(self, words: list[str]) -> int:
        """Tokens of all pre-tokens of a text."""
        try:
            return sum(map(self.known.__getitem__, words))
        except KeyError:
            if len(self.forward) > self.most_nodes:
                self.clear()
            for word in dict.fromkeys(words):
                if word not in self.known:
                    self._grow(word)
            return sum(map(self.known.__getitem__, words))


def pre_tokens(text: str | None) -> list[str]:
    """The words of a text, by the white space rule of all operators here."""
    if not text:
        return []
    return _WORD.findall(text) if _RARE_SPACE.search(text) else text.split()


def count_column(text: Column, path: str, most_nodes: int = MOST_NODES) -> Column:
    """struct<pre_tokens, tokens> of each text, under a sentencepiece vocabulary."""

    @F.pandas_udf("pre_tokens long, tokens long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if path not in _tries:
            _tries[path] = Trie(zipf_scores(path), most_nodes)
        trie = _tries[path]
        for texts in batches:
            words = [pre_tokens(text) for text in texts]
            yield pd.DataFrame({"pre_tokens": [len(w) for w in words], "tokens": [trie.tokens(w) for w in words]}, dtype="int64")

    return of(text)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", most_nodes: int = MOST_NODES) -> DataFrame:
    """doc_id, pre_tokens, tokens for every row."""
    expect_long_texts(docs.sparkSession)
    counted = docs.select(F.col(id_col).alias("doc_id"), count_column(F.col(text_col), path, most_nodes).alias("n"))
    return counted.select("doc_id", "n.pre_tokens", "n.tokens")
