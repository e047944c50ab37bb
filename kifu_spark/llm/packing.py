"""Sum-of-squares packing of token sequences.

A document is tokenised, closed with an end token and, only if longer than a sequence, cut into full pieces; the first
piece takes the remainder. Pieces are dealt by hash to groups of about ``group_pieces`` and each group is packed in
one task by the sum-of-squares rule: a piece goes where the sum over residual gaps of squared counts of open sequences
becomes smallest, a new sequence being one of the places. Pieces come largest first. The open sequences are only counts
per gap, so a group's state is one array of sequence length, and a group wastes at most a few open sequences at its end.

Only piece lengths and checksums are shuffled, never texts. Identifiers stay in Arrow columns, so that 64-bit ones
beside nulls keep every digit.

Cases: a null text is empty, and an empty text is the end token alone. Repeated rows are packed once each, and spread
over groups by their place in the table, as are rows without an identifier. A text of any length is encoded whole, in
one call; runs of white space over ``LONGEST_RUN`` go to the tokenizer itself. Further columns never matter, whatever
their names. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kifu_spark.session import cut, expect_long_texts

CAPACITY = 2048
END_ID = 0
GROUP_PIECES = 8192
COPIES_KEPT = 20_000
#: Longer runs of white space exhaust the stack of the fast encoder's pattern matcher.
LONGEST_RUN = 10_000

#: Texts with special tokens, controls, rare white space or characters beyond the basic plane are left to the tokenizer
#: itself; in all others both libraries read the same pre-token pattern alike.
_UNUSUAL = re.compile(
    "[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff\U00010000-\U0010ffff]"
)
_LONG_RUN = re.compile(rf"\s{{{LONGEST_RUN}}}")
_PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_encoders: dict[str, Encoder] = {}


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and number the others from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Encoder:
    """Token ids of a text as little-endian 32-bit bytes, for a byte-level BPE file of the tokenizers library.

    The file's vocabulary also drives tiktoken, which merges the same pairs in the same order about three times as
    fast. That needs ids in merge order, no normaliser, no prefix blank and the usual byte-level pre-token pattern,
    all checked when the file is read; any other file is left to the tokenizers library.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        file = json.loads(self.tokenizer.to_str())
        model, before = file["model"], file["pre_tokenizer"] or {}
        usual = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"]
        byte_of, vocab = _byte_of_char(), model["vocab"]
        merged = [vocab["".join(pair if isinstance(pair, list) else pair.split(" "))] for pair in model["merges"]]
        self.special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = None
        if merged == sorted(merged) and usual and not file["normalizer"] and not model.get("ignore_merges"):
            ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in self.special}
            special = {token: vocab.get(token, len(vocab) + k) for k, token in enumerate(self.special)}
            self.fast = tiktoken.Encoding("byte-level", pat_str=_PRE_TOKEN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> bytes:
        if self.fast is not None and not (_UNUSUAL.search(text) or any(token in text for token in self.special) or has_long_run(text)):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def has_long_run(text: str) -> bool:
    """Whether a text has a run of white space of LONGEST_RUN characters, which two neighbours of a sparse sample would hit."""
    if len(text) < LONGEST_RUN:
        return False
    sample = text[:: LONGEST_RUN // 3]
    return any(a.isspace() and b.isspace() for a, b in zip(sample, sample[1:])) and _LONG_RUN.search(text) is not None


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary file and worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def piece_bounds(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of each piece; only the first may be shorter than the capacity."""
    first = length % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, length, capacity))]


def pieces_column(text: Column, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> Column:
    """array<struct<start, length, ids_crc32>> of each text's pieces."""

    @F.pandas_udf("array<struct<start:long,length:long,ids_crc32:long>>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode, end = encoder(path), np.array([end_id], dtype="<u4").tobytes()
        known: dict[bytes, list[dict]] = {}  # pieces by the text's 128-bit digest: copies are encoded once a task
        for texts in batches:
            found = []
            for text in texts:
                digest = xxhash.xxh3_128_digest((text or "").encode("utf-8", "surrogatepass"))
                if (pieces := known.get(digest)) is None:
                    ids = encode.ids(text or "") + end
                    pieces = [
                        {"start": at, "length": n, "ids_crc32": zlib.crc32(ids[4 * at : 4 * (at + n)])}
                        for at, n in piece_bounds(len(ids) // 4, capacity)
                    ]
                    if len(known) >= COPIES_KEPT:
                        known.clear()
                    known[digest] = pieces
                found.append(pieces)
            yield pd.Series(found)

    return of(text)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length in order, by the sum-of-squares rule; ties go to the fuller sequence."""
    count = np.zeros(capacity + 1, dtype=np.int64)  # open sequences by gap
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, n in enumerate(lengths.tolist()):
        if n == capacity:
            sequence[i], offset[i], made = made, 0, made + 1
            continue
        gaps = np.flatnonzero(count[n:capacity]) + n
        best_gap, best = capacity, 2 * count[capacity - n] + 1
        if len(gaps):
            rise = 2 * (count[gaps - n] - count[gaps]) + 2
            if gaps[0] == n:
                rise[0] = 1 - 2 * count[n]
            at = int(rise.argmin())
            if rise[at] <= best:
                best_gap = int(gaps[at])
        if best_gap == capacity:
            number, made = made, made + 1
        else:
            number = open_by_gap[best_gap].pop()
            count[best_gap] -= 1
        sequence[i], offset[i] = number, capacity - best_gap
        if left := best_gap - n:
            open_by_gap[left].append(number)
            count[left] += 1
    return sequence, offset


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    expect_long_texts(docs.sparkSession)
    pieces = cut(
        docs.select(F.col(id_col).alias("doc_id"), pieces_column(F.col(text_col), tokenizer_path, capacity, end_id).alias("all"))
        .select("doc_id", F.posexplode("all").alias("piece", "one"))
        .select("doc_id", "piece", "one.*")
    )
    groups = max(1, round(pieces.count() / group_pieces))
    place = F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())
    dealt = pieces.withColumn("pack_group", F.pmod(place, F.lit(groups)))

    def pack(group: pa.Table) -> pa.Table:
        order = [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]
        group = group.take(pc.sort_indices(group, order))
        number, offset = sum_of_squares(group["length"].to_numpy(), capacity)
        number += group["pack_group"].to_numpy() << 32
        return group.drop_columns("pack_group").append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset))

    schema = f"doc_id {dict(pieces.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("pack_group").applyInArrow(pack, schema)
