"""Packing of very long white space, wide identifiers beside nulls, clashing columns and repeated rows."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kifu_spark.llm import packing

BPE = public_tokenizers.path("byte_bpe_50k.json")
RUNS = [" " * 2_000_000 + "a", "\n" * 2_000_000, " \n" * 1_000_000 + "a", "x" + "\t" * 10_000 + "y", " " * 9_999 + "z"]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(BPE)


def test_long_white_space_equals_the_tokenizer(plain):
    ours = packing.Encoder(BPE)
    for text in RUNS:
        assert ours.ids(text) == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_other_vocabularies_are_left_to_the_tokenizer(tmp_path, plain):
    import json

    file = json.loads(plain.to_str())
    file["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(file))
    other = packing.Encoder(str(path))
    assert other.fast is None
    assert other.ids("a b") == np.array(Tokenizer.from_file(str(path)).encode("a b", add_special_tokens=False).ids, "<u4").tobytes()


def test_wide_identifiers_nulls_and_clashing_names(spark, plain):
    rows = [(2**53 + 1, "one", 7, "x"), (2**53 + 3, "two", 8, "x"), (None, "three", 9, "x"), (None, RUNS[2], 9, "x"), (2**63 - 1, "é " * 9000, 1, "x")]
    rows += [(5, "again and again", 0, "x")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, piece long, length string")
    got = packing.pack_documents(df, BPE, group_pieces=8).collect()
    want = []
    for doc_id, text, *_ in rows:
        ids = plain.encode(text, add_special_tokens=False).ids + [0]
        for k, (start, n) in enumerate(packing.piece_bounds(len(ids))):
            want.append((str(doc_id), k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        ends = [0, *(o + n for o, n in sorted(parts))]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048
