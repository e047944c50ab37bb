"""Repeated passages against brute force: repeated rows, one identifier with several texts, null identifiers."""

import re

import pytest

from kifu_spark.llm import repeats

LINE = "one two three four five six"
ROWS = [
    (1, f"{LINE}\nfirst of all these words here"), (1, f"{LINE}\nfirst of all these words here"), (1, f"Short.\n{LINE.upper()}\nanother tail of five words"),
    (2, "Another quite different text that must not be cut at all."), (2, f"{LINE} \t\n{LINE}"), (None, LINE), (None, LINE), (None, "all alone with its five words"),
    (3, None), (4, ""), (5, "word " * 50_000), (5, "word " * 50_000),
]


def by_hand(rows):
    """(row, unit, start, end, copies, keep row, keep unit) of every occurrence to remove."""
    found = {}
    for row, (doc_id, text) in enumerate(rows):
        at = 0
        for unit, piece in enumerate(re.findall(r"[^\n.!?]*[\n.!?]+|[^\n.!?]+", text or "")):
            norm = " ".join(piece.lower().split())
            if len(norm.split()) >= 5:
                found.setdefault(norm, []).append(((doc_id is None, doc_id or 0, unit, at, at + len(piece), row), row, unit, at, at + len(piece)))
            at += len(piece)
    out = []
    for group in found.values():
        first, *rest = sorted(group)
        out += [(rows[r][0], unit, start, end, len(group), rows[first[1]][0], first[2]) for _, r, unit, start, end in rest]
    return sorted(out, key=str), found


@pytest.mark.parametrize("share", [1 / 1024, 0.3, 1.0])
def test_occurrences_of_rows(spark, share):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "'clash' as copies", "7 as row")
    got = repeats.repeated_units(df, hot_share=share).collect()
    assert sorted([(r.doc_id, r.unit, r.start, r.end, r.copies, r.keep_doc_id, r.keep_unit) for r in got], key=str) == by_hand(ROWS)[0]


def test_each_row_loses_its_own_units(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "'clash' as copies", "7 as row")
    left = repeats.without_repeats(df)
    assert left.columns == df.columns and left.count() == len(ROWS)
    texts = sorted([(r.doc_id, r.text) for r in left.collect()], key=str)
    whole, found = f"{LINE}\nfirst of all these words here", by_hand(ROWS)[1]
    assert sorted(t or "" for d, t in texts if d == 1) == sorted(["", whole, "Short.\nanother tail of five words"])
    assert sorted(t for d, t in texts if d == 2) == ["", ROWS[3][1]]
    assert sorted(t for d, t in texts if d is None) == ["", "", ROWS[7][1]]
    assert sorted(t for d, t in texts if d == 5) == ["", "word " * 50_000]
    assert len(found) == 6


def test_sql_counts_rows_too(spark):
    import duckdb
    import pandas as pd

    from kifu_spark.llm import queries

    documents = pd.DataFrame({"doc_id": pd.array([r[0] for r in ROWS], dtype="Int64"), "text": [r[1] for r in ROWS]})  # noqa: F841
    got = duckdb.connect().execute(queries.OP3_SQL).fetchall()
    assert sorted([(d, u, s, e, c, k, ku) for d, u, s, e, _, c, k, ku in got], key=str) == by_hand(ROWS)[0]
