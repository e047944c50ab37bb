"""Record trees against a plain reader of nested texts."""

import random
import re

from pyspark.sql import functions as F

from kifu_spark.operators import record_trees as trees

TEXTS = {
    "plain": "(;GM[1];B[aa];W[bb])",
    "forks": "(;GM[1];B[aa](;W[bb];B[cc](;W[dd])(;W[ee]))(;W[ff](;B[gg])(;B[hh];W[ii])))",
    "escapes": "junk ;X (;C[a\\]b(;)\\\\];B[aa]\n(;W[b;b]C[(;\\\n)])(;W[tt]N[\\]\\)]))",
    "cut off": "(;B[aa](;W[bb];B[c",
    "cut off at a backslash": "(;B[aa];C[x\\",
    "two trees": "(;B[aa];W[bb])(;B[cc](;W[dd])(;W[ee]))",
    "bracket too many": "(;B[aa];W[bb]))(;B[cc])",
    "after a variation": "(;B[aa](;W[bb]);W[cc](;B[dd])(;B[ee]))",
    "nothing before": "((;B[zz](;W[yy]);B[xx]);B[aa](;W[bb]))",
    "empty groups": "(()(;B[aa])",
    "no nodes": "()",
    "nothing": "",
}


def by_hand(text):
    """(parent, depth, branch, properties) by node number, by walking the characters with a stack."""
    nodes, groups, kids = [], [], {}
    at, dead = 0, []
    while at < len(text):
        c = text[at]
        if c == "(":
            hangs = groups[-1] if groups else "top"
            groups.append(hangs if isinstance(hangs, int) else ("root" if hangs == "top" else "lost"))
            dead.append((dead[-1] if dead else False) or (bool(groups[:-1]) and not isinstance(hangs, int)))
        elif c == ")":
            if not groups:
                break
            groups.pop()
            dead.pop()
        elif c == ";":
            end, inside = at + 1, False
            while end < len(text) and (inside or text[end] not in ";()"):
                if inside and text[end] == "\\":
                    end += 1
                elif text[end] == "[" and not inside:
                    inside = True
                elif text[end] == "]":
                    inside = False
                end += 1
            end = min(end, len(text))
            if groups:
                parent = groups[-1] if isinstance(groups[-1], int) else None
                number = len(nodes)
                nodes.append(None if dead[-1] else (parent, 0 if parent is None else nodes[parent][1] + 1, kids.get(parent, 0), text[at + 1 : end]))
                if not dead[-1]:
                    kids[parent] = kids.get(parent, 0) + 1
                groups[-1] = number
            at = end - 1
        at += 1
    return {i: n for i, n in enumerate(nodes) if n}


def found(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "path string, text string").withColumn("left", F.lit("clash"))
    out = {k: {} for k in texts}
    rows = trees.record_nodes(df).collect()
    for r in rows:
        out[r.path][r.node] = (r.parent, r.depth, r.branch, r.properties)
    return out, rows


def played_by_hand(nodes):
    line, at = [], next((i for i, n in nodes.items() if n[0] is None), None)
    while at is not None:
        line.append(at)
        at = next((i for i, n in nodes.items() if n[0] == at), None)
    return line


def test_trees_by_hand(spark):
    got, rows = found(spark, TEXTS)
    expected = {k: by_hand(t) for k, t in TEXTS.items()}
    assert got == expected
    for key, nodes in expected.items():
        mine = [r for r in rows if r.path == key]
        assert sorted(r.node for r in mine if r.played) == played_by_hand(nodes)
        for r in mine:  # what lies between the places is what is below
            below = {x.node for x in mine if r.left < x.left < r.right}
            up = {i for i in nodes if r.node in ancestors(nodes, i)}
            assert below == up and (not below or r["last"] >= max(below))


def ancestors(nodes, i):
    out = set()
    while (i := nodes[i][0]) is not None:
        out.add(i)
    return out


def random_text(rng, deep=0):
    out = "("
    for _ in range(rng.randint(1, 4)):
        value = "".join(rng.choice("ab;()[\\]") for _ in range(rng.randint(0, 5))).replace("\\", "\\\\").replace("]", "\\]")
        out += ";" + rng.choice(["B", "W ", "C\n"]) + f"[{value}]" * rng.randint(0, 2)
    for _ in range(rng.choice([0, 0, 1, 2, 3]) if deep < 5 else 0):
        out += random_text(rng, deep + 1)
    return out + ")"


def test_random_trees(spark):
    rng = random.Random(8)
    texts = {str(i): random_text(rng) for i in range(60)}
    texts["long"] = "(" + "".join(f";{'BW'[i % 2]}[aa](;N[{i}])(" for i in range(400)) + ";E[]" + ")" * 401
    assert found(spark, texts)[0] == {k: by_hand(t) for k, t in texts.items()}


def test_played_moves(spark):
    texts = {"a": "(;B[zz]GM[1];B[aa](;W[tt];C[x];B[];W[bb]C[;])(;W[cc]))", "b": "(;GM[1])"}
    nodes = trees.record_nodes(spark.createDataFrame(list(texts.items()), "path string, text string"))
    rows = {r.path: [tuple(m) for m in r.moves] for r in trees.played_moves(nodes).collect()}
    assert rows == {"a": [("B", "aa"), ("W", ""), ("B", ""), ("W", "bb")]}
    ends = {(r.path, r.node, r.played) for r in trees.last_moves(nodes).collect()}
    assert ends == {("a", 5, True), ("a", 6, False), ("b", 0, True)}
    assert re.compile(trees.MOVE)


def test_packed_planes(spark):
    import numpy as np
    import pytest

    from kifu_spark.operators import grids, planes

    rng = np.random.default_rng(2)
    flags = rng.integers(0, 2, (40, 5 * 5 * 3))
    rows = [(i, f.tolist(), i % 8, None if i == 3 else i % 27) for i, f in enumerate(flags)]
    df = spark.createDataFrame(rows, "id long, flags array<int>, view int, label int").repartition(3)
    packed = planes.pack_planes(df, "flags", 5, 3)
    assert {r.id: r.packed for r in packed.collect()} == {i: np.packbits(f.astype(np.uint8)).tobytes() for i, f in enumerate(flags)}
    for r in planes.decode_planes(packed, "packed", "view", 5, 3, "label").collect():
        source = grids.source_index(r.view, 5)
        assert (np.array(r.planes).reshape(25, 3) == flags[r.id].reshape(25, 3)[source]).all()
        assert r.view_label == (source.index(r.label) if r.label is not None and r.label < 25 else None)
    with pytest.raises(Exception, match="flags, not 50"):
        planes.pack_planes(df, "flags", 5, 2).collect()
    assert planes.decode_planes(packed.limit(0), "packed", "view", 5, 3).count() == 0


def test_one_child_serves_all_batches(spark, tmp_path):
    import sys

    from kifu_spark.sources.scorer import score_with

    starts = tmp_path / "starts"
    code = (
        "import sys, json, os, random\n"
        f"open({str(starts)!r}, 'a').write('x')\n"
        "held = []\n"
        "print('ready', flush=True)\n"
        "for line in iter(sys.stdin.readline, ''):\n"
        "    held.append(json.loads(line))\n"
        "    if len(held) >= 5:\n"
        "        r = held.pop(random.randrange(5))\n"
        "        print(json.dumps({'id': r['id'], 'turn': r['turn'], 'warning': 'odd'}), flush=True)\n"
        "        print(json.dumps({'id': r['id'], 'turn': r['turn'], 'lead': float(r['request'])}), flush=True)\n"
        "for r in held: print(json.dumps({'id': r['id'], 'turn': r['turn'], 'lead': float(r['request'])}), flush=True)\n"
    )
    rows = [(f"g{i}", t, str(i + t / 10)) for i in range(100) for t in range(5)]
    asked = spark.createDataFrame(rows, "id string, turn int, request string").coalesce(1)
    usual = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = {(r.id, r.turn): r.lead for r in score_with(asked, [sys.executable, "-c", code], in_flight=16).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", usual)
    assert got == {(i, t): float(x) for i, t, x in rows} and starts.read_text() == "x"
