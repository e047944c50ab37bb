"""Formatted chats: read back, expanded, and escaped texts against plain Python."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kifu_spark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
PIECES = ["<turn", "</turn>", "<\\turn:user>", "<\\\\/turn>\n", "\\", "<", ">", "\n", "### Assistant: ", "\\l", "ü", "𝄞", "", "a b"]


def by_hand(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def read(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(chat.format_chats(df)).collect()}


def odd_rows():
    rows = [(c, t, ["system", "user", "assistant"][min(t, 1 + (t + 1) % 2)], "".join(PIECES[(c * 7 + t * k) % len(PIECES)] for k in range(5))) for c in range(40) for t in range(c % 7)]
    rows += [(100, 0, None, None), (100, None, "assistant", "first"), (100, 1, "assistant", ""), (None, 0, "user", "x"), (None, 1, "assistant", "y")]
    rows += [(101, 0, "assistant", "same")] * 3 + [(102, 0, "a<b>\\l\\", "</turn>\n"), (103, 5, "user", "no reply"), (104, 0, "assistant", "long " * 200_000)]
    return rows + [(105, t, ["user", "assistant"][t % 2], f"{t} <turn:") for t in range(2500)]


def test_read_back_is_what_went_in(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(7).withColumn("position", F.lit("clash")).withColumn("body", F.lit(0))
    assert read(df) == by_hand(rows)
    assert read(df.limit(0)) == {}


def test_expanded_examples_hold_all_turns_before(spark):
    rows = [r for r in odd_rows() if r[0] != 105]
    formatted = chat.format_chats(spark.createDataFrame(rows, SCHEMA))
    got = sorted((str(r.conv_id), r.example, r.text, r.text[r.loss_start : r.loss_end]) for r in chat.expanded(formatted).collect())
    expected = []
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        text, example = "", 0
        for *_, role, said in turns:
            role_out = role.replace("\\", "\\\\").replace("<", "\\l").replace(">", "\\g")
            said_out = chat.re.sub(chat.LOOKALIKE, r"<\\\1", said)
            text += f"<turn:{role_out}>{said_out}</turn>\n"
            if role == "assistant":
                expected.append((str(conv), example, text, said_out))
                example += 1
    assert got == sorted(expected)
    counted = {str(r.conv_id): (r.examples, r.expanded_chars, r.formatted_chars) for r in chat.read_back(formatted).collect()}
    for conv, (examples, chars, _) in counted.items():
        assert examples == sum(g[0] == conv for g in got) and chars == sum(len(g[2]) for g in got if g[0] == conv)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES)).map("".join) | st.text())
def test_escapes_are_reversible(text):
    escaped = chat.re.sub(chat.LOOKALIKE, r"<\\\1", text)
    assert chat.plain_text(escaped) == text and "<turn" not in escaped and "</turn" not in escaped
    role = text.replace("\\", "\\\\").replace("<", "\\l").replace(">", "\\g")
    assert chat.plain_role(role) == text


def test_stored_turns_read_back_in_any_order(spark, tmp_path):
    rows = odd_rows()
    chat.format_chats(spark.createDataFrame(rows, SCHEMA)).repartition(5).write.parquet(str(tmp_path / "turns"))
    again = chat.read_back(chat.in_order(spark.read.parquet(str(tmp_path / "turns"))))
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in again.collect()} == by_hand(rows)


def test_digests_are_read_from_expanded_examples(spark, monkeypatch):
    rows = [r for r in odd_rows() if r[0] in (3, 5, 6, 102, 103)]
    batch = chat.format_chats(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "position").toArrow().combine_chunks().to_batches()
    made = list(chat._expansions(iter(batch)))
    wanted = by_hand(rows)
    for conv in wanted:
        texts = [m for m in made if m[0] == conv]
        digest = chat.Digest()
        for _, text, _, start, end in texts[:-1]:
            assert text[end:] == chat.CLOSE and texts[-1][1].startswith(text)
            digest.add(text, start, end)
        digest.close(texts[-1][1])
        assert digest.row()[:4] == wanted[conv] and digest.row()[5] == len(texts) - 1
    from pytest import raises

    cut = chat.Digest()
    cut.add("<turn:user>a</turn>\n<turn:assistant>b</turn>\n", 36, 37)
    with raises(ValueError):  # an example that lost a turn of its context
        cut.add("<turn:assistant>b</turn>\n<turn:assistant>c</turn>\n", 41, 42)
