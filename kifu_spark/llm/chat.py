"""Chat formatting by prefix-target expansion.

A conversation's turns are written one after the other by a template, each between control strings::

    <turn:user>text</turn>

Every assistant turn is an example of its own: all text before its reply is context and only the reply is trainable. An
example therefore is a prefix of its conversation's formatted text, with the target from ``loss_start`` to ``loss_end``.
Turns are stored once, with these offsets, and every example is made from them with its whole context when it is used:
``expanded`` writes them as rows and ``read_back`` reads each of them.

Control strings inside texts are escaped: ``<turn`` and ``</turn``, with any number of backslashes after ``<``, get one
more backslash there, which reading takes away again; all other texts stay as they are. In a role, ``\\``, ``<`` and ``>``
become ``\\\\``, ``\\l`` and ``\\g``.

Rows of a conversation meet in one task, sorted outside memory, as its order is one sequence; memory holds an Arrow batch
and the formatted text of one conversation, and the time of a conversation grows with the square of its turns.

Cases: null texts and null roles count as empty. Rows are ordered by turn (nulls first), equal turns by role and text,
and repeated rows stay. Rows without conversation identifier are one conversation. Conversations without assistant have
no example and no loss text, but are formatted. Texts of any length are one cell. Further columns never matter, whatever
their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

TRAINED = "assistant"
CLOSE = "</turn>\n"
#: A lookalike of a control string in a text, for Java and Python alike.
LOOKALIKE, ESCAPED = r"<(\\*/?turn)", r"<\\(\\*/?turn)"
_TURN = re.compile(r"<turn:([^<>]*)>(.*?)</turn>\n", re.DOTALL)
_ROLE = {r"\\": "\\", r"\l": "<", r"\g": ">"}


def escaped_text(text: Column) -> Column:
    return F.regexp_replace(text, LOOKALIKE, r"<\\$1")


def escaped_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def plain_text(text: str) -> str:
    """A formatted text without its escapes."""
    return re.sub(ESCAPED, r"<\1", text) if "<\\" in text else text


def plain_role(role: str) -> str:
    return re.sub(r"\\[\\lg]", lambda m: _ROLE[m[0]], role)


def format_chats(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row for each turn: conv_id, position, start (its place in the conversation's formatted text), body, and for
    an assistant turn the example's number, loss_start and loss_end; positions are Unicode code points."""
    empty = F.lit("")
    turns = conversations.select(
        F.col(id_col).alias("conv_id"), "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")
    )
    head = F.concat(F.lit("<turn:"), escaped_role(F.col("role")), F.lit(">"))
    written = turns.repartition("conv_id").withColumns({"head": head, "body": F.concat(head, escaped_text(F.col("text")), F.lit(CLOSE))})
    line = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    is_trained = F.col("role") == TRAINED
    return (
        written.withColumns(
            {
                "position": F.row_number().over(line).cast("long") - 1,
                "start": F.sum(F.length("body").cast("long")).over(upto) - F.length("body"),
                "nth": F.sum(is_trained.cast("long")).over(upto) - 1,
            }
        )
        .withColumns(
            {
                "example": F.when(is_trained, F.col("nth")),
                "loss_start": F.when(is_trained, F.col("start") + F.length("head")),
                "loss_end": F.when(is_trained, F.col("start") + F.length("body") - len(CLOSE)),
            }
        )
        .select("conv_id", "position", "start", "body", "example", "loss_start", "loss_end")
    )


def in_order(formatted: DataFrame) -> DataFrame:
    """Formatted turns that were stored and read again, so that those of a conversation follow each other in one partition."""
    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "position")


def _columns(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch[c].to_pylist() for c in names))


def _expansions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """conv_id, text, example, loss_start, loss_end of each example with its whole context, and at a conversation's end
    its whole text as no example."""
    parts: list[str] = []
    key, length = None, 0
    for batch in batches:
        for conv, position, start, body, *example in _columns(batch, "conv_id", "position", "start", "body", "example", "loss_start", "loss_end"):
            if position == 0:
                if parts:
                    yield key, "".join(parts), None, None, None
                parts, key, length = [], conv, 0
            if start != length:
                raise ValueError("formatted turns do not follow each other")
            parts.append(body)
            length += len(body)
            if example[0] is not None:
                parts = ["".join(parts)]
                yield key, parts[0], *example
    if parts:
        yield key, "".join(parts), None, None, None


def expanded(formatted: DataFrame) -> DataFrame:
    """conv_id, example, text, loss_start, loss_end: every example with its whole context, as one text.

    The texts of a conversation grow with the square of its turns, and its formatted text must fit in a worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, text, *example in _expansions(batches):
            if example[0] is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([conv], kind), pa.array([text]), *(pa.array([x], pa.int64()) for x in example)],
                    ["conv_id", "text", "example", "loss_start", "loss_end"],
                )

    kind = to_arrow_type(formatted.schema["conv_id"].dataType)
    out = StructType([formatted.schema["conv_id"], *StructType.fromDDL("text string, example long, loss_start long, loss_end long").fields])
    return in_order(formatted).mapInArrow(run, out)


class Digest:
    """What is read back of one conversation's examples."""

    def __init__(self) -> None:
        self.turns, self.loss, self.context = hashlib.sha256(), hashlib.sha256(), ""
        self.n_turns = self.loss_chars = self.formatted_chars = self.examples = self.expanded_chars = 0

    def add(self, text: str, loss_start: int, loss_end: int) -> None:
        """An example, which goes on from the one before it: the loss mask has its target."""
        if not text.startswith(self.context) or loss_start < len(self.context):
            raise ValueError("an example does not hold the turns before it")
        target = plain_text(text[loss_start:loss_end])
        self.loss.update(target.encode("utf-8", "surrogatepass"))
        self.loss_chars += len(target)
        self.examples += 1
        self.expanded_chars += len(text)
        self.context = text

    def close(self, text: str) -> None:
        """The whole conversation."""
        if not text.startswith(self.context):
            raise ValueError("a conversation does not go on from its examples")
        for turn in _TURN.finditer(text):
            if turn.start() != self.formatted_chars:
                break
            self.turns.update(f"{plain_role(turn[1])}\n{plain_text(turn[2])}\n".encode("utf-8", "surrogatepass"))
            self.n_turns += 1
            self.formatted_chars = turn.end()
        if self.formatted_chars != len(text):
            raise ValueError("a conversation is not written as turns")

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars, self.examples, self.expanded_chars


DIGEST_SCHEMA = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, examples long, expanded_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """By conversation, counts and digests of what its expanded examples and its whole text say.

    The turns come as ``format_chats`` or ``in_order`` leave them, one conversation in one partition. Its examples are
    made and read one after the other where its turns are, so that none travels; its formatted text must fit in a worker.
    """
    out = StructType([formatted.schema["conv_id"], *StructType.fromDDL(DIGEST_SCHEMA).fields])
    names, kinds = out.fieldNames(), [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    kind = to_arrow_type(formatted.schema["conv_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        own = Digest()

        def taken() -> pa.RecordBatch:
            columns = list(zip(*done))
            done.clear()
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, [kind, *kinds])], names)

        for conv, text, example, *loss in _expansions(batches):
            if example is not None:
                own.add(text, *loss)
                continue
            own.close(text)
            done.append((conv, *own.row()))
            own = Digest()
            if len(done) >= 1000:
                yield taken()
        if done:
            yield taken()

    return formatted.sortWithinPartitions("conv_id", "position").mapInArrow(run, out)
