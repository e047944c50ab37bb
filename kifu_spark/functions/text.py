"""Text columns: patterns with nulls, key=value lists, escapes, and rows that may be damaged."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def matched(text: Column, pattern: str, group: int = 1) -> Column:
    """A pattern's group where it matches, else null; an empty group stays empty."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def key_values(text: Column, between: str, sign: str) -> Column:
    """map<string,string> of a list of key=value parts; the first sign splits, and the last of equal keys counts."""
    parts = F.filter(F.split(text, between), lambda p: p.contains(sign))
    entries = F.transform(parts, lambda p: F.struct(F.substring_index(p, sign, 1).alias("key"), F.substring(p, F.instr(p, sign) + 1, F.length(p)).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(last)


def escaped(text: Column) -> Column:
    """Backslashes and closing brackets with a backslash before them."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("]"), F.lit("\\]"))


def unescaped(text: Column) -> Column:
    """A backslash makes the character after it stand for itself."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def quoted(text: Column) -> Column:
    """A literal in single quotes, in double ones where only single quotes occur in it; line ends, tabs and backslashes escaped."""
    body = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for plain, escape in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(plain), F.lit(escape))
    double = text.contains("'") & ~text.contains('"')
    single = F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(single)


def unquoted(literal: Column) -> Column:
    """The text of a quoted literal: its outer quotes go, and escapes of quotes, backslashes, line ends and tabs are undone."""
    parts = F.split(F.substring(literal, F.lit(2), F.length(literal) - 2), r"\\\\")  # between escaped backslashes no escape spans two parts

    def undone(part: Column) -> Column:
        for escape, plain in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\'", "'"), ('\\"', '"')):
            part = F.replace(part, F.lit(escape), F.lit(plain))
        return part

    return F.array_join(F.transform(parts, undone), "\\")


def parsed_or_damaged(line: Column, schema: str) -> Column:
    """struct<value, damaged>: a JSON line under a schema; one that does not parse has no value and is marked."""
    parsed = F.from_json(line, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    bad = line.isNull() | parsed["_bad"].isNotNull()
    return F.struct(F.when(~bad, parsed).alias("value"), bad.alias("damaged"))
