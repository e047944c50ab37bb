"""Properties of record trees with escapes, points, and what reports write of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kifu_spark.functions.text import escaped, unescaped

#: A bracketed value; a backslash takes the next character with it. Possessive, so that long values need no stack.
_INSIDE = r"[^\]\\]*+(?:\\.[^\]\\]*+)*+"
_VALUE = rf"\[{_INSIDE}\]"
_ROOT = rf"(?s)^\s*\(\s*;((?:\s*[A-Za-z]++\s*(?:{_VALUE}\s*)++)*+)"
_PROPERTY = rf"(?s)([A-Z]+)\s*((?:{_VALUE}\s*)++)"


def root_properties(text: Column) -> Column:
    """map<name, array of values> of a record's first node, values unescaped; null where the text opens no node."""
    node = F.regexp_extract(text, _ROOT, 1)
    names = F.regexp_extract_all(node, F.lit(_PROPERTY), F.lit(1))
    values = F.transform(
        F.regexp_extract_all(node, F.lit(_PROPERTY), F.lit(2)),
        lambda v: F.transform(F.regexp_extract_all(v, F.lit(rf"(?s)\[({_INSIDE})\]"), F.lit(1)), unescaped),
    )
    pairs = F.arrays_zip(names.alias("name"), values.alias("values"))
    first = F.filter(pairs, lambda p, i: F.array_position(names, p["name"]) == i + 1)  # of equal names the first counts
    return F.when(text.rlike(r"^\s*\(\s*;"), F.map_from_entries(F.transform(first, lambda p: F.struct(p["name"], p["values"]))))


def root_length(text: Column) -> Column:
    """How many characters the opening and the first node take."""
    return F.length(F.regexp_extract(text, _ROOT, 0))


def property_text(text: Column, name: str) -> Column:
    """A property's first value as written, escapes kept, white space at the ends off; no capital stands before the name. Empty without one."""
    value = F.regexp_extract(text, rf"(?s)(?<![A-Z]){name}\[({_INSIDE})\]", 1)
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def cut_off(text: Column) -> Column:
    """Whether a record's end is missing: no closing bracket, or a move that is not finished."""
    tail = F.rtrim(F.regexp_replace(text, r"\s+$", ""))
    return ~tail.endswith(")") | F.regexp_replace(tail, r"\)+$", "").rlike(r"[BW]\[[a-s]?$")


def point(place: Column, size: int) -> Column:
    """A row-major place as two letters, column and row from the top left; null is a pass, an empty point."""
    letter = lambda x: F.char(x + 97)
    return F.coalesce(F.concat(letter(F.pmod(place, F.lit(size))), letter(F.floor(place / size))), F.lit(""))


def place_of_point(name: Column, size: int) -> Column:
    """The row-major place of two letters in either case; null for a pass (empty or tt) and for anything off the board."""
    x, y = F.ascii(F.lower(F.substring(name, 1, 1))) - 97, F.ascii(F.lower(F.substring(name, 2, 1))) - 97
    on = (F.length(name) == 2) & (F.lower(name) != "tt") & x.between(0, size - 1) & y.between(0, size - 1)
    return F.when(on, y * size + x)


def short_percent(percent: Column) -> Column:
    """A percentage as a short label: one decimal from 1 on, two from 0.01 on, else one digit and an exponent."""
    power = F.floor(F.log10(F.nullif(percent, F.lit(0.0))))
    digit = F.round(percent / F.pow(F.lit(10.0), power), 0)
    small = F.when(digit >= 10, F.concat(F.lit("1e"), (power + 1).cast("long"))).otherwise(F.concat(digit.cast("int"), F.lit("e"), power.cast("long")))
    return F.when(percent >= 1, F.format_string("%.1f", percent)).when(percent >= 0.01, F.format_string("%.2f", percent)).otherwise(F.coalesce(small, F.lit("0e0")))


def ruleset_name(stated: Column) -> Column:
    """A ruleset by the start of its stated name: japanese, korean, else chinese."""
    low = F.lower(stated)
    return F.when(low.startswith("jap"), "japanese").when(low.startswith("kor"), "korean").otherwise("chinese")


def score_text(lead: Column) -> Column:
    """A judged lead (positive for Black) as a result: 0 under a quarter of a point."""
    side = F.when(lead > 0, "B+").otherwise("W+")
    return F.when(F.abs(lead) < 0.25, "0").otherwise(F.concat(side, F.format_string("%.1f", F.abs(lead))))


def pass_back(contested: Column, open_points: Column, border_moves: Column) -> Column:
    """What to do when the opponent passed: play on (unsettled), close the border, or the player's own rule.

    Fixed values: 10 contested points, 4 open points, 20 border moves.
    """
    return F.when(contested > 10, "play on").when((F.coalesce(open_points, F.lit(0)) > 4) & (border_moves < 20), "close the border").otherwise("own rule")


def commented_moves(line: Column, comments: Column) -> Column:
    """Nodes of moves (structs of color and point) with a comment each, escaped, where there is one; one node a line."""
    node = lambda m, c: F.concat(F.lit("\n;"), m["color"], F.lit("["), m["point"], F.lit("]"), F.when(c.isNotNull(), F.concat(F.lit("C["), escaped(c), F.lit("]"))).otherwise(""))
    return F.array_join(F.zip_with(line, comments, node), "")


def written_record(header: Column, black: Column, white: Column, nodes: Column) -> Column:
    """A record of header properties (map of name to value, escaped here), setup stones by color (arrays of points) and nodes."""
    props = F.array_join(F.transform(F.map_entries(header), lambda e: F.concat(e["key"], F.lit("["), escaped(e["value"]), F.lit("]"))), "")
    stones = lambda name, points: F.when(F.size(points) > 0, F.concat(F.lit(name), F.array_join(F.transform(points, lambda p: F.concat(F.lit("["), p, F.lit("]"))), ""))).otherwise("")
    return F.concat(F.lit("(;"), props, stones("AB", black), stones("AW", white), nodes, F.lit(")\n"))


def warm_up(step: Column, start: float, target: float, steps: int) -> Column:
    """A rate that rises linearly over the first steps and then stays."""
    return F.when(step > steps, F.lit(target)).otherwise(start + (target - start) * step / max(1, steps))


def sweep(step: Column, start: float, floor: float, ceiling: float, warm_steps: int, steps: int) -> Column:
    """A rate that warms up to the floor and then grows by equal factors to the ceiling."""
    part = F.least(F.lit(1.0), (step - warm_steps) / steps)
    return F.when(step <= warm_steps, start + (floor - start) * step / max(1, warm_steps)).otherwise(floor * F.pow(F.lit(ceiling / floor), part))


def cosine(step: Column, start: float, target: float, warm_steps: int, total_steps: int) -> Column:
    """A rate that warms up linearly and falls along half a cosine to nothing at the last step."""
    part = F.least(F.lit(1.0), (step - warm_steps) / max(1, total_steps - warm_steps))
    rising = start + (target - start) * step / max(1, warm_steps)
    return F.when(step < warm_steps, rising).otherwise(target * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * part)))


def unpacked_bits(packed: Column, size: int) -> Column:
    """The flags of hex bytes, first flag in the highest bit: the inverse of packing."""
    places = F.sequence(F.lit(0), F.lit((size + 7) // 8 - 1))
    byte = lambda row, k: F.conv(F.substring(row, k * 2 + 1, F.lit(2)), 16, 10).cast("int")
    eight = lambda b: F.array(*[F.shiftright(b, 7 - i).bitwiseAND(F.lit(1)) for i in range(8)])
    # the bytes are bound once for all flags
    flags = F.transform(F.array(packed), lambda row: F.flatten(F.transform(F.transform(places, lambda k: byte(row, k)), eight)))[0]
    return F.slice(flags, 1, size)
