"""Square grids kept as flat arrays: symmetries, bit packing, vertices and distributions, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the column letters of board vertices, without I.
COLUMN_LETTERS = "ABCDEFGHJKLMNOPQRST"
SYMMETRIES = 8


def source_index(symmetry: int, size: int) -> list[int]:
    """For each place of the turned grid, the place of the original that comes there: rotations 0-3, then mirrored ones."""
    found = []
    for row in range(size):
        for column in range(size):
            r, c = row, column
            if symmetry >= 4:
                c = size - 1 - c
            for _ in range(symmetry % 4):
                r, c = c, size - 1 - r
            found.append(r * size + c)
    return found


def turned(grid: Column, symmetry: int, size: int) -> Column:
    """The grid under one of the eight symmetries."""
    places = F.array(*[F.lit(i) for i in source_index(symmetry, size)])
    return F.transform(places, lambda i: F.element_at(grid, i + 1))


def turned_place(place: Column, symmetry: int, size: int) -> Column:
    """Where a place of the original grid goes under the symmetry."""
    inverse = [0] * (size * size)
    for to, source in enumerate(source_index(symmetry, size)):
        inverse[source] = to
    return F.element_at(F.array(*[F.lit(i) for i in inverse]), place + 1)


def packed_bits(flags: Column, size: int) -> Column:
    """Hex of the flags packed to bytes, first flag in the highest bit, zero-padded at the end."""
    padded = F.concat(flags, F.array_repeat(F.lit(0), -size % 8))
    byte = lambda row, at: F.aggregate(F.slice(row, at * 8 + 1, 8), F.lit(0), lambda a, x: a * 2 + x)
    places = F.sequence(F.lit(0), F.lit((size + 7) // 8 - 1))
    # flags are bound once for all bytes
    return F.transform(F.array(padded), lambda row: F.array_join(F.transform(places, lambda k: F.lpad(F.hex(byte(row, k)), 2, "0")), ""))[0]


def vertex(place: Column, size: int) -> Column:
    """A row-major place as a vertex: column letter and row number from the bottom."""
    letter = F.substring(F.lit(COLUMN_LETTERS), F.pmod(place, F.lit(size)) + 1, F.lit(1))
    return F.concat(letter, (F.lit(size) - F.floor(place / size)).cast("string"))


def place_of_vertex(name: Column, size: int) -> Column:
    """The row-major place of a vertex; null for anything else, such as a pass."""
    column = F.instr(F.lit(COLUMN_LETTERS), F.upper(F.substring(name, 1, 1))) - 1
    row = F.lit(size) - F.expr("1") * F.substring(name, 2, 2).try_cast("int")
    return F.when((column >= 0) & (column < size) & (row >= 0) & (row < size), row * size + column)


def softmax(weights: Column, temperature: float = 1.0) -> Column:
    """Weights as a distribution, shifted by their maximum first."""
    top = F.array_max(weights)
    powers = F.transform(weights, lambda x: F.exp((x - top) / temperature))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, y: a + y))


def entropy(shares: Column, least: float = 1e-12) -> Column:
    """Entropy of a distribution; shares are held above a small value."""
    return -F.aggregate(shares, F.lit(0.0), lambda a, p: a + p * F.ln(F.greatest(p, F.lit(least))))
