"""Classification columns: first match, all matches, labelled bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_that_applies(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    """The name of the first rule that holds."""
    return F.coalesce(*[F.when(test, F.lit(name)) for name, test in rules], F.lit(otherwise))


def all_that_apply(rules: list[tuple[str, Column]]) -> Column:
    """The names of all rules that hold, in order."""
    return F.array_remove(F.array(*[F.when(test, F.lit(name)).otherwise("") for name, test in rules]), "")  # no name is empty


def binned(value: Column, edges: list[float]) -> Column:
    """Half-open labels: below the first edge, between edges, from the last on."""
    text = [f"{e:g}" for e in edges]
    inside = [F.when(value < high, F.lit(f"{a}-{b}")) for high, a, b in zip(edges[1:], text, text[1:])]
    return F.when(value.isNotNull(), F.coalesce(F.when(value < edges[0], F.lit(f"<{text[0]}")), *inside, F.lit(f">={text[-1]}")))


def bin_labels(edges: list[float]) -> list[str]:
    """Names of the half-open bins between the edges, and of the two outside them."""
    return [f"<{edges[0]}", *[f"{a}-{b}" for a, b in zip(edges, edges[1:])], f">={edges[-1]}"]


def in_bins(value: Column, edges: list[float]) -> Column:
    """The name of a number's bin; null stays null."""
    at = F.coalesce(*[F.when(value < e, F.lit(name)) for e, name in zip(edges, bin_labels(edges))], F.lit(bin_labels(edges)[-1]))
    return F.when(value.isNotNull(), at)


def bin_counts(values: Column, edges: list[float]) -> Column:
    """array<bigint> of how many of an array's values each bin holds, in the order of ``bin_labels``; null for a null array."""
    return place_counts(bin_places(values, edges), edges)


def bin_places(values: Column, edges: list[float]) -> Column:
    """For each of an array's values the number of its bin, in the order of ``bin_labels``; a null stays null."""

    def place(value: Column) -> Column:
        return F.coalesce(*[F.when(value < e, i) for i, e in enumerate(edges)], F.when(value.isNotNull(), len(edges)))

    return F.transform(values, place)


def place_counts(places: Column, edges: list[float]) -> Column:
    """array<bigint> of how many of an array's bin numbers are each bin's; null for a null array."""
    counts = [(F.size(places) - F.size(F.array_remove(places, i))).cast("long") for i in range(len(edges) + 1)]
    return F.when(places.isNotNull(), F.array(*counts))
