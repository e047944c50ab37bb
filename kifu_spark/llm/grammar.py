"""Weighted finite-state transducers over small alphabets, and their composition into one table."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field


@dataclass
class Transducer:
    """A deterministic transducer that starts in state 0.

    arcs: (state, input) -> (next state, output, weight). An input without an arc is copied, at no weight, and leaves
    the state as it is, unless ``default`` names the next state for that state.
    """

    arcs: dict[tuple[int, str], tuple[int, str, float]]
    default: dict[int, int] = field(default_factory=dict)

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        found = self.arcs.get((state, symbol))
        return found if found else (self.default.get(state, state), symbol, 0.0)


class Composed:
    """The composition of transducers, each reading what the one before writes: one table of reachable states."""

    def __init__(self, parts: list[Transducer], alphabet: Iterable[str]):
        self.alphabet = tuple(alphabet)
        start = (0,) * len(parts)
        number, todo = {start: 0}, [start]
        self.table: dict[tuple[int, str], tuple[int, float]] = {}
        while todo:
            states = todo.pop()
            for symbol in self.alphabet:
                out, total, after = symbol, 0.0, []
                for part, state in zip(parts, states):
                    to, out, weight = part.step(state, out)
                    after.append(to)
                    total += weight
                reached = tuple(after)
                if reached not in number:
                    number[reached] = len(number)
                    todo.append(reached)
                self.table[number[states], symbol] = (number[reached], total)

    def weight(self, symbols: Iterable[str]) -> float:
        """The weight of the path that reads the symbols from the start."""
        state, total = 0, 0.0
        for symbol in symbols:
            state, weight = self.table[state, symbol]
            total += weight
        return total
