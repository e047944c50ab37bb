"""Replay of move sequences on a board: one small state a game, Spark deals and sorts the games."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

REPLAYED = "game long, move_no int, color string, place int, problem string, captured int, group_size int, liberties int, ko int, black int, white int"


class Board:
    """Stones of each side as the bits of a number (row-major); groups are found by flood fill when they are needed."""

    def __init__(self, size: int):
        self.size, self.black, self.white, self.ko = size, 0, 0, -1
        self.whole = (1 << size * size) - 1
        self.left = sum(1 << row * size for row in range(size))
        self.right = self.left << size - 1

    @property
    def stones(self) -> dict[int, str]:
        """Color by place."""
        return {p: "B" if self.black >> p & 1 else "W" for p in range(self.size * self.size) if (self.black | self.white) >> p & 1}

    def around(self, points: int) -> int:
        """The points and those beside them."""
        beside = (points & ~self.right) << 1 | (points & ~self.left) >> 1
        return (points | beside | points << self.size | points >> self.size) & self.whole

    def group(self, point: int, side: int) -> tuple[int, int]:
        """The stones of a point's group among a side's, and its liberties."""
        stones = point
        while (more := self.around(stones) & side) != stones:
            stones = more
        return stones, self.around(stones) & ~(self.black | self.white)

    def play(self, color: str, p: int | None) -> tuple[str | None, int, int, int]:
        """(problem, captured, group size, liberties); a pass or a rejected move changes no stone."""
        if p is None:
            self.ko = -1
            return None, 0, 0, 0
        point = 1 << p
        if (self.black | self.white) & point:
            return "illegal_occupied", 0, 0, 0
        if p == self.ko:
            return "illegal_ko", 0, 0, 0
        before = self.black, self.white
        if color == "B":
            self.black |= point
        else:
            self.white |= point
        other = self.white if color == "B" else self.black
        taken, near = 0, self.around(point) & other
        while near:
            stones, liberties = self.group(near & -near, other)
            near &= ~stones
            if not liberties:
                taken |= stones
        if color == "B":
            self.white &= ~taken
        else:
            self.black &= ~taken
        own, liberties = self.group(point, self.black if color == "B" else self.white)
        if not liberties:
            self.black, self.white = before
            return "illegal_suicide", 0, 0, 0
        self.ko = taken.bit_length() - 1 if taken.bit_count() == 1 and own == point else -1
        return None, taken.bit_count(), own.bit_count(), liberties.bit_count()


def replay_game(rows: Iterable[tuple[int, str, int | None]], size: int = 19) -> list[tuple]:
    """The moves of one game with what each did, up to and with the first that is not legal."""
    board, out = Board(size), []
    for number, color, place in rows:
        problem, captured, group_size, liberties = board.play(color, None if place is None or place < 0 else int(place))
        out.append((number, color, -1 if place is None else place, problem, captured, group_size, liberties, board.ko, board.black.bit_count(), board.white.bit_count()))
        if problem:
            break
    return out


def replay(moves: DataFrame, size: int = 19, rows: int = 20_000) -> DataFrame:
    """REPLAYED columns from moves (game, move_no, color, place; a place below 0 is a pass), whole batches of games at once.

    A game's moves follow each other in one partition, sorted outside memory; a task holds one game and ``rows`` results.
    """
    names = ["game", "move_no", "color", "place"]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string(), *[pa.int32()] * 6]
    fields = [c.split()[0] for c in REPLAYED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        game, own = None, []

        def taken() -> pa.RecordBatch:
            batch = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done), kinds)], fields)
            done.clear()
            return batch

        for batch in batches:
            for key, *move in zip(*(batch[c].to_pylist() for c in names)):
                if own and key != game:
                    done.extend((game, *r) for r in replay_game(own, size))
                    own = []
                    if len(done) >= rows:
                        yield taken()
                game = key
                own.append(move)
        if own:
            done.extend((game, *r) for r in replay_game(own, size))
        if done:
            yield taken()

    return moves.select(*names).repartition("game").sortWithinPartitions("game", "move_no").mapInArrow(run, REPLAYED)
