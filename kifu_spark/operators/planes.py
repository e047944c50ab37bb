"""Batches of bit-packed planes: packed, turned by a seeded choice of each place, and unpacked, in Arrow buffers.

Planes of size x size points with some features each are flat flags, the features of a point side by side. Packed, eight
flags take a byte, the first in the highest bit, so a row is a binary of fixed length. Decoding turns each row under one
of the eight symmetries by a permutation of points, whole batches at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kifu_spark.operators.grids import SYMMETRIES, source_index
from kifu_spark.operators.ranking import seeded_key


def seeded_view(seed: int, place: Column) -> Column:
    """One of the eight symmetries, a pure function of seed and place."""
    return F.conv(F.substring(seeded_key(seed, place), 1, 8), 16, 10).cast("long") % SYMMETRIES


def _extended(df: DataFrame, drop: list[str], added: str) -> StructType:
    return StructType([f for f in df.schema.fields if f.name not in drop] + StructType.fromDDL(added).fields)


def pack_planes(rows: DataFrame, flags: str, size: int, features: int, out: str = "packed") -> DataFrame:
    """rows with the array of flags (0 or 1, none null) as a binary of fixed length; a wrong number of flags is an error, null stays null."""
    count = size * size * features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch[flags]
            lengths = column.value_lengths().drop_null().to_numpy(zero_copy_only=False)
            if (lengths != count).any():
                raise ValueError(f"a row has {lengths[lengths != count][0]} flags, not {count}")
            bits = column.flatten().to_numpy(zero_copy_only=False).astype(np.uint8).reshape(-1, count)
            packed = iter(np.packbits(bits, axis=1))
            values = [next(packed).tobytes() if there else None for there in column.is_valid().to_pylist()]
            others = [n for n in batch.schema.names if n != flags]
            yield pa.record_batch([*(batch[n] for n in others), pa.array(values, pa.binary())], [*others, out])

    return rows.mapInArrow(run, _extended(rows, [flags], f"`{out}` binary"))


def point_permutations(size: int) -> np.ndarray:
    """By symmetry, for each point of the turned board the point of the original that comes there."""
    return np.array([source_index(k, size) for k in range(SYMMETRIES)])


def decode_planes(rows: DataFrame, packed: str, view: str, size: int, features: int, label: str | None = None, out: str = "planes") -> DataFrame:
    """rows with the planes of each under its view (0 to 7), as an array of bytes, and the label point's place in that view.

    The binary column goes; a label off the board or null has a null place.
    """
    count = size * size * features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = point_permutations(size)
        places = turns.argsort(axis=1)  # where a point goes
        for batch in batches:
            views = batch[view].to_numpy(zero_copy_only=False).astype(np.int64)
            raw = np.frombuffer(b"".join(batch[packed].to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            bits = np.unpackbits(raw, axis=1, count=count).reshape(batch.num_rows, size * size, features)
            turned = np.take_along_axis(bits, turns[views][:, :, None], axis=1).reshape(-1)
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * count)
            planes = pa.ListArray.from_arrays(offsets, pa.array(turned.astype(np.int8)))
            names = [n for n in batch.schema.names if n != packed]
            columns = [batch[n] for n in names]
            if label:
                found = [int(p) if p is not None and 0 <= p < size * size else None for p in batch[label].to_pylist()]
                columns.append(pa.array([None if p is None else int(places[v, p]) for p, v in zip(found, views)], pa.int32()))
            yield pa.record_batch([*columns, planes], [*names, *(["view_label"] if label else []), out])

    added = ("view_label int, " if label else "") + f"`{out}` array<tinyint>"
    return rows.mapInArrow(run, _extended(rows, [packed], added))
