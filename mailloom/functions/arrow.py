"""Arrow columns worked on in pieces, so what Python holds at once doesn't depend on how large Spark's batches are."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a piece, about; a longer value ends its piece.
PIECE = 1 << 20


def _sizes(values: pa.Array) -> np.ndarray:
    """Bytes of each value, about."""
    if pa.types.is_list(values.type):
        lengths = pc.multiply(pc.list_value_length(values), 8)
    elif pa.types.is_string(values.type) or pa.types.is_binary(values.type):
        lengths = pc.binary_length(values)
    else:
        return np.full(len(values), 16)
    return pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16


def spans(*columns: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Where the pieces of columns of one length begin and end."""
    if len(columns[0]):
        sizes = sum(map(_sizes, columns))
        cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // size)) + 1
        yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(columns[0])])


def _list(values: pa.Array) -> list:
    """The values; lists of numbers without an object of Arrow for each number."""
    if not pa.types.is_list(values.type) or not pa.types.is_integer(values.type.value_type) or values.flatten().null_count:
        return values.to_pylist()
    flat, ends = values.flatten().to_numpy().tolist(), np.cumsum(pc.fill_null(pc.list_value_length(values), 0).to_numpy()).tolist()
    return [flat[a:b] if there else None for a, b, there in zip([0, *ends], ends, values.is_valid().to_pylist())]


def number_lists(rows: list[list[int] | None]) -> pa.Array:
    """Lists of numbers as an array of lists of int."""
    counts = np.array([0 if x is None else len(x) for x in rows], np.int32)
    ends = np.cumsum(counts, dtype=np.int32)
    flat = np.fromiter(chain.from_iterable(x for x in rows if x), np.int32, int(counts.sum()))
    mask = pa.array([x is None for x in rows], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(np.r_[np.int32(0), ends], pa.int32()), pa.array(flat), mask=mask)


def lists(*columns: pa.Array, size: int = PIECE) -> Iterator[tuple[list, ...]]:
    """The values of columns as lists, a piece at a time."""
    for a, b in spans(*columns, size=size):
        yield tuple(_list(c.slice(a, b - a)) for c in columns)


def in_pieces(function: Callable[..., list | pa.Array], kind: str, arrow: pa.DataType, *columns: Column) -> Column:
    """A column of a type (of Spark and of Arrow) by a function that turns lists of the columns' values into a list (or array) as long; each piece is
    handed on as soon as it is done."""

    def made(rows: list | pa.Array) -> pa.Array:
        return rows if isinstance(rows, pa.Array) else pa.array(rows, arrow)

    @F.arrow_udf(kind)
    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for values in lists(batch):
                yield made(function(*values))

    @F.arrow_udf(kind)
    def two(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in batches:
            for values in lists(*batch):
                yield made(function(*values))

    return (one if len(columns) == 1 else two)(*columns)
