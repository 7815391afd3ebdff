"""Whole groups out of sorted partitions, for Arrow functions: no group costs a call of its own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with the rows of a key in one partition, one after another."""
    return df.repartition(*keys).sortWithinPartitions(*keys)


def starts(table: pa.Table | pa.RecordBatch, keys: tuple[str, ...]) -> np.ndarray:
    """Where each group begins; keys are integers without nulls."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[:1] = True
    for k in keys:
        x = table.column(k).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of complete groups, with the place where each begins; at most one group waits for the next batch."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        came = pa.Table.from_batches([batch])
        held = came if held is None else pa.concat_tables([held, came])
        at = starts(held, keys)
        if len(at) > 1:
            yield held.slice(0, int(at[-1])), at[:-1]
            held = held.slice(int(at[-1]))
    if held is not None and held.num_rows:
        yield held, starts(held, keys)
