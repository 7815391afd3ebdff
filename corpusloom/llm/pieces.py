"""Global order without whole groups: ranges of sorted rows whose groups may begin and end in any of them.

``ranged`` sorts a table over all its partitions. A function that streams one of them sees every
group as a piece: one that begins after the partition's first row and ends before its last is whole, and
can be finished there; the others are open and meet their neighbours later, as a few rows each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame

from ..session import ship
from .store import width


def ranged(df: DataFrame, *keys: str | Column) -> DataFrame:
    """``df`` in the order of ``keys``, nulls first, over partitions of about equal numbers of rows."""
    return df.repartitionByRange(width(df.sparkSession), *keys).sortWithinPartitions(*keys)


def streamed(df: DataFrame, make: Callable[[int, Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """``make``(number of the partition, its rows in order) for each partition; a batch of rows is in memory at a time."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(df.sparkSession)
    arrow = to_arrow_schema(_parse_datatype_string(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        def rows() -> Iterator[dict]:
            for b in batches:
                names = b.schema.names
                for values in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    yield dict(zip(names, values, strict=True))

        out: list[dict] = []
        size = 0
        for row in make(TaskContext.get().partitionId(), rows()):
            out.append(row)
            size += sum(len(v) for v in row.values() if isinstance(v, str | bytes | list))
            if len(out) >= 1000 or size > 4_000_000:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.mapInArrow(run, schema)


def with_last(rows: Iterator[dict]) -> Iterator[tuple[dict, bool]]:
    """Each row, and whether it is the last."""
    held = next(rows, None)
    while held is not None:
        after = next(rows, None)
        yield held, after is None
        held = after
