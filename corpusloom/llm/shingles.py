"""Word runs as native expressions: lower-cased runs of letters, digits and underscores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), "")


def runs(word: Column, n: int) -> Column:
    """Distinct 64-bit hashes of all runs of ``n`` words."""
    at = lambda i: F.xxhash64(*(F.get(word, i + j) for j in range(n)))
    return F.when(F.size(word) >= n, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(word) - n), at))).otherwise(F.array().cast("array<bigint>"))
