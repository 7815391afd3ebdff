"""Exact vector search and pluggable embeddings.

Passages stream by in Arrow batches against the query matrix, whose size is
checked; each task keeps the best k of every query, and only those are
shuffled: a batch is compared with the k-th best so far, and only what reaches it is
sorted. Ids are of any type. Beyond the check, the queries are stored, numbered and taken in blocks
of exactly that size, each a pass over the passages.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..config import RETRIEVAL
from ..functions.text import l2_normalised
from ..session import ship
from .lexical import _counted
from .tables import blocks, column_array, ordered

#: Queries of one block: at 384 numbers each, 24 MB.
BLOCK = 8192


def hashed_embedding(passages: DataFrame, id: str = "id", text: str = "text", dim: int = 256) -> DataFrame:
    """A deterministic embedding of text: stems hashed to ``dim`` places by MD5, 1 + ln(tf), unit length."""
    return with_hashed_embedding(passages.select(F.col(id).alias("id"), F.col(text).alias("text")), "text", dim).select("id", "embedding")


def with_hashed_embedding(passages: DataFrame, text: str = "text", dim: int = 256) -> DataFrame:
    """``passages`` with that embedding of their text; each row is finished where it is read."""
    ship(passages.sparkSession)
    schema = T.StructType([*passages.schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType()))])
    at, names = passages.columns.index(text), [*passages.columns, "embedding"]

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.RecordBatch.from_arrays([pa.array(range(b.num_rows)), b.column(at)], names=["id", "text"])
            lists = next(_counted(iter([texts]))).column("terms")
            each, row = lists.flatten(), np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            term = each.field("term").dictionary_encode()
            place = np.array([int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dim for t in term.dictionary.to_pylist()], dtype=np.int64)[term.indices.to_numpy()]
            m = np.bincount(row * dim + place, 1 + np.log(each.field("tf").to_numpy()), b.num_rows * dim).reshape(-1, dim)
            m = m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-12)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, dim, dtype=np.int32)), pa.array(m.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*b.columns, vectors], names=names)

    return passages.mapInArrow(embed, schema)


def mean_pooled(states: DataFrame, key: str = "id", vector: str = "state", mask: str = "mask") -> DataFrame:
    """One unit vector a ``key``: the mean of its token vectors whose mask is 1, at unit length (zeros without any)."""
    each = states.select(key, F.col(mask).cast("double").alias("m"), F.posexplode(vector).alias("place", "x"))
    means = each.groupBy(key, "place").agg((F.sum(F.col("x").cast("double") * F.col("m")) / F.greatest(F.sum("m"), F.lit(1e-9))).alias("x"))
    rows = means.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "x"))).alias("xs"))
    return rows.select(key, l2_normalised(F.col("xs.x")).alias("embedding"))


def search(passages: DataFrame, queries: DataFrame, k: int = RETRIEVAL.candidates, not_itself: bool = False) -> DataFrame:
    """query_id, id, score, rank (from 1): the k best by dot product; ``passages``: id, embedding; ``queries``: query_id, embedding.

    ``not_itself`` leaves out the passage whose id is the query's. Of queries with equal ids the least embedding counts.
    """
    ship(passages.sparkSession)
    each = queries.groupBy("query_id").agg(F.min("embedding").alias("embedding"))
    return reduce(DataFrame.unionByName, (_best(passages, block, k, not_itself) for block in blocks(each, BLOCK)))


class Best:
    """The k best of each query so far: scores, and ids of any type, by score (to nine places), then id."""

    def __init__(self, k: int, n: int, ids: np.ndarray):
        self.score, self.rough = np.full((k, n), -np.inf), np.full((k, n), -np.inf)
        self.id = np.full((k, n), ids[0], dtype=ids.dtype)  # any id, where no score is
        self.k = k

    def add(self, ids: np.ndarray, score: np.ndarray, columns: np.ndarray | None = None) -> None:
        """Rows of passages (``ids`` ascending) by columns of queries; ``columns``: which ones, all without."""
        columns = np.arange(score.shape[1]) if columns is None else columns
        bar = self.rough[-1, columns] - 1e-9  # what rounding may add
        near = (score >= bar) & (score < np.inf)
        full = np.flatnonzero(near.sum(axis=0) > 2 * self.k)
        if len(full):  # none below the k-th best of these rows themselves
            those = np.where(near[:, full], score[:, full], -np.inf)
            near[:, full] &= score[:, full] >= np.partition(those, len(ids) - self.k, axis=0)[len(ids) - self.k] - 2e-9
        rows, cols = np.nonzero(near)
        real = np.isfinite(score[rows, cols])
        rows, cols = rows[real], cols[real]
        if not len(rows):
            return
        some, at = np.unique(cols, return_inverse=True)
        mine = columns[some]
        flat = lambda held: held[:, mine].T.reshape(-1)
        id_ = np.concatenate([flat(self.id), ids[rows]])
        score = np.concatenate([flat(self.score), score[rows, cols]])
        rough = np.concatenate([flat(self.rough), np.round(score[len(mine) * self.k :], 9)])
        column = np.concatenate([np.repeat(np.arange(len(some)), self.k), at])
        order = np.lexsort((ordered(id_), -rough, column))
        first = np.searchsorted(column[order], np.arange(len(some)))
        order = order[first[:, None] + np.arange(self.k)]  # each column has the k that it held and more
        for held, new in ((self.id, id_), (self.rough, rough), (self.score, score)):
            held[:, mine] = new[order].T


def matrix_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _best(passages: DataFrame, queries: DataFrame, k: int, not_itself: bool) -> DataFrame:
    asked = queries.orderBy("query_id").collect()  # of one block
    ids = [r["query_id"] for r in asked]
    matrix = np.array([r["embedding"] for r in asked], dtype=np.float64).T if asked else None
    place = {q: i for i, q in enumerate(ids)} if not_itself else {}
    kinds = [(n, df.schema[c].dataType) for n, df, c in (("query_id", queries, "query_id"), ("id", passages, "id"))]
    schema = T.StructType([*(T.StructField(n, t) for n, t in kinds), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for part in batches if matrix is not None else ():
            if not part.num_rows:
                continue
            own = column_array(part.column("id"))
            order = np.argsort(own, kind="stable")
            score = (matrix_of(part.column("embedding")) @ matrix)[order]
            own = own[order]
            if not_itself:
                for i, x in enumerate(own.tolist()):
                    if x in place:
                        score[i, place[x]] = -np.inf
            held = held or Best(k, len(ids), own)
            held.add(own, score)
        if held is not None:
            at, q = np.nonzero(np.isfinite(held.score))
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in q], arrow.field(0).type), pa.array(held.id[at, q], arrow.field(1).type), pa.array(held.score[at, q])], schema=arrow)

    found = passages.filter("embedding IS NOT NULL AND id IS NOT NULL").select("id", "embedding").mapInArrow(best, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
