"""An inverted file of vectors: k-means cells, probed nearest first, and widened until the answer is certain.

Cells are fitted on at most ``SAMPLE`` vectors, picked by a hash of the id (a documented bound; cells only decide what is read,
never what is right). Every vector is stored under its nearest cell, a folder each, large cells in several files, with each cell's
widest angle and greatest length. A search reads the cells nearest to each query first. Then, for exact answers, it reads those
whose bound

    |q| * length(cell) * cos(max(0, angle(q, centre) - widest(cell)))

reaches the k-th score found so far; no other cell can hold a better one. Without ``exact`` it stops after the probes, whose number
``probes_for`` finds by measured recall. A cell is scored for its own queries only.

Edge cases: null ids and vectors are left out; fewer vectors than cells make fewer cells; vectors of length 0 have angle 0 to
every centre; equal vectors share a cell, however many; an empty table has no hits; queries with equal ids count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..config import RETRIEVAL
from ..session import ship
from .dense import BLOCK, Best, column_array, matrix_of
from .tables import blocks, shared_dir, stored

SAMPLE, MOST_CELLS, ROUNDS = 20_000, 1024, 12
ROWS_PER_FILE = 100_000


@dataclass
class Cells:
    """``table``: cell, id, embedding, stored by cell; the rest is one row a cell."""

    table: DataFrame
    centres: np.ndarray
    rows: np.ndarray
    widest: np.ndarray
    longest: np.ndarray

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Greatest score that a cell can hold, by query (rows) and cell."""
        length = np.linalg.norm(queries, axis=1)
        near = np.cos(np.maximum(0.0, angles(queries, self.centres) - self.widest[None, :]))
        return np.where(self.rows > 0, length[:, None] * np.where(near > 0, self.longest[None, :] * near, 0.0), -np.inf)


def angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Between vectors and centres of length 1."""
    length = np.maximum(np.linalg.norm(x, axis=1), 1e-300)
    return np.arccos(np.clip(x @ centres.T / length[:, None], -1.0, 1.0))


def fit(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 3) -> np.ndarray:
    """Spherical k-means: centres of length 1, drawn far apart first."""
    unit = sample / np.maximum(np.linalg.norm(sample, axis=1), 1e-300)[:, None]
    rng = np.random.default_rng(seed)
    centres, far = [unit[int(rng.integers(len(unit)))]], np.full(len(unit), np.inf)
    while len(centres) < cells:
        far = np.minimum(far, np.maximum(0.0, 1 - unit @ centres[-1]))
        if far.sum() <= 1e-9:  # no further direction
            break
        centres.append(unit[int(rng.choice(len(unit), p=far / far.sum()))])
    c = np.array(centres)
    for _ in range(rounds):
        own = (unit @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, unit)
        length = np.linalg.norm(sums, axis=1)
        c = np.where(length[:, None] > 1e-12, sums / np.maximum(length, 1e-300)[:, None], c)
    return c


def build(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> Cells:
    """The inverted file of ``vectors`` (id, embedding), stored in the shared folder."""
    spark = vectors.sparkSession
    ship(spark)
    given = vectors.filter("embedding IS NOT NULL AND id IS NOT NULL").select("id", "embedding")
    n = given.count()
    cells = cells or int(np.clip(round(n**0.5), 1, MOST_CELLS))
    share = min(1.0, 1.2 * sample / max(n, 1))
    some = given.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("embedding").limit(sample).collect()
    drawn = np.array([r["embedding"] for r in some], dtype=np.float64)
    centres = fit(drawn, cells) if len(drawn) else np.zeros((1, 1))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix_of(b.column("embedding"))
                by_cell = angles(x, centres)
                cell = by_cell.argmin(axis=1)
                angle, length = by_cell[np.arange(len(x)), cell], np.linalg.norm(x, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), b.column("id"), b.column("embedding"), pa.array(angle), pa.array(length)], names=["cell", "id", "embedding", "angle", "length"])

    fields = [T.StructField("cell", T.IntegerType()), given.schema["id"], given.schema["embedding"], T.StructField("angle", T.DoubleType()), T.StructField("length", T.DoubleType())]
    placed = stored(given.mapInArrow(place, T.StructType(fields)), "cells-placed")
    about = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("widest"), F.max("length").alias("longest")).collect()  # a row a cell
    rows, widest, longest = np.zeros(len(centres), dtype=np.int64), np.zeros(len(centres)), np.zeros(len(centres))
    for r in about:
        rows[r["cell"]], widest[r["cell"]], longest[r["cell"]] = r["n"], r["widest"], r["longest"]
    path = f"{shared_dir(spark)}/cells-{id(placed)}-{abs(hash(placed.stored_at))}"
    files = F.get(F.array(*(F.lit(int(-(-x // ROWS_PER_FILE)) or 1) for x in rows)), F.col("cell"))
    split = F.pmod(F.xxhash64("id"), files.cast("long"))
    placed.select("cell", "id", "embedding").repartition("cell", split).write.partitionBy("cell").parquet(path)
    table = spark.read.schema(T.StructType([*fields[1:3], fields[0]])).parquet(path)
    return Cells(table, centres, rows, widest + 1e-9, longest * (1 + 1e-12))


def _scored(index: Cells, ids: list, matrix: np.ndarray, probes: np.ndarray, kind: T.DataType, k: int, not_itself: bool) -> DataFrame:
    """The best of the cells that ``probes`` (queries by cells) names, each for its own queries; other cells are not read."""
    cells = np.flatnonzero(probes.any(axis=0) & (index.rows > 0))
    schema = T.StructType([T.StructField("query_id", kind), index.table.schema["id"], T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)
    place = {q: i for i, q in enumerate(ids)} if not_itself else {}

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            cell = b.column("cell").to_numpy()
            own, x = column_array(b.column("id")), matrix_of(b.column("embedding"))
            held = held or Best(k, len(ids), own)
            for c in np.unique(cell):
                rows, columns = np.flatnonzero(cell == c), np.flatnonzero(probes[:, c])
                rows = rows[np.argsort(own[rows], kind="stable")]
                score = x[rows] @ matrix[columns].T
                if not_itself:
                    to = {q: i for i, q in enumerate(columns.tolist())}
                    for i, name in enumerate(own[rows].tolist()):
                        if place.get(name) in to:
                            score[i, to[place[name]]] = -np.inf
                held.add(own[rows], score, columns)
        if held is not None:
            at, q = np.nonzero(np.isfinite(held.score))
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in q], arrow.field(0).type), pa.array(held.id[at, q], arrow.field(1).type), pa.array(held.score[at, q])], schema=arrow)

    return index.table.filter(F.col("cell").isin([int(c) for c in cells])).select("id", "embedding", "cell").mapInArrow(best, schema)


def nearest(index: Cells, matrix: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` cells of greatest cosine to each query, as queries by cells."""
    out = np.zeros((len(matrix), len(index.centres)), dtype=bool)
    order = np.argsort(angles(matrix, index.centres) + np.where(index.rows > 0, 0.0, 10.0)[None, :], axis=1, kind="stable")[:, :probes]
    np.put_along_axis(out, order, True, axis=1)
    return out


def search(index: Cells, queries: DataFrame, k: int = RETRIEVAL.candidates, probes: int = 4, exact: bool = True, not_itself: bool = False, reads: list | None = None) -> DataFrame:
    """query_id, id, score, rank (from 1) of the k best; ``queries``: query_id, embedding. ``reads`` gets the vectors compared in each pass, summed over queries."""
    ship(queries.sparkSession)
    each = queries.groupBy("query_id").agg(F.min("embedding").alias("embedding"))
    kind = queries.schema["query_id"].dataType

    def block(some: DataFrame) -> DataFrame:
        asked = some.orderBy("query_id").collect()  # of one block
        ids = [r["query_id"] for r in asked]
        if not ids or not index.rows.sum():
            return _scored(index, ids, np.zeros((0, 1)), np.zeros((0, len(index.rows)), dtype=bool), kind, k, False)
        matrix = np.array([r["embedding"] for r in asked], dtype=np.float64)
        first = nearest(index, matrix, probes)
        found = stored(_scored(index, ids, matrix, first, kind, k, not_itself), "cells-found")
        note(first)
        if not exact:
            return found
        order = Window.partitionBy("query_id").orderBy(F.desc("score"))
        kth = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k).select("query_id", "score").collect()  # one a query of the block
        least = np.full(len(ids), -np.inf)
        at = {q: i for i, q in enumerate(ids)}
        for r in kth:
            least[at[r["query_id"]]] = r["score"]
        more = (index.bounds(matrix) >= least[:, None] - 1e-8) & ~first
        note(more)
        return found.unionByName(_scored(index, ids, matrix, more, kind, k, not_itself)) if more.any() else found

    def note(probed: np.ndarray) -> None:
        if reads is not None:
            reads.append(int((probed @ index.rows).sum()))

    found = reduce(DataFrame.unionByName, [block(b) for b in blocks(each, BLOCK)])
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def probes_for(index: Cells, queries: DataFrame, recall: float = 0.95, k: int = RETRIEVAL.candidates, most: int = 200) -> tuple[int, float]:
    """The least power of two of probes whose answers hold ``recall`` of the exact ones over up to ``most`` of the queries (by hash), and the recall measured."""
    some = stored(queries.orderBy(F.xxhash64("query_id")).limit(most), "cells-queries")
    want = stored(search(index, some, k).select("query_id", "id"), "cells-exact")
    n, probes = want.count(), 1
    while True:
        got = search(index, some, k, probes, exact=False).select("query_id", "id").join(want, ["query_id", "id"]).count()
        if got >= recall * n or probes >= len(index.rows):
            return probes, got / max(n, 1)
        probes *= 2
