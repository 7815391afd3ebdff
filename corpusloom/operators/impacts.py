"""BM25 by blocks of impacts: passages in ranges, and of those only what can reach the best.

Passages get numbers in order of their ids and form ranges of ``SPAN``. The postings of a term in a range are one block: numbers
as differences, frequencies and lengths as packed arrays, and beside them the greatest impact

    tf (k1 + 1) / (tf + k1 (1 - b + b dl / avg))

of any of them. Blocks lie in folders by a hash of their term, sorted by term and range, so a search reads the folders of its own terms.
It goes twice over them. The first pass reads impacts only: the sum of weight times impact over a query's terms bounds all scores of a range. The ranges of
the ``FIRST`` greatest bounds of each query are scored, exactly, and the k-th score found is a threshold; then the ranges whose bound
reaches it are scored too. No other can hold a better passage, so answers equal those of the whole index.

Edge cases are those of ``lexical.search``: queries without a known term have no hits, ties go by the first term's place, then by id, equal ids of queries are one query.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..config import RETRIEVAL
from ..session import ship
from .lexical import Index, query_terms
from .tables import blocks as cut_blocks
from .tables import shared_dir, small, stored

SPAN, FIRST, FOLDERS = 1024, 4, 64
#: Queries of one block.
QUERIES = 1024
#: Ranges of one task at most.
STRETCHES = 1 << 30
FLAT = RETRIEVAL.k1 * (1 - RETRIEVAL.b)


@dataclass
class Impacts:
    """``table``: folder, term, range, n, top, data; ``passages``: n (in order of id), id; ``index``: what it was made from."""

    table: DataFrame
    passages: DataFrame
    index: Index
    span: int


def packed(gaps: np.ndarray, tf: np.ndarray, dl: np.ndarray) -> bytes:
    """Gaps below ``SPAN``, frequencies and lengths in the least whole number of bytes each."""
    out = []
    for x in (gaps, tf, dl):
        width = next(w for w in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << 8 * w)
        out.append(bytes([width]) + x.astype(f"<u{width}").tobytes())
    return b"".join(out)


def unpacked(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, out = 0, []
    for _ in range(3):
        width = data[at]
        out.append(np.frombuffer(data, f"<u{width}", n, at + 1).astype(np.int64))
        at += 1 + n * width
    return np.cumsum(out[0]), out[1], out[2]


def packed_blocks(at: np.ndarray, gaps: np.ndarray, tf: np.ndarray, dl: np.ndarray) -> pa.Array:
    """``packed`` of each block, all at once; ``at``: where blocks begin in the postings."""
    ends = np.r_[at[1:], len(gaps)]
    n = ends - at
    block = np.repeat(np.arange(len(at)), n)
    nth = np.arange(len(gaps)) - at[block]
    columns, widths = [x.astype(np.int64) for x in (gaps, tf, dl)], []
    for x in columns:
        top = np.maximum.reduceat(x, at)
        widths.append(np.select([top < 1 << 8, top < 1 << 16, top < 1 << 32], [1, 2, 4], 8))
    offsets = np.r_[0, np.cumsum(sum(1 + n * w for w in widths))]
    out, begin = np.zeros(int(offsets[-1]), dtype=np.uint8), offsets[:-1].copy()
    for x, width in zip(columns, widths, strict=True):
        out[begin] = width
        wide = width[block]
        place = begin[block] + 1 + nth * wide
        for byte in range(int(width.max())):
            some = slice(None) if byte == 0 else np.flatnonzero(wide > byte)
            out[place[some] + byte] = (x[some] >> 8 * byte) & 255
        begin += 1 + n * width
    return pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())


def build(index: Index, span: int = SPAN, folders: int = FOLDERS) -> Impacts:
    """The blocks of an index, stored in the shared folder.

    Passages are dealt by stretches of ids, once and with all their terms; a task numbers its own and makes their blocks, and only blocks are shuffled.
    Numbers of a task begin at ``STRETCHES`` ranges after those of the task before it, so they need not be counted first. The ids of a range are a row
    without a term, in a folder of their own.
    """
    spark = index.passages.sparkSession
    ship(spark)
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = index.passages.filter("id IS NOT NULL").select("id", F.col("dl").cast("long").alias("dl"), "terms").repartitionByRange(wide, "id").sortWithinPartitions("id")
    slope = RETRIEVAL.k1 * RETRIEVAL.b / (index.avg_len or 1.0)
    id_kind = T.ArrayType(index.passages.schema["id"].dataType)
    schema = T.StructType([*T._parse_datatype_string("term string, range long, n int, top double, data binary").fields, T.StructField("ids", id_kind)])
    arrow = to_arrow_schema(schema)

    def blocks_of(part: pa.Table, rng: int) -> Iterator[pa.RecordBatch]:
        """The blocks of a range's passages, which come in order, and its ids."""
        ids, lists = part.column("id").combine_chunks(), part.column("terms").combine_chunks()
        null = lambda kind: pa.nulls(1, kind)
        kinds = [f.type for f in arrow]
        yield pa.RecordBatch.from_arrays([null(kinds[0]), pa.array([rng]), pa.array([len(ids)], kinds[2]), null(kinds[3]), null(kinds[4]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids).cast(kinds[5])], schema=arrow)
        flat = lists.flatten()
        if not len(flat):
            return
        coded = flat.field("term").dictionary_encode()
        term, tf = coded.indices.to_numpy().astype(np.int64), flat.field("tf").to_numpy().astype(np.int64)
        n = np.repeat(np.arange(len(ids)), np.asarray(pc.list_value_length(lists)))
        order = np.argsort(term, kind="stable")
        term, tf, n = term[order], tf[order], n[order]
        dl = part.column("dl").to_numpy()[n]
        at = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
        gaps = np.diff(n, prepend=0)
        gaps[at] = n[at]
        impact = tf * (RETRIEVAL.k1 + 1) / (tf + FLAT + slope * dl)
        size = len(at)
        yield pa.RecordBatch.from_arrays(
            [coded.dictionary.take(pa.array(term[at])), pa.array(np.full(size, rng)), pa.array(np.diff(np.r_[at, len(term)]).astype(np.int32)), pa.array(np.maximum.reduceat(impact, at)), packed_blocks(at, gaps, tf, dl), pa.nulls(size, kinds[5])],
            schema=arrow,
        )

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng, held = TaskContext.get().partitionId() * STRETCHES, None
        for b in _with_end(batches):
            if b is not None:
                came = pa.Table.from_batches([b])
                held = came if held is None else pa.concat_tables([held, came])
            while held is not None and held.num_rows >= (span if b is not None else 1):
                yield from blocks_of(held.slice(0, span), rng)
                rng, held = rng + 1, held.slice(span)

    folder = F.when(F.col("term").isNull(), F.lit(-1)).otherwise(F.pmod(F.hash("term"), F.lit(folders)))
    made = ordered.mapInArrow(make, schema).withColumn("folder", folder)
    path = f"{shared_dir(spark)}/impacts-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    made.repartition("folder", F.pmod(F.col("range"), F.lit(8))).sortWithinPartitions("folder", "term", "range").write.partitionBy("folder").parquet(path)
    every = spark.read.schema(T.StructType([*schema.fields, T.StructField("folder", T.IntegerType())])).parquet(path)
    table = every.filter("folder >= 0").select("term", "range", "n", "top", "data", "folder")
    passages = every.filter("folder = -1").select("range", F.posexplode("ids").alias("at", "id")).select((F.col("range") * span + F.col("at")).alias("n"), "id")
    return Impacts(table, passages, index, span)


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def search(impacts: Impacts, queries: DataFrame, k: int = RETRIEVAL.candidates, reads: list | None = None) -> DataFrame:
    """query_id, id, score, rank (from 1), as ``lexical.search`` has them. ``reads`` gets the blocks scored and those that hold asked terms."""
    ship(queries.sparkSession)
    asked = query_terms(queries).join(impacts.index.frequencies, "term")
    each = cut_blocks(asked.groupBy("query_id").agg(F.collect_list(F.struct("term", "times", "pos", "df")).alias("terms")), QUERIES)
    found = reduce(DataFrame.unionByName, (_best(impacts, b, k, reads) for b in each))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "pos", "n")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return impacts.passages.join(small(stored(best, "impacts-best")), "n").select("query_id", "id", "score", "rank")


def _best(impacts: Impacts, queries: DataFrame, k: int, reads: list | None) -> DataFrame:
    spark, kind, index, span = queries.sparkSession, queries.schema["query_id"].dataType, impacts.index, impacts.span
    asked = sorted(queries.collect(), key=lambda r: str(r["query_id"]))  # at most QUERIES of them
    ids = [r["query_id"] for r in asked]
    weights: dict[str, list[tuple[int, float, int]]] = {}
    for q, r in enumerate(asked):
        for t in r["terms"]:
            weights.setdefault(t["term"], []).append((q, t["times"] * float(np.log(1 + (index.n_docs - t["df"] + 0.5) / (t["df"] + 0.5))), t["pos"]))
    names = sorted(weights)
    numbered = small(spark.createDataFrame([(i, t) for i, t in enumerate(names)], "t int, term string").withColumn("folder", F.pmod(F.hash("term"), F.lit(FOLDERS))))
    folders = [r["folder"] for r in numbered.select("folder").distinct().collect()]  # at most FOLDERS
    mine = impacts.table.filter(F.col("folder").isin(folders)).join(numbered.drop("folder"), "term")
    by_term = [tuple(np.array(x) for x in zip(*weights[t], strict=True)) for t in names]
    slope = RETRIEVAL.k1 * RETRIEVAL.b / (index.avg_len or 1.0)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
        """Rows of a range at a time: one block a term."""
        now, rows = None, []
        for b in batches:
            for r in b.to_pylist():
                if r["range"] != now and rows:
                    yield now, rows
                    rows = []
                now = r["range"]
                rows.append(r)
        if rows:
            yield now, rows

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rng, rows in groups(batches):
            bound = np.zeros(len(ids))
            for r in rows:
                q, w, _ = by_term[r["t"]]
                bound[q] += w * r["top"]
            some = np.flatnonzero(bound > 0)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), rng)), pa.array(bound[some])], names=["q", "range", "bound"])

    bounds = mine.select("range", "t", "top").repartition("range").sortWithinPartitions("range").mapInArrow(bounded, "q int, range long, bound double")
    bounds = stored(bounds, "impacts-bounds")
    first = bounds.withColumn("at", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "range"))).filter(F.col("at") <= FIRST).select("q", "range")
    schema = "q int, n long, score double, pos int"

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rng, rows in groups(batches):
            want = np.zeros(len(ids), dtype=bool)
            want[rows[0]["qs"]] = True
            score, pos = np.zeros((len(ids), span)), np.full((len(ids), span), 2**31 - 1, dtype=np.int32)
            for r in rows:
                q, w, p = by_term[r["t"]]
                on = want[q]
                if on.any():
                    at, tf, dl = unpacked(r["data"], r["n"])
                    here = np.ix_(q[on], at)
                    score[here] += (w[on] * (RETRIEVAL.k1 + 1))[:, None] * (tf / (tf + FLAT + slope * dl))
                    pos[here] = np.minimum(pos[here], p[on][:, None].astype(np.int32))
            rough = np.round(score, 9)
            for q in np.flatnonzero(want):
                some = np.flatnonzero(rough[q] > 0)
                some = some[np.lexsort((some, pos[q, some], -rough[q, some]))[:k]]
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), q, dtype=np.int32)), pa.array(some + rng * span), pa.array(score[q, some]), pa.array(pos[q, some])], names=["q", "n", "score", "pos"])

    def score(pairs: DataFrame, tag: str) -> DataFrame:
        by_range = pairs.groupBy("range").agg(F.collect_list("q").alias("qs"))  # at most QUERIES
        rows = mine.select("range", "t", "n", "data").join(by_range, "range").repartition("range").sortWithinPartitions("range")
        return stored(rows.mapInArrow(scored, schema), tag)

    def count(pairs: DataFrame) -> int:
        return mine.select("range").join(pairs.select("range").distinct(), "range", "left_semi").count()

    sure = score(first, "impacts-first")
    kth = sure.withColumn("at", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).filter(F.col("at") == k).select("q", F.col("score").alias("least"))
    left = bounds.join(first, ["q", "range"], "left_anti").join(kth, "q", "left").filter(F.col("bound") >= F.coalesce("least", F.lit(0.0)) - 1e-7).select("q", "range")
    left = stored(left, "impacts-left")
    every = sure.unionByName(score(left, "impacts-more"))
    if reads is not None:
        reads.append((count(first.unionByName(left)), mine.count(), first.count() + left.count(), bounds.count()))
    numbers = F.array(*(F.lit(i) for i in ids)).cast(T.ArrayType(kind)) if ids else F.array().cast(T.ArrayType(kind))
    return every.select(F.get(numbers, F.col("q")).alias("query_id"), "n", "score", "pos")
