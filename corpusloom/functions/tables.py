"""Table functions for SQL: ``chunk_pages`` makes passages, ``sentences_of`` sentences, of any table with the columns that they need.

``register(spark)`` names them for the session. Both are polymorphic: all columns of the given table that they do not
make themselves come out again beside each result.

    SELECT * FROM chunk_pages(TABLE(docs))                            -- a row a document: pages array<string>
    SELECT * FROM chunk_pages(TABLE(pages), target_tokens => 200)     -- a row a page: text, page; rows meet by doc_id, in order of page
    SELECT * FROM sentences_of(TABLE(docs) PARTITION BY doc_id ORDER BY page)

Edge cases: null texts and pages are empty; a null doc_id is a document of its own (rows of a page each meet in it); missing columns of a document are null;
documents without text give no rows; tables without rows give none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from ..config import CHUNKING, Chunking
from ..operators import chunk
from ..session import ship
from . import fixed as X

ABOUT = ["title", "publisher", "year", "licence", "source_url"]
SENTENCE = re.compile(X.SENTENCE, re.ASCII)
#: The passages' columns; a table function is analysed where no session is.
MADE = [T.StructField(name, {"string": T.StringType(), "int": T.IntegerType()}[kind]) for name, kind in (c.split() for c in chunk.RESULT.split(", "))]
#: A word, as in ``functions.text.words``.
WORD = re.compile(r"\S+")


def _names(table: AnalyzeArgument, *needed: str) -> list[str]:
    if not table.isTable:
        raise ValueError("the first argument is a table: TABLE(name)")
    names = [f.name for f in table.dataType.fields]
    missing = [c for c in needed if c not in names]
    if missing:
        raise ValueError(f"columns {', '.join(missing)} are needed")
    return names


def _number(argument: AnalyzeArgument | None, default: int) -> int:
    if argument is None:
        return default
    if not argument.isConstantExpression or argument.value is None or int(argument.value) < 0:
        raise ValueError("limits are constants of 0 or more")
    return int(argument.value)


@dataclass
class Passages(AnalyzeResult):
    by_page: bool = False
    extras: list = field(default_factory=list)
    names: list = field(default_factory=list)
    limits: Chunking = CHUNKING


@udtf
class ChunkPages:
    @staticmethod
    def analyze(docs: AnalyzeArgument, target_tokens: AnalyzeArgument | None = None, overlap_tokens: AnalyzeArgument | None = None, min_tokens: AnalyzeArgument | None = None) -> Passages:
        names = _names(docs, "doc_id")
        by_page = "pages" not in names
        if by_page:
            _names(docs, "text", "page")
        extras = [f for f in docs.dataType.fields if f.name not in {*(f.name for f in MADE), *ABOUT, "pages", "text", "page"}]
        limits = Chunking(target_tokens=_number(target_tokens, CHUNKING.target_tokens), overlap_tokens=_number(overlap_tokens, CHUNKING.overlap_tokens), min_tokens=_number(min_tokens, CHUNKING.min_tokens), chars_per_token=CHUNKING.chars_per_token)
        return Passages(
            schema=T.StructType([*MADE, *extras]), by_page=by_page, extras=[f.name for f in extras], names=names, limits=limits,
            partitionBy=[PartitioningColumn("doc_id")] if by_page else [], orderBy=[OrderingColumn("page")] if by_page else [],
        )

    def __init__(self, shape: Passages):
        self.shape, self.first, self.pages = shape, None, []

    def _passages(self, row: T.Row, pages: list[str]) -> Iterator[tuple]:
        about = {c: row[c] if c in self.shape.names else None for c in ABOUT}
        doc = None if row["doc_id"] is None else str(row["doc_id"])
        for i, (text, first, last) in enumerate(chunk.pack(pages, about["title"] or "", self.shape.limits)):
            yield doc, i, about["title"], text, about["publisher"], about["year"], about["licence"], about["source_url"], first, last, *(row[c] for c in self.shape.extras)

    def eval(self, row: T.Row, **_limits) -> Iterator[tuple]:
        if self.shape.by_page:
            self.first = self.first or row
            self.pages.append(row["text"] or "")
        else:
            yield from self._passages(row, [p or "" for p in row["pages"] or []])

    def terminate(self) -> Iterator[tuple]:
        if self.first is not None:
            yield from self._passages(self.first, self.pages)
            self.first, self.pages = None, []


def sentences(text: str) -> list[str]:
    """As the column function: one of up to three words belongs to that before it."""
    out: list[list[str]] = []
    for part in filter(None, (p.strip() for p in SENTENCE.split(text))):
        if out and len(WORD.findall(part)) <= 3:
            out[-1].append(part)
        else:
            out.append([part])
    return [" ".join(run) for run in out]


@dataclass
class Sentences(AnalyzeResult):
    extras: list = field(default_factory=list)


@udtf
class SentencesOf:
    """Sentences of ``text``, numbered from 0 on through the rows of a partition."""

    @staticmethod
    def analyze(docs: AnalyzeArgument) -> Sentences:
        _names(docs, "text")
        extras = [f for f in docs.dataType.fields if f.name not in {"text", "position", "sentence"}]
        return Sentences(schema=T.StructType([*extras, T.StructField("position", T.LongType()), T.StructField("sentence", T.StringType())]), extras=[f.name for f in extras])

    def __init__(self, shape: Sentences):
        self.extras, self.n = shape.extras, 0

    def eval(self, row: T.Row) -> Iterator[tuple]:
        for s in sentences(row["text"] or ""):
            yield *(row[c] for c in self.extras), self.n, s
            self.n += 1


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.udtf.register("chunk_pages", ChunkPages)
    spark.udtf.register("sentences_of", SentencesOf)
