"""The build flow: page files and PDF files with their manifest become documents, passages, vectors and an index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CHUNKING, Chunking
from ..sources import files
from . import chunk, dense, lexical

ABOUT = ["doc_id", "title", "publisher", "year", "licence", "source_url"]


def documents(pages: DataFrame, pdfs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Both sources as documents: doc_id, title, publisher, year, licence, source_url, pages, kind.

    ``pages``: of page files, a document a row; ``pdfs``: filename, pages, usable; ``manifest``: filename and
    what is known of it. PDF files that are not usable are left out; one that the manifest does not know is
    named after its file, without a licence. Texts of nothing are left out.
    """
    web = pages.select(*ABOUT, F.array("text").alias("pages"), F.lit("page").alias("kind")).filter("coalesce(text, '') <> ''")
    known = manifest.dropDuplicates(["filename"]).select("filename", *(F.col(c).alias(f"m_{c}") for c in ABOUT))
    named = lambda c, default: F.coalesce(f"m_{c}", default).alias(c)
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    none = F.lit("")
    pdf = pdfs.filter("usable").join(known, "filename", "left").select(named("doc_id", stem), named("title", stem), named("publisher", none), named("year", F.lit("unknown")), named("licence", none), named("source_url", none), "pages", F.lit("pdf").alias("kind"))
    return web.unionByName(pdf)


def passages(docs: DataFrame, limits: Chunking = CHUNKING) -> DataFrame:
    """Passages of documents whose licence allows their use, with ``id``; no vector is made for the others."""
    made = chunk.chunks(files.served(docs), limits)
    return made.withColumn("id", F.concat_ws("#", "doc_id", F.col("chunk_index").cast("string")))


def index(spark: SparkSession, docs: DataFrame, path: str, embed: Callable[[DataFrame], DataFrame] = dense.hashed_embedding) -> tuple[DataFrame, lexical.Index]:
    """Passages with vectors and their BM25 index, saved in ``path`` and loaded from there."""
    made = passages(docs)
    files.save_index(dense.with_hashed_embedding(made) if embed is dense.hashed_embedding else made.join(embed(made.select("id", "text")), "id"), path)
    return files.load_index(spark, path)
