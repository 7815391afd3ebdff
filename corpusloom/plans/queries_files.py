"""Queries of sources and sinks: tables written in the formats of the domain and read back, and the build flow."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import build, ingest
from ..operators.tables import shared_dir
from ..sources import files
from .base import registry, table

ENTRIES, query = registry()


def _place(spark) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


def _pages(spark, d):
    docs = table(spark, d, "documents")
    name = F.col("doc_id").cast("string")
    return docs.select(
        name.alias("doc_id"), F.concat(F.lit("title "), name).alias("title"), "text", F.concat(F.lit("http://x/"), name).alias("source_url"), F.coalesce("source", F.lit("")).alias("publisher"), F.lit("2001").alias("year"),
        F.when(F.col("doc_id") % 5 == 0, "CC BY-ND 4.0").otherwise("CC BY 4.0").alias("licence"), F.array(F.lit("crop")).alias("areas"), F.array().cast("array<string>").alias("crops"), (F.col("doc_id") / 7).alias("relevance_score"), F.length("text").alias("n_chars"),
    )


@query("SELECT doc_id::VARCHAR AS doc_id, 'title ' || doc_id AS title, md5(text) AS digest, length(text) AS n_chars, coalesce(source, '') AS publisher, round(doc_id / 7.0::DOUBLE, 9) AS relevance_score, 1 AS n_areas, 0 AS n_crops FROM documents")
def jsonl_pages(spark, d):
    """All documents as a JSON Lines page file, read again by its schema."""
    path = _place(spark)
    files.pages_sink(_pages(spark, d), path)
    back = files.pages_jsonl(spark, path)
    return back.select("doc_id", "title", F.md5("text").alias("digest"), "n_chars", "publisher", F.round("relevance_score", 9).alias("relevance_score"), F.size("areas").alias("n_areas"), F.size("crops").alias("n_crops"))


def _wrapped(rows, name: str, path: str, **about) -> str:
    """One JSON object a file, with up to a thousand rows under ``name``, as question sets and manifests are kept."""
    place = F.monotonically_increasing_id()  # the partition's number above 33 bits of place
    each = rows.groupBy(F.shiftright(place, 33).alias("part"), F.floor(place.bitwiseAND(F.lit((1 << 33) - 1)) / 1000).alias("cut")).agg(F.collect_list(F.struct(*rows.columns)).alias(name))
    each.select(*(F.lit(v).alias(k) for k, v in about.items()), name).write.option("maxRecordsPerFile", 1).json(path)
    return path


@query("SELECT item_id::VARCHAR AS id, item_id % 3 > 0 AS in_scope, md5(text) AS question, CASE WHEN item_id % 3 > 0 THEN 2 ELSE -1 END AS n_expected FROM benchmark")
def question_set(spark, d):
    """Benchmark items as a question set file."""
    i = F.col("item_id")
    expect = F.when(i % 3 > 0, F.array(F.left("text", F.lit(5)), F.lit("x")))
    rows = table(spark, d, "benchmark").select(i.cast("string").alias("id"), (i % 3 > 0).alias("in_scope"), F.col("text").alias("question"), expect.alias("expect_any"))
    back = files.questions(spark, _wrapped(rows, "questions", _place(spark), schema=1))
    return back.select("id", "in_scope", F.md5("question").alias("question"), F.coalesce(F.size("expect_any"), F.lit(-1)).alias("n_expected"))


@query("SELECT 'doc' || doc_id || '.pdf' AS filename, 'title ' || doc_id AS title, coalesce(length(text), 0)::BIGINT AS size_bytes, 1 AS n_crops FROM documents")
def manifest_documents(spark, d):
    docs = table(spark, d, "documents")
    rows = docs.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"), F.concat(F.lit("title "), F.col("doc_id").cast("string")).alias("title"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("size_bytes"), F.array(F.lit("yam")).alias("crops"))
    back = files.manifest(spark, _wrapped(rows, "documents", _place(spark), schema=1, note="given"))
    return back.select("filename", "title", "size_bytes", F.size("crops").alias("n_crops"))


@query("SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*/', '') || '.html' AS place, md5(html) AS digest, strlen(html)::BIGINT AS n_bytes FROM pages WHERE regexp_matches(url, '^[a-z]+://[^/]*/(en|de)/')")
def zip_pages_wanted(spark, d):
    """All pages packed into ZIP archives, a folder a page, as .html files by their URLs' paths and as text; of these the wanted folders' .html entries are opened."""
    path = _place(spark)
    place = F.regexp_replace("url", "^[a-z]+://[^/]*/", "")
    kinds = F.explode(F.array(F.lit(".html"), F.lit(".txt")))
    pages = table(spark, d, "pages").select(F.concat(F.lit("page"), F.col("page_id").cast("string"), F.lit("/"), place).alias("stem"), F.encode("html", "UTF-8").alias("content"), kinds.alias("kind"))
    files.archives.pack(pages.select(F.concat("stem", "kind").alias("path"), "content"), path)
    found = files.zip_pages(spark, path, ["en/", "de/"])
    inner = F.regexp_replace("path", "^[^/]*/", "")
    return found.select(F.regexp_extract("path", "^page([0-9]+)/", 1).cast("long").alias("page_id"), inner.alias("place"), F.md5(F.encode("html", "UTF-8")).alias("digest"), F.octet_length("html").cast("long").alias("n_bytes"))


@query("SELECT doc_id, doc_id % 3 = 0 AS complete FROM documents")
def pdf_integrity(spark, d):
    """Texts dressed as PDF files: whole, without their end, without their beginning."""
    i, pad = F.col("doc_id"), F.lit("x" * 2000)
    text = F.concat(F.when(i % 3 == 2, F.lit("")).otherwise(F.lit("%PDF-1.4 ")), F.coalesce("text", F.lit("")), pad, F.when(i % 3 == 1, F.lit("")).otherwise(F.lit("%%EOF\n")))
    return table(spark, d, "documents").select("doc_id", ingest.is_complete_pdf(F.encode(text, "UTF-8")).alias("complete"))


def _documents(spark, d):
    """Even documents as PDF files of two pages, odd ones as page files; of the files every seventh is unknown to the manifest."""
    docs = table(spark, d, "documents")
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".pdf"))
    half = F.floor(F.length("text") / 2).cast("int")
    pdfs = docs.filter("doc_id % 2 = 0 AND text IS NOT NULL").select(name.alias("filename"), F.array(F.left("text", half), F.substring(F.col("text"), half + 1, F.length("text"))).alias("pages"), (F.col("doc_id") % 4 == 0).alias("usable"))
    manifest = docs.filter("doc_id % 7 <> 0").select(name.alias("filename"), F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("doc_id"), F.lit("known").alias("title"), F.lit("P").alias("publisher"), F.lit("2001").alias("year"), F.when(F.col("doc_id") % 5 == 0, "All rights reserved").otherwise("CC BY 4.0").alias("licence"), F.lit("").alias("source_url"))
    return build.documents(_pages(spark, d).filter(F.col("doc_id").cast("long") % 2 == 1), pdfs, manifest)


_built = """b AS (SELECT CASE WHEN doc_id % 2 = 1 THEN doc_id::VARCHAR WHEN doc_id % 7 <> 0 THEN 'm' || doc_id ELSE doc_id::VARCHAR END AS doc_id, CASE WHEN doc_id % 2 = 1 THEN 'page' ELSE 'pdf' END AS kind,
    CASE WHEN doc_id % 2 = 1 THEN 'title ' || doc_id WHEN doc_id % 7 <> 0 THEN 'known' ELSE doc_id::VARCHAR END AS title, CASE WHEN doc_id % 2 = 1 THEN doc_id % 5 = 0 ELSE doc_id % 7 <> 0 AND doc_id % 5 = 0 END AS barred, text
    FROM documents WHERE text IS NOT NULL AND ((doc_id % 2 = 1 AND text <> '') OR doc_id % 4 = 0))"""


@query(f"WITH {_built} SELECT doc_id, kind, title, CASE WHEN kind = 'pdf' THEN 2 ELSE 1 END AS n_pages, md5(text) AS digest FROM b")
def corpus_union(spark, d):
    return _documents(spark, d).select("doc_id", "kind", "title", F.size("pages").alias("n_pages"), F.md5(F.array_join("pages", "")).alias("digest"))


@query(f"WITH {_built} SELECT count(*) FILTER (NOT barred AND length(trim(text)) >= 2000) AS long_documents, true AS all_indexed, true AS all_have_vectors, 0 AS barred_passages FROM b")
def index_build(spark, d):
    """The whole build: every long document whose licence allows it has passages, each with its vector and its row in the index."""
    docs = _documents(spark, d)
    chunks, index = build.index(spark, docs, _place(spark))
    longer = files.served(docs).filter(F.length(F.trim(F.array_join("pages", ""))) >= 2000).select("doc_id").distinct()
    held = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    counts = longer.join(held, "doc_id", "left").agg(F.count(F.lit(1)).alias("long_documents"), F.count_if(F.col("n").isNull()).alias("lost"))
    shape = chunks.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("embedding").isNotNull() & (F.size("embedding") == 256)).alias("v"))
    barred = chunks.join(docs.select("doc_id", "licence").filter("licence IN ('All rights reserved', 'CC BY-ND 4.0')").select("doc_id"), "doc_id", "left_semi").agg(F.count(F.lit(1)).cast("int").alias("barred_passages"))
    indexed = index.postings.filter("term = ''").agg(F.count(F.lit(1)).alias("i"))
    row = counts.join(F.broadcast(shape)).join(F.broadcast(barred)).join(F.broadcast(indexed))
    return row.select("long_documents", ((F.col("lost") == 0) & (F.col("i") == F.col("n"))).alias("all_indexed"), (F.col("v") == F.col("n")).alias("all_have_vectors"), "barred_passages")
