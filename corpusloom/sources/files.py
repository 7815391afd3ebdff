"""Sources and sinks: PDF and HTML files, JSON Lines pages, manifests, question sets, review sheets, the index."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quality import licence_reason
from ..functions.text import clean
from ..operators import lexical
from ..session import ship
from . import archives

PAGE = "doc_id string, title string, text string, source_url string, publisher string, year string, licence string, areas array<string>, crops array<string>, relevance_score double, n_chars int"
DOCUMENT = "doc_id string, title string, publisher string, year string, doc_type string, access_rights string, licence string, source_url string, landing_page string, filename string, sha256 string, size_bytes long, crops array<string>, relevance_score double, n_pages int, guidance_terms int, institutional_terms int"
MANIFEST = f"schema int, generated_by string, note string, documents array<struct<{', '.join(f.replace(' ', ':', 1) for f in DOCUMENT.split(', '))}>>, bulk_sources array<struct<name:string, n_pages:int>>"
QUESTION = "id string, area string, crop string, topic string, in_scope boolean, question string, expect_any array<string>, reject_any array<string>, why_refused string, probe string"
MAX_PAGES, SCANNED_CHARS, USABLE_CHARS = 800, 120, 2000


def pages_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGE).option("mode", "FAILFAST").json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row a document of a manifest file."""
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path).select(F.inline("documents"))


def questions(spark: SparkSession, path: str) -> DataFrame:
    fields = ", ".join(f.replace(" ", ":", 1) for f in QUESTION.split(", "))
    return spark.read.schema(f"questions array<struct<{fields}>>").option("multiLine", True).json(path).select(F.inline("questions"))


def html_files(spark: SparkSession, path: str, prefixes: list[str] | None = None) -> DataFrame:
    """path, html of .html files, of some folders only if ``prefixes`` are given."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").option("recursiveFileLookup", True).load(path)
    root = F.regexp_replace("path", "^.*?" + path.rstrip("/").rsplit("/", 1)[-1] + "/", "./")
    return wanted(files.select("path", root.alias("inner"), F.decode("content", "UTF-8").alias("html")), prefixes, "inner").drop("inner")


def zip_pages(spark: SparkSession, path: str, prefixes: list[str] | None = None) -> DataFrame:
    """path, html of the .html entries of ZIP archives, of some folders only if ``prefixes`` are given; other entries are not opened."""
    return archives.zip_entries(spark, path, prefixes, ".html").select("path", F.decode("content", "UTF-8").alias("html"))


def wanted(files: DataFrame, prefixes: list[str] | None, path: str = "path") -> DataFrame:
    """.html files under some folders of the archive; the archive's own folder, the first, does not count."""
    inner = F.regexp_replace(F.col(path), "^[^/]*/", "")
    hit = F.lit(prefixes is None)
    for p in prefixes or ():
        hit = hit | F.startswith(inner, F.lit(p))
    return files.filter(F.endswith(F.lower(F.col(path)), F.lit(".html")) & hit)


def pdf_files(spark: SparkSession, path: str, max_pages: int = MAX_PAGES) -> DataFrame:
    """path, pages, text, n_pages, truncated, n_chars, is_scanned, usable, error of PDF files; a page that fails is empty.

    Pages after ``max_pages`` are left out, which ``truncated`` says.

    The PDF library is optional: without it every row says so in ``error``.
    """
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            from pypdf import PdfReader
        except ImportError:
            PdfReader = None
        for batch in batches:
            rows = []
            for p, content in zip(batch["path"], batch["content"], strict=True):
                pages, total, error = [], 0, None
                if PdfReader is None:
                    error = "pypdf not installed"
                else:
                    try:
                        reader = PdfReader(io.BytesIO(content))
                        total = len(reader.pages)
                    except Exception as e:  # any damage to a file is that file's error
                        error = f"unreadable: {e}"
                    for i in range(min(total, max_pages)):
                        try:
                            pages.append(reader.pages[i].extract_text() or "")
                        except Exception:
                            pages.append("")
                rows.append((p, pages, total, error))
            yield pd.DataFrame(rows, columns=["path", "pages", "n_pages", "error"])

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")
    read = raw.mapInPandas(run, "path string, pages array<string>, n_pages int, error string")
    return probed(read.withColumn("truncated", F.size("pages") < F.col("n_pages")))


def probed(read: DataFrame) -> DataFrame:
    """Cleaned pages with length and status; ``read``: pages, n_pages, error."""
    df = read.withColumn("pages", F.transform("pages", clean))
    df = df.withColumn("text", clean(F.array_join("pages", "\n\n"))).withColumn("n_chars", F.length("text"))
    df = df.withColumn("is_scanned", (F.size("pages") > 0) & (F.col("n_chars") / F.size("pages") < SCANNED_CHARS))
    return df.withColumn("usable", F.col("error").isNull() & ~F.col("is_scanned") & (F.col("n_chars") > USABLE_CHARS))


def review_sheet(spark: SparkSession, path: str) -> DataFrame:
    """id, english, draft, answer of a review sheet (UTF-8 with or without mark, instruction row left out)."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    df = df.select(*(F.col(f"`{c}`").alias(c.lstrip("﻿").strip()) for c in df.columns))
    return df.filter(F.col("id") != "HOW-TO-USE").select("id", "english", "draft", F.col(df.columns[-1]).alias("answer"))


def reviewed(sheet: DataFrame) -> DataFrame:
    """``sheet`` with corrected: the draft where the answer approves, the answer where it is another text, else null."""
    low = F.lower(F.trim(F.coalesce("answer", F.lit(""))))
    approves = low.isin("ok", "okay", "yes", "good", "correct", "fine", "y")
    return sheet.withColumn("corrected", F.when(low == "", F.lit(None)).when(approves, F.col("draft")).otherwise(F.trim("answer")))


def carried(fresh: DataFrame, prior: DataFrame) -> DataFrame:
    """A new sheet (id, english) with the drafts and corrections that its English texts had before; new rows are empty."""
    known = prior.groupBy("english").agg(F.max(F.struct(F.col("corrected").isNotNull(), "draft", "corrected")).alias("k"))
    return fresh.join(known, "english", "left").select("id", "english", F.coalesce("k.draft", F.lit("")).alias("draft"), F.col("k.corrected").alias("corrected"))


def imported(items: DataFrame, sheet: DataFrame, mark: str = "CRITICAL ") -> DataFrame:
    """``items`` (id, ...) with the corrections of a filled sheet, whose ids may bear the mark of urgent rows; of several for an id the greatest counts."""
    filled = reviewed(sheet).select("id", "corrected").filter("corrected is not null")
    marked = filled.filter(F.startswith("id", F.lit(mark))).groupBy(F.substr("id", F.lit(len(mark) + 1)).alias("id")).agg(F.max("corrected").alias("urgent"))
    plain = filled.filter(~F.startswith("id", F.lit(mark))).groupBy("id").agg(F.max("corrected").alias("corrected"))
    return items.join(marked, "id", "left").join(plain, "id", "left").withColumn("corrected", F.coalesce("urgent", "corrected")).drop("urgent")


def meta(metadata, key: str, default: str = ""):
    """The first value of a repository record's field; ``metadata``: map of arrays of (value)."""
    return F.coalesce(F.get(F.try_element_at(metadata, F.lit(key)), F.lit(0))["value"], F.lit(default))


def save_index(chunks: DataFrame, path: str, id: str = "id") -> None:
    """Passages with their vectors, and the BM25 index of those whose licence allows their use."""
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    lexical.build(served(chunks.sparkSession.read.parquet(f"{path}/chunks")), id).save(f"{path}/bm25")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, lexical.Index]:
    """Passages whose licence allows their use, with their vectors as a column, and their BM25 index for ``search``."""
    return served(spark.read.parquet(f"{path}/chunks")), lexical.load(spark, f"{path}/bm25")


def served(chunks: DataFrame) -> DataFrame:
    return chunks.filter(licence_reason(F.coalesce("licence", F.lit(""))).isNull())


def pages_sink(pages: DataFrame, path: str) -> None:
    pages.write.mode("overwrite").json(path)


def event_frame(event, data):
    """One server-sent event as text."""
    return F.format_string("event: %s\ndata: %s\n\n", event, data)


def arc_questions(spark: SparkSession, path: str) -> DataFrame:
    """question_id, question, choice (from 0), text, n_chars, gold of the choices in a JSON Lines file of the ARC layout; rows whose key names no choice are left out."""
    rows = spark.read.schema("id string, question struct<stem:string, choices:array<struct<text:string, label:string>>>, answerKey string").json(path)
    each = rows.select(F.col("id").alias("question_id"), F.col("question.stem").alias("question"), "answerKey", F.posexplode("question.choices").alias("choice", "c"), F.exists("question.choices", lambda c: c["label"] == F.col("answerKey")).alias("known"))
    return each.filter("known").select("question_id", "question", "choice", F.col("c.text").alias("text"), F.length("c.text").alias("n_chars"), (F.col("c.label") == F.col("answerKey")).alias("gold"))


def result_sink(result: DataFrame, path: str, **about) -> None:
    """A result as JSON, each row with the settings that it was made with."""
    result.select(F.struct(*(F.lit(v).alias(k) for k, v in about.items())).alias("settings") if about else F.lit(None).alias("settings"), F.struct(*result.columns).alias("result")).coalesce(1).write.mode("overwrite").json(path)
