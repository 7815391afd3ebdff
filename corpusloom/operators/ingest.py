"""Harvest and ingest: gates, funnel, provenance, manifests, hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quality import licence_reason

#: Document types of guidance, titles of navigation pages and folders of content (fixed values).
GUIDANCE_TYPES = ("book", "report", "manual", "training material", "extension material", "brief", "working paper", "book chapter", "poster", "presentation")
BLOCKED_TITLES = ("home", "(untitled)", "admin", "about us", "contact", "search", "sitemap", "login", "user account", "publications")
CONTENT_PREFIXES = (
    "PlantHealth/", "plant_pests/", "crops-fruits-vegetables/", "natural-pest-control/", "cultural-control/", "animal-health-and-disease/", "AnimalHealth/",
    "animal-husbandry/", "animal-species/", "agro-ecological-zones", "water-management/", "processing-and-value-addition/", "trees/", "indigenous-plants/", "medicinal-plants/",
)


def _or_unspecified(value: Column) -> Column:
    return F.when(F.trim(F.coalesce(value, F.lit(""))) == "", "unspecified").otherwise(value)


def vet(access: Column, licence: Column, kind: Column) -> Column:
    """The first gate that a record fails; null if it passes all."""
    low = F.lower(F.trim(F.coalesce(access, F.lit(""))))
    return (
        F.when(low != "open access", F.concat(F.lit("access rights: "), _or_unspecified(access)))
        .when(licence_reason(F.coalesce(licence, F.lit(""))).isNotNull(), F.concat(F.lit("licence: "), licence_reason(F.coalesce(licence, F.lit("")))))
        .when(~F.lower(F.trim(F.coalesce(kind, F.lit("")))).isin(*GUIDANCE_TYPES), F.concat(F.lit("type: "), F.lower(F.trim(_or_unspecified(kind))), F.lit(" (not extension guidance)")))
    )


def title_blocked(title: Column, blocked=BLOCKED_TITLES) -> Column:
    return F.lower(F.trim(title)).isin(*blocked)


def funnel(documents: DataFrame, status: str = "status") -> DataFrame:
    return documents.groupBy(F.col(status).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def with_provenance(files: DataFrame, manifest: DataFrame, key: str = "filename") -> DataFrame:
    """``files`` with the manifest's fields, or the words for what is not known."""
    joined = files.join(manifest, key, "left")
    defaults = {"title": F.regexp_replace(key, r"\.[A-Za-z0-9]+$", ""), "publisher": F.lit("unknown"), "year": F.lit("unknown"), "licence": F.lit("unspecified"), "source_url": F.lit("")}
    return joined.withColumns({k: F.coalesce(F.col(k), v) for k, v in defaults.items() if k in joined.columns})


def upsert(manifest: DataFrame, entry: DataFrame, key: str = "name") -> DataFrame:
    """``manifest`` with ``entry`` in place of its rows of the same key; twice is as good as once."""
    return manifest.join(entry.select(key).distinct(), key, "left_anti").unionByName(entry, allowMissingColumns=True)


def verify(manifest: DataFrame, files: DataFrame, key: str = "filename") -> DataFrame:
    """MISSING, MISMATCH or ok for each manifest row; ``files``: key, content."""
    hashed = files.select(key, F.sha2("content", 256).alias("found"))
    status = F.when(F.col("found").isNull(), "MISSING").when(F.col("found") != F.col("sha256"), "MISMATCH").otherwise("ok")
    return manifest.select(key, "sha256").join(hashed, key, "left").select(key, status.alias("status"))


def is_complete_pdf(content: Column) -> Column:
    """A kilobyte at least, with the PDF header and the end mark in the last two."""
    tail = F.substring(content, F.greatest(F.length(content) - 2047, F.lit(1)), F.lit(2048))
    return (F.length(content) >= 1024) & (F.substring(content, 1, 5) == F.lit(b"%PDF-")) & F.contains(tail, F.lit(b"%%EOF"))


def area_counts(documents: DataFrame, areas: str = "areas") -> DataFrame:
    return documents.select(F.explode(areas).alias("area")).groupBy("area").agg(F.count(F.lit(1)).alias("n"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    n = F.length("text")
    return chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.count_distinct("doc_id").alias("n_docs"), F.min(n).cast("long").alias("min_chars"), F.max(n).cast("long").alias("max_chars"), F.sum(n).cast("long").alias("total_chars"))


def index_meta(chunks: DataFrame, model: str, dim: int) -> DataFrame:
    return chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.lit(dim).alias("dim"), F.lit("float32").alias("dtype"), F.lit(model).alias("embedding_model"), F.count_distinct("doc_id").alias("n_documents"))
