"""Hybrid search: reciprocal-rank fusion, re-ranking by flags, floors and quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import RETRIEVAL
from ..functions import fixed as X
from ..functions.quality import is_usable
from ..functions.questions import asks_about_field, sign_names
from ..functions.scope import crops_mentioned, other_crops
from ..functions.text import count, dot, let, matches, words
from . import dense, lexical
from .tables import small, stored


def fuse(dense_hits: DataFrame, lexical_hits: DataFrame, top: int = 3 * RETRIEVAL.top_k, k: int = RETRIEVAL.rrf_k, sure: int = RETRIEVAL.guaranteed) -> DataFrame:
    """query_id, id, rrf, fused_rank (from 0), dense_rank, lexical_rank, score of both rankings (ranks from 1) made one.

    The first ``sure`` of either come first, lexical before dense; the others by
    the sum of 1 / (k + rank); ties keep the dense order, then the lexical.
    """
    both = dense_hits.select("query_id", "id", F.col("rank").alias("d"), F.lit(None).cast("int").alias("l"), "score").unionByName(
        lexical_hits.select("query_id", "id", F.lit(None).cast("int").alias("d"), F.col("rank").alias("l"), F.lit(None).cast("double").alias("score"))
    )
    each = both.groupBy("query_id", "id").agg(F.min("d").alias("dense_rank"), F.min("l").alias("lexical_rank"), F.max("score").alias("score"))
    one = lambda c: F.coalesce(1.0 / (F.lit(k) + F.col(c)), F.lit(0.0))
    each = each.withColumn("rrf", one("dense_rank") + one("lexical_rank"))
    place = F.least(F.when(F.col("lexical_rank") <= sure, 2 * (F.col("lexical_rank") - 1)), F.when(F.col("dense_rank") <= sure, 2 * (F.col("dense_rank") - 1) + 1))
    first = F.coalesce(F.col("dense_rank"), F.lit(RETRIEVAL.candidates) + F.col("lexical_rank"))
    order = Window.partitionBy("query_id").orderBy(F.coalesce(place, F.lit(2 * sure)), F.desc(F.round("rrf", 12)), first)
    return each.withColumn("fused_rank", F.row_number().over(order) - 1).filter(F.col("fused_rank") < top)


def off_crop(title: Column, text: Column, query: Column) -> Column:
    """The passage is about other crops than the query's, or names none under another crop's title."""
    body = F.concat_ws(" ", title, text)
    named = let(body, lambda b: F.array_union(crops_mentioned(b), other_crops(b)))
    elsewhere = lambda wanted: let(named, lambda found: F.when(F.size(found) > 0, ~F.arrays_overlap(found, wanted)).otherwise(F.size(other_crops(title)) > 0))
    return let(crops_mentioned(query), lambda wanted: F.when(F.size(wanted) > 0, elsewhere(wanted)).otherwise(F.lit(False)))


def not_named(title: Column, text: Column, query: Column) -> Column:
    """Signs in the query name a pest or disease that the passage does not."""
    low = F.lower(F.concat_ws(" ", title, text))
    return let(sign_names(query), lambda names: (F.size(names) > 0) & ~F.exists(names, lambda n: F.contains(low, n)))


def is_research(title: Column, text: Column) -> Column:
    return matches(F.concat_ws(" ", title, text), X.RESEARCH_REGISTER)


def is_postharvest(title: Column, text: Column) -> Column:
    body = F.concat_ws(" ", title, text)
    n = count(body, X.POSTHARVEST_TERMS)
    return (n >= 3) & (1000.0 * n / F.greatest(F.size(words(body)), F.lit(1)) >= 25.0)


def rerank(hits: DataFrame) -> DataFrame:
    """``hits`` (fused_rank, title, text, query) with four flags and ``place`` (from 0).

    Four stable partitions, one after the other, are one sort with the last on top.
    """
    args = (F.col("title"), F.col("text"), F.col("query"))
    flagged = hits.withColumns({"offcrop": off_crop(*args), "not_named": not_named(*args), "research": is_research(*args[:2]), "postharvest": asks_about_field(args[2]) & is_postharvest(*args[:2])})
    order = Window.partitionBy("query_id").orderBy("postharvest", "research", "not_named", "offcrop", "fused_rank")
    return flagged.withColumn("place", F.row_number().over(order) - 1)


def floor(min_score: float = RETRIEVAL.min_score) -> Column:
    """Close enough, with some tolerance for the lexical ranking's first."""
    return F.col("score") >= F.when(F.col("lexical_rank") <= RETRIEVAL.exempt, min_score - RETRIEVAL.tolerance).otherwise(min_score)


def hybrid(passages: DataFrame, queries: DataFrame, min_score: float = RETRIEVAL.min_score, top_k: int = RETRIEVAL.top_k, index: lexical.Index | None = None) -> DataFrame:
    """The hits of each query; ``passages``: id, title, text, embedding; ``queries``: query_id, text, embedding; ``index``: of the passages, built where none is given.

    Every fused candidate has its cosine, also those that only the lexical ranking found.
    """
    near = dense.search(passages.select("id", "embedding"), queries.select("query_id", "embedding"))
    said = lexical.search(index or passages, queries.select("query_id", "text"), id="id")
    fused = stored(fuse(near, said).drop("score"))  # a few rows a query; the passages' texts are read for these only
    vectors = queries.select("query_id", F.col("text").alias("query"), F.col("embedding").alias("asked"))
    full = passages.select("id", "title", "text", "embedding").join(small(fused), "id").join(F.broadcast(vectors) if queries.count() <= dense.BLOCK else vectors, "query_id")
    ranked = rerank(full.withColumn("score", dot(F.col("embedding"), F.col("asked"))).drop("embedding", "asked"))
    good = ranked.filter(floor(min_score) & is_usable(F.col("text")))
    order = Window.partitionBy("query_id").orderBy("place")
    return good.withColumn("hit", F.row_number().over(order)).filter(F.col("hit") <= top_k)
