"""Context compression: sentences under a token budget, safety sentences first."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import RETRIEVAL
from ..functions.text import CHARS_PER_TOKEN, dot, is_safety_critical, sentences
from .dense import hashed_embedding


def budgets(hits: DataFrame, total: int = RETRIEVAL.token_budget) -> DataFrame:
    """``hits`` (query_id, hit from 1) with weight and budget: by rank, not by score."""
    w = 1.0 / (F.col("hit") + 1)
    weighted = hits.withColumn("weight", w / F.sum(w).over(Window.partitionBy("query_id")))
    return weighted.withColumn("budget", F.greatest(F.lit(60), (F.col("weight") * total).cast("int")))


def select(scored: DataFrame, key: list[str], least: int = 2) -> DataFrame:
    """``key``, text, kept, total, forced of sentences (key, pos, sentence, score, budget).

    Safety sentences always stay. The others follow by score until one does not
    fit and ``least`` are kept: it ends the selection, it is not passed over.
    """
    cost = F.length("sentence") / CHARS_PER_TOKEN
    rows = scored.withColumns({"forced": is_safety_critical(F.col("sentence")), "cost": cost})
    whole = Window.partitionBy(*key)
    rows = rows.withColumns({"total": F.count(F.lit(1)).over(whole), "n_forced": F.sum(F.col("forced").cast("int")).over(whole)})
    before = Window.partitionBy(*key).orderBy(F.desc("forced"), F.desc("score"), "pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"used": F.sum("cost").over(before), "place": F.count(F.lit(1)).over(before)})
    over = ~F.col("forced") & (F.col("used") > F.col("budget")) & (F.col("place") - 1 >= least)
    rows = rows.withColumn("ended", F.max(over.cast("int")).over(before)).withColumn("stays", (F.col("total") <= least) | (F.col("ended") == 0))
    kept = rows.filter("stays").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "sentence"))).alias("s"), F.count(F.lit(1)).alias("kept"), F.max("total").alias("total"), F.max(F.when(F.col("total") > least, F.col("n_forced")).otherwise(0)).alias("forced"))
    return kept.select(*key, F.array_join(F.col("s.sentence"), " ").alias("text"), "kept", "total", "forced")


def split(hits: DataFrame, text: str = "text") -> DataFrame:
    """A row a sentence: pos, sentence."""
    return hits.select(*[c for c in hits.columns if c != text], F.posexplode(sentences(F.col(text))).alias("pos", "sentence"))


def scored(pieces: DataFrame, asked: DataFrame, embed: Callable[[DataFrame], DataFrame] = hashed_embedding) -> DataFrame:
    """``pieces`` (query_id, sentence, ...) with score: the sentence's likeness to its query (``asked``: query_id, embedding).

    ``embed`` makes id, embedding of id, text; every different sentence is embedded once.
    """
    keyed = pieces.withColumn("id", F.sha2("sentence", 256))
    vectors = embed(keyed.select("id", F.col("sentence").alias("text")).dropDuplicates(["id"]))
    near = keyed.join(vectors, "id").join(asked.select("query_id", F.col("embedding").alias("asked")), "query_id")
    return near.withColumn("score", dot(F.col("embedding"), F.col("asked"))).drop("id", "embedding", "asked")


def compressed(hits: DataFrame, asked: DataFrame, total: int = RETRIEVAL.token_budget, embed: Callable[[DataFrame], DataFrame] = hashed_embedding) -> DataFrame:
    """``hits`` (query_id, hit from 1, text) with shown, and its counts: kept and n_sentences, before and after in tokens, forced.

    A hit's budget is its share of ``total`` by rank; a text of up to two sentences is shown as it is.
    """
    each = budgets(hits.select("query_id", "hit", "text"), total).drop("weight")
    rows = scored(split(each), asked, embed)
    picked = select(rows, ["query_id", "hit"]).withColumnRenamed("text", "picked").withColumnRenamed("total", "n_sentences")
    shown = F.when(F.col("n_sentences") > 2, F.col("picked")).otherwise(F.col("text"))
    tokens = lambda c: (F.length(c) / CHARS_PER_TOKEN).cast("int")
    return hits.join(picked, ["query_id", "hit"], "left").withColumn("shown", shown).withColumns({"before": tokens("text"), "after": tokens("shown")}).drop("picked")
