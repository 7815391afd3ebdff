"""The question flow as one plan over many questions; models are columns.

A generator is a function (prompt, sources) -> Column; the default writes the
first sentence of each source, which needs no model and is deterministic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import language, questions, safety, scope
from ..functions.text import citation, let, sentences, words

SYSTEM = (
    "You help farmers with small holdings in the south-west of Nigeria. The numbered sources below were chosen for the question: answer "
    "from them alone and name the number of each, as in [1]. Give a rate or dose only if a source states it. Put prevention and good "
    "husbandry before chemicals. Write few, short and plain sentences that say what to do."
)
NO_CLOCK = " The date, the season and prices are unknown to you: where the answer turns on them, say what it depends on and how to find that out nearby."
Generator = Callable[[Column, Column], Column]


def extractive(prompt: Column, sources: Column) -> Column:
    first = F.transform(sources, lambda s, i: F.concat(F.coalesce(F.get(sentences(s), F.lit(0)), F.lit("")), F.lit(" ["), (i + 1).cast("string"), F.lit("]")))
    return F.array_join(first, " ")


def prompt(question: Column, hits: Column) -> Column:
    """system and user; ``hits``: array of (text, title, year) in order."""
    parts = F.transform(hits, lambda h, i: F.concat(F.array_join(words(h["text"]), " "), F.lit(" ("), h["title"], F.lit(", "), h["year"], F.lit(") ["), (i + 1).cast("string"), F.lit("]")))
    system = F.concat(F.lit(SYSTEM), F.when(questions.depends_on_time(question), F.lit(NO_CLOCK)).otherwise(F.lit("")))
    return F.struct(system.alias("system"), F.concat(F.lit("Sources:\n\n"), F.array_join(parts, "\n\n"), F.lit("\n\nFarmer's question: "), question).alias("user"))


def considered(asked: DataFrame) -> DataFrame:
    """``asked`` (query_id, question) with language, reason (null: in scope), search_text."""
    q = F.col("question")
    df = asked.withColumn("language", language.detect(q))
    df = df.withColumn("reason", scope.refusal_reason(language.pidgin_normalised(q), F.col("language")))
    return df.withColumn("search_text", questions.prepared(q, F.col("language")))


def advise(asked: DataFrame, hits: DataFrame, now: int, generate: Generator = extractive) -> DataFrame:
    """One row a question: answer, refused, why, language, citations, safety.

    ``asked``: from ``considered``; ``hits``: query_id, hit, text, shown, title,
    year, publisher, page_start, page_end (text: whole, for the safety check;
    shown: compressed, for the prompt).
    """
    cite = citation(F.col("title"), F.col("year"), F.col("publisher"), F.col("page_start"), F.col("page_end"))
    each = hits.select("query_id", F.struct("hit", "text", F.coalesce("shown", "text").alias("shown"), "title", "year", cite.alias("citation")).alias("h"))
    found = each.groupBy("query_id").agg(F.array_sort(F.collect_list("h")).alias("hits"))  # a few rows a question
    df = asked.join(found, "query_id", "left")
    q, lang = F.col("question"), F.col("language")
    why = (
        F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when(F.col("hits").isNull(), "no guidance")
        .when(questions.cannot_be_settled(q), "regulatory status")
    )
    df = df.withColumn("why", why).withColumn("prompt", F.when(why.isNull(), prompt(q, F.transform("hits", lambda h: F.struct(h["shown"].alias("text"), h["title"], h["year"])))))
    raw = F.when(F.col("why").isNull(), generate(F.col("prompt"), F.col("hits.shown")))
    df = df.withColumn("raw", safety.without_citation_run(safety.without_money(raw)))
    df = df.withColumn("why", F.when(F.col("why").isNull() & F.col("raw").isNull(), "citations only").otherwise(F.col("why")))
    df = df.withColumn("clean", safety.without_echo(safety.without_disclaimer(F.col("raw")), q))
    sources = F.coalesce(F.col("hits.text"), F.array().cast("array<string>"))
    years = F.coalesce(F.col("hits.year"), F.array().cast("array<string>"))
    df = df.withColumn("safety", F.when(F.col("clean").isNotNull(), safety.verdict(F.col("clean"), sources, q, years, now)))
    spoken = let(safety.replaced(F.col("clean"), F.col("safety.unsupported_doses"), X.DOSE_REMOVED), lambda a: let(safety.notice(F.col("safety"), lang), lambda n: F.when(n == "", a).otherwise(F.concat(a, F.lit("\n\n---\n"), n))))
    refusal = F.coalesce(scope.refusal_text(F.col("reason"), lang), scope.message("no_guidance", lang))
    return df.select("query_id", "question", lang, F.when(F.col("why").isNull(), spoken).otherwise(refusal).alias("answer"), F.col("why").isNotNull().alias("refused"), "why", F.transform(F.coalesce("hits", F.array().cast(df.schema["hits"].dataType)), lambda h, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), h["citation"])).alias("citations"), F.coalesce(F.col("safety.safe"), F.lit(True)).alias("safe"))
