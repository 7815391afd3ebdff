"""Relevance of documents by lexicons: hits of each group, score, decision."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.language import stopword_votes
from ..functions.text import find_all, let, words
from . import lexicons

GROUPS = {**X.POSITIVE_GROUPS, "institutional": X.INSTITUTIONAL_TERMS, "africa": X.AFRICA_TERMS, "elsewhere": X.ELSEWHERE_TERMS}


#: Hits are numbered: the group's place times this, and the term's place in it.
WIDE = 10_000


def _listed(values) -> Column:
    """A literal array of words."""
    return F.split(F.lit("\x01".join(values)), "\x01")


def _tokens(low: Column) -> Column:
    return find_all(low, r"[\p{L}\p{N}_]+")


def _numbered(groups: dict) -> dict[int, str]:
    return {g * WIDE + i: t for g, terms in enumerate(groups.values()) for i, t in enumerate(sorted(set(terms)))}


def _hits(low: Column, tokens: Column, groups: dict) -> Column:
    """(id, n) of the terms of all groups that occur: single words as words (or with an s), phrases anywhere, those of several parts by pattern.

    ``tokens``, the words of ``low``, are looked up once; only those that some term has go further.
    """
    terms = _numbered(groups)
    plain, phrases = {i: t for i, t in terms.items() if t.isalpha()}, {i: t for i, t in terms.items() if " " in t}
    entry = lambda i, n: F.struct(i.cast("int").alias("id"), n.cast("int").alias("n"))
    parts = [F.array().cast("array<struct<id:int,n:int>>")]
    if plain:
        forms: dict[str, list[int]] = {}
        for i, t in plain.items():
            for form in (t, t + "s"):
                forms.setdefault(form, []).append(i)
        ids = F.from_json(F.lit(json.dumps(forms)), "map<string,array<int>>")
        some = let(F.filter(tokens, lambda w: w.isin(*forms)), lambda ws: F.flatten(F.transform(ws, lambda w: F.element_at(ids, w))))
        parts.append(let(some, lambda found: F.transform(F.array_distinct(found), lambda i: entry(i, F.size(F.filter(found, lambda x: x == i))))))
    if phrases:
        numbers = F.split(F.lit(",".join(map(str, phrases))), ",").cast("array<int>")
        times = lambda p: (F.length(low) - F.length(F.replace(low, p, F.lit("")))) / F.length(p)
        parts.append(F.transform(_listed(phrases.values()), lambda p, k: entry(F.get(numbers, k), times(p))))
    rest = {i: t for i, t in terms.items() if i not in plain and i not in phrases}
    if rest:
        parts.append(F.array(*(entry(F.lit(i), F.regexp_count(low, F.lit(r"\b" + t.replace(".", r"\.") + r"(?:s\b|\b)"))) for i, t in rest.items())))
    return F.filter(F.concat(*parts), lambda x: x["n"] > 0)


def _total(hits: Column, group: int) -> Column:
    return F.aggregate(F.filter(hits, lambda x: F.floor(x["id"] / WIDE) == group), F.lit(0), lambda a, x: a + x["n"])


def term_hits(text: Column, terms) -> Column:
    """(term, n) of the terms that occur in ``text``."""
    groups = {"terms": terms}
    names = _listed(_numbered(groups).values())
    return let(F.lower(text), lambda low: F.transform(_hits(low, _tokens(low), groups), lambda x: F.struct(F.get(names, x["id"]).alias("term"), x["n"].alias("n"))))


def total(hits: Column) -> Column:
    return F.aggregate(hits, F.lit(0), lambda a, x: a + x["n"])


def scored(documents: DataFrame, text: str = "text", groups: dict | None = None, automaton: bool = True) -> DataFrame:
    """``documents`` with n_words, n_<group>, positive, score, language, english_share, areas, crops, accepted, reason, top_terms.

    Terms are found by ``lexicons`` in one pass of each text; without ``automaton`` each is looked for by itself, and the rows are the same.
    """
    groups = GROUPS if groups is None else groups
    t = F.coalesce(F.col(text), F.lit(""))
    votes_ = {f"__v_{lang}": n for lang, n in stopword_votes(t).items()}
    df = documents.withColumns({"n_words": F.greatest(F.size(words(t)), F.lit(1)), "__low": F.lower(t), **votes_})
    df = lexicons.with_hits(df, "__low", _numbered(groups), "__hits") if automaton else df.withColumn("__hits", _hits(F.col("__low"), _tokens(F.col("__low")), groups))
    positive = [g for g in groups if g not in ("institutional", "africa", "elsewhere")]
    df = df.withColumns({f"n_{g}": _total(F.col("__hits"), i) for i, g in enumerate(groups)})
    df = df.withColumn("positive", reduce(lambda a, b: a + b, (F.col(f"n_{g}") for g in positive)))
    df = df.withColumn("score", (F.col("positive") - 2.0 * F.col("n_institutional")) * 1000.0 / F.col("n_words"))
    votes = [f"__v_{k}" for k in X.LANGUAGE_STOPWORDS]
    cast = reduce(lambda a, b: a + b, map(F.col, votes))
    best = reduce(lambda rest, k: F.when(F.col(f"__v_{k}") == F.greatest(*votes), k).otherwise(rest), reversed(list(X.LANGUAGE_STOPWORDS)), F.lit(None).cast("string"))
    df = df.withColumn("language", F.when(cast < 20, "unknown").otherwise(best)).withColumn("english_share", F.when(cast < 20, 0.0).otherwise(F.col("__v_en") / cast))
    need = F.greatest(F.lit(6), F.least(F.lit(25), F.floor(F.col("n_words") / 40)))
    least = F.greatest(F.lit(3), F.least(F.lit(10), F.floor(F.col("n_words") / 80)))
    crop = F.col("n_symptom") + F.col("n_agronomy") + F.col("n_organism") + F.col("n_control")
    areas = F.array_compact(F.array(F.when(crop >= least, "crop"), *(F.when(F.col(f"n_{a}") >= least, a) for a in ("livestock", "weather", "market"))))
    low = F.col("__low")
    crops = F.array_sort(F.array_compact(F.array(*(F.when(reduce(lambda a, b: a | b, (F.contains(low, F.lit(x)) for x in names)), c) for c, names in X.CROP_TERMS.items()))))
    present = reduce(lambda a, b: a + b, ((F.col(f"n_{g}") > 0).cast("int") for g in positive))
    africa, elsewhere = F.col("n_africa"), F.col("n_elsewhere")
    reason = (
        F.when(~F.col("language").isin("en", "unknown") & (F.col("english_share") < 0.55), "not English")
        .when(F.col("positive") < need, "too little guidance vocabulary")
        .when((present < 2) & (F.col("positive") / F.col("n_words") > 0.30), "term listing, not guidance")
        .when(F.col("score") < 6.0, "institutional prose dominates")
        .when(africa >= 40, "practical guidance")
        .when((africa == 0) & (elsewhere > 0), "no African context")
        .when(elsewhere > F.greatest(africa, F.lit(1)), "regionally out of scope")
        .otherwise("practical guidance")
    )
    df = df.withColumns({"areas": areas, "crops": crops, "reason": reason}).withColumn("accepted", F.col("reason") == "practical guidance")
    good, names = [i for i, g in enumerate(groups) if g in positive], F.from_json(F.lit(json.dumps(_numbered(groups))), "map<string,string>")
    every = F.transform(F.filter("__hits", lambda x: F.floor(x["id"] / WIDE).isin(*good)), lambda x: F.struct((-x["n"]).alias("k"), F.element_at(names, x["id"].cast("string")).alias("term"), x["n"].alias("n")))
    df = df.withColumn("top_terms", F.transform(F.slice(F.array_sort(every), 1, 12), lambda x: F.struct(x["term"], x["n"])))
    return df.drop(*(c for c in df.columns if c.startswith("__")))
