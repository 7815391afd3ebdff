"""The automaton against regular expressions and against the column function."""

import random
import re

import pytest

from corpusloom.operators import lexicons, relevance

TERMS = ["pest", "pests", "maize", "sub-saharan", "p-value", "dry season", "season dry", "a a", "co.op", "ü", "soil", "oil", "farm", "army worm"]


def plain(text, term):
    if term.isalpha():
        return sum(w in (term, term + "s") for w in re.findall(r"[^\W]+", text))
    if " " in term:
        return text.count(term)
    return len(re.findall(r"\b" + re.escape(term) + r"(?:s\b|\b)", text))


@pytest.mark.parametrize("stretch", [1, 7, 2048])
def test_counts_equal_regular_expressions(monkeypatch, stretch):
    monkeypatch.setattr(lexicons, "STRETCH", stretch)
    r = random.Random(stretch)
    parts = [*TERMS, "s", "ss", " ", " ", "-", ".", "\n", "é", "_", "7", "a", "a a a a", "pestss", "xmaize", "soils", "é😀"]
    texts = ["".join(r.choice(parts) + r.choice(["", " "]) for _ in range(r.randrange(30))) for _ in range(300)] + ["", "maize", "pests"]
    got = lexicons.Automaton(dict(enumerate(TERMS))).counts(texts)
    for t, hits in zip(texts, got, strict=True):
        assert dict(hits) == {i: n for i, term in enumerate(TERMS) if (n := plain(t, term))}, t


def test_rows_equal_the_column_function(spark):
    texts = [None, "", "Maize pests in the dry season; sub-saharan soils. " * 3, "x" * 50_000 + " Farms and ARMY WORM", "ﬁ İstanbul farm's soil_ 7soil"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    low = df.selectExpr("*", "lower(coalesce(text, '')) AS low")
    want = {r["id"]: sorted((x["term"], x["n"]) for x in r["h"]) for r in df.select("id", relevance.term_hits(lexicons.F.coalesce("text", lexicons.F.lit("")), TERMS).alias("h")).collect()}
    names = dict(enumerate(sorted(set(TERMS))))
    got = {r["id"]: sorted((names[x["id"]], x["n"]) for x in r["hits"]) for r in lexicons.with_hits(low, "low", names).collect()}
    assert got == want
    assert lexicons.with_hits(low, "low", {}).filter("size(hits) > 0").count() == 0


def test_documents_are_scored_in_one_pass_of_each_text(spark):
    df = spark.createDataFrame([(1, "Maize pests in the dry season of Kenya. " * 9), (2, None), (3, "steering committee " * 30)], "id long, text string")
    found = relevance.scored(df)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "regexp_count" not in plan.lower()  # no term is looked for by itself
    same = relevance.scored(df, automaton=False).select(*found.columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, same.collect()))
