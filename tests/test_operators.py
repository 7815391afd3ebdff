"""Operators against plain Python models."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import answer, chunk, compress, dedup, dense, evaluate, html, ingest, lexical, relevance, search, tables
from corpusloom.plans import fixtures as fx


def test_fusion_equals_the_interleaving_loop(spark):
    r = random.Random(3)
    cases, dense_rows, lex_rows = [], [], []
    for q in range(60):
        d, lx = r.sample(range(12), r.randint(0, 8)), r.sample(range(12), r.randint(0, 8))
        cases.append((d, lx))
        dense_rows += [(q, i, n, 0.5) for n, i in enumerate(d, 1)]
        lex_rows += [(q, i, n) for n, i in enumerate(lx, 1)]
    out = search.fuse(spark.createDataFrame(dense_rows, "query_id int, id int, rank int, score double"), spark.createDataFrame(lex_rows, "query_id int, id int, rank int"), top=7)
    got = {}
    for row in out.orderBy("query_id", "fused_rank").collect():
        got.setdefault(row["query_id"], []).append(row["id"])
    for q, (d, lx) in enumerate(cases):
        score = {}
        for ranking in (d, lx):
            for n, i in enumerate(ranking):
                score[i] = score.get(i, 0) + 1 / (61 + n)
        sure = []
        for n in range(2):
            for s in (lx, d):
                if n < len(s) and s[n] not in sure:
                    sure.append(s[n])
        want = (sure + [i for i in sorted(score, key=lambda i: -score[i]) if i not in sure])[:7]
        assert got.get(q, []) == want


def test_one_sort_equals_four_stable_partitions(spark):
    q = "yellow twisted leaves with cottony mass on my cassava plant"
    texts = ["Mealybug on cassava", "storage storing stored bagging of dry cassava in silo", "mango trees", "cassava mosaic in vitro accession", "cassava planting", "okra and mealybug", "plain words"]
    hits = spark.createDataFrame([(1, i, "", t, q, i) for i, t in enumerate(texts)], "query_id int, id int, title string, text string, query string, fused_rank int")
    rows = {r["id"]: r for r in search.rerank(hits).collect()}
    order = list(range(len(texts)))
    for flag in ("offcrop", "not_named", "research", "postharvest"):
        order = [i for i in order if not rows[i][flag]] + [i for i in order if rows[i][flag]]
    assert order == sorted(rows, key=lambda i: rows[i]["place"])
    assert rows[2]["offcrop"] and rows[5]["offcrop"] and not rows[6]["offcrop"] and rows[1]["postharvest"] and rows[3]["research"] and rows[4]["not_named"]


def test_dense_search_equals_numpy(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(200, 8))
    v[50] = v[60]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>").repartition(6)
    out = dense.search(df, df.filter("id % 40 = 0").withColumnRenamed("id", "query_id"), k=5, not_itself=True)
    for q in range(0, 200, 40):
        s = v @ v[q]
        s[q] = -np.inf
        want = sorted(range(200), key=lambda i: (-round(s[i], 9), i))[:5]
        assert [r["id"] for r in out.filter(F.col("query_id") == q).orderBy("rank").collect()] == want


@pytest.mark.parametrize("n", [8, 16, 17, 64])
def test_query_blocks_give_the_same(spark, monkeypatch, n):
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(70)], "id long, embedding array<double>").repartition(3)
    asked = df.filter(F.col("id") < n).withColumnRenamed("id", "query_id")
    asked = asked.unionByName(asked.filter("query_id = 3")).unionByName(spark.createDataFrame([(3, [9.0, 9.0, 9.0])] * 9, asked.schema))
    whole = sorted(map(tuple, dense.search(df, asked, k=3).collect()))
    assert len(whole) == 3 * n
    monkeypatch.setattr(dense, "BLOCK", 8)
    made = tables.blocks(asked.groupBy("query_id").agg(F.min("embedding").alias("embedding")), 8)
    assert [b.count() for b in made] == [8] * (n // 8) + [n % 8] * (n % 8 > 0)
    assert sorted(map(tuple, dense.search(df, asked, k=3).collect())) == whole


def test_bm25_on_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, "the and"), (3, "cassava cuttings")], "doc_id long, text string")
    ask = spark.createDataFrame([(1, "the"), (2, "cassava"), (3, None)], "query_id long, text string")
    assert [(r["query_id"], r["id"], r["rank"]) for r in lexical.search(docs, ask).collect()] == [(2, 3, 1)]
    assert lexical.corpus_stats(docs.limit(0)).first()["avg_len"] == 0.0 and lexical.search(docs.limit(0), ask).collect() == []


def test_hashed_embedding_is_unit_length(spark):
    docs = spark.createDataFrame([(1, "cassava mosaic cassava"), (2, "")], "id long, text string")
    got = {r["id"]: np.array(r["embedding"]) for r in dense.hashed_embedding(docs).collect()}
    assert np.linalg.norm(got[1]) == pytest.approx(1) and not got[2].any()


def test_greedy_selection_stops_at_the_first_that_does_not_fit(spark):
    def model(sentences, budget):
        forced = {i for i, (s, _) in enumerate(sentences) if "never" in s}
        if len(sentences) <= 2:
            return list(range(len(sentences)))
        keep, used = set(forced), sum(len(sentences[i][0]) for i in forced) / 3.5
        for i in sorted((i for i in range(len(sentences)) if i not in forced), key=lambda i: -sentences[i][1]):
            cost = len(sentences[i][0]) / 3.5
            if used + cost > budget and len(keep) >= 2:
                break
            keep.add(i)
            used += cost
        return sorted(keep)

    r, rows, want = random.Random(9), [], {}
    for k in range(50):
        s = [("never " * (r.random() < 0.2) + "w" * r.randint(5, 120) + str(i), r.random()) for i in range(r.randint(1, 8))]
        want[k] = " ".join(s[i][0] for i in model(s, 40))
        rows += [(k, i, t, x, 40) for i, (t, x) in enumerate(s)]
    df = spark.createDataFrame(rows, "id int, pos int, sentence string, score double, budget int")
    assert {x["id"]: x["text"] for x in compress.select(df, ["id"]).collect()} == want


def test_hits_are_compressed_towards_the_query(spark):
    text = "Cassava mosaic is spread by whitefly. The sea was calm on that day. Never spray in wind. Ships came home with the tide in the evening. Uproot sick cassava plants. " + "Gulls cried over the harbour all morning long and nobody heard them. " * 8
    hits = spark.createDataFrame([(1, 1, text), (1, 2, "One. Only two long sentences are here."), (2, 1, "")], "query_id long, hit int, text string")
    asked = dense.hashed_embedding(spark.createDataFrame([(1, "cassava mosaic whitefly"), (2, "x")], "id long, text string")).withColumnRenamed("id", "query_id")
    got = {(r["query_id"], r["hit"]): r for r in compress.compressed(hits, asked, total=60).collect()}
    first = got[1, 1]
    assert "whitefly" in first["shown"] and "Never spray in wind." in first["shown"] and "Uproot" in first["shown"] and len(first["shown"]) < len(text) / 2
    assert first["forced"] == 1 and first["kept"] < first["n_sentences"] and first["after"] < first["before"] == int(len(text) / 3.5)
    assert got[1, 2]["shown"] == "One. Only two long sentences are here." and got[2, 1]["shown"] == ""


def test_breakdown_and_memory(spark):
    rows = spark.createDataFrame([("a", True, True, False), ("a", True, False, True), ("a", False, False, True), ("b", False, True, False)], "crop string, in_scope boolean, covered boolean, refused boolean")
    got = {r["crop"]: (r["coverage"], r["refusal"], r["pass"]) for r in evaluate.breakdown(rows, ["crop"]).collect()}
    assert got == {"a": (0.5, 1.0, False), "b": (None, 0.0, False)}
    assert evaluate.memory_budget(spark.createDataFrame([("x", 3.0), ("y", 4.5)], "name string, mb double"), 7.0).first()["fits"] is False


def test_near_pairs_and_greedy_keep(spark):
    r = random.Random(4)
    base = [[f"w{r.randrange(500)}" for _ in range(60)] for _ in range(8)]
    docs = []
    for i in range(64):
        w = list(base[i % 8])
        for _ in range(i // 16):
            w[r.randrange(60)] = f"n{i}"
        docs.append(" ".join(w))
    docs += ["", "a b"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")

    def runs(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets, jac = [runs(t) for t in docs], lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    first = {}
    for i, t in enumerate(docs):
        first.setdefault(frozenset(sets[i]) or i, i)
    reps = sorted(first.values())
    want = {(a, b) for a in reps for b in reps if a < b and jac(sets[a], sets[b]) >= 0.75}
    assert {(x["a"], x["b"]) for x in dedup.near_pairs(df).collect()} == want and want
    kept = []
    for i in range(len(docs)):
        if not any(jac(sets[i], sets[k]) >= 0.75 for k in kept):
            kept.append(i)
    assert sorted(x["id"] for x in dedup.near_keep(df).filter("kept").collect()) == kept


def test_chunks_hold_their_limits(spark):
    r = random.Random(1)
    para = lambda n: " ".join("word" + str(r.randrange(99)) + ("." if r.random() < 0.1 else "") for _ in range(n))
    pages = ["Pests of cassava\n" + para(300) + "\n\nSymptoms:\n" + para(20), "", "Harvest:\n" + para(700) + "\n\n" + "x" * 4000]
    got = chunk.pack(pages, "A title")
    assert all(len(t) <= 1575 + 140 + len("Pests of cassava") + 1 for t, *_ in got) and all(len(t) >= 140 for t, *_ in got)
    assert all(1 <= a <= b <= 3 for _, a, b in got) and all(t.startswith("A title\n") for t, *_ in got)
    words = set(" ".join(pages).split())
    assert words - {"Symptoms:"} <= set(" ".join(t for t, *_ in got).split()) | {w for w in words if len(w) > 100}
    df = spark.createDataFrame([("d", "A title", pages, "p", "2001", "l", "u"), ("e", None, None, "p", "2001", "l", "u")], "doc_id string, title string, pages array<string>, publisher string, year string, licence string, source_url string")
    rows = chunk.chunks(df).orderBy("chunk_index").collect()
    assert [(x["text"], x["page_start"], x["page_end"]) for x in rows] == got and [x["chunk_index"] for x in rows] == list(range(len(got)))


def test_windows_cover_every_line_once_or_by_their_overlap():
    r = random.Random(11)
    kinds = ["Pests:", "PLANTING MATERIAL", "Harvest and storage", "Name: x", "short line here.", "A sentence of some length that goes on. " * 4, "w" * 500, "many words " * 60]
    for _ in range(400):
        pages = ["\n\n".join(r.choice(kinds) for _ in range(r.randint(0, 14))) for _ in range(r.randint(1, 3))]
        text, lines = chunk.layout(pages, 1575)
        got = chunk.windows(text, lines, len(pages), 1575, 210, 140, lossy=False)
        assert text == "\n".join(text[x.start : x.end] for x in lines)
        covered = set()
        for w, then in zip(got, [*got[1:], None]):
            assert w.end - w.start >= 140 and w.first_page <= w.last_page and not text[w.start].isspace()
            assert w.end == len(text) or any(x.end == w.end for x in lines)
            assert then is None or w.end - 210 <= then.start <= w.end + 1  # an overlap at most, and no gap
            covered.update(range(w.start, w.end))
        left = [x for x in lines if not set(range(x.start, x.end)) <= covered]
        assert sum(x.end - x.start + 1 for x in left) <= 140 and all(x.end > (got[-1].end if got else 0) for x in left)  # only a short end


def test_pieces_hold_their_size_and_all_words():
    r = random.Random(12)
    for _ in range(300):
        text = " ".join(r.choice(["One two. ", "three! ", "four " * r.randint(1, 9), "z" * r.randint(1, 90)]) for _ in range(r.randint(1, 30))).strip()
        got = chunk.pieces(text, 60)
        assert all(0 < len(p) <= 60 and p == p.strip() for p in got) and "".join("".join(got).split()) == "".join(text.split())


def test_marks_inside_of_elements():
    page = "<div class=sidebar><p>no<div>no</div></p></div><p>yes<img class=sidebar>still<br>here</p><h2>Head <b>line</b></h2><nav>no<p>no</nav>after<title>T&amp;t</title><script>if (a<b) x('</p>')</script>end"
    text, title, headings, has_main = html.read(page)
    assert text.split() == ["yesstill", "here", "Head", "line", "afterend"] and title == "T&t" and headings == ["Head", "line"] and not has_main
    text, _, _, has_main = html.read("before<main>in<aside>out</aside><div>deep</div></main>after<main>again")
    assert "".join(text.split()) == "beforeindeepagain" and has_main


def test_short_text_before_a_long_piece_is_not_lost():
    page = "short start.\n\n" + "y" * 100 + ". " + "z" * 1500
    assert not any("short start" in t for t, *_ in chunk.pack([page], "", lossy=True))
    assert any("short start" in t for t, *_ in chunk.pack([page], ""))


PAGE = """<html><head><title>Mites | The Site</title><style>p{}</style><script>var t="</p>no";</script></head><body class="toolbar">
<nav><ul><li>menu</li></ul></nav><div class="sidebar x"><div>in</div>side</div><h1>Red mites on crops</h1><p>Mites feed on leaves of plants<p>They make fine webs below leaves</body>"""


def test_html(spark):
    main = "<body><h2>x</h2><p>outside of the main part</p><main><p>inside of the main part</p></main><p>after the main part</p>"
    df = spark.createDataFrame([(1, PAGE), (2, main), (3, None), (4, "<p>broken <b")], "page_id long, html string")
    got = {r["page_id"]: r for r in html.extract(df, site_suffix="The Site").collect()}
    assert got[1]["title"] == "Mites" and got[1]["headings"] == ["Red mites on crops"]
    assert got[1]["text"] == "Red mites on crops\nMites feed on leaves of plants\nThey make fine webs below leaves"
    assert got[2]["has_main"] and "inside of the main part" in got[2]["text"] and "after" not in got[2]["text"]
    assert got[3]["title"] == "(untitled)" and got[3]["n_chars"] == 0


def test_relevance(spark):
    good = "Cassava mosaic causes yellowing and stunted plants in Nigeria. Farmers should prune, weeding and rotation help. Aphids and whiteflies are a vector. " * 4
    rows = [good, "The steering committee and stakeholders held a workshop participants report. " * 20, "les des une dans pour sur avec est sont cette aux par plus leur " * 5, good.replace("Nigeria", "Florida"), ""]
    got = relevance.scored(spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, text string")).orderBy("i").collect()
    assert [r["accepted"] for r in got] == [True, False, False, False, False] and got[3]["reason"] == "no African context" and got[2]["reason"] == "not English"
    assert got[0]["n_symptom"] == 12 and got[0]["crops"] == ["cassava"] and got[0]["top_terms"][0]["n"] == 4


def test_gates_and_manifest(spark):
    rec = fx.frame(spark, fx.RECORDS, "id string, access string, licence string, kind string")
    why = {r["id"]: r["w"] for r in rec.select("id", ingest.vet(F.col("access"), F.col("licence"), F.col("kind")).alias("w")).collect()}
    assert why["a1"] is None and why["a6"] is None and why["a2"].startswith("licence: NoDerivatives") and why["a3"].startswith("access") and why["a5"].startswith("type: journal article") and why["a7"] == "access rights: unspecified"
    pdf = b"%PDF-1.4" + b"x" * 2000 + b"%%EOF\n"
    ok = spark.createDataFrame([(pdf,), (pdf[:-6],), (b"%PDF-%%EOF",), (b"y" + pdf,)], "c binary").select(ingest.is_complete_pdf(F.col("c")).alias("x"))
    assert [r["x"] for r in ok.collect()] == [True, False, False, False]


def test_percentiles_by_place(spark):
    values = [5.0, 1.0, 9.0, 3.0, 3.0, 7.0, 2.0]
    got = evaluate.by_index(spark.createDataFrame([(x,) for x in values], "x double"), "x", {"p50": 0.5, "p95": 0.95, "p100": 1.0}).first()
    s = sorted(values)
    assert (got["n"], got["p50"], got["p95"], got["p100"]) == (7, s[3], s[6], s[6])


def test_split_is_stable_and_even(spark):
    ids = spark.createDataFrame([(f"q{i}",) for i in range(400)], "id string")
    sides = [r["s"] for r in ids.select(evaluate.side(F.col("id")).alias("s")).collect()]
    assert sides == [r["s"] for r in ids.select(evaluate.side(F.col("id")).alias("s")).collect()] and 150 < sides.count("dev") < 250


def test_answers_flow(spark):
    asked = answer.considered(spark.createDataFrame([(1, "My cassava leaves have brown spots"), (2, "What is the current price of yam?"), (3, "Is paraquat registered for use in Nigeria?"), (4, "How do I plant okra?")], "query_id long, question string"))
    hits = spark.createDataFrame([(1, 1, "Spray 20 ml per litre of water. Remove sick plants. Sell for N500.", None, "T", "2001", "P", 1, 2), (3, 1, "Text.", None, "T", "2001", "P", 1, 1)], "query_id long, hit int, text string, shown string, title string, year string, publisher string, page_start int, page_end int")
    got = {r["query_id"]: r for r in answer.advise(asked, hits, 2026).collect()}
    assert not got[1]["refused"] and got[1]["citations"] == ["[1] T (2001), P, pp. 1-2"] and "N500" not in got[1]["answer"] and not got[1]["safe"]
    assert [got[i]["why"] for i in (2, 3, 4)] == ["live price", "regulatory status", "no guidance"] and all(got[i]["answer"] for i in got)
    talk = answer.advise(asked.filter("query_id = 1"), hits, 2026, generate=lambda prompt, sources: F.lit("[1] [2] ")).first()
    assert talk["refused"] and talk["why"] == "citations only"


def test_near_pairs_shuffle_runs_of_sets_in_company_only(spark, monkeypatch):
    from corpusloom.operators import dedup

    r = random.Random(8)
    prose = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    alone, twin = [prose(200) for _ in range(40)], prose(200)
    rows = [*enumerate(alone), *enumerate(alone[:20], 100), (50, twin), (51, twin + " more words"), (52, twin), (53, None), (54, "")]
    rows += [(200 + i, prose(150) + " a line that very many texts have at their end") for i in range(20)]
    df, kept = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), {}
    monkeypatch.setattr(dedup, "stored", lambda df, tag, f=dedup.stored: kept.setdefault(tag, f(df, tag)))
    assert [(x["a"], x["b"]) for x in dedup.near_pairs(df).collect()] == [(50, 51)]
    assert kept["dedup-company"].count() == 2 and kept["dedup-known"].count() == 2  # neither copies nor sets alone go on
    plan = kept["dedup-known"].count() and dedup._of_rows(kept["dedup-sets"], kept["dedup-company"], kept["dedup-alone"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan  # sets stay where they are


def test_search_of_frequent_and_rare_terms_in_parts(spark, monkeypatch):
    """Products of few columns, sums of few pairs and blocks of few queries give what brute force gives, ties by the first term's place, then by id."""
    import math
    from collections import Counter

    r = random.Random(11)
    words_ = [f"w{i}x" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = {i: r.choices(words_, weights, k=r.randrange(0, 30)) for i in range(300)}
    asks = {q: r.choices(words_, weights, k=r.randrange(1, 12)) for q in range(23)} | {23: ["w59x"], 24: ["absent"]}
    for name, value in (("QUERIES", 10), ("PASSAGES", 70), ("OFTEN", 0.05), ("COLUMNS", 3), ("PAIRS", 50)):
        monkeypatch.setattr(lexical, name, value)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in docs.items()], "doc_id long, text string").repartition(3)
    got = lexical.search(df, spark.createDataFrame([(q, " ".join(t)) for q, t in asks.items()], "query_id long, text string"), 7).collect()
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df_ = Counter(t for d in docs.values() for t in set(d))
    want = []
    for q, terms_ in asks.items():
        found = []
        for i, d in docs.items():
            if both := set(terms_) & set(d):
                tf, times = Counter(d), Counter(terms_)
                s = sum(times[t] * math.log(1 + (n - df_[t] + 0.5) / (df_[t] + 0.5)) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in both)
                found.append((-round(s, 9), min(terms_.index(t) for t in both), i))
        want += [(q, rank, i) for rank, (_, _, i) in enumerate(sorted(found)[:7], 1)]
    assert sorted((x["query_id"], x["rank"], x["id"]) for x in got) == sorted(want)


def test_names_absent_from_a_text_are_not_sought_as_words(spark):
    from corpusloom.functions import safety

    df = spark.createDataFrame([("Use DDT, not addtion; Methyl-Parathion too.",), ("addtions",), (None,)], "a string")
    assert [r["h"] for r in df.select(safety.hazardous(F.col("a")).alias("h")).collect()] == [["ddt", "parathion"], [], []]
    plan = df.select(safety.hazardous(F.col("a")).alias("h"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("contains(") >= 3
