"""Search by blocks of impacts against the whole index."""

import random

import numpy as np
import pytest

from corpusloom.operators import impacts, lexical


def test_packed_numbers_come_back():
    r = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 5), (300, 200), (300, 70_000), (5, 2**40)):
        gaps, tf, dl = (r.integers(0, top, size=n) for _ in range(3))
        at, tf2, dl2 = impacts.unpacked(impacts.packed(gaps, tf, dl), n)
        assert (at == np.cumsum(gaps)).all() and (tf2 == tf).all() and (dl2 == dl).all()


@pytest.mark.parametrize("kind", ["long", "string"])
def test_rows_equal_the_whole_index_with_fewer_blocks(spark, kind):
    r = random.Random(2)
    common, rare = [f"word{i}" for i in range(30)], [f"rare{i}" for i in range(400)]
    texts = [" ".join(r.choice(common) for _ in range(r.randrange(3, 60))) + " " + " ".join(rare[(i // 8 + j) % 400] for j in range(2)) for i in range(1200)]
    texts[700:900] = [texts[700]] * 200  # equal passages: ties by id
    df = spark.createDataFrame([(f"p{i:05d}" if kind == "string" else i, t) for i, t in enumerate([*texts, None, ""])], f"doc_id {kind}, text string").repartition(7)
    asked = spark.createDataFrame([(i, f"{rare[i * 9]} {rare[i * 9 + 1]} word1 word2") for i in range(30)] + [(90, "unknown"), (91, None), (92, "word3 word4 word5"), (93, texts[700])], "query_id long, text string")
    index, reads = lexical.build(df), []
    want = sorted(tuple(x) for x in lexical.search(index, asked, 10).selectExpr("query_id", "rank", "id", "round(score, 9)").collect())
    got = sorted(tuple(x) for x in impacts.search(impacts.build(index, span=32), asked, 10, reads).selectExpr("query_id", "rank", "id", "round(score, 9)").collect())
    assert got == want and len(want) > 300
    scored, all_blocks, pairs, all_pairs = reads[0]
    assert scored <= all_blocks and pairs < 0.6 * all_pairs, reads


def test_nothing_to_search(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "yam")], "query_id long, text string")
    assert impacts.search(impacts.build(lexical.build(df)), asked).count() == 0


def test_an_index_is_made_and_read_without_a_shuffle_of_postings(spark):
    r = random.Random(5)
    texts = [" ".join(f"word{r.randrange(60)}" for _ in range(r.randrange(1, 20))) for _ in range(9000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame([(i, f"word{i} word{i + 1} word7") for i in range(12)], "query_id long, text string")
    one, many = lexical.build(df.repartition(1)), lexical.build(df.repartition(7))
    found = [sorted(tuple(x) for x in lexical.search(i, asked, 15).selectExpr("query_id", "rank", "id", "round(score, 9)").collect()) for i in (one, many)]
    assert found[0] == found[1] and len(found[0]) == 180  # one task takes several tables of passages
    assert one.passages.count() == 9000 and one.postings.filter("term = ''").count() == 9000
    best = lexical._best(one, spark.createDataFrame([(1, [("word7", 1, 0, 5)])], "query_id long, terms array<struct<term:string,times:long,pos:int,df:long>>"), 5)
    for plan in (lexical.counted(df), best):
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_blocks_packed_at_once_are_those_packed_one_by_one():
    r = np.random.default_rng(3)
    sizes = [1, 7, 300, 2, 1]
    at = np.cumsum([0, *sizes[:-1]])
    gaps, tf, dl = r.integers(0, 1024, sum(sizes)), r.integers(1, 300, sum(sizes)), r.integers(1, 90_000, sum(sizes))
    tf[-1], dl[0] = 2**40, 255
    want = [impacts.packed(gaps[a : a + n], tf[a : a + n], dl[a : a + n]) for a, n in zip(at, sizes, strict=True)]
    assert impacts.packed_blocks(at, gaps, tf, dl).to_pylist() == want


def test_build_shuffles_passages_once_and_no_postings(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"word{i % 7} word{i % 11} yam") for i in range(500)] + [(None, "yam")], "doc_id long, text string")
    index, plans = lexical.build(df), []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, *a, f=type(df).mapInArrow, **b: (plans.append(self._jdf.queryExecution().executedPlan().toString()), f(self, *a, **b))[1])
    made = impacts.build(index, span=16)
    assert len(plans) == 1 and plans[0].count("Exchange rangepartitioning") == 1 and "Join" not in plans[0] and "Generate" not in plans[0]
    assert [x["id"] for x in made.passages.orderBy("n").collect()] == list(range(500))
