"""Table functions against the operators that make the same rows."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import tables, text
from corpusloom.operators import chunk

WORDS = "The farm has yams and maize. It is dry! Why? Because rain is late. HARVEST NOTES: "


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, [f"Heading {i}\n" + WORDS * (i * 7 % 40), None, "  ", WORDS * (i % 3)], f"title {i % 3}" if i % 4 else None, "P", "2001", "CC BY", "http://x") for i in range(12)]
    rows += [(100, None, None, None, None, None, None), (None, [WORDS * 30], "t", "P", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, pages array<string>, title string, publisher string, year string, licence string, source_url string")
    tables.register(spark)
    df.createOrReplaceTempView("docs")
    df.select("*", F.posexplode_outer("pages").alias("page", "text")).drop("pages").filter("page IS NOT NULL").withColumn("area", F.lit("north")).repartition(5).createOrReplaceTempView("doc_pages")
    return df


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_passages_equal_the_operator(spark, docs):
    want = chunk.chunks(docs)
    got = spark.sql("SELECT * FROM chunk_pages(TABLE(docs))")
    assert got.columns == want.columns and rows(got) == rows(want) and len(rows(want)) > 20
    by_page = spark.sql("SELECT * FROM chunk_pages(TABLE(doc_pages))")
    assert by_page.columns == [*want.columns, "area"] and rows(by_page.drop("area")) == rows(want)
    small = spark.sql("SELECT * FROM chunk_pages(TABLE(docs), target_tokens => 100, overlap_tokens => 10, min_tokens => 5)")
    from corpusloom.config import Chunking

    assert rows(small) == rows(chunk.chunks(docs, Chunking(100, 10, 5, 3.5))) and small.count() > got.count()


def test_sentences_equal_the_column_function(spark, docs):
    got = spark.sql("SELECT doc_id, page, position, sentence FROM sentences_of(TABLE(doc_pages) PARTITION BY doc_id ORDER BY page)")
    want = {}
    for r in spark.table("doc_pages").select("doc_id", "page", text.sentences(F.coalesce("text", F.lit(""))).alias("s")).orderBy("doc_id", "page").collect():
        want.setdefault(r["doc_id"], []).extend((r["page"], s) for s in r["s"])
    assert rows(got) == sorted([(d, p, i, s) for d, all_ in want.items() for i, (p, s) in enumerate(all_)], key=str)


def test_what_is_refused(spark, docs):
    for call, said in (("chunk_pages(TABLE(SELECT 1 AS x))", "doc_id"), ("sentences_of(TABLE(SELECT 1 AS x))", "text"), ("chunk_pages(TABLE(docs), target_tokens => -1)", "limits")):
        with pytest.raises(Exception, match=said):
            spark.sql(f"SELECT * FROM {call}").collect()
    assert spark.sql("SELECT * FROM chunk_pages(TABLE(SELECT * FROM docs WHERE doc_id < 0))").count() == 0
