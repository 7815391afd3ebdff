"""Odd tables: nulls, blanks, long texts, equal ids, repeated rows, clashing columns, nothing at all."""

import pytest

from corpusloom.llm import decontaminate, fingerprint, katz, language, mixing, secret_scan, similar_join, token_counts, toxicity, url_filter
from tests.llm.conftest import prose

N = 14


def rows(df):
    return df.collect()


def test_secrets(odd, none):
    for scan in (secret_scan.scan, secret_scan.scan_all):
        got = rows(scan(odd))
        assert len(got) == N and all(isinstance(r["secrets"], list) for r in got) and got[0]["score"] == 9.0
        assert rows(scan(none)) == []


def test_mixing(odd, none):
    got = rows(mixing.mix(odd))
    assert len(got) == N and sum(r["size"] == 0 and r["taken"] == 0 for r in got) == 4
    assert rows(mixing.mix(none)) == []


def test_join(odd, none):
    got = rows(similar_join.classes(odd))
    assert len(got) == N
    assert sorted(r["n_links"] for r in got if r["doc_id"] in (1, 2)) == [3, 3, 3]  # two equal rows, a copy and a near copy
    assert {r["class_id"] for r in got if r["doc_id"] in (1, 2)} == {1}
    assert rows(similar_join.classes(none)) == []
    kept = similar_join.one_of_each(odd)
    assert kept.columns == odd.columns and sum(r["doc_id"] == 1 for r in rows(kept)) == 1
    assert rows(similar_join.one_of_each(none)) == []


def test_unlike_texts_of_one_id_all_stay(spark):
    texts = [prose(i, 60) for i in range(300, 306)]
    rows_ = [(1, texts[0]), (1, texts[1]), (1, texts[2] + " a"), (2, texts[2] + " a b"), (7, texts[3]), (7, texts[4]), (8, texts[4]), (None, texts[5]), (None, texts[5])]
    df = spark.createDataFrame(rows_, "doc_id long, text string")
    found = {(r["doc_id"], r["text_key"]): r["class_key"] for r in rows(similar_join.classes(df))}
    assert len(found) == 8 and len(set(found.values())) == 6
    kept = rows(similar_join.one_of_each(df))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == sorted([(1, texts[0]), (1, texts[1]), (1, texts[2] + " a"), (7, texts[3]), (7, texts[4]), (0, texts[5])])


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "x", 1.0, "y", "z", "w") for i, u in [(1, None), (1, ""), (None, "http://a.com/en/"), (2, "http://a.com/en/"), (2, "http://a.com/en/"), (3, "h" * 5000)]], "page_id long, url string, verdict string, score double, host string, n string, said string")
    got = rows(url_filter.judge(df, [("block", "com", "/en/")]))
    assert len(got) == 6 and sum(r["rule"] == "com/en/" for r in got) == 3 and {r["said"] for r in got} == {"w"} and {r["host"] for r in got} == {"", "a.com"} and all(r["verdict"] == "block" for r in got)
    assert rows(url_filter.judge(df.limit(0), [("block", "com", "/en/")])) == []
    assert {r["verdict"] for r in rows(url_filter.judge(df, []))} == {"allow"}


def test_decontamination(odd, none, spark):
    items = spark.createDataFrame([(1, odd.filter("doc_id = 2").first()["text"]), (2, None), (3, "word"), (3, "word"), (None, "word")], "item_id long, text string")
    got = [(r["doc_id"], r["item_id"]) for r in rows(decontaminate.contained(odd, items))]
    assert sorted(got, key=str) == [(1, 1), (1, 1), (2, 1), (3, 1), (6, 3), (6, 3), (6, None)]  # a row for each pair of rows, null ids too
    assert rows(decontaminate.contained(none, items)) == [] and rows(decontaminate.contained(odd, items.limit(0))) == []
    clean = decontaminate.clean(odd, items)
    assert clean.columns == odd.columns and clean.count() == N - 5
    assert decontaminate.clean(odd, items.filter("item_id is null")).count() == N - 1
    assert decontaminate.clean(none, items).count() == 0 and decontaminate.clean(odd, items.limit(0)).count() == N


def test_toxicity(odd, none, spark):
    labels = spark.createDataFrame([(1, 1, None), (2, 0, 1), (2, 1, 0), (None, 1, 1), (77, 1, 1), (3, None, None)], "doc_id long, toxic int, quality int")
    for lab in (labels, labels.limit(0)):
        chain = toxicity.train(odd, lab)
        got = rows(toxicity.score(odd, chain))
        assert len(got) == N and not any(r["toxic"] for r in got)
        assert toxicity.keep_clean(odd, chain).count() == N and toxicity.keep_clean(odd, chain).columns == odd.columns
    assert rows(toxicity.score(none, toxicity.train(none, labels))) == []


def test_language(odd, none):
    net = language.train(odd)
    got = rows(language.predict(odd, net))
    assert len(got) == N and sum(r["lang_pred"] == "und" and r["score"] == 0 for r in got) == 4
    assert all(0 <= r["score"] <= 1 for r in got)
    assert language.train(none) is None and {r["lang_pred"] for r in rows(language.predict(odd, None))} == {"und"}
    assert rows(language.predict(none, net)) == []


def test_tokens(odd, none):
    got = rows(token_counts.running(token_counts.length_histogram(odd)))
    assert sum(r["n_docs"] for r in got) == N and min(r["n_tokens"] for r in got) == 0
    assert rows(token_counts.running(token_counts.length_histogram(none))) == []


def test_katz(odd, none):
    from pyspark.sql import functions as F

    got = rows(katz.score(odd.withColumn("train", F.col("doc_id") > 2)))
    assert len(got) == N and sum(r["n_tokens"] == 1 for r in got) == 4 and all(r["score"] < 0 for r in got)
    untrained = rows(katz.score(odd.withColumn("train", F.lit(False))))
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in untrained)
    assert rows(katz.score(none.withColumn("train", F.lit(True)))) == []


def test_fingerprints(odd, none):
    got = rows(fingerprint.with_edits(odd))
    assert len(got) == N and len({r["fingerprint"] for r in got if r["doc_id"] in (1, 2)}) == 1
    assert sum(r["doc_id"] is None for r in got) == 2
    assert rows(fingerprint.with_edits(none)) == []
    one = rows(fingerprint.with_edits(odd.filter("doc_id = 6")))
    assert one[0]["near_next"] == 1.0


def test_pipeline_stages(odd, none, spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    for name, docs in (("odd", odd), ("none", none)):
        d = str(tmp_path / name)
        docs.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(2, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        given = spark.read.parquet(f"{d}/documents.parquet")
        for _, stage in pipeline.STAGES[:-1]:
            assert stage(spark, given, d).columns == docs.columns
        out = pipeline.run(spark, d).collect()
        assert len(out) == (9 if name == "odd" else 0)  # of four near copies and three empty texts one stays each


def test_pipeline_on_planted_rows(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    from tests.llm.conftest import prose

    d = str(tmp_path)
    item = prose(5000, 25)
    docs = [(i, prose(i, 120) + (" you idiot and stupid scum" if i < 80 else ""), "en", "s", 1) for i in range(200)]
    docs += [(200, docs[100][1], "en", "s", 1), (201, docs[101][1] + " one", "en", "s", 1), (202, prose(202, 50) + " " + item + " " + prose(203, 50), "en", "t", 1), (203, prose(204, 30) + " token = abcdefghijklmnop", "en", "t", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i < 80)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    rows_, given = {}, spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in pipeline.STAGES:
        given = stage(spark, given, d).persist()
        rows_[name] = {r["doc_id"]: r for r in given.collect()}
    names = [n for n, _ in pipeline.STAGES]
    assert set(rows_[names[0]]) == set(range(80, 204))
    assert set(rows_[names[1]]) == set(range(80, 200)) | {202, 203}
    assert set(rows_[names[2]]) == set(range(80, 200)) | {203}
    assert rows_[names[3]][203]["text"].endswith("[SECRET]") and set(rows_[names[3]]) == set(rows_[names[2]])
    assert set(rows_[names[4]]) == set(rows_[names[3]]) and sum(r["taken"] for r in rows_[names[4]].values()) > 0
    assert {r["doc_id"] for r in pipeline.run(spark, d).collect()} == set(rows_[names[4]])
