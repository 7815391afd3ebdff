"""Files in and out, the guard on token streams, event time."""

import json

from pyspark.sql import functions as F

from corpusloom.functions import fixed as X
from corpusloom.operators import ingest, lexical
from corpusloom.sources import files
from corpusloom.streaming import events, guard


def feed(text, size, sources=""):
    g = guard.Guard(sources=guard.squeezed(sources))
    out = "".join(g.feed(text[i : i + size]) for i in range(0, len(text), size))
    return out + g.close()


def test_guard_loses_nothing_and_lets_no_price_out():
    plain = "Plant early. Weed twice,\nthen rest. " * 20
    for size in (1, 3, 7, 1000):
        assert feed(plain, size) == plain
        out = feed("Sell at the market. It costs N12,500 a bag. Then rest well.", size)
        assert "12,500" not in out and X.MONEY_REDACTION in out and out.endswith("Then rest well.")
        assert feed("[1] [2] Plant now.", size).endswith("Plant now.") and not feed("[1] [2] Plant now.", size).startswith("[")
        assert feed(" .. [1] ", size) == X.NO_GUIDANCE_MESSAGE
    assert "20 ml" in feed("Use 20 ml per litre. Good.", 1, "use 20 ml per litre") and "20 ml" not in feed("Use 20 ml per litre. Good.", 1)


def test_pieces_make_no_difference():
    texts = [
        "[1] [2] Sell for KSh 81.21 per 50 kg bag. Use 20 ml of it per litre of water! Rest.\nZMK 8 or 30 dollars or N 500. Apply 250 g per hectare now",
        "Mix 1:20 at the pound, pounding on. It is 5 o'clock. Twenty naira? No: 20 naira.", "Weed. " * 30 + "Pay $" + "9" * 40 + " then. Done", "no end",
    ]
    for t in texts:
        whole = feed(t, len(t), "use 20 ml of it per litre of water")
        assert all(feed(t, n, "use 20 ml of it per litre of water") == whole for n in range(1, 12)) and "81" not in whole and "999" not in whole and "250 g" not in whole


def test_an_attempt_without_a_letter_is_asked_for_again():
    g = guard.Guard()
    assert g.take(0, "[1] ", False, 0, 2) == "" and g.take(1, "[2]", True, 0, 2) == "" and (g.state, g.attempt) == ("retry", 1)
    assert g.take(1, "early.", True, 1, 2) == "" and g.take(0, "[1] [2] Plant ", False, 1, 2) == "Plant early." and g.state == "done"
    g = guard.Guard()
    assert g.take(0, "", True, 0, 2) == "" and g.state == "retry" and g.take(0, "[1]", True, 1, 2) == X.NO_GUIDANCE_MESSAGE and g.state == "done"
    assert guard.Guard().take(0, "[1]", True) == X.NO_GUIDANCE_MESSAGE


def test_guard_as_a_stream_in_any_order(spark, tmp_path):
    text = "It costs N900 now. " * 3 + "Plant early in the season and weed twice."
    pieces = [("a", 0, i, text[i * 5 : i * 5 + 5], (i + 1) * 5 >= len(text), "") for i in range(-(-len(text) // 5))][::-1]
    pieces += [("b", 0, 0, "[1]", True, ""), ("b", 1, 1, "twice.", True, ""), ("b", 1, 0, "Weed ", False, ""), ("c", 0, 0, "Wait for it, there is more to come of this", False, "")]
    df = spark.createDataFrame(pieces, "answer_id string, attempt int, seq int, piece string, is_last boolean, sources string")
    for k in range(3):  # three files: pieces come late, and all of them twice
        df.filter((F.col("seq") + F.col("attempt")) % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = {}
    for r in events.run_to_end(guard.guarded(stream), str(tmp_path / "out")).orderBy("upto").collect():
        out.setdefault(r["answer_id"], []).append((r["text"], r["state"]))
    assert "".join(t for t, _ in out["a"]) == feed(text, 5) and out["a"][-1][1] == "done"
    assert out["b"] == [("", "retry"), ("Weed twice.", "done")] and out["c"] == [("Wait for it, there", "more")]
    left = spark.read.format("statestore").load(str(tmp_path / "out" / "state"))
    assert [r["key"]["answer_id"] for r in left.collect()] == ["c"]


def test_late_events_and_repeats(spark, tmp_path):
    rows = [(i, f"2024-01-01 {h:02d}:{m:02d}:00", 1, "view", 1.0, "{}") for i, (h, m) in enumerate([(0, 5), (0, 50), (1, 30), (0, 10), (2, 0), (5, 0)])]
    df = spark.createDataFrame([(*r[:1], *r[1:]) for r in rows], "event_id long, t string, user_id long, event_type string, value double, props string").select("event_id", F.col("t").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = events.run_to_end(events.tumbling(events.stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"))
    assert {str(r["start"])[11:13]: r["n"] for r in out.collect()} == {"00": 3, "01": 1, "02": 1}
    assert events.once(df.unionByName(df)).count() == len(rows)
    assert sorted(r["n"] for r in events.sessions(df, "45 minutes").collect()) == [1, 5]


def test_files(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"schema": 1, "documents": [{"filename": "a.pdf", "title": "A", "crops": ["yam"], "n_pages": 3}], "bulk_sources": []}))
    assert files.manifest(spark, str(tmp_path / "m.json")).first()["crops"] == ["yam"]
    (tmp_path / "q.json").write_text(json.dumps({"questions": [{"id": "x", "in_scope": True, "question": "?", "expect_any": ["a"]}]}))
    assert files.questions(spark, str(tmp_path / "q.json")).first()["expect_any"] == ["a"]
    (tmp_path / "s.csv").write_text("﻿id,english,draft,ok_or_your_version\nHOW-TO-USE,,,\n1,Hello,Abeg,OK\n2,Bye,Go,\n3,Now,Dis,Now now\n", encoding="utf-8")
    got = {r["id"]: r["corrected"] for r in files.reviewed(files.review_sheet(spark, str(tmp_path / "s.csv"))).collect()}
    assert got == {"1": "Abeg", "2": None, "3": "Now now"}
    pages = spark.createDataFrame([("d", "T", "text", "u", "p", "2001", "l", ["crop"], ["yam"], 7.5, 4)], files.PAGE)
    files.pages_sink(pages, str(tmp_path / "pages"))
    assert files.pages_jsonl(spark, str(tmp_path / "pages")).collect() == pages.collect()


def test_html_and_pdf_files(spark, tmp_path):
    for name in ("site/trees/a.html", "site/other/b.html", "site/trees/c.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("<p>x</p>")
    assert files.html_files(spark, str(tmp_path / "site")).count() == 2
    assert [r["path"].rsplit("/", 1)[-1] for r in files.html_files(spark, str(tmp_path / "site"), list(ingest.CONTENT_PREFIXES)).collect()] == ["a.html"]
    (tmp_path / "bad.pdf").write_bytes(b"no pdf")
    row = files.pdf_files(spark, str(tmp_path / "bad.pdf")).first()
    assert row["error"] and not row["usable"]
    read = spark.createDataFrame([(["a-\nb " + "w " * 1500, ""], 2, None), (["x"], 1, None)], "pages array<string>, n_pages int, error string")
    assert [(r["usable"], r["is_scanned"]) for r in files.probed(read).collect()] == [(True, False), (False, True)]


def test_index_keeps_rows_and_vectors_together(spark, tmp_path):
    rows = [(i, f"yam number {i} {'maize ' * i}", lic, [float(i == j) for j in range(4)]) for i, lic in enumerate(["CC BY", "CC BY-ND", "", "All rights reserved"])]
    df = spark.createDataFrame(rows, "id int, text string, licence string, embedding array<double>")
    files.save_index(df, str(tmp_path / "ix"))
    chunks, index = files.load_index(spark, str(tmp_path / "ix"))
    got = chunks.orderBy("id").collect()
    assert [r["id"] for r in got] == [0, 2] and all(r["embedding"][r["id"]] == 1 for r in got)
    assert index.n_docs == 2 and index.frequencies.filter("term = 'yam'").first()["df"] == 2
    asked = spark.createDataFrame([(7, "maize yam"), (8, "nothing")], "query_id long, text string")
    assert [(r["query_id"], r["id"]) for r in lexical.search(index, asked).orderBy("rank").collect()] == [(7, 2), (7, 0)]
    read = lexical.search(index, asked).inputFiles()
    assert read and all("/ix/bm25/postings/" in f for f in read)  # the passages are not read again


def test_review_ids_that_repeat_do_not_multiply_items(spark):
    items = spark.createDataFrame([("1",), ("2",), ("3",)], "id string")
    sheet = spark.createDataFrame([("1", "d", "a"), ("1", "d", "b"), ("CRITICAL 2", "d", "yes"), ("CRITICAL 2", "d", ""), ("2", "d", "plain")], "id string, draft string, answer string")
    assert sorted((r["id"], r["corrected"]) for r in files.imported(items, sheet).collect()) == [("1", "b"), ("2", "d"), ("3", None)]


def test_choices_and_results(spark, tmp_path):
    rows = [{"id": "q1", "question": {"stem": "Which?", "choices": [{"text": "one", "label": "A"}, {"text": "two", "label": "B"}]}, "answerKey": "B"}, {"id": "q2", "question": {"stem": "?", "choices": [{"text": "x", "label": "1"}]}, "answerKey": "E"}]
    (tmp_path / "arc.jsonl").write_text("\n".join(map(json.dumps, rows)))
    got = files.arc_questions(spark, str(tmp_path / "arc.jsonl")).orderBy("choice").collect()
    assert [(r["question_id"], r["text"], r["n_chars"], r["gold"]) for r in got] == [("q1", "one", 3, False), ("q1", "two", 3, True)]
    files.result_sink(spark.createDataFrame([(0.97, True)], "value double, pass boolean"), str(tmp_path / "r"), top_k=6, floor=0.7)
    row = spark.read.json(str(tmp_path / "r")).first()
    assert (row["settings"]["top_k"], row["result"]["value"], row["result"]["pass"]) == (6, 0.97, True)


def test_pages_left_out_are_told(spark, tmp_path):
    (tmp_path / "bad.pdf").write_bytes(b"no pdf")
    assert files.pdf_files(spark, str(tmp_path / "bad.pdf")).first()["truncated"] is False


def test_upsert_twice_is_once(spark):
    m = spark.createDataFrame([("a", 1), ("b", 2)], "name string, n int")
    e = spark.createDataFrame([("b", 5)], "name string, n int")
    assert sorted(map(tuple, ingest.upsert(ingest.upsert(m, e), e).collect())) == [("a", 1), ("b", 5)]
