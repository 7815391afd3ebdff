"""Versions of a manifest: crashes, two writers, old versions; streams with repeats and late rows."""

import threading

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import ingest
from corpusloom.sources.snapshots import Conflict, Snapshots
from corpusloom.streaming import events


def frame(spark, rows):
    return spark.createDataFrame(rows, "name string, n_pages long, tags array<string>")


def held(df):
    return sorted((r["name"], r["n_pages"], r["tags"]) for r in df.collect())


def test_a_writer_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch):
    s = Snapshots(spark, f"file:{tmp_path}/m")
    assert s.latest() == 0 and s.read() is None
    assert s.commit(frame(spark, [("a", 1, ["x"])]), 0) == 1
    with monkeypatch.context() as m:
        m.setattr(Snapshots, "_claim", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            s.commit(frame(spark, [("b", 2, None)]), 1)
    assert s.latest() == 1 and held(s.read()) == [("a", 1, ["x"])]
    assert s.clean(older_s=3600) == 0 and s.clean(older_s=-5) == 1 and held(s.read()) == [("a", 1, ["x"])]
    assert s.commit(s.read().limit(0), 1) == 2 and s.read().count() == 0 and held(s.read(1)) == [("a", 1, ["x"])]


def test_the_writer_that_loses_tries_again(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "m"))
    s.commit(frame(spark, [("a", 1, None)]), 0)
    other, calls = Snapshots(spark, str(tmp_path / "m")), []

    def change(df):
        calls.append(df.count())
        if len(calls) == 1:  # the other one commits first
            other.update(lambda d: ingest.upsert(d, frame(spark, [("b", 2, None)])))
        return ingest.upsert(df, frame(spark, [("a", 9, ["new"])]))

    assert s.update(change) == 3 and calls == [1, 2]
    assert held(s.read()) == [("a", 9, ["new"]), ("b", 2, None)] and held(s.read(2)) == [("a", 1, None), ("b", 2, None)]
    with pytest.raises(Conflict):
        s.commit(frame(spark, []), 1)
    with pytest.raises(Conflict):
        s.update(lambda d: (other.update(lambda e: e), d)[1], attempts=1)
    assert len([p for p in (tmp_path / "m").iterdir() if p.name.startswith("rows-")]) == s.latest()


def test_many_writers_lose_nothing(spark, tmp_path):
    Snapshots(spark, str(tmp_path / "m")).commit(frame(spark, []), 0)
    add = lambda i: Snapshots(spark, str(tmp_path / "m")).update(lambda d: ingest.upsert(d, frame(spark, [(f"w{i}", i, None)])), attempts=50)
    threads = [threading.Thread(target=add, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    s = Snapshots(spark, str(tmp_path / "m"))
    assert s.latest() == 5 and [r[0] for r in held(s.read())] == [f"w{i}" for i in range(4)]


def test_repeats_and_late_rows_of_a_stream(spark, tmp_path):
    given = spark.range(40).selectExpr("id AS event_id", "timestamp_seconds(1704067200 + id * 60) AS ts", "id % 3 AS user_id", "'t' AS event_type", "id * 1.0D AS value", "'' AS props")
    given.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    given.filter("event_id % 2 = 0").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    late = given.limit(3).withColumn("event_id", F.col("event_id") + 1000).withColumn("ts", F.col("ts") - F.expr("INTERVAL 10 DAYS"))
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # rows are late by the watermark of the batch before
    stream = spark.readStream.schema(events.EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = events.run_to_end(events.once(stream, "2 days"), str(tmp_path / "out"))
    assert sorted(r["event_id"] for r in out.collect()) == list(range(40))
