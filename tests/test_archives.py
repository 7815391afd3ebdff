"""The ZIP source against the standard library's, its pushed conditions, splits and staging."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import archives, files


def folder(tmp_path, n=40):
    want = {}
    for a in range(3):
        with zipfile.ZipFile(tmp_path / f"a{a}.zip", "w", zipfile.ZIP_DEFLATED if a else zipfile.ZIP_STORED) as z:
            z.writestr("site/", "")
            for i in range(n):
                name = f"site/{['en', 'de', 'fr'][i % 3]}/é{i}.{['html', 'HTML', 'txt'][i % 7 % 3]}"
                want[f"a{a}", name] = f"<p>{a} {i}</p>".encode() * (i * 17 % 90)
                z.writestr(name, want[f"a{a}", name])
    return want


def rows(df):
    return {(r["archive"].rsplit("/", 1)[1][:-4], r["path"]): bytes(r["content"]) for r in df.collect()}


def test_all_entries_in_any_splits(spark, tmp_path):
    want = folder(tmp_path)
    archives.register(spark)
    for split in (1, 500, 1 << 30):
        df = spark.read.format("zip_entries").option("bytesPerSplit", split).load(f"file:{tmp_path}")
        assert rows(df) == want and df.count() == 120
        assert df.rdd.getNumPartitions() == (120 if split == 1 else 3 if split > 500 else df.rdd.getNumPartitions())
    one = spark.read.format("zip_entries").load(str(tmp_path / "a1.zip")).select("inner", "size").collect()
    assert {(r["inner"], r["size"]) for r in one} == {(n[5:], len(c)) for (a, n), c in want.items() if a == "a1"}


def broken_but(path, keep):
    """Overwrites the data of all entries that ``keep`` is not true of."""
    with zipfile.ZipFile(path) as z:
        spans = [(i.header_offset, i.header_offset + 30 + len(i.filename.encode()) + i.compress_size) for i in z.infolist() if not keep(i.filename)]
    data = bytearray(path.read_bytes())
    for a, b in spans:
        data[a:b] = b"\xff" * (b - a)
    path.write_bytes(bytes(data))


def test_entries_that_are_not_wanted_are_never_opened(spark, tmp_path):
    want = folder(tmp_path)
    keep = lambda n: n.startswith(("site/en/", "site/de/")) and n.endswith(".html")
    for a in range(3):
        broken_but(tmp_path / f"a{a}.zip", keep)
    expect = {k: v for k, v in want.items() if keep(k[1])}
    df = archives.zip_entries(spark, str(tmp_path), ["en/", "de/"]).filter(F.col("path").endswith(".html"))
    assert rows(df) == expect and len(expect) > 9
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan zip_entries" in plan and "Filter " not in plan  # nothing is left for Spark to test
    assert rows(archives.zip_entries(spark, str(tmp_path)).filter("inner LIKE 'en/%' AND path LIKE '%.html'")) == {k: v for k, v in expect.items() if "/en/" in k[1]}
    lower = archives.zip_entries(spark, str(tmp_path), ["en/é0.", "en/é21."], ".HTML")
    assert {p for _, p in rows(lower)} == {"site/en/é0.html", "site/en/é21.html"}
    name = next(iter(expect))[1]
    assert set(rows(archives.zip_entries(spark, str(tmp_path)).filter(F.col("path") == name))) == {("a0", name), ("a1", name), ("a2", name)}
    with pytest.raises(Exception, match="site/"):
        archives.zip_entries(spark, str(tmp_path)).collect()


def test_written_archives_come_back(spark, tmp_path):
    out = str(tmp_path / "out")
    given = spark.range(200).selectExpr("concat('x/', id % 7, '/', id, '.html') AS path", "CASE WHEN id % 50 = 0 THEN NULL ELSE encode(repeat(concat('<é', id), int(id)), 'UTF-8') END AS content").repartition(4)
    archives.pack(given, out)
    back = archives.zip_entries(spark, out)
    assert {(r["path"], bytes(r["content"])) for r in back.collect()} == {(r["path"], bytes(r["content"] or b"")) for r in given.collect()}
    names = [p.name for p in (tmp_path / "out").iterdir()]
    assert len(names) == 4 and all(n.endswith(".zip") for n in names)
    for p in (tmp_path / "out").iterdir():
        assert zipfile.ZipFile(p).testzip() is None
    archives.pack(given.limit(3), out, "overwrite")
    assert archives.zip_entries(spark, out).count() == 3
    bad = given.limit(5).withColumn("content", F.expr("CAST(assert_true(path IS NULL) AS BINARY)"))
    with pytest.raises(Exception, match="is not true"):
        archives.pack(bad, out)
    assert archives.zip_entries(spark, out).count() == 3 and not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]


def test_odd_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "none.zip", "w"):
        pass
    (tmp_path / "prefixed.zip").write_bytes(b"#!stub" + zip_bytes({"a.html": b"one"}))
    big = zip_bytes({"wide.html": b"two" * 9}, force=True)
    (tmp_path / "wide.zip").write_bytes(big)
    assert {p: bytes(c) for p, c in archives.zip_entries(spark, str(tmp_path)).select("path", "content").collect()} == {"a.html": b"one", "wide.html": b"two" * 9}
    broken = bytearray(zip_bytes({"a.html": b"one" * 50}, method=zipfile.ZIP_STORED))
    broken[60] ^= 1
    (tmp_path / "prefixed.zip").write_bytes(bytes(broken))
    with pytest.raises(Exception, match="broken"):
        archives.zip_entries(spark, str(tmp_path)).collect()
    (tmp_path / "prefixed.zip").write_bytes(b"no archive")
    with pytest.raises(Exception, match="not a ZIP"):
        archives.zip_entries(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="nowhere"):
        archives.zip_entries(spark, str(tmp_path / "nowhere")).collect()


def zip_bytes(entries, force=False, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in entries.items():
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=force) as f:
                f.write(data)
    return out.getvalue()


def test_wanted_pages_of_archives_equal_those_of_folders(spark, tmp_path):
    pages = spark.createDataFrame([(f"site/{d}/{i}.html", f"<p>{d}{i}</p>") for d in ("en", "de", "fr") for i in range(9)], "path string, html string")
    archives.pack(pages.select("path", F.encode("html", "UTF-8").alias("content")), str(tmp_path / "z"))
    got = files.zip_pages(spark, str(tmp_path / "z"), ["en/", "fr/"])
    assert {(r["path"], r["html"]) for r in got.collect()} == {(r["path"], r["html"]) for r in files.wanted(pages, ["en/", "fr/"]).collect()}
    assert json.loads(json.dumps(got.columns)) == ["path", "html"]
