"""Every registered query of the library runs; those with SQL give the same rows."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from corpusloom.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables here")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for p in Path(DATA).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sql, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = Counter(tuple(map(str, r)) for r in df.select(*columns).collect())
    if name in registry.ORACLES:
        listed = ", ".join(f'"{c}"' for c in columns)
        assert rows == Counter(tuple(map(str, r)) for r in sql.sql(f"SELECT {listed} FROM ({registry.ORACLES[name]})").fetchall())
    else:
        assert rows


def test_lexicon_counts_are_of_all_documents_and_groups(spark, tmp_path):
    import re

    from corpusloom.plans.queries_text import GENERIC

    odd = [(-1, "Der Änder der España Das das: les LES lesen los derart von_der und Loss", None), (-2, None, "de"), (-3, "THE end of the World; Africas Canada", "fr"), (-4, "", "en")]
    given = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    given.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string")).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in registry.QUERIES["lexicon_group_counts"](spark, str(tmp_path)).collect()}
    docs = {r["doc_id"]: (r["text"] or "").lower() for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}
    assert got.keys() == docs.keys()
    for i, t in docs.items():
        words = Counter(re.findall(r"\w+", t))
        for g, terms in GENERIC.items():
            assert got[i][f"n_{g}"] == sum(t.count(x) if " " in x else words[x] + words[x + "s"] for x in terms), (i, g)
    assert got[-1]["n_article"] == 8


def test_coverage_wants_whole_items(spark, tmp_path):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda sigma tau upsilon"
    spark.createDataFrame([(1, "x " + item[:65]), (2, "other words"), (3, "say Omicron Rho pi. and"), (4, "more words")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(8, item), (10, "omicron rho PI.")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [(r["total"], r["hits"]) for r in registry.QUERIES["coverage_eval"](spark, str(tmp_path)).collect()] == [(2, 1)]
    assert {r["verdict"]: r["n"] for r in registry.QUERIES["answer_verdicts"](spark, str(tmp_path)).collect()} == {"OK": 1, "UNGROUNDED": 1}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_the_rest_stands_without_the_training_data_operators(tmp_path):
    import shutil
    import subprocess
    import sys

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "corpusloom", tmp_path / "corpusloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True)
    assert said.stdout.split() == [str(len(registry.QUERIES)), str(len(registry.ORACLES))], said.stderr
