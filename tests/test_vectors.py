"""Exact vector search and the inverted file against brute force, with ids of any type."""

import numpy as np
import pytest

from corpusloom.operators import build, cells, dense, search


def vectors(n, dim=8, seed=0, groups=6):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, dim))
    x = centre[rng.integers(groups, size=n)] + 0.15 * rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[n // 2 : n // 2 + n // 4] = x[0]  # a large group of equal vectors
    return x


def frame(spark, x, name, id):
    return spark.createDataFrame([(f"d-{i:05d}#0" if id == "string" else i, [float(v) for v in row]) for i, row in enumerate(x)], f"{name} {id}, embedding array<double>")


def brute(x, q, k, own=None):
    s = np.round(x @ q, 9)
    order = [i for i in np.lexsort((np.arange(len(x)), -s)) if i != own]
    return order[:k]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_exact_and_inverted_file_equal_brute_force(spark, kind):
    x = vectors(1500)
    passages, asked = frame(spark, x, "id", kind).repartition(5), frame(spark, x, "query_id", kind).filter("hash(query_id) % 40 = 0")
    at = lambda v: int(v[2:7]) if kind == "string" else v
    index, reads = cells.build(passages, 24), []
    for found in (dense.search(passages, asked, 7, not_itself=True), cells.search(index, asked, 7, probes=1, not_itself=True, reads=reads)):
        got: dict = {}
        for r in found.collect():
            got.setdefault(at(r["query_id"]), {})[r["rank"]] = at(r["id"])
        assert len(got) == asked.count() and all([g[i + 1] for i in range(7)] == brute(x, x[q], 7, q) for q, g in got.items())
    assert index.rows.sum() == 1500 and sum(reads) < 0.5 * 1500 * len(got)  # a part of the passages


def test_probes_by_measured_recall(spark):
    x = vectors(2000, 16, 3, 30)
    passages, asked = frame(spark, x, "id", "long"), frame(spark, vectors(60, 16, 3, 30), "query_id", "long")
    index = cells.build(passages, 40)
    probes, recall = cells.probes_for(index, asked, 0.95, 10)
    assert recall >= 0.95 and probes < 40
    reads: list = []
    got = {(r["query_id"], r["id"]) for r in cells.search(index, asked, 10, probes, exact=False, reads=reads).collect()}
    want = {(r["query_id"], r["id"]) for r in dense.search(passages, asked, 10).collect()}
    assert len(got & want) >= 0.95 * len(want)


def test_odd_vectors(spark):
    rows = [(1, [0.0, 0.0]), (2, [3.0, 4.0]), (2, [3.0, 4.0]), (None, [1.0, 0.0]), (3, None), (4, [-3.0, -4.0]), (5, [30.0, 40.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    asked = spark.createDataFrame([("a", [3.0, 4.0]), ("a", [3.0, 4.0]), ("b", [-1.0, 0.0])], "query_id string, embedding array<double>")
    want = {("a", 1, 5, 250.0), ("a", 2, 2, 25.0), ("a", 3, 2, 25.0), ("b", 1, 4, 3.0), ("b", 2, 1, 0.0), ("b", 3, 2, -3.0)}
    for found in (dense.search(df, asked, 3), cells.search(cells.build(df), asked, 3, probes=1)):
        assert {(r["query_id"], r["rank"], r["id"], r["score"]) for r in found.collect()} == want
    none = df.limit(0)
    assert cells.search(cells.build(none), asked, 3).count() == 0 and dense.search(none, asked, 3).count() == 0
    assert cells.search(cells.build(df), asked.limit(0), 3).count() == 0


def test_a_built_index_is_searched_in_hybrid_mode(spark, tmp_path):
    sentence = "Plant yam setts early in the ridges before the rains begin. Weed the maize field twice. Dry the cassava chips well on clean racks. "
    docs = spark.createDataFrame([(f"doc-{i}", f"Guide {i}", "P", "2001", "CC BY 4.0" if i % 4 else "All rights reserved", "http://x", [sentence * (2 + i % 3) + f" Farm number{i} keeps goats and bees near river{i}."]) for i in range(20)], "doc_id string, title string, publisher string, year string, licence string, source_url string, pages array<string>")
    passages, index = build.index(spark, docs, str(tmp_path / "index"))
    asked = spark.createDataFrame([(i, f"Which farm number{i} keeps goats near river{i}?") for i in range(20)], "query_id long, text string")
    hits = search.hybrid(passages, asked.join(dense.hashed_embedding(asked, "query_id").withColumnRenamed("id", "query_id"), "query_id"), min_score=0.0, index=index).collect()
    first = {r["query_id"]: r["id"] for r in hits if r["hit"] == 1}
    assert all(first[i].startswith(f"doc-{i}#") for i in range(20) if i % 4) and not [r for r in hits if int(r["id"].split("-")[1].split("#")[0]) % 4 == 0]
