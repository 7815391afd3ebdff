"""Queries of the lexical, dense and hybrid search, fusion and compression."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text
from ..operators import answer, cells, compress, dense, impacts, lexical, search
from ..operators.tables import shared_dir, stored
from ..sources import files
from . import fixtures as fx
from . import rule_sql as R
from . import sql as S
from .base import registry, table

ENTRIES, query = registry()


@query(f"WITH {S.stemmed('documents', 'doc_id', 'text')} SELECT id AS doc_id, term, count(*) AS tf FROM stems GROUP BY ALL")
def bm25_postings(spark, d):
    return lexical.postings(table(spark, d, "documents")).withColumnRenamed("id", "doc_id")


@query(f"WITH {S.stemmed('documents', 'doc_id', 'text')} SELECT term, count(DISTINCT id) AS df FROM stems GROUP BY term")
def bm25_doc_freq(spark, d):
    return lexical.term_stats(table(spark, d, "documents"))


@query(f"WITH {S.stemmed('documents', 'doc_id', 'text')} SELECT count(*) AS n_docs, sum(len(l))::BIGINT AS n_terms, round(sum(len(l)) / count(*)::DOUBLE, 6) AS avg_len FROM stems_l")
def bm25_corpus_stats(spark, d):
    return lexical.corpus_stats(table(spark, d, "documents")).select("n_docs", "n_terms", F.round("avg_len", 6).alias("avg_len"))


def _asked(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


_indexes: dict[tuple[str, str], lexical.Index] = {}


def index_of(spark, d) -> lexical.Index:
    """The BM25 index of a folder's documents, built once in an application and used by all queries that search it."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _indexes:
        _indexes[key] = lexical.build(table(spark, d, "documents"))
    return _indexes[key]


@query(f"WITH {S.bm25('documents', 'doc_id', 'benchmark', 'item_id')} SELECT query_id, id AS doc_id, rank, round(score, 6) AS score FROM bm25")
def bm25_search(spark, d):
    found = lexical.search(index_of(spark, d), _asked(spark, d))
    return found.select("query_id", F.col("id").alias("doc_id"), F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"WITH {S.bm25('documents', 'doc_id', 'benchmark', 'item_id')} SELECT query_id, id AS doc_id, rank, round(score, 6) AS score FROM bm25")
def bm25_blocks(spark, d):
    """The same by blocks of impacts: ranges of documents whose bound is below a query's k-th score are not scored."""
    found = impacts.search(impacts.build(index_of(spark, d)), _asked(spark, d))
    return found.select("query_id", F.col("id").alias("doc_id"), F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"WITH {S.bm25('documents', 'doc_id', 'benchmark', 'item_id')} SELECT query_id, id AS doc_id, rank, round(score, 6) AS score FROM bm25")
def stream_search(spark, d):
    """The same search of a stream of items, a file at a time, against the stored index."""
    from ..streaming.events import answered_to_end

    rows = stored(_asked(spark, d).repartition(3))
    source = rows.inputFiles()[0].rsplit("/", 1)[0]
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    index = index_of(spark, d)
    found = answered_to_end(stream, lambda batch: lexical.search(index, batch), f"{source}-found")
    return found.select("query_id", F.col("id").alias("doc_id"), F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))), 5) AS norm, round(embedding[1]::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))), 1e-12), 6) AS first FROM embeddings")
def l2_normalise(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "embedding", text.l2_normalised(F.col("embedding")).alias("unit"))
    return v.select("vec_id", F.round(F.sqrt(text.dot(F.col("embedding"), F.col("embedding"))), 5).alias("norm"), F.round(F.get("unit", F.lit(0)), 6).alias("first"))


_near = """v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), near_all AS (SELECT q.id AS query_id, v.id, list_dot_product(q.e, v.e) AS score,
    row_number() OVER (PARTITION BY q.id ORDER BY round(list_dot_product(q.e, v.e), 9) DESC, v.id) AS rank FROM v q JOIN v ON q.id <> v.id WHERE q.id % 100 = 0), near AS (SELECT * FROM near_all WHERE rank <= 20)"""


def _nearest(spark, d):
    """The stated query set: every vector whose id is divisible by 100, against all vectors but itself."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return dense.search(vectors, vectors.filter("id % 100 = 0").withColumnRenamed("id", "query_id"), not_itself=True)


@query(f"WITH {_near} SELECT query_id, id, rank, round(score, 6) AS score FROM near")
def dense_search(spark, d):
    return _nearest(spark, d).select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"WITH {_near} SELECT query_id, id, rank, round(score, 6) AS score FROM near")
def ivf_search(spark, d):
    """The same answers from the inverted file: nearest cells first, then those whose bound reaches the k-th score."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    found = cells.search(cells.build(vectors), vectors.filter("id % 100 = 0").withColumnRenamed("id", "query_id"), not_itself=True)
    return found.select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(
    f"""WITH {_near}, lx AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC) AS rank FROM near WHERE rank % 2 = 0),
    u AS (SELECT query_id, id, rank AS d, NULL AS l FROM near UNION ALL SELECT query_id, id + 1, NULL, rank FROM lx), e AS (SELECT query_id, id, min(d) AS d, min(l) AS l FROM u GROUP BY ALL),
    s AS (SELECT *, coalesce(1.0::DOUBLE / (60 + d), 0) + coalesce(1.0::DOUBLE / (60 + l), 0) AS rrf, least(CASE WHEN l <= 2 THEN 2 * (l - 1) END, CASE WHEN d <= 2 THEN 2 * (d - 1) + 1 END) AS place FROM e),
    f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(place, 4), round(rrf, 12) DESC, coalesce(d, 20 + l)) - 1 AS fused_rank FROM s) SELECT query_id, id, fused_rank, round(rrf, 9) AS rrf FROM f WHERE fused_rank < 18"""
)
def rrf_fuse(spark, d):
    """The dense ranking with a second one made from it, so that both agree in part."""
    near = stored(_nearest(spark, d))
    w = Window.partitionBy("query_id").orderBy(F.desc("rank"))
    other = near.filter("rank % 2 = 0").select("query_id", (F.col("id") + 1).alias("id"), F.row_number().over(w).alias("rank"))
    return search.fuse(near, other).select("query_id", "id", F.col("fused_rank").cast("long").alias("fused_rank"), F.round("rrf", 9).alias("rrf"))


@query(f"WITH {_near} SELECT query_id, id FROM near WHERE score >= CASE WHEN rank <= 2 THEN 0.30 - 0.08 ELSE 0.30 END")
def floor_filter(spark, d):
    return _nearest(spark, d).withColumn("lexical_rank", F.col("rank")).filter(search.floor(0.30)).select("query_id", "id")


@query("WITH h AS (SELECT item_id AS query_id, unnest(range(1, 7)) AS hit FROM benchmark), w AS (SELECT *, (1.0::DOUBLE / (hit + 1)) / sum(1.0::DOUBLE / (hit + 1)) OVER (PARTITION BY query_id) AS weight FROM h) SELECT query_id, hit, round(weight, 9) AS weight, greatest(60, trunc(weight * 700)::INT) AS budget FROM w")
def budget_weights(spark, d):
    hits = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(6).cast("long"))).alias("hit"))
    return compress.budgets(hits).select("query_id", "hit", F.round("weight", 9).alias("weight"), "budget")


@query(
    r"""WITH s AS (SELECT doc_id, i - 1 AS pos, w[i] AS sentence FROM (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '') AS w FROM documents), LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i)),
    f AS (SELECT *, """ + S.rx("sentence", X.SAFETY_CRITICAL) + r""" AS forced, length(sentence) / 3.5::DOUBLE AS cost, length(sentence) % 7 AS score, count(*) OVER (PARTITION BY doc_id) AS total FROM s),
    o AS (SELECT *, sum(cost) OVER w AS used, row_number() OVER w AS place FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY forced DESC, score DESC, pos)),
    e AS (SELECT *, max((NOT forced AND used > 200 AND place - 1 >= 2)::INT) OVER (PARTITION BY doc_id ORDER BY place) AS ended FROM o)
    SELECT doc_id, count(*) AS kept, any_value(total) AS total, md5(string_agg(sentence, ' ' ORDER BY pos)) AS digest FROM e WHERE total <= 2 OR ended = 0 GROUP BY doc_id"""
)
def compress_greedy(spark, d):
    """Lines as sentences with a given score, so that both engines split alike."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x != "")).alias("pos", "sentence"))
    scored = lines.withColumn("score", F.length("sentence") % 7).withColumn("budget", F.lit(200))
    return compress.select(scored, ["doc_id"]).select("doc_id", "kept", "total", F.md5("text").alias("digest"))


_ranked = [*fx.SOURCES, *fx.PASSAGES, "Cocoa pods turn black; prune the trees.", "Mealybug on cassava: white waxy masses.", "Storage, drying and bagging of stored grain in a warehouse silo."]


@query(R.rerank(fx.QUESTIONS, _ranked))
def rerank_partitions(spark, d):
    """Every benchmark item behind a literal question, against literal sources that go on with the item's text, where the flags fire."""
    text_ = F.coalesce("text", F.lit(""))
    asked = F.get(F.array(*map(F.lit, fx.QUESTIONS)), (F.col("item_id") % len(fx.QUESTIONS)).cast("int"))
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat_ws(" ", asked, text_).alias("query"), text_.alias("own"))
    hits = q.select("query_id", "query", "own", F.posexplode(F.array(*map(F.lit, _ranked))).alias("id", "source"))
    hits = hits.select("query_id", "query", "id", F.concat_ws(" ", "source", "own").alias("text"), F.lit("").alias("title"), F.col("id").alias("fused_rank"))
    return search.rerank(hits).select("query_id", "id", "place", "offcrop", "not_named", "research", "postharvest")


def _passage_vectors(spark, d):
    """Passages with their vectors, stored together, and the items with theirs."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))
    return stored(dense.with_hashed_embedding(docs), "passages"), stored(dense.with_hashed_embedding(_asked(spark, d)), "asked")


@query(R.hybrid(S.bm25("documents", "doc_id", "benchmark", "item_id"), 0.10))
def hybrid_search(spark, d):
    """Every benchmark item against every document; floor for the hashed embedding."""
    passages, asked = _passage_vectors(spark, d)
    return search.hybrid(passages, asked, min_score=0.10, index=index_of(spark, d)).select("query_id", "id", *(F.col(c).cast("long").alias(c) for c in ("hit", "place", "fused_rank")), F.round("score", 6).alias("score"))


@query(R.hybrid(S.bm25("documents", "doc_id", "benchmark", "item_id"), 0.10).replace("WITH ", "WITH documents AS (SELECT 'doc-' || doc_id || '#0' AS doc_id, source, text FROM main.documents WHERE doc_id % 5 <> 0), ", 1))
def built_hybrid(spark, d):
    """An index with names as ids, saved and loaded, licences gated, and searched in hybrid mode: every benchmark item."""
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit("#0")).alias("id"), F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("source", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("doc_id") % 5 == 0, "CC BY-ND 4.0").otherwise("CC BY 4.0").alias("licence"))
    place = f"{shared_dir(spark)}/built-{uuid.uuid4().hex}"
    files.save_index(dense.with_hashed_embedding(docs), place)
    passages, index = files.load_index(spark, place)
    asked = stored(dense.with_hashed_embedding(_asked(spark, d)), "asked")
    return search.hybrid(passages, asked, min_score=0.10, index=index).select("query_id", "id", *(F.col(c).cast("long").alias(c) for c in ("hit", "place", "fused_rank")), F.round("score", 6).alias("score"))


@query(R.hybrid(S.bm25("documents", "doc_id", "benchmark", "item_id"), 0.10))
def stream_hybrid(spark, d):
    """The same for a stream of items in which half come again: each is answered once, by the whole hybrid flow."""
    from ..streaming.events import answered_to_end

    passages, asked = _passage_vectors(spark, d)
    index = index_of(spark, d)
    place = f"{shared_dir(spark)}/stream-hybrid-{uuid.uuid4().hex}"
    timed = asked.withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("query_id") % 3600))
    for rows in (timed, timed.filter("query_id % 2 = 0")):
        rows.repartition(2).write.mode("append").parquet(f"{place}/in")
    stream = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 2).parquet(f"{place}/in")
    once = stream.withWatermark("ts", "2 hours").dropDuplicatesWithinWatermark(["query_id"]).select("query_id", "text", "embedding")
    names = ["query_id", "id", "hit", "place", "fused_rank", "score"]
    found = answered_to_end(once, lambda batch: search.hybrid(passages, stored(batch), min_score=0.10, index=index).select(*names), place)
    return found.select("query_id", "id", *(F.col(c).cast("long").alias(c) for c in ("hit", "place", "fused_rank")), F.round("score", 6).alias("score"))


@query("SELECT label, round(sum(x * x), 6) AS norm, round(max(x) FILTER (i = 1), 6) AS first FROM (SELECT label, i, m / greatest(sqrt(sum(m * m) OVER (PARTITION BY label)), 1e-12) AS x FROM (SELECT label, i, sum(embedding[i]::DOUBLE * (vec_id % 2)) / greatest(sum(vec_id % 2), 1e-9) AS m FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL)) GROUP BY label")
def mean_pool(spark, d):
    """The vectors of a label as the states of its tokens, every other one masked."""
    states = table(spark, d, "embeddings").select("label", "embedding", (F.col("vec_id") % 2).alias("mask"))
    pooled = dense.mean_pooled(states, "label", "embedding", "mask")
    return pooled.select("label", F.round(text.dot(F.col("embedding"), F.col("embedding")), 6).alias("norm"), F.round(F.get("embedding", F.lit(0)), 6).alias("first"))


@query()
def advise(spark, d):
    """The whole question flow: all questions of users and the literal ones against all documents, hits compressed for the prompt."""
    own = table(spark, d, "conversations").filter("role = 'user'").select(F.concat_ws("-", F.lit("c"), "conv_id", "turn").alias("name"), F.coalesce("text", F.lit("")).alias("question"))
    asked = own.unionByName(fx.frame(spark, [(f"f-{i}", q) for i, q in enumerate(fx.QUESTIONS)], "name string, question string")).withColumn("query_id", F.xxhash64("name", "question"))
    asked = stored(answer.considered(asked).drop("name"))
    open_ = asked.filter("reason is null").select("query_id", F.col("search_text").alias("text"))
    passages, _ = _passage_vectors(spark, d)
    vectors = stored(dense.hashed_embedding(open_, "query_id")).withColumnRenamed("id", "query_id")
    hits = search.hybrid(passages, open_.join(vectors, "query_id"), min_score=0.10, index=index_of(spark, d))
    hits = compress.compressed(stored(hits), vectors)
    about = {"year": F.lit("unknown"), "publisher": F.lit("given"), "page_start": F.lit(1), "page_end": F.lit(1)}
    return answer.advise(asked, hits.withColumns(about), fx.NOW).select("query_id", "language", "refused", "why", "answer", "citations", "safe")
