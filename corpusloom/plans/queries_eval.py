"""Queries of the evaluation and of event time."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import evaluate, lexical
from ..operators.tables import shared_dir, stored
from ..streaming import events
from . import sql as S
from .base import registry, table
from .queries_search import index_of

ENTRIES, query = registry()
_bucket = f"(('0x' || left(sha256('{evaluate.SALT}:' || item_id), 8))::BIGINT / 4294967295.0::DOUBLE)"


@query(f"SELECT item_id, round({_bucket}, 9) AS bucket, CASE WHEN {_bucket} < 0.5 THEN 'dev' ELSE 'test' END AS side FROM benchmark")
def dev_test_split(spark, d):
    i = F.col("item_id").cast("string")
    return table(spark, d, "benchmark").select("item_id", F.round(evaluate.bucket(i), 9).alias("bucket"), evaluate.side(i).alias("side"))


@query(f"SELECT CASE WHEN {_bucket} < 0.5 THEN 'dev' ELSE 'test' END AS side, length(text) > 200 AS long_item, count(*) AS n FROM benchmark GROUP BY ALL")
def split_summary(spark, d):
    return evaluate.split_summary(table(spark, d, "benchmark").withColumn("long_item", F.length("text") > 200), "item_id", ("long_item",))


def _covered(spark, d):
    """item_id, covered: some of the six best documents holds the item's whole text."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    docs = table(spark, d, "documents")
    top = stored(lexical.search(index_of(spark, d), items, k=6))
    held = top.join(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("body")), "id").join(items, "query_id")
    hit = F.max(evaluate.any_of(F.coalesce("body", F.lit("")), F.array("text")).cast("int"))
    return items.select("query_id").join(held.groupBy("query_id").agg(hit.alias("hit")), "query_id", "left").select("query_id", (F.coalesce("hit", F.lit(0)) > 0).alias("covered"))


_hits = f"{S.bm25('documents', 'doc_id', 'benchmark', 'item_id', 6)}, cov AS (SELECT item_id, coalesce(bool_or(contains(lower(d.text), lower(b.text))), false) AS covered FROM benchmark b LEFT JOIN bm25 ON bm25.query_id = b.item_id LEFT JOIN documents d ON d.doc_id = bm25.id GROUP BY item_id)"


@query(f"WITH {_hits} SELECT count(*) AS total, count(*) FILTER (covered) AS hits, round(count(*) FILTER (covered)::DOUBLE / count(*), 9) AS value, count(*) FILTER (covered)::DOUBLE / count(*) >= 0.8 AS pass FROM cov")
def coverage_eval(spark, d):
    r = evaluate.shares(_covered(spark, d), "covered")
    return r.select("total", "hits", F.round("value", 9).alias("value"), "pass")


@query(f"WITH {_hits}, r AS (SELECT CASE WHEN {_bucket} < 0.5 THEN 'dev' ELSE 'test' END AS side, item_id % 3 <> 0 AS inside, covered FROM cov) SELECT side, count(*) FILTER (inside) AS n_in_scope, count(*) FILTER (NOT inside) AS n_refusable, round(avg(covered::INT) FILTER (inside), 9) AS coverage, round(avg((NOT covered)::INT) FILTER (NOT inside), 9) AS refusal, coalesce(avg(covered::INT) FILTER (inside), 1) >= 0.8 AND coalesce(avg((NOT covered)::INT) FILTER (NOT inside), 1) >= 0.8 AS pass FROM r GROUP BY side")
def coverage_by_side(spark, d):
    """Every third item as a question to be refused, which it is where nothing covers it."""
    i = F.col("query_id")
    rows = _covered(spark, d).select(evaluate.side(i.cast("string")).alias("side"), (i % 3 != 0).alias("in_scope"), "covered", (~F.col("covered")).alias("refused"))
    r = evaluate.breakdown(rows, ["side"])
    return r.select("side", "n_in_scope", "n_refusable", F.round("coverage", 9).alias("coverage"), F.round("refusal", 9).alias("refusal"), "pass")


@query("SELECT round(sum(n * 256 / 1e6::DOUBLE), 9) AS total_mb, 1.0::DOUBLE AS limit_mb, round(sum(n * 256 / 1e6::DOUBLE), 9) AS share, sum(n * 256 / 1e6::DOUBLE) <= 1 AS fits FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)")
def memory_budget(spark, d):
    """The vectors of each label as parts of an index in memory."""
    parts = table(spark, d, "embeddings").groupBy(F.col("label").alias("name")).agg((F.count(F.lit(1)) * 256 / F.lit(1e6)).alias("mb"))
    r = evaluate.memory_budget(parts, 1.0)
    return r.select(F.round("total_mb", 9).alias("total_mb"), "limit_mb", F.round("share", 9).alias("share"), "fits")


@query(f"WITH {_hits}, ans AS (SELECT item_id, covered, item_id % 4 AS k FROM cov) SELECT CASE WHEN k = 3 THEN 'CONTRADICTED' WHEN k <> 1 AND covered THEN 'OK' WHEN covered THEN 'NOT_USED' WHEN k <> 1 THEN 'UNGROUNDED' ELSE 'MISSED' END AS verdict, count(*) AS n FROM ans GROUP BY 1")
def answer_verdicts(spark, d):
    """Answers made from the coverage: one of four lacks the expected word, one of four says the rejected one."""
    k = F.col("query_id") % 4
    answer = F.concat(F.when(k == 1, F.lit("nothing")).otherwise(F.lit("expected")), F.when(k == 3, F.lit(" rejected")).otherwise(F.lit("")))
    sources = F.when(F.col("covered"), F.lit("expected")).otherwise(F.lit(""))
    v = evaluate.answer_verdict(answer, sources, F.array(F.lit("expected")), F.array(F.lit("REJECTED")))
    return _covered(spark, d).groupBy(v.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH l AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY 1) SELECT event_type, len(v) AS n, v[least(floor(len(v) * 0.5), len(v) - 1)::INT + 1] AS p50, v[least(floor(len(v) * 0.95::DOUBLE), len(v) - 1)::INT + 1] AS p95 FROM l")
def latency_percentiles(spark, d):
    return evaluate.by_index(table(spark, d, "events"), "value", {"p50": 0.5, "p95": 0.95}, ["event_type"])


@query("WITH q AS (SELECT quantile_cont(value, 0.1) AS a, quantile_cont(value, 0.9) AS b FROM events) SELECT i AS step, round(a + (b - a) * i / 8.0::DOUBLE, 6) AS floor FROM q, (SELECT unnest(range(0, 9)) AS i)")
def sweep_range(spark, d):
    return evaluate.sweep_range(table(spark, d, "events"), "value").select(F.col("step").cast("long").alias("step"), F.round("floor", 6).alias("floor"))


@query("WITH f AS (SELECT unnest([10.0, 30.0, 60.0, 90.0])::DOUBLE AS floor), b AS (SELECT user_id, max(value) AS score, user_id % 3 <> 0 AS in_scope FROM events GROUP BY user_id) SELECT floor, round(avg((score >= floor)::INT) FILTER (in_scope), 9) AS coverage, round(avg((score >= floor)::INT) FILTER (NOT in_scope), 9) AS answered_anyway FROM b CROSS JOIN f GROUP BY floor")
def floor_sweep(spark, d):
    best = table(spark, d, "events").groupBy("user_id").agg(F.max("value").alias("score")).withColumn("in_scope", F.col("user_id") % 3 != 0)
    r = evaluate.floor_sweep(best, [10.0, 30.0, 60.0, 90.0])
    return r.select("floor", F.round("coverage", 9).alias("coverage"), F.round("answered_anyway", 9).alias("answered_anyway"))


@query(
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events), q AS (SELECT *, greatest(n // 4, 1) AS k FROM r),
    m AS (SELECT event_type, avg(value) FILTER (i <= k) AS early, avg(value) FILTER (i > n - k) AS late FROM q GROUP BY event_type) SELECT event_type, round(early, 6) AS early, round(late, 6) AS late, round((early - late) / early, 6) AS decay FROM m"""
)
def decay_first_last(spark, d):
    r = evaluate.decay(table(spark, d, "events"), "event_id", "value", ["event_type"])
    return r.select("event_type", *(F.round(c, 6).alias(c) for c in ("early", "late", "decay")))


@query(
    """WITH v AS (SELECT vec_id // 8 AS question_id, (vec_id // 2) % 4 AS choice, vec_id % 2 AS p, list_transform(embedding, lambda x: 10 * x::DOUBLE) AS l FROM embeddings),
    n AS (SELECT *, list_max(l) + ln(list_sum(list_transform(l, lambda x: exp(x - list_max(l))))) AS norm, CASE p WHEN 1 THEN (question_id * 11 + choice * 17) % 64 ELSE (question_id * 3 + 1) % 64 END AS token FROM v)
    SELECT question_id, choice, round(sum(l[token + 1] - norm), 6) AS score, count(*) AS n_scored FROM n WHERE p = 1 OR choice % 2 = 1 GROUP BY ALL"""
)
def continuation_scores(spark, d):
    """Vectors as logits over 64 tokens, two places a choice; every other choice's tokens leave the prompt's before its end."""
    v = F.col("vec_id")
    rows = table(spark, d, "embeddings").select(F.floor(v / 8).alias("question_id"), (F.floor(v / 2) % 4).alias("choice"), (v % 2).alias("position"), "embedding")
    q, c, p = F.col("question_id"), F.col("choice"), F.col("position")
    logits = rows.select("question_id", "choice", "position", F.posexplode("embedding").alias("token", "x")).select("question_id", "choice", "position", F.col("token").cast("long").alias("token"), (F.col("x").cast("double") * 10).alias("logit"))
    places = rows.select("question_id", "choice").distinct().withColumn("position", F.explode(F.array(*(F.lit(i).cast("long") for i in range(3)))))
    sequences = places.withColumn("token", F.when(p == 0, q * 5 % 64).when(p == 1, (q * 3 + c % 2) % 64).otherwise((q * 11 + c * 17) % 64))
    prompts = sequences.filter((c == 0) & (p < 2)).drop("choice")
    return evaluate.continuation_scores(logits, sequences, prompts).select("question_id", "choice", F.round("score", 6).alias("score"), "n_scored")


@query(
    """WITH c AS (SELECT event_id // 4 AS question_id, event_id % 4 AS choice, value AS score, 1 + event_id % 7 AS n_chars, event_id % 4 = (event_id // 4) % 4 AS gold FROM events),
    a AS (SELECT question_id, arg_max(gold, score * 1000003 - choice) AS a, arg_max(gold, score / n_chars) AS b FROM c GROUP BY question_id) SELECT count(*) AS n, round(avg(a::INT), 6) AS acc, round(avg(b::INT), 6) AS acc_norm FROM a"""
)
def argmax_accuracy(spark, d):
    i = F.col("event_id")
    q = F.floor(i / 4)
    choices = table(spark, d, "events").select(q.alias("question_id"), (i % 4).alias("choice"), F.col("value").alias("score"), (1 + i % 7).alias("n_chars"), (i % 4 == q % 4).alias("gold"))
    r = evaluate.argmax_accuracy(choices)
    return r.select("n", F.round("acc", 6).alias("acc"), F.round("acc_norm", 6).alias("acc_norm"))


@query("SELECT event_id, event_type, round(value, 6) AS value, n AS n_of_type FROM events JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) USING (event_type)")
def events_once(spark, d):
    """Events as a stream in which a third comes again and some come a year late, once each, joined with a static table."""
    given = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    static = given.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_of_type"))
    late = given.filter("event_id % 50 = 1").withColumns({"event_id": F.col("event_id") + 10**12, "ts": F.col("ts") - F.expr("INTERVAL 365 DAYS")})
    place = f"{shared_dir(spark)}/events-once-{uuid.uuid4().hex}"
    for rows in (given, given.filter("event_id % 3 = 0"), late):  # rows are late by the watermark of the batch before
        rows.repartition(4).write.mode("append").parquet(f"{place}/in")
    stream = spark.readStream.schema(given.schema).option("maxFilesPerTrigger", 4).parquet(f"{place}/in")
    out = events.run_to_end(events.once(stream, "60 days").join(static, "event_type"), place)
    return out.select("event_id", "event_type", F.round("value", 6).alias("value"), "n_of_type")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, d):
    return events.tumbling(table(spark, d, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH h AS (SELECT time_bucket(INTERVAL 30 minutes, ts) AS b FROM events), s AS (SELECT b AS start FROM h UNION ALL SELECT b - INTERVAL 30 minutes FROM h) SELECT start, count(*) AS n FROM s GROUP BY start")
def events_sliding(spark, d):
    return events.sliding(table(spark, d, "events"))


@query("WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 minutes THEN 0 ELSE 1 END AS fresh FROM events), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 minutes AS \"end\", count(*) AS n FROM g GROUP BY user_id, s")
def events_sessions(spark, d):
    return events.sessions(table(spark, d, "events"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events WHERE ts < (SELECT date_trunc('hour', max(ts) - INTERVAL 10 minutes) FROM events) GROUP BY ALL")
def events_stream(spark, d):
    """The same hours by a stream with a watermark: only those that are closed come out."""
    rows = stored(table(spark, d, "events"))
    source = rows.inputFiles()[0].rsplit("/", 1)[0]
    out = events.run_to_end(events.tumbling(events.stream(spark, source)), f"{source}-hours")
    return out.select("start", "event_type", "n")


@query("WITH l AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY 1) SELECT event_type, len(v) AS n, v[greatest(floor(len(v) * 0.99::DOUBLE)::INT - 1, 0) + 1] AS p99 FROM l")
def p99_by_place(spark, d):
    return evaluate.by_index(table(spark, d, "events"), "value", {"p99": 0.99}, ["event_type"], back=1)


@query(
    """WITH f AS (SELECT conv_id AS answer_id, turn AS seq, CASE WHEN turn = 0 THEN 'language' WHEN turn = 1 AND conv_id % 3 = 0 THEN 'refused' WHEN turn = 1 THEN 'stage' WHEN turn = 2 AND conv_id % 3 > 0 THEN 'sources' WHEN turn = 3 THEN 'stage' ELSE 'done' END AS event FROM conversations),
    g AS (SELECT answer_id, string_agg(event || ' ', '' ORDER BY seq, event) AS s FROM f GROUP BY answer_id) SELECT answer_id, regexp_matches(s, '^language (refused |stage sources stage (token )*(safety )?|stage refused )done $') AS valid FROM g"""
)
def stream_protocol(spark, d):
    """Turns of conversations as the events of answers, some in order, some not."""
    c, t = F.col("conv_id"), F.col("turn")
    event = F.when(t == 0, "language").when((t == 1) & (c % 3 == 0), "refused").when(t == 1, "stage").when((t == 2) & (c % 3 > 0), "sources").when(t == 3, "stage").otherwise("done")
    return events.follows_protocol(table(spark, d, "conversations").select(c.alias("answer_id"), t.alias("seq"), event.alias("event")))
