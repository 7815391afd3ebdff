"""Queries of the rules on questions and answers: all turns of the conversations, and literal rows that rules fire on."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import language, questions, safety, scope, text
from ..operators import answer, ingest
from ..operators.tables import shared_dir, stored
from ..sources import files
from ..streaming import guard
from . import fixtures as fx
from . import rule_sql as R
from . import sql as S
from .base import registry, table

ENTRIES, query = registry()
_q = f"(SELECT 'c' || conv_id || '-' || turn AS id, coalesce(text, '') AS q FROM conversations UNION ALL SELECT 'f' || (row_number() OVER ()) AS id, q FROM {fx.sql_values(fx.QUESTIONS, 'q')})"
_a = f"(SELECT 'c' || conv_id || '-' || turn AS id, coalesce(text, '') AS a, '' AS q FROM conversations UNION ALL SELECT 'f' || (row_number() OVER ()) AS id, a, q FROM {fx.sql_values(fx.ANSWERS, 'a, q')})"


def asked(spark, d):
    own = table(spark, d, "conversations").select(F.concat(F.lit("c"), F.concat_ws("-", "conv_id", "turn")).alias("id"), F.coalesce("text", F.lit("")).alias("q"))
    return own.unionByName(fx.frame(spark, [(f"f{i}", q) for i, q in enumerate(fx.QUESTIONS, 1)], "id string, q string"))


def answered(spark, d):
    own = table(spark, d, "conversations").select(F.concat(F.lit("c"), F.concat_ws("-", "conv_id", "turn")).alias("id"), F.coalesce("text", F.lit("")).alias("a"), F.lit("").alias("q"))
    return own.unionByName(fx.frame(spark, [(f"f{i}", a, q) for i, (a, q) in enumerate(fx.ANSWERS, 1)], "id string, a string, q string"))


@query(f"SELECT id, {S.scope_reason('q')} AS reason FROM {_q}")
def scope_check(spark, d):
    return asked(spark, d).select("id", scope.refusal_reason(F.col("q"), F.lit("en")).alias("reason"))


@query(f"SELECT coalesce(regexp_replace(reason, ':.*', ''), 'in scope') AS reason, count(*) AS n FROM (SELECT {S.scope_reason('q')} AS reason FROM {_q}) GROUP BY 1")
def scope_reason_counts(spark, d):
    reason = F.coalesce(F.regexp_replace(scope.refusal_reason(F.col("q"), F.lit("en")), ":.*", ""), F.lit("in scope"))
    return asked(spark, d).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(R.scope_messages(_q))
def scope_messages(spark, d):
    df = asked(spark, d).withColumn("language", language.detect(F.col("q")))
    reason = scope.refusal_reason(language.pidgin_normalised(F.col("q")), F.col("language"))
    return df.select("id", "language", reason.alias("reason"), scope.refusal_text(reason, F.col("language")).alias("answer"))


@query(f"WITH {R.languages(_q)} SELECT id, language, round({R.confidence()}, 9) AS confidence FROM spoken")
def detect_language(spark, d):
    return asked(spark, d).select("id", language.detect(F.col("q")).alias("language"), F.round(language.confidence(F.col("q")).cast("double"), 9).alias("confidence"))


@query(f"SELECT id, {R.looks_pidgin('q')} AS pidgin, {R.pidgin_normalised('q')} AS normalised FROM {_q}")
def pidgin_normalise(spark, d):
    return asked(spark, d).select("id", language.looks_pidgin(F.col("q")).alias("pidgin"), language.pidgin_normalised(F.col("q")).alias("normalised"))


@query(rf"SELECT id, {S.rx('q', X.YORUBA_MARKS)} OR {R.among(r"regexp_extract_all(lower(q), '[\pL\pM\pN_]+')", X.YORUBA_MARKERS)} >= 2 AS yoruba FROM {_q}")
def looks_yoruba(spark, d):
    return asked(spark, d).select("id", language.looks_yoruba(F.col("q")).alias("yoruba"))


@query(f"WITH {R.languages(_q)} {R.farm_terms()}")
def farm_terms(spark, d):
    return asked(spark, d).select("id", language.with_farm_terms(F.col("q"), language.detect(F.col("q"))).alias("expanded"))


@query(R.retrieval_query(_q))
def retrieval_query(spark, d):
    return asked(spark, d).select("id", questions.retrieval_query(F.col("q")).alias("search_text"))


@query(R.diagnostic_intent(_q))
def diagnostic_intent(spark, d):
    return asked(spark, d).select("id", questions.with_diagnostic_intent(F.col("q")).alias("search_text"))


_signs = ", ".join(f"CASE WHEN {S.rx('q', '(?i)' + p)} THEN {fx.sql_string(n)} END" for p, n in X.SIGN_TO_NAME)


@query(f"SELECT id, array_to_string(list_sort(list_distinct(list_filter([{_signs}], lambda x: x IS NOT NULL))), ', ') AS names FROM {_q}")
def sign_names(spark, d):
    return asked(spark, d).select("id", F.array_join(F.array_sort(questions.sign_names(F.col("q"))), ", ").alias("names"))


@query(f"SELECT id, list_has_any(regexp_extract_all(lower(q), '[a-z]+'), [{', '.join(fx.sql_string(w) for w in X.SYMPTOM_WORDS)}]) AS symptoms FROM {_q}")
def describes_symptoms(spark, d):
    return asked(spark, d).select("id", questions.describes_symptoms(F.col("q")).alias("symptoms"))


@query(f"SELECT id, {S.rx('q', X.FIELD_CONTEXT)} AND NOT {S.rx('q', X.STORE_CONTEXT)} AS field FROM {_q}")
def asks_about_field(spark, d):
    return asked(spark, d).select("id", questions.asks_about_field(F.col("q")).alias("field"))


@query(f"SELECT id, {S.rx('q', X.CLOSED_OPENER)} AND {S.rx('q', X.REGULATORY)} AND {S.rx('q', X.JURISDICTION)} AS unsettled FROM {_q}")
def polarity_guard(spark, d):
    return asked(spark, d).select("id", questions.cannot_be_settled(F.col("q")).alias("unsettled"))


@query(f"SELECT id, {S.rx('q', X.TIME_DEPENDENT)} AS timed FROM {_q}")
def depends_on_time(spark, d):
    return asked(spark, d).select("id", questions.depends_on_time(F.col("q")).alias("timed"))


_crops = ", ".join(f"CASE WHEN {' OR '.join(f'contains(lower(q), {fx.sql_string(t)})' for t in ts)} THEN {fx.sql_string(c)} END" for c, ts in X.CROP_TERMS.items())


@query(f"SELECT id, array_to_string(list_sort(list_filter([{_crops}], lambda x: x IS NOT NULL)), ', ') AS crops FROM {_q}")
def infer_crops(spark, d):
    low = F.lower("q")
    found = []
    for crop, terms in X.CROP_TERMS.items():
        hit = F.lit(False)
        for t in terms:
            hit = hit | F.contains(low, F.lit(t))
        found.append(F.when(hit, crop))
    return asked(spark, d).select("id", F.array_join(F.array_sort(F.array_compact(F.array(*found))), ", ").alias("crops"))


_actives = ", ".join(f"CASE WHEN {S.rx('lower(a)', chr(92) + 'b' + t.replace('-', chr(92) + '-') + chr(92) + 'b')} THEN {fx.sql_string(t)} END" for t in sorted(set(X.HAZARDOUS_ACTIVES)))


@query(f"SELECT id, array_to_string(list_filter([{_actives}], lambda x: x IS NOT NULL), ', ') AS actives FROM {_a}")
def hazardous_actives(spark, d):
    return answered(spark, d).select("id", F.array_join(safety.hazardous(F.col("a")), ", ").alias("actives"))


_sources = "\n".join(fx.SOURCES)


@query(f"SELECT id, array_to_string(said, '; ') AS doses FROM (SELECT id, {R.doses('a')} AS said FROM {_a})")
def find_dosages(spark, d):
    return answered(spark, d).select("id", F.array_join(safety.doses(F.col("a")), "; ").alias("doses"))


@query(f"SELECT id, array_to_string({R.lacking('said', _sources)}, '; ') AS unsupported FROM (SELECT id, {R.doses('a')} AS said FROM {_a})")
def unsupported_dosages(spark, d):
    return answered(spark, d).select("id", F.array_join(safety.unsupported_doses(F.col("a"), F.lit(_sources)), "; ").alias("unsupported"))


@query(f"SELECT id, {R.without_money('a')} AS answer FROM {_a}")
def redact_money(spark, d):
    return answered(spark, d).select("id", safety.without_money(F.col("a")).alias("answer"))


@query(f"SELECT id, array_to_string({R.foreign_money('a')}, ', ') AS currencies FROM {_a}")
def foreign_money(spark, d):
    return answered(spark, d).select("id", F.array_join(safety.foreign_money(F.col("a")), ", ").alias("currencies"))


_found = ("hazardous", "unsupported_doses", "stale_sources", "restricted_veterinary", "foreign_money")


@query(f"WITH {R.verdict(_a, fx.SOURCES, ['2010', 'unknown'], fx.NOW)} SELECT id, safe, missing_withdrawal, container_reuse, {', '.join(f"array_to_string({k}, '; ') AS {k}" for k in _found)} FROM judged")
def safety_verdict(spark, d):
    v = safety.verdict(F.col("a"), F.array(*map(F.lit, fx.SOURCES)), F.col("q"), F.array(F.lit("2010"), F.lit("unknown")), fx.NOW)
    return answered(spark, d).select("id", v.alias("v")).select("id", "v.safe", "v.missing_withdrawal", "v.container_reuse", *(F.array_join(f"v.{k}", "; ").alias(k) for k in _found))


@query(f"SELECT id, {S.rx('a', X.CHEMICAL_CONTEXT)} AS chemical, {S.rx('a', X.SAFETY_CRITICAL)} AS critical FROM {_a}")
def chemical_context(spark, d):
    return answered(spark, d).select("id", safety.has_chemical_context(F.col("a")).alias("chemical"), text.is_safety_critical(F.col("a")).alias("critical"))


_cut = f"regexp_replace(regexp_replace(a, {fx.sql_string(X.FALSE_DISCLAIMER)}, ''), '^[ \\n]+', '')"


@query(f"SELECT id, md5(CASE WHEN {S.rx('a', X.FALSE_DISCLAIMER)} AND {_cut} <> '' THEN upper(left({_cut}, 1)) || substr({_cut}, 2) ELSE a END) AS digest FROM {_a}")
def strip_disclaimer(spark, d):
    return answered(spark, d).select("id", F.md5(safety.without_disclaimer(F.col("a"))).alias("digest"))


@query(f"SELECT id, {R.replaced('a', R.lacking('said', _sources), X.DOSE_REMOVED)} AS answer FROM (SELECT *, {R.doses('a')} AS said FROM {_a})")
def redact_doses(spark, d):
    return answered(spark, d).select("id", safety.replaced(F.col("a"), safety.unsupported_doses(F.col("a"), F.lit(_sources)), X.DOSE_REMOVED).alias("answer"))


@query(f"WITH {R.verdict(_a, fx.SOURCES, ['2010', 'unknown'], fx.NOW)}, l AS (SELECT *, 'en' AS language FROM judged) SELECT id, {R.notice()} AS notice FROM l")
def safety_notice(spark, d):
    v = safety.verdict(F.col("a"), F.array(*map(F.lit, fx.SOURCES)), F.col("q"), F.array(F.lit("2010"), F.lit("unknown")), fx.NOW)
    return answered(spark, d).select("id", safety.notice(v, F.lit("en")).alias("notice"))


@query(R.prompt(_q, fx.SOURCES))
def build_prompt(spark, d):
    hits = F.array(*(F.struct(F.lit(t).alias("text"), F.lit("A title").alias("title"), F.lit("2001").alias("year")) for t in fx.SOURCES))
    return asked(spark, d).select("id", answer.prompt(F.col("q"), hits).alias("p")).select("id", F.md5("p.system").alias("system"), F.md5("p.user").alias("user"))


@query(R.without_echo(_a))
def symptom_echo(spark, d):
    return answered(spark, d).select("id", safety.without_echo(F.col("a"), F.col("q")).alias("answer"))


@query(rf"SELECT id, md5(nullif(regexp_replace(regexp_replace(a, {fx.sql_string(X.CITATION_RUN)}, ''), '^\s+', ''), '')) AS digest FROM {_a}")
def citation_dump(spark, d):
    return answered(spark, d).select("id", F.md5(safety.without_citation_run(F.col("a"))).alias("digest"))


_year = "regexp_extract(coalesce(text, ''), '[0-9]{1,2}[0-9x.][0-9]', 0)"


@query(f"SELECT doc_id, year, coalesce({fx.NOW} - CASE WHEN regexp_matches(trim(left(year, 4)), '^[0-9]+$') THEN trim(left(year, 4))::INT END > 10, true) AS stale FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN (2000 + doc_id % 40)::VARCHAR ELSE {_year} END AS year FROM documents)")
def stale_sources(spark, d):
    """A third of the documents by a year of their own, the others by the first number in their text that might be one."""
    year = F.when(F.col("doc_id") % 3 == 0, (2000 + F.col("doc_id") % 40).cast("string")).otherwise(F.regexp_extract(F.coalesce("text", F.lit("")), "[0-9]{1,2}[0-9x.][0-9]", 0))
    return table(spark, d, "documents").select("doc_id", year.alias("year")).withColumn("stale", safety.is_stale(F.col("year"), fx.NOW))


@query(f"SELECT id, 'event: token' || chr(10) || 'data: ' || length(a) || chr(10) || chr(10) AS frame FROM {_a}")
def sse_frames(spark, d):
    return answered(spark, d).select("id", files.event_frame(F.lit("token"), F.length("a").cast("string")).alias("frame"))


@query(
    """WITH s AS (SELECT vec_id AS id, 'draft ' || vec_id AS draft, CASE vec_id % 4 WHEN 0 THEN ' OK ' WHEN 1 THEN '' WHEN 2 THEN 'new words' ELSE 'fine' END AS answer FROM embeddings)
    SELECT id, CASE WHEN trim(answer) = '' THEN NULL WHEN lower(trim(answer)) IN ('ok', 'fine') THEN draft ELSE trim(answer) END AS corrected FROM s"""
)
def review_sheet(spark, d):
    i = F.col("vec_id")
    sheet = table(spark, d, "embeddings").select(i.alias("id"), F.concat(F.lit("draft "), i.cast("string")).alias("draft"), F.when(i % 4 == 0, " OK ").when(i % 4 == 1, "").when(i % 4 == 2, "new words").otherwise("fine").alias("answer"))
    return files.reviewed(sheet).select("id", "corrected")


@query("SELECT conv_id, turn, role IN ('user', 'assistant') AS known FROM conversations WHERE trim(lower(role)) NOT IN ('system', 'admin')")
def title_blocklist(spark, d):
    rows = table(spark, d, "conversations")
    return rows.filter(~ingest.title_blocked(F.col("role"), ("system", "admin"))).select("conv_id", "turn", F.col("role").isin("user", "assistant").alias("known"))


@query(R.guarded(_a, _sources))
def guarded_stream(spark, d):
    """All answers as streams of seven-character pieces, through the guard to the end of the input."""
    from ..streaming.events import run_to_end

    n = F.greatest(F.ceil(F.length("a") / 7.0), F.lit(1)).cast("int")
    cut = answered(spark, d).select(F.col("id").alias("answer_id"), "a", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("seq"))
    pieces = cut.select("answer_id", "seq", F.substring("a", F.col("seq") * 7 + 1, F.lit(7)).alias("piece"), (F.col("seq") == F.col("n") - 1).alias("is_last"), F.lit("\n".join(fx.SOURCES)).alias("sources"))
    table_ = stored(pieces)
    source = table_.inputFiles()[0].rsplit("/", 1)[0]
    stream = spark.readStream.schema(table_.schema).parquet(source)
    out = run_to_end(guard.guarded(stream), f"{source}-guarded")
    return out.groupBy("answer_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("upto", "text"))), lambda x: x["text"]), "").alias("text"))


_cut = f"(SELECT id, CASE WHEN length(a) % 5 = 0 AND length(a) > 7 THEN left(a, 7 * (ceil(length(a) / 7.0)::INT - 1)) ELSE a END AS a FROM {_a})"
_speed = "greatest(ceil(length(a) / 7.0), 1)::BIGINT AS tokens, 500::BIGINT AS first_ms, CASE WHEN length(a) > 7 THEN 20.0::DOUBLE END AS per_second"


@query(R.guarded(_cut, _sources).replace("SELECT id AS answer_id,", f"SELECT id AS answer_id, {_speed},"))
def token_log_guarded(spark, d):
    """All answers as growing token logs, 20 pieces of seven characters a second; every answer of a length divisible by five loses its last piece and is closed by event time."""
    from ..streaming import answers, tokens
    from ..streaming.events import run_to_end

    n = F.greatest(F.ceil(F.length("a") / 7.0), F.lit(1)).cast("int")
    cut = answered(spark, d).select(F.col("id").alias("answer_id"), "a", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("seq"))
    ts = F.timestamp_millis(F.lit(1704067200500) + F.col("seq") * 50)
    asked = F.timestamp_millis(F.lit(1704067200000))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    said = cut.filter((F.length("a") % 5 > 0) | (F.col("n") == 1) | (F.col("seq") < F.col("n") - 1))
    last = F.col("seq") == F.col("n") - 1
    lines = said.select("answer_id", "seq", F.substring("a", F.col("seq") * 7 + 1, F.lit(7)).alias("piece"), last.alias("is_last"), F.lit("\n".join(fx.SOURCES)).alias("sources"), stamp(asked).alias("asked"), stamp(ts).alias("ts"))
    end = spark.range(1).select(F.lit("end of the log").alias("answer_id"), F.lit(0).alias("seq"), F.lit("").alias("piece"), F.lit(False).alias("is_last"), F.lit("").alias("sources"), stamp(asked).alias("asked"), stamp(F.timestamp_millis(F.lit(1735689600000))).alias("ts"))
    place = f"{shared_dir(spark)}/token-log-{uuid.uuid4().hex}"
    lines.unionByName(end).write.json(place)
    out = run_to_end(answers.answered(tokens.token_log(spark, place), attempts=1), f"{place}-guarded")
    whole = out.groupBy("answer_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("upto", F.when(F.col("state") == "more", 0).otherwise(1).alias("end"), "text"))), lambda x: x["text"]), "").alias("text"), F.max("tokens").alias("tokens"), F.max("first_ms").alias("first_ms"), F.round(F.max("per_second"), 6).alias("per_second"))
    return whole.filter("answer_id <> 'end of the log'")


@query(
    """WITH p AS (SELECT label AS k, max(vec_id) FILTER (vec_id % 2 = 0) AS even, max(vec_id) AS last FROM embeddings GROUP BY label), f AS (SELECT vec_id AS id, label + vec_id % 2 * 100 AS k FROM embeddings)
    SELECT f.id, coalesce('d' || coalesce(even, last), '') AS draft, CASE WHEN even IS NOT NULL THEN 'c' || even END AS corrected FROM f LEFT JOIN p USING (k)"""
)
def carry_review(spark, d):
    """Half the rows keep an English text of the sheet before; of a text's rows, a corrected one counts, then the greatest draft."""
    v, e = F.col("vec_id"), table(spark, d, "embeddings")
    pad = F.lpad(v.cast("string"), 9, "0")
    prior = e.select(F.col("label").cast("string").alias("english"), F.concat(F.lit("d"), pad).alias("draft"), F.when(v % 2 == 0, F.concat(F.lit("c"), pad)).alias("corrected"))
    fresh = e.select(v.alias("id"), (F.col("label") + v % 2 * 100).cast("string").alias("english"))
    bare = lambda c: F.regexp_replace(c, "^([cd])0+(?=.)", "$1")
    return files.carried(fresh, prior).select("id", bare("draft").alias("draft"), bare("corrected").alias("corrected"))


@query("SELECT vec_id::VARCHAR AS id, CASE vec_id % 4 WHEN 0 THEN 'draft ' || vec_id WHEN 1 THEN NULL WHEN 2 THEN 'new words' ELSE 'draft ' || vec_id END AS corrected FROM embeddings")
def import_review(spark, d):
    """A filled sheet in which every third id bears the mark of urgent rows."""
    i = F.col("vec_id")
    items = table(spark, d, "embeddings").select(i.cast("string").alias("id"))
    name = F.concat(F.when(i % 3 == 0, F.lit("CRITICAL ")).otherwise(F.lit("")), i.cast("string"))
    sheet = table(spark, d, "embeddings").select(name.alias("id"), F.concat(F.lit("draft "), i.cast("string")).alias("draft"), F.when(i % 4 == 0, "yes").when(i % 4 == 1, " ").when(i % 4 == 2, "new words").otherwise("Correct").alias("answer"))
    return files.imported(items, sheet).select("id", "corrected")


@query("SELECT event_id, coalesce(props::JSON ->> '$.k', 'none') AS k FROM events")
def metadata_first_value(spark, d):
    """Fields of a record as lists of values, as repositories give them."""
    props = F.from_json("props", "map<string,string>")
    listed = F.transform_values(props, lambda k, v: F.array(F.struct(v.alias("value"))))
    return table(spark, d, "events").select("event_id", files.meta(listed, "k", "none").alias("k"))
