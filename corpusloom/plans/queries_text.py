"""Queries of text functions, ingest and deduplication."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import language, quality, tables, text
from ..operators import chunk, dedup, html, ingest, relevance
from ..operators.tables import shared_dir
from ..sources import files, snapshots
from . import fixtures as fx
from . import rule_sql as R
from . import sql as S
from .base import registry, table

ENTRIES, query = registry()
_passages = f"SELECT 'd' || doc_id AS id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 'f' || (row_number() OVER ()) AS id, p AS text FROM {fx.sql_values(fx.PASSAGES, 'p')}"


def passages(spark, d):
    """All documents and the literal passages, by a text id."""
    own = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return own.unionByName(fx.frame(spark, [(f"f{i}", p) for i, p in enumerate(fx.PASSAGES, 1)], "id string, text string"))


@query(f"WITH t AS (SELECT doc_id, {S.tokens('text')} AS l FROM documents) SELECT doc_id, len(l) AS n_tokens, md5(array_to_string(l, ' ')) AS digest FROM t")
def tokenize(spark, d):
    t = text.tokens(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", t.alias("l")).select("doc_id", F.size("l").cast("long").alias("n_tokens"), F.md5(F.array_join("l", " ")).alias("digest"))


@query(f"WITH {S.stemmed('documents', 'doc_id', 'text')} SELECT DISTINCT token, term FROM stems")
def stem_terms(spark, d):
    tokens = table(spark, d, "documents").select(F.explode(text.tokens(F.coalesce("text", F.lit("")))).alias("token")).distinct()
    return tokens.select("token", text.stem(F.col("token")).alias("term"))


@query(r"""SELECT id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '([\pL\pN_])-\n([\pL\pN_])', '\1\2', 'g'), '[ \t\x{A0}]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM (""" + _passages + ")")
def clean_text(spark, d):
    return passages(spark, d).select("id", F.md5(text.clean(F.col("text"))).alias("digest"))


@query(
    r"""WITH p AS (""" + _passages + r"""), l AS (SELECT id, list_transform(string_split(regexp_replace(text, '[ \t\x{A0}]+', ' ', 'g'), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS ls FROM p),
    k AS (SELECT id, list_filter(ls, lambda x: x = '' OR len(list_filter(string_split_regex(x, '\s+'), lambda w: w <> '')) > 2) AS ls FROM l)
    SELECT id, md5(regexp_replace(regexp_replace(array_to_string(ls, chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM k"""
)
def html_clean_lines(spark, d):
    return passages(spark, d).select("id", F.md5(text.clean_lines(F.col("text"))).alias("digest"))


@query(R.strip_boilerplate(_passages))
def strip_boilerplate(spark, d):
    return passages(spark, d).select("id", text.strip_boilerplate(F.col("text")).alias("text"))


@query(R.strip_furniture(_passages))
def strip_furniture(spark, d):
    return passages(spark, d).select("id", text.strip_furniture(F.col("text"), F.lit("")).alias("text"))


@query(
    r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM documents), t AS (SELECT doc_id, regexp_replace(x, '^\s+|\s+$', '', 'g') AS x FROM l)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (x <> '' AND length(x) <= 72 AND (ends_with(x, ':') OR (regexp_matches(x, """ + fx.sql_string(X.HEADING) + r""") AND len(list_filter(string_split_regex(x, '\s+'), lambda w: w <> '')) <= 9))) AS n_headings FROM t GROUP BY doc_id"""
)
def heading_lines(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("x"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(text.is_heading(F.col("x")).cast("long")).alias("n_headings"))


@query(
    r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, CASE WHEN length(x) < 80 THEN '#' || i ELSE '=' || left(regexp_replace(lower(x), '[^\pL\pN\pM_]+', '', 'g'), 200) END ORDER BY i) AS nth FROM l)
    SELECT doc_id, count(*) AS n_lines, md5(string_agg(x, chr(10) ORDER BY i)) AS digest FROM k WHERE nth = 1 GROUP BY doc_id"""
)
def line_dedup(spark, d):
    kept = table(spark, d, "documents").select("doc_id", text.unique_long_lines(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("l"))
    return kept.select("doc_id", F.size("l").cast("long").alias("n_lines"), F.md5(F.array_join("l", "\n")).alias("digest"))


@query(
    r"""WITH l AS (SELECT id, unnest(string_split(text, chr(10))) AS x FROM (""" + _passages + r""")) SELECT id, count(*) FILTER (""" + S.rx(r"regexp_replace(x, '^\s+|\s+$', '', 'g')", X.FIELD_LABEL) + r""") AS n_labels FROM l GROUP BY id"""
)
def field_labels(spark, d):
    lines = passages(spark, d).select("id", F.explode(F.split("text", "\n", -1)).alias("x"))
    return lines.groupBy("id").agg(F.sum(text.is_field_label(F.col("x")).cast("long")).alias("n_labels"))


@query(R.sentences(_passages))
def sentences_table(spark, d):
    """The same by the SQL table function."""
    tables.register(spark)
    passages(spark, d).createOrReplaceTempView("sentences_table_given")
    return spark.sql("SELECT id, CAST(position AS INT) AS pos, sentence FROM sentences_of(TABLE(SELECT id, text FROM sentences_table_given) PARTITION BY id)")


@query(R.sentences(_passages))
def sentences(spark, d):
    return passages(spark, d).select("id", F.posexplode(text.sentences(F.col("text"))).alias("pos", "sentence"))


@query(r"""SELECT page_id, regexp_replace(left(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 60), '_+$', '') AS slug, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS host FROM pages""")
def url_slug(spark, d):
    return table(spark, d, "pages").select("page_id", text.slug(F.col("url")).alias("slug"), F.lower(F.regexp_extract("url", "^[a-zA-Z]+://([^/?#]*)", 1)).alias("host"))


@query("SELECT page_id, url FROM pages WHERE ends_with(lower(url), '.html') AND regexp_matches(url, '^[a-z]+://[^/]*/(en|de)/')")
def pages_wanted(spark, d):
    inner = table(spark, d, "pages").withColumn("path", F.regexp_replace("url", "^[a-z]+://[^/]*/", "site/"))
    return files.wanted(inner, ["en/", "de/"]).select("page_id", "url")


@query()
def html_extract(spark, d):
    return html.extract(table(spark, d, "pages")).withColumn("usable", html.usable())


@query("SELECT p.id, CASE WHEN ws.n < 20 THEN 1.0::DOUBLE ELSE ws.k::DOUBLE / ws.n END AS share FROM (" + _passages + ") p, LATERAL (SELECT len(regexp_extract_all(p.text, '[A-Za-z]+')) AS n, len(list_filter(regexp_extract_all(p.text, '[A-Za-z]+'), lambda w: length(w) >= 3)) AS k) ws")
def q_real_word_share(spark, d):
    return passages(spark, d).select("id", quality.real_word_share(F.col("text")).alias("share"))


_front = f"{S.rx_count('left(text, 600)', X.FRONT_MATTER)} + {S.rx_count('left(text, 600)', X.COPYRIGHT)}"
_marks = "array_to_string(regexp_extract_all(text, '[.!?]'), '')"
_run = f"list_max(list_transform(string_split_regex({_marks}, '[.!]'), lambda x: length(x)))"
_form = f"({S.rx_count('text', X.BLANK_RUN)} >= 3 OR ({S.rx('text', X.FORM_NUMBERING)} AND {S.rx('text', X.BLANK_RUN)}))"
_check = rf"(len(list_filter(string_split_regex(text, '[.!?]+\s+'), lambda s: trim(s) <> '')) >= 4 AND {_run} >= 3 AND ({_run} >= 5 OR {S.rx_count('text', X.SELF_ASSESSMENT)} >= 2))"


@query(f"SELECT id, {_front} > 2 AS front_matter FROM ({_passages})")
def q_front_matter(spark, d):
    return passages(spark, d).select("id", quality.is_front_matter(F.col("text")).alias("front_matter"))


@query(f"SELECT id, {_form} AS form FROM ({_passages})")
def q_form(spark, d):
    return passages(spark, d).select("id", quality.is_form(F.col("text")).alias("form"))


@query(f"SELECT id, {_check} AS checklist FROM ({_passages})")
def q_checklist(spark, d):
    return passages(spark, d).select("id", quality.is_question_checklist(F.col("text")).alias("checklist"))


@query(
    f"""WITH p AS ({_passages}), s AS (SELECT *, len(regexp_extract_all(text, '[A-Za-z]+')) AS n, len(list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda w: length(w) >= 3)) AS k FROM p)
    SELECT id, CASE WHEN {_front} > 2 THEN 'front matter' WHEN n >= 20 AND k::DOUBLE / n < 0.72 THEN 'garbled text' WHEN {_form} THEN 'questionnaire or worksheet, not guidance'
    WHEN {_check} THEN 'self-assessment checklist, not guidance' END AS reason FROM s"""
)
def q_is_usable(spark, d):
    reason = quality.unusable_reason(F.col("text"))
    return passages(spark, d).select("id", F.regexp_replace(reason, r" \(\d+% real words\)$", "").alias("reason"))


_licence = r"regexp_extract(text, '(CC BY[A-Z0-9. -]*[0-9.]|Apache License|MIT License|GNU General Public License)', 1)"


@query(
    f"""WITH l AS (SELECT 'd' || doc_id AS id, {_licence} AS licence FROM documents UNION ALL SELECT id, licence FROM {fx.sql_values(fx.RECORDS, 'id, access, licence, kind')})
    SELECT id, licence, CASE WHEN {S.rx('licence', X.NO_DERIVATIVES)} THEN 'NoDerivatives (' || licence || ')' WHEN {S.rx('licence', X.PROPRIETARY)} THEN 'proprietary (' || licence || ')' END AS excluded FROM l"""
)
def licence_gate(spark, d):
    own = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.regexp_extract("text", r"(CC BY[A-Z0-9. -]*[0-9.]|Apache License|MIT License|GNU General Public License)", 1).alias("licence"))
    rows = own.unionByName(fx.frame(spark, fx.RECORDS, "id string, access string, licence string, kind string").select("id", "licence"))
    return rows.select("id", "licence", quality.licence_reason(F.col("licence")).alias("excluded"))


_licence_line = "coalesce(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '(?i)licen[cs]e|copyright|rights'))[1], '')"
_kinds = [*ingest.GUIDANCE_TYPES, "journal article", ""]


@query(
    f"""WITH r AS (SELECT doc_id, CASE WHEN lang = 'en' THEN ' Open Access' ELSE coalesce(lang, '') END AS access, {_licence_line} AS licence, {S.listed(_kinds).replace('(', '[', 1)[:-1]}][coalesce(length(text), 0) % {len(_kinds)} + 1] AS kind FROM documents)
    SELECT doc_id, CASE WHEN lower(trim(access)) <> 'open access' THEN 'access rights: ' || CASE WHEN trim(access) = '' THEN 'unspecified' ELSE access END
    WHEN {S.rx('licence', X.NO_DERIVATIVES)} THEN 'licence: NoDerivatives (' || licence || ')' WHEN {S.rx('licence', X.PROPRIETARY)} THEN 'licence: proprietary (' || licence || ')'
    WHEN lower(trim(kind)) NOT IN {S.listed(ingest.GUIDANCE_TYPES)} THEN 'type: ' || CASE WHEN trim(kind) = '' THEN 'unspecified' ELSE lower(trim(kind)) END || ' (not extension guidance)' END AS rejected FROM r"""
)
def vet_gates(spark, d):
    """All documents: access by language, licence by the line of the text that speaks of it, type by the text's length."""
    kind = F.get(F.array(*map(F.lit, _kinds)), (F.coalesce(F.length("text"), F.lit(0)) % len(_kinds)).cast("int"))
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.rlike(x, F.lit("(?i)licen[cs]e|copyright|rights")))
    line = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    access = F.when(F.col("lang") == "en", " Open Access").otherwise(F.coalesce("lang", F.lit("")))
    return table(spark, d, "documents").select("doc_id", ingest.vet(access, line, kind).alias("rejected"))


@query("SELECT sha256(coalesce(text, '')) AS sha256, min(doc_id) AS id, count(*) AS copies FROM documents GROUP BY 1")
def exact_dedup(spark, d):
    return dedup.exact(table(spark, d, "documents"))


_near = f"""{S.shingled('documents', 'doc_id')}, src AS (SELECT doc_id AS id, source FROM documents), sets AS (SELECT id, md5(string_agg(s, '|' ORDER BY s)) AS k, count(*) AS n FROM sh GROUP BY id),
    first AS (SELECT source, k, min(id) AS id, any_value(n) AS n FROM sets JOIN src USING (id) GROUP BY ALL), fs AS (SELECT first.id, source, n, s FROM first JOIN sh USING (id)),
    m AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM fs a JOIN fs b ON a.s = b.s AND a.source = b.source AND a.id < b.id GROUP BY ALL),
    near AS (SELECT a, b, round(c / (na + nb - c)::DOUBLE, 6) AS jaccard FROM m WHERE c / (na + nb - c)::DOUBLE >= 0.75 - 1e-12)"""


@query(f"WITH {_near} SELECT * FROM near")
def near_dup_pairs(spark, d):
    return dedup.near_pairs(table(spark, d, "documents"), block="source").select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query(f"WITH {R.near_keep(_near)} SELECT d.doc_id AS id, sets.id IS NULL OR (first.id = d.doc_id AND (d.doc_id NOT IN (SELECT id FROM node) OR coalesce(list_contains((SELECT ids FROM fold), d.doc_id), false))) AS kept FROM documents d LEFT JOIN sets ON sets.id = d.doc_id LEFT JOIN first ON first.source = d.source AND first.k = sets.k")
def near_dup_keep(spark, d):
    return dedup.near_keep(table(spark, d, "documents"), block="source")


_votes = ", ".join(f"len(list_filter(w, lambda x: x IN {S.listed(stops)})) AS {lang}" for lang, stops in X.LANGUAGE_STOPWORDS.items())


@query(f"WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-zàâçéèêëîïôûùüÿñæœáíóúü]+')[1:20000] AS w FROM documents) SELECT doc_id, {_votes} FROM w")
def lang_vote(spark, d):
    votes = language.stopword_votes(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", *(v.cast("long").alias(k) for k, v in votes.items()))


#: A lexicon that the test texts use, in place of the domain's, which they do not.
GENERIC = {"function": ("the", "and", "that", "with", "from", "of the"), "article": ("der", "die", "das", "les", "los"), "institutional": ("project team",), "africa": ("africa",), "elsewhere": ("canada",)}


@query(R.lexicon(GENERIC))
def lexicon_group_counts(spark, d):
    """All groups over all documents."""
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", *(relevance.total(relevance.term_hits(t, ts)).cast("long").alias(f"n_{g}") for g, ts in GENERIC.items()))


_GUIDE = [
    "Cassava mosaic causes yellowing and stunted plants in Nigeria. Farmers should prune, weeding and rotation help; aphids and whiteflies are a vector. " * 6,
    "Maize and cowpea: crop rotation, mulching and early planting control weeds in Ghana. Goats and poultry need vaccination. Market prices fall at harvest. " * 9,
    "The steering committee and stakeholders held a workshop on co-funding in Kenya; participants report on the project. " * 20,
    "Aphids on beans in Canada and Florida: prune, spray, mulch, weeding, pests, blight, wilting and yellowing plants. " * 8,
    "pest pests blight aphid aphids wilting mosaic weevil " * 12,
]


@query(R.relevance(_passages + " UNION ALL SELECT 'g' || (row_number() OVER ()) AS id, p AS text FROM " + fx.sql_values(_GUIDE, "p"), relevance.GROUPS))
def relevance_score(spark, d):
    """All documents, and literal ones that meet other decisions."""
    return _relevance(spark, d)


@query(R.relevance(_passages + " UNION ALL SELECT 'g' || (row_number() OVER ()) AS id, p AS text FROM " + fx.sql_values(_GUIDE, "p"), relevance.GROUPS))
def relevance_automaton(spark, d):
    """The same query by its older name; both find all terms by one automaton."""
    return _relevance(spark, d)


def _relevance(spark, d):
    more = fx.frame(spark, [(f"g{i}", p) for i, p in enumerate(_GUIDE, 1)], "id string, text string")
    found = relevance.scored(passages(spark, d).unionByName(more))
    named = F.array_join(F.transform("top_terms", lambda x: F.concat(x["term"], F.lit(":"), x["n"].cast("string"))), ", ")
    return found.select("id", "n_words", "positive", F.round("score", 6).alias("score"), "language", F.array_join("areas", ", ").alias("areas"), F.array_join("crops", ", ").alias("crops"), "accepted", "reason", named.alias("top_terms"))


@query(f"WITH {S.stemmed('documents', 'doc_id', 'text')}, c AS (SELECT id, term, count(*) AS n FROM stems GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, term) AS k FROM c) SELECT id AS doc_id, k AS rank, term, n FROM r WHERE k <= 12")
def top_terms(spark, d):
    from pyspark.sql import Window

    from ..operators import lexical

    counted = lexical.postings(table(spark, d, "documents"))
    w = Window.partitionBy("id").orderBy(F.desc("tf"), "term")
    return counted.withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 12").select(F.col("id").alias("doc_id"), "rank", "term", F.col("tf").alias("n"))


@query(
    f"""WITH p AS ({_passages}), s AS (SELECT id, text, CASE WHEN length(text) < 600 THEN 'too_short' WHEN row_number() OVER (PARTITION BY sha256(text) ORDER BY id) > 1 THEN 'duplicate'
    WHEN len(regexp_extract_all(text, '[A-Za-z]+')) >= 20 AND len(list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda w: length(w) >= 3))::DOUBLE / len(regexp_extract_all(text, '[A-Za-z]+')) < 0.72 THEN 'garbled' ELSE 'accepted' END AS status FROM p)
    SELECT status, count(*) AS n FROM s GROUP BY status"""
)
def ingest_funnel(spark, d):
    p = passages(spark, d)
    first = p.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("id").alias("first"))
    rows = p.withColumn("h", F.sha2("text", 256)).join(first, "h")
    status = F.when(F.length("text") < 600, "too_short").when(F.col("id") != F.col("first"), "duplicate").when(quality.real_word_share(F.col("text")) < 0.72, "garbled").otherwise("accepted")
    return ingest.funnel(rows.withColumn("status", status))


@query("SELECT count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs, min(length(text)) AS min_chars, max(length(text)) AS max_chars, sum(length(text))::BIGINT AS total_chars FROM documents")
def chunk_stats(spark, d):
    return ingest.chunk_stats(table(spark, d, "documents"))


@query("SELECT count(*) AS n_chunks, 64 AS dim, 'float32' AS dtype, 'given' AS embedding_model, count(DISTINCT vec_id) AS n_documents FROM embeddings")
def index_meta(spark, d):
    return ingest.index_meta(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "given", 64)


@query("WITH a AS (SELECT unnest(list_filter([CASE WHEN contains(lower(text), 'th') THEN 'th' END, CASE WHEN contains(lower(text), 'ung') THEN 'ung' END, lang], lambda x: x IS NOT NULL)) AS area FROM documents) SELECT area, count(*) AS n FROM a GROUP BY area")
def area_counts(spark, d):
    docs = table(spark, d, "documents")
    areas = F.array_compact(F.array(*(F.when(F.contains(F.lower("text"), F.lit(x)), x) for x in ("th", "ung")), F.col("lang")))
    return ingest.area_counts(docs.select(areas.alias("areas")))


@query(
    f"""SELECT d.doc_id, coalesce(l.quality::VARCHAR, 'unknown') AS publisher, 'unknown' AS year, 'doc' AS title FROM documents d LEFT JOIN (SELECT doc_id, any_value(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)"""
)
def docs_with_provenance(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"))
    known = table(spark, d, "labels").groupBy("doc_id").agg(F.any_value("quality").alias("q"))
    manifest = known.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), F.col("q").cast("string").alias("publisher"), F.lit(None).cast("string").alias("year"), F.lit("doc").alias("title"))
    return ingest.with_provenance(docs, manifest).select("doc_id", "publisher", "year", F.lit("doc").alias("title"))


@query("SELECT lang AS name, count(*) AS n_pages FROM documents WHERE lang <> 'en' GROUP BY lang UNION ALL SELECT 'en', -1")
def manifest_upsert(spark, d):
    manifest = table(spark, d, "documents").groupBy(F.col("lang").alias("name")).agg(F.count(F.lit(1)).alias("n_pages"))
    entry = spark.createDataFrame([("en", -1)], "name string, n_pages long")
    return ingest.upsert(ingest.upsert(manifest, entry), entry)


@query("SELECT lang AS name, count(*) AS n_pages, 3 AS version FROM documents WHERE lang <> 'en' GROUP BY lang UNION ALL SELECT 'en', -1, 3")
def manifest_versions(spark, d):
    """The same as versions of a stored manifest: the table, then an entry, then that entry again."""
    manifest = table(spark, d, "documents").groupBy(F.col("lang").alias("name")).agg(F.count(F.lit(1)).alias("n_pages"))
    entry = spark.createDataFrame([("en", -1)], "name string, n_pages long")
    kept = snapshots.Snapshots(spark, f"{shared_dir(spark)}/manifest-{uuid.uuid4().hex}")
    kept.commit(manifest, 0)
    kept.update(lambda now: ingest.upsert(now, entry))
    version = kept.update(lambda now: ingest.upsert(now, entry))
    return kept.read().withColumn("version", F.lit(version))


@query("SELECT d.doc_id AS filename, CASE WHEN d.doc_id % 3 = 0 THEN 'MISSING' WHEN d.doc_id % 3 = 1 THEN 'MISMATCH' ELSE 'ok' END AS status FROM documents d")
def verify_hashes(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("filename"), F.coalesce("text", F.lit("")).alias("text"))
    manifest = docs.select("filename", F.sha2("text", 256).alias("sha256"))
    on_disk = docs.filter("filename % 3 <> 0").select("filename", F.encode(F.when(F.col("filename") % 3 == 1, F.concat(F.lit("x"), F.col("text"))).otherwise(F.col("text")), "UTF-8").alias("content"))
    return ingest.verify(manifest, on_disk)


@query(
    f"""WITH l AS (SELECT vec_id, CASE label % 3 WHEN 0 THEN 'CC BY-ND 4.0' WHEN 1 THEN 'All rights reserved' ELSE 'CC BY 4.0' END AS licence FROM embeddings)
    SELECT vec_id, licence FROM l WHERE NOT {S.rx('licence', X.NO_DERIVATIVES)} AND NOT {S.rx('licence', X.PROPRIETARY)}"""
)
def index_load_licence(spark, d):
    licence = F.when(F.col("label") % 3 == 0, "CC BY-ND 4.0").when(F.col("label") % 3 == 1, "All rights reserved").otherwise("CC BY 4.0")
    return files.served(table(spark, d, "embeddings").withColumn("licence", licence)).select("vec_id", "licence")


@query(
    r"""SELECT doc_id, source || CASE WHEN doc_id % 4 = 0 THEN '' ELSE ' (' || (2000 + doc_id % 4) || ')' END || ', ' || coalesce(lang, '') || ', ' || CASE WHEN doc_id % 2 = 0 THEN 'p. 3' ELSE 'pp. 3-5' END AS citation FROM documents"""
)
def citations(spark, d):
    i = F.col("doc_id")
    year = F.when(i % 4 == 0, F.lit("unknown")).otherwise((2000 + i % 4).cast("string"))
    return table(spark, d, "documents").select("doc_id", text.citation(F.col("source"), year, F.coalesce("lang", F.lit("")), F.lit(3), F.when(i % 2 == 0, 3).otherwise(5)).alias("citation"))


@query(r"SELECT doc_id, md5(regexp_extract(left(coalesce(text, ''), 600), '\(([A-Z][a-z]+ [a-z]{3,})\)', 1)) AS name_digest FROM documents")
def specific_title(spark, d):
    t = text.specific_title(F.lit(""), F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", F.md5(F.regexp_extract(t, r"^ \((.*)\)$", 1)).alias("name_digest"))


@query()
def chunk_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("title"), F.array(F.coalesce("text", F.lit(""))).alias("pages"), F.lit("given").alias("publisher"), F.lit("unknown").alias("year"), F.lit("unspecified").alias("licence"), F.lit("").alias("source_url"))
    return chunk.chunks(docs)


@query()
def chunk_pages_table(spark, d):
    """The same by the SQL table function, from a row a document."""
    tables.register(spark)
    table(spark, d, "documents").createOrReplaceTempView("chunk_pages_given")
    return spark.sql("""SELECT * FROM chunk_pages(TABLE(SELECT doc_id, source AS title, array(coalesce(text, '')) AS pages, 'given' AS publisher, 'unknown' AS year, 'unspecified' AS licence, '' AS source_url FROM chunk_pages_given))""")
