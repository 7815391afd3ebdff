"""Pieces of the DuckDB twins: written for DuckDB, not derived from the Spark plans."""

from __future__ import annotations

from ..functions import fixed as X
from .fixtures import sql_string as q


def rx(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {q(pattern)})"


def rx_count(expr: str, pattern: str) -> str:
    return f"len(regexp_extract_all({expr}, {q(pattern)}))"


def listed(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def tokens(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), {q(X.TOKEN)}), lambda t: t NOT IN {listed(dict.fromkeys(X.STOPWORDS))})"


def stemmed(source: str, id: str, text: str, name: str = "stems") -> str:
    """CTEs ending in ``name``(id, pos, token, term)."""
    cuts = " ".join(f"WHEN ends_with(token, {q(s)}) AND length(token) - {len(s)} >= 4 THEN left(token, length(token) - {len(s)})" for s in X.SUFFIXES)
    return f"""
        {name}_l AS (SELECT {id} AS id, {tokens(text)} AS l FROM {source}),
        {name}_t AS (SELECT id, unnest(l) AS token, generate_subscripts(l, 1) - 1 AS pos FROM {name}_l),
        {name}_c AS (SELECT *, CASE {cuts} ELSE token END AS base FROM {name}_t),
        {name} AS (SELECT id, pos, token, CASE WHEN base <> token AND length(base) > 4 AND right(base, 1) = substr(base, length(base) - 1, 1)
            AND right(base, 1) NOT IN ('a', 'e', 'i', 'o', 'u') THEN left(base, length(base) - 1) ELSE base END AS term FROM {name}_c)"""


def bm25(passages: str, pid: str, queries: str, qid: str, k: int = 20) -> str:
    """CTEs ending in bm25(query_id, id, score, rank)."""
    return f"""
        {stemmed(passages, pid, "text", "p")}, {stemmed(queries, qid, "text", "a")},
        dl AS (SELECT id, len(l) AS dl FROM p_l), st AS (SELECT count(*) AS n, avg(dl) AS avg_len FROM dl),
        tf AS (SELECT id, term, count(*) AS tf FROM p GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        asked AS (SELECT id AS query_id, term, count(*) AS times, min(pos) AS pos FROM a GROUP BY ALL),
        summed AS (SELECT query_id, tf.id, min(pos) AS pos, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_len))) AS score
            FROM asked JOIN tf USING (term) JOIN df USING (term) JOIN dl ON dl.id = tf.id CROSS JOIN st GROUP BY ALL),
        bm25_all AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pos, id) AS rank FROM summed),
        bm25 AS (SELECT * FROM bm25_all WHERE rank <= {k})"""


def shingled(source: str, id: str) -> str:
    """CTEs ending in sh(id, s): distinct runs of five words."""
    return f"""
        sw AS (SELECT {id} AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\pL\\pN_]+'), lambda x: x <> '') AS w FROM {source}),
        sh AS (SELECT DISTINCT id, s FROM (SELECT id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM sw))"""


def scope_reason(e: str) -> str:
    """The ordered refusal rules for an English or Pidgin question."""
    words = lambda ws: r"\b(?:" + "|".join(ws) + r")\b"
    low = f"lower({e})"
    own = " ".join(f"WHEN {rx(low, chr(92) + 'b(?:my|our)' + chr(92) + 's+' + t + chr(92) + 'b')} THEN {q(n)}" for t, n in X.OUT_OF_SCOPE_CROPS.items())
    named = " ".join(f"WHEN {rx(low, chr(92) + 'b' + t + chr(92) + 'b')} THEN {q(n)}" for t, n in X.OUT_OF_SCOPE_CROPS.items())
    covered = rx(low, words([f"{c}(?:e?s)?" for c in X.IN_SCOPE_CROPS]))
    crop = f"coalesce(CASE {own} END, CASE WHEN {covered} THEN NULL {named} END)"
    first = lambda p: f"nullif(lower(regexp_extract({e}, {q(p)})), '')"
    place = f"CASE WHEN NOT {rx(e, X.HERE)} THEN coalesce({first(X.ELSEWHERE)}, {first(X.WRONG_CLIMATE)}) END"
    harms = (("HARM_TO_OTHERS", "harm to others"), ("DECEIVE_BUYER", "deceiving a buyer"), ("ADULTERATE", "adulteration"), ("EVADE_PROHIBITION", "evading a prohibition"))
    harm = " ".join(f"WHEN {rx(e, getattr(X, n))} THEN 'harmful request: {k}'" for n, k in harms)
    return f"""CASE WHEN {rx(e, X.HUMAN_MEDICAL_PERSON)} OR ({rx(e, X.HUMAN_MEDICAL_SYMPTOM)} AND NOT {rx(low, words(X.POSITIVE_GROUPS["livestock"]))}) THEN 'human medical'
        {harm} WHEN {rx(e, X.LIVE_PRICE)} AND NOT {rx(e, X.PRICE_METHOD)} THEN 'live price'
        WHEN {rx(e, X.DOSAGE_QUESTION)} AND {rx(e, X.SUBSTANCE)} THEN 'dosage' WHEN {rx(e, X.LIVE_FORECAST)} THEN 'live forecast'
        WHEN {rx(e, X.FINANCIAL_LEGAL)} THEN 'financial or legal' WHEN {rx(e, X.MACHINE)} AND {rx(e, X.MECHANICAL_FAULT)} THEN 'mechanical repair'
        WHEN {crop} IS NOT NULL THEN 'out-of-scope crop: ' || {crop} WHEN {rx(e, X.LIFE_DECISION)} THEN 'personal decision'
        WHEN {place} IS NOT NULL THEN 'outside the service area: ' || {place} WHEN {rx(e, X.NEVER_IN_DOMAIN)} OR NOT {rx(e, X.IN_DOMAIN)} THEN 'out of domain' END"""
