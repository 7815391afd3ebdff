"""DuckDB twins of the rules on questions, answers and texts.

Written for DuckDB, whose patterns know no look-around: where a rule has one, the twin marks or
filters matches instead. That is the same on texts in which such matches do not overlap.
"""

from __future__ import annotations

import re

from ..functions import fixed as X
from ..functions.language import _ACCENTED, _BASE, _COMPOSED
from ..functions.scope import _KEYS, _PREFIXES
from .fixtures import sql_string as q
from .sql import listed, rx, rx_count, scope_reason

BREAK = "chr(1)"


def stripped(e: str) -> str:
    return rf"regexp_replace({e}, '^\s+|\s+$', '', 'g')"


def once(e: str) -> str:
    """A list without repeats, in order."""
    return f"list_filter({e}, lambda x, i: list_position({e}, x) = i)"


def some(cases: list[tuple[str, str]]) -> str:
    """The names whose condition holds, in order."""
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {q(n)} END" for c, n in cases) + "], lambda x: x IS NOT NULL)"


def lowered(e: str) -> str:
    out = f"lower({e})"
    for a, b in _COMPOSED:
        out = f"replace({out}, {q(a)}, {q(b)})"
    return out


def letters(low: str, chars) -> str:
    return f"(length({low}) - length(translate({low}, {q(''.join(chars))}, '')))"


def among(words: str, known) -> str:
    return f"len(list_intersect({words}, [{', '.join(map(q, dict.fromkeys(known)))}]))"


def languages(source: str, e: str = "q") -> str:
    """CTEs ending in spoken(*, low, found, strong, weak, language)."""
    gone = re.search(r"\(\?!(.*?)\)\[", X.GO_FUTURE)[1].replace(r"\b", "").split("|")
    future = rf"len(list_filter(regexp_extract_all(low, '\bi go\s+([a-z]+)\b', 1), lambda w: length(w) > 1 AND w NOT IN {listed(gone)})) > 0"
    phrases = " OR ".join([rx("low", rf"\b(?:{'|'.join(X.PIDGIN_PHRASES)})\b"), rx("low", X.FIT_MODAL), rx("low", X.DON_PERFECT), future])
    weak = " + ".join([among("found", X.PIDGIN_WEAK)])
    more = " + ".join(f"contains(low, {q(p)})::INT" for p in X.PIDGIN_WEAK_PHRASES)
    return f"""lw AS (SELECT *, {lowered(e)} AS low FROM {source}), lf AS (SELECT *, list_distinct(regexp_extract_all(low, '[a-z]+')) AS found FROM lw),
        lc AS (SELECT *, {letters('low', X.YORUBA_CHARS)} AS y, {letters('low', X.IGBO_CHARS)} AS g, {letters('low', X.SHARED_CHARS)} AS sh, {among('found', X.PIDGIN_STRONG)} AS strong, {weak} AS weak, {more} AS weak_phrases FROM lf),
        spoken AS (SELECT *, CASE WHEN {letters('low', X.HAUSA_CHARS)} > 0 THEN 'hau' WHEN y > 0 AND g = 0 THEN 'yor' WHEN g > 0 AND y = 0 THEN 'ibo'
            WHEN y + g + sh >= 2 AND y > g THEN 'yor' WHEN y + g + sh >= 2 AND g > y THEN 'ibo' WHEN y + g + sh >= 2 AND sh >= 2 THEN 'yor' WHEN len(found) = 0 THEN 'en'
            WHEN {among('found', X.PIDGIN_UNAMBIGUOUS)} > 0 OR {phrases} OR strong >= 2 OR (strong >= 1 AND weak + weak_phrases >= 2) THEN 'pcm'
            WHEN {among('found', X.YORUBA_WORDS)} >= 2 THEN 'yor' WHEN {among('found', X.IGBO_WORDS)} >= 2 THEN 'ibo'
            WHEN {among('found', X.HAUSA_UNAMBIGUOUS)} >= 1 OR {among('found', X.HAUSA_WORDS)} >= 2 THEN 'hau' ELSE 'en' END AS language FROM lc)"""


def confidence() -> str:
    by = lambda code, chars: f"WHEN language = '{code}' THEN CASE WHEN {letters('low', chars)} > 0 THEN 0.95::DOUBLE ELSE 0.75::DOUBLE END"
    pidgin = "least(1.0::DOUBLE, strong * 0.4::DOUBLE + weak * 0.15::DOUBLE)"
    return f"CASE {by('yor', X.YORUBA_CHARS)} {by('ibo', X.IGBO_CHARS)} {by('hau', X.HAUSA_CHARS)} WHEN len(found) = 0 THEN 1.0::DOUBLE WHEN language = 'pcm' THEN {pidgin} ELSE 1.0::DOUBLE - {pidgin} END"


def looks_pidgin(e: str) -> str:
    return rx(e, X.PIDGIN_MARKERS)


def pidgin_normalised(e: str) -> str:
    out = e
    for pattern, new in X.PIDGIN_RULES:
        new = re.sub(r"\$(\d)", r"\\\1", new)
        if pattern.startswith("(?<!"):  # "i am" is hidden from the rule on "am"
            out = rf"regexp_replace(regexp_replace(regexp_replace({out}, '(?i)(\bi )(am\b)', '\1_\2', 'g'), '(?i)\bam\b', {q(new)}, 'g'), '(?i)(\bi )_(am\b)', '\1\2', 'g')"
        elif "(?=" in pattern:
            out = rf"regexp_replace({out}, {q('(?i)' + pattern.replace('(?=', '('))}, {q(new + chr(92) + '1')}, 'g')"
        else:
            out = f"regexp_replace({out}, {q('(?i)' + pattern)}, {q(new)}, 'g')"
    squeezed = rf"regexp_replace({out}, '\s+', ' ', 'g')"
    return f"CASE WHEN {looks_pidgin(e)} THEN {stripped(squeezed)} ELSE {e} END"


def farm_terms() -> str:
    """Of spoken(q, low, language): the question with the English of its terms."""
    folded = rf"translate(regexp_replace(low, '\p{{Mn}}', '', 'g'), {q(_ACCENTED)}, {q(_BASE)})"
    ordered = sorted(X.FARM_TERMS.items(), key=lambda kv: -len(kv[0]))
    found = some([(rx("folded", rf"\b{t}\b"), n) for t, n in ordered])
    return f"SELECT id, CASE WHEN language IN ('yor', 'ibo', 'hau') AND len(names) > 0 THEN q || ' ' || array_to_string({once('names')}, ' ') ELSE q END AS expanded FROM (SELECT *, {found} AS names FROM (SELECT *, {folded} AS folded FROM spoken))"


def retrieval_query(source: str) -> str:
    ask = re.search(r"\(\?=(and.*)\)$", X.CLAUSE)[1]
    cut = rf"regexp_replace(regexp_replace(bare, '([.!?])\s+', '\1' || {BREAK}, 'g'), ',\s+(' || {q(ask)} || ')', {BREAK} || '\1', 'g')"
    kept = f"list_filter(string_split({cut}, {BREAK}), lambda c: {stripped('c')} <> '' AND NOT {rx('c', X.INSTRUCTION)})"
    joined = stripped(f"array_to_string(list_transform({kept}, lambda c: {stripped('c')}), ' ')")
    return f"SELECT id, CASE WHEN length(short) < 15 THEN whole ELSE short END AS search_text FROM (SELECT *, {joined} AS short FROM (SELECT *, regexp_replace(whole, {q(X.REPORTED_SPEECH)}, '') AS bare FROM (SELECT id, {stripped('q')} AS whole FROM {source})))"


def sign_names(e: str) -> str:
    return some([(rx(e, f"(?i){p}"), n) for p, n in X.SIGN_TO_NAME])


def symptoms(e: str) -> str:
    return f"list_has_any(regexp_extract_all(lower({e}), '[a-z]+'), [{', '.join(map(q, X.SYMPTOM_WORDS))}])"


def diagnostic_intent(source: str) -> str:
    named = f"CASE WHEN len(names) > 0 THEN q || ' ' || array_to_string({once('names')}, ' ') ELSE q END || ' ' || {q(X.DIAGNOSTIC_INTENT)}"
    return f"SELECT id, CASE WHEN {symptoms('q')} THEN {named} ELSE q END AS search_text FROM (SELECT *, {sign_names('q')} AS names FROM {source})"


def message(key: str, language: str = "language") -> str:
    return "coalesce(CASE " + " ".join(f"WHEN {language} = {q(code)} THEN {q(t[key])}" for code, t in X.MESSAGES.items() if key in t) + f" END, {q(X.MESSAGES['en'].get(key))})"


def refusal_text() -> str:
    prefixes = " ".join(f"WHEN starts_with(reason, {q(p)}) THEN coalesce({message(k)}, {q(d)})" for p, (k, d) in _PREFIXES.items())
    keys = " ".join(f"WHEN reason = {q(n)} THEN coalesce({message(k)}, {q(d)})" for n, (k, d) in _KEYS.items())
    return f"CASE WHEN reason IS NULL THEN NULL {keys} {prefixes} ELSE {message('no_guidance')} END"


def scope_messages(source: str) -> str:
    reason = f"(SELECT CASE WHEN r = 'out of domain' AND language NOT IN ('en', 'pcm') THEN NULL ELSE r END FROM (SELECT {scope_reason('norm')} AS r))"
    return f"WITH {languages(source)}, n AS (SELECT *, {pidgin_normalised('q')} AS norm FROM spoken), r AS (SELECT *, {reason} AS reason FROM n) SELECT id, language, reason, {refusal_text()} AS answer FROM r"


def doses(e: str) -> str:
    """Doses by the patterns in order, once each but for case and white space."""
    found = []
    for p in X.DOSAGE_PATTERNS:
        if "(?!" in p:  # an excluded unit behind a dose is matched, and the match let go
            i = p.index("(?!")
            whole = p[:i].replace("(?<dose>", "(") + "(" + p[i + 3 :] + "?"
            found.append(f"list_transform(list_filter(list_zip(regexp_extract_all({e}, {q(whole)}, 1), regexp_extract_all({e}, {q(whole)}, 2)), lambda z: coalesce(z[2], '') = ''), lambda z: trim(z[1]))")
        else:
            found.append(f"list_transform(regexp_extract_all({e}, {q(p)}), lambda d: trim(d))")
    every = f"list_concat({', '.join(found)})"
    key = rf"list_transform({every}, lambda d: regexp_replace(lower(d), '\s+', ' ', 'g'))"
    return f"list_filter({every}, lambda d, i: list_position({key}, ({key})[i]) = i)"


def squeezed(e: str) -> str:
    return rf"regexp_replace(lower({e}), '[\s,]+', '', 'g')"


def lacking(found: str, sources: str) -> str:
    return f"list_filter({found}, lambda d: NOT contains({squeezed(q(sources))}, {squeezed('d')}))"


def replaced(e: str, parts: str, by: str) -> str:
    return f"list_reduce(list_prepend({e}, {parts}), lambda t, p: replace(t, p, {q(by)}))"


def _money() -> str:
    end = X.MONEY.index(r"(?!\w)")
    mark = X.MONEY.rindex("[$£€₦]|", 0, end) + len("[$£€₦]")
    return X.MONEY[:mark] + r"\B" + X.MONEY[mark : end - 1] + r"\b)" + X.MONEY[end + len(r"(?!\w)") :]


MONEY = _money()


def without_money(e: str) -> str:
    return replaced(e, f"regexp_extract_all({e}, {q(MONEY)})", X.MONEY_REDACTION)


def foreign_money(e: str) -> str:
    """Foreign currencies as words or before a number, with a digit within 14 characters on either side."""
    words = re.search(r"KES\|.*?\(\?!\[A-Za-z\]\)$", X.FOREIGN_MONEY)[0].removesuffix(")(?![A-Za-z])")
    rule = rf"(?i)(?:^|[^A-Za-z])((?:{words})(?:[^A-Za-z]|$)|(?:[$£€]|[KUT]?\.?Sh(?:s|illing)?\.?)\s*\d)"
    hits = f"list_transform(regexp_extract_all({e}, {q(rule)}, 1), lambda m: trim(regexp_replace(m, '[^A-Za-z$£€.]+$', '')))"
    trimmed = f"list_transform({hits}, lambda m: regexp_replace(m, '(?i)^({words})[^A-Za-z]$', '\\1'))"
    near = rf"lambda m: regexp_matches({e}, '(?i)[0-9].{{0,13}}' || regexp_escape(m)) OR regexp_matches({e}, '(?i)' || regexp_escape(m) || '.{{0,13}}[0-9]')"
    return f"list_sort(list_distinct(list_filter({trimmed}, {near})))"


def sentence_list(e: str, end: str = r"([.!?])\s+") -> str:
    return rf"string_split(regexp_replace({e}, '{end}', '\1' || {BREAK}, 'g'), {BREAK})"


def named(e: str, terms) -> str:
    return some([(rx(f"lower({e})", r"\b" + t.replace("-", r"\-") + r"\b"), t) for t in sorted(set(terms))])


def verdict(source: str, sources: list[str], years: list[str], now: int) -> str:
    """CTEs ending in judged(id, a, safe and the findings); ``years``: all of them stale or unknown."""
    joined = "\n".join(sources)
    old = all(not re.fullmatch(r"\d{1,4}", y[:4].strip()) or now - int(y[:4]) > 10 for y in years)
    stale = f"CASE WHEN {rx('a', X.CHEMICAL_CONTEXT)} THEN [{', '.join(map(q, sorted(set(years))))}] ELSE [] END" if old else "[]::VARCHAR[]"
    reuse = f"len(list_filter({sentence_list('a')}, lambda s: {rx('s', X.REUSE_CONTAINER)} AND NOT {rx('s', X.NEGATED)})) > 0"
    withdrawal = f"({rx('a', X.VETERINARY_TREATMENT)} OR {rx('q', X.WITHDRAWAL_QUESTION)}) AND NOT {rx('a', X.WITHDRAWAL_MENTIONED)}"
    both = f"(a || chr(10) || {q(joined)})"
    return f"""vd AS (SELECT *, {doses('a')} AS said FROM {source}), vf AS (SELECT id, a, q, CASE WHEN len({named('a', X.HAZARDOUS_ACTIVES)}) > 0 THEN {named('a', X.HAZARDOUS_ACTIVES)} ELSE {named(q(joined), X.HAZARDOUS_ACTIVES)} END AS hazardous,
        {lacking('said', joined)} AS unsupported_doses, {stale} AS stale_sources, {named(both, X.RESTRICTED_VETERINARY)} AS restricted_veterinary, {withdrawal} AS missing_withdrawal, {reuse} AS container_reuse, {foreign_money('a')} AS foreign_money FROM vd),
        judged AS (SELECT *, len(hazardous) = 0 AND len(unsupported_doses) = 0 AND len(stale_sources) = 0 AND len(restricted_veterinary) = 0 AND len(foreign_money) = 0 AND NOT missing_withdrawal AND NOT container_reuse AS safe FROM vf)"""


def notice() -> str:
    """Of judged(..., language): the lines that a verdict adds."""
    names = lambda k: f"array_to_string(list_sort({k}), ', ')"
    when = lambda k, text: f"CASE WHEN len({k}) > 0 THEN {text} END"
    vet = f"'Some sources mention veterinary medicines that are banned or restricted in food-producing animals (' || {names('restricted_veterinary')} || '). Do not use them. Ask a veterinary officer.'"
    money = f"'Some figures above are in a currency from another country (' || {names('foreign_money')} || '). They are not Nigerian prices and should not be used to decide what to sell for. Ask at your local market.'"
    lines = [
        when("hazardous", f"{message('hazardous_pesticide')} || ' (' || {names('hazardous')} || ')'"), when("unsupported_doses", message("unsupported_dosage")),
        when("stale_sources", f"{message('stale_chemical')} || ' (' || {names('stale_sources')} || ')'"), when("restricted_veterinary", vet), when("foreign_money", money),
        f"CASE WHEN container_reuse THEN {q(X.CONTAINER_REUSE_WARNING)} END", f"CASE WHEN missing_withdrawal THEN {message('withdrawal_period')} END",
    ]
    return f"array_to_string(list_filter([{', '.join(lines)}], lambda x: x IS NOT NULL), chr(10) || chr(10))"


def prompt(source: str, texts: list[str]) -> str:
    from ..operators.answer import NO_CLOCK, SYSTEM

    parts = "\n\n".join(f"{' '.join(t.split())} (A title, 2001) [{i}]" for i, t in enumerate(texts, 1))
    return f"SELECT id, md5({q(SYSTEM)} || CASE WHEN {rx('q', X.TIME_DEPENDENT)} THEN {q(NO_CLOCK)} ELSE '' END) AS system, md5({q('Sources:' + chr(10) * 2 + parts + chr(10) * 2)} || 'Farmer''s question: ' || q) AS user FROM {source}"


def content_words(e: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({e}), '[a-z]+'), lambda w: length(w) > 2 AND w NOT IN {listed(X.ECHO_STOPWORDS)}))"


def without_echo(source: str) -> str:
    own = content_words("s")
    n = f"len(list_intersect({own}, asked))"
    stays = f"len({own}) = 0 OR NOT {rx('s', X.IMPERATIVE)} OR {n}::DOUBLE / len(asked) < 0.8 OR {n}::DOUBLE / greatest(len({own}), 1) < 0.6"
    joined = stripped(f"array_to_string(list_filter(kept, lambda s: {stripped('s')} <> ''), ' ')")
    return f"""WITH e AS (SELECT id, a, {content_words('q')} AS asked, {sentence_list('a')} AS ss FROM {source}), k AS (SELECT *, list_filter(ss, lambda s: {stays}) AS kept FROM e)
        SELECT id, CASE WHEN len(asked) = 0 OR len(kept) = len(ss) OR {joined} = '' THEN a ELSE {joined} END AS answer FROM k"""


def sentences(source: str) -> str:
    """A row a sentence; short ones go with the one before."""
    return rf"""WITH s AS (SELECT id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+([A-Z(])', '\1' || {BREAK} || '\2', 'g'), {BREAK}), lambda x: {stripped('x')}), lambda x: x <> '') AS l FROM ({source})),
        r AS (SELECT id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM s), g AS (SELECT *, sum((i = 1 OR len(list_filter(string_split_regex(x, '\s+'), lambda w: w <> '')) > 3)::INT) OVER (PARTITION BY id ORDER BY i) AS k FROM r)
        SELECT id, (k - 1)::INT AS pos, string_agg(x, ' ' ORDER BY i) AS sentence FROM g GROUP BY id, k"""


def strip_boilerplate(source: str) -> str:
    clean = "text"
    for pattern, new in ((X.BBCODE, ""), (X.LITERAL_TAG, ""), (" ", " "), (X.LITERAL_ESCAPE, " ")):
        clean = f"regexp_replace({clean}, {q(pattern)}, {q(new)}, 'g')"
    line = "x"
    for label in X.FIELD_NAMES:
        line = rf"(SELECT CASE WHEN starts_with(lower(y), {q(label)}) THEN regexp_replace(substr(y, {len(label) + 1}), '^[ .:\-]+|[ .:\-]+$', '', 'g') ELSE y END FROM (SELECT {line} AS y))"
    tail = " OR ".join(f"starts_with(lower(x), {q(m)})" for m in X.TAIL_MARKERS)
    key = r"CASE WHEN length(x) < 80 THEN '#' || i ELSE '=' || left(regexp_replace(lower(x), '[^\pL\pN\pM_]+', '', 'g'), 200) END"
    return rf"""WITH t AS (SELECT id, {clean} AS text FROM ({source})), l AS (SELECT id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {stripped('x')}), lambda x: lower(x) NOT IN {listed(X.BOILERPLATE_LINES)}) AS l FROM t),
        r AS (SELECT id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM l), u AS (SELECT id, i, {line} AS x FROM r), f AS (SELECT id, i, x, {tail} AS tail FROM u WHERE x <> ''),
        b AS (SELECT f.* FROM f LEFT JOIN (SELECT id, min(i) AS stop FROM f WHERE tail GROUP BY id) s USING (id) WHERE i < coalesce(stop, 2147483647) AND NOT {rx('x', X.CREDIT_LINE)}),
        k AS (SELECT *, row_number() OVER (PARTITION BY id, {key} ORDER BY i) AS nth FROM b) SELECT t.id, coalesce(string_agg(x, chr(10) ORDER BY i), '') AS text FROM t LEFT JOIN (SELECT * FROM k WHERE nth = 1) k USING (id) GROUP BY t.id"""


def strip_furniture(source: str) -> str:
    """For an empty title; captions end at a full stop or line's end here."""
    caption = X.CAPTION.replace(r"(?:(?!\s\d{1,4}\s)[^.\n]){0,80}", r"[^.\n]{0,80}")
    number = r"regexp_replace(regexp_replace({}, '([.\n])\s*\d{{1,4}}\s*([A-Z\n])', '\1 \2', 'g'), '^\s*\d{{1,4}}\s*([A-Z\n])|([.\n])\s*\d{{1,4}}\s*$|^\s*\d{{1,4}}\s*$', '\2 \1', 'g')"
    out = f"regexp_replace(regexp_replace(text, {q(caption)}, ' ', 'g'), {q(X.WEB_FURNITURE)}, ' ', 'g')"
    squeezed_ = rf"regexp_replace({number.format(out)}, '\s{{2,}}', ' ', 'g')"
    return f"SELECT id, {stripped(squeezed_)} AS text FROM ({source})"


def crops(e: str) -> str:
    return some([(rx(f"lower({e})", rf"\b{c}(?:e?s)?\b"), c) for c in X.IN_SCOPE_CROPS])


def other_crops(e: str) -> str:
    return some([(rx(f"lower({e})", rf"\b{c}\b"), c) for c in X.OTHER_CROP_TERMS])


def usable(text: str) -> str:
    """A passage that no quality gate takes."""
    front = f"{rx_count(f'left({text}, 600)', X.FRONT_MATTER)} + {rx_count(f'left({text}, 600)', X.COPYRIGHT)}"
    run = f"list_max(list_transform(string_split_regex(array_to_string(regexp_extract_all({text}, '[.!?]'), ''), '[.!]'), lambda x: length(x)))"
    form = f"({rx_count(text, X.BLANK_RUN)} >= 3 OR ({rx(text, X.FORM_NUMBERING)} AND {rx(text, X.BLANK_RUN)}))"
    check = rf"(len(list_filter(string_split_regex({text}, '[.!?]+\s+'), lambda s: trim(s) <> '')) >= 4 AND {run} >= 3 AND ({run} >= 5 OR {rx_count(text, X.SELF_ASSESSMENT)} >= 2))"
    n, k = f"len(regexp_extract_all({text}, '[A-Za-z]+'))", f"len(list_filter(regexp_extract_all({text}, '[A-Za-z]+'), lambda w: length(w) >= 3))"
    return f"NOT ({front} > 2 OR ({n} >= 20 AND {k}::DOUBLE / {n} < 0.72) OR {form} OR {check})"


def embedded(stems: str, name: str, dim: int = 256) -> str:
    """CTEs ending in ``name``(id, place, x): unit vectors of hashed stems, without zeros; ``stems``: a CTE of id, term."""
    return f"""{name}_w AS (SELECT id, ('0x' || left(md5(term), 8))::BIGINT % {dim} AS place, sum(1 + ln(tf)) AS w FROM (SELECT id, term, count(*) AS tf FROM {stems} GROUP BY ALL) GROUP BY ALL),
        {name}_n AS (SELECT id, sqrt(sum(w * w)) AS norm FROM {name}_w GROUP BY id), {name} AS (SELECT id, place, w / norm AS x FROM {name}_w JOIN {name}_n USING (id))"""


def hybrid(bm25: str, min_score: float, top_k: int = 6) -> str:
    """The whole search; ``bm25``: CTEs with p (passages' stems), a (queries' stems) and bm25; passages are documents, titled by source."""
    body = "(title || ' ' || text)"
    words = rf"len(list_filter(string_split_regex({body}, '\s+'), lambda w: w <> ''))"
    return f"""WITH {bm25}, {embedded('p', 'pv')}, {embedded('a', 'av')}, cos AS (SELECT av.id AS query_id, pv.id, sum(av.x * pv.x) AS score FROM av JOIN pv USING (place) GROUP BY ALL),
        every AS (SELECT item_id AS query_id, doc_id AS id, coalesce(score, 0) AS score FROM benchmark CROSS JOIN documents LEFT JOIN cos ON cos.query_id = item_id AND cos.id = doc_id),
        near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM every) WHERE rank <= 20),
        u AS (SELECT query_id, id, rank AS d, NULL AS l FROM near UNION ALL SELECT query_id, id, NULL, rank FROM bm25), e AS (SELECT query_id, id, min(d) AS d, min(l) AS l FROM u GROUP BY ALL),
        s AS (SELECT *, coalesce(1.0::DOUBLE / (60 + d), 0) + coalesce(1.0::DOUBLE / (60 + l), 0) AS rrf, least(CASE WHEN l <= 2 THEN 2 * (l - 1) END, CASE WHEN d <= 2 THEN 2 * (d - 1) + 1 END) AS place FROM e),
        f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(place, 4), round(rrf, 12) DESC, coalesce(d, 20 + l)) - 1 AS fused_rank FROM s),
        x AS (SELECT f.query_id, f.id, f.fused_rank, f.l, every.score, coalesce(b.text, '') AS query, coalesce(t.source, '') AS title, coalesce(t.text, '') AS text FROM f JOIN every USING (query_id, id) JOIN benchmark b ON b.item_id = f.query_id JOIN documents t ON t.doc_id = f.id WHERE fused_rank < 18),
        y AS (SELECT *, {crops('query')} AS wanted, list_concat({crops(body)}, {other_crops(body)}) AS named, {sign_names('query')} AS signs, {other_crops('title')} AS titled, {rx_count(body, X.POSTHARVEST_TERMS)} AS n_post FROM x),
        z AS (SELECT *, len(wanted) > 0 AND CASE WHEN len(named) > 0 THEN NOT list_has_any(named, wanted) ELSE len(titled) > 0 END AS offcrop, len(signs) > 0 AND len(list_filter(signs, lambda n: contains(lower({body}), n))) = 0 AS not_named,
            {rx(body, X.RESEARCH_REGISTER)} AS research, {rx('query', X.FIELD_CONTEXT)} AND NOT {rx('query', X.STORE_CONTEXT)} AND n_post >= 3 AND 1000.0 * n_post / greatest({words}, 1) >= 25 AS postharvest FROM y),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY postharvest, research, not_named, offcrop, fused_rank) - 1 AS place FROM z),
        h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS hit FROM r WHERE score >= CASE WHEN l <= 2 THEN {min_score} - 0.08 ELSE {min_score} END AND {usable('text')})
        SELECT query_id, id, hit, place, fused_rank, round(score, 6) AS score FROM h WHERE hit <= {top_k}"""


def rerank(questions: list[str], sources: list[str]) -> str:
    """Every benchmark item behind one of ``questions``, against each of ``sources`` with the item's own text."""
    body = "(' ' || text)"
    asked = f"([{', '.join(map(q, questions))}])[item_id % {len(questions)} + 1] || ' ' || coalesce(text, '')"
    given = ", ".join(f"({i}, {q(x)})" for i, x in enumerate(sources))
    words = rf"len(list_filter(string_split_regex({body}, '\s+'), lambda w: w <> ''))"
    return f"""WITH a AS (SELECT query_id, query, {crops('query')} AS wanted, {sign_names('query')} AS signs, {rx('query', X.FIELD_CONTEXT)} AND NOT {rx('query', X.STORE_CONTEXT)} AS field FROM (SELECT item_id AS query_id, {asked} AS query FROM benchmark)),
        s AS (SELECT query_id, id, text, list_concat({crops(body)}, {other_crops(body)}) AS crops, {rx(body, X.RESEARCH_REGISTER)} AS research, {rx_count(body, X.POSTHARVEST_TERMS)} AS n_post, {words} AS n FROM (SELECT item_id AS query_id, id, source || ' ' || coalesce(text, '') AS text FROM benchmark, (VALUES {given}) v(id, source))),
        f AS (SELECT query_id, id, len(wanted) > 0 AND len(crops) > 0 AND NOT list_has_any(crops, wanted) AS offcrop, len(signs) > 0 AND len(list_filter(signs, lambda x: contains(lower({body}), x))) = 0 AS not_named, research,
            field AND n_post >= 3 AND 1000.0 * n_post / greatest(n, 1) >= 25 AS postharvest FROM a JOIN s USING (query_id))
        SELECT query_id, id, (row_number() OVER (PARTITION BY query_id ORDER BY postharvest, research, not_named, offcrop, id) - 1)::INT AS place, offcrop, not_named, research, postharvest FROM f"""


def guarded(source: str, sources: str) -> str:
    """An answer's text as a whole: without the first run of citations, money, and doses that the sources lack."""
    cut = rf"regexp_replace(regexp_replace(a, {q(X.CITATION_RUN)}, ''), '^\s+', '')"
    return f"""WITH h AS (SELECT id, a, coalesce(nullif({cut}, ''), a) AS t FROM {source}), m AS (SELECT id, a, t, {lacking(doses('t'), sources)} AS gone FROM h)
        SELECT id AS answer_id, CASE WHEN NOT regexp_matches(a, '\\pL') THEN {q(X.NO_GUIDANCE_MESSAGE)} ELSE {replaced(without_money('t'), 'gone', X.DOSE_GONE)} END AS text FROM m"""


def near_keep(pairs: str) -> str:
    """``pairs``: CTEs ending in near(a, b); then kept(id): in order of id, whoever has no earlier neighbour that stays."""
    return f"""{pairs}, nb AS (SELECT b AS id, list(a) AS before FROM near GROUP BY b), node AS (SELECT id, coalesce(before, []) AS before FROM (SELECT a AS id FROM near UNION SELECT b FROM near) LEFT JOIN nb USING (id)),
        fold AS (SELECT list_reduce(list_prepend({{'id': -1::BIGINT, 'before': []::BIGINT[], 'kept': []::BIGINT[]}}, list({{'id': id, 'before': before, 'kept': []::BIGINT[]}} ORDER BY id)),
            lambda s, x: {{'id': x.id, 'before': x.before, 'kept': CASE WHEN list_has_any(s.kept, x.before) THEN s.kept ELSE list_append(s.kept, x.id) END}}).kept AS ids FROM node)"""


def hits(groups: dict) -> str:
    """CTEs ending in hits(id, grp, term, n); before them p(id, low, ...)."""
    forms, phrases, others = [], [], []
    for g, ts in groups.items():
        for t in sorted(set(ts)):
            if t.isalpha():
                forms += [(t, t, g), (t + "s", t, g)]
            elif " " in t:
                phrases.append((t, g))
            else:
                others.append((t, r"\b" + t.replace(".", r"\.") + r"(?:s\b|\b)", g))
    values = lambda rows: ", ".join("(" + ", ".join(map(q, r)) + ")" for r in rows)
    parts = [
        (forms, f"SELECT id, grp, term, sum(n)::BIGINT AS n FROM tc JOIN (VALUES {values(forms)}) f(form, term, grp) ON t = form GROUP BY ALL"),
        (phrases, f"SELECT id, grp, term, (length(low) - length(replace(low, term, ''))) // length(term) AS n FROM p CROSS JOIN (VALUES {values(phrases)}) f(term, grp)"),
        (others, f"SELECT id, grp, term, len(regexp_extract_all(low, rule)) AS n FROM p CROSS JOIN (VALUES {values(others)}) f(term, rule, grp)"),
    ]
    every = " UNION ALL ".join(sql for rows, sql in parts if rows)
    return rf"tk AS (SELECT id, unnest(regexp_extract_all(low, '[\pL\pN_]+')) AS t FROM p), tc AS (SELECT id, t, count(*) AS n FROM tk GROUP BY ALL), hits AS ({every})"


def lexicon(groups: dict) -> str:
    """Hits of each group in every document."""
    return f"WITH p AS (SELECT doc_id AS id, lower(coalesce(text, '')) AS low FROM documents), {hits(groups)} SELECT p.id AS doc_id, {', '.join(f'coalesce(sum(n) FILTER (grp = {q(g)}), 0)::BIGINT AS n_{g}' for g in groups)} FROM p LEFT JOIN hits USING (id) GROUP BY p.id"


def relevance(source: str, groups: dict) -> str:
    """Lexicon hits, score and decision; ``source``: id, text."""
    positive = [g for g in groups if g not in ("institutional", "africa", "elsewhere")]
    n = lambda g: f"n_{g}"
    languages_ = list(X.LANGUAGE_STOPWORDS)
    votes = ", ".join(f"len(list_filter(v, lambda x: x IN {listed(stops)})) AS v_{lang}" for lang, stops in X.LANGUAGE_STOPWORDS.items())
    cast, most = " + ".join(f"v_{k}" for k in languages_), f"greatest({', '.join(f'v_{k}' for k in languages_)})"
    best = "CASE " + " ".join(f"WHEN v_{k} = {most} THEN {q(k)}" for k in languages_) + " END"
    crop_names = some([(" OR ".join(f"contains(low, {q(t)})" for t in ts), c) for c, ts in sorted(X.CROP_TERMS.items())])
    areas = "list_filter([" + ", ".join([f"CASE WHEN {' + '.join(map(n, ('symptom', 'agronomy', 'organism', 'control')))} >= least THEN 'crop' END", *(f"CASE WHEN n_{a} >= least THEN '{a}' END" for a in ("livestock", "weather", "market"))]) + "], lambda x: x IS NOT NULL)"
    return rf"""WITH p AS (SELECT id, text, lower(text) AS low FROM ({source})), {hits(groups)},
        sums AS (SELECT id, {', '.join(f"coalesce(sum(n) FILTER (grp = {q(g)}), 0)::BIGINT AS n_{g}" for g in groups)} FROM hits GROUP BY id),
        top AS (SELECT id, string_agg(term || ':' || n, ', ' ORDER BY n DESC, term) AS top_terms FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, term) AS k FROM hits WHERE n > 0 AND grp IN {listed(positive)}) WHERE k <= 12 GROUP BY id),
        b AS (SELECT p.id, low, greatest(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')), 1) AS n_words, regexp_extract_all(low, '[a-zàâçéèêëîïôûùüÿñæœáíóúü]+')[1:20000] AS v, {', '.join(f'coalesce(n_{g}, 0) AS n_{g}' for g in groups)} FROM p LEFT JOIN sums USING (id)),
        c AS (SELECT *, {votes}, {' + '.join(map(n, positive))} AS positive FROM b),
        d AS (SELECT *, (positive - 2.0::DOUBLE * n_institutional) * 1000.0::DOUBLE / n_words AS score, CASE WHEN {cast} < 20 THEN 'unknown' ELSE {best} END AS language, CASE WHEN {cast} < 20 THEN 0.0::DOUBLE ELSE v_en::DOUBLE / ({cast}) END AS english,
            greatest(6, least(25, n_words // 40)) AS need, greatest(3, least(10, n_words // 80)) AS least, {' + '.join(f'(n_{g} > 0)::INT' for g in positive)} AS present FROM c),
        e AS (SELECT *, CASE WHEN language NOT IN ('en', 'unknown') AND english < 0.55 THEN 'not English' WHEN positive < need THEN 'too little guidance vocabulary' WHEN present < 2 AND positive::DOUBLE / n_words > 0.30 THEN 'term listing, not guidance'
            WHEN score < 6.0 THEN 'institutional prose dominates' WHEN n_africa >= 40 THEN 'practical guidance' WHEN n_africa = 0 AND n_elsewhere > 0 THEN 'no African context' WHEN n_elsewhere > greatest(n_africa, 1) THEN 'regionally out of scope' ELSE 'practical guidance' END AS reason FROM d)
        SELECT e.id, n_words, positive, round(score, 6) AS score, language, array_to_string({areas}, ', ') AS areas, array_to_string({crop_names}, ', ') AS crops, reason = 'practical guidance' AS accepted, reason, coalesce(top_terms, '') AS top_terms FROM e LEFT JOIN top USING (id)"""
