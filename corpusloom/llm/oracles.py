"""DuckDB twins of those queries that SQL can express, written from the contracts, not from the Spark plans."""

from __future__ import annotations

from .secret_scan import ALL_CLASSES, BASE, FILLERS, WHOLE


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _placed(name: str, pattern: str, group: int = 0) -> str:
    """CTE ``name``(r, m, v, pos): matches with their start in code points."""
    return f"""{name}_l AS (SELECT r, regexp_extract_all(t, {_q(pattern)}, 0) AS ms, regexp_extract_all(t, {_q(pattern)}, {group}) AS vs, string_split_regex(t, {_q(pattern)}) AS bs FROM d WHERE regexp_matches(t, {_q(pattern)})),
        {name}_i AS (SELECT r, ms, vs, bs, unnest(range(1, len(ms) + 1)) AS i FROM {name}_l),
        {name} AS (SELECT r, ms[i] AS m, vs[i] AS v, list_sum(list_transform(bs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS pos FROM {name}_i)"""


#: Candidates of the entropy classes without look-around: maximal runs, then a test of the whole run.
_RUNS = {"entropy_hex": "^[0-9A-Fa-f]+$", "entropy_upper": "^[A-Z0-9]+$", "entropy_base64": "^[A-Za-z0-9+/_-]+$", "entropy_lower": "^[a-z0-9]+$", "entropy_letters": "^[A-Za-z]+$"}
#: Without references back: a character eight times in a row.
_EIGHT = "|".join(f"{c if c.isalnum() else chr(92) + c}{{8}}" for c in "abcdefghijklmnopqrstuvwxyz0123456789+/_-")


def secret_scan() -> str:
    """All kinds and classes, fillers by runs."""
    parts, spans = [], []
    for rank, (kind, (pattern, group, least)) in enumerate(BASE.items()):
        parts.append(_placed(kind, pattern, group))
        spans.append(f"SELECT r, pos AS a, {rank} AS k, pos + length(m) AS b, '{kind}' AS kind FROM {kind} WHERE length({'v' if group else 'm'}) >= {least}")
    fillers = "|".join(f.replace("(?i)", "") for f in FILLERS).replace(r"(.)\1{7}", _EIGHT)
    touched = _q(f"(?i)[a-z0-9]*?(?:{fillers})[a-z0-9]*")
    for rank, c in enumerate(ALL_CLASSES, len(BASE)):
        run = f"[A-Za-z0-9{'+/_-' if c.kind == 'entropy_base64' else ''}]{{{c.width},}}"
        needs = " AND ".join(f"regexp_matches(m, {_q(n)})" for n in c.needs)
        allowed = " AND ".join(f"NOT regexp_matches(m, {_q(a)})" for a in WHOLE)
        text = "lower(m)" if c.fold else "m"
        entropy = f"log2({c.width}) - list_sum(list_transform(list_distinct(regexp_extract_all(w, '.')), lambda x: (length(w) - length(replace(w, x, ''))) * log2(length(w) - length(replace(w, x, ''))))) / {c.width}"
        parts.append(_placed(c.kind, run))
        parts.append(f"{c.kind}_f AS (SELECT r, m, pos, regexp_extract_all(m, {touched}) AS fs, string_split_regex(m, {touched}) AS gs FROM {c.kind} WHERE regexp_matches(m, {_q(_RUNS[c.kind])}) AND {needs} AND {allowed})")
        parts.append(f"{c.kind}_c AS (SELECT r, pos, CASE WHEN len(fs) = 0 THEN m ELSE array_to_string(list_transform(range(1, len(gs) + 1), lambda i: gs[i] || repeat(chr(10), coalesce(length(fs[i]), 0))), '') END AS m FROM {c.kind}_f)")
        parts.append(f"{c.kind}_w AS (SELECT r, pos, i, substr({text}, i + 1, {c.width}) AS w FROM (SELECT r, m, pos, unnest(range(0, length(m) - {c.width} + 1)) AS i FROM {c.kind}_c))")
        spans.append(f"SELECT r, pos + min(i), {rank}, pos + max(i) + {c.width}, '{c.kind}' FROM {c.kind}_w WHERE NOT contains(w, chr(10)) AND {entropy} >= {c.bits} GROUP BY r, pos")
    each = "kind || ':' || a || ':' || b"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), {', '.join(parts)}, s AS ({' UNION ALL '.join(spans)}),
        g AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
            string_agg({each}, ',' ORDER BY a, k) FILTER (k < {len(BASE)}) AS base, string_agg({each}, ',' ORDER BY a, k) AS spans FROM s GROUP BY r)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)"""


#: CRC-32 of an ASCII string, by bits.
_CRC = "xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({s}, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda x, e: xor(xor(x, e) >> 1, 3988292384 * (xor(x, e) & 1))))"


def crc32(s: str) -> str:
    return _CRC.replace("{s}", f"({s})")


def prefix_trie() -> str:
    """Nodes as lists of hashed turns; every node is counted into all nodes above it."""
    return rf"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i,
            sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL),
        own AS (SELECT conv_id, list(k ORDER BY i) AS ks, list(w ORDER BY i) AS ws FROM t GROUP BY conv_id),
        c AS (SELECT conv_id, {crc32('conv_id::VARCHAR')} % 4 AS h, ks, ws FROM own),
        s AS (SELECT c.conv_id, list_concat(coalesce(b.ks[1:h], []), c.ks[h+1:]) AS ks, list_concat(coalesce(b.ws[1:h], []), c.ws[h+1:]) AS ws FROM c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20),
        p AS (SELECT conv_id, d, ks[1:d] AS pre, len(ks) AS n, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS w FROM (SELECT *, unnest(range(0, len(ks) + 1)) AS d FROM s)),
        nd AS (SELECT pre, d, min(conv_id) AS id, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS own, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends FROM p GROUP BY pre, d),
        k AS (SELECT pre[1:d-1] AS up, count(*) AS kids FROM nd WHERE d > 0 GROUP BY 1),
        f AS (SELECT nd.*, coalesce(kids, 0) AS kids FROM nd LEFT JOIN k ON k.up = nd.pre),
        a AS (SELECT pre[1:e] AS pre, sum((kids = 0)::BIGINT) AS leaves, sum(own) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM f) GROUP BY 1)
        SELECT f.id AS conv_id, f.d::BIGINT AS depth, u.id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.kids::BIGINT AS n_children, a.leaves::BIGINT AS n_leaves, a.saved::BIGINT AS saved_tokens, f.ends AS ends_sha256
        FROM f JOIN a USING (pre) LEFT JOIN nd u ON f.d > 0 AND u.pre = f.pre[1:f.d-1]"""


def conversation_repair() -> str:
    """The program over whole audits and texts, a turn a step: per state (cost, audit, text)."""
    put = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
    into: dict[int, list[str]] = {t: [] for t in range(4)}
    for s0 in range(4):
        s, more, audit, text = s0, 0, "", ""
        for _ in range(3):
            have = lambda cost, letter, line, more=more, audit=audit, text=text, s0=s0: f"struct_pack(c := s{s0}.c + {more} + {cost}, a := s{s0}.a || '{audit}{letter}', b := s{s0}.b || {text or chr(39) * 2}{line})"
            ok = f"s{s0} IS NOT NULL"
            into[s].append(f"CASE WHEN {ok} THEN {have('3', 'D', '')} END")
            to, role = put[s]
            into[to].append(f"CASE WHEN {ok} AND NOT must THEN {have('2 + cut', 'R', f' || chr(10) || {_q(role)} || chr(58) || text')} END")
            for initial, after in {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[s].items():
                into[after].append(f"CASE WHEN {ok} AND NOT must AND ini = '{initial}' THEN {have('cut', 'K', ' || chr(10) || role || chr(58) || text')} END")
            text = f"{text + ' || ' if text else ''}chr(10) || {_q(role + ':')}"
            s, more, audit = to, more + 2, audit + "I"
    step = ", ".join(f"list_sort(list_filter([{', '.join(into[t])}], lambda x: x IS NOT NULL))[1]" for t in range(4))
    tail = {0: "", 1: "chr(10) || 'user:' || chr(10) || 'assistant:'", 2: "chr(10) || 'assistant:'", 3: ""}
    ends = ", ".join(f"CASE WHEN s{t} IS NOT NULL THEN struct_pack(c := s{t}.c + {2 * k}, a := s{t}.a || '{'I' * k}', b := s{t}.b || {tail[t] or chr(39) * 2}) END" for t, k in ((0, 0), (1, 2), (2, 1), (3, 0)))
    none = "NULL::STRUCT(c BIGINT, a VARCHAR, b VARCHAR)"
    return rf"""WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations),
        g AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM o WHERE k <> 0),
        n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text), copy) AS i, left(role, 1) AS ini, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM g),
        m AS (SELECT *, last = '' AS blank, last <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup FROM n),
        f AS (SELECT *, blank OR dup AS must, (NOT blank AND NOT dup AND last NOT IN ('.', '!', '?'))::BIGINT AS cut, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM m),
        st AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, struct_pack(c := 0::BIGINT, a := '', b := '') AS s0, {none} AS s1, {none} AS s2, {none} AS s3 FROM o
            UNION ALL SELECT st.conv_id, f.i, {step} FROM st JOIN f ON f.conv_id IS NOT DISTINCT FROM st.conv_id AND f.i = st.i + 1),
        z AS (SELECT conv_id, list_sort(list_filter([{ends}], lambda x: x IS NOT NULL))[1] AS e FROM st QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
        q AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count_if(blank) AS blank, count_if(dup) AS duplicate, sum(cut) AS truncated, count_if(before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
        SELECT z.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, e.c AS cost, e.a AS audit, sha256(e.b[2:]) AS repaired_sha256
        FROM z LEFT JOIN q ON q.conv_id IS NOT DISTINCT FROM z.conv_id"""


_WORDS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\pL\pN_]+'), lambda x: x <> '')"


def jaccard_join() -> str:
    return f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
        sh AS (SELECT DISTINCT r, s FROM (SELECT r, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d)),
        k AS (SELECT d.r, doc_id, coalesce(any_value(x.key), 'raw ' || t) AS key, coalesce(any_value(x.n), 0) AS n FROM d LEFT JOIN (SELECT r, md5(string_agg(s, '|' ORDER BY s)) AS key, count(*) AS n FROM sh GROUP BY r) x USING (r) GROUP BY d.r, doc_id, t),
        sets AS (SELECT key, min(r) AS r, min(doc_id) AS id, count(*) AS copies, any_value(n) AS n FROM k GROUP BY key),
        ss AS (SELECT sets.r, n, copies, s FROM sets JOIN sh USING (r)),
        e AS (SELECT a.r AS a, b.r AS b, any_value(b.copies) AS copies FROM ss a JOIN ss b ON a.s = b.s AND a.r <> b.r GROUP BY a.r, b.r, a.n, b.n HAVING count(*)::DOUBLE / (a.n + b.n - count(*)) >= 0.8 - 1e-12),
        reach(a, b) AS (SELECT r, r FROM sets UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
        cls AS (SELECT reach.a AS r, min(sets.id) AS class_id FROM reach JOIN sets ON sets.r = reach.b GROUP BY reach.a),
        lk AS (SELECT a AS r, sum(copies) AS links FROM e GROUP BY a)
        SELECT k.doc_id, class_id, (coalesce(links, 0) + copies - 1)::BIGINT AS n_links FROM k JOIN sets USING (key) JOIN cls ON cls.r = sets.r LEFT JOIN lk ON lk.r = sets.r"""


def decontamination() -> str:
    runs = lambda n, source, key: f"SELECT DISTINCT {key}, {n} AS run, s FROM (SELECT {key}, unnest(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i+{n - 1}], ' '))) AS s FROM {source} WHERE len(w) >= {n})"
    items = " UNION ALL ".join(runs(n, f"(SELECT * FROM b WHERE {'len(w) >= 5' if n == 5 else f'len(w) = {n}'})", "i") for n in range(1, 6))
    docs = " UNION ALL ".join(runs(n, f"(SELECT * FROM d WHERE {n} IN (SELECT run FROM bs))" if n < 5 else "d", "r") for n in range(1, 6))
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents), b AS (SELECT row_number() OVER () AS i, item_id, {_WORDS} AS w FROM benchmark),
        bs AS ({items}), ds AS ({docs}), n AS (SELECT i, count(*) AS n_item FROM bs GROUP BY i),
        hit AS (SELECT r, i, count(*) AS n_shared FROM ds JOIN bs USING (run, s) GROUP BY r, i)
        SELECT doc_id, item_id, n_item, n_shared, n_shared::DOUBLE / n_item AS containment FROM hit JOIN n USING (i) JOIN d USING (r) JOIN b USING (i) WHERE n_shared::DOUBLE / n_item >= 0.8 - 1e-12"""


def url_filter(rules: list[tuple[str, str, str]]) -> str:
    case = lambda what: "CASE " + " ".join(f"WHEN (host = {_q(h)} OR ends_with(host, {_q('.' + h)})) AND starts_with(path, {_q(p)}) THEN {_q(v if what == 'verdict' else h + p)}" for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2]))) + " END"
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    fold = rf"regexp_replace(translate(url, '{upper}', '{low}'), '[^a-z0-9/.\-_?=&#:%]', '~', 'g')"
    p = lambda x: f"({x}3 + greatest({x}t3, 1) * (({x}2 + greatest({x}t2, 1) * (({x}1 + 0.5) / ({x}n + 0.5 * symbols))) / ({x}n2 + greatest({x}t2, 1)))) / ({x}n3 + greatest({x}t3, 1))"
    return f"""WITH u AS (SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{upper}', '{low}') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
        j AS (SELECT *, {case('rule')} AS rule, {case('verdict')} AS said FROM u),
        e AS (SELECT url, said, count(*) AS n, ('0x' || left(md5(url), 8))::BIGINT % 5 = 0 AS held FROM j WHERE url IS NOT NULL GROUP BY url, said),
        f AS (SELECT *, '^^' || {fold} AS x FROM e WHERE length(url) > 0), g AS (SELECT url, said, n, held, unnest(list_transform(range(1, length(x) - 1), lambda i: substr(x, i, 3))) AS gram FROM f),
        c AS (SELECT gram, substr(gram, 1, 2) AS ctx, substr(gram, 2, 1) AS mid, substr(gram, 3, 1) AS last, coalesce(sum(n) FILTER (said = 'allow' AND NOT held), 0) AS a3, coalesce(sum(n) FILTER (said = 'block' AND NOT held), 0) AS b3 FROM g GROUP BY gram),
        c2 AS (SELECT mid, last, sum(a3) AS a2, sum(b3) AS b2 FROM c GROUP BY ALL), c1 AS (SELECT last, sum(a2) AS a1, sum(b2) AS b1 FROM c2 GROUP BY ALL), tot AS (SELECT sum(a1) AS an, sum(b1) AS bn, count(*) AS symbols FROM c1),
        s3 AS (SELECT ctx, sum(a3) AS an3, count(*) FILTER (a3 > 0) AS at3, sum(b3) AS bn3, count(*) FILTER (b3 > 0) AS bt3 FROM c GROUP BY ctx),
        s2 AS (SELECT mid, sum(a2) AS an2, count(*) FILTER (a2 > 0) AS at2, sum(b2) AS bn2, count(*) FILTER (b2 > 0) AS bt2 FROM c2 GROUP BY mid),
        m AS (SELECT gram, ln(({p('a')})::DOUBLE) - ln(({p('b')})::DOUBLE) AS ratio FROM c JOIN s3 USING (ctx) JOIN s2 USING (mid) JOIN c2 USING (mid, last) JOIN c1 USING (last) CROSS JOIN tot),
        sc AS (SELECT url, any_value(said) AS said, any_value(held) AS held, sum(ratio) / count(*) AS score FROM g JOIN m USING (gram) GROUP BY url),
        fit AS (SELECT avg(score) FILTER (said = 'allow') AS am, stddev_pop(score) FILTER (said = 'allow') + 1e-9 AS sa, avg(score) FILTER (said = 'block') AS bm, stddev_pop(score) FILTER (said = 'block') + 1e-9 AS sb FROM sc WHERE held)
        SELECT page_id, host, path, rule, coalesce(j.said, CASE WHEN score < coalesce((am * sb + bm * sa) / (sa + sb), 0) THEN 'block' ELSE 'allow' END) AS verdict, round(score, 6) AS score FROM j LEFT JOIN sc USING (url) CROSS JOIN fit"""
