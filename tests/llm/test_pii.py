"""Personal data: base shapes against plain regular expressions, disclosing terms against a count by hand, odd rows."""

import hashlib
import math
import random
import re
from collections import defaultdict

from corpusloom.llm import pii as P

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    out = []
    for rank, (kind, rx) in enumerate(PLAIN.items()):
        for m in re.finditer(rx, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda m, d: True, "ip": lambda m, d: all(int(x) <= 255 for x in m[0].split(".")), "phone": lambda m, d: 10 <= len(d) <= 15}.get(kind, lambda m, d: 14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d[::-1])) % 10 == 0)(m, d)
            if ok:
                out.append((m.start(), rank, m.end()))
    return sorted(out)


def brute(docs, share=P.DISCLOSED):
    """All documents: base spans and those of disclosing terms, by whole lists of words."""
    n, n_entity, n_term, both, hashes, places = len(docs), defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set)
    base = []
    for i, (_, text) in enumerate(docs):
        text = text or ""
        words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W_]+", text)]
        for _, _, w in words:
            n_term[w].add(i)
            n_term[P.term_class(w)].add(i)
        spans = plain(text)
        base.append(spans)
        for s, rank, e in spans:
            around = [w for w in words if w[1] <= s][-P.AROUND :] + [w for w in words if w[0] >= e][: P.AROUND]
            around = [w for w in around if not any(w[0] < b and a < w[1] for a, _, b in spans)]
            who = P.entity(rank, text[s:e])
            n_entity[who].add(i)
            for a, b, w in around:
                for t in (w, P.term_class(w)):
                    both[who, t].add(i)
                    hashes[who, t].add(tuple(x[2] for x in around))
                places[i, who, w].add((a, b))
    over = set()
    for (who, t), at in both.items():
        p = len(n_entity[who]) / n
        if len(hashes[who, t]) > 1 and p < 1 and math.log2(len(at) / len(n_term[t]) / p) >= share * -math.log2(p):
            over.add((who, t))
    out = []
    for i, spans in enumerate(base):
        more = {}
        for (j, who, t), at in places.items():
            if i == j and (who, t) in over:
                for a, b in at:
                    more[a, b] = max(more.get((a, b), 0), 5 if (who, P.term_class(t)) in over else 4)
        out.append((spans, sorted(spans + [(a, r, b) for (a, b), r in more.items()])))
    return out


def digest(spans):
    return ",".join(f"{P.KINDS[r]}:{s}:{e}" for s, r, e in spans)


def check(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = P.find(df).select("doc_id", "digest", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", P.spelled().alias("spans")).collect()
    want = sorted((-1 if d is None else d, *(sum(r == k for _, r, _ in b) for k in range(4)), hashlib.sha256(digest(b).encode()).hexdigest(), digest(all_)) for (d, _), (b, all_) in zip(docs, brute(docs), strict=True))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in got) == want
    return want


def test_shapes_are_leftmost_and_linear():
    r = random.Random(3)
    parts = ["a@b.c", "@", ".", "x.y-z@q.org.", "1.2.3.4", "1.2.3", "300.1.1.1", "4785380592391139", "4 7 8", "-", " ", "+1 (743) 555-3824", "+", "(", ")", "0", "99", "é", "a", "_", "%", "12345678901234567890", "\n", "0255.01.1.1"]
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(12)))
        assert P.base_spans(text) == plain(text), text
    for one in ("x", "1", "1.", "a@", "+1 ", "@", "1 ", "a."):
        P.base_spans(one * 300_000)


def test_terms_that_give_an_entity_away(spark):
    r = random.Random(4)
    common = [f"w{i}" for i in range(40)] + ["the", "of", "and"]
    some = lambda n: " ".join(r.choice(common) for _ in range(n))
    docs = [(i, some(30)) for i in range(300)]
    docs += [(1000 + i, f"{some(12)} Zephyrine Quill lives at {some(2)} zq@mail.example.org {some(9)}") for i in range(6)]
    docs += [(2000 + i, f"{some(6)} room 40417 call +1 (743) 555-3824 {some(9)}") for i in range(4)]
    docs += [(3000 + i, f"hapax{0} only once near once@mail.example.org {' '.join(common[:9])} {i}") for i in range(5)]  # copies but for the end
    want = {w[0]: w for w in check(spark, docs)}
    assert "general" in want[1000][-1] and "general" in want[2001][-1]
    assert not any("general" in want[3000 + i][-1] or "removed" in want[3000 + i][-1] for i in range(5))
    assert all(want[i][-1] == "" for i in range(300))
    clean = {x.doc_id: x.text for x in P.sanitised(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert "Quill" not in clean[1001] and "[EMAIL]" in clean[1001] and "[NUMBER]" in clean[2000] and clean[5] == docs[5][1]


def test_odd_rows(spark, odd, none):
    docs = [(None, None), (None, "a@b.cc x"), (1, ""), (1, "a@b.cc x"), (1, "a@b.cc x"), (2, "q a@b.cc y"), (3, "x" * 50_000 + " a@b.cc é 1.2.3.4 😀 " * 50), (4, "é😀 +1 (743) 555-3824 ½² 4785380592391139")]
    check(spark, docs)
    assert P.find(odd).count() == odd.count() and P.find(none).count() == 0
    assert P.sanitised(odd).columns == odd.columns and P.sanitised(odd).count() == odd.count()
    assert P.find(spark.createDataFrame([("k", "a@b.cc")], "doc_id string, text string")).first().n_email == 1


def test_terms_far_from_a_value_give_it_away_too(spark):
    r = random.Random(6)
    some = lambda n: " ".join(f"w{r.randrange(40)}" for _ in range(n))
    docs = [(i, some(60)) for i in range(300)]
    docs += [(1000 + i, f"Zephyrine {some(40)} zq@mail.example.org {some(30)} 40417 {some(3)}") for i in range(5)]
    docs += [(2000 + i, f"hapax {' '.join(f'w{k}' for k in range(30))} once@mail.example.org {' '.join(f'w{k}' for k in range(9))} {some(5)}") for i in range(5)]  # one surrounding
    got = {x.doc_id: x.spans for x in P.find(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", P.spelled().alias("spans")).collect()}
    for i in range(5):
        text = docs[300 + i][1]
        at = text.index("40417")
        assert ":0:9" in got[1000 + i] and f":{at}:{at + 5}" in got[1000 + i], got[1000 + i]
        assert got[2000 + i].count(":") == 2
    assert all(got[i] == "" for i in range(300))
