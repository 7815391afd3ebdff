"""The prefix trie against a dictionary of all prefixes, in both of its ways, and on odd rows."""

import hashlib
import random
import re
import zlib

import pytest

from corpusloom.llm import pieces, trie as T


def sequences(rows):
    own: dict = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c > 0 else -1)
        out[c] = tuple(own.get(base, [])[:h] + turns[h:])
    return out


def brute(rows):
    seqs = sequences(rows)
    nodes: dict = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    found = {p: {"n_convs": len(m), "conv_id": min(m), "depth": len(p), "parent": min(nodes[p[:-1]]) if p else None} for p, m in nodes.items()}
    kids: dict = {p: 0 for p in nodes}
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = {p: 0 for p in nodes}, {p: 0 for p in nodes}
    for p, m in nodes.items():
        own = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += own
    ends = {p: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(p)).encode()).hexdigest() for p, m in nodes.items()}
    return sorted((x["conv_id"], x["depth"], -1 if x["parent"] is None else x["parent"], x["n_convs"], kids[p], leaves[p], saved[p], ends[p]) for p, x in found.items())


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def got(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in T.trie(*T.rebuilt(T.encoded_turns(df))).collect())


def made(seed, n, texts=3, turns=6):
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "assistant"]), " ".join(["w"] * r.randrange(texts))) for c in range(n) for t in range(r.randrange(1, turns))]


@pytest.mark.parametrize(("local", "piece"), [(1024, 4096), (8, 2), (1, 1)])
def test_all_prefixes(spark, monkeypatch, local, piece):
    monkeypatch.setattr(T, "LOCAL", local)
    monkeypatch.setattr(T, "PIECE", piece)
    rows = made(local, 250)
    rows += [(1000 + i, t, "user", f"same {t}") for i in range(30) for t in range(3)] + [(2001, t, "user", f"long {t}") for t in range(300)]
    assert got(table(spark, rows)) == brute(rows)


def test_one_conversation_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(T, "LOCAL", 16)
    monkeypatch.setattr(pieces, "width", lambda spark: 7)
    r = random.Random(2)
    rows = [(20, t, "user", "a b c " * r.randrange(3)) for t in range(900)] + [(21, t, "user", "x y") for t in range(40)]
    assert got(table(spark, rows)) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "gone"), (3, None, None, None), (3, None, None, None), (3, 1, "user", None), (5, 0, "", ""), (-7, 0, "user", "minus"), (-41, 2, "user", "minus"), (0, 0, "user", "z " * 50_000), (2, 0, "user", "z " * 50_000), (41, 0, "user", "turnless?"), (62, 0, "assistant", "alone")]
    assert got(table(spark, rows)) == brute(rows)
    assert got(table(spark, [])) == []
    clash = table(spark, made(9, 30)).selectExpr("*", "1 as part", "2 as pos", "'x' as id", "0 as n", "'k' as key", "5 as words", "1 as weight")
    assert got(clash) == brute(made(9, 30))
