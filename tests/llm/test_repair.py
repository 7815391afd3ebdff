"""Conversation repair against a program that carries whole audit strings, and on odd rows."""

import hashlib
import random
import re
import zlib

import pytest

from corpusloom.llm import repair as R

NAMES = {"u": "user", "a": "assistant"}


def brute(conversations):
    """The contract, with whole strings."""
    one = lambda v: " " if v is None else str(v)
    rows: dict = {}
    for conv, turn, role, text in conversations:
        rows.setdefault(conv, [])
        kind = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: solve(r) for c, r in rows.items()}


def solve(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(R.SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    turns = [r[0] for r in rows if r[0] is not None]
    state = {"": (0, "", ())}  # roles so far -> cost, audit, lines

    def better(new, to, cost, audit, lines):
        new[to] = min(new.get(to, (1 << 60, "", ())), (cost, audit, lines))

    def put(state):
        for _ in range(3):
            for s, (cost, audit, lines) in list(state.items()):
                to = "a" if s == "u" else "u"
                better(state, to, cost + 2, audit + "I", lines + (NAMES[to] + ":",))
        return state

    for (_, role, text), fault in zip(rows, faults, strict=True):
        new: dict = {}
        for s, (cost, audit, lines) in put(state).items():
            better(new, s, cost + 3, audit + "D", lines)
            if fault in ("blank", "duplicate"):
                continue
            more = fault == "truncated"
            if role[:1] in ("s", "u", "a") and s + role[:1] in ("s", "u", "su", "ua", "au"):
                better(new, role[:1], cost + more, audit + "K", lines + (f"{role}:{text}",))
            to = "a" if s == "u" else "u"
            better(new, to, cost + more + 2, audit + "R", lines + (f"{NAMES[to]}:{text}",))
        state = new
    cost, audit, lines = min(v for s, v in put(state).items() if s in ("", "a"))
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": faults.count("blank"), "duplicate": faults.count("duplicate"), "truncated": faults.count("truncated"),
        "illegal": sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:], strict=False)), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def made(seed, n):
    r = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(r.choice([1, 1, 2, 3, 5, 8])):
            text = r.choice(["Yes.", "No", "", "  ", "Why?", "Because .  ", f"Text {r.randrange(50)}!", f"cut {r.randrange(9)}"])
            rows.append((conv, turn + r.choice([0, 0, 0, 3]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), text))
    return rows


def got(df):
    rows = df.collect()
    found = {r.conv_id: {k: r[k] for k in r.asDict() if k != "conv_id"} for r in rows}
    assert len(found) == len(rows)
    return found


def test_repair_is_the_cheapest_and_least(spark):
    rows = made(1, 600)
    assert got(R.repair(R.damage(table(spark, rows)), gone="gone")) == brute(rows)


@pytest.mark.parametrize("piece", [1, 3])
def test_long_conversations_in_pieces(spark, monkeypatch, piece):
    monkeypatch.setattr(R, "PIECE", piece)
    r = random.Random(piece)
    rows = [(conv, t if conv else None, r.choice(["user", "assistant", "system"]), f"{r.choice(['a.', 'b', 'c!'])} {r.randrange(60)}" + r.choice(["", "."])) for conv, n in ((0, 150), (7, 400), (8, 3)) for t in range(n)]
    assert got(R.repair(R.damage(table(spark, rows)), gone="gone")) == brute(rows)


def test_every_way_of_short_conversations():
    """The table of layers against all edit scripts of up to two insertions a gap."""
    layers = R.Layers()
    choices = [(i, m, c) for i in "suax" for m in (False, True) for c in (False, True)]
    r = random.Random(5)
    for _ in range(60):
        turns = [r.choice(choices) for _ in range(r.randrange(4))]
        best = {}

        def walk(i, s, cost, audit, turns=turns, best=best):
            ways = [(s, cost, audit)]
            for k in range(2):
                s2 = R.PUT[ways[-1][0]][0]
                ways.append((s2, ways[-1][1] + 2, audit + "I" * (k + 1)))
            for s, cost, audit in ways:
                if i == len(turns):
                    if s in (R.NOTHING, R.A):
                        best[0] = min(best.get(0, (99, "")), (cost, audit))
                    continue
                initial, must, cut = turns[i]
                walk(i + 1, s, cost + 3, audit + "D")
                if not must:
                    if (s, initial) in R.AFTER:
                        walk(i + 1, R.AFTER[s, initial], cost + cut, audit + "K")
                    walk(i + 1, R.PUT[s][0], cost + 2 + cut, audit + "R")

        walk(0, R.NOTHING, 0, "")
        passed, cost = layers.run(turns, R.NOTHING)
        leave, more = R.ending({s: x for s, x in enumerate(layers.layers[passed[-1]]) if x is not None})
        codes, entry = layers.codes(turns, passed, leave)
        assert entry == R.NOTHING
        assert (cost + more, "".join(R.CODES[c] for c in codes) + "I" * R.TAIL[leave]) == best[0]


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (None, 1, "user", "Hi."), (1, None, "user", None), (1, 2, None, "x"), (1, 2, None, "x"), (2, 5, "assistant", "y" * 300_000 + "."), (3, 0, "user", "Ü 😀")]
    assert got(R.repair(R.damage(table(spark, rows)), gone="gone")) == brute(rows)
    assert R.repair(R.damage(table(spark, [])), gone="gone").count() == 0
    clash = table(spark, made(3, 20)).selectExpr("*", "1 as part", "2 as seq", "'x' as audit", "'y' as n", "'z' as key", "0 as kind")
    assert got(R.repair(R.damage(clash), gone="gone")) == brute(made(3, 20))
    assert got(R.repair(clash)) == {c: solve([r[1:] for r in made(3, 20) if r[0] == c]) for c in range(20)}


def test_repaired_turns_spell_the_audit(spark, monkeypatch):
    monkeypatch.setattr(R, "PIECE", 4)
    rows = R.damage(table(spark, made(4, 60)))
    audits: dict = {}
    for x in sorted(R.repaired_turns(rows, gone="gone").collect(), key=lambda x: (x.conv_id, x.part, x.seq, x.at)):
        audits.setdefault(x.conv_id, []).append(x.edit)
    want = got(R.repair(rows, gone="gone"))
    assert {c: "".join(a) for c, a in audits.items()} == {c: v["audit"] for c, v in want.items() if v["audit"]}
