"""Order statistics by brackets, greedy keeping of chains, continuation scores: against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import dedup, evaluate


def test_places_in_narrowing_brackets(spark):
    r = random.Random(1)
    rows = [(g, x) for g, n, draw in (("flat", 3000, lambda: r.random()), ("ties", 3000, lambda: float(r.randrange(3))), ("one", 1, lambda: 5.0), ("tail", 2500, lambda: r.random() ** 9 * 1e9), ("two", 2, lambda: r.random())) for x in (draw() for _ in range(n))] + [("flat", None), ("null", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    sorted_ = {g: sorted(x for h, x in rows if h == g and x is not None) for g in ("flat", "ties", "one", "tail", "two")}
    for most in (20, None):
        got = {x["g"]: x for x in evaluate.by_index(df, "x", {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}, ["g"], most=most).collect()}
        assert set(got) == set(sorted_)
        for g, v in sorted_.items():
            assert got[g]["n"] == len(v) and [got[g][p] for p in ("p0", "p50", "p95", "p100")] == [v[min(int(len(v) * s), len(v) - 1)] for s in (0.0, 0.5, 0.95, 1.0)]
    whole = sorted(x for _, x in rows if x is not None)
    got = evaluate.by_index(df, "x", {"p99": 0.99}, back=1, most=50).collect()
    assert [(x["n"], x["p99"]) for x in got] == [(len(whole), whole[int(len(whole) * 0.99) - 1])]
    floors = [x["floor"] for x in evaluate.sweep_range(df, "x", most=50).orderBy("step").collect()]
    want = df.agg(F.percentile("x", F.array(F.lit(0.1), F.lit(0.9)))).first()[0]
    assert floors == pytest.approx([want[0] + (want[1] - want[0]) * i / 8 for i in range(9)])
    assert evaluate.by_index(df.limit(0), "x", {"p": 0.5}, ["g"]).count() == 0


def greedy(pairs):
    before, kept = {}, {}
    for a, b in pairs:
        before.setdefault(b, []).append(a)
        before.setdefault(a, [])
    for x in sorted(before):
        kept[x] = not any(kept[y] for y in before[x])
    return kept


def test_a_chain_of_ten_thousand_revisions(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(dedup, "forget", lambda *t, f=dedup.forget: (rounds.append(1), f(*t)))
    pairs = [(i, i + 1) for i in range(10_000)]
    got = {x["id"]: x["kept"] for x in dedup.greedy(spark.createDataFrame(pairs, "a long, b long").repartition(4)).collect()}
    assert got == greedy(pairs) and len(rounds) <= 24, len(rounds)


@pytest.mark.parametrize("folded", [200_000, 40])
def test_greedy_on_random_graphs(spark, monkeypatch, folded):
    monkeypatch.setattr(dedup, "FOLDED", folded)
    monkeypatch.setattr(dedup, "EASY_ROUNDS", 1)
    r = random.Random(folded)
    pairs = sorted({tuple(sorted(r.sample(range(k * 100, k * 100 + 60), 2))) for k in range(6) for _ in range(30 + 40 * k)} | {(1000 + i, 1001 + i) for i in range(30)})
    got = {x["id"]: x["kept"] for x in dedup.greedy(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == greedy(pairs)


def test_continuations_score_as_by_hand(spark):
    r, logits, sequences, prompts, want = random.Random(3), [], [], [], {}
    for q in range(6):
        prompt = [r.randrange(5) for _ in range(r.randrange(1, 5))]
        prompts += [(q, i, t) for i, t in enumerate(prompt)]
        for c in range(3):
            keep = len(prompt) if c else r.randrange(len(prompt) + 1)
            full = prompt[:keep] + ([] if c == 1 else [r.randrange(5) for _ in range(r.randrange(1, 4))])
            if not full:
                full = [7 % 5]
            sequences += [(q, c, i, t) for i, t in enumerate(full)]
            rows = [[r.choice([-1, 1]) * r.random() * 900 for _ in range(5)] for _ in full]
            logits += [(q, c, i, t, x) for i, row in enumerate(rows) for t, x in enumerate(row)]
            n = 0
            while n < min(len(full), len(prompt)) and full[n] == prompt[n]:
                n += 1
            n, s = max(n, 1), 0.0
            for i in range(n, len(full)):
                top = max(rows[i - 1])
                s += rows[i - 1][full[i]] - top - math.log(sum(math.exp(x - top) for x in rows[i - 1]))
            want[q, c] = (s if n < len(full) else -math.inf, max(len(full) - n, 0))
    made = evaluate.continuation_scores(spark.createDataFrame(logits, "question_id long, choice long, position long, token long, logit double"), spark.createDataFrame(sequences, "question_id long, choice long, position long, token long"), spark.createDataFrame(prompts, "question_id long, position long, token long"))
    got = {(x["question_id"], x["choice"]): (x["score"], x["n_scored"]) for x in made.collect()}
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0], rel=1e-9) for k in want)
    gold = made.withColumns({"gold": F.col("choice") == 2, "n_chars": F.lit(1)})
    best = {q: max(range(3), key=lambda c: (want[q, c][0], -c)) for q in range(6)}
    assert evaluate.argmax_accuracy(gold).first()["acc"] == pytest.approx(sum(b == 2 for b in best.values()) / 6)
