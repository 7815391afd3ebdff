"""Token logs that grow and restart, the guard with timers, and its statistics against brute force."""

import json
import random
import time
from datetime import UTC, datetime, timedelta

import pytest

from corpusloom.functions import fixed as X
from corpusloom.streaming import answers, guard, tokens
from corpusloom.streaming.events import run_to_end

ZERO = datetime(2024, 1, 1, tzinfo=UTC)


def line(answer, seq, piece, last, ms, asked=0, **more):
    stamp = lambda x: (ZERO + timedelta(milliseconds=x)).isoformat()
    return json.dumps({"answer_id": answer, "seq": seq, "piece": piece, "is_last": last, "sources": "Apply 20 kg per ha.", "asked": stamp(asked), "ts": stamp(ms), **more}, ensure_ascii=False) + "\n"


def cut(text, n=5):
    return [text[i : i + n] for i in range(0, len(text), n)] or [""]


TEXTS = {f"a{i}": f"Answer {i}: plant yam é in ridges. It costs N{i}00 a bag. Apply {20 if i % 2 else 50} kg per ha. Then wait." for i in range(12)}


def whole(text):
    g = guard.Guard(sources=guard.squeezed("Apply 20 kg per ha."))
    return g.feed(text) + g.close()


def said(rows):
    out: dict = {}
    for r in sorted(rows, key=lambda r: (r["answer_id"], r["upto"], r["state"] != "more")):
        out[r["answer_id"]] = out.get(r["answer_id"], "") + r["text"]
    return out


@pytest.mark.parametrize("split", [37, 1 << 20])
def test_a_log_that_grows_is_read_once(spark, tmp_path, split):
    logs, want = tmp_path / "logs", []
    logs.mkdir()
    r = random.Random(split)
    lines = [[line(f"w{w}", i, "é" * r.randrange(30), False, i) for i in range(60)] for w in range(2)]
    for stop in (20, 21, 60):
        for w in range(2):
            data = "".join(lines[w][:stop]).encode()
            (logs / f"w{w}.jsonl").write_bytes(data + (lines[w][stop].encode()[:25] if stop < 60 else b""))  # a line that is not finished
        stream = tokens.token_log(spark, str(logs), bytesPerSplit=split)
        got = run_to_end(stream, str(tmp_path / "out")).collect()
        want = sorted((f"w{w}", i, json.loads(lines[w][i])["piece"]) for w in range(2) for i in range(stop))
        assert sorted((x["answer_id"], x["seq"], x["piece"]) for x in got) == want
    (logs / "w0.jsonl").write_bytes(b"[1]\n")
    with pytest.raises(Exception, match="fewer bytes|no token"):
        run_to_end(tokens.token_log(spark, str(logs)), str(tmp_path / "out"))


def test_guarded_answers_over_restarts(spark, tmp_path):
    """Out of order, repeated and in three runs; statistics as from a plain count."""
    logs = tmp_path / "logs"
    logs.mkdir()
    r, rows = random.Random(1), []
    for k, (name, text) in enumerate(TEXTS.items()):
        pieces = cut(text)
        rows += [(line(name, i, p, i == len(pieces) - 1, 1000 * k + 500 + 40 * i, 1000 * k), name, i) for i, p in enumerate(pieces)]
    rows += r.sample(rows, 60)
    r.shuffle(rows)
    cuts = [0, len(rows) // 3, 2 * len(rows) // 3, len(rows)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        with (logs / "all.jsonl").open("a") as f:
            f.write("".join(x[0] for x in rows[a:b]))
        out = run_to_end(answers.answered(tokens.token_log(spark, str(logs)), "10 minutes", "10 minutes"), str(tmp_path / "out")).collect()
    assert said(out) == {n: whole(t) for n, t in TEXTS.items()}
    ended = {x["answer_id"]: x for x in out if x["state"] == "done"}
    assert set(ended) == set(TEXTS)
    for name, text in TEXTS.items():
        n = len(cut(text))
        assert ended[name]["tokens"] == n and ended[name]["first_ms"] == 500 and ended[name]["per_second"] == pytest.approx(1000 / 40)


def test_a_silent_answer_closes_without_a_clock(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.jsonl").write_text(line("s", 0, "Yam costs N500 each", False, 0) + line("s", 1, " and more", False, 100) + line("q", 0, " 1 ", True, 0) + line("far", 0, "Later.", True, 10_000_000))
    out = run_to_end(answers.answered(tokens.token_log(spark, str(logs)), "30 seconds", "1 second"), str(tmp_path / "out")).collect()
    ended = {r["answer_id"]: r for r in out if r["state"] in ("silent", "done", "retry")}
    assert ended["s"]["state"] == "silent" and said(out)["s"] == whole("Yam costs N500 each and more") and ended["s"]["tokens"] == 2 and ended["s"]["per_second"] == pytest.approx(10)
    assert sorted(r["state"] for r in out if r["answer_id"] == "q") == ["retry", "silent"] and said(out)["q"] == X.NO_GUIDANCE_MESSAGE
    assert ended["far"]["state"] == "done" and ended["far"]["per_second"] is None
    with (logs / "a.jsonl").open("a") as f:  # repeats of closed answers are too late for the watermark, or known
        f.write(line("s", 1, " and more", False, 100) + line("far", 0, "Later.", True, 10_000_000))
    again = run_to_end(answers.answered(tokens.token_log(spark, str(logs)), "30 seconds", "1 second"), str(tmp_path / "out")).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_processing_time_has_the_same_text(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.jsonl").write_text("".join(line(n, i, p, i == len(cut(t)) - 1, i) for n, t in TEXTS.items() for i, p in enumerate(cut(t))))
    stream = answers.answered(tokens.token_log(spark, str(logs)), "10 minutes", event_time=False)
    query = stream.writeStream.outputMode("append").format("memory").queryName("spoken").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        deadline = time.time() + 90  # timers by the clock ask for batches without end
        while time.time() < deadline and spark.table("spoken").filter("state = 'done'").count() < len(TEXTS):
            time.sleep(0.5)
    finally:
        query.stop()
    assert said(spark.table("spoken").collect()) == {n: whole(t) for n, t in TEXTS.items()}


def test_pieces_that_came_together_are_looked_at_once(monkeypatch):
    looks = []
    settled = guard.settled
    monkeypatch.setattr(guard, "settled", lambda text, sources: looks.append(text) or settled(text, sources))
    for text in TEXTS.values():
        g = guard.Guard(sources=guard.squeezed("Apply 20 kg per ha."))
        for i, piece in enumerate(cut(text)):
            g.put(i, piece, i == len(cut(text)) - 1)
        looks.clear()
        assert g.drained() == whole(text) and len(looks) <= 2 and g.state == "done" and g.taken == len(cut(text))


class Handle:
    """State of one answer that counts what is asked of it."""

    def __init__(self):
        self.calls, self.value, self.map, self.timers = [], None, {}, set()

    def getValueState(self, *_):
        return self._named(get=lambda: self.value, update=lambda v: setattr(self, "value", v), clear=lambda: setattr(self, "value", None))

    def getMapState(self, *_):
        return self._named(iterator=lambda: iter(list(self.map.items())), updateValue=lambda k, v: self.map.__setitem__(k, v), removeKey=lambda k: self.map.pop(k), clear=self.map.clear)

    def _named(self, **functions):
        return type("State", (), {n: staticmethod(lambda *a, n=n, f=f: (self.calls.append(n), f(*a))[1]) for n, f in functions.items()})

    def registerTimer(self, at):
        self.calls.append("register")
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls.append("delete")
        self.timers.remove(at)


def tokens_in(*lines):
    return list(answers._packed(iter([tokens.tokens_of([x.strip().encode() for x in lines], "a")])))[0]


def rows_of(batch):
    from pyspark.sql import Row

    return [Row(**r) for r in batch.to_pylist()]


def test_an_answer_costs_few_calls_of_its_state():
    text = TEXTS["a1"]
    pieces = cut(text)
    lines = [line("a1", i, p, i == len(pieces) - 1, 500 + 40 * i) for i, p in enumerate(pieces)]
    h, processor = Handle(), answers.Answers(1, 30_000, True)
    processor.init(h)
    got = list(processor.handleInputRows(("a1",), iter(rows_of(tokens_in(*lines))), None))
    assert [(r.text, r.state, r.tokens, r.first_ms) for r in got] == [(whole(text), "done", len(pieces), 500)] and h.calls == ["get", "register", "update"]
    h.calls.clear()
    assert list(processor.handleInputRows(("a1",), iter(rows_of(tokens_in(*lines))), None)) == [] and h.calls == ["get"]  # repeats of an ended one
    assert list(processor.handleExpiredTimer(("a1",), None, None)) == [] and h.calls == ["get", "get", "clear"]
    h = Handle()
    processor.init(h)
    parts = [lines[4:], lines[1:3], lines[:1] + lines[3:4]]  # later pieces first: they wait in the map, and one timer stands at any time
    said_ = [r for part in parts for r in processor.handleInputRows(("a1",), iter(rows_of(tokens_in(*part))), None)]
    assert "".join(r.text for r in said_) == whole(text) and said_[-1].tokens == len(pieces) and not h.map and len(h.timers) == 1


def test_tokens_of_a_batch_are_one_row_an_answer():
    some = [line(a, i, f"{a}{i}", i == 5, i) for i in range(6) for a in ("x", "y")]
    random.Random(4).shuffle(some)
    bare = json.dumps({"answer_id": "z", "seq": 0, "piece": None, "is_last": None, "sources": None, "asked": None, "ts": None})
    got = {r.answer_id: r for r in rows_of(tokens_in(*some, bare, line("n", 1, "b", False, 7, sources=" ,"), line("n", 0, "a", False, 8)))}
    assert set(got) == {"x", "y", "z", "n"} and got["x"].piece == [f"x{i}" for i in range(6)] and got["y"].seq == list(range(6)) and got["x"].last == [False] * 5 + [True]
    assert got["n"].sources == "Apply 20 kg per ha." and got["n"].ts == ZERO + timedelta(milliseconds=8) and got["n"].ms == [int(ZERO.timestamp() * 1000) + 8, int(ZERO.timestamp() * 1000) + 7]
    assert (got["z"].ts, got["z"].asked, got["z"].sources, got["z"].piece, got["z"].ms, got["z"].attempt, got["z"].last) == (None, None, None, [None], [None], [0], [False])


def test_lines_are_read_alike_by_arrow_and_by_line():
    odd = [
        line("é", 0, 'a "quoted" \\ piece ', True, 5), line("b", 1, "", False, 6, attempt=None), '{"answer_id": "c", "seq": 2, "other": [1, {"x": 2}], "ts": "2024-01-01T01:00:00.123456+01:00"}', "{}",
        '{"answer_id": "d", "ts": "2024-01-01T00:00:00"}', '{"answer_id": "d", "ts": "2024-01-01"}', '{"answer_id": "e", "is_last": 1}', '{"answer_id": "a", "answer_id": "f"}', ' {"answer_id": "g"} ',
    ]
    for few in ([odd[i]] for i in range(len(odd))):
        raw = [x.strip("\n").encode() for x in few]
        assert tokens.tokens_of(raw, "a").to_pylist() == tokens._batch([tokens.parsed(x, "a") for x in raw]).to_pylist(), few
    together = [x.strip("\n").encode() for x in odd]
    assert tokens.tokens_of(together, "a").to_pylist() == tokens._batch([tokens.parsed(x, "a") for x in together]).to_pylist()
    for wrong in (b"[1]", b"{} {}", b'{"answer_id": "a"', b'{"piece": "\xff"}', b"null", b"{} null {}", b"{}\nnull"):
        with pytest.raises(ValueError, match="no token"):
            tokens.tokens_of([wrong], "log")
