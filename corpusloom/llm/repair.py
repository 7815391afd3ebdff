"""Conversation structure repair: the cheapest edits that make roles alternate, by a rank-compressed dynamic program.

Roles must read ``(s?(ua)+)?`` by their initials. A layer of the program stands for the turns so far, with
four states: nothing yet, after s, after u, after a. Between two layers lies one macro edit: a run of up to two
inserted turns, then what becomes of the turn (K keep 0, R other role 2, D delete 3; an insertion I costs 2; a
truncated turn that stays costs 1). More insertions in a row go round the cycle of u and a for nothing.

Audit strings are never carried along. A macro edit's code is ``I`` for each insertion and the letter of
the turn: the codes are free of prefixes, so two audits over the same turns compare like their sequences of codes,
and it is enough to know each state's rank among the layer's best audits: the next layer orders by (cost, rank, code).
A layer is its relative costs and ranks, of which few differ; so a step is a look-up in a table that fills as it is used,
and a layer keeps one number, from which its parent pointers and codes are read when the edits are written down at the end.

Conversations of any length: turns are sorted by range over all partitions and solved in pieces of at most
``PIECE`` turns. A piece within a longer conversation is solved from each of the four states it may be entered
in; pieces combine like matrices over (cost, rank). The states at their ends are chosen in one pass over
those small matrices, and edits and text are written for each piece in parallel. Only the audit, which is one value, and the
running SHA-256 pass through one task for each conversation, piece by piece.

Order: turn (null first); ties by role, then by the SHA-256 of role and text. Equal rows of one turn are
counted before they are sorted, and become one kept row and deletions.

Edge cases: null role or text is one space, so that the turn is blank or its role none of s, u, a (and neither is an
empty role: such a turn is replaced or deleted); a null conv_id is a conversation of its own; null turns do not count for
gaps; a conversation whose rows are all ``gone`` has zeros, an empty audit and the hash of an empty text; empty tables give none;
extra columns are left aside.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pieces import ranged, streamed, with_last
from .store import written

SPACE = " \t\n\x0b\x0c\r"
PIECE, PIECE_CHARS = 2048, 4_000_000
NOTHING, S, U, A = range(4)
#: State after a turn of this initial, by the state before.
AFTER = {(NOTHING, "s"): S, (NOTHING, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
#: State after an inserted or re-roled turn, and its role.
PUT = {NOTHING: (U, "user"), S: (U, "user"), U: (A, "assistant"), A: (U, "user")}
#: Insertions at the end, by state.
TAIL = {NOTHING: 0, S: 2, U: 1, A: 0}
CODES = sorted("I" * k + x for k in range(3) for x in "DKR")
LEGAL = {"su", "ua", "au"}
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damage(conversations: DataFrame) -> DataFrame:
    """The rows after damage by crc32 of ``conv_id:turn``, and a row marked ``gone`` for each that is dropped."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn"))), F.lit(20))
    rows = conversations.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), F.explode(F.array_repeat(F.lit(0), copies)).alias("_")).drop("_")


class Layers:
    """Layers of the program, numbered as they are met: (cost above the least, rank) of each state, None where it can't be."""

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.layers: list[tuple] = []
        self.steps: dict[tuple[int, tuple], tuple[int, int, tuple]] = {}
        self.begin = [self.number(tuple((0, 0) if s == e else None for s in range(4))) for e in range(4)]

    def number(self, layer: tuple) -> int:
        if layer not in self.known:
            self.known[layer] = len(self.layers)
            self.layers.append(layer)
        return self.known[layer]

    def step(self, at: int, turn: tuple[str, bool, bool]) -> tuple[int, int, tuple]:
        """Next layer, what its least cost adds, and (state before, code) of each state; turn: initial, must go, truncated."""
        found = self.steps.get((at, turn))
        if found is None:
            found = self.steps[at, turn] = self._step(at, turn)
        return found

    def _step(self, at: int, turn: tuple[str, bool, bool]) -> tuple[int, int, tuple]:
        initial, must_go, cut = turn
        best: dict[int, tuple] = {}
        for s, have in enumerate(self.layers[at]):
            if have is None:
                continue
            for c, code in enumerate(CODES):
                to, cost, edit = s, have[0] + 2 * (len(code) - 1), code[-1]
                for _ in code[:-1]:
                    to = PUT[to][0]
                if edit == "D":
                    cost += 3
                elif must_go or (edit == "K" and (to, initial) not in AFTER):
                    continue
                else:
                    cost += cut + 2 * (edit == "R")
                    to = AFTER[to, initial] if edit == "K" else PUT[to][0]
                best[to] = min(best.get(to, (1 << 60,)), (cost, have[1], c, s))
        least = min(b[0] for b in best.values())
        order = sorted({b[1:3] for b in best.values()})
        layer = tuple((best[t][0] - least, order.index(best[t][1:3])) if t in best else None for t in range(4))
        return self.number(layer), least, tuple((best[t][3], best[t][2]) if t in best else None for t in range(4))

    def run(self, turns: list[tuple], entry: int) -> tuple[array, int]:
        """Numbers of all layers from ``entry`` on, and the least cost of the last."""
        at = self.begin[entry]
        passed, cost = array("I", [at]), 0
        for turn in turns:
            at, more, _ = self.step(at, turn)
            passed.append(at)
            cost += more
        return passed, cost

    def codes(self, turns: list[tuple], passed: array, leave: int) -> tuple[list[int], int]:
        """Codes of the edits that end in state ``leave``, by the parent pointers, and the state that they began in."""
        out = []
        for i in range(len(turns) - 1, -1, -1):
            leave, code = self.step(passed[i], turns[i])[2][leave]
            out.append(code)
        return out[::-1], leave


def ending(layer: dict[int, tuple]) -> tuple[int, int]:
    """State of the best end and its cost; ``layer``: (cost, rank) by state."""
    cost, _, _, s = min((cost + 2 * TAIL[s], rank, "I" * TAIL[s], s) for s, (cost, rank) in layer.items())
    return s, cost


def edits(turns: list[tuple], codes: list[int], entry: int, tail: int) -> Iterator[tuple[str, int | None, str | None]]:
    """(letter, place of the turn or None, new role or None) of each edit in order."""
    s = entry
    for i, (turn, c) in enumerate(zip(turns, codes, strict=True)):
        for letter in CODES[c]:
            if letter == "I":
                s, role = PUT[s]
                yield "I", None, role
            elif letter == "R":
                s, role = PUT[s]
                yield "R", i, role
            elif letter == "K":
                s = AFTER[s, turn[0]]
                yield "K", i, None
            else:
                yield "D", i, None
    for _ in range(tail):
        s, role = PUT[s]
        yield "I", None, role


class Piece:
    """Turns of one conversation, in order, with what is counted in them."""

    def __init__(self, conv):
        self.conv, self.turns, self.rows, self.at, self.chars = conv, [], [], [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.first_turn = self.last_turn = self.first = self.last = None

    def add(self, r: dict) -> None:
        if r["n"] == 0:
            return
        initial, n = r["role"][:1], r["n"]
        if self.last is not None:
            self.illegal += self.last + initial not in LEGAL
        else:
            self.first = initial
        self.illegal += (n - 1) * (initial + initial not in LEGAL)
        self.last = initial
        if r["turn"] is not None:
            self.distinct += r["turn"] != self.last_turn
            self.last_turn = r["turn"]
            if self.first_turn is None:
                self.first_turn = r["turn"]
        self.blank += n * r["blank"]
        if not r["blank"]:
            self.duplicate += n - 1 + r["late"]
            self.truncated += r["cut"] and not r["late"]
        self.at += [len(self.rows)] * n
        self.rows.append((r["role"], r["text"]))
        self.turns += [(initial, r["blank"] or r["late"], r["cut"] and not r["blank"])] + [("", True, False)] * (n - 1)
        self.chars += len(r["text"]) + n

    def written(self, layers: Layers, entry: int, passed: array, leave: int, tail: int) -> tuple[str, list[tuple[str, str, str]]]:
        """The audit and, for every edit, (letter, role, text)."""
        codes, _ = layers.codes(self.turns, passed, leave)
        return told(self.turns, [self.rows[i] for i in self.at], codes, entry, tail)


def told(turns: list[tuple], rows: list[tuple[str, str]], codes: list[int], entry: int, tail: int) -> tuple[str, list[tuple[str, str, str]]]:
    out = [(letter, role or rows[i][0], "" if i is None else rows[i][1]) for letter, i, role in edits(turns, codes, entry, tail)]
    return "".join(x[0] for x in out), out


def body(made: list[tuple[str, str, str]]) -> list[str]:
    return [f"{role}:{text}" for letter, role, text in made if letter != "D"]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


MATRIX = "costs array<int>, ranks array<int>"
KEPT = "roles array<string>, texts array<string>, at array<int>, initials array<string>, must array<boolean>, cuts array<boolean>"
EDIT = "array<struct<edit:string,role:string,text:string>>"


def _pieces(conv_type: str, with_edits: bool) -> tuple:
    """Function and schema of the pass over sorted turns: finished conversations, and open pieces with their matrices."""
    schema = f"conv_id {conv_type}, part int, seq int, open boolean, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string, edits {EDIT}, distinct_turns long, first_turn long, last_turn long, first string, last string, {MATRIX}, {KEPT}"

    def make(part: int, rows: Iterator[dict]) -> Iterator[dict]:
        layers = Layers()
        piece, seq, began_at_start = None, 0, True

        def close(p: Piece, whole: bool) -> dict:
            out = {"conv_id": p.conv, "part": part, "seq": seq, "open": not whole, "blank": p.blank, "duplicate": p.duplicate, "truncated": p.truncated, "illegal": p.illegal}
            if whole:
                passed, cost = layers.run(p.turns, NOTHING)
                leave, more = ending({s: x for s, x in enumerate(layers.layers[passed[-1]]) if x is not None})
                audit, made = p.written(layers, NOTHING, passed, leave, TAIL[leave])
                gaps = 0 if p.first_turn is None else p.last_turn - p.first_turn + 1 - p.distinct
                return out | {"gaps": gaps, "cost": cost + more, "audit": audit, "repaired_sha256": _sha("\n".join(body(made))), "edits": [dict(zip(("edit", "role", "text"), x, strict=True)) for x in made] if with_edits else None}
            costs, ranks = [], []
            for entry in range(4):
                passed, cost = layers.run(p.turns, entry)
                for x in layers.layers[passed[-1]]:
                    costs.append(None if x is None else cost + x[0])
                    ranks.append(None if x is None else x[1])
            return out | {
                "distinct_turns": p.distinct, "first_turn": p.first_turn, "last_turn": p.last_turn, "first": p.first, "last": p.last, "costs": costs, "ranks": ranks,
                "roles": [r for r, _ in p.rows], "texts": [t for _, t in p.rows], "at": p.at, "initials": [t[0] for t in p.turns], "must": [t[1] for t in p.turns], "cuts": [t[2] for t in p.turns],
            }

        cut = False
        for r, is_last in with_last(rows):
            if piece is not None and r["conv_id"] != piece.conv:
                yield close(piece, not (began_at_start or cut))
                piece, cut, began_at_start = None, False, False
                seq += 1
            elif piece is not None and (len(piece.turns) >= PIECE or piece.chars >= PIECE_CHARS):
                yield close(piece, False)
                piece, cut = None, True
                seq += 1
            piece = piece or Piece(r["conv_id"])
            piece.add(r)
            if is_last:
                yield close(piece, False)

    return make, schema


def _folded(conv_type: str) -> tuple:
    """Function and schema of the pass over a conversation's matrices, in order: where each piece is entered and left."""
    schema = f"conv_id {conv_type}, part int, seq int, entry int, leave int, tail int, {', '.join(f'{c} long' for c in COUNTS)}"

    def solve(pieces: list[dict]) -> Iterator[dict]:
        now, back = {NOTHING: (0, 0)}, []
        for p in pieces:
            best: dict[int, tuple] = {}
            for m, (cost, rank) in now.items():
                for t in range(4):
                    if p["costs"][4 * m + t] is not None:
                        best[t] = min(best.get(t, (1 << 60,)), (cost + p["costs"][4 * m + t], rank, p["ranks"][4 * m + t], m))
            order = sorted({b[1:3] for b in best.values()})
            back.append({t: b[3] for t, b in best.items()})
            now = {t: (b[0], order.index(b[1:3])) for t, b in best.items()}
        leave, cost = ending(now)
        totals = {c: sum(p[c] for p in pieces) for c in ("blank", "duplicate", "truncated", "illegal")} | {"cost": cost}
        with_rows = [p for p in pieces if p["first"] is not None]
        totals["illegal"] += sum(x["last"] + y["first"] not in LEGAL for x, y in zip(with_rows, with_rows[1:], strict=False))
        timed = [p for p in pieces if p["first_turn"] is not None]
        distinct = sum(p["distinct_turns"] for p in timed) - sum(x["last_turn"] == y["first_turn"] for x, y in zip(timed, timed[1:], strict=False))
        totals["gaps"] = timed[-1]["last_turn"] - timed[0]["first_turn"] + 1 - distinct if timed else 0
        found = []
        tail = TAIL[leave]
        for p, parents in zip(reversed(pieces), reversed(back), strict=True):
            found.append({"conv_id": p["conv_id"], "part": p["part"], "seq": p["seq"], "entry": parents[leave], "leave": leave, "tail": tail} | totals)
            leave, tail, totals = parents[leave], 0, {}
        yield from reversed(found)

    def make(_part: int, rows: Iterator[dict]) -> Iterator[dict]:
        held: list[dict] = []
        for r in rows:
            if held and held[0]["conv_id"] != r["conv_id"]:
                yield from solve(held)
                held = []
            held.append(r)
        if held:
            yield from solve(held)

    return make, schema


def _spelled(conv_type: str, with_edits: bool) -> tuple:
    """Function and schema: the edits of each open piece, now that its states are known."""
    schema = f"conv_id {conv_type}, part int, seq int, audit string, body string, lines int, edits {EDIT}, {', '.join(f'{c} long' for c in COUNTS)}"

    def make(_part: int, rows: Iterator[dict]) -> Iterator[dict]:
        layers = Layers()
        for r in rows:
            turns = list(zip(r["initials"], r["must"], r["cuts"], strict=True))
            passed, _ = layers.run(turns, r["entry"])
            codes, _ = layers.codes(turns, passed, r["leave"])
            kept = [(r["roles"][i], r["texts"][i]) for i in r["at"]]
            audit, made = told(turns, kept, codes, r["entry"], r["tail"])
            lines = body(made)
            yield {c: r[c] for c in ("conv_id", "part", "seq", *COUNTS)} | {"audit": audit, "body": "\n".join(lines), "lines": len(lines), "edits": [dict(zip(("edit", "role", "text"), x, strict=True)) for x in made] if with_edits else None}

    return make, schema


def _joined(conv_type: str) -> tuple:
    """Function and schema: audit and running hash of a conversation, over its pieces in order."""
    schema = f"conv_id {conv_type}, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string"

    def make(_part: int, rows: Iterator[dict]) -> Iterator[dict]:
        audit, sha, any_line = [], hashlib.sha256(), False
        for r in rows:
            audit.append(r["audit"])
            if r["lines"]:
                sha.update((("\n" if any_line else "") + r["body"]).encode("utf-8", "surrogatepass"))
                any_line = True
            if r["cost"] is not None:  # the last piece carries the sums
                yield {c: r[c] for c in ("conv_id", *COUNTS)} | {"audit": "".join(audit), "repaired_sha256": sha.hexdigest()}
                audit, sha, any_line = [], hashlib.sha256(), False

    return make, schema


def _sorted_turns(rows: DataFrame, gone: str | None) -> DataFrame:
    """Turns in order with their faults; ``n`` copies of equal rows are one, n = 0 only names a conversation."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    away: Column = F.coalesce(F.col(gone), F.lit(False)) if gone else F.lit(False)
    named = rows.select("conv_id", F.when(~away, F.col("turn").cast("long")).alias("turn"), F.when(~away, one("role")).alias("role"), F.when(~away, one("text")).alias("text"), away.alias("away"))
    counted = named.groupBy("conv_id", "turn", "role", "text").agg(F.sum((~F.col("away")).cast("long")).alias("n"))
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    keyed = counted.withColumn("key", F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)))
    again = keyed.filter(F.col("n") > 0).groupBy("conv_id", "key").agg(F.count(F.lit(1)).alias("places"), F.max(F.col("turn").isNull()).alias("untimed"), F.min("turn").alias("from_turn")).filter(F.col("places") > 1)
    k, a = keyed.alias("k"), again.alias("a")
    late = F.when(F.col("a.untimed"), F.col("k.turn").isNotNull()).otherwise(F.coalesce(F.col("k.turn") > F.col("a.from_turn"), F.lit(False)))
    bare = F.rtrim(text, F.lit(SPACE))
    marked = k.join(a, F.col("k.conv_id").eqNullSafe(F.col("a.conv_id")) & (F.col("k.key") == F.col("a.key")), "left").select(
        "k.conv_id", "k.turn", role.alias("role"), text.alias("text"), "k.n", "k.key", late.alias("late"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?") & (bare != "")).alias("cut")
    )
    return ranged(marked, "conv_id", "turn", "role", "key").drop("key")


def _solved(rows: DataFrame, gone: str | None, with_edits: bool) -> tuple[DataFrame, DataFrame, str]:
    """Finished conversations and the spelled pieces of the others."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    pieces = written(streamed(_sorted_turns(rows, gone), *_pieces(kind, with_edits)), "repair-pieces")
    whole, parts = pieces.filter(~F.col("open")), pieces.filter("open")
    small = parts.select("conv_id", "part", "seq", "blank", "duplicate", "truncated", "illegal", "distinct_turns", "first_turn", "last_turn", "first", "last", "costs", "ranks")
    states = streamed(small.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq"), *_folded(kind)).drop("conv_id")
    known = parts.select("conv_id", "part", "seq", "roles", "texts", "at", "initials", "must", "cuts").join(states, ["part", "seq"])
    return whole, streamed(known, *_spelled(kind, with_edits)), kind


def repair(rows: DataFrame, gone: str | None = None) -> DataFrame:
    """One row a conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Rows marked ``gone`` only name theirs."""
    whole, parts, kind = _solved(rows, gone, False)
    joined = streamed(parts.drop("edits").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq"), *_joined(kind))
    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
    return whole.select(*names).unionByName(joined.select(*names))


def repaired_turns(rows: DataFrame, gone: str | None = None) -> DataFrame:
    """Every edit with its result, one row each: conv_id, (part, seq, at) in order, edit, role, text; deleted turns too."""
    whole, parts, _ = _solved(rows, gone, True)
    every = whole.select("conv_id", "part", "seq", "edits").unionByName(parts.select("conv_id", "part", "seq", "edits"))
    return every.select("conv_id", "part", "seq", F.posexplode("edits").alias("at", "e")).select("conv_id", "part", "seq", "at", "e.edit", "e.role", "e.text")
