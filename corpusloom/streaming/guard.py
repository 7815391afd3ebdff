"""A guard on token streams: what leaves has no price and no dose that the sources lack.

An answer is one text that grows. What may leave of it is a function of the text so far,
not of the pieces in which it came: nothing before its first letter; up to ``LOOK_BEHIND``
characters before its first digit or currency mark; from there to the end of the sentence
as one span, cleaned; without either, all but the last ``LOOK_BEHIND`` characters.

An attempt that ends without a letter is asked for once more (state ``retry``), and after
``ATTEMPTS`` answered by the no-guidance message. Structured Streaming keeps an answer's
text and removes it when the answer is done, or, if asked to, when no piece has come for a time.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import fixed as X
from ..session import ship

LOOK_BEHIND, ATTEMPTS = 24, 2
_python = lambda p: re.compile(p.replace("(?<dose>", "(?P<dose>"))
DOSES, MONEY, RISKY = [_python(p) for p in X.DOSAGE_PATTERNS], re.compile(X.MONEY), re.compile(r"\d|(?:" + X.MONEY_MARK.removeprefix("(?i)") + ")", re.IGNORECASE)
ENDS, CITATIONS = re.compile(r"[.!?]\s|\n"), re.compile(X.CITATION_RUN)


def squeezed(text: str) -> str:
    return re.sub(r"[\s,]+", "", text.lower())


def released(span: str, sources: str) -> str:
    """``span`` without money and without doses that the squeezed sources lack."""
    gone = {amount: X.MONEY_REDACTION for amount in MONEY.findall(span)}
    for rx in DOSES:
        named = [(m["dose"] if "dose" in rx.groupindex else m[0]).strip() for m in rx.finditer(span)]
        gone |= {dose: X.DOSE_GONE for dose in named if squeezed(dose) not in sources}
    for said, instead in gone.items():
        span = span.replace(said, instead)
    return span


def settled(text: str, sources: str) -> tuple[str, int]:
    """What may leave of ``text``, and how much of it that settles."""
    out, at = [], 0
    while risk := RISKY.search(text, at):
        safe = max(at, risk.start() - LOOK_BEHIND)
        out.append(text[at:safe])
        end = ENDS.search(text, risk.start())
        if end is None:
            return "".join(out), safe
        out.append(released(text[safe : end.end()], sources))
        at = end.end()
    safe = max(at, len(text) - LOOK_BEHIND)
    return "".join([*out, text[at:safe]]), safe


@dataclass
class Guard:
    """One answer. ``waiting``: pieces before their turn, by attempt and place."""

    sources: str = ""
    text: str = ""
    spoken: bool = False
    attempt: int = 0
    turn: int = 0
    taken: int = 0
    state: str = "more"
    waiting: dict[str, list] = field(default_factory=dict)

    def feed(self, piece: str) -> str:
        self.text += piece
        if not self.spoken:
            self.spoken = any(map(str.isalpha, self.text))
            if not self.spoken:
                return ""
            self.text = CITATIONS.sub("", self.text, count=1).lstrip() or self.text
        out, upto = settled(self.text, self.sources)
        self.text = self.text[upto:]
        return out

    def close(self, no_guidance: str = X.NO_GUIDANCE_MESSAGE) -> str:
        """The end of the last attempt."""
        self.state = "done"
        out, self.text = released(self.text, self.sources) if self.spoken else no_guidance, ""
        return out

    def take(self, seq: int, piece: str, last: bool, attempt: int = 0, attempts: int = 1) -> str:
        """A piece, in any order; what its turn lets out."""
        self.put(seq, piece, last, attempt)
        return self.drained(attempts)

    def put(self, seq: int, piece: str, last: bool, attempt: int = 0) -> None:
        """A piece that waits for its turn, unless it came before."""
        if self.state != "done" and (attempt, seq) >= (self.attempt, self.turn):
            self.waiting.setdefault(f"{attempt}:{seq}", [piece, last])

    def drained(self, attempts: int = 1) -> str:
        """What the pieces whose turn it is let out; those that follow each other are looked at as one."""
        out, run = "", []
        while self.state != "done" and (came := self.waiting.pop(f"{self.attempt}:{self.turn}", None)):
            self.turn, self.taken, self.state = self.turn + 1, self.taken + 1, "more"
            run.append(came[0])
            if came[1]:
                out, run = out + self.feed("".join(run)), []
                if not self.spoken and self.attempt + 1 < attempts:
                    self.attempt, self.turn, self.text, self.state = self.attempt + 1, 0, "", "retry"
                else:
                    out += self.close()
        return out + (self.feed("".join(run)) if run else "")


RESULT = "answer_id string, upto int, text string, state string"


def guarded(pieces: DataFrame, attempts: int = ATTEMPTS, patience_ms: int | None = None) -> DataFrame:
    """Released text of each answer, in order of ``upto``; state is ``more``, ``done``, or ``retry`` where another attempt is wanted.

    ``pieces``: a stream of answer_id, seq (from 0), piece, is_last, sources, and attempt (from 0) where
    the generator can be asked again; without that column the first attempt is the last. Pieces may come
    in any order and more than once. An answer from which nothing has come for ``patience_ms`` is closed;
    this needs a trigger that goes on (timeouts in processing time keep ``availableNow`` from ending).
    """
    ship(pieces.sparkSession)
    most = attempts if "attempt" in pieces.columns else 1

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        guard = Guard(**json.loads(state.get[0])) if state.exists else Guard()
        before, out = (guard.taken, guard.state), ""
        if state.hasTimedOut:
            out = guard.close()
        else:
            for batch in batches:
                attempt = batch["attempt"].tolist() if most > 1 else [0] * len(batch)
                for said, seq, piece, last, n in sorted(zip(batch["sources"].tolist(), batch["seq"].tolist(), batch["piece"].tolist(), batch["is_last"].tolist(), attempt, strict=True), key=lambda r: r[1]):
                    guard.sources = guard.sources or squeezed(said or "")
                    guard.put(int(seq), piece or "", bool(last), int(n))
                out += guard.drained(most)
        if guard.state == "done":
            state.remove()
        else:
            state.update((json.dumps(asdict(guard)),))
            if patience_ms:
                state.setTimeoutDuration(patience_ms)
        if out or (guard.state != "more" and (guard.taken, guard.state) != before):
            yield pd.DataFrame({"answer_id": [key[0]], "upto": [guard.taken], "text": [out], "state": [guard.state]})

    return pieces.groupBy("answer_id").applyInPandasWithState(step, RESULT, "guard string", "append", GroupStateTimeout.ProcessingTimeTimeout if patience_ms else GroupStateTimeout.NoTimeout)
