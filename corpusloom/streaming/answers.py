"""The guard as a stateful processor with timers: text, end and speed of each answer of a token stream.

Tokens of an answer that are read together come to its state as one row (``packed``), which is as late as the last of them.

State of an answer: the guard with its clock and timer as one value, pieces before their turn as a map, which is asked only where there are some. In event time a timer
stands ``patience`` after an answer's last token: when the watermark passes it, an answer that fell silent is closed with what it said, and one that had ended is
forgotten; until then its repeats are known. This needs no wall clock, so it also happens in the last batch of ``availableNow``. In processing time the timer runs by the
clock, and state also has that time to live.

An ended answer's row has its number of tokens (pieces, repeats not counted, of all attempts), the milliseconds from question to first token, and tokens a
second from the first to the last (null for one).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import fields

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..session import ship
from .guard import ATTEMPTS, Guard, squeezed

RESULT = "answer_id string, upto int, text string, state string, tokens long, first_ms long, per_second double"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEPT = [f.name for f in fields(Guard) if f.name != "waiting"]
PACKED = "answer_id string, sources string, asked long, ts timestamp, attempt array<int>, seq array<int>, piece array<string>, last array<boolean>, ms array<long>"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        ids = b.column("answer_id").dictionary_encode(null_encoding="encode").indices.to_numpy()
        key = lambda c: pc.fill_null(b.column(c), 0).to_numpy()
        order = np.lexsort((key("seq"), key("attempt"), ids))
        t = b.take(pa.array(order))
        starts = np.flatnonzero(np.r_[True, np.diff(ids[order]) != 0])
        ends = pa.array(np.r_[starts, b.num_rows], pa.int32())

        def first(column: pa.Array, good: pa.Array, starts: np.ndarray = starts, n: int = b.num_rows) -> pa.Array:
            """Each answer's first value that is good, else null."""
            at = np.minimum.reduceat(np.where(pc.fill_null(good, False).to_numpy(zero_copy_only=False), np.arange(n), n), starts)
            return column.take(pa.array(at, mask=at == n))

        ms = lambda c: pc.floor(pc.divide(pc.cast(t.column(c).cast(pa.int64()), pa.float64()), 1000.0)).cast(pa.int64())
        asked, sources, ts = ms("asked"), t.column("sources"), t.column("ts")
        none = np.iinfo(np.int64).min
        latest = np.maximum.reduceat(pc.fill_null(ts.cast(pa.int64()), none).to_numpy(), starts)
        lists = [pa.ListArray.from_arrays(ends, c) for c in (t.column("attempt"), t.column("seq"), t.column("piece"), t.column("is_last"), ms("ts"))]
        columns = [t.column("answer_id").take(pa.array(starts)), first(sources, pc.match_substring_regex(sources, r"[^\s,]")), first(asked, asked.is_valid()), pa.array(latest, pa.int64(), mask=latest == none).cast(ts.type), *lists]
        yield pa.RecordBatch.from_arrays(columns, names=["answer_id", "sources", "asked", "ts", "attempt", "seq", "piece", "last", "ms"])


def packed(tokens: DataFrame) -> DataFrame:
    """A row for the tokens of an answer that one batch of Arrow holds: its lists in order of attempt and place, ts: the latest."""
    return tokens.select("answer_id", "attempt", "seq", "piece", "is_last", "sources", "asked", "ts").mapInArrow(_packed, PACKED)


class Answers(StatefulProcessor):
    def __init__(self, attempts: int, patience_ms: int, event_time: bool):
        self.attempts, self.patience, self.event_time = attempts, patience_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        live = None if self.event_time else 4 * self.patience
        self.handle = handle
        self.kept = handle.getValueState("kept", "guard string, asked long, first long, last long, tokens long, early int, timer long", live)
        self.early = handle.getMapState("early", "place string", "piece string, last boolean", live)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.kept.get()
        guard, asked, first, last, tokens, early, timer = held or (None, None, None, None, 0, 0, None)
        g = Guard(**json.loads(guard)) if guard else Guard()
        if g.state == "done":
            for _ in rows:
                pass
            return
        before = {k[0]: v for k, v in self.early.iterator()} if early else {}
        g.waiting = {k: [v[0], v[1]] for k, v in before.items()}
        had, out = (g.taken, g.state), ""
        for r in sorted(rows, key=lambda r: (r.attempt[0] or 0, r.seq[0] or 0)):
            g.sources = g.sources or squeezed(r.sources or "")
            asked, waits = r.asked if asked is None else asked, bool(g.waiting)
            for attempt, seq, piece, end, ts in zip(r.attempt, r.seq, r.piece, r.last, r.ms, strict=True):
                attempt, seq = int(attempt), int(seq)
                if g.state != "done" and (attempt, seq) >= (g.attempt, g.turn) and f"{attempt}:{seq}" not in g.waiting:
                    tokens += 1
                    if ts is not None:
                        first, last = ts if first is None else min(first, ts), ts if last is None else max(last, ts)
                    g.put(seq, piece or "", bool(end), attempt)
                    if end or waits:  # it may end here, and what comes after the end does not count
                        out += g.drained(self.attempts)
            out += g.drained(self.attempts)
        if g.state == "done":
            g.sources = ""
        for place in before.keys() - g.waiting.keys():
            self.early.removeKey((place,))
        for place in g.waiting.keys() - before.keys():
            self.early.updateValue((place,), tuple(g.waiting[place]))
        now = last if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        due = None if now is None else now + self.patience
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        self.kept.update((json.dumps({k: getattr(g, k) for k in KEPT}), asked, first, last, tokens, len(g.waiting), due))
        if out or (g.state != "more" and (g.taken, g.state) != had):
            yield self._row(key, g, out, g.state, (asked, first, last, tokens))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.kept.get()
        if held:
            g = Guard(**json.loads(held[0]))
            if g.state != "done":
                yield self._row(key, g, g.close(), "silent", held[1:5])
            if held[5]:
                self.early.clear()
            self.kept.clear()

    def close(self) -> None:
        """Nothing is held outside of the state."""

    @staticmethod
    def _row(key, g: Guard, text: str, state: str, clock: tuple) -> Row:
        asked, first, last, tokens = clock
        ended = state in ("done", "silent")
        wait = first - asked if ended and first is not None and asked is not None else None
        speed = 1000.0 * (tokens - 1) / (last - first) if ended and first is not None and last > first else None
        return Row(answer_id=key[0], upto=g.taken, text=text, state=state, tokens=tokens if ended else None, first_ms=wait, per_second=speed)


def ready(spark: SparkSession) -> None:
    """State variables need the RocksDB state store."""
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def answered(tokens: DataFrame, patience: str = "30 seconds", late: str = "10 seconds", attempts: int = ATTEMPTS, event_time: bool = True) -> DataFrame:
    """Released text of each answer in order of ``upto`` (state more, retry, done, or silent where it was closed), from a stream as ``token_log`` has it."""
    spark = tokens.sparkSession
    ready(spark)
    ms = int(pd.Timedelta(patience).total_seconds() * 1000)
    processor = Answers(attempts, ms, event_time)
    given = packed(tokens)
    given = given.withWatermark("ts", late) if event_time else given
    return given.groupBy("answer_id").transformWithState(processor, RESULT, "append", "EventTime" if event_time else "ProcessingTime")
