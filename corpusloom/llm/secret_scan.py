"""Secret scans: fixed shapes and sliding-window entropy, as native expressions.

Base kinds (assign, access, hex) are fixed shapes, leftmost and non-overlapping
each. The method adds, for each character class, stretches of candidate strings
in which some window of fixed width has a Shannon entropy over the class's
threshold. The window slides over a candidate with one count a symbol: a step
adds one character, drops one, and moves the sum of c * log2(c) by those two
counts alone. Candidates on the allow-list (fillers, plain numbers, ...) are let
go; the base kinds are not.

The query and the pipeline use ``scan_all``: it has ``ALL_CLASSES``, and fillers let go only the run of letters
and digits that they are in, so that one in a long path or blob hides no other part of it. The SQL twin states the same.

A span is kind, start, end in code points, end exclusive. Positions come from
the lengths of what lies between matches, so a text is never cut.

Edge cases: null text is empty; an empty text has no spans; texts of any length
are scanned whole, in time proportional to length; equal spans of two kinds are both kept; repeated rows are
scanned one by one; other columns pass through ``scan`` untouched, but for one
named like its result, which is replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shapes of the base kinds (fixed values): pattern, group whose length counts, least length.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
#: Candidates that are no secrets (fixed values): plain numbers, words in one case, fillers, published examples.
ALLOWED = (
    r"^[0-9]+$",
    r"^[a-z_/+-]+$",
    r"^[A-Z_/+-]+$",
    r"(?i)example|placeholder|changeme|dummy|sample|redacted|your[_-]",
    r"(?i)0123456789|abcdefgh|deadbeef|(.)\1{7}",
)


@dataclass(frozen=True)
class CharClass:
    """A character class: its candidates, its symbols (after folding to lower case, if ``fold``), width and threshold in bits."""

    kind: str
    pattern: str
    symbols: str
    width: int
    bits: float
    fold: bool = False
    needs: tuple[str, ...] = ()


DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
CLASSES = (
    CharClass("entropy_hex", r"(?<![A-Za-z0-9])[0-9A-Fa-f]{20,}(?![A-Za-z0-9])", DIGITS + "abcdef", 20, 2.905, fold=True, needs=("[0-9]", "[A-Fa-f]")),
    CharClass("entropy_upper", r"(?<![A-Za-z0-9])[A-Z0-9]{16,}(?![A-Za-z0-9])", DIGITS + LOWER.upper(), 16, 3.005, needs=("[0-9]", "[A-Z]")),
    CharClass("entropy_base64", r"[A-Za-z0-9+/_-]{20,}", DIGITS + LOWER + LOWER.upper() + "+/_-", 20, 3.605, needs=("[0-9]", "[a-z]", "[A-Z]")),
)
#: Also tokens that none of those takes: lower-case letters with digits, letters of both cases without.
ALL_CLASSES = (
    *CLASSES,
    CharClass("entropy_lower", r"(?<![A-Za-z0-9])[a-z0-9]{20,}(?![A-Za-z0-9])", DIGITS + LOWER, 20, 3.405, needs=("[0-9]", "[g-z]")),
    CharClass("entropy_letters", r"(?<![A-Za-z0-9])[A-Za-z]{20,}(?![A-Za-z0-9])", LOWER + LOWER.upper(), 20, 3.58, needs=("[a-z][A-Z].*[a-z][A-Z]", "[A-Z][a-z]?[A-Z].*[A-Z][a-z]?[A-Z]")),
)
#: Of the allow-list what holds for a candidate as a whole, with the published example that its filler does not reach, and the fillers.
WHOLE = (*ALLOWED[:3], r"^wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY$")
FILLERS = ALLOWED[3:]
#: Matches whose spans are collected at once.
RUN = 256
SPAN = "struct<start:int,rank:int,end:int,kind:string>"


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _placed(text: Column, pattern: str, group: int, keep) -> Column:
    """Spans of the matches of ``pattern``; keep(match, group's text, start) gives a span or null.

    Arrays grow by copying, so spans collect in runs of ``RUN`` matches: the cost of a text goes with its matches, not with their square.
    """
    rx = F.lit(pattern)

    def place(matches: Column, between: Column, groups: Column) -> Column:
        none = F.array().cast(f"array<{SPAN}>")

        def step(state: Column, i: Column) -> Column:
            m = F.get(matches, i)
            begin = state["at"] + F.length(F.get(between, i))
            made = keep(m, F.get(groups, i), begin)
            return F.struct((begin + F.length(m)).alias("at"), F.when(made.isNotNull(), F.concat(state["spans"], F.array(made))).otherwise(state["spans"]).alias("spans"))

        def run(state: Column, k: Column) -> Column:
            some = F.aggregate(F.sequence(k * RUN, F.least((k + 1) * RUN, F.size(matches)) - 1), F.struct(state["at"].alias("at"), none.alias("spans")), step)
            return _let(some, lambda s: F.struct(s["at"].alias("at"), F.concat(state["runs"], F.array(s["spans"])).alias("runs")))

        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("runs"))
        return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / RUN).cast("int")), start, run, lambda s: F.flatten(s["runs"]))

    found = _let(F.regexp_extract_all(text, rx, F.lit(0)), lambda m: _let(F.split(text, pattern, -1), lambda b: _let(F.regexp_extract_all(text, rx, F.lit(group)) if group else m, lambda g: place(m, b, g))))
    return F.when(F.rlike(text, rx), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def _span(start: Column, rank: int, end: Column, kind: str) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(rank).alias("rank"), end.cast("int").alias("end"), F.lit(kind).alias("kind"))


def base_spans(text: Column, kind: str, rank: int) -> Column:
    pattern, group, least = BASE[kind]
    return _placed(text, pattern, group, lambda m, g, at: F.when(F.length(g) >= least, _span(at, rank, at + F.length(m), kind)))


def _unfilled(candidate: Column, fillers: tuple[str, ...]) -> Column:
    """``candidate`` with a line feed for each character of the runs of letters and digits that a filler touches.

    A run is tried from its start alone and passed once, whatever its length.
    """
    some = "|".join(f"(?:{f})" for f in fillers)
    rx = f"(?<![A-Za-z0-9])[A-Za-z0-9]*?(?:{some})[A-Za-z0-9]*+"
    gap = lambda marks, i: F.repeat(F.lit("\n"), F.coalesce(F.length(F.get(marks, i)), F.lit(0)))
    blanked = _let(F.regexp_extract_all(candidate, F.lit(rx), F.lit(0)), lambda marks: F.array_join(F.transform(F.split(candidate, rx, -1), lambda b, i: F.concat(b, gap(marks, i))), ""))
    return F.when(F.rlike(candidate, F.lit(some)), blanked).otherwise(candidate)


def _hot(candidate: Column, c: CharClass, gaps: bool = False) -> Column:
    """First start and last end (from 0) of the windows over the threshold, null without any; with ``gaps``, a window with a line feed is none.

    Counts are a string with one character a symbol, so that a step replaces two characters of it.
    """
    n_log_n = lambda x: x * math.log2(x) if x else 0.0
    growth = F.array(*(F.lit(n_log_n(x + 1) - n_log_n(x)) for x in range(c.width + 1)))

    def slide(symbols: Column) -> Column:
        begin = F.struct(F.repeat(F.lit("0"), F.lit(len(c.symbols))).alias("counts"), F.lit(0.0).alias("sum"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), *([F.lit(-1).alias("gap")] if gaps else []))

        def step(s: Column, i: Column) -> Column:
            came, left = F.get(symbols, i), F.when(i >= c.width, F.get(symbols, i - c.width)).otherwise(F.lit(0))
            count = lambda counts, k: F.ascii(F.substr(counts, k, F.lit(1))) - 48
            more = lambda counts, k, by: F.when(k > 0, F.overlay(counts, F.chr(count(counts, k) + (48 + by)), k, F.lit(1))).otherwise(counts)
            gain = F.when(came > 0, F.get(growth, count(s["counts"], came))).otherwise(F.lit(0.0))
            loss = F.when(left > 0, F.get(growth, count(s["counts"], left) - 1)).otherwise(F.lit(0.0))
            moved = F.when(came == left, s["sum"]).otherwise(s["sum"] + gain - loss)
            counts = F.when(came == left, s["counts"]).otherwise(more(more(s["counts"], came, 1), left, -1))
            if gaps:
                over_gap = F.when(came == 0, i).otherwise(s["gap"])
            over = ((i - over_gap >= c.width) if gaps else (i >= c.width - 1)) & (F.log2(F.lit(float(c.width))) - moved / c.width >= c.bits)
            return F.struct(counts.alias("counts"), moved.alias("sum"), F.when(over, F.coalesce(s["start"], i - (c.width - 1))).otherwise(s["start"]).alias("start"), F.when(over, i + 1).otherwise(s["end"]).alias("end"), *([over_gap.alias("gap")] if gaps else []))

        return F.aggregate(F.sequence(F.lit(0), F.size(symbols) - 1), begin, step, lambda s: F.when(s["start"].isNotNull(), F.struct(s["start"], s["end"])))

    return _let(F.transform(F.split(F.lower(candidate) if c.fold else candidate, ""), lambda x: F.instr(F.lit(c.symbols), x)), slide)


def entropy_spans(text: Column, c: CharClass, rank: int, allowed=ALLOWED, fillers=()) -> Column:
    def keep(m: Column, _g: Column, at: Column) -> Column:
        ok = F.lit(True)
        for need in c.needs:
            ok = ok & F.rlike(m, F.lit(need))
        for rx in allowed:
            ok = ok & ~F.rlike(m, F.lit(rx))
        return F.when(ok, _let(_hot(_unfilled(m, fillers), c, True) if fillers else _hot(m, c), lambda h: F.when(h.isNotNull(), _span(at + h["start"], rank, at + h["end"], c.kind))))

    return _placed(text, c.pattern, 0, keep)


def scan(documents: DataFrame, text: str = "text", classes=CLASSES, allowed=ALLOWED, out: str = "secrets", fillers=()) -> DataFrame:
    """``documents`` with the column ``out``: array of (start, rank, end, kind), by start, then kind in the order listed."""
    whole = F.coalesce(F.col(text), F.lit(""))
    arrays = [base_spans(whole, kind, i) for i, kind in enumerate(BASE)] + [entropy_spans(whole, c, len(BASE) + i, allowed, fillers) for i, c in enumerate(classes)]
    return documents.withColumn(out, F.array_sort(F.concat(*arrays)))


def scan_all(documents: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """``scan`` with all classes, fillers taken by themselves."""
    return scan(documents, text, ALL_CLASSES, WHOLE, out, FILLERS)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every stretch that spans cover replaced by one mark; ``spans`` in order of start."""

    def step(s: Column, x: Column) -> Column:
        fresh = x["start"] >= s["at"]
        out = F.when(fresh, F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mark))).otherwise(s["out"])
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), out.alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.when(F.size(spans) > 0, F.aggregate(spans, begin, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))).otherwise(text)
