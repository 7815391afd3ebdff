"""Text as column expressions: tokens, stems, cleaning, sentences, citations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X

CHARS_PER_TOKEN = 3.5
BLANKS = r"(?U)\s+"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space of any kind at either end (the built-in trim knows the blank only)."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def words(text: Column) -> Column:
    """Pieces between runs of white space."""
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def matches(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit(pattern))


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def tokens(text: Column) -> Column:
    """Lower-case search tokens without stop words."""
    return F.filter(find_all(F.lower(text), X.TOKEN), lambda t: ~t.isin(*X.STOPWORDS))


def stem(token: Column) -> Column:
    """Less the longest suffix that leaves four letters; a doubled last consonant of over four letters becomes one.

    Two patterns, so that it stays inside generated code: the mark "#", which no
    token has, stands for a suffix taken off until the second has run.
    """
    cut = F.regexp_replace(token, f"^(.{{4,}}?)(?:{'|'.join(X.SUFFIXES)})$", "$1#")
    return F.translate(F.regexp_replace(cut, r"^(.{3,}([^aeiou]))\2#$", "$1"), "#", "")


def terms(text: Column) -> Column:
    return F.transform(tokens(text), stem)


def clean(text: Column) -> Column:
    """Words broken at a line end are joined, blanks and blank lines collapsed."""
    text = F.regexp_replace(text, r"(?U)(\w)-\n(\w)", "$1$2")
    text = F.regexp_replace(text, r"[ \t ]+", " ")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def clean_lines(text: Column) -> Column:
    """Lines of one or two words go; blank lines stay, two at most in a row."""
    lines = F.transform(F.split(F.regexp_replace(text, r"[ \t ]+", " "), "\n", -1), strip)
    kept = F.filter(lines, lambda x: (x == "") | (F.size(words(x)) > 2))
    return strip(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))


def strip_boilerplate(text: Column) -> Column:
    """An archive page's lines without markup left-overs, furniture, credits, the tail and long repeats."""
    for pattern, new in ((X.BBCODE, ""), (X.LITERAL_TAG, ""), (" ", " "), (X.LITERAL_ESCAPE, " ")):
        text = F.regexp_replace(text, pattern, new)
    lines = F.filter(F.transform(F.split(text, "\n", -1), strip), lambda x: ~F.lower(x).isin(*X.BOILERPLATE_LINES))

    def unlabelled(line: Column) -> Column:
        for label in X.FIELD_NAMES:
            line = let(line, without(label))
        return line

    def without(label: str):
        return lambda x: F.when(F.startswith(F.lower(x), F.lit(label)), F.regexp_replace(F.substring(x, F.lit(len(label) + 1), F.length(x)), r"^[ .:\-]+|[ .:\-]+$", "")).otherwise(x)

    lines = F.filter(F.transform(lines, unlabelled), lambda x: x != "")
    tail = lambda x: reduce(lambda a, b: a | b, (F.startswith(F.lower(x), F.lit(m)) for m in X.TAIL_MARKERS))
    upto = let(lines, lambda ls: let(F.array_position(F.transform(ls, tail), F.lit(True)), lambda at: F.when(at > 0, F.slice(ls, F.lit(1), (at - 1).cast("int"))).otherwise(ls)))
    kept = F.filter(upto, lambda x: ~matches(x, X.CREDIT_LINE))
    return F.array_join(unique_long_lines(kept), "\n")


def unique_long_lines(lines: Column) -> Column:
    """Lines of 80 characters and more once each, by their first 200 letters and digits; shorter ones stay."""
    key = lambda x: F.substring(F.regexp_replace(F.lower(x), r"(?U)\W+", ""), 1, 200)
    named = lambda x, i: F.struct(F.when(F.length(x) < 80, F.concat(F.lit("#"), i.cast("string"))).otherwise(F.concat(F.lit("="), key(x))).alias("k"), i.alias("i"))
    first = lambda ks: F.filter(ks, lambda x, j: (j == 0) | (F.get(ks, j - 1)["k"] != x["k"]))  # noqa: E731  of lines in order of key, then place
    return let(lines, lambda ls: let(F.array_sort(F.transform(ls, named)), lambda ks: F.transform(F.array_sort(F.transform(first(ks), lambda x: x["i"])), lambda i: F.get(ls, i))))


def strip_furniture(text: Column, title: Column) -> Column:
    """Captions, repeats of a long title, web phrases and bare page numbers go; white space collapses."""
    out = F.regexp_replace(text, X.CAPTION, " ")

    def once(t: Column) -> Column:
        at = F.instr(t, title)
        head = F.left(t, at + F.length(title) - 1)
        rest = F.substring(t, at + F.length(title), F.length(t))
        return F.when((F.length(title) > 12) & (at > 0), F.concat(head, F.replace(rest, title, F.lit(" ")))).otherwise(t)

    out = let(out, once)
    out = F.regexp_replace(F.regexp_replace(out, X.WEB_FURNITURE, " "), X.PAGE_NUMBER, " ")
    return strip(F.regexp_replace(out, r"(?U)\s{2,}", " "))


def sentences(text: Column) -> Column:
    """Sentences; one of up to three words belongs to that before it."""
    parts = F.filter(F.transform(F.split(text, X.SENTENCE), strip), lambda s: s != "")

    def joined(ps: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(ps) - 1), lambda i: (i == 0) | (F.size(words(F.get(ps, i))) > 3))
        return let(starts, lambda at: F.transform(at, lambda i, j: F.array_join(F.slice(ps, i + 1, F.coalesce(F.get(at, j + 1), F.size(ps)) - i), " ")))

    return let(parts, lambda ps: F.when(F.size(ps) == 0, ps).otherwise(joined(ps)))


def is_heading(line: Column) -> Column:
    line = strip(line)
    plain = matches(line, X.HEADING) & (F.size(words(line)) <= 9)
    return (line != "") & (F.length(line) <= 72) & (F.endswith(line, F.lit(":")) | plain)


def is_field_label(line: Column) -> Column:
    return matches(strip(line), X.FIELD_LABEL)


def is_safety_critical(sentence: Column) -> Column:
    return matches(sentence, X.SAFETY_CRITICAL)


def citation(title: Column, year: Column, publisher: Column, page_start: Column, page_end: Column) -> Column:
    known = year.isNotNull() & ~year.isin("", "unknown")
    pages = F.when(page_start == page_end, F.concat(F.lit("p. "), page_start.cast("string"))).otherwise(F.concat(F.lit("pp. "), page_start.cast("string"), F.lit("-"), page_end.cast("string")))
    return F.concat(title, F.when(known, F.concat(F.lit(" ("), year, F.lit(")"))).otherwise(F.lit("")), F.lit(", "), publisher, F.lit(", "), pages)


def slug(text: Column, most: int = 60, mark: str = "_") -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", mark), f"^{mark}+|{mark}+$", "")
    return F.regexp_replace(F.left(out, F.lit(most)), f"{mark}+$", "")


def specific_title(title: Column, text: Column) -> Column:
    """The title with the first Latin name in brackets of the text's beginning, unless it has it already."""
    name = F.regexp_extract(F.left(text, F.lit(600)), r"\(([A-Z][a-z]+ [a-z]{3,})\)", 1)
    return F.when((name != "") & ~F.contains(F.lower(title), F.lower(name)), F.concat(title, F.lit(" ("), name, F.lit(")"))).otherwise(title)


def l2_normalised(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return let(F.greatest(norm, F.lit(1e-12)), lambda n: F.transform(vector, lambda x: x.cast("double") / n))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
