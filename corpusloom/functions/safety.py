"""What an answer may say: doses, money, hazardous substances, withdrawal, stale sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X
from .scope import message
from .text import find_all, let, matches, strip

RECENT_YEARS, MONEY_WINDOW = 10, 14


def _named(text: Column, terms) -> Column:
    """Terms that stand in the text as words, sorted; one test each, for names may hold others. What a text does not hold at all is not sought as a word."""
    word = lambda low, t: F.contains(low, F.lit(t)) & matches(low, r"\b" + t.replace("-", r"\-") + r"\b")
    return let(F.lower(text), lambda low: F.array_compact(F.array(*(F.when(word(low, t), t) for t in sorted(set(terms))))))


def hazardous(text: Column) -> Column:
    return _named(text, X.HAZARDOUS_ACTIVES)


def restricted_veterinary(text: Column) -> Column:
    return _named(text, X.RESTRICTED_VETERINARY)


def doses(text: Column) -> Column:
    """Doses by the patterns in order; those equal but for case and white space once."""
    found = F.flatten(F.array(*(F.transform(find_all(text, p, 1 if "(?<dose>" in p else 0), strip) for p in X.DOSAGE_PATTERNS)))
    key = lambda d: F.regexp_replace(F.lower(d), r"\s+", " ")
    return let(found, lambda fs: let(F.transform(fs, key), lambda ks: F.filter(fs, lambda d, i: F.array_position(ks, F.get(ks, i)) == i + 1)))


def squeezed(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"(?U)[\s,]+", "")


def unsupported_doses(answer: Column, sources: Column) -> Column:
    """Doses of the answer that the sources do not hold; ``sources``: one text."""
    return let(squeezed(sources), lambda s: F.filter(doses(answer), lambda d: ~F.contains(s, squeezed(d))))


def replaced(text: Column, parts: Column, by: str) -> Column:
    return F.aggregate(parts, text, lambda t, p: F.replace(t, p, F.lit(by)))


def money(text: Column) -> Column:
    return find_all(text, X.MONEY)


def without_money(text: Column) -> Column:
    return replaced(text, money(text), X.MONEY_REDACTION)


def foreign_money(text: Column) -> Column:
    """Foreign currencies with a digit within 14 characters on either side, sorted."""
    rx = X.FOREIGN_MONEY

    def place(ms: Column, gaps: Column, names: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("found"))

        def step(s: Column, i: Column) -> Column:
            start = s["at"] + F.length(F.get(gaps, i))
            end = start + F.length(F.get(ms, i))
            low = F.greatest(start - MONEY_WINDOW, F.lit(0))
            near = F.rlike(F.substring(text, low + 1, end + MONEY_WINDOW - low), F.lit("[0-9]"))
            return F.struct(end.alias("at"), F.when(near, F.concat(s["found"], F.array(strip(F.get(names, i))))).otherwise(s["found"]).alias("found"))

        return F.aggregate(F.sequence(F.lit(0), F.size(ms) - 1), begin, step, lambda s: F.array_sort(F.array_distinct(s["found"])))

    whole = let(find_all(text, rx), lambda m: let(F.split(text, rx, -1), lambda g: let(find_all(text, rx, 1), lambda n: place(m, g, n))))
    return F.when(matches(text, rx), whole).otherwise(F.array().cast("array<string>"))


def advises_container_reuse(answer: Column) -> Column:
    return F.exists(F.split(answer, X.SENTENCE_END), lambda s: matches(s, X.REUSE_CONTAINER) & ~matches(s, X.NEGATED))


def has_chemical_context(text: Column) -> Column:
    return matches(text, X.CHEMICAL_CONTEXT)


def is_stale(year: Column, now: int) -> Column:
    """Older than ten years; a year that cannot be read counts as old."""
    return F.coalesce(F.lit(now) - _year(year) > RECENT_YEARS, F.lit(True))


def _year(year: Column) -> Column:
    head = strip(F.left(year.cast("string"), F.lit(4)))
    return F.when(F.rlike(head, F.lit("^[0-9]{1,4}$")), head.try_cast("int"))


def verdict(answer: Column, sources: Column, question: Column, years: Column, now: int) -> Column:
    """The safety verdict as a struct; ``sources`` and ``years`` are arrays."""
    joined = F.array_join(sources, "\n")
    found = let(hazardous(answer), lambda named: F.when(F.size(named) > 0, named).otherwise(hazardous(joined)))
    restricted = restricted_veterinary(F.concat_ws("\n", answer, joined))
    withdrawal = (matches(answer, X.VETERINARY_TREATMENT) | matches(question, X.WITHDRAWAL_QUESTION)) & ~matches(answer, X.WITHDRAWAL_MENTIONED)
    all_stale = (F.size(years) > 0) & has_chemical_context(answer) & F.forall(years, lambda y: is_stale(y, now))
    stale = F.when(all_stale, F.array_sort(F.array_distinct(years))).otherwise(F.array().cast("array<string>"))
    parts = F.struct(
        found.alias("hazardous"), unsupported_doses(answer, joined).alias("unsupported_doses"), stale.alias("stale_sources"), restricted.alias("restricted_veterinary"),
        F.coalesce(withdrawal, F.lit(False)).alias("missing_withdrawal"), advises_container_reuse(answer).alias("container_reuse"), foreign_money(answer).alias("foreign_money"),
    )

    def judged(v: Column) -> Column:
        none = [F.size(v[k]) == 0 for k in ("hazardous", "unsupported_doses", "stale_sources", "restricted_veterinary", "foreign_money")]
        safe = none[0] & none[1] & none[2] & none[3] & none[4] & ~v["missing_withdrawal"] & ~v["container_reuse"]
        return F.struct(safe.alias("safe"), *(v[k].alias(k) for k in ("hazardous", "unsupported_doses", "stale_sources", "restricted_veterinary", "missing_withdrawal", "container_reuse", "foreign_money")))

    return let(parts, judged)


def notice(v: Column, language: Column) -> Column:
    """The lines that a verdict adds to an answer, in order; empty for a safe one. The verdict is evaluated once, however many lines ask for it."""
    return let(v, lambda x: _lines(x, language))


def _lines(v: Column, language: Column) -> Column:
    listed = lambda k: F.array_join(F.array_sort(v[k]), ", ")
    some = lambda k: F.size(v[k]) > 0
    lines = F.array(
        F.when(some("hazardous"), F.concat(message("hazardous_pesticide", language), F.lit(" ("), listed("hazardous"), F.lit(")"))),
        F.when(some("unsupported_doses"), message("unsupported_dosage", language)),
        F.when(some("stale_sources"), F.concat(message("stale_chemical", language), F.lit(" ("), listed("stale_sources"), F.lit(")"))),
        F.when(some("restricted_veterinary"), F.concat(F.lit("Some sources mention veterinary medicines that are banned or restricted in food-producing animals ("), listed("restricted_veterinary"), F.lit("). Do not use them. Ask a veterinary officer."))),
        F.when(some("foreign_money"), F.concat(F.lit("Some figures above are in a currency from another country ("), listed("foreign_money"), F.lit("). They are not Nigerian prices and should not be used to decide what to sell for. Ask at your local market."))),
        F.when(v["container_reuse"], F.lit(X.CONTAINER_REUSE_WARNING)),
        F.when(v["missing_withdrawal"], message("withdrawal_period", language)),
    )
    return F.array_join(F.array_compact(lines), "\n\n")


def without_disclaimer(answer: Column) -> Column:
    """Without a leading "I have no information", capitalised anew; never empty."""
    cut = F.regexp_replace(F.regexp_replace(answer, X.FALSE_DISCLAIMER, ""), r"^[ \n]+", "")
    return F.when(matches(answer, X.FALSE_DISCLAIMER), let(cut, lambda c: F.when(c == "", answer).otherwise(F.concat(F.upper(F.left(c, F.lit(1))), F.substring(c, F.lit(2), F.length(c)))))).otherwise(answer)


def content_words(text: Column) -> Column:
    return F.array_distinct(F.filter(find_all(F.lower(text), "[a-z]+"), lambda w: (F.length(w) > 2) & ~w.isin(*X.ECHO_STOPWORDS)))


def without_echo(answer: Column, question: Column) -> Column:
    """Without advice that only hands the question's own words back; never empty."""

    def kept(asked: Column) -> Column:
        def stays(s: Column) -> Column:
            return let(content_words(s), lambda ws: let(F.size(F.array_intersect(ws, asked)), lambda n: (F.size(ws) == 0) | ~matches(s, X.IMPERATIVE) | (n / F.size(asked) < 0.8) | (n / F.greatest(F.size(ws), F.lit(1)) < 0.6)))

        return let(F.split(answer, X.SENTENCE_END), lambda ss: let(F.filter(ss, stays), lambda ks: F.when(F.size(ks) == F.size(ss), answer).otherwise(let(strip(F.array_join(F.filter(ks, lambda s: strip(s) != ""), " ")), lambda j: F.when(j == "", answer).otherwise(j)))))

    return let(content_words(question), lambda asked: F.when(F.size(asked) == 0, answer).otherwise(kept(asked)))


def without_citation_run(answer: Column) -> Column:
    """Without two or more citation marks at the start; null where nothing else is left."""
    cut = F.regexp_replace(F.regexp_replace(answer, X.CITATION_RUN, ""), r"(?U)^\s+", "")
    return F.when(cut != "", cut)


def released(span: Column, sources: Column) -> Column:
    """A span as the guard lets it out: no money, no dose that the (squeezed) sources lack."""
    lacking = F.filter(doses(span), lambda d: ~F.contains(sources, squeezed(d)))
    return replaced(without_money(span), lacking, "[rate not given in the sources - ask an extension officer]")
