"""Languages of questions: detection, Pidgin rewriting, farm terms in English."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X
from .text import find_all, let, matches, strip

#: Letters that may come as a base and a combining mark.
_COMPOSED = (("ẹ", "ẹ"), ("ọ", "ọ"), ("ṣ", "ṣ"), ("ụ", "ụ"), ("ị", "ị"), ("ṅ", "ṅ"))
#: Accented letters and their base, for looking words up.
_ACCENTED, _BASE = "àáâãäåèéêëìíîïòóôõöùúûüñçẹọṣụịṅÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜÑÇẸỌṢỤỊṄ", "aaaaaaeeeeiiiiooooouuuunceosuinAAAAAAEEEEIIIIOOOOOUUUUNCEOSUIN"


def lowered(text: Column) -> Column:
    """Lower case, with the marked letters of these languages composed."""
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), _COMPOSED, F.lower(text))


def _any(cs) -> Column:
    return reduce(lambda a, b: a | b, cs)


def _both(found: Column, listed) -> Column:
    return F.size(F.array_intersect(found, F.array(*map(F.lit, dict.fromkeys(listed)))))


def _letters(low: Column, chars) -> Column:
    return F.length(low) - F.length(F.translate(low, "".join(chars), ""))


def _counts(low: Column) -> tuple[Column, Column, Column]:
    found = F.array_distinct(find_all(low, "[a-z]+"))
    strong = _both(found, X.PIDGIN_STRONG)
    weak = _both(found, X.PIDGIN_WEAK)
    return found, strong, weak


def detect(text: Column) -> Column:
    """en, pcm, yor, ibo or hau."""

    def decide(low: Column) -> Column:
        yor, ibo, shared = (_letters(low, c) for c in (X.YORUBA_CHARS, X.IGBO_CHARS, X.SHARED_CHARS))
        found, strong, weak = _counts(low)
        weak = weak + reduce(lambda a, b: a + b, (F.contains(low, F.lit(p)).cast("int") for p in X.PIDGIN_WEAK_PHRASES))
        phrases = [rf"\b(?:{'|'.join(X.PIDGIN_PHRASES)})\b", X.FIT_MODAL, X.DON_PERFECT, X.GO_FUTURE]
        script = yor + ibo + shared >= 2
        return (
            F.when(_letters(low, X.HAUSA_CHARS) > 0, "hau")
            .when((yor > 0) & (ibo == 0), "yor")
            .when((ibo > 0) & (yor == 0), "ibo")
            .when(script & (yor > ibo), "yor")
            .when(script & (ibo > yor), "ibo")
            .when(script & (shared >= 2), "yor")
            .when(F.size(found) == 0, "en")
            .when(_both(found, X.PIDGIN_UNAMBIGUOUS) > 0, "pcm")
            .when(_any(matches(low, p) for p in phrases), "pcm")
            .when((strong >= 2) | ((strong >= 1) & (weak >= 2)), "pcm")
            .when(_both(found, X.YORUBA_WORDS) >= 2, "yor")
            .when(_both(found, X.IGBO_WORDS) >= 2, "ibo")
            .when(_both(found, X.HAUSA_UNAMBIGUOUS) >= 1, "hau")
            .when(_both(found, X.HAUSA_WORDS) >= 2, "hau")
            .otherwise("en")
        )

    return let(lowered(text), decide)


def confidence(text: Column) -> Column:
    """How sure ``detect`` is; Hausa keeps its own name, at 0.75, or 0.95 with its letters."""

    def measure(low: Column) -> Column:
        found, strong, weak = _counts(low)
        pidgin = F.least(F.lit(1.0), strong * 0.4 + weak * 0.15)
        by_script = lambda chars: F.when(_letters(low, chars) > 0, 0.95).otherwise(0.75)
        code = detect(text)
        return (
            F.when(code == "yor", by_script(X.YORUBA_CHARS)).when(code == "ibo", by_script(X.IGBO_CHARS)).when(code == "hau", by_script(X.HAUSA_CHARS))
            .when(F.size(found) == 0, F.lit(1.0)).when(code == "pcm", pidgin).otherwise(1.0 - pidgin)
        )

    return let(lowered(text), measure)


def looks_pidgin(text: Column) -> Column:
    return matches(text, X.PIDGIN_MARKERS)


def looks_yoruba(text: Column) -> Column:
    """A letter that only Yoruba has here, or two of its common words."""
    return matches(text, X.YORUBA_MARKS) | (_both(find_all(F.lower(text), r"[\p{L}\p{M}\p{N}_]+"), X.YORUBA_MARKERS) >= 2)


def pidgin_normalised(text: Column) -> Column:
    """English by rules, in order, where a marker shows Pidgin; other text is left as it is."""
    rewritten = lambda text: reduce(lambda t, r: F.regexp_replace(t, f"(?i){r[0]}", r[1]), X.PIDGIN_RULES, text)
    return let(text, lambda t: F.when(looks_pidgin(t), strip(F.regexp_replace(rewritten(t), r"(?U)\s+", " "))).otherwise(t))


def with_farm_terms(text: Column, language: Column) -> Column:
    """Yoruba, Igbo and Hausa questions with the English of the farm terms in them, longest terms first."""
    ordered = sorted(X.FARM_TERMS.items(), key=lambda kv: -len(kv[0]))

    def expanded(t: Column) -> Column:
        folded = F.translate(F.regexp_replace(lowered(t), r"\p{Mn}", ""), _ACCENTED, _BASE)
        found = let(folded, lambda f: F.array_distinct(F.array_compact(F.array(*(F.when(matches(f, rf"\b{term}\b"), english) for term, english in ordered)))))
        return let(found, lambda names: F.when(F.size(names) > 0, F.concat_ws(" ", t, F.array_join(names, " "))).otherwise(t))

    return let(text, lambda t: F.when(language.isin("yor", "ibo", "hau"), expanded(t)).otherwise(t))


def stopword_votes(text: Column, most: int = 20_000) -> dict[str, Column]:
    """How many of the first words are stop words of each language."""
    found = F.slice(find_all(F.lower(text), "[a-zàâçéèêëîïôûùüÿñæœáíóúü]+"), 1, most)
    among = lambda listed: lambda w: w.isin(*listed)
    return {lang: F.size(F.filter(found, among(stops))) for lang, stops in X.LANGUAGE_STOPWORDS.items()}
