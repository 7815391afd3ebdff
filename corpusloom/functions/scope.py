"""The scope of the service: an ordered chain of refusal rules, each its own boolean column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X
from .text import find_all, let, matches


def _word(text: Column, terms) -> Column:
    return matches(text, rf"\b(?:{'|'.join(terms)})\b")


def crops_mentioned(text: Column, plural: str = "(?:e?s)?") -> Column:
    """Crops of the service named in a text; ``plural="s?"`` leaves out "tomatoes"."""
    return let(F.lower(text), lambda low: F.array_compact(F.array(*(F.when(matches(low, rf"\b{c}{plural}\b"), c) for c in X.IN_SCOPE_CROPS))))


def other_crops(text: Column) -> Column:
    return let(F.lower(text), lambda low: F.array_compact(F.array(*(F.when(matches(low, rf"\b{c}\b"), c) for c in X.OTHER_CROP_TERMS))))


def human_medical(q: Column) -> Column:
    return matches(q, X.HUMAN_MEDICAL_PERSON) | (matches(q, X.HUMAN_MEDICAL_SYMPTOM) & ~_word(F.lower(q), X.POSITIVE_GROUPS["livestock"]))


def harm(q: Column) -> Column:
    kinds = ((X.HARM_TO_OTHERS, "harm to others"), (X.DECEIVE_BUYER, "deceiving a buyer"), (X.ADULTERATE, "adulteration"), (X.EVADE_PROHIBITION, "evading a prohibition"))
    return F.coalesce(*(F.when(matches(q, p), k) for p, k in kinds))


def out_of_scope_crop(q: Column, whole_words: bool = True) -> Column:
    """The crop asked about that is not covered. ``whole_words=False``: any in-scope name within a word exempts, as "rice" in "price"."""
    terms = X.OUT_OF_SCOPE_CROPS.items()

    def find(low: Column) -> Column:
        own = F.coalesce(*(F.when(matches(low, rf"\b(?:my|our)\s+{t}\b"), n) for t, n in terms))
        named = F.coalesce(*(F.when(matches(low, rf"\b{t}\b"), n) for t, n in terms))
        covered = _word(low, [f"{c}(?:e?s)?" for c in X.IN_SCOPE_CROPS]) if whole_words else reduce(lambda a, b: a | b, (F.contains(low, F.lit(c)) for c in X.IN_SCOPE_CROPS))
        return F.coalesce(own, F.when(~covered, named))

    return let(F.lower(q), find)


def wrong_place(q: Column) -> Column:
    first = lambda p: F.lower(F.get(find_all(q, p), F.lit(0)))
    return F.when(~matches(q, X.HERE), F.coalesce(first(X.ELSEWHERE), first(X.WRONG_CLIMATE)))


def in_domain(q: Column) -> Column:
    return ~matches(q, X.NEVER_IN_DOMAIN) & matches(q, X.IN_DOMAIN)


def rules(q: Column, language: Column) -> list[tuple[str, Column]]:
    """(name, reason or null), in the order in which they decide."""
    when = F.when
    crop, place = out_of_scope_crop(q), wrong_place(q)
    return [
        ("human_medical", when(human_medical(q), "human medical")),
        ("harmful", let(harm(q), lambda k: when(k.isNotNull(), F.concat(F.lit("harmful request: "), k)))),
        ("live_price", when(matches(q, X.LIVE_PRICE) & ~matches(q, X.PRICE_METHOD), "live price")),
        ("dosage", when(matches(q, X.DOSAGE_QUESTION) & matches(q, X.SUBSTANCE), "dosage")),
        ("live_forecast", when(matches(q, X.LIVE_FORECAST), "live forecast")),
        ("financial_legal", when(matches(q, X.FINANCIAL_LEGAL), "financial or legal")),
        ("mechanical", when(matches(q, X.MACHINE) & matches(q, X.MECHANICAL_FAULT), "mechanical repair")),
        ("other_crop", let(crop, lambda c: when(c.isNotNull(), F.concat(F.lit("out-of-scope crop: "), c)))),
        ("personal_decision", when(matches(q, X.LIFE_DECISION), "personal decision")),
        ("wrong_place", let(place, lambda p: when(p.isNotNull(), F.concat(F.lit("outside the service area: "), p)))),
        ("out_of_domain", when(language.isin("en", "pcm") & ~in_domain(q), "out of domain")),
    ]


def refusal_reason(q: Column, language: Column) -> Column:
    """The first rule that refuses; null if the question is in scope."""
    return let(q, lambda x: F.coalesce(*(r for _, r in rules(x, language))))


_KEYS = {
    "dosage": ("dosage_refusal", X.DOSAGE_MESSAGE), "human medical": ("human_medical", X.HUMAN_MEDICAL_MESSAGE),
    "personal decision": ("personal_decision", X.LIFE_DECISION_MESSAGE), "out of domain": ("out_of_domain", X.NO_GUIDANCE_FALLBACK),
    "financial or legal": ("financial_legal", X.FINANCIAL_LEGAL_MESSAGE), "mechanical repair": ("mechanical_repair", X.MECHANICAL_MESSAGE),
    "live price": ("live_price", X.LIVE_PRICE_MESSAGE), "live forecast": ("live_forecast", X.LIVE_FORECAST_MESSAGE),
}
_PREFIXES = {"outside the service area": ("out_of_area", X.OUT_OF_AREA_MESSAGE), "harmful request": ("harmful_request", X.HARMFUL_MESSAGE), "out-of-scope crop": ("out_of_scope_crop", None)}


def message(key: str, language: Column) -> Column:
    """A fixed text in the language, else in English, else null."""
    out = F.lit(X.MESSAGES["en"].get(key))
    for code, texts in X.MESSAGES.items():
        if code != "en":
            out = F.when(language == code, F.lit(texts.get(key))).otherwise(out)
    return out


def refusal_text(reason: Column, language: Column) -> Column:
    out = message("no_guidance", language)
    for prefix, (key, default) in _PREFIXES.items():
        out = F.when(F.startswith(reason, F.lit(prefix)), F.coalesce(message(key, language), F.lit(default))).otherwise(out)
    for name, (key, default) in _KEYS.items():
        out = F.when(reason == name, F.coalesce(message(key, language), F.lit(default))).otherwise(out)
    return F.when(reason.isNotNull(), out)
