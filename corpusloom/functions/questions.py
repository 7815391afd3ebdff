"""What a question is about and how it is put to the search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X
from .language import pidgin_normalised, with_farm_terms
from .text import find_all, let, matches, strip


def sign_names(text: Column) -> Column:
    """Names of what signs point to, in the rules' order, once each."""
    return let(text, lambda t: F.array_distinct(F.array_compact(F.array(*(F.when(matches(t, f"(?i){p}"), name) for p, name in X.SIGN_TO_NAME)))))


def describes_symptoms(text: Column) -> Column:
    return F.arrays_overlap(find_all(F.lower(text), "[a-z]+"), F.array(*map(F.lit, X.SYMPTOM_WORDS)))


def retrieval_query(text: Column) -> Column:
    """The question without "... says:" before it and without instructions to the answerer."""

    def short(whole: Column) -> Column:
        bare = F.regexp_replace(whole, X.REPORTED_SPEECH, "")
        kept = F.filter(F.split(bare, X.CLAUSE, -1), lambda c: (strip(c) != "") & ~matches(c, X.INSTRUCTION))
        return let(strip(F.array_join(F.transform(kept, strip), " ")), lambda r: F.when(F.length(r) < 15, whole).otherwise(r))

    return let(strip(text), short)


def with_diagnostic_intent(text: Column) -> Column:
    named = lambda t: let(sign_names(t), lambda names: F.concat_ws(" ", t, F.when(F.size(names) > 0, F.array_join(names, " ")), F.lit(X.DIAGNOSTIC_INTENT)))
    return let(text, lambda t: F.when(describes_symptoms(t), named(t)).otherwise(t))


def prepared(text: Column, language: Column) -> Column:
    """The whole preparation, in the order of the question flow."""
    return with_diagnostic_intent(retrieval_query(with_farm_terms(pidgin_normalised(text), language)))


def asks_about_field(text: Column) -> Column:
    return matches(text, X.FIELD_CONTEXT) & ~matches(text, X.STORE_CONTEXT)


def depends_on_time(text: Column) -> Column:
    return matches(text, X.TIME_DEPENDENT)


def cannot_be_settled(text: Column) -> Column:
    """A yes-or-no question on regulatory status, which no guide settles."""
    return matches(text, X.CLOSED_OPENER) & matches(text, X.REGULATORY) & matches(text, X.JURISDICTION)
