"""Is a passage guidance prose? Gates in order, each a boolean column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X
from .text import count, find_all, let, matches, strip

REAL_WORD_SHARE, FRONT_MATTER_HITS = 0.72, 2


def real_word_share(text: Column) -> Column:
    """Share of ASCII words of three letters and more; 1 for texts of under 20 words."""
    return let(find_all(text, "[A-Za-z]+"), lambda ws: F.when(F.size(ws) < 20, F.lit(1.0)).otherwise(F.size(F.filter(ws, lambda w: F.length(w) >= 3)) / F.size(ws)))


def is_front_matter(text: Column) -> Column:
    head = F.left(text, F.lit(600))
    return count(head, X.FRONT_MATTER) + count(head, X.COPYRIGHT) > FRONT_MATTER_HITS


def is_form(text: Column) -> Column:
    runs = count(text, X.BLANK_RUN)
    return (runs >= 3) | (matches(text, X.FORM_NUMBERING) & (runs >= 1))


def longest_question_run(text: Column) -> Column:
    marks = F.array_join(find_all(text, "[.!?]"), "")
    return F.coalesce(F.array_max(F.transform(F.split(marks, "[.!]", -1), F.length)), F.lit(0))


def is_question_checklist(text: Column) -> Column:
    n = F.size(F.filter(F.transform(F.split(text, X.SENTENCE_SPLIT, -1), strip), lambda s: s != ""))
    run = longest_question_run(text)
    return (n >= 4) & (run >= 3) & ((run >= 5) | (count(text, X.SELF_ASSESSMENT) >= 2))


def unusable_reason(text: Column) -> Column:
    """Why a passage is not guidance; null if it is."""
    share = real_word_share(text)
    return (
        F.when(is_front_matter(text), "front matter")
        .when(share < REAL_WORD_SHARE, F.concat(F.lit("garbled text ("), F.bround(share * 100, 0).cast("int").cast("string"), F.lit("% real words)")))
        .when(is_form(text), "questionnaire or worksheet, not guidance")
        .when(is_question_checklist(text), "self-assessment checklist, not guidance")
    )


def is_usable(text: Column) -> Column:
    return unusable_reason(text).isNull()


def licence_reason(licence: Column) -> Column:
    """Why a licence excludes a document; null if it does not."""
    return F.when(matches(licence, X.NO_DERIVATIVES), F.concat(F.lit("NoDerivatives ("), licence, F.lit(")"))).when(matches(licence, X.PROPRIETARY), F.concat(F.lit("proprietary ("), licence, F.lit(")")))
