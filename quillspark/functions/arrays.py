"""Functions over arrays of answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_blank, normalize_answer


def valid_answers(responses: Column | str, field: str | None = None) -> Column:
    """Answers that aren't blank, in order."""
    c = F.col(responses) if isinstance(responses, str) else responses
    if field:
        c = F.transform(c, lambda r: r[field])
    return F.filter(c, lambda a: ~is_blank(a))


def dedupe_answers(answers: Column | str) -> Column:
    """Answers without later ones of the same normalised text, in order."""
    c = F.col(answers) if isinstance(answers, str) else answers
    keys = F.transform(c, lambda a: normalize_answer(a))
    return F.filter(c, lambda a, i: (normalize_answer(a) != "") & (F.array_position(keys, normalize_answer(a)) == i + 1))


def longest_answer(answers: Column | str) -> Column:
    """Longest by characters, the first among equals."""
    c = F.col(answers) if isinstance(answers, str) else answers
    return F.array_max(F.transform(c, lambda a, i: F.struct(F.length(a).alias("n"), (-i).alias("at"), a.alias("answer"))))["answer"]


def string_list(c: Column) -> Column:
    """A scalar as a list of itself, blanks dropped."""
    return F.filter(F.array(c), lambda x: ~is_blank(x))


def ordered_unique(c: Column | str) -> Column:
    return F.array_distinct(c)
