"""Classes of verbatim grading texts."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .text import normalize_arabic

# a keyword counts at the start of a word, after optional joined particles
_START = r"(?<![ء-ي])[وف]?[بلك]?(?:ال)?"


def _any(words: list[str]) -> str:
    return _START + "(?:" + "|".join(words) + ")"


FABRICATED, WEAK, ACCEPTED = _any(V.GRADE_FABRICATED), _any(V.GRADE_WEAK), _any(V.GRADE_ACCEPTED)


def classify_grade(text: Column) -> Column:
    """accepted / weak / fabricated / mixed / unknown. Rejections are removed before acceptance is looked for."""
    norm = normalize_arabic(text)
    fabricated, weak = norm.rlike(FABRICATED), norm.rlike(WEAK)
    accepted = F.regexp_replace(F.regexp_replace(norm, WEAK, " "), FABRICATED, " ").rlike(ACCEPTED)
    return (
        F.when(accepted & (weak | fabricated), "mixed").when(fabricated, "fabricated").when(weak, "weak").when(accepted, "accepted").otherwise("unknown")
    )


def in_trusted_collection(attribution: Column) -> Column:
    return F.coalesce(normalize_arabic(attribution).rlike("|".join(V.TRUSTED_COLLECTION)), F.lit(False))


def distinct_gradings(grades: Column) -> Column:
    """Distinct grading wordings in source order."""
    return F.array_distinct(F.transform(grades, lambda g: F.trim(F.regexp_replace(g["text"], r"\s+", " "))))
