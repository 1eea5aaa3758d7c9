"""Numeric and ranking column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import CONFIDENCES


def four_digits(x: Column) -> Column:
    """Round half up to four digits by arithmetic, the same in every engine."""
    return F.floor(x * 10000 + F.lit(0.5)).cast("double") / F.lit(10000.0)


def confidence_rank(confidence) -> Column:
    """0 for the weakest tier up to 4; -1 for an unknown one."""
    c = F.col(confidence) if isinstance(confidence, str) else confidence
    out = F.lit(-1)
    for rank, name in enumerate(CONFIDENCES):
        out = F.when(c == name, F.lit(rank)).otherwise(out)
    return out


def at_least(confidence, floor: str | None) -> Column:
    if floor is None:
        return F.lit(True)
    return confidence_rank(confidence) >= CONFIDENCES.index(floor)


def is_bug_fix(subject) -> Column:
    s = F.col(subject) if isinstance(subject, str) else subject
    return F.coalesce(s.rlike(r"(?i)^(fix|bugfix|hotfix|patch)([(:! ]|$)"), F.lit(False))


def lines_of_code(text) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, "\n")) - F.endswith(t, F.lit("\n")).cast("int"))
