"""The metadata filter: length, phrases of title and description, category.

All rules are parameters; phrase lists are of bounded size and become literals.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    least_seconds: float = 0.0
    most_seconds: float = float("inf")
    title_phrases: tuple[tuple[str, ...], ...] = field(default=())
    description_phrases: tuple[tuple[str, ...], ...] = field(default=())
    categories: tuple[str, ...] = ()
    in_order: bool = False


def has_phrase(text: Column, phrases: tuple[tuple[str, ...], ...], in_order: bool = False) -> Column:
    """Whether all words of some phrase are words of the text, side by side if ``in_order``."""
    if not phrases:
        return F.lit(False)
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    if in_order:
        line = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
        return F.exists(F.array(*[F.lit(" " + " ".join(p).lower() + " ") for p in phrases]), lambda p: F.contains(line, p))
    singles = sorted({p[0].lower() for p in phrases if len(p) == 1})
    several = [F.array(*[F.lit(w.lower()) for w in p]) for p in phrases if len(p) > 1]
    out = F.arrays_overlap(words, F.array(*map(F.lit, singles))) if singles else F.lit(False)
    return out | F.exists(F.array(*several), lambda p: F.size(F.array_except(p, words)) == 0) if several else out


def keep(rows: DataFrame, rules: Rules, length: str = "length", title: str = "title", description: str = "description", category: str = "category") -> DataFrame:
    """Rows within the length limits, without a listed phrase and outside the listed categories."""
    ok = F.col(length).between(rules.least_seconds, rules.most_seconds)
    ok &= ~has_phrase(F.col(title), rules.title_phrases, rules.in_order) & ~has_phrase(F.col(description), rules.description_phrases, rules.in_order)
    if rules.categories:
        ok &= ~F.coalesce(F.col(category).isin(*rules.categories), F.lit(False))
    return rows.where(ok)
