"""Similarity of entity names: weighted terms behind cheap gates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T


@dataclass(frozen=True)
class Weights:
    """Weights of the four terms, and the score from which two names are one entity."""

    jaccard: float = 0.35
    containment: float = 0.25
    edit: float = 0.30
    acronym: float = 0.10
    threshold: float = 0.75

    @property
    def least_jaccard(self) -> float:
        """The token similarity that two names need for the threshold even if all other terms are full."""
        return (self.threshold - self.containment - self.edit - self.acronym) / self.jaccard if self.jaccard else 0.0

    @property
    def blocking_is_exact(self) -> bool:
        """Whether names without a common token cannot reach the threshold."""
        return self.threshold > self.containment + self.edit + self.acronym


def name_score(a: Column, b: Column, w: Weights = Weights()) -> Column:
    """Score of two names without gates."""
    x, y = T.normal_name(a), T.normal_name(b)
    return w.jaccard * T.jaccard(T.token_set(a), T.token_set(b)) + w.containment * T.containment(x, y) + w.edit * T.edit_similarity(x, y) + w.acronym * T.acronym(x, y)


def first_token_gate(a: Column, b: Column) -> Column:
    """Whether first tokens agree enough to go on: a common beginning of two letters, or more than half (rounded down)
    of the first one's letters in the other. Short names of one word pass. The gate is not symmetric."""
    a, b = F.lower(a), F.lower(b)
    short = ((F.length(a) <= 10) & ~F.contains(a, F.lit(" "))) | ((F.length(b) <= 10) & ~F.contains(b, F.lit(" ")))
    p, q = F.get(F.split(a, r"\s+"), F.lit(0)), F.get(F.split(b, r"\s+"), F.lit(0))
    begin = (F.length(p) >= 2) & (F.length(q) >= 2) & (F.left(p, F.lit(2)) == F.left(q, F.lit(2)))
    letters = F.size(F.filter(F.split(p, ""), lambda c: (c != "") & F.contains(q, c)))
    return short | begin | (letters > F.floor(F.length(p) / 2))


def score(a: Column, b: Column, type_a: Column, type_b: Column, w: Weights = Weights()) -> Column:
    """Score of two entities; 0 for different types, very different lengths or first tokens that disagree."""
    least, most = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    closed = (F.lower(type_a) != F.lower(type_b)) | ((least > 10) & (most > 5 * least)) | ~first_token_gate(a, b)
    return F.when(closed, 0.0).otherwise(name_score(a, b, w))
