"""Per-voxel expressions: thresholds, class choice, probabilities, votes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def above(value: Column, threshold: float) -> Column:
    """Strictly above; a null is not."""
    return F.coalesce(value > threshold, F.lit(False))


def winner(classes: list[Column]) -> Column:
    """Number of the class with the highest value; of equal ones the first, so background wins ties; nulls never win."""
    best = F.greatest(*classes)
    return reduce(lambda rest, pair: F.when(pair[1] == best, F.lit(pair[0])).otherwise(rest), list(enumerate(classes))[::-1], F.lit(None).cast("int"))


def only_winner(classes: list[Column]) -> list[Column]:
    """Each class's value where it wins, else 0."""
    won = winner(classes)
    return [F.when(won == k, c).otherwise(F.lit(0.0)) for k, c in enumerate(classes)]


def background(foreground: list[Column]) -> Column:
    """What the foreground classes leave of 1, not below 0."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - sum(foreground[1:], foreground[0]))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def logit_thresholds(first: float, last: float, count: int) -> list[float]:
    """``count`` thresholds, evenly spaced in log odds."""
    import math

    step = (last - first) / (count - 1) if count > 1 else 0.0
    return [1 / (1 + math.exp(-(first + k * step))) for k in range(count)]


def threshold_list(low: list[float], between: tuple[float, float, float] | None, high: list[float], saved: list[float] | None = None) -> tuple[list[float], list[bool]]:
    """All thresholds in ascending order and which are kept; each must lie strictly between 0 and 1."""
    values = set(low) | set(high)
    if between:
        start, stop, step = between
        k = 0
        while start + k * step < stop:
            values.add(round(start + k * step, 12))
            k += 1
    values = sorted(values)
    if any(not 0 < t < 1 for t in values):
        raise ValueError("thresholds must be between 0 and 1")
    if saved is not None and set(saved) - set(values):
        raise ValueError("thresholds to keep must be among the thresholds")
    return values, [saved is None or t in saved for t in values]


def angle(a: list[Column], b: list[Column]) -> Column:
    """Angle between two vectors, from the norms of their cross and dot products."""
    cross = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    dot = a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    return F.atan2(F.sqrt(cross[0] * cross[0] + cross[1] * cross[1] + cross[2] * cross[2]), dot)


def consensus(votes: list[Column], tie_wins: bool = False) -> Column:
    """Whether most votes are set; of an even number also half of them, if ``tie_wins``."""
    total = reduce(lambda a, b: a + b, [F.when(v, 1).otherwise(0) for v in votes])
    return 2 * total >= len(votes) if tie_wins and len(votes) % 2 == 0 else 2 * total > len(votes)


def reweighted(classes: list[Column], prior_from: list[float], prior_to: list[float]) -> list[Column]:
    """Class probabilities under other priors: each times the ratio of its priors, then normalised."""
    raw = [c * (t / f) for c, f, t in zip(classes, prior_from, prior_to, strict=True)]
    total = reduce(lambda a, b: a + b, raw)
    return [F.when(total > 0, r / total).otherwise(F.lit(0.0)) for r in raw]


def reweighted_odds(p: Column, prior_from: float, prior_to: float) -> Column:
    """One independent probability under another prior, by its odds."""
    ratio = (prior_to / (1 - prior_to)) / (prior_from / (1 - prior_from))
    odds = p / (1 - p) * ratio
    return F.when(p >= 1, F.lit(1.0)).otherwise(odds / (1 + odds))


def finite(value: Column, pad: float = 0.0) -> Column:
    """NaN, infinite and missing values replaced."""
    number = value.cast("double")
    return F.when(number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")), F.lit(pad)).otherwise(number)


def colour(label: Column, count: int) -> Column:
    """Labels onto 1 to ``count``, 0 staying 0."""
    return F.when(label == 0, F.lit(0)).otherwise((label - 1) % count + 1)


def voxel_index(x: Column, y: Column, z: Column, size: tuple[int, int, int]) -> Column:
    """Place in a linear order in which x runs fastest."""
    return x + size[0] * (y + size[1] * z)
