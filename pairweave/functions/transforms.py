"""Distance transforms and range predicates over pair tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("distance", "similarity", "percent")


def to_distance(value: Column, kind: str = "distance") -> Column:
    """Turn a raw value into a distance: itself, ``1 - s``, or ``1 - 0.01 * s`` for a percentage."""
    value = value.cast("double")
    if kind == "distance":
        return value
    if kind == "similarity":
        return F.lit(1.0) - value
    if kind == "percent":
        return F.lit(1.0) - value * F.lit(0.01)
    raise ValueError(f"kind must be one of {KINDS}, not {kind!r}")


def usable(value: Column) -> Column:
    """True where a double is neither null nor not-a-number."""
    return value.isNotNull() & ~F.isnan(value)


def tightest(bounds: Mapping[str, float] | Sequence[tuple[str, float]] | None, pick) -> dict[str, float]:
    """Fold repeated bounds of a column to the tightest one; ``pick`` is ``max`` for minima, ``min`` for maxima."""
    folded: dict[str, float] = {}
    for name, value in (bounds.items() if isinstance(bounds, Mapping) else bounds or ()):
        folded[name] = pick(folded[name], float(value)) if name in folded else float(value)
    return folded


def range_predicate(minimum, maximum) -> Column | None:
    """The conjunction of all inclusive bounds, on raw values. Null and not-a-number fail every bound."""
    lows, highs = tightest(minimum, max), tightest(maximum, min)
    terms = []
    for name in dict.fromkeys([*lows, *highs]):
        column = F.col(f"`{name}`").cast("double")
        if name in lows:
            terms.append(column >= F.lit(lows[name]))
        terms.append(column <= F.lit(highs[name]) if name in highs else ~F.isnan(column))
    if not terms:
        return None
    out = terms[0]
    for term in terms[1:]:
        out = out & term
    return out
