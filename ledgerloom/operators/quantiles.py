"""A10: exact quantiles of columns of any size, by narrowing brackets.

A wanted rank is bracketed by two values. Each round takes approximate
percentiles inside the bracket, whose state is bounded, and counts exactly what
lies below and in the new bracket; about a ten-thousandth of its rows stay. When
few rows are left they are fetched. Every round asks about values only, never
about the place of a row, so it does not matter that the input is computed again.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class _Bracket:
    """The value of a rank lies in [low, high]; ``below`` rows are smaller than low, ``inside`` rows are in the bracket."""

    column: str
    rank: int
    low: float
    high: float
    below: int
    inside: int
    value: float | None = None

    def holds(self, low: float | None = None, high: float | None = None) -> Column:
        return F.col(self.column).between(self.low if low is None else low, self.high if high is None else high)


def exact_quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float], fetch: int = 100_000, accuracy: int = 10_000) -> dict[str, list[float | None]]:
    """For each column its interpolated quantiles (linear between neighbouring ranks), None without values; NULL and NaN are no values.

    At most ``fetch`` rows of a rank's bracket are gathered. All columns and ranks share each pass.
    """
    plain = df.select(*(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns))
    first = plain.agg(*(F.struct(F.count(c), F.min(c), F.max(c)) for c in columns)).first()
    total = {c: first[k][0] for k, c in enumerate(columns)}
    ends = {c: first[k][1:] for k, c in enumerate(columns)}
    ranks = {c: sorted({r for s in shares for r in (math.floor(s * (total[c] - 1)), math.ceil(s * (total[c] - 1)))}) if total[c] else [] for c in columns}
    found = [_Bracket(c, r, *ends[c], 0, total[c]) for c in columns for r in ranks[c]]
    while wide := [b for b in found if b.value is None and b.inside > fetch]:
        _narrow(plain, wide, accuracy)
    if left := [b for b in found if b.value is None]:
        rows = plain.agg(*(F.sort_array(F.collect_list(F.when(b.holds(), F.col(b.column)))) for b in left)).first()
        for b, values in zip(left, rows):
            b.value = values[b.rank - b.below]
    at = {(b.column, b.rank): b.value for b in found}
    out: dict[str, list[float | None]] = {}
    for c in columns:
        out[c] = []
        for s in shares:
            place = s * (total[c] - 1)
            lo, hi = (at.get((c, f(place))) for f in (math.floor, math.ceil))
            out[c].append(None if lo is None else lo + (hi - lo) * (place - math.floor(place)))
    return out


def _narrow(plain: DataFrame, wide: list[_Bracket], accuracy: int) -> None:
    """One round: a bracket loses its ends or is answered by one of them, so every round makes progress."""
    guesses = []
    for b in wide:
        share = (b.rank - b.below + 0.5) / b.inside
        around = [min(1.0, max(0.0, share + d / accuracy)) for d in (-2, 2)]
        guesses.append(F.percentile_approx(F.when(b.holds(), F.col(b.column)), around, accuracy))
    cuts = plain.agg(*guesses).first()
    # Of the guesses g <= h: rows below g, at g, between, and at h.
    counts = []
    for b, (g, h) in zip(wide, cuts):
        c = F.col(b.column)
        counts.append(F.struct(F.count_if(b.holds() & (c < g)), F.count_if(c == g), F.count_if((c > g) & (c < h)), F.count_if(c == h)))
    for b, (g, h), (under, at_g, between, at_h) in zip(wide, cuts, plain.agg(*counts).first()):
        k = b.rank - b.below
        up, down = math.nextafter(g, math.inf), math.nextafter(h, -math.inf)
        if k < under:
            b.high, b.inside = math.nextafter(g, -math.inf), under
        elif k < under + at_g:
            b.value = g
        elif k < under + at_g + between:
            b.low, b.high, b.below, b.inside = up, down, b.below + under + at_g, between
        elif h > g and k < under + at_g + between + at_h:
            b.value = h
        else:
            gone = under + at_g + (between + at_h if h > g else 0)
            b.low, b.below, b.inside = math.nextafter(h, math.inf), b.below + gone, b.inside - gone
