"""Derived columns (P rows) as column expressions; a missing value is NULL, never NaN."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.config import ERAS


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def no_nan(c: str | Column) -> Column:
    """NaN becomes NULL; to be used at every edge where data come in."""
    return F.when(~F.isnan(col(c)), col(c))


def fiscal_year(end: str | Column, fye: str | Column) -> Column:
    """The fiscal year of a period end, given the month in which fiscal years end.

    A period that ends in the first five days of the month after counts as
    ending in the fiscal year's last month.
    """
    end, fye = col(end), col(fye)
    month = F.month(end)
    late = (month == fye % 12 + 1) & (F.dayofmonth(end) <= 5)
    counted = F.when(late, fye).otherwise(month)
    year = F.year(end) + F.when(counted > fye, 1).otherwise(0)
    return (year - F.when(late & (month < fye), 1).otherwise(0)).cast("int")


def form_type(amended: str | Column) -> Column:
    """P2"""
    return F.when(col(amended), F.lit("10-K/A")).otherwise(F.lit("10-K"))


def parse_sic(raw: str | Column) -> Column:
    """What is no number becomes 0, which no filter excludes."""
    return F.coalesce(F.expr("try_cast({} as int)".format(raw)) if isinstance(raw, str) else raw.try_cast("int"), F.lit(0))


def parse_fye_month(raw: str | Column) -> Column:
    """The month in the first two characters; NULL if there is none."""
    c = col(raw)
    return F.when(F.length(c) >= 2, F.substring(c, 1, 2).try_cast("int"))


def safe_log(c: str | Column) -> Column:
    """P5"""
    return F.when(col(c) > 0, F.ln(col(c)))


def ratio(num: str | Column, den: str | Column) -> Column:
    """NULL unless the denominator is positive."""
    return F.when(col(den) > 0, col(num) / col(den))


def guarded_growth(now: str | Column, before: str | Column, days: Column, low: int = 300, high: int = 400) -> Column:
    """Growth over a predecessor that is positive and 300 to 400 days away."""
    return F.when((col(before) > 0) & days.between(low, high), (col(now) - col(before)) / col(before))


def identity_fill(part: str | Column, whole: str | Column, other: str | Column) -> Column:
    """part = whole - other where it is missing."""
    return F.coalesce(col(part), col(whole) - col(other))


def sic2(sic: str | Column) -> Column:
    """P12"""
    return F.floor(col(sic) / 100).cast("int")


def without_helpers(columns: Sequence[str], prefixes: Sequence[str] = ("_",)) -> list[str]:
    """The columns that are no helpers."""
    return [c for c in columns if not c.startswith(tuple(prefixes))]


def one_line(text: str | Column) -> Column:
    """P14"""
    return F.regexp_replace(col(text), "\n", " ")


def word_count(text: str | Column) -> Column:
    """Tokens between white space (Unicode's too); 0 for NULL."""
    words = F.filter(F.split(col(text), r"(?U)\s+", -1), lambda w: w != "")
    return F.coalesce(F.size(words), F.lit(0)).cast("int")


def quality_tag(criteria: Sequence[str | Column]) -> Column:
    """PASS, MINOR, PARSE_ERR or FAIL from the criteria's scores."""
    cs = [col(c) for c in criteria]
    every = lambda *ok: reduce(lambda a, b: a & b, [F.coalesce(c.isin(*ok), F.lit(False)) for c in cs])
    return F.when(every("Pass"), "PASS").when(every("Pass", "Minor"), "MINOR").when(~every("Pass", "Minor", "Fail"), "PARSE_ERR").otherwise("FAIL")


def stars(p: str | Column) -> Column:
    """P18"""
    p = col(p)
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.10, "*").otherwise("")


def era(year: str | Column, bins: Sequence[tuple[int, int]] = ERAS) -> Column:
    """The label of the inclusive bin that holds the year."""
    y = col(year)
    return reduce(lambda c, b: c.when(y.between(*b), F.lit(f"{b[0]}-{b[1]}")), bins[1:], F.when(y.between(*bins[0]), F.lit(f"{bins[0][0]}-{bins[0][1]}")))


def clip(c: str | Column, low: Column, high: Column) -> Column:
    """NULL stays NULL, although least and greatest skip NULLs."""
    return F.when(col(c).isNotNull(), F.least(F.greatest(col(c), low), high))
