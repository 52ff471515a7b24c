"""Column functions: ratios, numbers kept as text, years, codes, labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The order in which labels and income groups are reported.
LABEL_ORDER = ("SDG_2", "SDG_3", "SDG_13")
INCOME_ORDER = ("High income", "Upper middle income", "Lower middle income", "Low income")


def column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: str | Column, b: str | Column) -> Column:
    """``a / b`` as a double, null where ``b`` is zero."""
    return F.try_divide(column(a).cast("double"), column(b).cast("double"))


def number(c: str | Column) -> Column:
    """Text as a double, null where it is not a number."""
    return column(c).try_cast("double")


def european_number(c: str | Column) -> Column:
    """Text such as ``1.234,5`` as a double, null where it is not a number."""
    plain = F.regexp_replace(column(c), r"\.", "")
    return F.regexp_replace(plain, ",", ".").try_cast("double")


def clean(c: str | Column) -> Column:
    """A double with NaN turned into null."""
    value = column(c).cast("double")
    return F.when(~F.isnan(value), value)


def last_year(period: str | Column) -> Column:
    """The four digits that end a period such as ``2015-2018``, null without them."""
    return F.regexp_substr(column(period), F.lit(r"\d{4}$")).try_cast("int")


def year_date(year: str | Column) -> Column:
    """The first of January of a year."""
    return F.make_date(column(year).try_cast("int"), F.lit(1), F.lit(1))


def rank_in(c: str | Column, order: Sequence[str]) -> Column:
    """The place of a value in a fixed order, null for other values."""
    place = F.array_position(F.array(*[F.lit(v) for v in order]), column(c)).cast("int")
    return F.when(place > 0, place)


def rounded_text(c: str | Column, digits: int = 2) -> Column:
    """A rounded number without trailing zeros; ``NA`` for null."""
    fixed = F.format_string(f"%.{digits}f", F.round(column(c), digits) + F.lit(0.0))
    short = F.regexp_replace(F.regexp_replace(fixed, r"0+$", ""), r"\.$", "")
    return F.coalesce(F.when(column(c).isNotNull(), short), F.lit("NA"))


def correlation_text(c: str | Column) -> Column:
    return F.concat(F.lit("r = "), rounded_text(c))


def key_or(c: str | Column, key: str, default: str) -> Column:
    """A map entry, or the default where the key is missing."""
    return F.coalesce(F.try_element_at(column(c), F.lit(key)), F.lit(default))


def total(c: str | Column) -> Column:
    """A sum that skips nulls and is zero when there is nothing to add."""
    return F.coalesce(F.sum(column(c)), F.lit(0.0))


def settled(c: str | Column) -> Column:
    """A sum of weights without the last digits, which depend on the order of adding.
    For comparing such a sum with a limit."""
    return F.round(column(c), 6)


def strict_mean(c: str | Column) -> Column:
    """A mean that is null as soon as one value is null."""
    return F.when(F.count("*") == F.count(column(c)), F.avg(column(c)))


def share_true(flag: str | Column) -> Column:
    """The share of true values; a null flag is left out."""
    return F.avg(column(flag).cast("double"))


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation over complete pairs; null without variance.

    Built from the regression sums, which count complete pairs only and give no
    division by zero under ANSI rules.
    """
    x, y = clean(x), clean(y)
    spread = F.sqrt(F.regr_sxx(y, x) * F.regr_syy(y, x))
    return F.try_divide(F.regr_sxy(y, x), spread)
