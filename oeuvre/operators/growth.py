"""Year-on-year growth and compound annual growth of report series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oeuvre.functions.columns import ratio


def yearly_growth(series: DataFrame, value: str, by: str, order: str = "year", name: str = "prop_change") -> DataFrame:
    """Change against the previous row of the series; zero where there is none.

    ``series`` is a finished aggregate, one row for each group and year.
    """
    previous = F.lag(value).over(Window.partitionBy(by).orderBy(order))
    return series.withColumn(name, F.coalesce(ratio(value, previous), F.lit(1.0)) - 1)


def compound_growth(
    series: DataFrame, values: dict[str, str], by: str, first: int, last: int, order: str = "year"
) -> DataFrame:
    """Growth factor and annual rate from the first to the last year.

    ``values`` maps columns to the prefix of the two results.  A missing year
    gives null.
    """
    def at(column: str, year: int):
        return F.max(F.when(F.col(order) == year, F.col(column)))

    factors = [ratio(at(c, last), at(c, first)).alias(f"{p}_growth_factor") for c, p in values.items()]
    ends = series.filter(F.col(order).isin(first, last)).groupBy(by).agg(*factors)
    power = F.lit(1.0 / (last - first))
    rates = {f"{p}_growth_rate": F.pow(f"{p}_growth_factor", power) - 1 for p in values.values()}
    return ends.withColumns(rates)
