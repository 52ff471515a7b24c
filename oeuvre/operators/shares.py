"""Counts, shares of a total and specialisation against a baseline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oeuvre.functions.columns import ratio, strict_mean
from oeuvre.operators.relations import complete, left_join, not_in
from oeuvre.operators.skew import names

# Regions left out of the report, and regions marked in it.
SMALL_REGIONS = ("Melanesia", "Polynesia", "Micronesia")
MAIN_REGIONS = ("Northern America", "Western Europe", "Northern Europe", "Eastern Asia")


def row_count(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count("*").alias(name))


def count_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    """Rows for each combination of keys; null is a value like any other."""
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def sum_by(df: DataFrame, value: str, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(value).alias(name))


def share_of_total(
    cells: DataFrame,
    value: str,
    within: str | Sequence[str],
    name: str = "share",
    total: str | None = None,
) -> DataFrame:
    """Each cell's part of the sum over ``within``, optionally with that sum.

    ``cells`` is a finished aggregate with one row per cell, so a partition holds
    as many rows as there are cells in a report group.  A total over all cells is
    a scalar subquery.
    """
    within = names(within)
    if within:
        cells = cells.withColumn("_total", F.sum(value).over(Window.partitionBy(*within)))
    else:
        cells = cells.withColumn("_total", cells.agg(F.sum(value)).scalar())
    cells = cells.withColumn(name, ratio(value, "_total"))
    return cells.withColumnRenamed("_total", total) if total else cells.drop("_total")


def group_shares(
    counts: DataFrame,
    groups: DataFrame,
    on: dict[str, str],
    group: str,
    within: Sequence[str],
    value: str = "n",
) -> DataFrame:
    """Counts by country turned into shares of country groups.

    Country counts are summed over everything but ``within`` first, so the lookup
    meets one row per country and report cell.  Countries that are unknown, or
    that lack any attribute in ``groups``, are left out.
    """
    ((country, code),) = on.items()
    cells = sum_by(counts, value, country, *within)
    placed = complete(cells.join(groups.withColumnRenamed(code, country), country))
    return share_of_total(sum_by(placed, "n", *within, group, name="nn"), "nn", within)


def share_of_baseline(
    counts: DataFrame, baseline: DataFrame, on: str | Sequence[str], n: str = "n", base: str = "overall_n"
) -> DataFrame:
    """Counts beside the baseline count of the same period and their ratio ``prop``."""
    return left_join(counts, baseline, on, null_keys="match").withColumn("prop", ratio(n, base))


def specialisation(sample: DataFrame, baseline: DataFrame, by: Sequence[str]) -> DataFrame:
    """The sample's share of a group divided by the group's share of the baseline."""
    named = sample.withColumnsRenamed({"nn": "nn_sdg", "share": "share_sdg"})
    paired = left_join(named, baseline, list(by), null_keys="match")
    return paired.withColumn("specialisation", ratio("share_sdg", "share"))


def region_report(
    ratios: DataFrame,
    omit: Sequence[str] = SMALL_REGIONS,
    highlight: Sequence[str] = MAIN_REGIONS,
    group: str = "sub_continent",
) -> DataFrame:
    """Specialisation without regions of very few papers, the main ones marked."""
    return ratios.filter(not_in(group, omit)).withColumn("highlight", F.col(group).isin(*highlight))


def mean_by(df: DataFrame, value: str, *keys: str, name: str | None = None, skip_nulls: bool = False) -> DataFrame:
    agg = F.avg(value) if skip_nulls else strict_mean(value)
    return df.groupBy(*keys).agg(agg.alias(name or f"mean_{value}"))


def proportions(df: DataFrame, indicator: str, value: str, *keys: str) -> DataFrame:
    """Sum of ``value`` by keys and indicator, and its share ``prop`` within the keys."""
    cells = df.groupBy(*keys, indicator).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("n"))
    return share_of_total(cells, "n", keys, name="prop")
