"""Open-access shares by year, by country, and beside economic indicators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oeuvre.functions.columns import correlation, ratio, settled
from oeuvre.operators.authorship import AFFILIATION, PAPER, SEQUENCE, by_country, with_last_place
from oeuvre.operators.relations import complete, left_join
from oeuvre.operators.shares import count_by, share_of_total
from oeuvre.operators.skew import HOT_ROWS


def open_share(papers: DataFrame, *keys: str) -> DataFrame:
    """Share of open papers among those whose status is known."""
    known = papers.filter(F.col("is_oa").isNotNull())
    shares = share_of_total(count_by(known, *keys, "is_oa"), "n", keys, name="oa_share")
    return shares.filter("is_oa")


def open_by_country(
    papers: DataFrame,
    authors: DataFrame,
    affiliations: DataFrame,
    years: tuple[int, int],
    *keys: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Open and closed output of countries, each author row weighing 1 / team size.

    The weight goes to every row of paper, label, author and affiliation, as the
    measure is defined, so authors with several affiliations count more than once.
    The year belongs to the paper, so it is filtered before the authors are joined.
    """
    known = papers.filter(F.col("is_oa").isNotNull() & F.col("year").between(*years))
    rows = with_last_place(known.select(PAPER, "is_oa", *keys), authors.select(PAPER, AFFILIATION, SEQUENCE), hot_rows)
    rows = rows.withColumn("_weight", ratio(F.lit(1), "_last"))
    cells = rows.groupBy(AFFILIATION, *keys, "is_oa").agg(F.sum("_weight").alias("sum_frac_oa"))
    sums = by_country(cells, affiliations, "sum_frac_oa", *keys, "is_oa")
    return share_of_total(sums, "sum_frac_oa", ["country", *keys], name="prop_oa", total="sum_frac_total")


def indicator_means(
    indicators: DataFrame, years: tuple[int, int], codes: Sequence[str] | None = None
) -> DataFrame:
    """Mean of each indicator of a country over some years; nulls and NaN are skipped."""
    chosen = indicators.filter(F.col("year").between(*years))
    if codes:
        chosen = chosen.filter(F.col("indicator_code").isin(*codes))
    value = F.when(~F.isnan("value"), F.col("value"))
    keys = ["country_name", "country_code", "indicator_code", "indicator_name"]
    return chosen.groupBy(*keys).agg(F.avg(value).alias("value"))


def pair_indicator(
    shares: DataFrame,
    indicators: DataFrame,
    codes: Sequence[str],
    years: tuple[int, int],
    countries: DataFrame | None = None,
    least: float = 0.0,
) -> DataFrame:
    """Open shares of countries beside one column for each indicator.

    Countries without a value for some indicator are dropped, as are those whose
    output is below ``least``.  ``countries`` adds attributes by ``country_code``.
    """
    means = indicator_means(indicators, years, codes)
    wide = means.groupBy("country_code", "country_name").pivot("indicator_code", list(codes)).agg(F.first("value"))
    paired = complete(shares.join(wide.withColumnRenamed("country_code", "country"), "country"))
    paired = paired.filter(F.col("is_oa") & (settled("sum_frac_total") >= least))
    return left_join(paired, countries, {"country": "country_code"}, "match") if countries is not None else paired


def proper_countries(countries: DataFrame) -> DataFrame:
    """Countries, as opposed to aggregates: entries that have a currency."""
    known = countries.filter(F.col("currency_unit").isNotNull())
    return known.select("country_code", "short_name", "region", "income_group")


def open_prestige_correlation(matched: DataFrame, least: float = 50.0, label: str = "SDG_label") -> DataFrame:
    """Correlation of open share and prestige over institutions, by year and label."""
    share = ratio("n_frac_oa_papers", "n_frac_papers")
    ranked = matched.filter((settled("n_frac_papers") > least) & F.col("P_top10").isNotNull())
    return ranked.withColumn("oa_share", share).groupBy("year", label).agg(correlation("oa_share", "P_top10").alias("cor"))
