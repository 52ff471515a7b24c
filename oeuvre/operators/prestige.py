"""University rankings beside the output of institutions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oeuvre.functions.columns import clean, correlation, correlation_text, last_year, number
from oeuvre.operators.quantiles import QUINTILES, bin_label, box_stats_log10, counted_breaks
from oeuvre.operators.relations import left_join
from oeuvre.operators.shares import proportions
from oeuvre.operators.skew import HOT_ROWS, lookup_join

# Ranking entries that are used, its numeric columns, texts of the report.
ALL_FIELDS = "All sciences"
RANKING_NUMBERS = ("P_top10", "PP_top10", "impact_P")
CITATIONS_TEXT = "# of citations (fractional)"
PUBLICATIONS_TEXT = "# of publications (fractional)"


def clean_ranking(ranking: DataFrame, field: str = ALL_FIELDS) -> DataFrame:
    """Fractionally counted entries of one field, with numbers read from text.

    ``last_year_of_period`` ties a ranking period to a year of output.
    """
    chosen = ranking.filter((F.col("Field") == field) & (F.col("Frac_counting") == 1))
    chosen = chosen.select("University", "Country", "Period", *RANKING_NUMBERS)
    numbers = {c: number(c) for c in RANKING_NUMBERS}
    return chosen.withColumns({**numbers, "last_year_of_period": last_year("Period")})


def match_prestige(output: DataFrame, key: DataFrame, ranking: DataFrame, null_keys: str = "match") -> DataFrame:
    """Output of institutions with the ranking of the period that ends that year.

    An institution may map to several universities and the other way round; every
    pair is kept.  ``null_keys`` tells whether an unknown institution may meet an
    unknown one in the key.  Most institutions are in no ranking, so their rows
    carry no university; they are spread over the shuffle, as they match nothing.
    """
    named = left_join(output, key, "affiliationid", null_keys)
    periods = ranking.withColumnRenamed("last_year_of_period", "year")
    return lookup_join(named, periods, ["University", "year"], hot_rows=None)


def inclusion_rows(matched: DataFrame, year: int, merge_labels: bool = False) -> DataFrame:
    """One row per output measure of a year, flagged by presence in the ranking.

    ``merge_labels`` names the measures for a report, where papers and open
    papers both read as publications.
    """
    chosen = matched.filter(F.col("year") == year)
    flag = F.when(F.col("University").isNotNull(), "matched").otherwise("unmatched")
    measures = [c for c in chosen.columns if c.startswith("n_")]
    others = [c for c in chosen.columns if c not in measures]
    long = chosen.withColumn("in_ranking", flag).unpivot([*others, "in_ranking"], measures, "indicator", "value")
    if merge_labels:
        text = F.when(F.col("indicator") == "n_frac_citations", CITATIONS_TEXT).otherwise(PUBLICATIONS_TEXT)
        long = long.withColumn("indicator", text)
    return long


def inclusion_stats(
    matched: DataFrame,
    year: int,
    label: str = "SDG_label",
    merge_labels: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Box statistics of ranked and unranked institutions by label and measure."""
    rows = inclusion_rows(matched, year, merge_labels).select(label, "indicator", "in_ranking", "value")
    return box_stats_log10(rows, "value", [label, "indicator", "in_ranking"], hot_rows)


def pairwise_correlation(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Correlation over complete pairs in each group, with its text."""
    found = df.groupBy(*by).agg(correlation(x, y).alias("cor"))
    return found.withColumn("label", correlation_text("cor"))


def prestige_correlation(
    matched: DataFrame, year: int, x: str = "P_top10", y: str = "n_frac_papers", label: str = "SDG_label"
) -> DataFrame:
    """Correlation of prestige and output in a year, over institutions with a known impact."""
    chosen = matched.filter((F.col("year") == year) & F.col("impact_P").isNotNull())
    return pairwise_correlation(chosen, x, y, label)


def prestige_bins(
    matched: DataFrame,
    columns: Sequence[str] = RANKING_NUMBERS,
    labels: Sequence[str] = QUINTILES,
) -> DataFrame:
    """Ranked rows with prestige measures as quantile bins of their period.

    The breaks are those of the matched rows, so a university counts once for
    every institution, year and label it is matched to.  The breaks come from
    counts of the ranking's values, one row a period; only these meet the rows,
    which stay where they are.
    """
    ranked = matched.filter(F.col("P_top10").isNotNull())
    cells = ranked.groupBy("Period", *columns).agg(F.count("*").alias("_copies"))
    for column in columns:
        breaks = counted_breaks(cells, column, "_copies", "Period", len(labels))
        ranked = left_join(ranked, breaks, "Period", null_keys="match")
        ranked = ranked.withColumn(column, bin_label(clean(column), F.col("_breaks"), labels)).drop("_breaks")
    return ranked


def bin_shares(
    matched: DataFrame,
    *keys: str,
    column: str = "P_top10",
    value: str = "n_frac_papers",
    labels: Sequence[str] = QUINTILES,
) -> DataFrame:
    """Share of output that falls to each prestige bin.

    Rows are summed by keys, period and value of the ranking first: those cells
    give both the breaks and, once labelled, the shares.
    """
    ranked = matched.filter(F.col("P_top10").isNotNull())
    by = dict.fromkeys([*keys, "Period", column])
    cells = ranked.groupBy(*by).agg(F.sum(value).alias("_sum"), F.count("*").alias("_copies"))
    cells = left_join(cells, counted_breaks(cells, column, "_copies", "Period", len(labels)), "Period", null_keys="match")
    cells = cells.withColumn(column, bin_label(clean(column), F.col("_breaks"), labels))
    return proportions(cells, column, "_sum", *keys)


def bin_shares_with_baseline(
    matched: DataFrame, corpus: DataFrame, label: str = "SDG_label"
) -> DataFrame:
    """Bin shares of each label and of the corpus, told apart by ``series``."""
    sample = bin_shares(matched, label, "year").withColumn("series", F.lit("sample"))
    base = bin_shares(corpus, "year").withColumn("series", F.lit("baseline"))
    return sample.unionByName(base, allowMissingColumns=True)
