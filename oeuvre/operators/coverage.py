"""How well the countries of affiliations are known, and how to fill the gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oeuvre.functions.columns import share_true
from oeuvre.operators.authorship import AFFILIATION
from oeuvre.operators.relations import left_join, uncovered


def seen_affiliations(authors: DataFrame, affiliations: DataFrame) -> DataFrame:
    """Every affiliation of the author table, with what is known about it."""
    return left_join(authors.select(AFFILIATION).distinct(), affiliations, AFFILIATION)


def coverage(rows: DataFrame, column: str, name: str = "country_share") -> DataFrame:
    """Share of rows in which ``column`` is known."""
    return rows.agg(share_true(F.col(column).isNotNull()).alias(name))


def missing_ids(authors: DataFrame, affiliations: DataFrame) -> DataFrame:
    """Affiliations of the author table without a country."""
    ids = authors.select(AFFILIATION).distinct()
    return uncovered(ids, affiliations.select(AFFILIATION, "country"), AFFILIATION, "country").select(AFFILIATION)


def one_country(source: DataFrame) -> DataFrame:
    """The country (alpha-3) of each affiliation in a second source: the first in order of its codes, if it states several."""
    return source.groupBy(AFFILIATION).agg(F.min("Alpha3").alias("country"))


def gap_coverage(missing: DataFrame, source: DataFrame) -> DataFrame:
    """Share of the missing affiliations whose country a second source can fill."""
    return coverage(left_join(missing, one_country(source), AFFILIATION, "match"), "country")


def compared(known: DataFrame, source: DataFrame) -> DataFrame:
    """Affiliations known to both sources, and whether the countries agree."""
    both = known.filter(F.col("country").isNotNull()).join(source.filter(F.col("Alpha3").isNotNull()), AFFILIATION)
    return both.withColumn("same_country", F.col("country") == F.col("Alpha3"))


def agreement(known: DataFrame, source: DataFrame) -> DataFrame:
    return compared(known, source).agg(share_true("same_country").alias("correct_countries"))


def disagreements(known: DataFrame, source: DataFrame) -> DataFrame:
    return compared(known, source).filter(~F.col("same_country"))


def gap_file(known: DataFrame, source: DataFrame) -> DataFrame:
    """Affiliations without a country, with the country of the second source."""
    gaps = known.filter(F.col("country").isNull()).drop("country")
    return left_join(gaps, one_country(source), AFFILIATION, "match")
