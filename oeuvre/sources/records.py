"""Nested records of institutions and of yearly counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oeuvre.functions.columns import key_or
from oeuvre.operators.relations import left_join
from oeuvre.operators.shares import share_of_total
from oeuvre.sources.schemas import INSTITUTION


def parse_institutions(text: Column | str) -> Column:
    """JSON text of an institution as a struct, absent fields null."""
    return F.from_json(text, INSTITUTION)


def import_institutions(institutions: DataFrame, codes: DataFrame, key: str = "mag") -> DataFrame:
    """Institutions with the id they have in another catalogue, and long country codes.

    An institution without such an id gets the empty text.
    """
    with_id = institutions.withColumn("affiliationid", key_or("ids", key, "")).drop("ids")
    return left_join(with_id, codes, {"country_code": "Alpha2"}, "match")


def count_rows(years: DataFrame) -> DataFrame:
    """Lists of count records as one row per record, with the year of the list."""
    one = years.select("year", F.explode("records").alias("record"))
    return one.select("year", F.col("record.key_display_name").alias("is_oa"), F.col("record.count").alias("count"))


def count_record_share(years: DataFrame) -> DataFrame:
    """Share of open papers in each year's count records."""
    shares = share_of_total(count_rows(years), "count", "year", name="prop")
    return shares.filter(F.col("is_oa") == "true")
