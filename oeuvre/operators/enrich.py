"""Open-access class, funding and normalised citations of papers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oeuvre.functions.columns import ratio
from oeuvre.operators.skew import HOT_ROWS, lookup_join, split_join

OA_COLUMNS = ("doi", "is_oa", "oa_status", "has_repository_copy", "provider_cat")


def oa_provider_class(open_access: DataFrame) -> DataFrame:
    """Where a paper is openly available, judged by its best locations.

    Best locations are picked inside the array, before it is flattened.  A paper
    with best locations of several hosts has several rows.  Open papers without a
    best location and papers of unknown status have none.
    """
    best = F.filter("oa_locations", lambda place: place["is_best"])
    hosts = F.array_distinct(F.transform(best, lambda place: place["host_type"]))
    status = [F.col(c) for c in OA_COLUMNS[:-1]]
    located = open_access.select(*status, F.explode(hosts).alias("host")).distinct()
    journal, repository = F.col("host") == "publisher", F.col("host") == "repository"
    located = located.withColumn(
        "provider_cat",
        F.when(repository, "Repository only")
        .when(journal & F.col("has_repository_copy"), "Journal & Repository")
        .when(journal, "Journal only"),
    )
    closed = open_access.filter(~F.col("is_oa")).select(*status, F.lit("Not OA").alias("provider_cat"))
    return located.select(*OA_COLUMNS).unionByName(closed)


def with_open_access(
    papers: DataFrame, open_access: DataFrame, hot_rows: int = HOT_ROWS, count: DataFrame | None = None
) -> DataFrame:
    """Papers with their open-access variants; equal variants count once."""
    return lookup_join(papers, oa_provider_class(open_access).distinct(), "doi", hot_rows, count)


def with_funding(
    papers: DataFrame, funders: DataFrame, hot_rows: int = HOT_ROWS, count: DataFrame | None = None
) -> DataFrame:
    """Flag papers whose DOI a funder reports.  DOIs are made distinct first, so
    that several reports of one paper do not multiply it."""
    reported = funders.select("doi").distinct().withColumn("is_funded", F.lit(True))
    return lookup_join(papers, reported, "doi", hot_rows, count).na.fill({"is_funded": False})


def funders_in_sample(funders: DataFrame, papers: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Funder rows of the sampled papers.  An empty DOI stands for none."""
    named = papers.filter(F.col("doi") != "").select("paperid", "doi").distinct()
    return split_join(funders, named, "doi", "inner", hot_rows)


def conference_means(conferences: DataFrame) -> DataFrame:
    mean = ratio("citationcount", "papercount").alias("mean_conf_citations")
    return conferences.select("conferenceinstanceid", mean)


def normalised_citations(
    papers: DataFrame,
    journals: DataFrame,
    conferences: DataFrame,
    hot_rows: int = HOT_ROWS,
    count: DataFrame | None = None,
) -> DataFrame:
    """Citations over the mean of the conference, or else of the journal and year.

    A paper with a conference is measured by it even if its mean is missing.
    """
    count = papers if count is None else count
    means = journals.select("journalid", "year", "mean_citations")
    placed = lookup_join(papers, means, ["journalid", "year"], hot_rows, count)
    placed = lookup_join(placed, conference_means(conferences), "conferenceinstanceid", hot_rows, count)
    mean = F.when(F.col("conferenceinstanceid").isNotNull(), F.col("mean_conf_citations")).when(
        F.col("journalid").isNotNull(), F.col("mean_citations")
    )
    return placed.withColumn("citations_norm", ratio("citationcount", mean))


def collated_papers(
    papers: DataFrame,
    open_access: DataFrame,
    funders: DataFrame,
    journals: DataFrame,
    conferences: DataFrame,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Papers with every enrichment; one row for each open-access variant."""
    rows = with_open_access(papers.distinct(), open_access, hot_rows, count=papers)
    rows = with_funding(rows, funders, hot_rows, count=papers)
    return normalised_citations(rows, journals, conferences, hot_rows, count=papers)
