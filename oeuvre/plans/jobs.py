"""The jobs: select a sample, enrich it, complete the countries, and report.

Jobs hand over to each other in Parquet below one output folder, so each shared
step runs once and a lost executor costs no more than its own tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oeuvre.operators import authorship, coverage, enrich, gender, growth, open_access, prestige, relations, sample, shares
from oeuvre.sources import files, records, schemas


@dataclass(frozen=True)
class SampleJob:
    """Where the catalogue, the topic file and the results are, and what to select."""

    database: str | None
    ontology: str
    out: str
    labels: Sequence[str] = sample.LABELS
    max_level: int = sample.MAX_LEVEL
    min_score: float = sample.MIN_SCORE
    years: tuple[int, int] = sample.YEARS
    csv: bool = True


def _stage(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path, mode="overwrite")
    return df.sparkSession.read.parquet(path)


def select_sample(spark: SparkSession, job: SampleJob) -> dict[str, DataFrame]:
    """Write the sampled papers, their labels and their author rows."""
    table = lambda name: files.catalog_table(spark, name, job.database)
    ontology = files.delimited(spark, job.ontology, files.SEMICOLON)
    ontology = ontology.select("SDG_label", F.col("fos_id").try_cast("bigint").alias("fos_id"))
    topics = sample.topic_fields(ontology, table("fieldsofstudy"), job.labels, job.max_level)
    matches = sample.topic_matches(topics, table("paperfieldsofstudy"), job.min_score)
    matches = _stage(matches.select("paperid", "fieldofstudyid", "SDG_label"), f"{job.out}/matches")
    chosen = _stage(sample.topic_sample(matches, table("papers"), job.years), f"{job.out}/sample")
    found = {
        "sdg_papers": sample.sample_papers(chosen, matches),
        "sdg_labels": sample.sample_labels(chosen),
        "sdg_author_paper_affil": sample.sample_authors(chosen, table("paperauthoraffiliations")),
    }
    found = {name: _stage(df, f"{job.out}/{name}") for name, df in found.items()}
    if job.csv:
        for name, df in found.items():
            files.write_quoted(df, f"{job.out}/{name}.csv")
    return found


@dataclass(frozen=True)
class EnrichJob:
    database: str | None
    out: str
    open_access: str
    funders: str
    journals: str
    csv: bool = True


def enrich_sample(spark: SparkSession, job: EnrichJob) -> DataFrame:
    """Write the sampled papers with open access, funding and normalised citations."""
    papers = spark.read.parquet(f"{job.out}/sdg_papers")
    places = files.parquet(
        spark, job.open_access, "doi", "is_oa", "oa_status", "has_repository_copy", "oa_locations"
    )
    funders = files.delimited(spark, job.funders)
    journals = files.delimited(spark, job.journals, schema=schemas.JOURNALS)
    conferences = files.catalog_table(spark, "conferenceinstances", job.database)
    collated = enrich.collated_papers(papers, places, funders, journals, conferences).distinct()
    collated = _stage(collated, f"{job.out}/sdg_papers_collated")
    if job.csv:
        files.write_quoted(collated, f"{job.out}/sdg_papers_collated.csv")
    return collated


@dataclass(frozen=True)
class CountryJob:
    """Author and affiliation files, and records and codes of a second source."""

    authors: str
    affiliations: str
    records: str
    codes: str
    out: str


def import_countries(spark: SparkSession, job: CountryJob) -> DataFrame:
    """Write the countries of the institution records that carry an affiliation id."""
    found = files.records(spark, job.records, schemas.INSTITUTION)
    codes = files.delimited(spark, job.codes, schema=schemas.COUNTRY_CODES)
    imported = records.import_institutions(found.select("ids", "country_code"), codes)
    ids = imported.withColumn("affiliationid", F.col("affiliationid").try_cast("bigint"))
    known = relations.complete(ids, ["affiliationid"]).select("affiliationid", "country_code", "Alpha3")
    return _stage(known, f"{job.out}/affiliation_countries")


def complete_countries(spark: SparkSession, job: CountryJob) -> dict[str, DataFrame]:
    """Write the file that fills missing countries, and audit both sources.

    Affiliations the author table mentions are written once, for all five tables.
    """
    source = import_countries(spark, job)
    authors = files.tabs(spark, job.authors, schemas.AUTHORS)
    places = files.delimited(spark, job.affiliations, files.NULL_TOKEN, schemas.AFFILIATIONS)
    seen = _stage(coverage.seen_affiliations(authors, places), f"{job.out}/seen_affiliations")
    missing = seen.filter(F.col("country").isNull()).select("affiliationid")
    filled = _stage(coverage.gap_file(seen, source), f"{job.out}/additional_country_information")
    files.write_report(filled, f"{job.out}/additional_country_information.csv")
    return {
        "coverage": coverage.coverage(seen, "country"),
        "gap_coverage": coverage.gap_coverage(missing, source),
        "agreement": coverage.agreement(seen, source),
        "disagreements": coverage.disagreements(seen, source),
        "gap_file": filled,
    }


@dataclass(frozen=True)
class Inputs:
    """Tables of the report.  ``extra_countries`` fills gaps in the affiliations."""

    papers: DataFrame
    labels: DataFrame
    authors: DataFrame
    corpus: DataFrame
    corpus_authors: DataFrame
    affiliations: DataFrame
    extra_countries: DataFrame
    countries: DataFrame
    incomes: DataFrame
    ranking: DataFrame
    ranking_key: DataFrame
    indicators: DataFrame
    people: DataFrame | None = None


@dataclass(frozen=True)
class Paths:
    """Files of the report: ``sample`` is the output folder of the first two jobs."""

    sample: str
    corpus: str
    corpus_authors: str
    affiliations: str
    extra_countries: str
    countries: str
    incomes: str
    ranking: str
    ranking_key: str
    indicators: str
    people: str | None = None


def read_inputs(spark: SparkSession, paths: Paths) -> Inputs:
    """Open every input in its format.  Key and country files use ``;`` between columns."""
    table = lambda path, schema, options=files.HEADER, names=None: files.delimited(spark, path, options, schema, names)
    key = files.european(spark, paths.ranking_key, ["affiliationid"])
    key = key.select(F.col("affiliationid").cast("bigint").alias("affiliationid"), "University")
    return Inputs(
        papers=spark.read.parquet(f"{paths.sample}/sdg_papers_collated"),
        labels=spark.read.parquet(f"{paths.sample}/sdg_labels"),
        authors=spark.read.parquet(f"{paths.sample}/sdg_author_paper_affil"),
        corpus=files.tabs(spark, paths.corpus, schemas.CORPUS),
        corpus_authors=files.tabs(spark, paths.corpus_authors, schemas.AUTHORS),
        affiliations=table(paths.affiliations, schemas.AFFILIATIONS, files.NULL_TOKEN),
        extra_countries=spark.read.parquet(paths.extra_countries).select("affiliationid", "country"),
        countries=table(paths.countries, schemas.COUNTRIES, files.SEMICOLON, schemas.COUNTRY_HEADER),
        incomes=table(paths.incomes, schemas.INCOME_COUNTRIES, files.HEADER, schemas.INCOME_HEADER),
        ranking=table(paths.ranking, schemas.RANKING),
        ranking_key=key,
        indicators=table(paths.indicators, schemas.INDICATORS),
        people=table(paths.people, schemas.AUTHOR_METADATA) if paths.people else None,
    )


def report(
    tables: Inputs,
    out: str,
    years: tuple[int, int] = (2006, 2019),
    open_years: tuple[int, int] = (2015, 2018),
    year: int = 2018,
    codes: Sequence[str] = ("NY.GDP.PCAP.KD",),
    least: float = 50.0,
) -> dict[str, DataFrame]:
    """Every table of the analysis, written below ``out``/report and read from there.

    The needed columns of the corpus, which comes as text, counts by country and
    output beside rankings are written once, as several tables start from them.
    """
    stage = lambda df, name: _stage(df, f"{out}/stages/{name}")
    label, country = "SDG_label", {"country": "country_code"}
    papers = tables.papers.filter(F.col("year") <= years[1]).join(tables.labels, "paperid")
    columns = [c for c in ("paperid", "year", "citationcount", "is_oa", "citations_norm") if c in tables.corpus.columns]
    corpus = stage(tables.corpus.select(*columns).filter(F.col("year").between(*years)), "corpus")
    authors = stage(tables.corpus_authors.select("paperid", "authorid", "affiliationid", "authorsequencenumber"), "corpus_authors")
    filled = relations.backfill(tables.affiliations, tables.extra_countries, "affiliationid", "country")

    counts = shares.count_by(papers, label, "year")
    trend = shares.share_of_baseline(counts, shares.count_by(corpus, "year", name="overall_n"), "year")
    label_rows = papers.select("paperid", label, "year")
    by_label = stage(authorship.country_counts(label_rows, tables.authors, tables.affiliations, "year", label), "by_label")
    by_year = stage(authorship.country_counts(corpus.select("paperid", "year"), authors, filled, "year"), "by_year")
    found = {
        "sample_size": shares.row_count(papers.select("paperid").distinct()),
        "label_counts": shares.count_by(papers, label),
        "label_years": shares.count_by(papers.filter(F.col("year").isin(*years)), "year", label),
        "country_positions": authorship.country_counts(
            label_rows, tables.authors, tables.affiliations, "year", label, "author_position"
        ),
        "growth": growth.yearly_growth(trend, "prop", label),
        "compound_growth": growth.compound_growth(trend, {"overall_n": "overall", "n": "individual"}, label, *years),
        "institutions": authorship.institutions_by_output(papers, tables.authors, tables.affiliations),
        "open_share": open_access.open_share(papers, label, "year"),
        "coverage": coverage.coverage(coverage.seen_affiliations(authors, tables.affiliations), "country"),
    }
    incomes = tables.incomes.select("country_code", "region", "short_name", "income_group")
    for name, groups, group in (("region", tables.countries, "sub_continent"), ("income", incomes, "income_group")):
        part = shares.group_shares(by_label, groups, country, group, [label, "year"])
        whole = shares.group_shares(by_year, groups, country, group, ["year"])
        ratios = shares.specialisation(part, whole, ["year", group])
        found[f"{name}_specialisation"] = ratios
        found[f"{name}_means"] = shares.mean_by(ratios, "specialisation", group, label)
    found["region_report"] = shares.region_report(found["region_specialisation"])
    if tables.people is not None:
        for name, keys in (("gender", [label, "year"]), ("gender_position", [label, "year", "author_position"])):
            found[name] = gender.gender_share(papers, tables.authors, tables.people, *keys, before=years[1] + 1)

    output = authorship.fractional_productivity(papers, tables.authors)
    corpus_output = authorship.fractional_corpus(corpus, authors)
    ranking = prestige.clean_ranking(tables.ranking)
    matched = stage(prestige.match_prestige(output, tables.ranking_key, ranking), "matched")
    matched_corpus = prestige.match_prestige(corpus_output, tables.ranking_key, ranking)
    found["inclusion"] = prestige.inclusion_stats(matched, year, merge_labels=True)
    found["prestige_correlation"] = prestige.prestige_correlation(matched, year)
    found["bin_shares"] = prestige.bin_shares_with_baseline(matched, matched_corpus)
    found["open_prestige_correlation"] = open_access.open_prestige_correlation(matched, least)

    proper = open_access.proper_countries(tables.incomes)
    for name, keys in (("open_indicator", ()), ("open_indicator_label", (label,))):
        open_rows = open_access.open_by_country(papers, tables.authors, tables.affiliations, open_years, *keys)
        found[name] = open_access.pair_indicator(open_rows, tables.indicators, codes, open_years, proper, least)
    return {name: _stage(df, f"{out}/report/{name}") for name, df in found.items()}
