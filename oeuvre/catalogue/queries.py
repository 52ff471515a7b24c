"""Every operator as a query over the driver's tables.

Sums of weights are rounded to four places and ratios to six, so that the order
in which Spark adds numbers up does not show.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oeuvre.catalogue.tables import Tables
from oeuvre.functions import columns as fn
from oeuvre.operators import authorship, coverage, enrich, gender, growth, open_access, order, prestige, quantiles, sample
from oeuvre.operators import relations as rel
from oeuvre.operators import shares
from oeuvre.operators.skew import split_join
from oeuvre.sources import files, records
from oeuvre.sources.schemas import INSTITUTION

LABEL = "SDG_label"
SAMPLE_YEARS = (1996, 2000)
TREND_YEARS = (1995, 2000)
OPEN_YEARS = (1996, 1999)
REPORT_YEAR = 1999
SEGMENTS = ["AUTOMOBILE", "BUILDING"]

Query = Callable[[Tables], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def in_years(df: DataFrame, years: tuple[int, int]) -> DataFrame:
    return df.filter(F.col("year").between(*years))


# Sample ----------------------------------------------------------------------


def matches(t: Tables) -> DataFrame:
    return sample.topic_matches(sample.topic_fields(t.ontology, t.fields), t.scores)


def sampled(t: Tables) -> DataFrame:
    return sample.topic_sample(matches(t), t.papers, SAMPLE_YEARS)


@query
def topic_sample(t):
    found = sampled(t).withColumn("date", F.col("date").cast("string"))
    return found.select("paperid", LABEL, "doi", "doctype", "year", "date", "journalid", "conferenceinstanceid")


@query
def field_list(t):
    return sample.sample_papers(sampled(t), matches(t)).select("paperid", "fosid_aggregated")


@query
def sample_labels(t):
    return sample.sample_labels(sampled(t))


@query
def sample_authors(t):
    return sample.sample_authors(sampled(t), t.authors)


@query
def score_profile(t):
    return rounded(sample.threshold_profiles(t.scores, t.fields, accuracy=10_000), 6, "perc")


@query
def score_quantiles(t):
    """Exact quantiles of the scores of each field level."""
    leveled = split_join(t.scores.select("fieldofstudyid", "score"), t.fields, "fieldofstudyid")
    found = quantiles.exact_quantiles(leveled, "score", "level", quantiles.PROFILE)
    return found.select("level", *[F.round(found.quantiles[i], 6).alias(f"q{i}") for i in range(5)])


# Enrichment ------------------------------------------------------------------


@query
def oa_provider(t):
    return enrich.oa_provider_class(t.open_access)


@query
def oa_variants(t):
    return enrich.with_open_access(t.papers.select("paperid", "doi"), t.open_access)


@query
def funded_flag(t):
    return enrich.with_funding(t.papers.select("paperid", "doi"), t.funders)


@query
def funders_in_sample(t):
    return enrich.funders_in_sample(t.funders, t.labelled)


@query
def norm_citations(t):
    keys = ["paperid", "year", "journalid", "conferenceinstanceid", "citationcount"]
    found = enrich.normalised_citations(t.papers.select(*keys), t.journal_averages, t.conferences)
    return rounded(found.drop("citationcount"), 6, "mean_citations", "mean_conf_citations", "citations_norm")


@query
def collated_papers(t):
    keys = ["paperid", "doi", "year", "journalid", "conferenceinstanceid", "citationcount"]
    papers = t.papers.select(*keys)
    found = enrich.collated_papers(papers, t.open_access, t.funders, t.journal_averages, t.conferences)
    found = found.select("paperid", "doi", "is_oa", "provider_cat", "is_funded", "citations_norm")
    return rounded(found, 6, "citations_norm")


# Counts and growth -----------------------------------------------------------


@query
def sample_size(t):
    return shares.row_count(t.labelled)


@query
def label_counts(t):
    return shares.count_by(t.labelled, LABEL)


@query
def label_counts_years(t):
    chosen = t.labelled.filter(F.col("year").isin(1995, 2000))
    return rel.sorted_report(shares.count_by(chosen, "year", LABEL), LABEL, "year")


def yearly(t: Tables) -> DataFrame:
    counts = shares.count_by(in_years(t.labelled, TREND_YEARS), LABEL, "year")
    overall = shares.count_by(in_years(t.papers, TREND_YEARS), "year", name="overall_n")
    return shares.share_of_baseline(counts, overall, "year")


@query
def corpus_share(t):
    return rounded(rel.complete(yearly(t)), 6, "prop")


@query
def yoy_growth(t):
    return rounded(growth.yearly_growth(yearly(t), "prop", LABEL), 6, "prop", "prop_change")


@query
def cagr(t):
    found = growth.compound_growth(yearly(t), {"overall_n": "overall", "n": "individual"}, LABEL, *TREND_YEARS)
    return rounded(found, 6, *[c for c in found.columns if c != LABEL])


# Authors ---------------------------------------------------------------------


@query
def author_roles(t):
    return authorship.author_groups(t.authors)


@query
def papers_with_roles(t):
    return authorship.papers_with_roles(t.labelled.select("paperid", LABEL, "year"), t.authors, t.affiliations)


@query
def fractional_weights(t):
    return rounded(authorship.fractional_weight(t.authors), 6, "frac_value")


@query
def sequence_weights(t):
    return rounded(authorship.sequence_weight(t.authors), 6, "frac_count")


def label_papers(t: Tables) -> DataFrame:
    return t.labelled.select("paperid", LABEL, "year")


def label_country_counts(t: Tables) -> DataFrame:
    return authorship.country_counts(label_papers(t), t.authors, t.affiliations, "year", LABEL)


def corpus_country_counts(t: Tables) -> DataFrame:
    papers = in_years(t.papers, TREND_YEARS).select("paperid", "year")
    filled = rel.backfill(
        t.affiliations, t.second_source.select("affiliationid", F.col("Alpha3").alias("country")), "affiliationid", "country"
    )
    return authorship.country_counts(papers, t.authors, filled, "year")


@query
def country_position_counts(t):
    return authorship.country_counts(
        label_papers(t), t.authors, t.affiliations, "year", LABEL, "author_position"
    )


def by_region(t: Tables, counts: DataFrame, *within: str) -> DataFrame:
    return shares.group_shares(counts, t.countries, {"country": "country_code"}, "sub_continent", within)


def by_income(t: Tables, counts: DataFrame, *within: str) -> DataFrame:
    return shares.group_shares(counts, t.income_groups, {"country": "country_code"}, "income_group", within)


@query
def region_share(t):
    return rounded(by_region(t, label_country_counts(t), LABEL, "year"), 6, "share")


@query
def region_baseline(t):
    return rounded(by_region(t, corpus_country_counts(t), "year"), 6, "share")


def region_ratio(t: Tables) -> DataFrame:
    label = by_region(t, label_country_counts(t), LABEL, "year")
    return shares.specialisation(label, by_region(t, corpus_country_counts(t), "year"), ["year", "sub_continent"])


def income_ratio(t: Tables) -> DataFrame:
    label = by_income(t, label_country_counts(t), LABEL, "year")
    return shares.specialisation(label, by_income(t, corpus_country_counts(t), "year"), ["year", "income_group"])


@query
def specialisation(t):
    report = rel.sorted_report(region_ratio(t), "sub_continent", LABEL, "year")
    return rounded(report, 6, "share_sdg", "share", "specialisation")


@query
def specialisation_main(t):
    """The report without regions of few papers, and with the highlighted ones marked."""
    marked = shares.region_report(region_ratio(t), ["AFRICA"], ["AMERICA", "EUROPE"])
    return rounded(marked.select(LABEL, "year", "sub_continent", "specialisation", "highlight"), 6, "specialisation")


@query
def income_share(t):
    return rounded(by_income(t, label_country_counts(t), LABEL, "year"), 6, "share")


@query
def income_baseline(t):
    return rounded(by_income(t, corpus_country_counts(t), "year"), 6, "share")


@query
def income_specialisation(t):
    return rounded(income_ratio(t), 6, "share_sdg", "share", "specialisation")


@query
def mean_specialisation(t):
    return rounded(shares.mean_by(income_ratio(t), "specialisation", "income_group", LABEL), 6, "mean_specialisation")


@query
def institutions_by_output(t):
    return authorship.institutions_by_output(t.labelled, t.authors, t.affiliations)


# Fractional output and prestige ----------------------------------------------


def productivity(t: Tables, **options) -> DataFrame:
    return authorship.fractional_productivity(t.labelled, t.authors, **options)


def matched(t: Tables) -> DataFrame:
    return prestige.match_prestige(productivity(t), t.ranking_key, prestige.clean_ranking(t.ranking))


@query
def fractional_productivity(t):
    return rounded(productivity(t), 4, "n_frac_papers", "n_frac_oa_papers", "n_frac_citations")


@query
def fractional_productivity_by_label(t):
    found = productivity(t, weight_over="affiliations")
    return rounded(found, 4, "n_frac_papers", "n_frac_oa_papers", "n_frac_citations")


@query
def fractional_corpus(t):
    return rounded(authorship.fractional_corpus(t.papers, t.authors), 4, "n_frac_papers")


@query
def clean_ranking(t):
    return prestige.clean_ranking(t.ranking)


@query
def prestige_match(t):
    return rounded(matched(t), 4, "n_frac_papers", "n_frac_oa_papers", "n_frac_citations")


@query
def inclusion_rows(t):
    found = prestige.inclusion_rows(matched(t), REPORT_YEAR, merge_labels=True)
    return rounded(found.select("affiliationid", LABEL, "University", "in_ranking", "indicator", "value"), 4, "value")


@query
def ranked_boxstats(t):
    found = prestige.inclusion_stats(matched(t), REPORT_YEAR)
    return rounded(found, 6, "q1", "median", "q3", "lower", "upper")


@query
def prestige_corr(t):
    return rounded(prestige.prestige_correlation(matched(t), REPORT_YEAR), 6, "cor")


@query
def quintile_share(t):
    return rounded(rounded(prestige.bin_shares(matched(t), LABEL, "year"), 4, "n"), 6, "prop")


@query
def quintile_bins(t):
    """All ranking measures of each matched row as quintiles of the period."""
    bins = prestige.prestige_bins(matched(t))
    return bins.select("affiliationid", "year", LABEL, "University", "Period", *prestige.RANKING_NUMBERS)


@query
def quintile_baseline(t):
    corpus = authorship.fractional_corpus(t.papers, t.authors)
    ranked = prestige.match_prestige(corpus, t.ranking_key, prestige.clean_ranking(t.ranking))
    return rounded(rounded(prestige.bin_shares_with_baseline(matched(t), ranked), 4, "n"), 6, "prop")


@query
def quartile_bins(t):
    rows = authorship.papers_with_authors(t.papers.select("paperid", "year"), t.authors)
    output = shares.count_by(rows, "year", "affiliationid")
    binned = output.withColumn("bin", F.col("n"))
    return quantiles.quantile_bins(binned, "bin", "year", quantiles.QUARTILES)


# Gender and open access ------------------------------------------------------


@query
def gender_share(t):
    return rounded(gender.gender_share(t.labelled, t.authors, t.people, LABEL, "year", before=2001), 6, "prop")


@query
def gender_position_share(t):
    keys = [LABEL, "year", "author_position"]
    return rounded(gender.gender_share(t.labelled, t.authors, t.people, *keys, before=2001), 6, "prop")


@query
def oa_year_share(t):
    return rounded(open_access.open_share(t.labelled, LABEL, "year"), 6, "oa_share")


def open_countries(t: Tables, *keys: str) -> DataFrame:
    return open_access.open_by_country(t.labelled, t.authors, t.affiliations, OPEN_YEARS, *keys)


def open_rounded(df: DataFrame) -> DataFrame:
    return rounded(rounded(df, 4, "sum_frac_oa", "sum_frac_total"), 6, "prop_oa")


@query
def oa_country(t):
    return open_rounded(open_countries(t))


@query
def oa_country_label(t):
    return open_rounded(open_countries(t, LABEL))


@query
def indicator_means(t):
    return rounded(open_access.indicator_means(t.indicators, OPEN_YEARS), 6, "value")


def paired(t: Tables, *keys: str) -> DataFrame:
    proper = open_access.proper_countries(t.incomes)
    found = open_access.pair_indicator(open_countries(t, *keys), t.indicators, SEGMENTS, OPEN_YEARS, proper, 10.0)
    return rounded(open_rounded(found), 6, *SEGMENTS)


@query
def oa_indicator(t):
    return paired(t)


@query
def oa_indicator_label(t):
    return paired(t, LABEL)


@query
def oa_prestige_corr(t):
    return rounded(open_access.open_prestige_correlation(matched(t), 20.0), 6, "cor")


# Coverage and records --------------------------------------------------------


def seen(t: Tables) -> DataFrame:
    return coverage.seen_affiliations(t.authors, t.affiliations)


@query
def country_coverage(t):
    return rounded(coverage.coverage(seen(t), "country"), 6, "country_share")


@query
def gap_coverage(t):
    missing = coverage.missing_ids(t.authors, t.affiliations)
    return rounded(coverage.gap_coverage(missing, t.second_source), 6, "country_share")


@query
def agreement(t):
    return rounded(coverage.agreement(seen(t), t.second_source), 6, "correct_countries")


@query
def disagreements(t):
    return coverage.disagreements(seen(t), t.second_source).select("affiliationid", "displayname", "country", "Alpha3")


@query
def missing_country_ids(t):
    return coverage.missing_ids(t.authors, t.affiliations)


@query
def gap_file(t):
    return coverage.gap_file(seen(t), t.second_source)


@query
def backfill_country(t):
    spare = t.second_source.select("affiliationid", F.col("Alpha3").alias("country"))
    return rel.backfill(t.affiliations, spare, "affiliationid", "country")


@query
def import_institutions(t):
    parsed = t.institution_texts.select(records.parse_institutions("record").alias("r")).select("r.*")
    found = records.import_institutions(parsed, t.country_codes)
    return found.select("id", "affiliationid", "country_code", "Alpha3", "works_count", "geo.city", "type")


@query
def record_columns(t):
    """The columns of a record in their fixed order, those at hand only."""
    parsed = t.institution_texts.select(records.parse_institutions("record").alias("r")).select("r.*")
    some = parsed.select("works_count", "country_code", "id", F.lit("extra").alias("note"))
    return rel.in_order(some, [part.split()[0] for part in INSTITUTION.replace("\n", " ").split(", ")])


@query
def count_record_share(t):
    return rounded(records.count_record_share(t.open_counts), 6, "prop")


# Relations, functions and formats --------------------------------------------


@query
def null_safe_join(t):
    """Authors' countries beside the country table, null meeting null or not."""
    cells = shares.count_by(rel.left_join(t.authors, t.affiliations, "affiliationid"), "country")
    marks = t.affiliations.select("country").distinct().withColumn("known", F.lit(1))
    strict = rel.left_join(cells, marks, "country").withColumnRenamed("known", "strict")
    return rel.left_join(strict, marks, "country", null_keys="match", unique=True)


@query
def ordered_labels(t):
    counts = shares.count_by(t.labelled, LABEL, "year")
    ranked = counts.withColumns({"place": fn.rank_in(LABEL, fn.LABEL_ORDER), "day": fn.year_date("year").cast("string")})
    return rel.sorted_report(ranked, "place", "year")


@query
def ordered_incomes(t):
    ranked = t.incomes.withColumn("place", fn.rank_in("income_group", fn.INCOME_ORDER))
    return rel.sorted_report(ranked.select("country_code", "income_group", "place"), "place", "country_code")


@query
def complete_incomes(t):
    return rel.complete(t.incomes)


@query
def european_numbers(t):
    """Prices written with a decimal comma, read back from text."""
    text = F.translate(F.format_number("o_totalprice", 2), ",.", ".,")
    written = t.raw("orders").select(F.col("o_orderkey").alias("paperid"), text.alias("price_text"))
    return written.withColumn("price", fn.european_number("price_text"))


@query
def quoted_rows(t):
    """Papers as quoted lines and read back, an empty DOI turning to null."""
    rows = t.papers.select("paperid", "doi", "papertitle", "year")
    lines = rows.select(F.to_csv(F.struct("*"), files.QUOTED).alias("line"))
    schema = "paperid bigint, doi string, papertitle string, year int"
    return lines.select("line", F.from_csv("line", F.lit(schema), files.HEADER).alias("r")).select("line", "r.*")


@query
def tab_rows(t):
    """Author rows as tab-separated lines without header, read back by position."""
    lines = t.authors.select(F.to_csv(F.struct("*"), files.TABS).alias("line"))
    schema = "paperid bigint, authorid bigint, affiliationid bigint, authorsequencenumber int"
    return lines.select(F.from_csv("line", F.lit(schema), files.TABS).alias("r")).select("r.*")


@query
def author_row_positions(t):
    """All author rows with their position in report order."""
    rows = t.authors.select("paperid", "authorid", "affiliationid", "authorsequencenumber")
    return order.positions(rows, ["-authorsequencenumber", "paperid", "authorid", "affiliationid"])


@query
def null_tokens(t):
    """Affiliations written with NA for a missing country, read back as null."""
    rows = t.affiliations.select("affiliationid", "country", "displayname")
    lines = rows.select(F.to_csv(F.struct("*"), files.NULL_TOKEN).alias("line"))
    schema = "affiliationid bigint, country string, displayname string"
    return lines.select("line", F.from_csv("line", F.lit(schema), files.NULL_TOKEN).alias("r")).select("line", "r.*")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(build: Query):
        return lambda spark, folder: build(Tables(spark, folder))

    return {name: bound(build) for name, build in QUERIES.items()}
